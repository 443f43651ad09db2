"""Image files, learned extractors, identities and the store."""

import hashlib
import json
import os
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from provena import errors as er
from provena.functions.ids import ID_TYPE
from provena.operators import inputs
from provena.operators import near_duplicates as nd
from provena.operators import neighbours as nb
from provena.sources import extractors as ex
from provena.sources import features as ft
from provena.sources import images as im
from provena.sources.dataset import Dataset


def chunk(kind, data):
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def png(pixels):
    """A PNG of an RGB array."""
    h, w, _ = pixels.shape
    lines = b"".join(b"\0" + pixels[y].astype(np.uint8).tobytes() for y in range(h))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def exif(way, order="<"):
    tiff = (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 8) + struct.pack(order + "H", 1) + struct.pack(order + "HHIHH", 0x0112, 3, 1, way, 0)
    body = b"Exif\0\0" + tiff
    return b"\xff\xd8\xff\xe0\0\x04ab\xff\xe1" + struct.pack(">H", len(body) + 2) + body + b"\xff\xda\0\x02"


def test_orientation():
    assert [im.orientation(exif(w, o)) for w in (1, 6, 8, 9) for o in "<>"] == [1, 1, 6, 6, 8, 8, 1, 1]
    for data in (b"", b"\xff\xd8", exif(6)[:24], png(np.zeros((1, 1, 3)))):
        assert im.orientation(data) == 1
    a = np.arange(6).reshape(2, 3)
    want = {1: a, 2: a[:, ::-1], 3: np.rot90(a, 2), 4: a[::-1], 5: a.T, 6: np.rot90(a, -1), 7: np.rot90(a, 2).T, 8: np.rot90(a)}
    for way, w in want.items():
        assert (im.upright(a, way) == w).all()


def scene(seed):
    rng = np.random.default_rng(seed)
    return np.kron(rng.integers(0, 255, (4, 4, 3)), np.ones((12, 12, 1))).astype(np.uint8)


def test_image_duplicates_from_files(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(png(scene(1)))
    (tmp_path / "b.png").write_bytes(png(np.clip(scene(1).astype(int) + 2, 0, 255)))
    (tmp_path / "c.png").write_bytes(png(scene(2)))
    (tmp_path / "broken.png").write_bytes(png(scene(3))[:60])
    rows = [(("int", "1"), f"{tmp_path}/a.png"), (("int", "2"), f"file:{tmp_path}/b.png"), (("str", "1"), f"{tmp_path}/c.png"), (("int", "4"), f"{tmp_path}/broken.png"), (("int", "5"), None), (("int", "6"), f"{tmp_path}/none.png")]
    images = spark.createDataFrame(rows, f"image_id {ID_TYPE}, file_path string")
    pixels = im.read_images(spark, f"{tmp_path}/*.png")
    got = nd.detect_image_duplicates(images, pixels)
    assert {(r.image_id.id, r.failure_code) for r in got.failures.collect()} == {("4", "image_decode_error"), ("5", "missing_path"), ("6", "missing_image")}
    assert [(r.image_a.id, r.image_b.id) for r in nd.ordered_pairs(got.pairs).collect()] == [("1", "2")]
    s = got.summary.first()
    assert (s.image_count, s.pair_count, s.cluster_count, s.failed_hashes) == (3, 1, 1, 3)
    with pytest.raises(er.DetectorError):
        nd.detect_image_duplicates(images.unionAll(images.limit(1)), pixels)


def checkpoint(folder, **config):
    os.makedirs(folder)
    with open(f"{folder}/config.json", "w") as f:
        json.dump({"model_type": "dinov2", "hidden_size": 384, "patch_size": 14, **config}, f)
    with open(f"{folder}/model.safetensors", "wb") as f:
        f.write(b"weights")
    return folder


def test_weight_identities(tmp_path):
    good = checkpoint(str(tmp_path / "good"))
    digest = hashlib.sha256()
    for name in ("config.json", "model.safetensors"):
        digest.update(name.encode())
        digest.update(open(f"{good}/{name}", "rb").read())
    assert ex.folder_identity(good) == "sha256:" + digest.hexdigest()
    with pytest.raises(er.IncompatibleWeights):
        ex.folder_identity(checkpoint(str(tmp_path / "wide"), hidden_size=768))
    with pytest.raises(er.WeightsNotFound):
        ex.folder_identity(str(tmp_path / "none"))
    os.remove(f"{good}/model.safetensors")
    with pytest.raises(er.WeightsNotFound):
        ex.folder_identity(good)
    (tmp_path / "r.pth").write_bytes(b"x")
    assert ex.file_identity(str(tmp_path / "r.pth")) == "sha256:" + hashlib.sha256(b"x").hexdigest()
    with pytest.raises(er.WeightsNotFound):
        ex.file_identity(str(tmp_path / "none"))


def test_devices():
    assert [ex.resolve_device(*x) for x in (("auto", None), ("auto", False), ("auto", True), ("cpu", True), ("cuda", True))] == ["cpu", "cpu", "cuda", "cpu", "cuda"]
    for wanted, cuda in (("cuda", False), ("cuda", None), ("tpu", True)):
        with pytest.raises(er.BackendUnavailable):
            ex.resolve_device(wanted, cuda)


def pictures(spark):
    rows = [(("int", str(i)), f"/x/{i}.png", 8, 8, 3, bytes(np.full((8, 8, 3), 20 * i, np.uint8))) for i in range(5)]
    rows.append((("int", "9"), "/x/9.png", -1, -1, -1, b""))
    return spark.createDataFrame(rows, f"image_id {ID_TYPE}, file_path string, height int, width int, channels int, data binary")


def test_two_extractors(spark, tmp_path):
    def tone(pixels):
        return np.repeat(pixels.mean((1, 2, 3))[:, None], 384, 1)

    def wide(pixels):
        return np.repeat(pixels.mean((1, 2, 3))[:, None], 2048, 1)

    def broken(pixels):
        raise RuntimeError("no")

    folder = checkpoint(str(tmp_path / "m"))
    (tmp_path / "r.pth").write_bytes(b"x")
    paths = (folder, str(tmp_path / "r.pth"))
    one = ex.extract_features(pictures(spark), "d", *paths, forwards=(tone, None))
    assert (one.info.actual_extractor, one.info.fallback_used, one.embeddings.count(), one.failures.count()) == ("dinov2", False, 5, 1)
    ft.validate_batch(one)
    two = ex.extract_features(pictures(spark), "d", *paths, allow_fallback=True, forwards=(broken, wide))
    assert (two.info.requested_extractor, two.info.actual_extractor, two.info.fallback_used) == ("dinov2", "resnet50", True)
    assert two.info.fallback_reason.startswith("model_inference_error") and two.embeddings.first().vector.__len__() == 2048
    with pytest.raises(er.FeatureError):
        ex.extract_features(pictures(spark), "d", *paths, forwards=(broken, None))


def info(**k):
    return ft.BatchInfo(**{"dataset_name": "d", "backend": "b", "model_id": "m", "weights_identity": "w", "embedding_dim": 2, "preprocessing": {}, "normalization": {}, "input_fingerprint": "f", **k})


def test_cache_keys_tell_extractors_apart():
    plain, used = info(), info(requested_extractor="a", actual_extractor="b", fallback_used=True, fallback_reason="r")
    assert plain.space_id == used.space_id and plain.cache_key != used.cache_key
    assert info(input_fingerprint=None).cache_key is None and info(input_fingerprint="g").cache_key != plain.cache_key
    for bad in (info(embedding_dim=0), info(model_id=" "), info(fallback_used=True), info(fallback_reason="r"), info(schema_version=1)):
        with pytest.raises(er.FeatureError):
            ft.validate_info(bad)


def batch(spark, rows, **k):
    vectors = spark.createDataFrame([(("int", str(i)), v) for i, v in rows], f"image_id {ID_TYPE}, vector array<float>")
    return ft.FeatureBatch(info(**k), vectors, spark.createDataFrame([], f"image_id {ID_TYPE}, failure_code string, reason string"))


def test_a_save_that_fails_leaves_the_former_batch(spark, tmp_path):
    old = batch(spark, [(1, [1.0, 0.0])])
    path = ft.save_batch(old, str(tmp_path))
    new = batch(spark, [(1, [0.0, 1.0]), (2, [1.0, 1.0])])
    # the failures cannot be written: the embeddings already are
    lost = ft.FeatureBatch(new.info, new.embeddings, new.failures.withColumn("reason", F.raise_error(F.lit("disk"))).unionAll(new.failures.sparkSession.createDataFrame([(("int", "3"), "x", "y")], new.failures.schema).withColumn("reason", F.raise_error(F.lit("disk")))))
    with pytest.raises(Exception, match="disk"):
        ft.save_batch(lost, str(tmp_path))
    assert [list(r.vector) for r in ft.load_batch(spark, path).embeddings.collect()] == [[1.0, 0.0]]
    assert ft.save_batch(new, str(tmp_path)) == path
    assert ft.load_batch(spark, path, new.info.cache_key).embeddings.count() == 2
    assert len([n for n in os.listdir(path) if n.startswith("v-")]) == 1


def test_detectors_check_batches(spark):
    good = batch(spark, [(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [0.0, 1.0])])
    assert nd.detect_near_duplicates(good, 0.9).pairs.count() == 1
    other = batch(spark, [(1, [1.0, 0.0])], model_id="other")
    with pytest.raises(er.DetectorError, match="spaces"):
        nb.detect_shift(good, other)
    with pytest.raises(er.FeatureError):
        nd.detect_near_duplicates(batch(spark, [(1, [1.0, 0.0, 0.0])]))
    labels = spark.createDataFrame([(("int", "1"), [1])], f"image_id {ID_TYPE}, labels array<bigint>")
    with pytest.raises(er.DetectorError, match="not in the dataset"):
        nb.detect_label_disagreement(labels, good, images=labels.select("image_id"))
    for rows in ([(1, [1.0, 0.0]), (1, [1.0, 0.0])], [(1, [1.0, float("nan")])], [(1, [1.0]), (2, [1.0, 2.0])], [(1, None)], [(1, [])]):
        with pytest.raises(er.DetectorError):
            inputs.check_features(batch(spark, rows).embeddings)


def test_dataset_fingerprint(spark, tmp_path):
    for n in "ab":
        (tmp_path / f"{n}.png").write_bytes(png(scene(ord(n))))
    rows = [(("int", "1"), 0, "a.png", 48, 48, f"{tmp_path}/a.png"), (("str", "x"), 1, "b.png", 48, 48, f"{tmp_path}/b.png"), (("int", "3"), 2, "c.png", 1, 1, None), (("int", "4"), 3, "d.png", 1, 1, "/none")]
    schema = f"image_id {ID_TYPE}, ordinal bigint, file_name string, width int, height int, file_path string"

    def fingerprint(rows):
        d = spark.createDataFrame(rows, schema)
        return ft.dataset_fingerprint(Dataset("d", "coco", "", d, d, d), ft.file_hashes(spark, str(tmp_path)))

    first = fingerprint(rows)
    assert first == fingerprint(rows[::-1])
    swapped = [(*rows[0][:1], 1, *rows[0][2:]), (*rows[1][:1], 0, *rows[1][2:]), *rows[2:]]
    assert len({first, fingerprint(rows[:3]), fingerprint(swapped), fingerprint([(*rows[0][:3], 47, *rows[0][4:]), *rows[1:]])}) == 4
    (tmp_path / "b.png").write_bytes(png(scene(9)))
    assert fingerprint(rows) != first
    assert fingerprint([]).startswith("sha256:")
