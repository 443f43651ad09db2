import json
import struct

import numpy as np
import pytest

from provena import errors as er
from provena.sources import features as ft
from provena.sources import images as im
from provena.sources.detect import detect_format, load_dataset


def png(w, h):
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + struct.pack(">II", w, h) + b"\x08\x02\0\0\0"


COCO = {
    "images": [{"id": 1, "file_name": "img1.jpg", "width": 640, "height": 480}, {"id": 2, "file_name": "img2.jpg", "width": 800, "height": 600}, {"id": "3", "file_name": "img3.jpg", "width": 1024, "height": 768}],
    "categories": [{"id": 1, "name": "vehicle"}, {"id": 2, "name": "pedestrian"}],
    "annotations": [{"id": 101, "image_id": 1, "category_id": 1, "bbox": [10, 20, 50, 60], "area": 3000, "iscrowd": 0}, {"id": 102, "image_id": 1, "category_id": 2, "bbox": [100, 150, 30, 80]}],
}


def write(path, doc):
    path.write_text(json.dumps(doc))
    return str(path)


def test_coco(spark, tmp_path):
    d = load_dataset(spark, write(tmp_path / "a.json", COCO))
    assert tuple(d.counts().first()) == (3, 2)
    assert {(r.image_id.id_type, r.image_id.id) for r in d.images.collect()} == {("int", "1"), ("int", "2"), ("str", "3")}
    second = d.annotations.filter("annotation_id.id = '102'").first()
    assert (second.area, second.iscrowd, second.category_name, list(second.warnings)) == (2400.0, None, "pedestrian", [])
    assert d.get_image("1").first().file_name == "img1.jpg"


@pytest.mark.parametrize(
    "change, error",
    [
        (lambda c: c.pop("images"), er.MalformedSource),
        (lambda c: c["images"].append(c["images"][0]), er.MalformedSource),
        (lambda c: c["annotations"][0].update(image_id=9), er.InvalidAnnotation),
        (lambda c: c["annotations"][0].update(category_id=9), er.InvalidAnnotation),
        (lambda c: c["annotations"][0].update(bbox=[1, 1, -1, 1]), er.InvalidBox),
        (lambda c: c["images"][0].update(width=0), er.MalformedSource),
    ],
)
def test_coco_errors(spark, tmp_path, change, error):
    doc = json.loads(json.dumps(COCO))
    change(doc)
    with pytest.raises(error):
        load_dataset(spark, write(tmp_path / "a.json", doc))


def test_coco_bounds(spark, tmp_path):
    doc = json.loads(json.dumps(COCO))
    doc["annotations"][0]["bbox"] = [600, 10, 150, 50]
    path = write(tmp_path / "a.json", doc)
    d = load_dataset(spark, path)
    assert len(d.annotations.filter("annotation_id.id = '101'").first().warnings) == 1
    assert len(d.images.filter("image_id.id = '1'").first().warnings) == 1
    with pytest.raises(er.BoxOutOfBounds):
        load_dataset(spark, path, strict_bounds=True)
    (tmp_path / "b.json").write_text("{")
    with pytest.raises(er.MalformedSource):
        load_dataset(spark, str(tmp_path / "b.json"))


def yolo_folder(tmp_path, lines="0 0.5 0.5 0.5 0.5\n\n1 0.2 0.3 0.1 0.2\n", classes="drone\nairplane\nhelicopter\n"):
    (tmp_path / "images").mkdir()
    (tmp_path / "labels").mkdir()
    for name, size in (("img1", (640, 480)), ("img2", (800, 600)), ("img3", (1920, 1080))):
        (tmp_path / "images" / f"{name}.png").write_bytes(png(*size))
    (tmp_path / "labels" / "img1.txt").write_text(lines)
    (tmp_path / "labels" / "img2.txt").write_text("")
    if classes:
        (tmp_path / "classes.txt").write_text(classes)
    return str(tmp_path)


def test_yolo(spark, tmp_path):
    d = load_dataset(spark, yolo_folder(tmp_path))
    assert d.format == "yolo" and tuple(d.counts().first()) == (3, 2)
    a = d.annotations.orderBy("ann_ordinal").collect()
    assert (a[0].xmin, a[0].ymin, a[0].width, a[0].height, a[0].category_name) == (160, 120, 320, 240, "drone")
    assert [x.annotation_id.id for x in a] == ["1", "2"] and a[1].ann_ordinal == 2


@pytest.mark.parametrize("lines, error", [("0 1 2", er.InvalidAnnotation), ("x 0.5 0.5 0.5 0.5", er.InvalidAnnotation), ("-1 0.5 0.5 0.5 0.5", er.InvalidAnnotation), ("7 0.5 0.5 0.5 0.5", er.InvalidAnnotation), ("0 0.5 0.5 0 0.5", er.InvalidBox), ("0 0.5d 0.5 0.5 0.5", er.InvalidAnnotation)])
def test_yolo_errors(spark, tmp_path, lines, error):
    with pytest.raises(error):
        load_dataset(spark, yolo_folder(tmp_path, lines))


def test_yolo_orphans_and_spill(spark, tmp_path):
    path = yolo_folder(tmp_path, "0 0.95 0.5 0.2 0.4", None)
    (tmp_path / "labels" / "lost.txt").write_text("")
    d = load_dataset(spark, path)
    assert len(d.warnings) == 2 and d.annotations.first().category_name is None
    assert len(d.annotations.first().warnings) == 1
    with pytest.raises(er.InvalidAnnotation):
        load_dataset(spark, path, strict_orphans=True)
    with pytest.raises(er.BoxOutOfBounds):
        load_dataset(spark, path, strict_bounds=True, strict_orphans=False)


def test_yolo_suffixes_in_any_case(spark, tmp_path):
    path = yolo_folder(tmp_path)
    (tmp_path / "images" / "img1.png").rename(tmp_path / "images" / "img1.pNg")
    d = load_dataset(spark, path)
    assert tuple(d.counts().first()) == (3, 2) and not d.warnings


def test_detection(tmp_path):
    (tmp_path / "a.json").write_text("{}")
    assert detect_format(str(tmp_path)) == "coco" and detect_format(str(tmp_path / "a.json")) == "coco"
    (tmp_path / "labels").mkdir()
    assert detect_format(str(tmp_path)) == "yolo"
    with pytest.raises(er.SourceNotFound):
        detect_format(str(tmp_path / "none"))


def test_headers():
    assert im.header_size(png(7, 5)) == (7, 5)
    assert im.header_size(b"BM" + b"\0" * 12 + struct.pack("<Iii", 40, 6, -4)) == (6, 4)
    assert im.header_size(b"BM" + b"\0" * 12 + struct.pack("<IHH", 12, 6, 4) + b"\0" * 4) == (6, 4)
    jpeg = b"\xff\xd8\xff\xe0" + struct.pack(">H", 4) + b"ab" + b"\xff\xc0" + struct.pack(">HBHH", 11, 8, 30, 40) + b"\0" * 4
    assert im.header_size(jpeg) == (40, 30)
    assert im.header_size(b"") is None and im.header_size(jpeg[:12]) is None


def test_perceptual_hash():
    a = np.full((64, 64, 3), 255, np.uint8)
    a[8:51, 8:31] = 0
    b = a.copy()
    b[8:51, 31] = 0
    c = np.zeros((64, 64, 3), np.uint8)
    y, x = np.mgrid[:64, :64]
    c[(x - 32) ** 2 + (y - 32) ** 2 < 24**2] = 255
    h = [im.perceptual_hash(p) for p in (a, b, c)]
    assert (h[0] ^ h[1]).bit_count() <= 8 < (h[0] ^ h[2]).bit_count()


def info(**k):
    return ft.BatchInfo(**{"dataset_name": "d s", "backend": "dummy", "model_id": "m", "weights_identity": "w", "embedding_dim": 2, "preprocessing": {}, "normalization": {}, "input_fingerprint": "f", **k})


def test_store(spark, tmp_path):
    rows = spark.createDataFrame([(("int", "101"), [1.0, 0.0]), (("str", "frame_002"), [0.0, 1.0])], f"image_id {ft.ID_TYPE}, vector array<float>")
    failed = spark.createDataFrame([(("int", "202"), "x", "r")], f"image_id {ft.ID_TYPE}, failure_code string, reason string")
    batch = ft.FeatureBatch(info(), rows, failed)
    path = ft.save_batch(batch, str(tmp_path))
    again = ft.load_batch(spark, path, batch.info.cache_key)
    assert {r.image_id.id_type for r in again.embeddings.collect()} == {"int", "str"} and again.info == batch.info
    with pytest.raises(er.StaleFeatures):
        ft.load_batch(spark, path, info(input_fingerprint="g").cache_key)
    with pytest.raises(er.FeatureError):
        ft.save_batch(ft.FeatureBatch(info(input_fingerprint=None), rows, failed), str(tmp_path))
    assert len({info(**k).space_id for k in ({}, {"model_id": "n"}, {"weights_identity": "v"}, {"embedding_dim": 3}, {"preprocessing": {"a": 1}}, {"normalization": {"a": 1}})}) == 6
    with pytest.raises(er.FeatureError):
        ft.validate_batch(ft.FeatureBatch(info(embedding_dim=3), rows, failed))


def pixels(spark):
    red = bytes([0, 0, 255] * 4)
    return spark.createDataFrame([(("int", "1"), "a", 2, 2, 3, red), (("int", "2"), "b", 2, 2, 3, red), (("int", "3"), "c", -1, -1, -1, None), (("int", "4"), None, -1, -1, -1, None)], f"image_id {ft.ID_TYPE}, file_path string, height int, width int, channels int, data binary")


def test_extraction_and_fallback(spark):
    good, bad = ft.extract(pixels(spark), ft.dummy_extractor(4), 4)
    v = [list(r.vector) for r in good.collect()]
    assert v[0] == v[1] and abs(sum(x * x for x in v[0]) - 1) < 1e-6
    assert {r.image_id.id: r.failure_code for r in bad.collect()} == {"3": "unrecognized_image", "4": "image_path_missing"}

    def broken(images):
        raise RuntimeError("no")

    batch = ft.extract_with_fallback(pixels(spark), (info(backend="primary"), broken), (info(backend="dummy", embedding_dim=4), ft.dummy_extractor(4)))
    assert batch.info.fallback_used and batch.info.fallback_reason == "model_inference_error: no" and batch.embeddings.count() == 2
