"""Feature batches: identity, validation, store, extractors and the fallback policy."""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provena.errors import FeatureError, StaleFeatures
from provena.functions.ids import ID_TYPE, id_token, json_string
from provena.runtime import get_text, materialize, put_text, remove_path
from provena.sources.dataset import Dataset
from provena.sources.images import mean_color_vector, rgb

SCHEMA_VERSION = 3


def canonical_json(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), allow_nan=False)


def sha256_label(value) -> str:
    return "sha256:" + hashlib.sha256(canonical_json(value).encode()).hexdigest()


@dataclass(frozen=True)
class BatchInfo:
    dataset_name: str
    backend: str
    model_id: str
    weights_identity: str
    embedding_dim: int
    preprocessing: dict
    normalization: dict
    input_fingerprint: str | None = None
    requested_extractor: str | None = None
    actual_extractor: str | None = None
    fallback_used: bool = False
    fallback_reason: str | None = None
    schema_version: int = SCHEMA_VERSION

    device: str | None = None

    @property
    def space_id(self) -> str:
        return sha256_label(
            {
                "model_id": self.model_id,
                "weights_identity": self.weights_identity,
                "preprocessing": self.preprocessing,
                "embedding_dim": self.embedding_dim,
                "normalization": self.normalization,
            }
        )

    @property
    def cache_key(self) -> str | None:
        """Identity of inputs, embedding space and the extractor that was used; None where the inputs are not known."""
        if self.input_fingerprint is None:
            return None
        return sha256_label(
            {
                "schema_version": self.schema_version,
                "input_fingerprint": self.input_fingerprint,
                "embedding_space_id": self.space_id,
                "requested_extractor": self.requested_extractor or self.backend,
                "actual_extractor": self.actual_extractor or self.backend,
                "fallback_used": self.fallback_used,
            }
        )


@dataclass
class FeatureBatch:
    info: BatchInfo
    embeddings: DataFrame  # image_id, vector (and file columns)
    failures: DataFrame  # image_id, failure_code, reason


def space_id_column(fields: dict[str, Column]) -> Column:
    """The same identity over columns: a hash of canonical JSON with sorted keys."""
    row = F.struct(*[fields[k].alias(k) for k in sorted(fields)])
    return F.concat(F.lit("sha256:"), F.sha2(F.to_json(row, {"ignoreNullFields": "false"}), 256))


def feature_violations(features: DataFrame, dim: int) -> DataFrame:
    """One row of counts: rows, wrong dimension, components that are not finite, zero vectors, repeated ids."""
    v = F.col("vector").cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    counts = features.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_if(F.col("vector").isNull() | (F.size("vector") != dim)).alias("wrong_dimension"),
        F.count_if(F.coalesce(bad, F.lit(False))).alias("not_finite"),
        F.count_if(F.coalesce(F.forall(v, lambda x: x == 0), F.lit(False))).alias("zero_vectors"),
    )
    repeated = features.groupBy("image_id").agg(F.count(F.lit(1)).alias("n")).agg(F.count_if(F.col("n") > 1).alias("repeated_ids"))
    return counts.join(repeated)


def validate_info(info: BatchInfo) -> None:
    """Texts that must not be empty, a positive dimension, and a fallback that is told in full."""
    if info.schema_version != SCHEMA_VERSION:
        raise FeatureError(f"schema version {info.schema_version}")
    for name in ("dataset_name", "backend", "model_id", "weights_identity"):
        if not isinstance(getattr(info, name), str) or not getattr(info, name).strip():
            raise FeatureError(f"{name} must be a text that is not empty")
    if isinstance(info.embedding_dim, bool) or not isinstance(info.embedding_dim, int) or info.embedding_dim <= 0:
        raise FeatureError("embedding_dim must be a positive integer")
    for name in ("preprocessing", "normalization"):
        if not isinstance(getattr(info, name), dict):
            raise FeatureError(f"{name} must be a mapping")
    if info.fallback_used and (not info.fallback_reason or (info.actual_extractor or info.backend) == (info.requested_extractor or info.backend)):
        raise FeatureError("a fallback needs a reason and another extractor than the one asked for")
    if not info.fallback_used and info.fallback_reason:
        raise FeatureError("a reason for a fallback that was not used")


def validate_batch(batch: FeatureBatch, space_id: str | None = None) -> None:
    validate_info(batch.info)
    if space_id is not None and space_id != batch.info.space_id:
        raise FeatureError("embedding spaces differ")
    row = feature_violations(batch.embeddings, batch.info.embedding_dim).first()
    for name in ("wrong_dimension", "not_finite", "repeated_ids"):
        if row[name]:
            raise FeatureError(f"{row[name]} rows: {name}")
    if batch.failures.groupBy("image_id").count().filter("count > 1").limit(1).count():
        raise FeatureError("an image failed twice")
    if batch.embeddings.join(batch.failures, "image_id", "left_semi").limit(1).count():
        raise FeatureError("an image is both embedded and failed")


# --- store ----------------------------------------------------------------------------------------------------------


def safe_stem(text: str) -> str:
    return re.sub(r"[^A-Za-z0-9._-]+", "_", text)


def save_batch(batch: FeatureBatch, folder: str) -> str:
    """Write the batch below ``folder`` and return its path.

    Every save has a folder of its own, and one small text file names the folder that counts. It is written last and
    replaces the former one by a rename, so readers see the old batch or the new one, never a mixture; a save that
    fails leaves the old one. The former folder goes after the switch.
    """
    if batch.info.cache_key is None:
        raise FeatureError("a batch without input fingerprint is not stored")
    validate_info(batch.info)
    spark = batch.embeddings.sparkSession
    path = f"{folder.rstrip('/')}/{safe_stem(batch.info.dataset_name)}-{batch.info.cache_key[7:23]}"
    before = _current(spark, path)
    version = f"v-{uuid.uuid4().hex}"
    try:
        batch.embeddings.write.parquet(f"{path}/{version}/embeddings")
        batch.failures.write.parquet(f"{path}/{version}/failures")
        meta = asdict(batch.info) | {"space_id": batch.info.space_id, "cache_key": batch.info.cache_key}
        spark.createDataFrame([(canonical_json(meta),)], "value string").coalesce(1).write.text(f"{path}/{version}/meta")
        put_text(spark, f"{path}/CURRENT", version)
    except Exception:
        remove_path(spark, f"{path}/{version}")
        raise
    if before:
        remove_path(spark, f"{path}/{before}")
    return path


def _current(spark: SparkSession, path: str) -> str | None:
    return get_text(spark, f"{path}/CURRENT")


def load_batch(spark: SparkSession, path: str, expected_cache_key: str | None = None) -> FeatureBatch:
    """The batch that counts at ``path``; its metadata, identity and contents are checked."""
    version = _current(spark, path)
    if version is None:
        raise FeatureError(f"no feature batch at {path}")
    try:
        meta = json.loads(spark.read.text(f"{path}/{version}/meta").first()["value"])
        space, key = meta.pop("space_id"), meta.pop("cache_key")
        info = BatchInfo(**meta)
    except Exception as e:
        raise FeatureError(f"no readable metadata at {path}") from e
    validate_info(info)
    if (space, key) != (info.space_id, info.cache_key):
        raise FeatureError("stored identity differs from the metadata")
    if expected_cache_key is not None and expected_cache_key != key:
        raise StaleFeatures("the stored batch was made from other inputs")
    batch = FeatureBatch(info, spark.read.parquet(f"{path}/{version}/embeddings"), spark.read.parquet(f"{path}/{version}/failures"))
    for name, frame, columns in (("embeddings", batch.embeddings, ("image_id", "vector")), ("failures", batch.failures, ("image_id", "failure_code", "reason"))):
        missing = [c for c in columns if c not in frame.columns]
        if missing:
            raise FeatureError(f"stored {name} lack {', '.join(missing)}")
    validate_batch(batch)
    return batch


def content_fingerprint(rows: DataFrame, key: str, content: str) -> DataFrame:
    """One row: a hash over the hashes of every row's content, in key order, by a two-level fold.

    Rows are hashed where they lie; only hashes are ordered, first within 256 bins of the key's hash, then bin by bin.
    """
    body = F.coalesce(F.col(content), F.lit(MISSING)).cast("binary")
    each = rows.select(F.col(key).cast("string").alias("k"), F.sha2(body, 256).alias("h"))
    bins = each.groupBy(F.substring(F.md5("k"), 1, 2).alias("bin")).agg(_folded("k").alias("h"))
    return bins.agg(_folded("bin").alias("fingerprint"))


def _folded(key: str) -> Column:
    """SHA-256 of the lines ``key=h``, ordered by key."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct(key, "h"))), lambda x: F.concat(x[key].cast("string"), F.lit("="), x["h"]))
    return F.sha2(F.array_join(lines, "\n"), 256)


#: fixed values: marks in place of a file's bytes
NO_PATH, MISSING = "|no-path|", "|unreadable-or-missing|"
FOLD_ROWS = 4096


def file_hashes(spark: SparkSession, folder: str) -> DataFrame:
    """``file_path, content_hash`` of all files of a folder, hashed where they are read."""
    files = spark.read.format("binaryFile").load(folder)
    return files.select(plain_path(F.col("path")).alias("file_path"), F.sha2("content", 256).alias("content_hash"))


def plain_path(c: Column) -> Column:
    """A path without the scheme of local files."""
    return F.regexp_replace(c, "^file:/+", "/")


def dataset_fingerprint(dataset: Dataset, hashes: DataFrame) -> str:
    """Identity of a dataset: its name, format and number of images, and every image's identity and bytes in dataset order.

    ``hashes``: ``file_path, content_hash``. Images are hashed where they lie, ``FOLD_ROWS`` of them in order make one line, and these
    lines in order the whole; images without a path or with a path that is not in ``hashes`` count as such.
    """
    images = dataset.images.withColumn("at", plain_path(F.col("file_path")))
    known = hashes.select(F.col("file_path").alias("at"), "content_hash")

    def text(c: str) -> Column:
        return F.when(F.col(c).isNull(), "null").otherwise(json_string(F.col(c)))

    def whole(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit("null"))

    fields = [("file_name", text("file_name")), ("file_path", text("at")), ("height", whole("height")), ("image_id", id_token(F.col("image_id"))), ("width", whole("width"))]
    identity = F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(F.lit(f'"{n}":'), c) for n, c in fields]), F.lit("}"))
    body = F.when(F.col("at").isNull(), NO_PATH).otherwise(F.coalesce("content_hash", F.lit(MISSING)))
    each = images.join(known, "at", "left").select(F.col("ordinal").alias("k"), F.sha2(F.concat(identity, body), 256).alias("h"))
    bins = each.groupBy(F.floor(F.col("k") / FOLD_ROWS).alias("bin")).agg(_folded("k").alias("h"), F.count(F.lit(1)).alias("n"))
    row = bins.agg(_folded("bin").alias("h"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    header = canonical_json({"name": dataset.name, "format": dataset.format, "images": row["n"]})
    return sha256_label([header, row["h"]])


def ordered_failures(failures: DataFrame, images: DataFrame) -> DataFrame:
    """Failures in the dataset's order."""
    return failures.join(images.select("image_id", "ordinal"), "image_id", "left").orderBy(F.col("ordinal").asc_nulls_last(), "image_id").drop("ordinal")


# --- extraction -----------------------------------------------------------------------------------------------------

#: of a list of RGB arrays the matrix of their embeddings
Extractor = Callable[[list[np.ndarray]], np.ndarray]


def dummy_extractor(dim: int) -> Extractor:
    return lambda images: np.stack([mean_color_vector(p, dim) for p in images])


def extract(images: DataFrame, extractor: Extractor, dim: int, batch_size: int = 16) -> tuple[DataFrame, DataFrame]:
    """Embeddings and failures of ``image_id, file_path, height, width, channels, data`` rows (height -1: not decodable).

    An extractor that raises gives its batch the code ``model_inference_error``; a wrong shape ends the run.
    """
    return _split(_extracted(images, extractor, dim, batch_size))


def _failure(path: str | None, height: float | None, content_known: bool) -> str | None:
    if path is None:
        return "image_path_missing"
    if height is None or height != height:
        return "image_not_found"
    if height == 0:
        return "invalid_image_dimensions"
    if height < 0:
        return "image_decode_error" if content_known else "unrecognized_image"
    return None


def _extracted(images: DataFrame, extractor: Extractor, dim: int, batch_size: int = 16) -> DataFrame:
    schema = f"image_id {ID_TYPE}, file_path string, vector array<float>, failure_code string, reason string"

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for start in range(0, len(frame), batch_size):
                part = frame.iloc[start : start + batch_size]
                rows, pixels, good = [], [], []
                for r in part.itertuples(index=False):
                    code = _failure(r.file_path, r.height, bool(getattr(r, "known_format", False)))
                    if code is None:
                        good.append(len(rows))
                        pixels.append(rgb(int(r.height), int(r.width), int(r.channels), r.data))
                    rows.append([r.image_id, r.file_path, None, code, code])
                if pixels:
                    try:
                        vectors = np.asarray(extractor(pixels), np.float32)
                    except Exception as e:
                        for i in good:
                            rows[i][3:] = ["model_inference_error", str(e)]
                    else:
                        if vectors.shape != (len(pixels), dim) or not np.isfinite(vectors).all():
                            raise FeatureError("the extractor gave a wrong shape or values that are not finite")
                        for i, v in zip(good, vectors, strict=True):
                            rows[i][2] = v.tolist()
                yield pd.DataFrame(rows, columns=["image_id", "file_path", "vector", "failure_code", "reason"])

    return images.mapInPandas(work, schema)


def _split(done: DataFrame) -> tuple[DataFrame, DataFrame]:
    found = done.filter("vector is not null").select("image_id", "file_path", "vector")
    return found, done.filter("vector is null").select("image_id", "file_path", "failure_code", "reason")


def extract_with_fallback(images: DataFrame, primary: tuple[BatchInfo, Extractor], fallback: tuple[BatchInfo, Extractor] | None = None) -> FeatureBatch:
    """Run the primary extractor; if it raises or fails on any batch, the whole run is the fallback's, or an error without one.

    Images that cannot be decoded are failures of their own and cause no fallback. Results are written once, so a lost
    executor does not run an extractor again.
    """
    info, run = primary
    try:
        batch = _run(images, info, run)
        failed = batch.failures.filter("failure_code = 'model_inference_error'").limit(1).collect()
        if not failed:
            return FeatureBatch(replace(info, requested_extractor=info.backend, actual_extractor=info.backend), batch.embeddings, batch.failures)
        reason = f"model_inference_error: {failed[0]['reason']}"
    except Exception as e:
        if fallback is None:
            raise FeatureError(f"{info.backend} failed and no fallback is given: {type(e).__name__}") from e
        reason = type(e).__name__
    if fallback is None:
        raise FeatureError(f"{info.backend} failed and no fallback is given: {reason}")
    other, run = fallback
    try:
        batch = _run(images, other, run)
    except Exception as e:
        raise FeatureError(f"{info.backend} failed ({reason}) and so did {other.backend}: {type(e).__name__}") from e
    told = replace(other, requested_extractor=info.backend, actual_extractor=other.backend, fallback_used=True, fallback_reason=reason)
    return FeatureBatch(told, batch.embeddings, batch.failures)


def _run(images: DataFrame, info: BatchInfo, run: Extractor) -> FeatureBatch:
    done = materialize(_extracted(images, run, info.embedding_dim), "features")
    return FeatureBatch(info, *_split(done))
