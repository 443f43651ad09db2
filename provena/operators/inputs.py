"""Checks of detector inputs: one aggregation over the features, errors on the driver."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provena.errors import DetectorError
from provena.operators.tiles import block_count
from provena.runtime import parallelism
from provena.sources.features import FeatureBatch, validate_batch


@dataclass(frozen=True)
class FeatureShape:
    rows: int
    dim: int

    def blocks(self, spark) -> int:
        return block_count(self.rows, 8 * self.dim, parallelism(spark))


def as_features(source: DataFrame | FeatureBatch) -> DataFrame:
    """Features of a table, or of a batch whose own identity and contents hold."""
    if isinstance(source, FeatureBatch):
        validate_batch(source)
        return source.embeddings.select("image_id", "vector")
    return source


def same_space(a: DataFrame | FeatureBatch, b: DataFrame | FeatureBatch) -> None:
    """Two batches can be compared only within one embedding space."""
    if isinstance(a, FeatureBatch) and isinstance(b, FeatureBatch) and a.info.space_id != b.info.space_id:
        raise DetectorError("the batches lie in different embedding spaces")


def feature_counts(features: DataFrame) -> DataFrame:
    """One row: rows, least and largest dimension, vectors that are null or hold what is no finite number, repeated ids."""
    v = F.col("vector").cast("array<double>")
    bad = F.coalesce(F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(True))
    size = F.coalesce(F.size("vector"), F.lit(0))
    by_id = features.groupBy("image_id").agg(F.count(F.lit(1)).alias("n"), F.min(size).alias("low"), F.max(size).alias("high"), F.count_if(bad).alias("bad"))
    return by_id.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"),
        F.min("low").alias("least_dim"),
        F.max("high").alias("most_dim"),
        F.coalesce(F.sum("bad"), F.lit(0)).alias("not_finite"),
        F.count_if(F.col("n") > 1).alias("repeated_ids"),
    )


def check_features(features: DataFrame, what: str = "features", images: DataFrame | None = None, dim: int | None = None) -> FeatureShape:
    """Every image once, all vectors finite and of one dimension, every image in ``images``; else an error."""
    row = feature_counts(features).first()
    if row["repeated_ids"]:
        raise DetectorError(f"{what}: {row['repeated_ids']} image ids repeat")
    if row["not_finite"]:
        raise DetectorError(f"{what}: {row['not_finite']} vectors are null or hold values that are not finite")
    if row["least_dim"] != row["most_dim"] or (row["row_count"] and not row["most_dim"]) or (dim is not None and row["row_count"] and row["most_dim"] != dim):
        raise DetectorError(f"{what}: vectors have dimensions {row['least_dim']} to {row['most_dim']}" + (f", not {dim}" if dim is not None else ""))
    if images is not None and features.join(images.select("image_id"), "image_id", "left_anti").limit(1).count():
        raise DetectorError(f"{what}: an image is not in the dataset")
    return FeatureShape(row["row_count"], row["most_dim"] or 0)
