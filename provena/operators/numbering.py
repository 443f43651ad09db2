"""Consecutive numbers in a global order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provena.runtime import materialize


def number_in_order(rows: DataFrame, order: Column | list[Column], name: str, first: int = 1) -> DataFrame:
    """Adds consecutive numbers in a global order without one sorted task: ranges are numbered and offset."""
    by = order if isinstance(order, list) else [order]
    ranged = materialize(rows.repartitionByRange(*by).withColumn("_range", F.spark_partition_id()), "numbered")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    counts = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*by))
    joined = ranged.withColumn("_own", own).join(F.broadcast(offsets), "_range")
    return joined.withColumn(name, (F.col("_offset") + F.col("_own") + F.lit(first - 1)).cast("bigint")).drop("_range", "_own", "_offset")
