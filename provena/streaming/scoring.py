"""Optional streaming forms: shift scores of arriving embeddings, and the audit log as a file stream.

Not part of the batch semantics: a stream is scored against a fixed reference, micro-batch by micro-batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provena.operators.neighbours import SHIFT_THRESHOLD, detect_shift


def score_stream(queries: DataFrame, reference: DataFrame, out: str, checkpoint: str, threshold: float = SHIFT_THRESHOLD):
    """Start a query that writes the shift findings of each micro-batch below ``out``, one folder a batch, so a replayed batch replaces its own."""

    def score(batch: DataFrame, number: int) -> None:
        detect_shift(reference, batch, threshold).findings.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return queries.writeStream.foreachBatch(score).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_counts(events: DataFrame, size: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Governance events a window and type, with a watermark for late lines."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("events"))


def read_event_stream(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).json(folder)
