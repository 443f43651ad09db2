"""Connected components of an undirected edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provena.runtime import discard, is_small, materialize


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, label`` for every node with an edge to another; label is the component's least node.

    Each round takes the least label among neighbours and then follows the label's own label, so chains halve. Rounds
    are written to the shared scratch folder. Null ends and self loops are ignored.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v")
    both = materialize(pairs.union(pairs.select("v", "u")).distinct(), "cc-edges")
    start = both.groupBy("u").agg(F.min("v").alias("v"))
    labels = materialize(start.select(F.col("u").alias("node"), F.least("u", "v").alias("label")), "cc-labels")
    few = is_small(labels)  # labels of few nodes are broadcast; else they meet by a shuffle that splits hot ones

    def dealt(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if few else df

    while True:
        near = both.join(dealt(labels.select(F.col("node").alias("v"), "label")), "v").groupBy("u").agg(F.min("label").alias("near"))
        near = near.withColumnRenamed("u", "node")
        lower = materialize(near.join(dealt(labels), "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label")), "cc-lower")
        jump = lower.select(F.col("node").alias("label"), F.col("label").alias("beyond"))
        step = materialize(lower.join(dealt(jump), "label").select("node", "old", F.least("label", "beyond").alias("label")), "cc-step")
        changed = step.filter("old <> label").limit(1).count()
        discard(lower)
        discard(labels)
        labels = step
        if not changed:
            discard(both)
            return labels.select("node", "label")
