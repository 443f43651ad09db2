"""Query sets against all vectors, in blocks.

A stated query set is cut into waves of at most ``WAVE`` queries and ``WAVE_BYTES`` bytes by a hash. One wave at a time is collected
and broadcast (its size is checked), and every partition of the table searches its own rows block by block. Each block gives at most k
rows a query; a window keeps the best k of them. Of several waves each is written before the next is collected.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provena.runtime import materialize, ship_package

WAVE = 8192
WAVE_BYTES = 128 << 20
BLOCK = 16384

#: of queries (ids, matrix) a searcher; of (ids, matrix) of a block it gives arrays: query place, vec_id, score
Search = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


def usable(column: Column, allow_zero: bool) -> Column:
    """Vectors that take part: not null or empty, all components finite (and not all zero)."""
    v = column.cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    fine = column.isNotNull() & (F.size(v) > 0) & fine
    return fine if allow_zero else fine & F.exists(v, lambda x: x != 0)


def blocks(batches: Iterator[pa.RecordBatch], size: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (vec_id, vector) as blocks of one dimension each: ids and a matrix of doubles."""
    held: dict[int, tuple[list[np.ndarray], list[np.ndarray], int]] = {}
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        lists = batch.column(1)
        lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
        flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        starts = np.cumsum(lengths) - lengths
        for dim in np.unique(lengths):
            mine = np.flatnonzero(lengths == dim)
            matrix = flat[(starts[mine][:, None] + np.arange(dim)).reshape(-1)].reshape(len(mine), dim)
            a, b, n = held.get(int(dim), ([], [], 0))
            a.append(ids[mine])
            b.append(matrix)
            n += len(mine)
            if n >= size:
                yield np.concatenate(a), np.concatenate(b)
                a, b, n = [], [], 0
            held[int(dim)] = (a, b, n)
    for a, b, n in held.values():
        if n:
            yield np.concatenate(a), np.concatenate(b)


def search_all(
    vectors: DataFrame, is_query: Column, k: int, score_type: str, descending: bool, searcher: Callable[[np.ndarray, np.ndarray], Search], block: int = BLOCK,
) -> DataFrame:
    """``query_id, rank, vec_id, score`` for every query among the rows (vec_id, vector) of ``vectors``.

    One query a vec_id (of repeated ids with several vectors the least vector asks); rows with the query's id are its own.
    Every other row is a candidate, so repeated rows of one vec_id can take several ranks.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    asked = vectors.filter(is_query).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    total, widest = asked.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    # half full on average, so that hashing does not overfill a wave
    waves = max(1, -(-total * 2 * 8 * (widest or 1) // WAVE_BYTES), -(-total * 2 // WAVE))
    if waves > 1:
        asked = materialize(asked, "asked")
    parts = []
    for wave in range(waves):
        mine = asked if waves == 1 else asked.filter(F.pmod(F.xxhash64("vec_id"), F.lit(waves)) == wave)
        found, shared = _one_wave(vectors, mine, score_type, searcher, block)
        if waves > 1:  # done before the next one's queries come to the driver
            found = materialize(_best(found, k, descending), "found")
            shared.destroy()
        parts.append(found)
    out = parts[0]
    for more in parts[1:]:
        out = out.union(more)
    return out if waves > 1 else _best(out, k, descending)


def _best(found: DataFrame, k: int, descending: bool) -> DataFrame:
    ranked = Window.partitionBy("query_id").orderBy(F.col("score").desc() if descending else F.col("score").asc(), "vec_id")
    rank = F.row_number().over(ranked).cast("int")
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _one_wave(vectors: DataFrame, asked: DataFrame, score_type: str, searcher, block: int) -> tuple[DataFrame, Broadcast]:
    rows = asked.orderBy("vec_id").collect()
    if sum(8 * len(r["vector"]) for r in rows) > WAVE_BYTES:
        raise ValueError("a wave of queries is too large to broadcast; lower WAVE")
    by_dim: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for dim in {len(r["vector"]) for r in rows}:
        same = [r for r in rows if len(r["vector"]) == dim]
        by_dim[dim] = (np.array([r["vec_id"] for r in same], np.int64), np.array([r["vector"] for r in same], np.float64))
    shared = vectors.sparkSession.sparkContext.broadcast(by_dim)
    dtype = pa.float64() if score_type == "double" else pa.int64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches = {dim: searcher(ids, m) for dim, (ids, m) in shared.value.items()}
        for ids, matrix in blocks(batches, block):
            dim = matrix.shape[1]
            if dim in searches:
                place, vec, score = searches[dim](ids, matrix)
                yield pa.record_batch([pa.array(shared.value[dim][0][place]), pa.array(vec), pa.array(score, dtype)], ["query_id", "vec_id", "score"])

    return vectors.select("vec_id", "vector").mapInArrow(run, f"query_id bigint, vec_id bigint, score {score_type}"), shared


def least_first(ids: np.ndarray, key: np.ndarray, k: int) -> np.ndarray:
    """Places of the k least keys in order, ties to the lesser id."""
    near = np.arange(len(ids))
    if len(ids) > 4 * k:
        near = np.flatnonzero(key <= np.partition(key, k - 1)[k - 1])
    return near[np.lexsort((ids[near], key[near]))][:k]
