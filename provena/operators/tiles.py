"""Exact all-against-all work on vectors, in tiles.

Rows fall into blocks by a hash; a tile is a pair of blocks that meet in one task, where numpy multiplies them strip by strip and only
qualifying results leave. No pair table and no n x n matrix exist anywhere. A block's size comes from a budget of bytes, so a tile needs
two blocks and one strip of memory, and each row travels once a block it meets. Tiles are keyed by both block numbers, so they
spread over all tasks alike, whichever blocks they join.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provena.runtime import ship_package

#: bytes of a block at most; rows below which a block is not cut for the sake of more tasks; rows of a strip
BLOCK_BYTES, LEAST_ROWS, STRIP = 16 << 20, 512, 2048

#: of (left rows, left matrix, right rows, right matrix, whether both are the same rows) a result frame
TileFunction = Callable[[pd.DataFrame, np.ndarray, pd.DataFrame, np.ndarray, bool], pd.DataFrame]


def block_count(rows: int, row_bytes: int, tasks: int) -> int:
    """Blocks of ``rows`` rows: as many as the budget asks for, and enough that tiles keep ``tasks`` tasks busy."""
    by_size = -(-rows * max(1, row_bytes) // BLOCK_BYTES)
    by_tasks = min(math.ceil(math.sqrt(4 * tasks)), rows // LEAST_ROWS)
    return max(1, by_size, by_tasks)


def _numbered(rows: DataFrame, blocks: int) -> Column:
    """Block of a row, by a hash of all its columns but the vector (ids do not repeat)."""
    return F.pmod(F.xxhash64(*[F.col(c) for c in rows.columns if c != "vector"]), F.lit(blocks)).cast("int")


def _matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    lists = vectors.combine_chunks()
    if not pa.types.is_list(lists.type):
        return lists.to_numpy(zero_copy_only=False)[:, None]
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(lists), -1) if len(lists) else np.zeros((0, 0))


def _strips(n: int) -> list[slice]:
    return [slice(a, min(a + STRIP, n)) for a in range(0, n, STRIP)]


def run_tiles(left: DataFrame, right: DataFrame | None, blocks: tuple[int, int], function: TileFunction, schema: str, prepare: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Apply ``function`` to every tile of rows (``vector`` and any other columns).

    ``right`` None: all pairs of ``left``'s rows, each unordered pair of strips once. ``blocks`` are the numbers of blocks of both sides;
    ``prepare`` makes a block's matrix ready (its rows may be scaled). ``vector`` may be a list of numbers or one number.
    """
    spark = left.sparkSession
    ship_package(spark)
    own = right is None
    n_left, n_right = blocks
    # rows of one side are listed with the blocks they meet
    with_left = left.withColumn("block", _numbered(left, n_left))
    if own:
        meets = with_left.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(n_left - 1))))
        spread = meets.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
        spread = spread.withColumn("second", F.col("block") > F.col("other")).drop("block", "other")
    else:
        a = with_left.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(n_right - 1)))).withColumnRenamed("block", "i").withColumn("second", F.lit(False))
        b = right.withColumn("j", _numbered(right, n_right)).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n_left - 1)))).withColumn("second", F.lit(True))
        spread = a.unionByName(b)
    kinds = [f.name for f in left.schema.fields if f.name != "vector"]

    def side(table: pa.Table, second: bool) -> tuple[pd.DataFrame, np.ndarray]:
        mask = table.column("second").to_numpy() == second
        mine = table.filter(pa.array(mask))
        return mine.select(kinds).to_pandas(), prepare(_matrix(mine.column("vector")))

    def results(table: pa.Table, same_block: bool) -> Iterator[pd.DataFrame]:
        fa, ma = side(table, False)
        fb, mb = (fa, ma) if same_block else side(table, True)
        for x, rows in enumerate(_strips(len(fa))):
            for y, others in enumerate(_strips(len(fb))):
                if not same_block or x <= y:
                    out = function(fa.iloc[rows], ma[rows], fb.iloc[others], mb[others], same_block and x == y)
                    if len(out):
                        yield out

    names, target = _arrow_schema(schema)

    def work(key: tuple, table: pa.Table) -> pa.Table:
        parts = list(results(table, own and key[0].as_py() == key[1].as_py()))
        if not parts:
            return target.empty_table()
        return pa.Table.from_pandas(pd.concat(parts)[names], target, preserve_index=False)

    return spread.groupBy("i", "j").applyInArrow(work, schema)


def _arrow_schema(schema: str) -> tuple[list[str], pa.Schema]:
    kinds = {"string": pa.string(), "double": pa.float64(), "bigint": pa.int64(), "int": pa.int32()}
    fields = [part.split() for part in schema.split(", ")]
    return [f[0] for f in fields], pa.schema([(n, kinds[k]) for n, k in fields])
