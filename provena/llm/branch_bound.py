"""Exact top-k by inner product: columnar branch-and-bound.

A block of vectors lies vertically, dimension by dimension. A query takes the dimension blocks in order of its own mass;
partial inner products are accumulated block by block, and a candidate goes when even the rest of its mass could not reach
the k-th best score: partial + |rest of query| * |rest of vector| (Cauchy-Schwarz). Survivors are compacted. The k-th best score
is carried over to a partition's later blocks, so bounds tighten as it goes on.

Components are floor(1024 * x) with x as double; scores are exact integers. Sums stay below 2**53 in doubles, which is checked by
block and query; beyond that Python integers are used, and a score outside 64 bits is held at the nearest end of the range.

Cases. Vectors null, empty or with null or non-finite components take no part (zero vectors do); other dimensions
than the query's are no candidates. Fewer than k candidates: all. Ties go to the lesser vec_id, so bounds keep equal scores.
Repeated rows: see ``search_all``. Null vec_id: no part. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provena.llm.vectors import Search, least_first, search_all, usable

SCALE = 1024
WIDTH = 8
EXACT = float(2**53)


def quantize(m: np.ndarray) -> np.ndarray:
    return np.floor(SCALE * m)


def _wide(q: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Scores beyond 53 bits, by Python integers."""
    qi = [int(x) for x in q]
    ends = np.iinfo(np.int64)
    return np.array([min(max(sum(a * int(b) for a, b in zip(qi, row, strict=True)), ends.min), ends.max) for row in block], np.int64)


def bounding_searcher(ids: np.ndarray, queries: np.ndarray, k: int, width: int = WIDTH) -> Search:
    qs = quantize(queries)
    dim = qs.shape[1]
    groups = [np.arange(a, min(a + width, dim)) for a in range(0, dim, width)]
    with np.errstate(over="ignore", invalid="ignore"):
        mass = np.stack([np.square(qs[:, g]).sum(1) for g in groups], 1)
    taken = np.argsort(-mass, axis=1, kind="stable")
    least = [None] * len(ids)  # k-th best score so far, by query
    kept: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(ids)

    def search(block_ids: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        xs = quantize(block)
        widest = np.abs(xs).max(initial=0.0)
        columns = [np.ascontiguousarray(xs[:, g].T) for g in groups]
        with np.errstate(over="ignore", invalid="ignore"):
            masses = np.stack([np.square(c).sum(0) for c in columns])
        places, found, scores = [], [], []
        for q in range(len(ids)):
            top = np.abs(qs[q]).max(initial=0.0)
            if not (top * widest * dim < EXACT and masses.max(initial=0.0) * len(groups) < EXACT and mass[q].sum() < EXACT):
                other = np.flatnonzero(block_ids != ids[q])
                exact = _wide(qs[q], xs[other])
                keep = sorted(range(len(other)), key=lambda i: (-int(exact[i]), block_ids[other[i]]))[:k]
                vec, score = block_ids[other[keep]], exact[keep]
            else:
                alive = np.flatnonzero(block_ids != ids[q])
                partial = np.zeros(len(alive))
                steps = taken[q]
                rest_q = np.sqrt(np.maximum(mass[q].sum() - np.cumsum(mass[q][steps]), 0.0))
                rest_x = masses.sum(0)[alive]
                bound = least[q]
                for s, g in enumerate(steps):
                    partial += qs[q, groups[g]] @ columns[g][:, alive]
                    rest_x = rest_x - masses[g][alive]
                    if s + 1 == len(steps):
                        break
                    reach = rest_q[s] * np.sqrt(np.maximum(rest_x, 0.0)) * (1 + 1e-9) + 1e-6
                    if bound is None or s % 2 == 1:
                        # a k-th best lower bound: what k candidates have at least
                        if len(alive) > k:
                            sure = np.partition(partial - reach, len(alive) - k)[len(alive) - k]
                            bound = sure if bound is None else max(bound, sure)
                    if bound is not None:
                        stay = partial + reach >= bound
                        if stay.sum() < 0.9 * len(alive):
                            alive, partial, rest_x = alive[stay], partial[stay], rest_x[stay]
                keep = least_first(block_ids[alive], -partial, k)
                vec, score = block_ids[alive[keep]], partial[keep].astype(np.int64)
                a, b = kept[q]
                a, b = np.concatenate([a, vec]), np.concatenate([b, score])
                keep = least_first(a, -b, k)
                kept[q] = (a[keep], b[keep])
                if len(keep) >= k:
                    least[q] = float(kept[q][1][-1])
            places.append(np.full(len(vec), q))
            found.append(vec)
            scores.append(score)
        return np.concatenate(places), np.concatenate(found), np.concatenate(scores)

    return search


def top_products(vectors: DataFrame, every: int = 100, k: int = 10) -> DataFrame:
    """``query_id, rank, vec_id, score``: queries are the rows whose vec_id is divisible by ``every``."""
    v = F.col("embedding").cast("array<double>")
    rows = vectors.filter(F.col("vec_id").isNotNull() & usable(F.col("embedding"), allow_zero=True)).select(F.col("vec_id").cast("bigint").alias("vec_id"), v.alias("vector"))
    return search_all(rows, F.col("vec_id") % every == 0, k, "bigint", True, lambda ids, m: bounding_searcher(ids, m, k))
