"""Approximate nearest neighbours by query-aware collision counting.

Each of ``PROJECTIONS`` random directions gives one sorted array of a block's projections. A query's windows are centred
on its own projections and widen together (virtual rehashing); only what a window newly covers is counted. A vector seen in
at least ``SHARE`` of the windows is verified: its Euclidean distance is taken on the original vectors. A query stops once
its windows are as wide as the k-th verified distance asks for: a vector at that distance would then have reached the
collision threshold with the probability of ``Z`` standard deviations (0.84), a nearer one with more. No window grows
beyond that width, so vectors farther off than the k-th are verified only as far as counts can't tell them apart.

Directions are orthonormal bases one after another, stretched to the square root of the dimension, which count more evenly than
independent ones; below ``FLAT`` dimensions, where the normal law does not hold for them, they are independent normal.

All rows are indexed; nothing is fitted on data. Cases: vectors null, empty, zero or with null or non-finite components take
no part, as query or candidate; other dimensions than the query's are no candidates. Fewer than k candidates: all. Ties
go to the lesser vec_id. Repeated rows: see ``search_all``. Null vec_id: no part. Extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provena.llm.vectors import Search, least_first, search_all, usable

PROJECTIONS = 128
SHARE = 0.8
Z = 1.0
FLAT = 32
GROWTH = 1.15
SEED = 20


def directions(dim: int, m: int) -> np.ndarray:
    """``m`` directions as columns, of about unit variance a component of a unit vector times the dimension."""
    rng = np.random.default_rng(SEED)
    if dim < FLAT:
        return rng.standard_normal((dim, m))
    bases = [np.linalg.qr(rng.standard_normal((dim, min(dim, m - a))))[0] for a in range(0, m, dim)]
    return np.concatenate(bases, 1) * math.sqrt(dim)


def _window_ratio(m: int, share: float) -> float:
    """Half width by distance at which a vector collides often enough with the probability of ``Z``."""
    p = min(0.999, share + Z * math.sqrt(share * (1 - share) / m))
    low, high = 0.0, 10.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if math.erf(mid / math.sqrt(2)) < p else (low, mid)
    return high


class CollisionIndex:
    """The sorted arrays of one block, and how many vectors its queries verified."""

    def __init__(self, ids: np.ndarray, block: np.ndarray, axes: np.ndarray, share: float = SHARE):
        self.ids, self.block, self.axes = ids, block, axes
        self.n, self.m = len(block), axes.shape[1]
        self.need = math.ceil(share * self.m)
        self.ratio = _window_ratio(self.m, share)
        projected = block @ axes
        self.order = np.ascontiguousarray(np.argsort(projected, axis=0, kind="stable").T)
        self.sorted_at = np.ascontiguousarray(np.take_along_axis(projected, self.order.T, 0).T)
        # all sorted arrays end to end, shifted apart: one search finds a place in every array
        self.floor, self.ceiling = self.sorted_at[:, 0] - 1, self.sorted_at[:, -1] + 1
        self.shift = np.cumsum(np.r_[0.0, (self.ceiling - self.floor)[:-1]]) - self.floor
        self.flat = (self.sorted_at + self.shift[:, None]).reshape(-1)
        self.base = np.arange(self.m) * self.n
        self.start = 0.0  # half the last query's final width
        self.verified = 0

    def _place(self, value: np.ndarray, side: str) -> np.ndarray:
        found = self.flat.searchsorted(np.clip(value, self.floor, self.ceiling) + self.shift, side)
        return np.clip(found - self.base, 0, self.n)

    def _first_width(self, centre: np.ndarray, lo: np.ndarray) -> float:
        """No vector can collide often enough before the windows reach something in as many arrays."""
        each = np.arange(self.m)
        above = np.where(lo < self.n, self.sorted_at[each, np.minimum(lo, self.n - 1)] - centre, np.inf)
        below = np.where(lo > 0, centre - self.sorted_at[each, np.maximum(lo - 1, 0)], np.inf)
        least = float(np.partition(np.minimum(above, below), self.need - 1)[self.need - 1])
        return max(least, self.start, 1e-12)

    def search(self, own: int, query: np.ndarray, k: int, known: float = math.inf) -> tuple[np.ndarray, np.ndarray]:
        """Places and distances of the k nearest found, own id aside; ``known``: a k-th distance found elsewhere."""
        centre = query @ self.axes
        lo = hi = self._place(centre, "left")
        half = self._first_width(centre, lo)
        count = np.zeros(self.n, np.int64)
        waiting = np.ones(self.n, bool)
        near, distance = np.zeros(0, np.int64), np.zeros(0)
        while True:
            a, b = np.minimum(self._place(centre - half, "left"), lo), np.maximum(self._place(centre + half, "right"), hi)
            fresh = [self.order[j, a[j] : lo[j]] for j in np.flatnonzero(a < lo)]
            fresh += [self.order[j, hi[j] : b[j]] for j in np.flatnonzero(b > hi)]
            lo, hi = a, b
            if fresh:
                count += np.bincount(np.concatenate(fresh), minlength=self.n)
                new = np.flatnonzero((count >= self.need) & waiting)
                if len(new):
                    waiting[new] = False
                    self.verified += len(new)
                    new = new[self.ids[new] != own]
                    d = np.sqrt(np.square(self.block[new] - query).sum(1))
                    near, distance = np.concatenate([near, new]), np.concatenate([distance, d])
                    keep = least_first(self.ids[near], distance, k)
                    near, distance = near[keep], distance[keep]
            kth = min(known, distance[-1] if len(near) >= k else math.inf)
            if half >= kth * self.ratio or (lo == 0).all() and (hi == self.n).all():
                break
            half = min(half * GROWTH, kth * self.ratio)
        self.start = half / 2
        return near, distance


def collision_searcher(ids: np.ndarray, queries: np.ndarray, k: int, m: int = PROJECTIONS, share: float = SHARE) -> Search:
    axes = directions(queries.shape[1], m)
    known = np.full(len(ids), math.inf)
    best = [np.zeros(0)] * len(ids)  # k least distances of the earlier blocks of a partition, by query

    def search(block_ids: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        index = CollisionIndex(block_ids, block, axes, share)
        places, found, scores = [], [], []
        for q in range(len(ids)):
            near, distance = index.search(int(ids[q]), queries[q], k, known[q])
            best[q] = np.sort(np.concatenate([best[q], distance]))[:k]
            if len(best[q]) >= k:
                known[q] = best[q][-1]
            places.append(np.full(len(near), q))
            found.append(block_ids[near])
            scores.append(distance)
        return np.concatenate(places), np.concatenate(found), np.concatenate(scores)

    return search


def nearest(vectors: DataFrame, every: int = 100, k: int = 10) -> DataFrame:
    """``query_id, rank, vec_id, score``: queries are the rows whose vec_id is divisible by ``every``."""
    v = F.col("embedding").cast("array<double>")
    taking_part = vectors.filter(F.col("vec_id").isNotNull() & usable(F.col("embedding"), allow_zero=False))
    rows = taking_part.select(F.col("vec_id").cast("bigint").alias("vec_id"), v.alias("vector"))
    return search_all(rows, F.col("vec_id") % every == 0, k, "double", False, lambda ids, m: collision_searcher(ids, m, k))
