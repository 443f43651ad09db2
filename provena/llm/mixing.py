"""Mixing sources to target weights by entropy balancing.

Documents i of source s get rates r_i between 0 and ``cap`` that stay as close as possible, in relative entropy over documents, to the
base rate 1, under one token constraint a source: sum(size_i * r_i) = target_s. The optimum is an exponential tilt of each
document, r_i = min(cap, exp(lambda_s * size_i / mean_s)), so among the documents of a source that must grow the longer ones are
taken more often, and where it must shrink they are the first to go. The convex dual, in the multipliers lambda, is solved by Newton
iterations: each is one distributed sum of words and of their derivative over all documents (equal sizes of a source are
summed once, with their number), inside a bracket that every iteration narrows; a dual that has not converged is an error.

Rates become whole copies: floor(r_i), and one more for a share r_i - floor(r_i) of the documents. Documents line up by their hashed
place divided by that share, and are taken in this order until the source's words meet its target to within half a document.
The cut is found in a histogram of words over the order; only one bin a source is sorted.

Cases. Null text has size 0; documents of size 0 take 0 words. A null source is a source of its own, last in
the order. A source without words has target 0. Repeated rows with one doc_id and text hash alike and are taken
alike, so reruns agree; a source may miss its target by the words of such rows at its cut. An empty table gives an empty result.
Extra columns are ignored. Only scalars come to the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provena.llm.text import free_names, quoted
from provena.runtime import discard, materialize

WORD = r"[^\x20\x09-\x0D]+"
#: histogram bins of the hash space a source; a source of more than BINS * BIN_ROWS rows gets more
BINS, BIN_ROWS = 1024, 4096
#: a table of so many sources at most (about 100 bytes each) is broadcast
BROADCAST_SOURCES = 100_000
#: Newton iterations at most, and how many run in one job; the largest miss of a target, in parts of it
ROUNDS, FUSED, TOLERANCE = 120, 3, 1e-9
#: sums are kept as whole numbers of this part of a word, so that they do not depend on the order of adding
_PART = float(1 << 40)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, pattern: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """``source, source_size, n_docs, target`` from ``source, source_size, n_docs`` (one row a source).

    Weights repeat ``pattern`` over the sources in code point order, null last. A target stops at ``cap`` times
    the source's size; what is over is shared by weight among the others until none is above.
    """
    spark = sources.sparkSession
    # ranks without one sorted task: sources are ranged by value, each range is ranked, and ranges are offset
    ranged = sources.repartitionByRange(8, F.col("source").asc_nulls_last()).withColumn("_range", F.spark_partition_id())
    ranged = materialize(ranged, "mix-ranges")
    starts = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offset = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).select("_range", F.coalesce(F.sum("_n").over(starts), F.lit(0)).alias("_offset"))
    within = Window.partitionBy("_range").orderBy(F.col("source").asc_nulls_last())
    place = F.col("_offset") + F.row_number().over(within) - F.lit(1)
    weights = F.array(*[F.lit(float(w)) for w in pattern])
    ranked = ranged.join(F.broadcast(offset), "_range").select(
        "source", "source_size", "n_docs", F.element_at(weights, (F.pmod(place, F.lit(len(pattern))) + 1).cast("int")).alias("weight"),
    )
    table = materialize(ranked, "mix-weights")
    discard(ranged)
    room = F.lit(float(cap)) * F.col("source_size")
    total = float(table.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0])
    left, level = share * total, 0.0
    # water level: target = min(cap * size, weight * level); each round fixes the sources that are full
    full = F.lit(False)
    while total > 0:
        row = table.agg(F.sum(F.when(full, room).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))), F.sum(full.cast("long"))).first()
        if not row[1]:
            break
        before, level = level, max(0.0, (left - row[0])) / row[1]
        if level <= before:
            level = before
            break
        full = room <= F.col("weight") * F.lit(level)
    target = F.least(room, F.col("weight") * F.lit(level)) if total > 0 else F.lit(0.0)
    if total > 0 and share >= cap:
        target = room
    return table.select("source", "source_size", "n_docs", "weight", target.cast("double").alias("target"))


def _tilted(size: Column, mean: Column, tilt: Column, cap: float) -> Column:
    """The rate of a document: exp(tilt * size / mean), at most ``cap``."""
    power = tilt * size / mean
    return F.when(power < F.lit(math.log(cap)), F.exp(power)).otherwise(F.lit(float(cap)))


def _whole_sum(value: Column) -> Column:
    return F.sum((value * F.lit(_PART)).cast("decimal(38,0)")).cast("double") / F.lit(_PART)


def _newton_step(sizes: DataFrame, state: DataFrame, cap: float, few: bool) -> DataFrame:
    """One iteration over ``sizes`` (source, size, n) for all sources of ``state``."""
    kept = [c for c in state.columns if c != "source"]
    rows = attach(sizes, state, few=few)
    rate = _tilted(F.col("size"), F.col("mean"), F.col("tilt"), cap)
    free = F.col("tilt") * F.col("size") / F.col("mean") < F.lit(math.log(cap))
    words = F.col("n") * F.col("size") * rate
    slope = F.when(free, words * F.col("size") / F.col("mean")).otherwise(F.lit(0.0))
    sums = rows.groupBy("source").agg(_whole_sum(words).alias("now"), _whole_sum(slope).alias("slope"), *[F.first(c).alias(c) for c in kept])
    now, target, tilt = F.col("now"), F.col("target"), F.col("tilt")
    low = F.when(now < target, tilt).otherwise(F.col("low"))
    high = F.when(now < target, F.col("high")).otherwise(tilt)
    far = F.lit(float("inf"))
    # between the ends of the bracket where Newton's step leaves it; beyond its only end where there is one
    inside = F.when(low == -far, high - 1 - F.abs(high)).when(high == far, low + 1 + F.abs(low)).otherwise((low + high) / 2)
    newton = tilt + (target - now) / F.col("slope")
    step = F.when((F.col("slope") > 0) & (newton > low) & (newton < high), newton).otherwise(inside)
    miss = F.abs(now - target) / target
    moved = {"tilt": F.when(miss <= TOLERANCE, tilt).otherwise(step), "low": low, "high": high, "miss": miss}
    return sums.select("source", *[moved.get(c, F.col(c)).alias(c) for c in kept])


def solve_dual(sizes: DataFrame, sources: DataFrame, cap: float = 2.0, rounds: int = ROUNDS) -> DataFrame:
    """``source, tilt, mean`` of the sources whose target lies between 0 and ``cap`` times their size.

    ``sizes`` has ``source, size, n`` (n documents of one size above 0), ``sources`` has ``source, source_size, n_docs, target``.
    """
    few = sources.count() <= BROADCAST_SOURCES
    open_ = sources.filter((F.col("target") > 0) & (F.col("target") < F.lit(cap * (1 - 1e-12)) * F.col("source_size")))
    mean = F.col("source_size") / F.col("n_docs")
    end = F.lit(float("inf"))
    state = open_.select(
        "source", "target", mean.alias("mean"), F.log(F.col("target") / F.col("source_size")).alias("tilt"), (-end).alias("low"), end.alias("high"),
        end.alias("miss"),
    )
    for _ in range(0, rounds, FUSED):
        for _ in range(FUSED):
            state = _newton_step(sizes, state, cap, few)
        done = materialize(state, "mix-newton")
        worst = done.agg(F.max("miss")).first()[0]
        if worst is None or worst <= TOLERANCE:
            return done.select("source", "tilt", "mean")
        state = done
    raise RuntimeError(f"the mix's dual has not converged in {rounds} iterations: a target is missed by {worst:.3g} of it")


def _unit_place(seed: int) -> Column:
    """The hash place of a document, in (0, 1)."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    return (F.pmod(F.xxhash64(F.lit(seed), key, crc), F.lit(1 << 40)) + F.lit(0.5)) / F.lit(float(1 << 40))


class _Copies:
    """Copies of a document, from its size, its hash place and its source's plan (struct columns of one name each)."""

    def __init__(self, size: Column, unit: Column, plan: Callable[[str], Column], cap: float):
        full = F.lit(float(cap)) * plan("source_size") * F.lit(1 - 1e-12)
        tilted = _tilted(size, plan("mean"), plan("tilt"), cap)
        rate = F.when(size <= 0, 1.0).when(plan("target") <= 0, 0.0).when(plan("target") >= full, float(cap)).otherwise(tilted)
        self.rate = F.coalesce(rate, F.lit(0.0))
        self.whole = F.floor(self.rate + F.lit(1e-9)).cast("long")
        share = self.rate - self.whole
        #: place in the order of extra copies, in [0, 1); null for documents without a share
        self.place = F.when((share > 1e-9) & (size > 0), unit / (unit + share))
        self.bin = F.floor(self.place * plan("n_bins")).cast("long")
        self.plan, self.cap = plan, cap

    def number(self) -> Column:
        at = self.plan("at")
        extra = (self.bin < at) | ((self.bin == at) & (self.place <= F.coalesce(self.plan("tau"), F.lit(-1.0))))
        return F.least(F.lit(int(self.cap)).cast("long"), self.whole + F.coalesce(extra, F.lit(False)).cast("long"))


def plan_mix(docs: DataFrame, pattern: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, cap: float = 2.0, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """Narrow rows ``doc_id, source, size, unit`` and, by source, all that decides a document's copies.

    A document gets ``whole`` copies by its rate, and one more if its bin is below ``at``, or is ``at`` and its place is at
    most ``tau``.
    """
    if not (0 < share <= cap) or cap != int(cap) or any(not (0 < w < math.inf) for w in pattern):
        raise ValueError("share must lie in (0, cap], cap be whole and weights be positive")
    narrow = materialize(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), _unit_place(seed).alias("unit")), "mix-sizes")
    sizes = materialize(narrow.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "mix-histogram")
    sums = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).cast("long").alias("source_size"), F.sum("n").alias("n_docs"))
    sources = materialize(source_targets(sums, pattern, share, cap), "mix-sources")
    few = sources.count() <= BROADCAST_SOURCES
    tilts = solve_dual(sizes.filter("size > 0"), sources, cap)
    n_bins = F.greatest(F.lit(BINS), F.ceil(F.col("n_docs") / F.lit(BIN_ROWS))).cast("long")
    rates = materialize(attach(sources, tilts, "left", few).select("source", "source_size", "target", "tilt", "mean", n_bins.alias("n_bins")), "mix-rates")
    # words by bin of the order: the cut falls into the bin where the wanted words run out, at its upper edge at the latest
    of = _Copies(F.col("size"), F.col("unit"), F.col, cap)
    placed = attach(narrow, rates, few=few).select("source", "size", "target", of.whole.alias("whole"), of.place.alias("place"), of.bin.alias("bin"))
    by_bin = placed.groupBy("source", "bin").agg(F.sum("size").alias("words"), F.sum(F.col("size") * F.col("whole")).alias("sure"), F.first("target").alias("target"))
    by_bin = materialize(by_bin, "mix-bins")
    wanted = materialize(
        by_bin.groupBy("source").agg((F.first("target") - F.sum("sure")).alias("wanted"), F.sum(F.when(F.col("bin").isNotNull(), F.col("words"))).alias("there")),
        "mix-wanted",
    )
    before = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    rest = F.col("wanted") - F.coalesce(F.sum("words").over(before), F.lit(0))
    cuts = attach(by_bin.filter("bin is not null").drop("target"), wanted, few=few).withColumn("rest", rest)
    cuts = materialize(cuts.filter((F.col("rest") > 0) & (F.col("rest") <= F.col("words"))).select("source", F.col("bin").alias("at"), "rest"), "mix-cuts")
    # only the rows of the bins with a cut are ordered; copies of one row, which share a place, are one there
    edge = attach(placed.select("source", "size", "place", "bin"), cuts, few=few).filter(F.col("bin") == F.col("at"))
    edge = edge.groupBy("source", "place", "rest").agg(F.sum("size").alias("size"))
    run = Window.partitionBy("source").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    taken = edge.withColumn("sum", F.sum("size").over(run)).filter(F.col("sum") - F.col("size") / 2 <= F.col("rest"))
    taus = materialize(taken.groupBy("source").agg(F.max("place").alias("tau")), "mix-taus")
    marked = attach(attach(attach(rates, wanted, "left", few), cuts, "left", few), taus, "left", few)
    # nothing wanted, or more than there is, leaves no cut: none or all
    full = F.col("wanted") >= F.col("there") - F.lit(0.5)
    at = F.coalesce("at", F.when(full, F.col("n_bins")).otherwise(F.lit(0)))
    plan = marked.withColumn("at", at).select("source", "source_size", "target", "tilt", "mean", "n_bins", "at", "tau")
    return narrow, materialize(plan, "mix-plan")


def attach(rows: DataFrame, by_source: DataFrame, how: str = "inner", few: bool | None = None) -> DataFrame:
    """Join on the source, null equal to null; a table of few sources (counted) is broadcast, so rows stay where they are."""
    other = by_source.withColumnRenamed("source", "_source")
    if by_source.count() <= BROADCAST_SOURCES if few is None else few:
        other = F.broadcast(other)
    return rows.join(other, F.col("source").eqNullSafe(F.col("_source")), how).drop("_source")


def entropy_mix(docs: DataFrame, pattern: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, cap: float = 2.0, seed: int = 17) -> DataFrame:
    """``doc_id, source, size, source_size, target, rate, copies, taken`` for every row of ``docs``."""
    narrow, plan = plan_mix(docs, pattern, share, cap, seed)
    of = _Copies(F.col("size"), F.col("unit"), F.col, cap)
    rows = attach(narrow, plan).withColumn("rate", of.rate).withColumn("copies", of.number())
    return rows.select("doc_id", "source", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def mix_copies(docs: DataFrame, pattern: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, cap: float = 2.0, seed: int = 17) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken, with the columns of ``docs``."""
    _, plan = plan_mix(docs, pattern, share, cap, seed)
    unit, size, held, nth = free_names(docs.columns, "unit", "size", "plan", "nth")
    rows = docs.withColumn(unit, _unit_place(seed)).withColumn(size, word_count(F.col("text")))
    by_source = plan.select("source", F.struct(*[c for c in plan.columns if c != "source"]).alias(held))
    other, named = by_source.withColumnRenamed("source", nth), F.col("source").eqNullSafe(F.col(nth))
    if plan.count() <= BROADCAST_SOURCES:
        other = F.broadcast(other)
    of = _Copies(F.col(size), F.col(unit), lambda name: F.col(held).getField(name), cap)
    rows = rows.join(other, named).withColumn(nth, F.explode(F.array_repeat(F.lit(0), of.number().cast("int"))))
    return rows.select(*quoted(docs.columns))
