"""Toxicity by maximum-scoring segments over token log-odds.

1. Token scores: log-odds of a word in toxic against clean labelled texts under an informative Dirichlet prior
   (the pooled frequencies), kept where effect and z-score are large. Near copies in the sample count once. Words without a score of their own back off to the
   longest prefix with one; a prefix is judged on words that nothing longer explains. All other tokens cost ``DRIFT``.
2. One linear scan a text finds all maximal scoring segments (every one disjoint and not extendable).
3. Extreme-value calibration: under clean text a segment's score S in n tokens has E-value K n exp(-lambda S), lambda
   solving sum p(s) exp(lambda s) = 1 over clean token scores and K fitted on clean texts. Segments with positive
   normalised score are the significant passages; the sum statistic of the r best, at its best r, is the
   text's evidence, and a two-parameter logistic curve on it gives the score.

The model is fitted on a bounded sample, at most about ``fit_docs`` labelled texts a class by a hash of doc_id; its table of
scored tokens is bounded by that sample and checked against ``max_terms``. Of the sample only near copies are left out: texts whose
runs of five words are alike to about ``ALIKE`` (by ``MARKS`` independent least hashes) in a text of their class that stays.

Cases. Null, empty or wordless text: evidence 0, the curve's base score. No toxic label learned: score 0 everywhere; none clean: score 1.
Labels null or missing: the text is not learned from, but is scored. Several labels of one doc_id: toxic if any says
so. Repeated rows are scored alike, very long texts whole. Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provena.llm.text import chunks, column_ddl, fold, free_names, only_caches_of, quoted, unit_hash, with_text
from provena.runtime import discard, materialize, ship_package

WORDS = re.compile(r"\w+")
PREFIXES = (6, 5, 4)
DRIFT = -0.3
KNOWN_WORDS = 100_000  # words a worker remembers
PRIOR_SHARE = 0.1  # weight of the prior, as a share of all counted tokens


#: least hashes a text in ``sketch``; texts that agree on a share of ``ALIKE`` count as near copies; rounds of grouping
MARKS, ALIKE, ROUNDS = 128, 0.8, 3
_FACTORS = np.random.default_rng(4).integers(0, 1 << 63, MARKS, np.uint64) * np.uint64(2) + np.uint64(1)


def sketch(text: str | None) -> list[int]:
    """``MARKS`` independent least hashes of the text's runs of five words.

    Two texts agree on each with the probability of their runs' Jaccard similarity; so the share they agree on
    estimates it, within 0.04 or so.
    """
    words = WORDS.findall(text.lower()) if text else []
    runs = np.array(sorted({zlib.crc32(" ".join(words[i : i + 5]).encode()) for i in range(max(1, len(words) - 4))}), np.uint64)
    least = np.full(MARKS, np.iinfo(np.uint64).max)
    runs = (runs + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    runs ^= runs >> np.uint64(29)
    for a in range(0, len(runs), 4096):
        mixed = runs[a : a + 4096, None] * _FACTORS
        mixed ^= mixed >> np.uint64(32)
        least = np.minimum(least, (mixed * np.uint64(0xBF58476D1CE4E5B9)).min(0))
    return (least >> np.uint64(33)).astype(np.int32).tolist()


def one_of_near_copies(toxic: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Which rows of a bounded sample stay: near copies once. Rows are in a fixed order.

    Rows of a class are grouped by one of their marks. A group's first row stays and stands for those that are like it in
    all marks; the rest of the group are grouped by the next mark. What is left after ``ROUNDS`` stays whole, so no
    row goes but for one that is kept and like it.
    """
    stays = np.zeros(len(marks), bool)
    rest = np.arange(len(marks))
    for k in range(ROUNDS):
        if not len(rest):
            break
        key = np.stack([toxic[rest].astype(np.int64), marks[rest, k]], 1)
        _, first, group = np.unique(key, axis=0, return_index=True, return_inverse=True)
        stays[rest[first]] = True
        like = (marks[rest] == marks[rest[first[group.reshape(-1)]]]).sum(1)
        rest = rest[like < ALIKE * MARKS]
    stays[rest] = True
    return stays


@dataclass
class Segment:
    start: int  # token positions, end exclusive
    end: int
    score: float


def maximal_segments(hits: list[tuple[int, float]], drift: float = DRIFT) -> list[Segment]:
    """All maximal scoring segments of a sequence that scores ``drift`` but for ``hits`` (position, score > 0).

    Candidates are kept on a stack with a link to the nearest one that starts lower, so each is visited a constant
    number of times.
    """
    left: list[float] = []
    right: list[float] = []
    start: list[int] = []
    end: list[int] = []
    link: list[int] = []
    total, at = 0.0, 0
    for position, score in hits:
        total += drift * (position - at)
        low, total, at = total, total + score, position + 1
        first = position
        while True:
            j = len(left) - 1
            while j >= 0 and left[j] >= low:
                j = link[j]
            if j < 0 or right[j] >= total:
                left.append(low)
                right.append(total)
                start.append(first)
                end.append(at)
                link.append(j)
                break
            # the stretch from candidate j on scores more than j alone: they become one
            low, first = left[j], start[j]
            del left[j:], right[j:], start[j:], end[j:], link[j:]
    return [Segment(a, b, r - lo) for a, b, lo, r in zip(start, end, left, right, strict=True)]


@dataclass
class ToxicityModel:
    scores: dict[str, float]  # "w" + word or prefix length + prefix
    rate: float = 1.0  # lambda
    log_k: float = 0.0
    base: float = -math.inf  # logistic curve: base + slope * evidence
    slope: float = 0.0

    def hits(self, text: str | None) -> tuple[int, list[tuple[int, float]]]:
        words = WORDS.findall(text.lower()) if text else []
        known = self._known
        return len(words), [(i, s) for i, w in enumerate(words) if (s := known(w)) is not None]

    def _known(self, word: str) -> float | None:
        memo = self.__dict__.setdefault("_memo", {})
        try:
            return memo[word]
        except KeyError:
            pass
        s = self.scores.get("w" + word)
        for k in PREFIXES:
            if s is None and len(word) > k:
                s = self.scores.get(f"{k}{word[:k]}")
        if len(memo) >= KNOWN_WORDS:
            memo.clear()
        memo[word] = s
        return s

    def forget(self) -> None:
        self.__dict__.pop("_memo", None)

    def passages(self, n: int, hits: list[tuple[int, float]]) -> list[tuple[Segment, float]]:
        """Significant segments with their normalised scores, best first."""
        if not hits:
            return []
        floor = self.log_k + math.log(max(n, 1))
        found = [(seg, self.rate * seg.score - floor) for seg in maximal_segments(hits)]
        return sorted((x for x in found if x[1] > 0), key=lambda x: (-x[1], x[0].start))

    @staticmethod
    def evidence(normalised: list[float]) -> float:
        """-log of the sum statistic's p-value at the best number of segments (largest scores first)."""
        best = total = 0.0
        for r, x in enumerate(normalised, 1):
            total += x
            best = max(best, total - (r - 1) * math.log(total) + math.lgamma(r + 1) + math.lgamma(r))
        return best

    def score(self, evidence: float) -> float:
        z = self.base + self.slope * evidence
        return 1.0 if z > 700 else 0.0 if z < -700 else 1.0 / (1.0 + math.exp(-z))


def _label_rows(docs: DataFrame, labels: DataFrame, is_train: Column, fit_docs: int) -> tuple[DataFrame, float, float]:
    """Sampled ``text, toxic``, written, with the full class sizes."""
    spark = docs.sparkSession
    marked = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    marked = marked.filter(is_train)
    sizes = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = sum(n for k, n in sizes.items() if k > 0), sizes.get(0, 0)
    share = F.when(F.col("toxic") > 0, min(1.0, fit_docs / max(n1, 1))).otherwise(min(1.0, fit_docs / max(n0, 1)))
    chosen = marked.filter(unit_hash(F.col("doc_id"), seed=4) < share).select("doc_id", (F.col("toxic") > 0).cast("int").alias("toxic"))
    # the sample is bounded, so it goes to the documents, which are not shuffled
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic", "doc_id")
    schema = f"text string, toxic int, doc_id {docs.schema['doc_id'].dataType.simpleString()}, marks array<int>"

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = [sketch(t) for _, texts in chunks(batch, "text") for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(marks, pa.list_(pa.int32()))], names=[*batch.schema.names, "marks"])

    # copies of one text would count as many witnesses of its words. The sample is bounded, and so are its marks (half a kilobyte a
    # text), which come to the driver; texts don't
    sketches = sample.mapInArrow(sketched, schema).select(F.monotonically_increasing_id().alias("row"), "*")
    sketches = materialize(sketches, "toxic-sketches")
    seen = sketches.select("row", "toxic", "doc_id", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("crc"), "marks").toArrow()
    seen = seen.sort_by([("doc_id", "ascending"), ("crc", "ascending")])
    marks = seen.column("marks").combine_chunks().flatten().to_numpy().reshape(len(seen), MARKS) if len(seen) else np.zeros((0, MARKS), np.int32)
    rows = seen.column("row").to_numpy()[one_of_near_copies(seen.column("toxic").to_numpy(), marks)]
    kept = spark.createDataFrame([(int(x),) for x in rows], "row bigint")
    apart = materialize(sketches.select("row", "text", "toxic").join(F.broadcast(kept), "row").select("text", "toxic"), "toxic-sample")
    discard(sketches)
    return apart, float(n1), float(n0)


def fit(docs: DataFrame, labels: DataFrame, is_train: Column, fit_docs: int = 4000, min_effect: float = 2.0, max_terms: int = 200_000) -> ToxicityModel:
    spark = docs.sparkSession
    ship_package(spark)
    rows, n1, n0 = _label_rows(docs, labels, is_train, fit_docs)
    if not n1:
        return ToxicityModel({})
    if not n0:
        return ToxicityModel({}, base=math.inf)

    def vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: tuple[dict[str, int], dict[str, int]] = {}, {}
        for batch in batches:
            toxic = batch.column(1).to_pylist()
            for start, texts in chunks(batch, "text"):
                for k, text in enumerate(texts):
                    mine = found[toxic[start + k]]
                    for w in set(WORDS.findall(text.lower())) if text else ():
                        mine[w] = mine.get(w, 0) + 1
        words = list(found[0].keys() | found[1].keys())
        for a in range(0, len(words), 50_000):
            part = words[a : a + 50_000]
            yield pa.record_batch(
                [pa.array(part, pa.string()), pa.array([found[1].get(w, 0) for w in part], pa.int64()), pa.array([found[0].get(w, 0) for w in part], pa.int64())],
                ["word", "y1", "y0"],
            )

    words = materialize(rows.mapInArrow(vocabulary, "word string, y1 bigint, y0 bigint").groupBy("word").agg(F.sum("y1").alias("y1"), F.sum("y0").alias("y0")), "toxic-words")
    all1, all0, n_words = (float(x or 0) for x in words.agg(F.sum("y1"), F.sum("y0"), F.count(F.lit(1))).first())
    total = all1 + all0
    if not all1 or not all0:
        base = math.log(n1 / n0)
        return ToxicityModel({}, base=base)
    prior = PRIOR_SHARE * total

    a = F.lit(prior / total) * (F.col("y1") + F.col("y0"))
    up, down = F.col("y1") + a, F.col("y0") + a
    effect = F.log(up / (F.lit(all1 + prior) - up)) - F.log(down / (F.lit(all0 + prior) - down))
    z = effect / F.sqrt(1 / up + 1 / down)
    # as many terms are tested, so far out lies the largest z of chance
    keep = (effect >= min_effect) & (z >= math.sqrt(2 * math.log(max(n_words, 2))))
    scores: dict[str, float] = {}
    clean: dict[str, float] = {}
    left = words
    for k in (0, *PREFIXES):
        term = F.col("word") if k == 0 else F.substring("word", 1, k)
        pool = left if k == 0 else left.filter(F.length("word") > k)
        terms = pool.groupBy(term.alias("term")).agg(F.sum("y1").alias("y1"), F.sum("y0").alias("y0"))
        kept = terms.filter(keep).select("term", effect.alias("s"), (down / F.lit(all0 + prior)).alias("p")).limit(max_terms + 1).collect()
        if len(kept) + len(scores) > max_terms:
            raise ValueError(f"more than {max_terms} scored terms")
        tag = "w" if k == 0 else str(k)
        scores |= {tag + r["term"]: r["s"] for r in kept}
        clean |= {tag + r["term"]: r["p"] for r in kept}
        if kept:
            gone = F.col("word") if k == 0 else F.when(F.length("word") > k, F.substring("word", 1, k))
            names = spark.createDataFrame([(r["term"],) for r in kept], "gone string")
            left = left.join(F.broadcast(names), gone == F.col("gone"), "left_anti")
    discard(words)
    model = ToxicityModel(scores)
    if not scores:
        model.base = math.log(n1 / n0)
        return model
    s = np.array([scores[t] for t in scores])
    p = np.array([clean[t] for t in scores])
    model.rate = _solve_rate(s, p)

    shared = spark.sparkContext.broadcast(model)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic, n_tokens, found = batch.column(1).to_pylist(), [], []
            for _, texts in chunks(batch, "text"):
                for text in texts:
                    n, hits = shared.value.hits(text)
                    n_tokens.append(n)
                    found.append([x.score for x in maximal_segments(hits)])
            yield pa.record_batch([pa.array(toxic, pa.int32()), pa.array(n_tokens, pa.int64()), pa.array(found, pa.list_(pa.float64()))], ["toxic", "n", "found"])

    # a bounded sample: its texts' segment scores come to the driver
    scanned = [(r["toxic"], r["n"], r["found"]) for r in rows.mapInArrow(scan, "toxic int, n bigint, found array<double>").collect()]
    discard(rows)
    tokens = sum(n for y, n, _ in scanned if not y)
    chance = sorted(x for y, _, f in scanned if not y for x in f)
    cut = chance[len(chance) // 2] if chance else float(s.min())
    above = sum(x >= cut for x in chance)
    model.log_k = math.log((above + 0.5) / max(tokens, 1)) + model.rate * cut
    y = np.array([r[0] for r in scanned], float)
    e = np.zeros(len(scanned))
    for i, (_, n, f) in enumerate(scanned):
        floor = model.log_k + math.log(max(n, 1))
        e[i] = ToxicityModel.evidence(sorted((v for x in f if (v := model.rate * x - floor) > 0), reverse=True))
    weight = np.where(y > 0, n1 / max(y.sum(), 1), n0 / max((1 - y).sum(), 1))
    model.base, model.slope = _logistic(np.minimum(e, 60.0), y, weight)
    return model


def _solve_rate(s: np.ndarray, p: np.ndarray) -> float:
    """lambda > 0 with sum p exp(lambda s) + (1 - sum p) exp(lambda DRIFT) = 1, by bisection."""
    rest = max(0.0, 1.0 - p.sum())

    def excess(x: float) -> float:
        return float((p * np.exp(np.minimum(x * s, 600))).sum()) + rest * math.exp(x * DRIFT) - 1.0

    low, high = 1e-6, 1.0
    while excess(high) < 0 and high < 100:
        high *= 2
    if excess(low) >= 0:
        return 0.05
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if excess(mid) < 0 else (low, mid)
    return high


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> tuple[float, float]:
    """Ridge logistic fit of y on x by Newton steps; the slope is not below 0."""
    design = np.stack([np.ones_like(x), x], 1)
    beta = np.zeros(2)
    penalty = np.array([1e-3, ridge])
    for _ in range(100):
        z = np.clip(design @ beta, -30, 30)
        mu = 1 / (1 + np.exp(-z))
        grad = design.T @ (weight * (y - mu)) - penalty * beta
        hess = (design * (weight * mu * (1 - mu))[:, None]).T @ design + np.diag(penalty)
        step = np.linalg.solve(hess, grad)
        size = np.abs(step).max()
        beta += step * min(1.0, 2.0 / max(size, 1e-12))
        if size < 1e-9:
            break
    return float(beta[0]), float(max(beta[1], 0.0))


def score_documents(docs: DataFrame, model: ToxicityModel, keep: tuple[str, ...] = ("doc_id",), with_passages: bool = False, score_name: str = "tox_score") -> DataFrame:
    """``keep`` columns plus the score (and ``passages``: token start, end and normalised score) for every row."""
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(model)
    schema = ", ".join(column_ddl(docs.schema[c]) for c in keep) + f", `{score_name}` double"
    schema += ", passages array<struct<start: int, end: int, score: double>>" if with_passages else ""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    rows, name = with_text(docs, keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        only_caches_of("toxicity", m.forget)
        for batch in batches:
            scores, spans = [], []
            for _, texts in chunks(batch, name):
                for text in texts:
                    found = m.passages(*m.hits(text))
                    scores.append(m.score(min(60.0, m.evidence([x for _, x in found]))))
                    if with_passages:
                        spans.append([{"start": g.start, "end": g.end, "score": x} for g, x in found])
            cols = [batch.column(i) for i in range(len(keep))]
            cols += [pa.array(scores, pa.float64())] + ([pa.array(spans, kind)] if with_passages else [])
            yield pa.RecordBatch.from_arrays(cols, names=[*keep, score_name] + ["passages"] * with_passages)

    return rows.mapInArrow(run, schema)


def detect_toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, fit_docs: int = 4000) -> DataFrame:
    """``doc_id, held_out, score, predicted``; labels of the held-out fold are not learned from."""
    is_held = fold(F.col("doc_id"), folds) == held_out
    model = fit(docs, labels, ~is_held, fit_docs)
    scored = score_documents(docs, model)
    return scored.select("doc_id", is_held.alias("held_out"), F.col("tox_score").alias("score"), (F.col("tox_score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, fit_docs: int = 4000) -> DataFrame:
    """Rows of ``docs`` whose score is below 0.5, with the columns of ``docs``."""
    (score,) = free_names(docs.columns, "tox_score")
    model = fit(docs, labels, fold(F.col("doc_id"), folds) != held_out, fit_docs)
    scored = score_documents(docs, model, tuple(docs.columns), score_name=score)
    return scored.filter(F.col(score) < 0.5).select(*quoted(docs.columns))
