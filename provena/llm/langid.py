"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased; every run of characters that are not letters becomes one space. All n-grams of orders 1
to 3 are hashed into ``BUCKETS`` buckets. The model is a matrix of log-probabilities (buckets by languages, with add
``ALPHA`` smoothing) and log priors; it is broadcast, its size is ``BUCKETS * languages * 4`` bytes and the number of languages is
checked against ``max_langs``. Scoring gathers matrix rows for a run of texts and sums them by text in numpy.

The counts come from a bounded sample: at most about ``fit_docs`` documents a language, chosen by a hash of doc_id.
Priors come from all labelled rows.

Cases. Null text, empty text or no letter: ``und`` with score 0. Null lang: the row is not learned from but is
predicted. No labelled row at all: every prediction is ``und``. Repeated rows are predicted alike. Very long texts
are scored whole. Ties go to the language that sorts first. Extra columns are ignored.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provena.llm.text import chunks, column_ddl, fold, free_names, only_caches_of, quoted, unit_hash, with_text
from provena.runtime import ship_package

ORDERS = (1, 2, 3)
BUCKETS = 1 << 16
ALPHA = 0.1
UND = "und"

_letters: np.ndarray | None = None


def _letter_table() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
    return _letters


def grams(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order the buckets of all n-grams and the text (by place in the list) each belongs to."""
    lowered = [(t or "").lower() for t in texts]
    lengths = np.fromiter(map(len, lowered), np.int64, len(lowered))
    code = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(lowered), dtype=np.int32), lengths)
    letter = _letter_table()[code]
    code = np.where(letter, code, np.uint32(32))
    keep = letter.copy()
    keep[1:] |= letter[:-1] & (owner[1:] == owner[:-1])  # one space after each word
    code, owner = code[keep], owner[keep]
    for n in ORDERS:
        m = len(code) - n + 1
        if m <= 0:
            return
        h = code[:m].astype(np.uint64)
        for k in range(1, n):
            h = h * np.uint64(0x100000001B3) + code[k : k + m]
        h = (h + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
        bucket = (h >> np.uint64(64 - 16)).astype(np.int32)
        if n == 1:
            whole = code != 32
        else:
            whole = owner[:m] == owner[n - 1 :]
        yield bucket[whole], owner[:m][whole]


@dataclass
class LanguageModel:
    langs: list[str]
    log_prior: np.ndarray
    log_prob: np.ndarray  # BUCKETS x languages, float32

    def scores(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Predicted language and its posterior for each text."""
        total = np.zeros((len(texts), len(self.langs)))
        seen = np.zeros(len(texts), bool)
        if self.langs:
            for bucket, owner in grams(texts):
                if not len(owner):
                    continue
                seen[owner] = True
                starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
                rows = owner[starts]
                for j in range(len(self.langs)):
                    total[rows, j] += np.add.reduceat(self.log_prob[bucket, j].astype(np.float64), starts)
            total += self.log_prior
            top = total.argmax(1)
            best = 1.0 / np.exp(total - total.max(1, keepdims=True)).sum(1)
        else:
            top, best = np.zeros(len(texts), int), np.zeros(len(texts))
        return [self.langs[k] if ok else UND for k, ok in zip(top, seen, strict=True)], np.where(seen, best, 0.0)


def fit(docs: DataFrame, is_train: Column, fit_docs: int = 3000, max_langs: int = 512) -> LanguageModel:
    """Learn from the rows of ``docs`` (text, lang, doc_id) for which ``is_train`` holds."""
    spark = docs.sparkSession
    ship_package(spark)
    train = docs.filter(is_train & F.col("lang").isNotNull())
    priors = train.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy("lang").limit(max_langs + 1).collect()
    if len(priors) > max_langs:
        raise ValueError(f"more than {max_langs} languages")
    langs = [r["lang"] for r in priors]
    if not langs:
        return LanguageModel([], np.zeros(0), np.zeros((BUCKETS, 0), np.float32))
    share = F.element_at(F.create_map(*[F.lit(x) for r in priors for x in (r["lang"], min(1.0, fit_docs / r["n"]))]), F.col("lang"))
    sample = train.filter(unit_hash(F.col("doc_id"), seed=8) < share).select("text", "lang")
    place = {lang: k for k, lang in enumerate(langs)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only_caches_of("langid", lambda: None)
        found = np.zeros((len(place), BUCKETS), np.int64)
        for batch in batches:
            own = np.array([place[x] for x in batch.column(1).to_pylist()], np.int64)
            for start, texts in chunks(batch, "text"):
                for bucket, owner in grams(texts):
                    np.add.at(found.reshape(-1), own[start + owner] * BUCKETS + bucket, 1)
        k, b = np.nonzero(found)
        yield pa.record_batch([pa.array(k.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(found[k, b])], ["k", "b", "n"])

    counted = sample.mapInArrow(count, "k int, b int, n bigint").groupBy("k", "b").agg(F.sum("n").alias("n")).toArrow()
    table = np.full((BUCKETS, len(langs)), ALPHA)
    table[counted["b"].to_numpy(), counted["k"].to_numpy()] += counted["n"].to_numpy()
    n = np.array([r["n"] for r in priors], float)
    return LanguageModel(langs, np.log(n / n.sum()), np.log(table / table.sum(0)).astype(np.float32))


def predict(docs: DataFrame, model: LanguageModel, keep: tuple[str, ...] = ("doc_id",), names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``keep`` columns plus predicted language and score (columns ``names``) for every row of ``docs``."""
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(model)
    fields = [docs.schema[c] for c in keep]
    schema = ", ".join(f"{column_ddl(f)}" for f in fields) + f", `{names[0]}` string, `{names[1]}` double"
    rows, name = with_text(docs, keep)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only_caches_of("langid", lambda: None)
        for batch in batches:
            found, values = [], []
            for _, texts in chunks(batch, name):
                lang, best = shared.value.scores(texts)
                found += lang
                values.append(best)
            cols = [batch.column(i) for i in range(len(keep))]
            best = np.concatenate(values) if values else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*cols, pa.array(found, pa.string()), pa.array(best, pa.float64())], names=[*keep, *names])

    return rows.mapInArrow(score, schema)


def identify_languages(docs: DataFrame, folds: int = 3, held_out: int = 1, fit_docs: int = 3000) -> DataFrame:
    """``doc_id, held_out, lang_pred, score``; learned only from rows outside the held-out fold."""
    is_held = fold(F.col("doc_id"), folds) == held_out
    model = fit(docs, ~is_held, fit_docs)
    return predict(docs, model).select("doc_id", is_held.alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, min_score: float = 0.0, folds: int = 3, held_out: int = 1, fit_docs: int = 3000) -> DataFrame:
    """Rows of ``docs`` whose language is identified with at least ``min_score`` (by default any score); ``und`` goes."""
    model = fit(docs, fold(F.col("doc_id"), folds) != held_out, fit_docs)
    lang, score = free_names(docs.columns, "lang_pred", "score")
    scored = predict(docs, model, tuple(docs.columns), (lang, score))
    return scored.filter((F.col(lang) != UND) & (F.col(score) >= min_score)).select(*quoted(docs.columns))
