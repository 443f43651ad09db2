import zlib

import pytest
from pyspark.sql import functions as F

from provena.llm import langid, toxicity
from provena.llm.text import fold

DATA = "/root/testdata/sf0.01"


def docs(spark, rows):
    return spark.createDataFrame([(*r, 1.0, "q") for r in rows], "doc_id bigint, text string, lang string, score double, toxic string")


def test_fold_is_crc32_of_the_text(spark):
    got = [r.f for r in spark.range(50).select(fold(F.col("id"), 3).alias("f")).collect()]
    assert got == [zlib.crc32(str(i).encode()) % 3 for i in range(50)]


def test_language_of_held_out_texts(spark):
    d = spark.read.parquet(f"{DATA}/documents.parquet")
    got = langid.identify_languages(d).join(d.select("doc_id", "lang"), "doc_id").filter("held_out").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.97 and got.score.between(0, 1).all()


def test_language_odd_rows(spark):
    rows = [(i, t * 5, lang) for i, (t, lang) in enumerate([("the cat and the dog ", "en"), ("der hund und die katze ", "de")] * 20)]
    rows += [(100, None, "en"), (101, "", None), (102, "12 !?", "en"), (103, "the dog " * 40000, None), (None, "und der hund", "de"), (0, "the cat and the dog " * 5, "en")]
    x = docs(spark, rows)
    got = {(r.doc_id): r for r in langid.identify_languages(x).collect()}
    assert [got[i].lang_pred for i in (100, 101, 102, 103)] == ["und", "und", "und", "en"]
    assert got[100].score == 0 and got[None].lang_pred == "de"
    kept = langid.keep_identified(x.drop("score"))
    assert kept.columns == ["doc_id", "text", "lang", "toxic"] and kept.count() == len(rows) - 3
    none = langid.identify_languages(docs(spark, [(1, "text", None)])).first()
    assert (none.lang_pred, none.score) == ("und", 0.0)
    assert langid.identify_languages(docs(spark, [])).count() == 0


def test_short_texts_of_several_languages_stay(spark):
    """A word that six languages share has a posterior of about a sixth; it is clean text all the same."""
    rows = [(i, "radio taxi hotel " * 3, lang) for i, lang in enumerate(["en", "de", "fr", "es", "it", "nl"] * 60)] + [(900, "taxi", None), (901, "7", None)]
    x = docs(spark, rows).drop("score")
    scores = {r.doc_id: r.score for r in langid.identify_languages(x).collect()}
    assert 0 < scores[900] < 0.5
    assert {r.doc_id for r in langid.keep_identified(x).collect()} == {i for i, _, _ in rows} - {901}


def test_language_counts_equal_brute_force():
    texts = ["Ab, cd", None, "é x", "", "ab"]
    got = {}
    for bucket, owner in langid.grams(texts):
        for b, o in zip(bucket.tolist(), owner.tolist(), strict=True):
            got.setdefault(o, []).append(b)
    assert set(got) == {0, 2, 4}
    # "ab cd": letters 4, pairs 4, triples 3; "ab " has a space at the end only inside the text
    assert len(got[0]) == 4 + 4 + 3 and len(got[4]) == 2 + 1
    assert sorted(got[4])[0] in got[0]


@pytest.mark.parametrize("hits", [[], [(0, 1.0)], [(0, 1.0), (1, 1.0), (50, 2.0)], [(3, 1.0), (5, 0.2), (7, 3.0), (20, 0.5), (21, 0.1), (60, 4.0)]])
def test_segments_equal_brute_force(hits):
    """All maximal segments: repeatedly the best-scoring stretch, then left and right of it."""
    n, drift = 70, -0.3
    s = [drift] * n
    for i, x in hits:
        s[i] = x

    def solve(a, b):
        best = None
        for i in range(a, b):
            total = 0.0
            for j in range(i, b):
                total += s[j]
                if total > 1e-12 and (best is None or total > best[2] + 1e-9):
                    best = (i, j + 1, total)
        if best is None:
            return []
        return [*solve(a, best[0]), best, *solve(best[1], b)]

    got = [(g.start, g.end, round(g.score, 6)) for g in toxicity.maximal_segments(hits, drift)]
    assert got == [(a, b, round(x, 6)) for a, b, x in solve(0, n)]


def test_segments_are_linear_in_time():
    hits = [(i, 1.0 if i % 3 else 0.25) for i in range(0, 400_000, 2)]
    assert toxicity.maximal_segments(hits)


def test_only_near_copies_are_left_out_of_the_sample(spark):
    """Texts around one common passage stay, each with its own words; copies and near copies are one."""
    passage = " ".join(f"licence{k}" for k in range(40))
    rows = [(i, f"{passage} " + " ".join(f"own{i}x{k}" for k in range(12)), "en") for i in range(300)]
    long = [f"word{k}" for k in range(400)]
    rows += [(1000 + i, " ".join([*long[:200], f"new{i}", *long[200:]]), "en") for i in range(50)] + [(2000 + i, "a copy of one text", "en") for i in range(50)]
    labels = spark.createDataFrame([(i, 1, 1) for i, _, _ in rows], "doc_id bigint, quality int, toxic int")
    sample, n1, _ = toxicity._label_rows(docs(spark, rows), labels, F.lit(True), 4000)
    got = [r.text for r in sample.collect()]
    assert n1 == 400 and {t for _, t, _ in rows[:300]} <= set(got)
    assert len(got) <= 300 + 5 + 1 and "a copy of one text" in got


def test_toxicity_of_held_out_texts(spark):
    d, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    got = toxicity.detect_toxicity(d, labels).join(labels, "doc_id").toPandas()
    clean, bad = got[got.toxic == 0], got[got.toxic == 1]
    assert clean.predicted.mean() < 0.02 and bad.predicted.mean() > 0.75
    assert ((got.score >= 0.5) == (got.predicted == 1)).all() and got.score.between(0, 1).all()


def test_toxicity_odd_rows(spark):
    rows = [(i, f"some calm words number {i} here " + ("vile foul awful " if i % 2 else "kind nice good "), "en") for i in range(200)]
    rows += [(900, None, None), (901, "", "en"), (902, "calm " * 30000 + "vile foul awful " * 20, "en"), (None, "x", "en")]
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(200)] + [(0, 1, None), (None, 0, 1)], "doc_id bigint, quality int, toxic int")
    x = docs(spark, rows)
    got = {r.doc_id: r for r in toxicity.detect_toxicity(x, labels).collect()}
    assert len(got) == len(rows)
    assert all(got[i].predicted == i % 2 for i in range(200))
    assert got[900].predicted == got[901].predicted == 0 and got[902].predicted == 1
    assert toxicity.drop_toxic(x, labels).columns == x.columns
    assert toxicity.detect_toxicity(x, labels.filter("toxic = 0")).agg(F.max("score")).first()[0] == 0.0
    assert toxicity.detect_toxicity(x, labels.filter("toxic = 1")).agg(F.min("score")).first()[0] == 1.0
    assert toxicity.detect_toxicity(docs(spark, []), labels).count() == 0
