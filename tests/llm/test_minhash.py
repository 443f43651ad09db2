import numpy as np
from pyspark.sql import functions as F

from provena.llm import minhash as mh

SCHEMA = "doc_id bigint, text string, class_id string, h string"
BASE = [f"w{i}" for i in range(200)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA)


def classes(spark, rows):
    return {r.doc_id: r.class_id for r in mh.near_duplicate_classes(frame(spark, rows)).collect()}


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(3)
    a = {int(k): float(w) for k, w in zip(rng.integers(0, 2**44, 80), rng.uniform(0.1, 4, 80), strict=True)}
    b = {k: w * (0.4 if i % 4 == 0 else 1) for i, (k, w) in enumerate(a.items()) if i % 9}
    both = set(a) | set(b)
    want = sum(min(a.get(k, 0), b.get(k, 0)) for k in both) / sum(max(a.get(k, 0), b.get(k, 0)) for k in both)
    owner = np.array([0] * len(a) + [1] * len(b))
    s = mh.dart_signatures(owner, np.array([*a, *b], np.uint64), np.array([*a.values(), *b.values()]), 2, 8192)
    assert abs((s[0] == s[1]).mean() - want) < 0.03
    assert (s != mh._NONE).all()


def test_signature_does_not_depend_on_batch():
    words = [["a"] * 9, BASE, BASE[:7], []]
    together = mh.text_signatures(words)
    for i, w in enumerate(words):
        assert (mh.text_signatures([w])[0] == together[i]).all()
    assert (together[3] == mh._NONE).all()


def test_elements_are_multisets():
    a, b = mh.elements(["x"] * 10), mh.elements(["x"] * 12)
    assert mh.similarity(a, b) == 6 / 8
    assert mh.similarity(a, mh.elements([])) == 0.0


def test_overlaps_equal_pairwise():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 9000, rng.integers(1, 6000)).astype(np.uint64)) for _ in range(12)]
    got = mh._overlaps(sets[:5], sets[5:])
    assert (got == [[len(np.intersect1d(x, y)) for y in sets[5:]] for x in sets[:5]]).all()


def test_classes_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = []
    for g in range(6):
        base = [f"g{g}w{rng.integers(0, 900)}" for _ in range(150)]
        for _ in range(9):
            words = list(base)
            for _ in range(rng.integers(0, 9)):
                words[rng.integers(0, len(words))] = f"e{rng.integers(0, 10**6)}"
            rows.append((len(rows), " ".join(words)))
    e = {i: mh.elements(mh.words_of(t)) for i, t in rows}
    want = {i: i for i in e}
    changed = True
    while changed:
        changed = False
        for i in e:
            for j in e:
                if i < j and mh.similarity(e[i], e[j]) >= mh.THRESHOLD and want[i] != want[j]:
                    want[i] = want[j] = min(want[i], want[j])
                    changed = True
    assert classes(spark, rows) == want


def test_large_buckets_are_compared_exactly(spark, monkeypatch):
    monkeypatch.setattr(mh, "SMALL", 2)
    monkeypatch.setattr(mh, "TILE", 4)
    test_classes_equal_brute_force(spark)


def test_odd_rows(spark):
    long = " ".join(f"z{i}" for i in range(30000))
    rows = [(1, None), (2, ""), (3, "!!"), (4, "Hi there"), (5, "hi, THERE"), (5, "hi there"), (6, long), (7, long + " end"), (None, "hi there"), (8, "a"), (9, None)]
    got = mh.near_duplicate_classes(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r.class_id for r in got if r.doc_id is not None}
    assert by == {1: 1, 2: 2, 3: 3, 4: 4, 5: 4, 6: 6, 7: 6, 8: 8, 9: 9}
    assert [r.class_id for r in got if r.doc_id is None] == [4]
    assert mh.near_duplicate_classes(frame(spark, [])).count() == 0


def test_one_of_each_stays(spark):
    text = " ".join(BASE)
    rows = [(3, text), (2, text + " more"), (1, "another text altogether"), (7, None), (8, None), (4, "one two"), (4, "one two")]
    kept = mh.keep_one_of_each(frame(spark, rows))
    assert kept.columns == ["doc_id", "text", "class_id", "h"]
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 4, 7, 8]
    assert mh.keep_one_of_each(frame(spark, [])).count() == 0
    assert kept.filter(F.col("h") == "y").count() == 5
