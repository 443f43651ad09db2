import random

import pytest
from pyspark.sql import functions as F

import brute
import corpus_pipeline as cp
from provena.llm import langid, minhash, mixing, toxicity
from provena.llm.queries import ORACLE_SQL, QUERIES, tokenizer_path

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"

WORDS = {
    "en": "the and river house garden window people little bread water street evening".split(),
    "de": "der und haus garten fenster leute wenig brot wasser strasse abend morgen".split(),
    "fr": "le et riviere maison jardin fenetre gens petit pain eau rue soir".split(),
}
NASTY = "zgrobian schlonker vermitz drakkuss".split()


def rows():
    """Texts in three languages; toxic ones, exact and near copies, nulls, empty, wordless and long ones, several sources."""
    rng = random.Random(5)
    out = []
    for i in range(150):
        lang = ("en", "de", "fr")[i % 3]
        text = " ".join(rng.choice(WORDS[lang]) + (str(rng.randrange(100)) if rng.random() < 0.4 else "") for _ in range(rng.randrange(12, 60)))
        if i % 5 == 2:
            words = text.split()
            for _ in range(8):
                words.insert(rng.randrange(len(words)), rng.choice(NASTY))
            text = " ".join(words)
        out.append((i, text, lang, "abc"[rng.randrange(3)] if i % 7 else None))
    base = out[0][1].split()
    for k in range(6):  # near and exact copies of one text
        words = list(base)
        if k % 2:
            words[-1 - k // 2] = f"changed{k}"
        out.append((200 + k, " ".join(words), "en", "a"))
    out += [(300, None, "en", "a"), (301, "", "de", "b"), (302, " \n", None, "b"), (303, "12 34 !", "en", None), (304, "the river " * 3000, "en", "c"), (305, "Haus", None, "b")]
    return [{"doc_id": i, "text": t, "lang": lang, "source": s} for i, t, lang, s in out]


LABELS = {i: int(i % 5 == 2) for i in range(150)}


def frame(spark, data):
    return spark.createDataFrame([(r["doc_id"], r["text"], r["lang"], r["source"], len(r["text"] or "")) for r in data], SCHEMA)


def labels(spark):
    return spark.createDataFrame([(i, y) for i, y in LABELS.items()], "doc_id bigint, toxic int")


def units(spark, data):
    got = frame(spark, data).select("doc_id", mixing._unit_place(17).alias("u")).collect()
    place = {r.doc_id: r.u for r in got}
    return [place[r["doc_id"]] for r in data]


def test_languages_equal_brute_force(spark):
    data = rows()
    got = {r.doc_id: r for r in langid.identify_languages(frame(spark, data)).collect()}
    for r, (lang, score) in zip(data, brute.languages(data), strict=True):
        assert got[r["doc_id"]].lang_pred == lang and abs(got[r["doc_id"]].score - score) < 1e-4
        assert got[r["doc_id"]].held_out == (brute.fold(r["doc_id"], 3) == 1)


def test_toxicity_equals_brute_force(spark):
    data = rows()
    want, model = brute.toxicity_scores(data, LABELS)
    fitted = toxicity.fit(frame(spark, data), labels(spark), toxicity.fold(F.col("doc_id"), 5) != 0)
    assert abs(fitted.rate - model["rate"]) < 1e-9 and abs(fitted.log_k - model["log_k"]) < 1e-6
    assert {k: round(v, 9) for k, v in fitted.scores.items()} == {("w" if k == 0 else str(k)) + t: round(v, 9) for (k, t), v in model["scores"].items()}
    # the rate solves the equation of the extreme-value law
    total = sum(p * 2.718281828459045 ** (fitted.rate * model["scores"][t]) for t, p in model["clean"].items())
    assert abs(total + (1 - sum(model["clean"].values())) * 2.718281828459045 ** (fitted.rate * toxicity.DRIFT) - 1) < 1e-6
    got = {r.doc_id: r for r in toxicity.detect_toxicity(frame(spark, data), labels(spark)).collect()}
    for r, score in zip(data, want, strict=True):
        assert abs(got[r["doc_id"]].score - score) < 1e-6 and got[r["doc_id"]].predicted == (score >= 0.5)


def expected(spark, data):
    """doc_ids that remain after each stage, and the rows of the last one."""
    sentencepiece = pytest.importorskip("sentencepiece")
    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path())
    left = [r for r, (lang, _) in zip(data, brute.languages(data), strict=True) if lang != "und"]
    after = [sorted(r["doc_id"] for r in left)]
    left = [r for r, s in zip(left, brute.toxicity_scores(left, LABELS)[0], strict=True) if s < 0.5]
    after.append(sorted(r["doc_id"] for r in left))
    left = brute.one_of_each(left)
    after.append(sorted(r["doc_id"] for r in left))
    mixed = [r for r, n in zip(left, brute.copies(left, units(spark, left)), strict=True) for _ in range(n)]
    after.append(sorted(r["doc_id"] for r in mixed))
    return after, sorted(brute.token_row(library, r["doc_id"], r["text"]) for r in mixed)


def test_pipeline_equals_brute_force(spark, tmp_path):
    """All rows of run(), and what each stage leaves, against plain Python."""
    data = rows()
    d = str(tmp_path)
    frame(spark, data).write.parquet(f"{d}/documents.parquet")
    labels(spark).write.parquet(f"{d}/labels.parquet")
    after, tokens = expected(spark, data)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for k, (name, stage) in enumerate(cp.STAGES[:4]):
        out = stage(spark, docs, d)
        assert out.columns == docs.columns
        out.write.parquet(f"{d}/stage{k}")
        docs = spark.read.parquet(f"{d}/stage{k}")
        assert sorted(r.doc_id for r in docs.select("doc_id").collect()) == after[k], name
    assert after[0][-1] == 305 and len(after[1]) < len(after[0]) and len(after[2]) < len(after[1])
    got = sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, tuple(r.ids)) for r in cp.run(spark, d).collect())
    assert got == tokens


CLASHING = ["score", "lang_pred", "tox_score", "_h", "_least", "_rows", "_place", "h", "key", "unit", "size", "plan", "nth", "held", "part", "Label", "id", "taken"]


def test_stages_with_clashing_columns_and_odd_rows(spark, tmp_path):
    """Columns named like the stages' own come through as they are; nulls in any column, repeated rows, a very long text."""
    data = rows()[:40] + rows()[150:]
    data += [data[3], {"doc_id": None, "text": "the river and the house", "lang": None, "source": None}, {"doc_id": None, "text": None, "lang": None, "source": None}]
    data.append({"doc_id": 900, "text": "le jardin " * 60000, "lang": "fr", "source": "a"})
    d = str(tmp_path)
    docs = frame(spark, data)
    docs = docs.select("*", *[F.concat(F.lit(f"{c}-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(c) for c in CLASHING])
    labels(spark).write.parquet(f"{d}/labels.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, d)
        out.write.parquet(f"{d}/stage{k}")
        docs = spark.read.parquet(f"{d}/stage{k}")
        if k < 4:
            assert out.columns == columns, name
            for r in docs.select("doc_id", *CLASHING).collect():
                assert all(r[c] == f"{c}-{'none' if r.doc_id is None else r.doc_id}" for c in CLASHING), name
    assert {900, None} <= {r.doc_id for r in docs.select("doc_id").collect()}


def test_stages_on_empty_tables(spark, tmp_path):
    d = str(tmp_path)
    labels(spark).limit(0).write.parquet(f"{d}/labels.parquet")
    docs = frame(spark, [])
    for k, (_, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, d)
        out.write.parquet(f"{d}/stage{k}")
        docs = spark.read.schema(out.schema).parquet(f"{d}/stage{k}")
        assert docs.count() == 0


def test_near_copies_of_brute_force_agree(spark):
    data = rows()
    got = minhash.near_duplicate_classes(frame(spark, data)).collect()
    of = dict(zip((r["doc_id"] for r in data), brute.classes(data), strict=True))
    mine = {r.doc_id: r.class_id for r in got}
    groups, want = {}, {}
    for i, c in mine.items():
        groups.setdefault(c, set()).add(i)
    for i, c in of.items():
        want.setdefault(c, set()).add(i)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_names():
    assert [n for n, _ in cp.STAGES] == ["language", "toxicity", "near_dedup", "mixing", "tokens"]
    assert {k.split("_")[0] for k in QUERIES} == {f"op{i}" for i in range(1, 11)}
    assert set(ORACLE_SQL) <= set(QUERIES)
