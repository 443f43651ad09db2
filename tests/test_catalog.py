"""Every query of the catalogue against its SQL form, on the smallest tables."""

import functools
import numbers
import os

import duckdb
import pandas as pd
import pytest

from provena.plans import catalog, oracles

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def rows(frame):
    cols = sorted(frame.columns)
    out = []
    for r in frame[cols].itertuples(index=False):
        out.append(tuple("null" if x is None or x is pd.NA or x != x else round(float(x), 5) + 0.0 if isinstance(x, numbers.Real) and not isinstance(x, bool) else str(x) for x in r))
    return cols, sorted(out, key=str)


@pytest.fixture(scope="module", autouse=True)
def shared_runs():
    """Runs of detectors that several queries read are made once; each query still runs through its own code."""
    made = {name: getattr(catalog, name) for name in ("_run", "risk", "_labels", "all_evidence")}
    for name, f in made.items():
        setattr(catalog, name, functools.cache(f))
    yield
    for name, f in made.items():
        setattr(catalog, name, f)


@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n in oracles.ORACLE_SQL])
def test_query(spark, duck, name):
    if not os.path.isdir(DATA):
        pytest.skip("no test tables here")
    got = rows(catalog.QUERIES[name](spark, DATA).toPandas())
    want = rows(duck.sql(oracles.ORACLE_SQL[name]).df())
    assert got == want


def test_every_query_has_a_form():
    assert set(catalog.QUERIES) == set(oracles.ORACLE_SQL)


def test_runner(spark):
    from provena.plans.runner import Settings, register_functions, run_integrity

    f, lab = catalog.features(spark, DATA), catalog.labels(spark, DATA)
    ref, query = catalog.parity(spark, DATA)
    run = run_integrity(catalog._assets(spark, DATA), f, lab, catalog.provenance(spark, DATA), ref, query, catalog.hashes(spark, DATA), Settings(cosine_threshold=0.4, shift_threshold=0.35, hash_threshold=18))
    assert {r.layer for r in run.findings.select("layer").distinct().collect()} == {"1C", "1D", "1E", "1F", "1G", "1H"}
    register_functions(spark)
    far = spark.sql("SELECT cosine_similarity(array(1e200D, 1e200D), array(1e200D, -1e200D)) AS a, cosine_similarity(array(1e-200D, 1e-200D), array(1e-200D, 1e-200D)) AS b").first()
    assert abs(far.a) < 1e-12 and abs(far.b - 1) < 1e-12
    for bad in ("array(1D, 2D)", "array(double('NaN'))"):
        with pytest.raises(Exception, match="differ in length or are not finite"):
            spark.sql(f"SELECT cosine_similarity(array(1D), {bad})").collect()
    row = spark.sql("SELECT cosine_similarity(array(1D, 0D), array(1D, 0D)) AS c, cosine_similarity(array(0D), array(1D)) AS z, hamming_distance(0L, -1L) AS h").first()
    assert tuple(row) == (1.0, 0.0, 64)


def test_hash_pairs_equal_their_definition(spark):
    """Tiles, and bands where the threshold leaves wide ones, against a plain theta join; with equal hashes and far ones."""
    from provena.operators import near_duplicates as nd

    hashes = catalog.hashes(spark, DATA)
    some = hashes.limit(40)
    near = some.unionAll(some.selectExpr("struct('str', concat('x', image_id.id)) AS image_id", "hash ^ 5 AS hash")).unionAll(some.selectExpr("struct('str', concat('y', image_id.id)) AS image_id", "hash"))
    for rows, threshold in ((hashes, 18), (near, 0), (near, 2), (near, 3), (near, 64)):
        got = sorted(map(str, nd.hash_pairs(rows, threshold).collect()))
        assert got == sorted(map(str, nd.hash_pairs_sql(rows, threshold).collect()))


def test_tiles_of_many_blocks(spark, monkeypatch):
    """Blocks and strips of a few rows give the pairs of one block."""
    from provena.operators import near_duplicates as nd
    from provena.operators import neighbours as nb
    from provena.operators import tiles

    def listed(frame):
        return sorted(tuple(round(x, 9) if isinstance(x, float) else str(x) for x in r) for r in frame.collect())

    f = catalog.features(spark, DATA).limit(200)
    whole, near = listed(nd.cosine_pairs(f, 0.3)), listed(nb.nearest_others(f, None, 3))
    monkeypatch.setattr(tiles, "BLOCK_BYTES", 64 * 8 * 41)
    monkeypatch.setattr(tiles, "STRIP", 13)
    assert len(whole) and listed(nd.cosine_pairs(f, 0.3)) == whole
    assert listed(nb.nearest_others(f, None, 3)) == near


def test_event_stream(spark, tmp_path):
    from provena.streaming.scoring import event_counts, read_event_stream

    (tmp_path / "in").mkdir()
    lines = [f'{{"ts": "2024-01-01T00:{m:02d}:00Z", "event_type": "{t}"}}' for m, t in ((1, "a"), (2, "a"), (3, "b"), (12, "a"), (59, "a"))]
    (tmp_path / "in" / "log.json").write_text("\n".join(lines))
    counts = event_counts(read_event_stream(spark, str(tmp_path / "in"), "ts timestamp, event_type string"))
    counts.writeStream.format("memory").queryName("event_counts").outputMode("update").trigger(availableNow=True).start().awaitTermination()
    got = sorted((r.window.start.minute, r.event_type, r.events) for r in spark.table("event_counts").collect())
    assert got == [(0, "a", 2), (0, "b", 1), (10, "a", 1), (50, "a", 1)]


def test_stream_scores(spark, tmp_path):
    from provena.streaming.scoring import score_stream

    ref, query = catalog.parity(spark, DATA)
    query.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(query.schema).parquet(str(tmp_path / "in"))
    score_stream(stream, ref, str(tmp_path / "out"), str(tmp_path / "cp"), 0.35).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == query.count()
