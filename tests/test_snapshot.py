"""Findings, decisions, metadata and what a dashboard is given."""

import json

import pytest
from pyspark.sql import functions as F

from provena.errors import AggregationError, CorruptAuditLog, FindingError, ProvenanceError
from provena.functions.ids import ID_TYPE, id_repr, ids_json
from provena.operators import evidence as ev
from provena.operators import findings as fi
from provena.plans.snapshot import DEMO_ASSETS, Snapshot, demo_snapshot, snapshot_of


def ident(x):
    return ("int" if isinstance(x, int) else "str", str(x))


def test_demo_and_empty_snapshot(spark):
    demo = demo_snapshot(spark)
    assert demo.assets.count() == 3 and demo.findings.count() == 4
    assert [r.layer for r in demo.report().collect()] == ["1C", "1D", "1E", "1G"]
    again = json.loads(demo.to_json())
    assert again["demo_mark"] == "DEMO / SAMPLE DATA" and len(again["findings"]) == 4 and [a["image_id"]["id"] for a in again["assets"]] == list(DEMO_ASSETS)
    assert list(again) == sorted(again)
    none = snapshot_of(None, spark)
    assert (none.run_id, none.header()["total_assets"], none.findings.count()) == ("pipeline-not-connected", 0, 0)
    with pytest.raises(FindingError):
        Snapshot("r", "demo", "d", demo.assets, demo.findings, (), ())
    broken = Snapshot("r", "pipeline", "d", demo.assets, demo.findings.withColumn("score", F.lit(float("nan"))), (), ())
    with pytest.raises(Exception, match="not finite"):
        broken.to_json()


def test_write_lines(spark, tmp_path):
    demo_snapshot(spark).write_lines(str(tmp_path / "s"))
    assert spark.read.json(str(tmp_path / "s" / "findings")).count() == 4
    assert spark.read.json(str(tmp_path / "s" / "header")).first().mode == "demo"


def test_finding_contract(spark):
    good = demo_snapshot(spark).findings
    fi.check_findings(good)
    for change in ({"title": F.lit(" ")}, {"confidence": F.lit(1.2)}, {"confidence": F.lit(float("nan"))}, {"reason": F.lit(None).cast("string")}):
        with pytest.raises(FindingError):
            fi.check_findings(good.withColumns(change))
    assert [r.label for r in fi.first_findings(good, 1).collect()] == ["[1C] Near-duplicate pair candidate · demo-1c-pair-01"]


def test_decisions_and_export(spark, tmp_path):
    one = demo_snapshot(spark).findings.filter("layer = '1C'").withColumn("reference", F.col("finding_id"))
    made = fi.decisions_from_findings(one, "ACCEPT", " me ", " fine ", "demo", "d1", "2024-01-01T00:00:00Z", "r")
    row = made.first()
    assert (row.decision_id, row.actor, row.rationale, list(row.evidence_references)) == ("d1", "me", "fine", ["demo-1c-pair-01"])
    for bad in (("MAYBE", "me", "x", "demo"), ("ACCEPT", " ", "x", "demo"), ("ACCEPT", "me", "x", "live")):
        with pytest.raises(FindingError):
            fi.decisions_from_findings(one, *bad, "d1", "2024-01-01T00:00:00Z", "r")
    events = fi.decision_events(made.withColumn("position", F.lit(0)))
    assert fi.invalid_events(events).count() == 0
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in events.schema.fields if f.name != "position")
    path = str(tmp_path / "deep" / "log.jsonl")
    assert fi.read_audit_log(spark, path, schema).count() == 0
    fi.append_audit_log(events, path, schema)
    log = fi.read_audit_log(spark, path, schema)
    document = json.loads(fi.export_document(log, "2024-02-02T00:00:00Z"))
    assert (document["event_count"], document["exported_at"], document["schema_version"]) == (2, "2024-02-02T00:00:00Z", 1)
    assert [e["event_id"] for e in document["events"]] == ["d1:reviewed", "d1:decision"]
    assert fi.latest_decision(log).first().analyst_decision == "ACCEPT"
    assert [r.position for r in fi.latest_first(log).collect()] == [1, 0]
    for change, reason in (({"mode": F.lit("live")}, "mode"), ({"rationale": F.lit(" ")}, "rationale"), ({"schema_version": F.lit(2)}, "schema_version"), ({"evidence_references": F.array(F.lit(""))}, "evidence_references")):
        wrong = events.withColumns(change)
        assert {r.reason for r in fi.invalid_events(wrong).collect()} == {reason}
        with pytest.raises(FindingError):
            fi.append_audit_log(wrong, path, schema)
    with open(path, "a") as f:
        f.write(open(path).readline().replace('"demo"', '"live"'))
    with pytest.raises(CorruptAuditLog, match="line 3: mode"):
        fi.read_audit_log(spark, path, schema)


def test_literals(spark):
    texts = ["a", "it's", 'a"b', "it's \"x\"", "back\\slash", "tab\tline\n", "é"]
    rows = spark.createDataFrame([(ident(x),) for x in [1, -2, *texts]], f"i {ID_TYPE}")
    assert [r[0] for r in rows.select(id_repr(F.col("i"))).collect()] == [repr(x) for x in [1, -2, *texts]]
    got = rows.select(ids_json(F.array(F.col("i"), F.col("i")))).collect()
    assert [r[0] for r in got] == [json.dumps([ident(x), ident(x)], ensure_ascii=False, separators=(",", ":")) for x in [1, -2, *texts]]


def test_metadata(spark):
    rows = [(ident(1), {"contributor": "a", "contributor_id": "b", "source_id": "s"}, None), (ident(2), {"batch": " "}, 5), (ident("x"), None, None)]
    images = spark.createDataFrame(rows, f"image_id {ID_TYPE}, metadata map<string,string>, batch_id int")
    got = {r.image_id.id: (r.contributor, r.source, r.batch) for r in ev.source_metadata(images, {"source": "lab", "batch_id": 7}).collect()}
    assert got == {"1": ("a", "s", "7"), "2": (None, "lab", "5"), "x": (None, "lab", "7")}
    found, conflicts = ev.resolve(ev.candidates(*ev.metadata_records(images, {"source": "lab", "source_id": "lab", "batch_id": 7})))
    by = {r.image_id.id: r for r in found.collect()}
    assert by["1"].contributor_id.value == "b" and by["1"].source_id is None and by["1"].batch_id.value == "7" and by["x"].source_id.value == "lab"
    assert {(r.image_id.id, r.field) for r in conflicts.collect()} == {("1", "source_id"), ("2", "batch_id")}


def test_groups_in_order_with_reasons(spark):
    images = spark.createDataFrame([(ident(i),) for i in range(4)], f"image_id {ID_TYPE}")
    v = lambda x: None if x is None else ident(x)
    schema = f"image_id {ID_TYPE}, " + ", ".join(f"{f} {ev.VALUE}" for f in ev.FIELDS)
    p = spark.createDataFrame([(ident(0), v("b"), v(2), None), (ident(1), v("a"), v(10), None), (ident(2), v("b"), None, None)], schema)
    pairs = spark.createDataFrame([(ident(0), ident(2), 0.987654)], f"image_a {ID_TYPE}, image_b {ID_TYPE}, similarity double")
    got = ev.aggregate_risk(images, ev.pair_evidence(pairs, 0.95), p)
    rows = ev.ordered_groups(got.groups).collect()
    assert [r.group_id for r in rows][:4] == ["contributor_id=str:a", "contributor_id=str:b", "source_id=int:10", "source_id=int:2"]
    assert rows[1].reason == "Observed 1 distinct detector findings affecting 2 of 2 images (Layer 1C near-duplicate: 1); weighted evidence score 1.000. Recommendation: REVIEW."
    assert rows[0].reason == "Observed 0 distinct detector findings affecting 0 of 1 images (No detector findings affected this group.); weighted evidence score 0.000. Recommendation: ACCEPT."
    item = ev.pair_evidence(pairs, 0.95).first()
    assert item.summary == "Near-duplicate pair 0 ↔ 2; cosine similarity 0.987654 met configured threshold 0.950000."
    assert item.evidence_id == '[["int","0"],["int","2"]]'
    huge = {c: 1.7e308 for c in ev.WEIGHTS}
    two = ev.pair_evidence(pairs.unionAll(pairs.withColumn("image_b", F.col("image_a")).withColumn("image_a", F.struct(F.lit("int").alias("id_type"), F.lit("1").alias("id")))), 0.95)
    with pytest.raises(AggregationError, match="overflow"):
        ev.aggregate_risk(images, two, p, weights=huge)
    with pytest.raises(ProvenanceError):
        ev.aggregate_risk(images, two, p.withColumn("image_id", F.struct(F.lit("int").alias("id_type"), F.lit("77").alias("id"))))


def test_label_texts_use_names(spark):
    findings = spark.createDataFrame([(ident("i'"), [1, 2], 3, 0.9, "review")], f"image_id {ID_TYPE}, labels array<bigint>, competing_label bigint, score double, state string")
    names = spark.createDataFrame([(1, "car"), (2, " ")], "category_id bigint, name string")
    assert ev.label_evidence(findings, 0.8, names).first().summary == 'Label-neighborhood review for image "i\'": assigned [car, 2], strongest competing label [3], score 0.900000 at threshold 0.800000.'
