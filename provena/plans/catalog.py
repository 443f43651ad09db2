"""The catalogue: one query for each operator over the test tables, through the library's own functions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provena.functions import boxes as bx
from provena.functions import vectors as vf
from provena.functions.ids import int_id, lookup_id, number_of, str_id
from provena.operators import evidence as ev
from provena.operators import findings as fi
from provena.operators import near_duplicates as nd
from provena.operators import neighbours as nb
from provena.operators.numbering import number_in_order
from provena.plans.oracles import HASH, PAIR, SHIFT
from provena.plans.runner import IntegrityRun, Settings, run_integrity
from provena.sources import coco, yolo
from provena.sources import features as ft
from provena.sources.dataset import Dataset

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def features(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(int_id(F.col("vec_id")).alias("image_id"), F.col("embedding").alias("vector"))


def labels(spark: SparkSession, d: str, multi: bool = False) -> DataFrame:
    one = F.array(F.col("label").cast("bigint"))
    two = F.array_sort(F.array(F.col("label").cast("bigint"), ((F.col("label") + 1) % 10).cast("bigint")))
    sets = F.when(F.col("vec_id") % 5 == 0, two).otherwise(one) if multi else one
    return table(spark, d, "embeddings").select(int_id(F.col("vec_id")).alias("image_id"), sets.alias("labels"))


def num(name: str, alias: str | None = None) -> Column:
    return number_of(F.col(name)).alias(alias or "vec_id")


def r6(c: Column | str, alias: str | None = None) -> Column:
    return F.round(c, 6).alias(alias or c)


def parity(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Reference (even ids) and query (odd ids)."""
    even = number_of(F.col("image_id")) % 2 == 0
    x = features(spark, d)
    return x.filter(even), x.filter(~even)


def hashes(spark: SparkSession, d: str) -> DataFrame:
    return features(spark, d).select("image_id", vf.hex_to_long(vf.bit_signature(F.col("vector"))).alias("hash"))


def provenance(spark: SparkSession, d: str) -> DataFrame:
    covered = table(spark, d, "labels").select(F.col("doc_id").alias("vec_id")).distinct()
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), "source", "lang")
    rows = table(spark, d, "embeddings").select("vec_id").join(docs, "vec_id").join(covered, "vec_id", "left_semi")
    team = F.concat(F.lit("team-"), (F.col("vec_id") % 7).cast("string"))
    return rows.select(
        int_id(F.col("vec_id")).alias("image_id"), ev.text_value(team).alias("contributor_id"), ev.text_value(F.col("source")).alias("source_id"),
        ev.text_value(F.col("lang")).alias("batch_id"),
    )


def all_evidence(spark: SparkSession, d: str) -> DataFrame:
    pairs = nd.cosine_pairs(features(spark, d), PAIR)
    lab = nb.detect_label_disagreement(labels(spark, d), features(spark, d))
    shift = nb.detect_shift(*parity(spark, d), SHIFT)
    return ev.pair_evidence(pairs, PAIR).unionByName(ev.label_evidence(lab.findings)).unionByName(ev.shift_evidence(shift.findings, SHIFT))


def risk(spark: SparkSession, d: str) -> ev.RiskResult:
    return ev.aggregate_risk(features(spark, d).select("image_id"), all_evidence(spark, d), provenance(spark, d))


def ids_text(c: str = "image_ids") -> Column:
    return F.array_join(F.transform(c, lambda x: x["id"]), ",").alias("image_ids")


def box_rows(spark: SparkSession, d: str) -> DataFrame:
    """Annotations made of ``lineitem``: image, category and a pixel box."""
    rows = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("img"), F.col("l_linenumber").cast("bigint").alias("category_id"),
        (F.col("l_quantity") * 12).cast("double").alias("x"), (F.col("l_discount") * 3000).cast("double").alias("y"),
        (F.col("l_tax") * 1000 + 5).cast("double").alias("w"), (F.col("l_quantity") * 3 + 10).cast("double").alias("h"),
    )
    return rows.distinct()


def _b() -> list[Column]:
    return [F.col(c) for c in "xywh"]


# --- near duplicates ------------------------------------------------------------------------------------------------


@query
def vector_norms(spark, d):
    v = F.col("vector")
    return features(spark, d).select(num("image_id"), r6(vf.norm(v), "norm"), r6(F.element_at(vf.normalized(v), 1), "first_unit"))


@query
def nd_pairs(spark, d):
    return nd.cosine_pairs(features(spark, d), PAIR).select(num("image_a", "id_a"), num("image_b", "id_b"), r6("similarity"))


@query
def nd_pair_order(spark, d):
    pairs = nd.ordered_pairs(nd.cosine_pairs(features(spark, d), PAIR))
    return number_in_order(pairs, [F.col("image_a"), F.col("image_b")], "position").select("position", num("image_a", "id_a"), num("image_b", "id_b"))


@query
def nd_clusters(spark, d):
    return nd.detect_near_duplicates(features(spark, d), PAIR).clusters.select("cluster_id", num("image_id"))


@query
def nd_summary(spark, d):
    return nd.detect_near_duplicates(features(spark, d), PAIR).summary


@query
def nd_cluster_sizes(spark, d):
    r = nd.detect_near_duplicates(features(spark, d), PAIR)
    edges = r.pairs.join(r.clusters, F.col("image_a") == F.col("image_id")).groupBy("cluster_id").agg(F.count(F.lit(1)).alias("pairs"))
    return r.clusters.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("members")).join(edges, "cluster_id")


@query
def hash64(spark, d):
    return features(spark, d).select(num("image_id"), vf.bit_signature(F.col("vector")).alias("hash"))


@query
def hash_pairs(spark, d):
    return nd.hash_pairs(hashes(spark, d), HASH).select(num("image_a", "id_a"), num("image_b", "id_b"), "distance")


@query
def hash_clusters(spark, d):
    return nd.detect_hash_duplicates(hashes(spark, d), HASH).clusters.select("cluster_id", num("image_id"))


# --- label neighbourhoods -------------------------------------------------------------------------------------------


def _labels(spark, d) -> nb.LabelResult:
    return nb.detect_label_disagreement(labels(spark, d), features(spark, d))


@query
def label_topk(spark, d):
    return _labels(spark, d).neighbours.select(num("image_id"), num("neighbour_id", "neighbour_id"), F.col("rank").cast("int").alias("rank"), r6("similarity"), "same")


@query
def label_findings(spark, d):
    return _labels(spark, d).findings.select(num("image_id"), "same_count", "different_count", r6("score"), "state", "recommendation")


@query
def label_distribution(spark, d):
    return _labels(spark, d).distribution.select(num("image_id"), "category_id", "count", "position")


@query
def label_same_similarity(spark, d):
    return _labels(spark, d).findings.select(num("image_id"), r6("same_similarity"))


@query
def label_competitor(spark, d):
    return _labels(spark, d).findings.filter("competing_label is not null").select(num("image_id"), "competing_label", "rival_count", r6("rival_similarity"))


@query
def label_summary(spark, d):
    return _labels(spark, d).summary


@query
def label_multilabel(spark, d):
    found = nb.detect_label_disagreement(labels(spark, d, multi=True), features(spark, d)).findings
    return found.select(num("image_id"), F.array_join(F.col("labels").cast("array<string>"), ",").alias("labels"), "same_count", "different_count")


@query
def label_sets(spark, d):
    rows = table(spark, d, "lineitem").select(int_id(F.col("l_orderkey")).alias("image_id"), F.col("l_linenumber").alias("category_id"))
    return nb.label_sets(rows).select(num("image_id", "order_id"), F.array_join(F.col("labels").cast("array<string>"), ",").alias("labels"))


@query
def label_exclusions(spark, d):
    category = F.when(F.col("l_linenumber") > 1, F.col("l_linenumber"))
    rows = table(spark, d, "lineitem").select(int_id(F.col("l_orderkey")).alias("image_id"), category.alias("category_id"))
    images = table(spark, d, "orders").select(int_id(F.col("o_orderkey")).alias("image_id"))
    return nb.label_exclusions(images, nb.label_sets(rows)).select(num("image_id", "order_id"), "reason")


# --- reference shift ------------------------------------------------------------------------------------------------


@query
def ood_findings(spark, d):
    return nb.detect_shift(*parity(spark, d), SHIFT).findings.select(num("image_id"), num("nearest_id", "nearest_id"), r6("similarity"), r6("score"), "state")


@query
def ood_self_excluded(spark, d):
    return nb.detect_shift(parity(spark, d)[0], features(spark, d), SHIFT).findings.select(num("image_id"), num("nearest_id", "nearest_id"), r6("similarity"))


@query
def ood_unscored(spark, d):
    only = features(spark, d).filter(number_of(F.col("image_id")) == 0)
    return nb.detect_shift(only, features(spark, d), SHIFT).unscored.select(num("image_id"), "reason")


@query
def ood_empty_reference(spark, d):
    x = features(spark, d)
    return nb.detect_shift(x.filter(F.lit(False)), x, SHIFT).unscored.select(num("image_id"), "reason")


@query
def ood_summary(spark, d):
    return nb.detect_shift(*parity(spark, d), SHIFT).summary


# --- silhouettes ----------------------------------------------------------------------------------------------------


@query
def silhouette_findings(spark, d):
    f = nb.analyze_silhouette(labels(spark, d), features(spark, d)).findings
    return f.select(
        num("image_id"), F.element_at("labels", 1).alias("label"), r6("intra_distance"), r6("nearest_distance"),
        F.element_at("nearest_labels", 1).alias("nearest_label"), r6("silhouette"), "well_separated",
    )


@query
def silhouette_class_summary(spark, d):
    return nb.analyze_silhouette(labels(spark, d), features(spark, d)).classes.select(F.element_at("labels", 1).alias("label"), "image_count", r6("mean_silhouette"))


@query
def silhouette_class_order(spark, d):
    classes = nb.analyze_silhouette(labels(spark, d), features(spark, d)).classes
    return number_in_order(nb.by_class(classes), F.col("labels"), "position").select("position", F.element_at("labels", 1).alias("label"))


@query
def silhouette_dataset_stats(spark, d):
    s = nb.analyze_silhouette(labels(spark, d), features(spark, d)).summary
    return s.select("scored_images", *[r6(c) for c in s.columns if c != "scored_images"])


@query
def silhouette_unscorable(spark, d):
    return nb.analyze_silhouette(labels(spark, d), features(spark, d), 50).unscorable.select(num("image_id"), "reason")


@query
def silhouette_multilabel(spark, d):
    f = nb.analyze_silhouette(labels(spark, d, multi=True), features(spark, d)).findings
    return f.select(num("image_id"), F.array_join(F.col("labels").cast("array<string>"), ",").alias("labels"), r6("silhouette"))


# --- provenance, evidence, risk -------------------------------------------------------------------------------------


@query
def provenance_resolved(spark, d):
    found, _ = ev.resolve(ev.candidates(provenance(spark, d)))
    return found.select(num("image_id"), F.col("contributor_id.value").alias("contributor"), F.col("source_id.value").alias("source"), F.col("batch_id.value").alias("batch"))


@query
def provenance_conflicts(spark, d):
    docs = table(spark, d, "documents").select(int_id(F.col("doc_id")).alias("image_id"), ev.text_value(F.col("lang")).alias("batch_id"))
    claimed = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    claimed = claimed.select(int_id(F.col("doc_id")).alias("image_id"), ev.text_value(F.when(F.col("toxic") == 1, "xx").otherwise(F.col("lang"))).alias("batch_id"))
    _, conflicts = ev.resolve(ev.candidates(docs, claimed))
    return conflicts.select(num("image_id"), "field", F.size("values").alias("value_count"))


@query
def evidence(spark, d):
    good, _ = ev.dedupe_evidence(all_evidence(spark, d))
    return good.select("category", ids_text(), r6("score"))


@query
def evidence_conflicts(spark, d):
    pairs = nd.cosine_pairs(features(spark, d), PAIR)
    strict = pairs.filter(F.col("similarity") >= 0.42)
    _, bad = ev.dedupe_evidence(ev.pair_evidence(pairs, PAIR).unionByName(ev.pair_evidence(strict, 0.42)))
    return bad.select(ids_text(), "variant_count")


@query
def risk_groups(spark, d):
    g = risk(spark, d).groups.filter("group_type <> 'combined'")
    return g.select(
        "group_type", "group_id", "image_count", "near_duplicate_count", "label_disagreement_count", "distribution_shift_count", "finding_count",
        "affected_images", r6("score"), "recommendation",
    )


@query
def risk_groups_combined(spark, d):
    return risk(spark, d).groups.filter("group_type = 'combined'").select("group_id", "image_count", "finding_count", "affected_images", r6("score"), "recommendation")


@query
def risk_reasons(spark, d):
    """Groups numbered in report order, with their texts."""
    groups = risk(spark, d).groups
    return number_in_order(ev.ordered_groups(groups), [F.col("type_order"), F.col("order_key")], "position").select("position", "group_type", "group_id", "reason")


@query
def evidence_texts(spark, d):
    return ev.ordered_evidence(all_evidence(spark, d)).select("category", "evidence_id", "summary")


def _described(spark, d) -> DataFrame:
    """Images with metadata: some of their own, by both aliases."""
    v = F.col("vec_id")
    meta = F.when(v % 3 == 0, F.create_map(F.lit("contributor"), F.concat(F.lit("c"), v % 4), F.lit("batch_id"), F.lit(" "))).when(
        v % 3 == 1, F.create_map(F.lit("contributor_id"), F.concat(F.lit("d"), v % 4)),
    )
    return table(spark, d, "embeddings").select(int_id(v).alias("image_id"), meta.alias("metadata"))


DATASET_METADATA = {"contributor_id": "team", "source": "lab", "batch": 7}


@query
def source_metadata(spark, d):
    return ev.source_metadata(_described(spark, d), DATASET_METADATA).select(num("image_id"), "contributor", "source", "batch")


@query
def metadata_conflicts(spark, d):
    """Dataset and image metadata both are candidates, so another contributor on an image is a conflict."""
    found, conflicts = ev.resolve(ev.candidates(*ev.metadata_records(_described(spark, d), DATASET_METADATA)))
    clear = found.filter("contributor_id is not null").select(num("image_id"), F.col("contributor_id.value").alias("contributor"), F.lit(1).alias("values"))
    return clear.unionAll(conflicts.filter("field = 'contributor_id'").select(num("image_id"), F.lit(None).cast("string"), F.size("values")))


@query
def risk_unattributed(spark, d):
    return risk(spark, d).unattributed.select("image_count", "affected_images", "finding_count", "near_duplicate_count")


@query
def risk_summary(spark, d):
    return risk(spark, d).summary.select("group_count", "review_count", "unattributed_images", "attribution_complete", "status")


# --- findings and governance ----------------------------------------------------------------------------------------


def _assets(spark, d) -> DataFrame:
    path = F.concat(F.lit("images/"), F.col("vec_id").cast("string"), F.lit(".png"))
    return table(spark, d, "embeddings").select(int_id(F.col("vec_id")).alias("image_id"), path.alias("file_path"))


def _run(spark, d) -> IntegrityRun:
    settings = Settings(cosine_threshold=PAIR, shift_threshold=SHIFT, hash_threshold=HASH)
    reference, asked = parity(spark, d)
    return run_integrity(_assets(spark, d), features(spark, d), labels(spark, d), provenance(spark, d), reference, asked, hashes(spark, d), settings)


def _findings(spark, d) -> DataFrame:
    return _run(spark, d).findings


@query
def findings_unified(spark, d):
    return _findings(spark, d).select("finding_id", "layer", num("image_id"), "severity", r6("score"), "recommendation")


@query
def finding_metrics(spark, d):
    return fi.metrics(_findings(spark, d), _assets(spark, d))


@query
def asset_findings(spark, d):
    return fi.with_assets(_findings(spark, d), _assets(spark, d)).select("finding_id", "file_path")


@query
def finding_report(spark, d):
    """Findings of labels and shift numbered in report order, with their list labels."""
    both = fi.unify(fi.from_labels(_labels(spark, d).findings), fi.from_shift(nb.detect_shift(*parity(spark, d), SHIFT).findings))
    numbered = number_in_order(fi.ordered(both), [F.col("layer"), F.col("finding_id")], "position")
    return numbered.select("position", F.format_string("[%s] %s · %s", "layer", "title", "finding_id").alias("label"))


@query
def first_findings(spark, d):
    return fi.first_findings(fi.from_labels(_labels(spark, d).findings)).select("finding_id", "label")


@query
def finding_contract(spark, d):
    """Findings that break the contract: every third one here lost its title, every fifth has a confidence of 1.5."""
    third, fifth = number_of(F.col("image_id")) % 3 == 0, number_of(F.col("image_id")) % 5 == 0
    broken = fi.from_labels(_labels(spark, d).findings)
    broken = broken.withColumn("title", F.when(third, " ").otherwise(F.col("title"))).withColumn("confidence", F.when(fifth, 1.5).otherwise(0.5))
    return fi.invalid_findings(broken).select("finding_id")


@query
def decisions_made(spark, d):
    reviewed = fi.from_labels(_labels(spark, d).findings).filter("recommendation = 'REVIEW'")
    made = fi.decisions_from_findings(reviewed, "QUARANTINE", " analyst ", "seen", "pipeline", "d1", "2024-01-01T00:00:00Z", "run-1")
    refs = F.array_join("evidence_references", ",").alias("refs")
    return made.select("decision_id", "finding_id", num("affected_image_id"), "source_recommendation", "analyst_decision", "actor", refs, "module")


@query
def decision_log(spark, d):
    """The lines an audit log gets for decisions on the label findings to review."""
    reviewed = fi.from_labels(_labels(spark, d).findings).filter("recommendation = 'REVIEW'")
    made = fi.decisions_from_findings(reviewed, "REVIEW", "analyst", "seen", "pipeline", "d1", "2024-01-01T00:00:00Z", "run-1")
    events = fi.decision_events(number_in_order(made.drop("affected_image_id"), F.col("finding_id"), "position", 0))
    return fi.event_line(events)


def _decisions(spark, d) -> DataFrame:
    kind = F.col("event_type")
    decision = F.when(kind == "click", "ACCEPT").when(kind == "view", "REVIEW").when(kind == "purchase", "QUARANTINE")
    return table(spark, d, "events").select(F.col("event_id").alias("position"), F.col("user_id").alias("finding_id"), decision.alias("analyst_decision"))


@query
def audit_events(spark, d):
    return fi.decision_events(_decisions(spark, d).filter("analyst_decision is not null"))


@query
def latest_decision(spark, d):
    events = fi.decision_events(_decisions(spark, d).filter("analyst_decision is not null"))
    return fi.latest_decision(events, ("finding_id",))


@query
def audit_validation(spark, d):
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    rows = table(spark, d, "events").join(_decisions(spark, d).select(F.col("position").alias("event_id"), "analyst_decision"), "event_id")
    events = rows.select(
        F.lit("governance_decision").alias("event_type"), "analyst_decision", F.lit("analyst").alias("actor"), stamp.alias("timestamp"),
        F.col("event_type").alias("kind"),
    )
    return fi.invalid_events(events).groupBy("kind").agg(F.count(F.lit(1)).alias("invalid"))


@query
def latest_events(spark, d):
    return fi.latest_first(fi.decision_events(_decisions(spark, d).filter("analyst_decision is not null")))


@query
def audit_export_summary(spark, d):
    return fi.export_summary(fi.decision_events(_decisions(spark, d).filter("analyst_decision is not null")))


# --- annotations and boxes ------------------------------------------------------------------------------------------


def _coco_items(spark, d) -> DataFrame:
    """Annotation objects as a COCO file has them, parsed to variants."""
    box = F.array(*[F.col(c) for c in "xywh"])
    item = F.struct(F.col("pos").alias("id"), F.col("img").alias("image_id"), "category_id", box.alias("bbox"), F.lit(0).alias("iscrowd"))
    rows = number_in_order(box_rows(spark, d), [F.col("img"), F.col("category_id"), F.col("x"), F.col("y"), F.col("w"), F.col("h")], "pos", 0)
    return rows.select("pos", F.parse_json(F.to_json(item)).alias("x"))


def _coco(spark, d) -> DataFrame:
    parsed = coco.parse_annotations(_coco_items(spark, d)).filter("error is null")
    return parsed.withColumn("img", number_of(F.col("image_id")))


def _order_images(spark, d, keep: Column | None = None) -> DataFrame:
    rows = table(spark, d, "orders")
    return (rows if keep is None else rows.filter(keep)).select(int_id(F.col("o_orderkey")).alias("image_id"))


@query
def coco_annotations(spark, d):
    return _coco(spark, d).select("img", "category_id", "xmin", "ymin", "width", "height", "area")


@query
def coco_bounds_warnings(spark, d):
    spill = bx.out_of_bounds(*_b(), F.lit(640), F.lit(480))
    return box_rows(spark, d).groupBy("img").agg(F.count_if(spill).alias("spilling"), F.count(F.lit(1)).alias("boxes"))


@query
def coco_fk_violations(spark, d):
    categories = spark.createDataFrame([(k,) for k in range(1, 7)], "category_id bigint")
    lost_image, lost_category = coco.unknown_references(_coco(spark, d), _order_images(spark, d, F.col("o_orderkey") % 2 == 0), categories)
    cols = ["img", "category_id", F.col("xmin").alias("x")]
    return lost_image.select(F.lit("image").alias("lost"), *cols).unionAll(lost_category.select(F.lit("category").alias("lost"), *cols))


def _normal(spark, d) -> DataFrame:
    n = bx.to_yolo(*_b(), F.lit(640), F.lit(480))
    return box_rows(spark, d).select("img", "category_id", *[c.alias(k) for k, c in n.items()])


@query
def yolo_parse(spark, d):
    text = F.concat_ws(" ", F.col("category_id").cast("string"), *[F.round(c, 8).cast("decimal(20,8)").cast("string") for c in ("cx", "cy", "nw", "nh")])
    lines = _normal(spark, d).select("img", F.concat(F.lit(" \t"), text, F.lit("  ")).alias("line"))
    good = yolo.parse_lines(lines).filter("error is null")
    spill = bx.yolo_out_of_bounds(*[F.col(c) for c in ("cx", "cy", "nw", "nh")])
    return good.select("img", "class_id", r6("cx"), r6("cy"), r6("nw"), r6("nh"), spill.alias("spills"))


@query
def yolo_to_pixels(spark, d):
    p = bx.from_yolo(*[F.col(c) for c in ("cx", "cy", "nw", "nh")], F.lit(640), F.lit(480))
    return _normal(spark, d).select("img", "category_id", *[r6(c, k) for k, c in p.items()])


@query
def pixels_to_yolo(spark, d):
    return _normal(spark, d).select("img", "category_id", *[r6(c) for c in ("cx", "cy", "nw", "nh")])


@query
def bbox_geometry(spark, d):
    return box_rows(spark, d).select("img", "category_id", *[r6(c, k) for k, c in bx.corners(*_b()).items()])


@query
def bbox_clamped(spark, d):
    c = bx.clamped(*_b(), F.lit(640), F.lit(480))
    return box_rows(spark, d).select("img", "category_id", *[r6(c[k], k) for k in ("x0", "y0", "cw", "ch")])


@query
def bbox_scaled(spark, d):
    s = bx.scaled(*_b(), (F.lit(640), F.lit(480)), (F.lit(320), F.lit(960)))
    return box_rows(spark, d).select("img", "category_id", *[r6(c, k) for k, c in s.items()])


@query
def yolo_orphans(spark, d):
    files = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("stem")).distinct()
    images = table(spark, d, "orders").filter("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("stem"))
    return yolo.orphans(files, images)


@query
def images_without_annotations(spark, d):
    excluded = nb.label_exclusions(_order_images(spark, d), nb.label_sets(_coco(spark, d)))
    return excluded.filter("reason = 'missing_annotation'").select(num("image_id", "img"))


def _dataset(spark, d) -> Dataset:
    names = spark.createDataFrame([(k, f" class-{k} " if k % 2 else " ") for k in range(1, 5)], "category_id bigint, name string")
    own = F.when(F.col("category_id") > 2, F.concat(F.lit("own-"), (F.col("img") % 3).cast("string")))
    return Dataset("orders", "coco", "", _order_images(spark, d), _coco(spark, d).withColumn("category_name", own), names)


@query
def dataset_counts(spark, d):
    return _dataset(spark, d).counts()


@query
def category_lookup(spark, d):
    named = _dataset(spark, d).with_category_names()
    return named.groupBy("category_id", "category_name").agg(F.count(F.lit(1)).alias("boxes"))


@query
def category_names(spark, d):
    return _dataset(spark, d).category_names()


@query
def id_lookup_fallback(spark, d):
    """Even ids are asked for as integers, odd ones as their text; every one is found."""
    known = int_id(F.col("vec_id"))
    asked = F.when(F.col("vec_id") % 2 == 0, known).otherwise(str_id(F.col("vec_id").cast("string")))
    return table(spark, d, "embeddings").select("vec_id", lookup_id(asked, known).alias("match"))


# --- features -------------------------------------------------------------------------------------------------------


@query
def embedding_space_ids(spark, d):
    model = F.concat(F.lit("m"), F.col("label").cast("string"))
    rows = table(spark, d, "embeddings").select("label").distinct()
    return rows.select(
        F.col("label").cast("bigint").alias("label"),
        ft.space_id_column({"model_id": model, "weights_identity": F.lit("w"), "embedding_dim": F.lit(64)}).alias("space_id"),
    )


@query
def content_fingerprint(spark, d):
    return ft.content_fingerprint(table(spark, d, "pages"), "page_id", "html").select(F.lit("sha").alias("kind"), "fingerprint")


@query
def feature_validation(spark, d):
    return ft.feature_violations(features(spark, d), 64)


@query
def cache_keys(spark, d):
    """Keys of batches with one input; every second one is a fallback's."""
    made = []
    for k in range(6):
        info = ft.BatchInfo("set", "b", f"m{k}", "w", 64, {"p": 1}, {"n": 2}, input_fingerprint="sha256:x")
        info = replace(info, requested_extractor="a", actual_extractor="b", fallback_used=True, fallback_reason="r") if k % 2 else info
        made.append((k, info.space_id, info.cache_key))
    return spark.createDataFrame(made, "k int, space_id string, cache_key string")


def _page_images(spark, d) -> DataFrame:
    """Pages as images: a third has no path, a third no readable file."""
    path = F.when(F.col("page_id") % 3 != 0, F.concat(F.lit("/img/"), F.col("page_id").cast("string")))
    sides = [F.lit(640).alias("width"), F.lit(480).alias("height")]
    return table(spark, d, "pages").select(
        int_id(F.col("page_id")).alias("image_id"), F.col("page_id").alias("ordinal"), F.lit("f").alias("file_name"), path.alias("file_path"), *sides,
    )


@query
def dataset_fingerprint(spark, d):
    files = table(spark, d, "pages").filter("page_id % 3 = 1").select(
        F.concat(F.lit("/img/"), F.col("page_id").cast("string")).alias("file_path"),
        F.sha2(F.coalesce("html", F.lit("")).cast("binary"), 256).alias("content_hash"),
    )
    images = _page_images(spark, d)
    found = ft.dataset_fingerprint(Dataset("pages", "coco", "", images, images, images), files)
    return spark.createDataFrame([(found,)], "fingerprint string")


@query
def failures_in_order(spark, d):
    images = _page_images(spark, d)
    failures = images.filter("file_path is null").select("image_id", "file_path", F.lit("image_path_missing").alias("failure_code"), F.lit("x").alias("reason"))
    first = ft.ordered_failures(failures, images).limit(20)
    return first.select(num("image_id", "page_id"), "failure_code")


@query
def image_hash_failures(spark, d):
    """Perceptual hashes of small images by image: no path, no file, no decodable content, or a hash."""
    images = table(spark, d, "embeddings").select(
        int_id(F.col("vec_id")).alias("image_id"), F.when(F.col("vec_id") % 4 != 0, F.concat(F.lit("/i/"), F.col("vec_id").cast("string"))).alias("file_path"),
        "vec_id",
    )
    tones = F.hex(F.lpad(F.lit("a"), 48, "bcd"))
    size = F.when(F.col("vec_id") % 4 == 2, -1).otherwise(4)
    pixels = images.filter("vec_id % 4 > 1").select("file_path", size.alias("height"), size.alias("width"), F.lit(3).alias("channels"), F.unhex(tones).alias("data"))
    found = nd.detect_image_duplicates(images.select("image_id", "file_path").filter("image_id.id < '2'"), pixels, 0)
    return found.failures.select(num("image_id"), "failure_code").unionAll(found.hashes.select(num("image_id"), F.lit("hashed").alias("failure_code")))


@query
def dummy_embeddings(spark, d):
    """Mean-colour embeddings of small one-colour images, one a label of the embeddings table."""
    rows = table(spark, d, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    tone = F.unhex(F.lpad(F.hex((F.col("label") * 20 + 15).cast("long")), 2, "0"))
    data = F.array_join(F.array_repeat(F.hex(tone), 12), "")
    images = rows.select(
        int_id(F.col("label")).alias("image_id"), F.lit("x").alias("file_path"), F.lit(2).alias("height"), F.lit(2).alias("width"), F.lit(3).alias("channels"),
        F.unhex(data).alias("data"),
    )
    found, _ = ft.extract(images, ft.dummy_extractor(6), 6)
    return found.select(num("image_id", "label"), F.size("vector").alias("dim"), r6(vf.norm(F.col("vector")), "norm"))
