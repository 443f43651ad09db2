"""SQL forms of the catalogue's queries for an independent engine, composed from named common table expressions."""

from __future__ import annotations

PAIR, SHIFT, HASH = 0.40, 0.35, 18

CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "e": ((), "SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings"),
    "p": (("e",), f"SELECT a.vec_id AS a, b.vec_id AS b, list_cosine_similarity(a.v, b.v) AS s FROM e a JOIN e b ON a.vec_id::VARCHAR < b.vec_id::VARCHAR WHERE list_cosine_similarity(a.v, b.v) >= {PAIR}"),
    "u": (("p",), "SELECT a, b FROM p UNION ALL SELECT b, a FROM p"),
    "r": (("u",), "SELECT a AS n, a AS m FROM u UNION SELECT r.n, u.b FROM r JOIN u ON r.m = u.a"),
    "c": (("r",), "SELECT dense_rank() OVER (ORDER BY root) AS cluster_id, n FROM (SELECT n, min(m::VARCHAR) AS root FROM r GROUP BY n)"),
    "nn": (("e",), "SELECT * FROM (SELECT a.vec_id AS q, b.vec_id AS n, a.label AS la, b.label AS lb, list_cosine_similarity(a.v, b.v) AS s, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_similarity(a.v, b.v) DESC, b.vec_id::VARCHAR) AS rk FROM e a JOIN e b ON a.vec_id <> b.vec_id) WHERE rk <= 5"),
    "lf": (("nn",), """SELECT q, la, sum((la = lb)::INT)::BIGINT AS same_count, sum((la <> lb)::INT)::BIGINT AS different_count, avg(CASE WHEN la = lb THEN s END) AS same_similarity, sum((la <> lb)::INT)::DOUBLE / count(*) AS score FROM nn GROUP BY q, la"""),
    "ls": (("lf",), "SELECT *, CASE WHEN same_count < 1 THEN 'insufficient_class_support' WHEN score >= 0.8 THEN 'review' ELSE 'not_flagged' END AS state, CASE WHEN same_count < 1 THEN 'REVIEW_CONTEXT' WHEN score >= 0.8 THEN 'REVIEW' ELSE 'NO_AUTOMATIC_ACTION' END AS recommendation FROM lf"),
    "ml": (("e",), "SELECT vec_id, v, CASE WHEN vec_id % 5 = 0 THEN list_sort([label, (label + 1) % 10]) ELSE [label] END AS ls FROM e"),
    "mn": (("ml",), "SELECT * FROM (SELECT a.vec_id AS q, a.ls AS la, b.ls AS lb, list_cosine_similarity(a.v, b.v) AS s, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_similarity(a.v, b.v) DESC, b.vec_id::VARCHAR) AS rk FROM ml a JOIN ml b ON a.vec_id <> b.vec_id) WHERE rk <= 5"),
    "sh": (("e",), f"SELECT q, n, s, CASE WHEN s < {SHIFT} THEN 'distribution_shift_candidate' ELSE 'in_distribution' END AS state, greatest(0.0, {SHIFT} - s) AS score FROM (SELECT a.vec_id AS q, b.vec_id AS n, list_cosine_similarity(a.v, b.v) AS s, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_similarity(a.v, b.v) DESC, b.vec_id::VARCHAR) AS rk FROM e a JOIN e b ON a.vec_id % 2 = 1 AND b.vec_id % 2 = 0) WHERE rk = 1"),
    "sm": (("e",), "SELECT a.vec_id AS q, a.label AS la, b.label AS lb, avg(1 - list_cosine_similarity(a.v, b.v)) AS d FROM e a JOIN e b ON a.vec_id <> b.vec_id GROUP BY ALL"),
    "sf": (("sm",), "SELECT q, la, a, b, nearest, CASE WHEN greatest(a, b) = 0 THEN 0.0 ELSE (b - a) / greatest(a, b) END AS s FROM (SELECT q, la, max(CASE WHEN la = lb THEN d END) AS a, min(CASE WHEN la <> lb THEN d END) AS b, arg_min(CASE WHEN la <> lb THEN lb END, CASE WHEN la <> lb THEN d END) AS nearest FROM sm GROUP BY q, la)"),
    "mm": (("ml",), "SELECT a.vec_id AS q, a.ls AS la, b.ls AS lb, avg(1 - list_cosine_similarity(a.v, b.v)) AS d FROM ml a JOIN ml b ON a.vec_id <> b.vec_id GROUP BY ALL"),
    "mc": (("ml",), "SELECT ls, count(*) AS k FROM ml GROUP BY ls"),
    "hb": (("e",), "SELECT vec_id, list_reduce(list_transform(v, lambda x: CASE WHEN x >= m THEN 1::UBIGINT ELSE 0::UBIGINT END), lambda a, b: a * 2 + b) AS h FROM (SELECT vec_id, v, list_sort(v[2:64])[32] AS m FROM e)"),
    "hp": (("hb",), f"SELECT a.vec_id AS a, b.vec_id AS b, bit_count(xor(a.h, b.h))::INTEGER AS d FROM hb a JOIN hb b ON a.vec_id::VARCHAR < b.vec_id::VARCHAR WHERE bit_count(xor(a.h, b.h)) <= {HASH}"),
    "hu": (("hp",), "SELECT a, b FROM hp UNION ALL SELECT b, a FROM hp"),
    "hr": (("hu",), "SELECT a AS n, a AS m FROM hu UNION SELECT hr.n, hu.b FROM hr JOIN hu ON hr.m = hu.a"),
    "pv": ((), "SELECT e.vec_id, 'team-' || (e.vec_id % 7) AS team, d.source AS source, d.lang AS batch FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id JOIN labels l ON l.doc_id = e.vec_id"),
    "ev": (("p", "ls", "sh"), "SELECT 'near_duplicate' AS category, a || ',' || b AS ids, a AS i, b AS j, s AS score FROM p UNION ALL SELECT 'label_disagreement', q::VARCHAR, q, q, score FROM ls WHERE state = 'review' UNION ALL SELECT 'distribution_shift', q::VARCHAR, q, q, score FROM sh WHERE state = 'distribution_shift_candidate'"),
    "ends": (("ev",), "SELECT category, ids, i AS img FROM ev UNION SELECT category, ids, j FROM ev"),
    "mem": (("pv",), "SELECT 'contributor' AS group_type, 'contributor_id=str:' || team AS group_id, vec_id FROM pv UNION ALL SELECT 'source', 'source_id=str:' || source, vec_id FROM pv UNION ALL SELECT 'batch', 'batch_id=str:' || batch, vec_id FROM pv UNION ALL SELECT 'combined', 'provenance={\"batch_id\":\"' || batch || '\",\"contributor_id\":\"' || team || '\",\"source_id\":\"' || source || '\"}', vec_id FROM pv"),
    "hit": (("ends", "mem"), "SELECT DISTINCT group_type, group_id, category, ids FROM ends JOIN mem ON img = vec_id"),
    "gr": (("hit", "mem", "ends"), """SELECT s.group_type, s.group_id, s.image_count, coalesce(nd, 0) AS near_duplicate_count, coalesce(ld, 0) AS label_disagreement_count, coalesce(ds, 0) AS distribution_shift_count,
        coalesce(f, 0) AS finding_count, coalesce(af, 0) AS affected_images, (coalesce(nd, 0) * 1.0 + coalesce(ld, 0) * 1.5 + coalesce(ds, 0) * 0.5)::DOUBLE AS score, CASE WHEN coalesce(f, 0) = 0 THEN 'ACCEPT' ELSE 'REVIEW' END AS recommendation
        FROM (SELECT group_type, group_id, count(DISTINCT vec_id) AS image_count FROM mem GROUP BY ALL) s
        LEFT JOIN (SELECT group_type, group_id, count(*) FILTER (category = 'near_duplicate') AS nd, count(*) FILTER (category = 'label_disagreement') AS ld, count(*) FILTER (category = 'distribution_shift') AS ds, count(*) AS f FROM hit GROUP BY ALL) h USING (group_type, group_id)
        LEFT JOIN (SELECT group_type, group_id, count(DISTINCT img) AS af FROM ends JOIN mem ON img = vec_id GROUP BY ALL) a USING (group_type, group_id)"""),
    "out_": (("pv",), "SELECT vec_id FROM embeddings WHERE vec_id NOT IN (SELECT vec_id FROM pv)"),
    "fu": (("p", "ls", "sh", "gr", "hp", "sf"), """SELECT '1C:["int",' || a || ']:["int",' || b || ']' AS finding_id, '1C' AS layer, a AS vec_id, 'warning' AS severity, s AS score, 'REVIEW' AS recommendation FROM p
        UNION ALL SELECT '1D:["int",' || q || ']', '1D', q, CASE WHEN state = 'review' THEN 'warning' ELSE 'info' END, score, recommendation FROM ls
        UNION ALL SELECT '1E:["int",' || q || ']', '1E', q, CASE WHEN state = 'in_distribution' THEN 'info' ELSE 'warning' END, score, CASE WHEN state = 'in_distribution' THEN 'NO_AUTOMATIC_ACTION' ELSE 'REVIEW' END FROM sh
        UNION ALL SELECT '1F:' || group_type || ':' || group_id, '1F', NULL, CASE WHEN finding_count > 0 THEN 'warning' ELSE 'info' END, score, recommendation FROM gr
        UNION ALL SELECT '1G:["int",' || a || ']:["int",' || b || ']', '1G', a, 'warning', d::DOUBLE, 'REVIEW' FROM hp
        UNION ALL SELECT '1H:["int",' || q || ']', '1H', q, CASE WHEN s > 0 THEN 'info' ELSE 'warning' END, s, CASE WHEN s > 0 THEN 'NO AUTOMATIC ACTION' ELSE 'REVIEW' END FROM sf"""),
    "box": ((), "SELECT DISTINCT l_orderkey AS img, l_linenumber AS category_id, (l_quantity * 12)::DOUBLE AS x, (l_discount * 3000)::DOUBLE AS y, (l_tax * 1000 + 5)::DOUBLE AS w, (l_quantity * 3 + 10)::DOUBLE AS h FROM lineitem"),
    "yl": (("box",), "SELECT img, category_id, (x + w / 2) / 640 AS cx, (y + h / 2) / 480 AS cy, w / 640 AS nw, h / 480 AS nh FROM box"),
    "au": ((), "SELECT event_id AS position, user_id AS finding_id, event_type AS kind, CASE event_type WHEN 'click' THEN 'ACCEPT' WHEN 'view' THEN 'REVIEW' WHEN 'purchase' THEN 'QUARANTINE' END AS decision FROM events"),
}


#: expressions that refer to themselves; all others are worked out once
RECURSIVE = {"r", "hr"}


def _with(names: tuple[str, ...]) -> str:
    order: list[str] = []

    def add(n: str) -> None:
        if n not in order:
            for d in CTES[n][0]:
                add(d)
            order.append(n)

    for n in names:
        add(n)
    return "WITH RECURSIVE " + ", ".join(f"{n} AS {'' if n in RECURSIVE else 'MATERIALIZED '}({CTES[n][1]})" for n in order)


def q(select: str, *names: str) -> str:
    return (_with(names) + " " if names else "") + select


ORACLE_SQL: dict[str, str] = {
    "vector_norms": q("SELECT vec_id, round(sqrt(list_dot_product(v, v)), 6) AS norm, round(v[1] / sqrt(list_dot_product(v, v)), 6) AS first_unit FROM e", "e"),
    "nd_pairs": q("SELECT a AS id_a, b AS id_b, round(s, 6) AS similarity FROM p", "p"),
    "nd_clusters": q("SELECT cluster_id, n AS vec_id FROM c", "c"),
    "nd_pair_order": q("SELECT row_number() OVER (ORDER BY a::VARCHAR, b::VARCHAR) AS position, a AS id_a, b AS id_b FROM p", "p"),
    "nd_summary": q("SELECT (SELECT count(*) FROM e) AS image_count, (SELECT count(*) FROM p) AS pair_count, count(DISTINCT cluster_id) AS cluster_count, count(*) AS clustered_images FROM c", "c", "p", "e"),
    "nd_cluster_sizes": q("SELECT cluster_id, count(DISTINCT n) AS members, (SELECT count(*) FROM p JOIN c d ON p.a = d.n WHERE d.cluster_id = c.cluster_id) AS pairs FROM c GROUP BY cluster_id", "c", "p"),
    "label_topk": q("SELECT q AS vec_id, n AS neighbour_id, rk::INTEGER AS rank, round(s, 6) AS similarity, la = lb AS same FROM nn", "nn"),
    "label_findings": q("SELECT q AS vec_id, same_count, different_count, round(score, 6) AS score, state, recommendation FROM ls", "ls"),
    "label_distribution": q("SELECT q AS vec_id, lb::BIGINT AS category_id, count(*) AS count, row_number() OVER (PARTITION BY q ORDER BY count(*) DESC, lb::VARCHAR)::INTEGER AS position FROM nn GROUP BY q, lb", "nn"),
    "label_same_similarity": q("SELECT q AS vec_id, round(same_similarity, 6) AS same_similarity FROM lf", "lf"),
    "label_competitor": q("SELECT vec_id, competing_label, rival_count, round(rs, 6) AS rival_similarity FROM (SELECT q AS vec_id, lb::BIGINT AS competing_label, count(*) AS rival_count, avg(s) AS rs, row_number() OVER (PARTITION BY q ORDER BY count(*) DESC, avg(s) DESC, lb::VARCHAR) AS k FROM nn WHERE la <> lb GROUP BY q, lb) WHERE k = 1", "nn"),
    "label_summary": q("SELECT count(*) AS scored_images, count(*) FILTER (state = 'review') AS suspicious_count, count(*) FILTER (state = 'insufficient_class_support') AS unsupported_count FROM ls", "ls"),
    "label_multilabel": q("SELECT q AS vec_id, array_to_string(la, ',') AS labels, sum(list_has_any(la, lb)::INT)::BIGINT AS same_count, sum((NOT list_has_any(la, lb))::INT)::BIGINT AS different_count FROM mn GROUP BY q, la", "mn"),
    "label_sets": "SELECT l_orderkey AS order_id, array_to_string(list_sort(list_distinct(list(l_linenumber))), ',') AS labels FROM lineitem GROUP BY l_orderkey",
    "label_exclusions": "SELECT o_orderkey AS order_id, CASE WHEN n IS NULL THEN 'missing_annotation' ELSE 'missing_category' END AS reason FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, count(CASE WHEN l_linenumber > 1 THEN 1 END) AS k FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey WHERE n IS NULL OR k = 0",
    "ood_findings": q("SELECT q AS vec_id, n AS nearest_id, round(s, 6) AS similarity, round(score, 6) AS score, state FROM sh", "sh"),
    "ood_self_excluded": q("SELECT q AS vec_id, n AS nearest_id, round(s, 6) AS similarity FROM (SELECT a.vec_id AS q, b.vec_id AS n, list_cosine_similarity(a.v, b.v) AS s, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_similarity(a.v, b.v) DESC, b.vec_id::VARCHAR) AS rk FROM e a JOIN e b ON b.vec_id % 2 = 0 AND a.vec_id <> b.vec_id) WHERE rk = 1", "e"),
    "ood_unscored": "SELECT vec_id, 'no_comparable_reference' AS reason FROM embeddings WHERE vec_id = 0",
    "ood_empty_reference": "SELECT vec_id, 'empty_reference_set' AS reason FROM embeddings",
    "ood_summary": q("SELECT count(*) AS scored_count, count(*) FILTER (state = 'distribution_shift_candidate') AS anomalous_count, 0::BIGINT AS unscored_count, count(*) AS total_count FROM sh", "sh"),
    "silhouette_findings": q("SELECT q AS vec_id, la::BIGINT AS label, round(a, 6) AS intra_distance, round(b, 6) AS nearest_distance, nearest::BIGINT AS nearest_label, round(s, 6) AS silhouette, s > 0 AS well_separated FROM sf", "sf"),
    "silhouette_class_summary": q("SELECT la::BIGINT AS label, count(*) AS image_count, round(avg(s), 6) AS mean_silhouette FROM sf GROUP BY la", "sf"),
    "silhouette_class_order": q("SELECT row_number() OVER (ORDER BY la) AS position, la::BIGINT AS label FROM (SELECT DISTINCT la FROM sf)", "sf"),
    "silhouette_dataset_stats": q("SELECT count(*) AS scored_images, round(avg(s), 6) AS mean_silhouette, round(median(s), 6) AS median_silhouette, round(min(s), 6) AS min_silhouette, round(max(s), 6) AS max_silhouette FROM sf", "sf"),
    "silhouette_unscorable": "SELECT vec_id, 'class_too_small' AS reason FROM embeddings JOIN (SELECT label, count(*) AS k FROM embeddings GROUP BY label) USING (label) WHERE k < 50",
    "silhouette_multilabel": q("SELECT q AS vec_id, array_to_string(la, ',') AS labels, round((b - a) / greatest(a, b), 6) AS silhouette FROM (SELECT q, la, max(CASE WHEN la = lb THEN d END) AS a, min(CASE WHEN la <> lb THEN d END) AS b FROM mm JOIN mc ON mc.ls = la WHERE k >= 2 GROUP BY q, la)", "mm", "mc"),
    "hash64": q("SELECT vec_id, printf('%016x', h) AS hash FROM hb", "hb"),
    "hash_pairs": q("SELECT a AS id_a, b AS id_b, d AS distance FROM hp", "hp"),
    "hash_clusters": q("SELECT dense_rank() OVER (ORDER BY root) AS cluster_id, n AS vec_id FROM (SELECT n, min(m::VARCHAR) AS root FROM hr GROUP BY n)", "hr"),
    "provenance_resolved": q("SELECT vec_id, team AS contributor, source, batch FROM pv", "pv"),
    "provenance_conflicts": "SELECT d.doc_id AS vec_id, 'batch_id' AS field, 2::INTEGER AS value_count FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE d.lang <> CASE WHEN l.toxic = 1 THEN 'xx' ELSE d.lang END",
    "evidence": q("SELECT category, ids AS image_ids, round(score, 6) AS score FROM ev", "ev"),
    "evidence_conflicts": q("SELECT a || ',' || b AS image_ids, 2::INTEGER AS variant_count FROM p WHERE s >= 0.42", "p"),
    "risk_groups": q("SELECT group_type, group_id, image_count, near_duplicate_count, label_disagreement_count, distribution_shift_count, finding_count, affected_images, round(score, 6) AS score, recommendation FROM gr WHERE group_type <> 'combined'", "gr"),
    "risk_groups_combined": q("SELECT group_id, image_count, finding_count, affected_images, round(score, 6) AS score, recommendation FROM gr WHERE group_type = 'combined'", "gr"),
    "risk_reasons": q("SELECT row_number() OVER (ORDER BY CASE group_type WHEN 'contributor' THEN 0 WHEN 'source' THEN 1 WHEN 'batch' THEN 2 ELSE 3 END, CASE group_type WHEN 'combined' THEN '(''' || json_extract_string(j, 'contributor_id') || ''', ''' || json_extract_string(j, 'source_id') || ''', ''' || json_extract_string(j, 'batch_id') || ''')' ELSE '''' || split_part(group_id, ':', 2) || '''' END) AS position, group_type, group_id, 'Observed ' || finding_count || ' distinct detector findings affecting ' || affected_images || ' of ' || image_count || ' images (' || CASE WHEN finding_count = 0 THEN 'No detector findings affected this group.' ELSE concat_ws('; ', CASE WHEN near_duplicate_count > 0 THEN 'Layer 1C near-duplicate: ' || near_duplicate_count END, CASE WHEN label_disagreement_count > 0 THEN 'Layer 1D label-manipulation: ' || label_disagreement_count END, CASE WHEN distribution_shift_count > 0 THEN 'Layer 1E distribution-shift: ' || distribution_shift_count END) END || '); weighted evidence score ' || printf('%.3f', score) || '. Recommendation: ' || recommendation || '.' AS reason FROM (SELECT *, CASE WHEN group_type = 'combined' THEN substr(group_id, 12)::JSON END AS j FROM gr)", "gr"),
    "evidence_texts": q(f"""SELECT 'near_duplicate' AS category, '[["int","' || a || '"],["int","' || b || '"]]' AS evidence_id, 'Near-duplicate pair ' || a || ' ↔ ' || b || '; cosine similarity ' || printf('%.6f', s) || ' met configured threshold {PAIR:.6f}.' AS summary FROM p
        UNION ALL SELECT 'label_disagreement', '[["int","' || ls.q || '"]]', 'Label-neighborhood review for image ' || ls.q || ': assigned [' || la || '], strongest competing label [' || coalesce(c::VARCHAR, 'unavailable') || '], score ' || printf('%.6f', score) || ' at threshold 0.800000.' FROM ls LEFT JOIN (SELECT q, lb AS c FROM (SELECT q, lb, row_number() OVER (PARTITION BY q ORDER BY count(*) DESC, avg(s) DESC, lb::VARCHAR) AS k FROM nn WHERE la <> lb GROUP BY q, lb) WHERE k = 1) r ON r.q = ls.q WHERE state = 'review'
        UNION ALL SELECT 'distribution_shift', '[["int","' || q || '"]]', 'Distribution-shift candidate image ' || q || ': nearest-reference cosine similarity ' || printf('%.6f', s) || ', configured threshold {SHIFT:.6f}, score ' || printf('%.6f', score) || '.' FROM sh WHERE state = 'distribution_shift_candidate'""", "p", "ls", "nn", "sh"),
    "source_metadata": "SELECT vec_id, CASE vec_id % 3 WHEN 0 THEN 'c' || (vec_id % 4) WHEN 1 THEN 'd' || (vec_id % 4) ELSE 'team' END AS contributor, 'lab' AS source, '7' AS batch FROM embeddings",
    "metadata_conflicts": "SELECT vec_id, CASE WHEN vec_id % 3 <> 1 THEN 'team' END AS contributor, CASE WHEN vec_id % 3 = 1 THEN 2 ELSE 1 END::INTEGER AS values FROM embeddings",
    "risk_unattributed": q("SELECT (SELECT count(*) FROM out_) AS image_count, count(DISTINCT img) AS affected_images, count(DISTINCT category || ids) AS finding_count, count(DISTINCT ids) FILTER (category = 'near_duplicate') AS near_duplicate_count FROM ends JOIN out_ ON img = vec_id", "ends", "out_"),
    "risk_summary": q("SELECT count(*) AS group_count, count(*) FILTER (recommendation = 'REVIEW') AS review_count, (SELECT count(*) FROM out_) AS unattributed_images, false AS attribution_complete, 'attribution partial' AS status FROM gr", "gr", "out_"),
    "findings_unified": q("SELECT finding_id, layer, vec_id, severity, round(score, 6) AS score, recommendation FROM fu", "fu"),
    "finding_metrics": q("SELECT count(*) AS findings, count(*) FILTER (recommendation = 'REVIEW') AS review, count(*) FILTER (recommendation = 'QUARANTINE') AS quarantine, (SELECT count(*) FROM embeddings) AS assets FROM fu", "fu"),
    "asset_findings": q("SELECT finding_id, CASE WHEN vec_id IS NOT NULL THEN 'images/' || vec_id || '.png' END AS file_path FROM fu", "fu"),
    "finding_report": q("""SELECT row_number() OVER (ORDER BY layer, id) AS position, '[' || layer || '] ' || title || ' · ' || id AS label FROM (SELECT '1D' AS layer, 'Label-neighborhood consistency finding' AS title, '1D:["int",' || q || ']' AS id FROM ls UNION ALL SELECT '1E', 'Distribution-shift candidate', '1E:["int",' || q || ']' FROM sh)""", "ls", "sh"),
    "first_findings": """SELECT '1D:["int",' || vec_id || ']' AS finding_id, '[1D] Label-neighborhood consistency finding · 1D:["int",' || vec_id || ']' AS label FROM embeddings ORDER BY finding_id LIMIT 4""",
    "finding_contract": """SELECT '1D:["int",' || vec_id || ']' AS finding_id FROM embeddings WHERE vec_id % 3 = 0 OR vec_id % 5 = 0""",
    "decisions_made": q("""SELECT 'd1:' || id AS decision_id, id AS finding_id, q AS vec_id, 'REVIEW' AS source_recommendation, 'QUARANTINE' AS analyst_decision, 'analyst' AS actor, 'layer1d,' || id AS refs, '1D' AS module FROM (SELECT q, '1D:["int",' || q || ']' AS id FROM ls WHERE state = 'review')""", "ls"),
    "decision_log": q("""SELECT 2 * n + k AS position, '{"actor":"analyst","analyst_decision":' || CASE k WHEN 1 THEN '"REVIEW"' ELSE 'null' END || ',"decision_id":' || e || ',"event_id":' || substr(e, 1, length(e) - 1) || CASE k WHEN 0 THEN ':reviewed"' ELSE ':decision"' END || ',"event_type":"' || CASE k WHEN 0 THEN 'finding_reviewed' ELSE 'governance_decision' END || '","evidence_references":["layer1d",' || i || '],"finding_id":' || i || ',"mode":"pipeline","module":"1D","rationale":"seen","run_id":"run-1","schema_version":1,"source_detector":"label_consistency","source_recommendation":"REVIEW","timestamp":"2024-01-01T00:00:00Z"}' AS value
        FROM (SELECT row_number() OVER (ORDER BY '1D:["int",' || q || ']') - 1 AS n, '"1D:[\\"int\\",' || q || ']"' AS i, '"d1:1D:[\\"int\\",' || q || ']"' AS e FROM ls WHERE state = 'review') CROSS JOIN (VALUES (0), (1)) t(k)""", "ls"),
    "latest_events": q("SELECT 2 * position + k AS position, finding_id, CASE k WHEN 0 THEN 'finding_reviewed' ELSE 'governance_decision' END AS event_type, CASE k WHEN 1 THEN decision END AS analyst_decision FROM au CROSS JOIN (VALUES (0), (1)) t(k) WHERE decision IS NOT NULL ORDER BY position DESC LIMIT 50", "au"),
    "cache_keys": """SELECT k::INTEGER AS k, s AS space_id, 'sha256:' || sha256('{"actual_extractor":"b","embedding_space_id":"' || s || '","fallback_used":' || CASE WHEN k % 2 = 1 THEN 'true' ELSE 'false' END || ',"input_fingerprint":"sha256:x","requested_extractor":"' || CASE WHEN k % 2 = 1 THEN 'a' ELSE 'b' END || '","schema_version":3}') AS cache_key
        FROM (SELECT k, 'sha256:' || sha256('{"embedding_dim":64,"model_id":"m' || k || '","normalization":{"n":2},"preprocessing":{"p":1},"weights_identity":"w"}') AS s FROM range(6) t(k))""",
    "dataset_fingerprint": """SELECT 'sha256:' || sha256('["{\\"format\\":\\"coco\\",\\"images\\":' || n || ',\\"name\\":\\"pages\\"}","' || h || '"]') AS fingerprint FROM (SELECT sum(n) AS n, sha256(string_agg(bin || '=' || h, chr(10) ORDER BY bin)) AS h FROM (SELECT k // 4096 AS bin, count(*) AS n, sha256(string_agg(k || '=' || h, chr(10) ORDER BY k)) AS h FROM (SELECT page_id AS k,
        sha256('{"file_name":"f","file_path":' || CASE WHEN page_id % 3 = 0 THEN 'null' ELSE '"/img/' || page_id || '"' END || ',"height":480,"image_id":["int",' || page_id || '],"width":640}' || CASE page_id % 3 WHEN 0 THEN '|no-path|' WHEN 1 THEN sha256(coalesce(html, '')) ELSE '|unreadable-or-missing|' END) AS h FROM pages) GROUP BY bin))""",
    "failures_in_order": "SELECT page_id, 'image_path_missing' AS failure_code FROM pages WHERE page_id % 3 = 0 ORDER BY page_id LIMIT 20",
    "image_hash_failures": "SELECT vec_id, CASE vec_id % 4 WHEN 0 THEN 'missing_path' WHEN 1 THEN 'missing_image' WHEN 2 THEN 'image_decode_error' ELSE 'hashed' END AS failure_code FROM embeddings WHERE vec_id::VARCHAR < '2'",
    "dummy_embeddings": "SELECT DISTINCT label::BIGINT AS label, 6::INTEGER AS dim, 1.0::DOUBLE AS norm FROM embeddings",
    "coco_annotations": q("SELECT img, category_id::BIGINT AS category_id, x AS xmin, y AS ymin, w AS width, h AS height, w * h AS area FROM box", "box"),
    "coco_bounds_warnings": q("SELECT img, count(*) FILTER (x < 0 OR y < 0 OR x + w > 640 OR y + h > 480) AS spilling, count(*) AS boxes FROM box GROUP BY img", "box"),
    "coco_fk_violations": q("SELECT 'image' AS lost, img, category_id::BIGINT AS category_id, x FROM box WHERE img NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 2 = 0) UNION ALL SELECT 'category', img, category_id::BIGINT, x FROM box WHERE category_id > 6", "box"),
    "yolo_parse": q("SELECT img, category_id::BIGINT AS class_id, round(cx, 6) AS cx, round(cy, 6) AS cy, round(nw, 6) AS nw, round(nh, 6) AS nh, (cx - nw / 2 < 0 OR cy - nh / 2 < 0 OR cx + nw / 2 > 1 OR cy + nh / 2 > 1) AS spills FROM (SELECT img, category_id, round(cx, 8) AS cx, round(cy, 8) AS cy, round(nw, 8) AS nw, round(nh, 8) AS nh FROM yl)", "yl"),
    "yolo_to_pixels": q("SELECT img, category_id::BIGINT AS category_id, round((cx - nw / 2) * 640, 6) AS xmin, round((cy - nh / 2) * 480, 6) AS ymin, round(nw * 640, 6) AS width, round(nh * 480, 6) AS height FROM yl", "yl"),
    "pixels_to_yolo": q("SELECT img, category_id::BIGINT AS category_id, round(cx, 6) AS cx, round(cy, 6) AS cy, round(nw, 6) AS nw, round(nh, 6) AS nh FROM yl", "yl"),
    "bbox_geometry": q("SELECT img, category_id::BIGINT AS category_id, round(x + w, 6) AS xmax, round(y + h, 6) AS ymax, round(x + w / 2, 6) AS center_x, round(y + h / 2, 6) AS center_y FROM box", "box"),
    "bbox_clamped": q("SELECT img, category_id::BIGINT AS category_id, round(x0, 6) AS x0, round(y0, 6) AS y0, round(greatest(0.0, x1 - x0), 6) AS cw, round(greatest(0.0, y1 - y0), 6) AS ch FROM (SELECT img, category_id, greatest(0.0, least(640.0, x)) AS x0, greatest(0.0, least(480.0, y)) AS y0, greatest(0.0, least(640.0, x + w)) AS x1, greatest(0.0, least(480.0, y + h)) AS y1 FROM box)", "box"),
    "bbox_scaled": q("SELECT img, category_id::BIGINT AS category_id, round(x * 0.5, 6) AS xmin, round(y * 2.0, 6) AS ymin, round(w * 0.5, 6) AS width, round(h * 2.0, 6) AS height FROM box", "box"),
    "yolo_orphans": "SELECT DISTINCT l_orderkey AS stem FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0)",
    "images_without_annotations": "SELECT o_orderkey AS img FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)",
    "dataset_counts": q("SELECT (SELECT count(*) FROM orders) AS image_count, (SELECT count(*) FROM box) AS annotation_count", "box"),
    "category_lookup": q("SELECT category_id::BIGINT AS category_id, CASE WHEN category_id > 2 THEN 'own-' || (img % 3) WHEN category_id = 1 THEN ' class-1 ' WHEN category_id = 2 THEN ' ' END AS category_name, count(*) AS boxes FROM box GROUP BY ALL", "box"),
    "category_names": q("SELECT category_id::BIGINT AS category_id, CASE WHEN category_id IN (1, 3) THEN 'class-' || category_id ELSE min(CASE WHEN category_id > 2 THEN 'own-' || (img % 3) END) END AS name FROM box GROUP BY category_id", "box"),
    "id_lookup_fallback": "SELECT vec_id, CASE WHEN vec_id % 2 = 0 THEN 0 ELSE 1 END AS match FROM embeddings",
    "embedding_space_ids": "SELECT label::BIGINT AS label, 'sha256:' || sha256('{\"embedding_dim\":64,\"model_id\":\"m' || label || '\",\"weights_identity\":\"w\"}') AS space_id FROM (SELECT DISTINCT label FROM embeddings)",
    "content_fingerprint": "SELECT 'sha' AS kind, sha256(string_agg(bin || '=' || h, chr(10) ORDER BY bin)) AS fingerprint FROM (SELECT bin, sha256(string_agg(k || '=' || h, chr(10) ORDER BY k)) AS h FROM (SELECT page_id::VARCHAR AS k, substr(md5(page_id::VARCHAR), 1, 2) AS bin, sha256(coalesce(html, '|unreadable-or-missing|')) AS h FROM pages) GROUP BY bin)",
    "feature_validation": q("SELECT count(*) AS row_count, count(*) FILTER (len(v) <> 64) AS wrong_dimension, count(*) FILTER (len(list_filter(v, lambda x: NOT isfinite(x))) > 0) AS not_finite, count(*) FILTER (list_dot_product(v, v) = 0) AS zero_vectors, (count(*) - count(DISTINCT vec_id))::BIGINT AS repeated_ids FROM e", "e"),
    "audit_events": q("SELECT 2 * position + k AS position, finding_id, CASE k WHEN 0 THEN 'finding_reviewed' ELSE 'governance_decision' END AS event_type, CASE k WHEN 1 THEN decision END AS analyst_decision FROM au CROSS JOIN (VALUES (0), (1)) t(k) WHERE decision IS NOT NULL", "au"),
    "latest_decision": q("SELECT finding_id, arg_max(decision, position) AS analyst_decision, 2 * max(position) + 1 AS position FROM au WHERE decision IS NOT NULL GROUP BY finding_id", "au"),
    "audit_validation": q("SELECT kind, count(*) AS invalid FROM au WHERE decision IS NULL GROUP BY kind", "au"),
    "audit_export_summary": q("SELECT (2 * count(*))::BIGINT AS event_count, count(*) AS decisions, count(DISTINCT finding_id) AS findings FROM au WHERE decision IS NOT NULL", "au"),
}
