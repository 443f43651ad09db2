import math

import pytest
from pyspark.sql import functions as F

from provena.errors import DetectorError
from provena.functions.ids import ID_TYPE
from provena.operators import near_duplicates as nd
from provena.operators import neighbours as nb
from provena.operators.components import connected_components


def ident(i):
    return ("int", str(i)) if isinstance(i, int) else ("str", i)


def features(spark, rows):
    return spark.createDataFrame([(ident(i), [float(x) for x in v]) for i, v in rows], f"image_id {ID_TYPE}, vector array<float>")


def labels(spark, rows):
    return spark.createDataFrame([(ident(i), None if s is None else list(s)) for i, s in rows], f"image_id {ID_TYPE}, labels array<bigint>")


def pair_ids(df):
    return sorted((r.image_a.id, r.image_b.id) for r in df.collect())


@pytest.mark.parametrize("rows, threshold, want", [([(0, (1, 0)), (1, (1, 0))], 0.95, 1), ([(0, (1, 0)), (1, (0, 1))], 0.95, 0), ([(0, (1, 0)), (1, (0.8, 0.6))], 0.7, 1), ([(0, (0, 0)), (1, (1, 0))], 0.95, 0)])
def test_pairs(spark, rows, threshold, want):
    x = features(spark, rows)
    assert nd.cosine_pairs(x, threshold).count() == want
    assert nd.cosine_pairs_sql(x, threshold).count() == want


def test_pairs_order_and_clusters(spark):
    angles = {"a": 0, "b": 20, "c": 40, "x": 180, "y": 100, "z": 120}
    rows = [(k, (math.cos(math.radians(t)), math.sin(math.radians(t)))) for k, t in angles.items()]
    for r in (rows, rows[::-1]):
        got = nd.detect_near_duplicates(features(spark, r), 0.9)
        assert pair_ids(got.pairs) == [("a", "b"), ("b", "c"), ("y", "z")]
        clusters = sorted((r.cluster_id, r.image_id.id) for r in got.clusters.collect())
        assert clusters == [(1, "a"), (1, "b"), (1, "c"), (2, "y"), (2, "z")]


def test_thresholds_are_checked(spark):
    for bad in (1.1, True, -2):
        with pytest.raises(DetectorError):
            nd.check_cosine_threshold(bad)
    for bad in (-1, 65, 1.5, True):
        with pytest.raises(DetectorError):
            nd.check_hamming_threshold(bad)


def test_empty_and_single(spark):
    assert nd.detect_near_duplicates(features(spark, []), 0.9).summary.first().pair_count == 0
    assert nd.detect_near_duplicates(features(spark, [(1, (1, 0))]), 0.9).clusters.count() == 0


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (None, 3)], "a bigint, b bigint")
    got = {r.node: r.label for r in connected_components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


@pytest.mark.parametrize("threshold", [0, 3, 64])
def test_hash_pairs_equal_theta_join(spark, threshold):
    values = [0, 1, 3, -1, -2, 1 << 40, 0, 7, -(1 << 63)]
    rows = spark.createDataFrame([(ident(i), v) for i, v in enumerate(values)], f"image_id {ID_TYPE}, hash bigint")
    one, other = nd.hash_pairs(rows, threshold), nd.hash_pairs_sql(rows, threshold)
    key = lambda df: sorted((r.image_a.id, r.image_b.id, r.distance) for r in df.collect())
    assert key(one) == key(other)


def test_label_disagreement(spark):
    vectors = [(1, (1, 0)), (2, (0.985, -0.174)), (3, (0.94, 0.342)), (4, (0.946, 0.326)), (5, (0.94, 0.342)), (6, (0, 1))]
    sets = labels(spark, [(1, [11]), (2, [11]), (3, [11]), (4, [29]), (5, [29]), (6, [29])])
    got = nb.detect_label_disagreement(sets, features(spark, vectors), 3, 0.6)
    row = got.findings.filter("image_id.id = '3'").first()
    assert (row.state, row.competing_label, round(row.score, 4)) == ("review", 29, 0.6667)
    assert nb.detect_label_disagreement(sets, features(spark, vectors), 3, 0.9).findings.filter("image_id.id = '3'").first().state == "not_flagged"


def test_label_ties_go_by_id_text(spark):
    x = features(spark, [(20, (1, 0)), (3, (1, 0)), (10, (1, 0))])
    near = nb.nearest_others(x, None, 2).filter("image_id.id = '20'").orderBy("rank").collect()
    assert [r.neighbour_id.id for r in near] == ["10", "3"]


def test_single_label_has_no_support(spark):
    got = nb.detect_label_disagreement(labels(spark, [(1, [5])]), features(spark, [(1, (1, 0))]))
    row = got.findings.first()
    assert (row.state, row.score) == ("insufficient_class_support", 0.0)
    with pytest.raises(DetectorError):
        nb.detect_label_disagreement(labels(spark, [(2, [5])]), features(spark, [(1, (1, 0))]))


@pytest.mark.parametrize(
    "reference, query, threshold, state, nearest",
    [
        ([(1, (1, 0))], (100, (1, 0)), 0.8, "in_distribution", "1"),
        ([(1, (1, 0)), (2, (0.9, 0.1))], (50, (-1, 0)), 0.8, "distribution_shift_candidate", "2"),
        ([(9, (1, 0)), (2, (1, 0))], (7, (1, 0)), 0.8, "in_distribution", "2"),
        ([(1, (1, 0)), (2, (-1, 0))], (1, (1, 0)), 0.8, "distribution_shift_candidate", "2"),
        ([(1, (0, 0))], (2, (0, 0)), 0.8, "distribution_shift_candidate", "1"),
    ],
)
def test_shift(spark, reference, query, threshold, state, nearest):
    row = nb.detect_shift(features(spark, reference), features(spark, [query]), threshold).findings.first()
    assert (row.state, row.nearest_id.id) == (state, nearest)


def test_shift_unscored(spark):
    one = features(spark, [(1, (1, 0))])
    assert nb.detect_shift(one, one).unscored.first().reason == "no_comparable_reference"
    assert nb.detect_shift(features(spark, []), one).unscored.first().reason == "empty_reference_set"
    failed = spark.createDataFrame([(ident(2), "image_unreadable")], f"image_id {ID_TYPE}, failure_code string")
    got = nb.detect_shift(one, features(spark, []), failures=failed)
    assert (got.summary.first().total_count, got.unscored.first().reason) == (1, "image_unreadable")


def test_silhouette(spark):
    sets = labels(spark, [(0, [1]), (1, [1]), (2, [2]), (3, [2])])
    good = nb.analyze_silhouette(sets, features(spark, [(0, (1, 0)), (1, (0.99, 0.1)), (2, (0, 1)), (3, (0.1, 0.99))]))
    assert good.findings.filter("silhouette > 0.9").count() == 4
    mixed = nb.analyze_silhouette(sets, features(spark, [(0, (1, 0)), (1, (0.99, 0.1)), (2, (1, 0)), (3, (0.99, 0.1))]))
    assert mixed.findings.filter("silhouette < 0.1").count() == 4
    assert nb.analyze_silhouette(sets, features(spark, [(0, (1, 0)), (1, (0, 1)), (2, (1, 0)), (3, (1, 1))]), 3).findings.count() == 0


def test_silhouette_reasons(spark):
    sets = labels(spark, [(0, [1]), (1, [1]), (2, [1]), (3, None), (4, [1]), (5, [1]), (6, [2])])
    x = features(spark, [(0, (0, 0)), (1, (float("nan"), 0)), (2, (1, 0, 0)), (3, (1, 0)), (5, (1, 0)), (6, (0, 1))])
    got = {r.image_id.id: r.reason for r in nb.analyze_silhouette(sets, x, dim=2).unscorable.collect()}
    assert got == {"0": "zero_vector", "1": "invalid_vector", "2": "dimension_mismatch", "3": "missing_label", "4": "missing_embedding", "5": "class_too_small", "6": "class_too_small"}
    alone = nb.analyze_silhouette(labels(spark, [(0, [1]), (1, [1])]), features(spark, [(0, (1, 0)), (1, (0, 1))]))
    assert {r.reason for r in alone.unscorable.collect()} == {"no_competing_class"}
    assert alone.summary.first().mean_silhouette is None


def test_multi_label_class_is_the_whole_set(spark):
    sets = labels(spark, [(0, [1, 2]), (1, [1, 2]), (2, [1]), (3, [1])])
    got = nb.analyze_silhouette(sets, features(spark, [(0, (1, 0)), (1, (1, 0.1)), (2, (0, 1)), (3, (0.1, 1))]))
    assert got.classes.filter(F.size("labels") == 2).first().image_count == 2
