"""Label neighbourhoods, reference shift and silhouettes over image embeddings, all exact."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provena.errors import DetectorError
from provena.functions.ids import ID_TYPE
from provena.functions.vectors import cosine_block, unit_rows
from provena.operators.inputs import as_features, check_features, same_space
from provena.operators.numbering import number_in_order
from provena.operators.tiles import block_count, run_tiles
from provena.runtime import materialize, parallelism
from provena.sources.features import FeatureBatch

NEIGHBOURS, DISAGREEMENT, MIN_SAME = 5, 0.8, 1
SHIFT_THRESHOLD = 0.80
MIN_CLASS = 2


def _id(t: str, i: str) -> Column:
    return F.struct(F.col(t).alias("id_type"), F.col(i).alias("id"))


def _best(frame: pd.DataFrame, s: np.ndarray, other: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best columns of each row of ``s`` with all ties of the k-th, minus infinite entries."""
    k = min(k, s.shape[1])
    if not k or not s.shape[0]:
        return pd.DataFrame()
    cut = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
    x, y = np.nonzero((s >= cut[:, None]) & np.isfinite(s))
    # ties beyond k are settled by id here, so that a block of equal vectors stays small
    order = np.lexsort((other["id"].to_numpy()[y], other["t"].to_numpy()[y], -s[x, y], x))
    x, y = x[order], y[order]
    nth = np.arange(len(x)) - np.searchsorted(x, x, "left")
    x, y = x[nth < k], y[nth < k]
    a, b = frame.iloc[x], other.iloc[y]
    ends = {"qt": a["t"].to_numpy(), "qi": a["id"].to_numpy(), "nt": b["t"].to_numpy(), "ni": b["id"].to_numpy()}
    return pd.DataFrame({**ends, "similarity": s[x, y]})


def _not_self(a: pd.DataFrame, b: pd.DataFrame, s: np.ndarray) -> np.ndarray:
    ka, kb = (a["t"] + "\x00" + a["id"]).to_numpy(), (b["t"] + "\x00" + b["id"]).to_numpy()
    return np.where(ka[:, None] == kb[None, :], -np.inf, s)


def nearest_others(queries: DataFrame, references: DataFrame | None, k: int) -> DataFrame:
    """``image_id, neighbour_id, similarity, rank``: each query's k most similar others, ties to the lesser id.

    ``references`` None: the queries themselves. An image is never its own neighbour.
    """
    spark = queries.sparkSession
    shape = check_features(queries, "queries")
    n = shape.blocks(spark)
    cols = [F.col("image_id.id_type").alias("t"), F.col("image_id.id").alias("id"), "vector"]
    schema = "qt string, qi string, nt string, ni string, similarity double"

    def both(a: pd.DataFrame, ma: np.ndarray, b: pd.DataFrame, mb: np.ndarray, same: bool) -> pd.DataFrame:
        s = _not_self(a, b, cosine_block(ma, mb))
        out = [_best(a, s, b, k)]
        if not same:
            out.append(_best(b, s.T, a, k))
        return pd.concat(out)

    def one_way(a: pd.DataFrame, ma: np.ndarray, b: pd.DataFrame, mb: np.ndarray, same: bool) -> pd.DataFrame:
        return _best(a, _not_self(a, b, cosine_block(ma, mb)), b, k)

    if references is None:
        found = run_tiles(queries.select(*cols), None, (n, n), both, schema, unit_rows)
    else:
        others = check_features(references, "references", dim=shape.dim if shape.rows else None)
        found = run_tiles(queries.select(*cols), references.select(*cols), (n, others.blocks(spark)), one_way, schema, unit_rows)
    named = found.select(_id("qt", "qi").alias("image_id"), _id("nt", "ni").alias("neighbour_id"), "similarity")
    rank = F.row_number().over(Window.partitionBy("image_id").orderBy(F.desc("similarity"), "neighbour_id"))
    return named.withColumn("rank", rank).filter(F.col("rank") <= k)


# --- label neighbourhoods -------------------------------------------------------------------------------------------


@dataclass
class LabelResult:
    neighbours: DataFrame  # image_id, neighbour_id, similarity, rank, same
    findings: DataFrame
    distribution: DataFrame  # image_id, category_id, count, position
    excluded: DataFrame
    summary: DataFrame


def label_sets(annotations: DataFrame) -> DataFrame:
    """``image_id, labels`` (sorted distinct integer categories; empty where none is usable) of annotated images."""
    return annotations.groupBy("image_id").agg(F.array_sort(F.collect_set("category_id")).alias("labels"))


def label_exclusions(images: DataFrame, labels: DataFrame) -> DataFrame:
    """``image_id, reason``: ``missing_annotation`` or ``missing_category``."""
    marked = images.select("image_id").join(labels, "image_id", "left")
    reason = F.when(F.col("labels").isNull(), "missing_annotation").when(F.size("labels") == 0, "missing_category")
    return marked.select("image_id", reason.alias("reason")).filter("reason is not null")


def detect_label_disagreement(
    labels: DataFrame, features: DataFrame | FeatureBatch, k: int = NEIGHBOURS, threshold: float = DISAGREEMENT, min_same: int = MIN_SAME,
    images: DataFrame | None = None,
) -> LabelResult:
    """Neighbours of labelled images among labelled images, with counts, competitor, score and state."""
    if isinstance(k, bool) or k < 1 or not 0 <= threshold <= 1 or min_same < 0:
        raise DetectorError("k >= 1, threshold in [0, 1] and min_same >= 0 are needed")
    features = as_features(features)
    usable = labels.filter(F.size("labels") > 0)
    if images is not None and features.join(images.select("image_id"), "image_id", "left_anti").limit(1).count():
        raise DetectorError("features of an image that is not in the dataset")
    if usable.join(features, "image_id", "left_anti").limit(1).count():
        raise DetectorError("a labelled image has no embedding")
    labelled = features.join(usable, "image_id", "left_semi").select("image_id", "vector")
    near = nearest_others(labelled, None, k)
    other = usable.select(F.col("image_id").alias("neighbour_id"), F.col("labels").alias("neighbour_labels"))
    near = near.join(usable, "image_id").join(other, "neighbour_id").withColumn("same", F.arrays_overlap("labels", "neighbour_labels"))
    near = materialize(near, "label-neighbours")
    per_label = near.select("image_id", "same", "similarity", "labels", F.explode("neighbour_labels").alias("category_id"))
    by_count = Window.partitionBy("image_id").orderBy(F.desc("count"), F.col("category_id").cast("string"))
    distribution = per_label.groupBy("image_id", "category_id").agg(F.count(F.lit(1)).alias("count")).withColumn("position", F.row_number().over(by_count))
    rivals = per_label.filter(~F.col("same") & ~F.array_contains("labels", F.col("category_id"))).groupBy("image_id", "category_id").agg(
        F.count(F.lit(1)).alias("rival_count"), F.avg("similarity").alias("rival_similarity"),
    )
    strongest = Window.partitionBy("image_id").orderBy(F.desc("rival_count"), F.desc("rival_similarity"), F.col("category_id").cast("string"))
    rival = rivals.withColumn("nth", F.row_number().over(strongest)).filter("nth = 1").select(
        "image_id", F.col("category_id").alias("competing_label"), "rival_count", "rival_similarity",
    )
    counts = near.groupBy("image_id").agg(
        F.count_if("same").alias("same_count"),
        F.count_if(~F.col("same")).alias("different_count"),
        F.avg(F.when(F.col("same"), F.col("similarity"))).alias("same_similarity"),
    )
    score = F.coalesce(F.try_divide(F.col("different_count"), F.col("same_count") + F.col("different_count")), F.lit(0.0))
    state = F.when(F.col("same_count") < min_same, "insufficient_class_support").when(score >= threshold, "review").otherwise("not_flagged")
    advice = F.when(F.col("same_count") < min_same, "REVIEW_CONTEXT").when(score >= threshold, "REVIEW").otherwise("NO_AUTOMATIC_ACTION")
    full = usable.join(counts, "image_id", "left").join(rival, "image_id", "left")
    full = full.withColumn("same_count", F.coalesce("same_count", F.lit(0))).withColumn("different_count", F.coalesce("different_count", F.lit(0)))
    findings = full.select(
        "image_id", "labels", "same_count", "different_count", "same_similarity", "competing_label", "rival_count", "rival_similarity", score.alias("score"),
        state.alias("state"), advice.alias("recommendation"),
    )
    findings = materialize(findings, "label-findings")
    excluded = label_exclusions(images if images is not None else labels, labels)
    summary = findings.agg(
        F.count(F.lit(1)).alias("scored_images"), F.count_if(F.col("state") == "review").alias("suspicious_count"),
        F.count_if(F.col("state") == "insufficient_class_support").alias("unsupported_count"),
    )
    return LabelResult(near, findings, distribution, excluded, summary)


def by_image(findings: DataFrame) -> DataFrame:
    """Findings, exclusions and unscored images by their ids."""
    return findings.orderBy("image_id")


def by_class(classes: DataFrame) -> DataFrame:
    """Class summaries by their category numbers."""
    return classes.orderBy("labels")


# --- reference shift ------------------------------------------------------------------------------------------------


@dataclass
class ShiftResult:
    findings: DataFrame
    unscored: DataFrame
    summary: DataFrame


def detect_shift(reference: DataFrame | FeatureBatch, query: DataFrame | FeatureBatch, threshold: float = SHIFT_THRESHOLD, failures: DataFrame | None = None) -> ShiftResult:
    """Nearest reference of each query; below the threshold (strictly) it is a shift candidate.

    ``failures``: ``image_id, failure_code`` of queries without features; they are unscored with their code.
    """
    if isinstance(threshold, bool) or not -1 <= threshold <= 1:
        raise DetectorError("threshold must lie in [-1, 1]")
    same_space(reference, query)
    if isinstance(query, FeatureBatch) and failures is None:
        failures = query.failures
    reference, query = as_features(reference), as_features(query)
    spark = query.sparkSession
    empty = not reference.limit(1).count()
    if empty:
        schema = f"image_id {ID_TYPE}, nearest_id {ID_TYPE}, similarity double, score double, state string, recommendation string"
        findings = spark.createDataFrame([], schema)
    else:
        near = nearest_others(query, reference, 1)
        low = F.col("similarity") < threshold
        findings = near.select(
            "image_id",
            F.col("neighbour_id").alias("nearest_id"),
            "similarity",
            F.greatest(F.lit(0.0), F.lit(float(threshold)) - F.col("similarity")).alias("score"),
            F.when(low, "distribution_shift_candidate").otherwise("in_distribution").alias("state"),
            F.when(low, "REVIEW").otherwise("NO_AUTOMATIC_ACTION").alias("recommendation"),
        )
        findings = materialize(findings, "shift-findings")
    code = "empty_reference_set" if empty else "no_comparable_reference"
    unscored = query.join(findings, "image_id", "left_anti").select("image_id", F.lit(code).alias("reason"))
    if failures is not None:
        unscored = unscored.unionByName(failures.select("image_id", F.col("failure_code").alias("reason")))
    counts = findings.agg(F.count(F.lit(1)).alias("scored_count"), F.count_if(F.col("state") == "distribution_shift_candidate").alias("anomalous_count"))
    summary = counts.join(unscored.agg(F.count(F.lit(1)).alias("unscored_count"))).withColumn("total_count", F.col("scored_count") + F.col("unscored_count"))
    return ShiftResult(findings, unscored, summary)


# --- silhouettes ----------------------------------------------------------------------------------------------------


@dataclass
class SilhouetteResult:
    findings: DataFrame
    unscorable: DataFrame
    classes: DataFrame
    summary: DataFrame


def analyze_silhouette(labels: DataFrame, features: DataFrame | FeatureBatch, min_class: int = MIN_CLASS, dim: int | None = None) -> SilhouetteResult:
    """Cosine silhouettes of images by their full label set.

    ``labels``: image_id, labels (sorted array). Unscorable codes, in order: missing_label, missing_embedding, dimension_mismatch, invalid_vector,
    zero_vector, class_too_small, no_competing_class, no_intra_class_peer.
    """
    if isinstance(min_class, bool) or min_class < 2:
        raise DetectorError("minimum class size is an integer of at least 2")
    if isinstance(features, FeatureBatch):
        dim, features = features.info.embedding_dim, as_features(features)
    v = F.col("vector").cast("array<double>")
    if dim is None:
        dim = features.agg(F.mode(F.size("vector"))).first()[0] or 0
    joined = labels.select("image_id", "labels").join(features.select("image_id", "vector"), "image_id", "left")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    code = (
        F.when(F.col("labels").isNull() | (F.size("labels") == 0), "missing_label")
        .when(F.col("vector").isNull(), "missing_embedding")
        .when(F.size("vector") != dim, "dimension_mismatch")
        .when(bad, "invalid_vector")
        .when(F.forall(v, lambda x: x == 0), "zero_vector")
    )
    coded = materialize(joined.withColumn("reason", code), "sil-coded")
    valid = coded.filter("reason is null").select("image_id", "labels", "vector")
    sizes = valid.groupBy("labels").agg(F.count(F.lit(1)).alias("class_size"))
    n_classes = sizes.count()
    sized = materialize(valid.join(F.broadcast(sizes) if n_classes <= 100_000 else sizes, "labels"), "sil-valid")
    small = F.when(F.col("class_size") < min_class, "class_too_small").when(F.lit(n_classes < 2), "no_competing_class")
    marked = sized.withColumn("reason", small)
    # classes get numbers so that tiles carry no label arrays; numeric order of the sets is the tie-break
    numbers = _class_numbers(sizes)
    ends = [F.col("image_id.id_type").alias("t"), F.col("image_id.id").alias("id")]
    rows = marked.join(numbers, "labels").select(*ends, "vector", "class", F.col("reason").isNull().cast("int").alias("scored"))
    n = block_count(rows.count(), 8 * dim, parallelism(rows.sparkSession))

    def sums(a: pd.DataFrame, ma: np.ndarray, b: pd.DataFrame, mb: np.ndarray, same: bool) -> pd.DataFrame:
        d = 1.0 - cosine_block(ma, mb)
        if same:
            np.fill_diagonal(d, 0.0)
        out = [_class_sums(a, d, b)]
        if not same:
            out.append(_class_sums(b, d.T, a))
        return pd.concat(out)

    parts = run_tiles(rows, None, (n, n), sums, "t string, id string, class bigint, distance double", unit_rows)
    to_class = parts.groupBy(_id("t", "id").alias("image_id"), "class").agg(F.sum("distance").alias("distance"))
    own = marked.filter("reason is null").join(numbers, "labels").select("image_id", "labels", F.col("class").alias("own"), "class_size")
    per = to_class.join(own, "image_id").join(numbers.select("class", F.col("labels").alias("other_labels"), F.col("size").alias("other_size")), "class")
    is_own = F.col("class") == F.col("own")
    mean = F.when(is_own, F.try_divide(F.col("distance"), F.col("class_size") - 1)).otherwise(F.col("distance") / F.col("other_size"))
    best = F.min(F.when(~is_own, F.struct(mean.alias("mean"), F.col("class").alias("class"), F.col("other_labels").alias("labels"))))
    scored = per.groupBy("image_id", "labels", "class_size").agg(F.max(F.when(is_own, mean)).alias("a"), best.alias("rival"))
    b = F.col("rival.mean")
    top = F.greatest("a", b)
    s = F.when(top == 0, 0.0).otherwise((b - F.col("a")) / top)
    findings = scored.select(
        "image_id", "labels", "class_size", F.col("a").alias("intra_distance"), b.alias("nearest_distance"), F.col("rival.labels").alias("nearest_labels"),
        s.alias("silhouette"), (s > 0).alias("well_separated"),
    )
    findings = materialize(findings, "sil-findings")
    unscorable = coded.filter("reason is not null").select("image_id", "reason").unionByName(marked.filter("reason is not null").select("image_id", "reason"))
    classes = findings.groupBy("labels").agg(F.count(F.lit(1)).alias("image_count"), F.avg("silhouette").alias("mean_silhouette"))
    x = F.col("silhouette")
    summary = findings.agg(
        F.count(F.lit(1)).alias("scored_images"), F.avg(x).alias("mean_silhouette"), F.median(x).alias("median_silhouette"), F.min(x).alias("min_silhouette"),
        F.max(x).alias("max_silhouette"),
    )
    return SilhouetteResult(findings, unscorable, classes, summary)


def _class_numbers(sizes: DataFrame) -> DataFrame:
    return materialize(number_in_order(sizes.select("labels", F.col("class_size").alias("size")), F.col("labels"), "class"), "sil-classes")


def _class_sums(a: pd.DataFrame, d: np.ndarray, b: pd.DataFrame) -> pd.DataFrame:
    """Summed distances of the scored rows of ``a`` to each class in ``b``."""
    scored = np.flatnonzero(a["scored"].to_numpy() == 1)
    if not len(scored) or not len(b):
        return pd.DataFrame()
    classes, place = np.unique(b["class"].to_numpy(), return_inverse=True)
    order = np.argsort(place, kind="stable")
    starts = np.searchsorted(place[order], np.arange(len(classes)))
    sums = np.add.reduceat(d[scored][:, order], starts, axis=1)
    rows = a.iloc[np.repeat(scored, len(classes))]
    return pd.DataFrame({"t": rows["t"].to_numpy(), "id": rows["id"].to_numpy(), "class": np.tile(classes, len(scored)), "distance": sums.reshape(-1)})
