"""Near-duplicate images: exact cosine pairs and their connected clusters; the same over perceptual hashes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provena.errors import DetectorError
from provena.functions.vectors import cosine_block, hamming, unit_rows
from provena.operators.components import connected_components
from provena.operators.inputs import as_features, check_features
from provena.operators.numbering import number_in_order
from provena.operators.tiles import block_count, run_tiles
from provena.runtime import materialize, parallelism
from provena.sources.features import FeatureBatch
from provena.sources.images import hash_dataset

COSINE_THRESHOLD, HAMMING_THRESHOLD = 0.95, 8
#: bits of a band from which hashes meet by an equi-join; narrower ones would be hot keys
WIDE = 16


@dataclass
class DuplicateResult:
    pairs: DataFrame  # image_a, image_b, similarity or distance
    clusters: DataFrame  # cluster_id, image_id
    summary: DataFrame  # one row


def check_cosine_threshold(t: float) -> float:
    if isinstance(t, bool) or not isinstance(t, int | float) or not -1 <= t <= 1:
        raise DetectorError("threshold must lie in [-1, 1]")
    return float(t)


def check_hamming_threshold(t: int) -> int:
    if isinstance(t, bool) or not isinstance(t, int) or not 0 <= t <= 64:
        raise DetectorError("threshold must be an integer from 0 to 64")
    return t


def cosine_pairs(features: DataFrame, threshold: float = COSINE_THRESHOLD) -> DataFrame:
    """``image_a, image_b, similarity`` with image_a before image_b and similarity >= threshold."""
    threshold = check_cosine_threshold(threshold)
    blocks = check_features(features).blocks(features.sparkSession)
    rows = features.select(F.col("image_id.id_type").alias("t"), F.col("image_id.id").alias("id"), "vector")

    def tile(a: pd.DataFrame, ma: np.ndarray, b: pd.DataFrame, mb: np.ndarray, same: bool) -> pd.DataFrame:
        s = cosine_block(ma, mb)
        x, y = np.nonzero(np.triu(s >= threshold, 1)) if same else np.nonzero(s >= threshold)
        left, right = a.iloc[x], b.iloc[y]
        ends = {"ta": left["t"].to_numpy(), "ia": left["id"].to_numpy(), "tb": right["t"].to_numpy(), "ib": right["id"].to_numpy()}
        return pd.DataFrame({**ends, "similarity": s[x, y]})

    found = run_tiles(rows, None, (blocks, blocks), tile, "ta string, ia string, tb string, ib string, similarity double", unit_rows)
    p, q = F.struct(F.col("ta").alias("id_type"), F.col("ia").alias("id")), F.struct(F.col("tb").alias("id_type"), F.col("ib").alias("id"))
    return found.select(F.least(p, q).alias("image_a"), F.greatest(p, q).alias("image_b"), "similarity")


def cosine_pairs_sql(features: DataFrame, threshold: float = COSINE_THRESHOLD) -> DataFrame:
    """The same relation as a plain theta join: the readable definition, for small tables."""
    from provena.functions.vectors import cosine

    a, b = features.alias("a"), features.alias("b")
    s = cosine(F.col("a.vector"), F.col("b.vector"))
    ends = [F.col("a.image_id").alias("image_a"), F.col("b.image_id").alias("image_b")]
    pairs = a.join(b, F.col("a.image_id") < F.col("b.image_id")).select(*ends, s.alias("similarity"))
    return pairs.filter(F.col("similarity") >= threshold)


def hash_pairs(hashes: DataFrame, threshold: int = HAMMING_THRESHOLD) -> DataFrame:
    """``image_a, image_b, distance`` of hashes (``image_id, hash`` as long) at most ``threshold`` apart, exactly.

    Equal hashes are one node, whose images are expanded at the end. Nodes are compared in tiles by counting bits; where the threshold
    leaves bands of ``WIDE`` bits or more, nodes that agree on no band are not compared (see ``_near_by_bands``).
    """
    threshold = check_hamming_threshold(threshold)
    images = materialize(hashes.select("image_id", "hash"), "hash-images")
    near = near_hashes(images.select("hash").distinct(), threshold)
    a = images.select(F.col("image_id").alias("x"), F.col("hash").alias("ha"))
    b = images.select(F.col("image_id").alias("y"), F.col("hash").alias("hb"))
    apart = near.join(a, "ha").join(b, "hb").select("x", "y", "distance")
    equal = a.join(b, (F.col("ha") == F.col("hb")) & (F.col("x") < F.col("y"))).select("x", "y", F.lit(0).alias("distance"))
    both = apart.union(equal)
    return both.select(F.least("x", "y").alias("image_a"), F.greatest("x", "y").alias("image_b"), "distance")


def near_hashes(nodes: DataFrame, threshold: int) -> DataFrame:
    """``ha, hb, distance`` of distinct hashes at most ``threshold`` apart, ha below hb."""
    nodes = materialize(nodes, "hash-nodes")
    if 64 // (threshold + 1) >= WIDE:
        return _near_by_bands(nodes, threshold)
    rows = nodes.select(F.col("hash").alias("vector"), F.col("hash").alias("key"))
    blocks = block_count(nodes.count(), 8, parallelism(nodes.sparkSession))

    def tile(a: pd.DataFrame, ma: np.ndarray, b: pd.DataFrame, mb: np.ndarray, same: bool) -> pd.DataFrame:
        d = np.bitwise_count(ma.view(np.uint64) ^ mb.view(np.uint64).T)
        near = np.triu(d <= threshold, 1) if same else d <= threshold
        x, y = np.nonzero(near)
        p, q = ma[x, 0], mb[y, 0]
        return pd.DataFrame({"ha": np.minimum(p, q), "hb": np.maximum(p, q), "distance": d[x, y].astype(np.int32)})

    return run_tiles(rows, None, (blocks, blocks), tile, "ha bigint, hb bigint, distance int", np.ascontiguousarray)


def bands_of(threshold: int) -> list[tuple[int, int]]:
    """(offset, width) of threshold + 1 bands of 64 bits."""
    edges = [i * 64 // (threshold + 1) for i in range(threshold + 2)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _near_by_bands(nodes: DataFrame, threshold: int) -> DataFrame:
    """By an equi-join on bands: of threshold + 1 bands two hashes that near agree on one whole band."""
    bands = bands_of(threshold)

    def part(h: Column, start: int, width: int) -> Column:
        return F.shiftrightunsigned(h, start).bitwiseAND(F.lit((1 << width) - 1 if width < 64 else -1))

    keys = F.array(*[F.struct(F.lit(k).alias("band"), part(F.col("hash"), a, w).alias("part")) for k, (a, w) in enumerate(bands)])
    spread = materialize(nodes.select("hash", F.explode(keys).alias("key")), "hash-bands")
    a, b = spread.select("key", F.col("hash").alias("ha")), spread.select("key", F.col("hash").alias("hb"))
    d = hamming(F.col("ha"), F.col("hb"))
    # a pair that agrees on several bands counts at the first of them
    first = F.lit(None).cast("int")
    for k, (start, w) in reversed(list(enumerate(bands))):
        first = F.when(part(F.col("ha").bitwiseXOR(F.col("hb")), start, w) == 0, k).otherwise(first)
    met = a.join(b, "key").filter((F.col("ha") < F.col("hb")) & (d <= threshold) & (F.col("key.band") == first))
    return met.select("ha", "hb", d.alias("distance"))


def hash_pairs_sql(hashes: DataFrame, threshold: int = HAMMING_THRESHOLD) -> DataFrame:
    """The plain theta join over hashes: the readable definition, for small tables."""
    a, b = hashes.alias("a"), hashes.alias("b")
    d = hamming(F.col("a.hash"), F.col("b.hash"))
    ends = [F.col("a.image_id").alias("image_a"), F.col("b.image_id").alias("image_b")]
    return a.join(b, F.col("a.image_id") < F.col("b.image_id")).select(*ends, d.alias("distance")).filter(F.col("distance") <= threshold)


def clusters_of(pairs: DataFrame) -> DataFrame:
    """``cluster_id, image_id``: components numbered from 1 by their least member; single images are in none."""
    labels = connected_components(pairs, "image_a", "image_b")
    roots = number_in_order(labels.select("label").distinct(), F.col("label"), "cluster_id")
    return labels.join(roots, "label").select("cluster_id", F.col("node").alias("image_id"))


def ordered_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs by their ids."""
    return pairs.orderBy("image_a", "image_b")


def detect_near_duplicates(features: DataFrame | FeatureBatch, threshold: float = COSINE_THRESHOLD) -> DuplicateResult:
    features = as_features(features)
    pairs = materialize(cosine_pairs(features, threshold), "nd-pairs")
    return _result(features, pairs)


def detect_hash_duplicates(hashes: DataFrame, threshold: int = HAMMING_THRESHOLD) -> DuplicateResult:
    pairs = materialize(hash_pairs(hashes, threshold), "hash-pairs")
    return _result(hashes, pairs)


@dataclass
class ImageDuplicateResult:
    hashes: DataFrame  # image_id, file_path, hash
    failures: DataFrame  # image_id, file_path, failure_code
    pairs: DataFrame
    clusters: DataFrame
    summary: DataFrame


def detect_image_duplicates(images: DataFrame, pixels: DataFrame, threshold: int = HAMMING_THRESHOLD) -> ImageDuplicateResult:
    """Perceptual-hash duplicates among image files: ``images`` (image_id, file_path) and their decoded ``pixels``.

    Images without a usable file are failures with a code and take no part in pairs.
    """
    if images.groupBy("image_id").count().filter("count > 1").limit(1).count():
        raise DetectorError("an image id repeats")
    done = materialize(hash_dataset(images, pixels), "image-hashes")
    hashes = done.filter("failure_code is null").select("image_id", "file_path", "hash")
    failures = done.filter("failure_code is not null").select("image_id", "file_path", "failure_code")
    found = detect_hash_duplicates(hashes, threshold)
    failed = failures.agg(F.count(F.lit(1)).alias("failed_hashes"))
    return ImageDuplicateResult(hashes, failures, found.pairs, found.clusters, found.summary.join(failed))


def _result(images: DataFrame, pairs: DataFrame) -> DuplicateResult:
    clusters = materialize(clusters_of(pairs), "clusters")
    counts = images.agg(F.count(F.lit(1)).alias("image_count"))
    sizes = clusters.agg(F.countDistinct("cluster_id").alias("cluster_count"), F.count(F.lit(1)).alias("clustered_images"))
    summary = counts.join(pairs.agg(F.count(F.lit(1)).alias("pair_count"))).join(sizes)
    return DuplicateResult(pairs, clusters, summary)
