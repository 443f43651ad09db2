"""Near-duplicate documents by DartMinHash and banded joining.

A text is the multiset of its runs of five words (lower-cased); an element's weight is how often it occurs. Similarity is the
weighted Jaccard similarity. Every element owns the quarter plane of weights and ranks; a Poisson process of unit rate, drawn
from hashes cell by cell, throws darts on it. A dart belongs to a text if its weight lies below the element's weight there.
Each dart hashes to one of ``COORDS`` coordinates and the signature keeps every coordinate's earliest (least rank) dart,
so two texts agree on a coordinate with probability equal to their similarity. Only about ``COORDS * ln(COORDS)`` darts
a text are thrown, however many coordinates there are.

Joining. Texts equal word for word are one node with a number. Nodes meet in ``BANDS`` bands of ``ROWS`` coordinates. In a bucket all nodes
are first compared, exactly, with the bucket's least node (the hub), which joins groups of any size by a star. What is
still apart afterwards is compared across components: pair by pair in buckets of up to ``SMALL`` nodes, in tiles of
numpy products above that (``_compare_groups``), where only links leave a task. So no link between candidates is lost, and
no bucket's pairs are all listed.

Cases. Texts without a word (null, empty, only signs) are never copies: each row is a class of its own, with a class
id of its own doc_id. Texts of fewer than five words have one element, all their words. Rows with one text share a
class, also when doc_id repeats; the class id is the least doc_id (null only if all are null). Extra columns are
ignored. Empty tables give empty results.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provena.llm.bitmap import Bitmap
from provena.llm.text import chunks, column_ddl, free_names, only_caches_of, quoted
from provena.operators.components import connected_components
from provena.runtime import discard, materialize, ship_package, small

WORDS = re.compile(r"\w+")
SHINGLE = 5
ROWS, BANDS = 5, 24
COORDS = ROWS * BANDS
THRESHOLD = 0.8
SMALL = 48
TILE = 256
#: words a worker remembers; characters and texts worked on at once (a text throws about 815 darts)
KNOWN_WORDS, CHUNK_CHARS, CHUNK_TEXTS = 100_000, 1 << 18, 256

_M1, _M2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
#: distribution function of the Poisson law of mean 1, scaled to 32 bits
_POISSON = np.array([math.floor(sum(math.exp(-1) / math.factorial(i) for i in range(n + 1)) * 2**32) for n in range(12)], np.uint64)
_NONE = np.uint64(2**64 - 1)


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_hashes = _WordHashes()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def words_of(text: str | None) -> list[str]:
    return WORDS.findall(text.lower()) if text else []


def shingles(words: list[str]) -> np.ndarray:
    """Hash of each run of five words, in order; of all words where there are fewer."""
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - SHINGLE + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(SHINGLE, len(h))):
        out = out * _STEP + _mix(h[k : k + n])
    return _mix(out)


def elements(words: list[str]) -> np.ndarray:
    """Sorted units of weight: the j-th occurrence of a shingle is an element of its own, so multisets become sets."""
    h = np.sort(shingles(words))
    if len(h) < 2:
        return h
    fresh = np.r_[True, h[1:] != h[:-1]]
    if fresh.all():
        return h
    first = np.flatnonzero(fresh)
    nth = np.arange(len(h)) - np.repeat(first, np.diff(np.r_[first, len(h)]))
    return np.sort(np.where(nth > 0, _mix(h + nth.astype(np.uint64) * _STEP), h))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two arrays from ``elements``."""
    if not len(a) or not len(b):
        return 0.0
    both = np.sort(np.concatenate([a, b]))
    common = int((both[1:] == both[:-1]).sum())
    return common / (len(a) + len(b) - common)


def dart_signatures(owner: np.ndarray, element: np.ndarray, weight: np.ndarray, sets: int, coords: int = COORDS) -> np.ndarray:
    """Signatures (sets x coords) of weighted sets given as parallel arrays; a set without weight keeps ``2**64 - 1``."""
    out = np.full(sets * coords, _NONE, np.uint64)
    total = np.bincount(owner, weight, sets)
    wanted = coords * (math.log(coords) + 2)
    with np.errstate(divide="ignore"):
        cells = np.where(total > 0, np.ceil(wanted / np.maximum(total, 1e-300)), 0)
    cells = np.minimum(cells, 1 << 18).astype(np.int64)
    begin = np.zeros(sets, np.int64)  # rank cells already thrown, by set
    base = _mix(element)
    while len(owner):
        high = np.ceil(weight).astype(np.int64)
        width = cells[owner]
        n = high * width
        item = np.repeat(np.arange(len(owner)), n)
        within = np.arange(len(item)) - np.repeat(np.cumsum(n) - n, n)
        level, rank = within // width[item], within % width[item] + begin[owner[item]]
        cell = _mix(base[item] + level.astype(np.uint64) * _STEP + rank.astype(np.uint64) * _M1)
        darts = np.searchsorted(_POISSON, cell >> np.uint64(32), side="right")
        dart_item = np.repeat(np.arange(len(item)), darts)
        nth = np.arange(len(dart_item)) - np.repeat(np.cumsum(darts) - darts, darts)
        dart = _mix(cell[dart_item] + (nth.astype(np.uint64) + np.uint64(1)) * _STEP)
        it = item[dart_item]
        ranks = (rank[dart_item].astype(np.uint64) << np.uint64(44)) | (dart >> np.uint64(20))
        place = owner[it] * coords + ((dart & np.uint64(0xFFFFF)) % np.uint64(coords)).astype(np.int64)
        partial = level[dart_item] + 1 > weight[it]
        if partial.any():
            high_at = level[dart_item] + (_mix(dart ^ _M2) >> np.uint64(11)).astype(float) * 2.0**-53
            hit = high_at < weight[it]
            place, ranks = place[hit], ranks[hit]
        np.minimum.at(out, place, ranks)
        begin += cells
        empty = (out.reshape(sets, coords) == _NONE).any(1) & (total > 0)
        still = empty[owner]
        owner, base, weight = owner[still], base[still], weight[still]
    return out.reshape(sets, coords)


def text_signatures(texts: list[list[str]]) -> np.ndarray:
    """Signatures of texts given as words; weights are counts of shingles."""
    parts = [shingles(w) >> np.uint64(20) | np.uint64(i << 44) for i, w in enumerate(texts)]
    key = np.sort(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)
    if not len(key):
        return np.full((len(texts), COORDS), _NONE, np.uint64)
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    weight = np.diff(np.r_[first, len(key)]).astype(float)
    key = key[first]
    return dart_signatures((key >> np.uint64(44)).astype(np.int64), key & np.uint64((1 << 44) - 1), weight, len(texts))


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of each signature."""
    bands = signatures.reshape(len(signatures), BANDS, ROWS)
    out = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * _STEP, bands.shape[:2]).copy()
    for k in range(ROWS):
        out = _mix(out * _M1 + bands[:, :, k])
    return out


def text_key(words: list[str]) -> bytes | None:
    return xxhash.xxh3_128_digest("\x00".join(words)) if words else None


def _featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    only_caches_of("minhash", _hashes.clear)
    for batch in batches:
        for start, texts in chunks(batch, "text", CHUNK_CHARS, CHUNK_TEXTS):
            words = [words_of(t) for t in texts]
            keys = band_keys(text_signatures(words)).view(np.int64)
            bands = pa.FixedSizeListArray.from_arrays(pa.array(keys.reshape(-1)), BANDS).cast(pa.list_(pa.int64()))
            h = pa.array([text_key(w) for w in words], pa.binary())
            n = pa.array([max(len(w) - SHINGLE + 1, 1) if w else 0 for w in words], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(texts)), h, n, bands], names=["doc_id", "h", "n", "bands"])


def _element_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, n, e (elements as bytes) of fetched texts (id, h, text), where the text is the one that h stands for."""
    only_caches_of("minhash", _hashes.clear)
    for batch in batches:
        node, want = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for start, texts in chunks(batch, "text", CHUNK_CHARS, CHUNK_TEXTS):
            ids, e = [], []
            for k, text in enumerate(texts):
                words = words_of(text)
                if text_key(words) == want[start + k]:
                    ids.append(node[start + k])
                    e.append(elements(words).tobytes())
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array([len(x) // 8 for x in e], pa.int32()), pa.array(e, pa.binary())], ["id", "n", "e"])


def _compare(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, e, f = (batch.column(i) for i in range(4))
            s = []
            for i in range(batch.num_rows):
                s.append(similarity(np.frombuffer(e[i].as_buffer(), np.uint64), np.frombuffer(f[i].as_buffer(), np.uint64)))
            keep = pa.array([x >= threshold for x in s])
            yield pa.record_batch([a.filter(keep), b.filter(keep), pa.array(s, pa.float64()).filter(keep)], ["a", "b", "similarity"])

    return run


def _verify(pairs: DataFrame, found: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of nodes whose exact similarity reaches the threshold."""
    left = found.select(F.col("id").alias("a"), F.col("e").alias("ea"))
    right = found.select(F.col("id").alias("b"), F.col("e").alias("eb"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "ea", "eb")
    return materialize(both.mapInArrow(_compare(threshold), "a bigint, b bigint, similarity double"), "dup-edges")


def _close_in_size(a: Column, b: Column, threshold: float) -> Column:
    """Necessary for the similarity: the smaller has at least the threshold's share of the larger."""
    return F.least(a, b) >= F.lit(threshold) * F.greatest(a, b)


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of two lists of sorted arrays, by products of indicator matrices."""
    out = np.zeros((len(left), len(right)), np.float32)
    shared = np.intersect1d(np.concatenate(left), np.concatenate(right))
    sides = []
    for arrays in (left, right):
        row = np.repeat(np.arange(len(arrays)), [len(x) for x in arrays])
        flat = np.concatenate(arrays)
        at = np.minimum(np.searchsorted(shared, flat), max(len(shared) - 1, 0))
        hit = shared[at] == flat if len(shared) else np.zeros(len(flat), bool)
        order = np.argsort(at[hit], kind="stable")
        sides.append((row[hit][order], at[hit][order]))
    for start in range(0, len(shared), 4096):
        block = []
        for (row, at), arrays in zip(sides, (left, right), strict=True):
            lo, hi = np.searchsorted(at, [start, start + 4096])
            m = np.zeros((len(arrays), min(4096, len(shared) - start)), np.float32)
            m[row[lo:hi], at[lo:hi] - start] = 1
            block.append(m)
        out += block[0] @ block[1].T
    return out


def _compare_tiles(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                sides = []
                for k in (0, 1):
                    rows = batch.column(k)[i].values
                    e = rows.field("e")
                    sides.append((rows.field("id").to_pylist(), rows.field("label").to_pylist(), [np.frombuffer(x.as_buffer(), np.uint64) for x in e]))
                (ha, la, ea), (hb, lb, eb) = sides
                common = _overlaps(ea, eb)
                na, nb = np.array([len(x) for x in ea])[:, None], np.array([len(x) for x in eb])[None, :]
                s = common / (na + nb - common)
                x, y = np.nonzero(s >= threshold)
                # one link from a node to each component: what is in it is joined already
                first = {(p, lb[q]): q for p, q in zip(x[::-1].tolist(), y[::-1].tolist(), strict=True) if la[p] != lb[q]}
                pairs = [(ha[p], hb[q], float(s[p, q])) for (p, _), q in first.items()]
                kinds = (pa.int64(), pa.int64(), pa.float64())
                yield pa.record_batch([pa.array([p[k] for p in pairs], kind) for k, kind in enumerate(kinds)], ["a", "b", "similarity"])

    return run


def _compare_groups(large: DataFrame, found: DataFrame, threshold: float) -> DataFrame:
    """Links between components within groups of large buckets, exactly, in tiles.

    ``large`` has ``id, hub, n, label`` of the members of large buckets. Buckets with common members form one group, so no pair is
    met once a band. A group's nodes are cut into size classes (similar texts are in one or in neighbours) and those into
    chunks of at most about ``TILE`` texts. A tile compares a chunk of nodes outside the group's main component with a
    chunk of any; only links leave it. So the work is the product of a group's nodes and those of them that no hub is
    similar to, within neighbouring size classes.
    """
    groups = connected_components(large.select(F.col("id").alias("a"), F.col("hub").alias("b")).distinct())
    size_class = F.floor(F.log(F.greatest(F.col("n"), F.lit(1))) / F.lit(-math.log(threshold))).cast("int")
    own = large.groupBy("id").agg(F.first("label").alias("label"), F.first("n").alias("n"))
    nodes = own.join(groups.select(F.col("node").alias("id"), F.col("label").alias("group")), "id").join(found, "id")
    nodes = materialize(nodes.select("id", "label", "group", "e", "n", size_class.alias("cls")), "dup-groups")
    parts = nodes.groupBy("group", "label").agg(F.count(F.lit(1)).alias("k"))
    main = parts.groupBy("group").agg(F.max(F.struct("k", "label")).alias("m")).select("group", F.col("m.label").alias("main"))
    chunks_of = F.greatest(F.ceil(F.count(F.lit(1)) / TILE), F.ceil(F.sum("n") / (TILE * 512)))
    extent = materialize(nodes.groupBy("group", "cls").agg(chunks_of.alias("chunks")).join(main, "group"), "dup-extent")
    placed = nodes.join(extent, ["group", "cls"]).withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
    packed = placed.groupBy("group", "cls", "chunk")
    row = F.struct("id", "label", "e")
    right = materialize(packed.agg(F.collect_list(row).alias("right")), "dup-right")
    left = materialize(packed.agg(F.collect_list(F.when(F.col("label") != F.col("main"), row)).alias("left")).filter("size(left) > 0"), "dup-left")
    near = left.select("group", F.explode(F.array(F.col("cls") - 1, F.col("cls"), F.col("cls") + 1)).alias("cls"), "left")
    tiles = near.join(right.select("group", "cls", "right"), ["group", "cls"]).select("left", "right")
    links = materialize(tiles.mapInArrow(_compare_tiles(threshold), "a bigint, b bigint, similarity double"), "dup-edges")
    for used in (nodes, right, left):
        discard(used)
    return links


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    named = labels.select(F.col("node").alias("id"), "label")
    return rows.join(small(named), "id", "left").withColumn("label", F.coalesce("label", "id"))


def _across(rows: DataFrame, key: str, threshold: float) -> DataFrame:
    """Distinct pairs (a, b) that share a key, lie in different components and are close in size."""
    a = rows.select(key, F.col("id").alias("a"), F.col("n").alias("na"), F.col("label").alias("la"))
    b = rows.select(key, F.col("id").alias("b"), F.col("n").alias("nb"), F.col("label").alias("lb"))
    pairs = a.join(b, key).filter((F.col("a") < F.col("b")) & (F.col("la") != F.col("lb")) & _close_in_size(F.col("na"), F.col("nb"), threshold))
    return pairs.select("a", "b").distinct()


@dataclass
class NearDuplicates:
    features: DataFrame  # doc_id, h, n, bands of every row
    nodes: DataFrame  # id, h, doc_id (the least), rows, n, bands of every distinct text with words
    labels: DataFrame  # node, label: the classes of several texts
    links: DataFrame  # a, b, similarity: verified links between nodes


def near_duplicate_nodes(docs: DataFrame, threshold: float = THRESHOLD) -> NearDuplicates:
    """Distinct texts as nodes with a number of their own, their verified links, and the classes these form."""
    spark = docs.sparkSession
    ship_package(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    features = materialize(docs.select("doc_id", "text").mapInArrow(_featurize, f"doc_id {kind}, h binary, n int, bands array<bigint>"), "dup-features")
    texts = features.filter("h is not null").groupBy("h").agg(
        F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("rows"), F.first("n").alias("n"), F.first("bands").alias("bands"),
    )
    # numbers are fixed once they are written; whatever they are, classes come out the same
    nodes = materialize(texts.select(F.monotonically_increasing_id().alias("id"), "h", "doc_id", "rows", "n", "bands"), "dup-nodes")
    # most keys are alone in their bucket, so they are counted on their own first
    spread = nodes.select("id", "n", F.explode("bands").alias("key"))
    shared = materialize(spread.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), "dup-keys")
    placed = materialize(spread.join(shared, "key"), "dup-placed")
    hubs = materialize(placed.groupBy("key").agg(F.min("id").alias("hub")), "dup-hubs")
    members = materialize(placed.join(hubs, "key"), "dup-members")
    found = _elements_of(docs, features, nodes, members)
    for used in (shared, placed, hubs):
        discard(used)

    stars = members.filter(F.col("id") != F.col("hub")).select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("hub").alias("b")).distinct()
    stars = materialize(stars, "dup-stars")
    sizes = nodes.select(F.col("id").alias("b"), F.col("n").alias("nb"))
    close = stars.join(sizes, "b").filter(_close_in_size(F.col("na"), F.col("nb"), threshold))
    links = _verify(materialize(close.select("a", "b"), "dup-close"), found, threshold)
    labels = connected_components(links)
    named = materialize(_labelled(members, labels), "dup-named")
    mixed = named.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("key")
    apart = materialize(named.join(mixed, "key", "left_semi"), "dup-apart")
    across = materialize(_across(apart.filter(F.col("size") <= SMALL), "key", threshold), "dup-across")
    more = _verify(across, found, threshold)
    large = apart.filter(F.col("size") > SMALL)
    if large.limit(1).count():
        more = more.union(_compare_groups(large, found.select("id", "e"), threshold))
    if more.limit(1).count():
        links = links.union(more)
        labels = connected_components(links)
    for used in (members, stars, named, apart, across, found):
        discard(used)
    return NearDuplicates(features, nodes, labels, links)


def _elements_of(docs: DataFrame, features: DataFrame, nodes: DataFrame, members: DataFrame) -> DataFrame:
    """``id, n, e`` of the nodes in shared buckets, from the row that stands for each; other rows' texts are not shuffled."""
    candidates = materialize(nodes.select("id", "h", "doc_id").join(members.select("id").distinct(), "id"), "dup-candidates")
    wanted = Bitmap(candidates, "doc_id").mark(docs.select(F.col("doc_id").alias("row_id"), "text"), F.col("row_id"), "wanted").filter("wanted")
    texts = wanted.select("row_id", "text").join(candidates, F.col("row_id").eqNullSafe(F.col("doc_id"))).select("id", "h", "text")
    rows = texts.mapInArrow(_element_rows, "id bigint, n int, e binary")
    # a doc_id that repeats with its text brings the same elements again
    if features.filter("h is not null").groupBy("doc_id", "h").count().filter("count > 1").limit(1).count():
        rows = rows.dropDuplicates(["id"])
    found = materialize(rows, "dup-elements")
    discard(candidates)
    return found


def _by_node(found: NearDuplicates) -> DataFrame:
    """``id, h, doc_id, rows, class`` of every node; alone it is a class of its own number."""
    classes = found.labels.select(F.col("node").alias("id"), F.col("label").alias("class"))
    nodes = found.nodes.select("id", "h", "doc_id", "rows").join(small(classes), "id", "left")
    return nodes.withColumn("class", F.coalesce("class", "id"))


def near_duplicate_classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, class_id, class_size, n_links`` of every row.

    ``class_id`` is the least doc_id of the row's class, ``class_size`` its number of rows, ``n_links`` the number of
    verified links of the row's text to other texts (links between texts already joined are not all listed).
    """
    found = near_duplicate_nodes(docs, threshold)
    links = found.links
    ends = links.select(F.col("a").alias("id")).union(links.select(F.col("b").alias("id"))).groupBy("id").agg(F.count(F.lit(1)).alias("n_links"))
    nodes = materialize(_by_node(found).join(small(materialize(ends, "dup-ends")), "id", "left"), "dup-classed")
    classes = nodes.groupBy("class").agg(F.min("doc_id").alias("class_id"), F.sum("rows").alias("class_size"))
    by_text = materialize(
        nodes.select("h", "class", F.coalesce("n_links", F.lit(0)).alias("n_links")).join(materialize(classes, "dup-classes"), "class").drop("class"),
        "dup-texts",
    )
    return found.features.select("doc_id", "h").join(by_text, "h", "left").select(
        "doc_id",
        F.when(F.col("h").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1)).cast("bigint").alias("class_size"),
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
    )


def _fates(found: NearDuplicates) -> DataFrame:
    """``h, doc_id, n, stays`` for every pair of a text and a doc_id with n rows: whether one of them is its class's."""
    nodes = materialize(_by_node(found).drop("id", "rows"), "dup-classed")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")
    firsts = nodes.groupBy("class").agg(F.min(order).alias("first"))
    firsts = materialize(firsts.select(F.col("first.h").alias("h"), F.col("first.doc_id").alias("kept"), F.lit(True).alias("there")), "dup-firsts")
    pairs = materialize(found.features.filter("h is not null").groupBy("h", "doc_id").agg(F.count(F.lit(1)).alias("n")), "dup-pairs")
    stays = F.col("there").isNotNull() & F.col("doc_id").eqNullSafe(F.col("kept"))
    fates = materialize(pairs.join(firsts, "h", "left").select("h", "doc_id", "n", stays.alias("stays")), "dup-fates")
    for used in (nodes, pairs, firsts):
        discard(used)
    return fates


def keep_one_of_each(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row of every class: that with the least doc_id (least text key on ties); rows without words all stay.

    Rows are decided by text and doc_id. A bitmap of the doc_ids that lose a row lets all other rows pass as they lie. Of the rows it
    holds back only those whose doc_id also has a row that stays are compared exactly, by their text's key.
    """
    found = near_duplicate_nodes(docs, threshold)
    features, fates = found.features, _fates(found)
    losing = Bitmap(fates.filter("not stays or n > 1").select("doc_id"), "doc_id")
    back = losing.mark(fates.filter("stays").select("h", "doc_id", "n"), F.col("doc_id"), "held").filter("held").drop("held")
    wordless = losing.mark(features.filter("h is null").select("doc_id"), F.col("doc_id"), "held").filter("held").drop("held")
    back = materialize(back, "dup-back")
    returning = Bitmap(back.select("doc_id").unionAll(wordless), "doc_id")

    held, again, key, kept_h, kept_id, n = free_names(docs.columns, "held", "again", "key", "kept_h", "kept_id", "n")
    marked = losing.mark(docs, F.col("doc_id"), held)
    passing = marked.filter(~F.col(held)).select(*quoted(docs.columns))
    doubtful = returning.mark(marked.filter(F.col(held)), F.col("doc_id"), again).filter(F.col(again)).select(*quoted(docs.columns))
    schema = f"`{key}` binary, " + ", ".join(column_ddl(f) for f in docs.schema.fields)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [text_key(words_of(t)) for _, texts in chunks(batch, "text") for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), *batch.columns], names=[key, *batch.schema.names])

    own = back.select(F.col("h").alias(kept_h), F.col("doc_id").alias(kept_id), F.col("n").alias(n))
    same = (F.col(key) == F.col(kept_h)) & F.col("doc_id").eqNullSafe(F.col(kept_id))
    checked = doubtful.mapInArrow(keyed, schema).join(own, same, "left")
    single = checked.filter(F.col(key).isNull() | (F.col(n) == 1))
    out = passing.unionByName(single.select(*quoted(docs.columns)))
    if back.filter("n > 1").limit(1).count():  # rows of a kept text that repeat its doc_id as well
        repeated = checked.filter(F.col(n) > 1).dropDuplicates([key])
        out = out.unionByName(repeated.select(*quoted(docs.columns)))
    return out
