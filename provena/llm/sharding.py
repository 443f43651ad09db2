"""Sharding by a hierarchical weighted hash tree (region, rack, shard).

Every shard is a leaf with a weight; a rack weighs as much as its shards, a region as much as its racks. At each level a document
draws one exponential arrival for every child of the node it is in, ``-ln(u) / weight`` with ``u`` hashed from its key and the
child's path alone, and enters the child that arrives first. Only the children of entered nodes are drawn, and a level's
outcome does not depend on how weight is spread further down.

So a change confines movement: where a leaf's weight changes, documents move only between the children of the nodes above it
(regions, racks of its region, shards of its rack), into the heavier or out of the lighter subtree; inside a
subtree whose weights are as before all documents that stay in it keep their shard. ``grow`` gives a new shard a region of its
own: the only new weight is that region's, so documents move into the new shard and nowhere else (law ``key``).

Cases. A null key hashes as its own value (it has a shard like any other). Repeated rows share a shard and get
different slots. Null text: size 1, ``text_crc32`` 0, like the empty text. An empty table gives an empty
result. Extra columns are ignored. Everything is built from DataFrame functions.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provena.runtime import materialize

#: hex digits of the md5 digest a draw takes: 13 fit a long and a double exactly
_DRAW_DIGITS = 13
LEVELS = ("region", "rack", "shard")


@dataclass(frozen=True)
class Leaf:
    region: str
    rack: str
    shard: int
    weight: float = 1.0


def balanced_tree(shards: int = 8, racks_per_region: int = 2, shards_per_rack: int = 2) -> list[Leaf]:
    """Equal leaves, filled rack by rack and region by region."""
    out = []
    for s in range(shards):
        rack = s // shards_per_rack
        out.append(Leaf(f"region{rack // racks_per_region}", f"rack{rack}", s))
    return out


def grow(tree: list[Leaf], weight: float = 1.0) -> list[Leaf]:
    """One shard more, in a region and a rack of its own, so that no other subtree's weight changes."""
    shard = max(leaf.shard for leaf in tree) + 1
    return [*tree, Leaf(f"region-of-{shard}", f"rack-of-{shard}", shard, weight)]


def check_tree(tree: list[Leaf]) -> None:
    if not tree:
        raise ValueError("the tree needs a shard")
    if len({leaf.shard for leaf in tree}) != len(tree):
        raise ValueError("shard numbers repeat")
    if any(not (0 <= leaf.weight < float("inf")) for leaf in tree) or not any(leaf.weight > 0 for leaf in tree):
        raise ValueError("weights must be finite, not negative and not all zero")
    if len({(leaf.rack, leaf.region) for leaf in tree}) != len({leaf.rack for leaf in tree}):
        raise ValueError("a rack belongs to one region")


def _path(leaf: Leaf, level: int) -> tuple[str, ...]:
    return (leaf.region, leaf.rack, str(leaf.shard))[: level + 1]


def _arrival(key: Column, path: tuple[str, ...], weight: float) -> Column:
    digits = F.substring(F.md5(F.concat(key, F.lit("|" + "/".join(path)))), 1, _DRAW_DIGITS)
    u = (F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(16**_DRAW_DIGITS))
    return -F.log(u) / F.lit(float(weight))


def _enter(key: Column, children: dict[tuple[str, ...], float], number: dict[tuple[str, ...], int]) -> Column:
    """Number of the child that arrives first; the first child on ties."""
    if len(children) == 1:
        return F.lit(number[next(iter(children))])
    draws = [F.struct(_arrival(key, path, w).alias("time"), F.lit(number[path]).alias("number")) for path, w in children.items()]
    return F.array_min(F.array(*draws)).getField("number")


def descend(rows: DataFrame, key: str, tree: list[Leaf], out: str) -> DataFrame:
    """``rows`` with the shard of the column ``key`` as ``out``, reached level by level.

    Each level is a projection of its own over the number of the node entered before, so a document draws for the children of
    the nodes it enters and for no others.
    """
    check_tree(tree)
    leaves = [leaf for leaf in tree if leaf.weight > 0]
    weights: list[dict[tuple[str, ...], float]] = [{} for _ in LEVELS]
    for leaf in leaves:
        for level in range(len(LEVELS)):
            path = _path(leaf, level)
            weights[level][path] = weights[level].get(path, 0.0) + leaf.weight
    at = None
    for level, table in enumerate(weights):
        number = {path: int(path[-1]) if level + 1 == len(LEVELS) else i for i, path in enumerate(table)}
        if at is None:
            entered = _enter(F.col(key), table, number)
        else:
            entered = F.lit(None)
            for path, i in parents.items():
                children = {p: w for p, w in table.items() if p[:-1] == path}
                entered = F.when(F.col(at) == i, _enter(F.col(key), children, number)).otherwise(entered)
        rows = rows.withColumn(f"{out}{level}" if level + 1 < len(LEVELS) else out, entered.cast("int"))
        at, parents = f"{out}{level}", number
    return rows.drop(*[f"{out}{level}" for level in range(len(LEVELS) - 1)])


def key_text(key: Column) -> Column:
    return F.coalesce(key.cast("string"), F.lit("\x00null"))


def shard_of(rows: DataFrame, key: str, tree: list[Leaf], out: str = "shard") -> DataFrame:
    """``rows`` with the shard of a key column; decided by the key and the tree alone."""
    named = rows.withColumn(f"{out}_key", key_text(F.col(key)))
    return descend(named, f"{out}_key", tree, out).drop(f"{out}_key")


def assign_shards(docs: DataFrame, tree: list[Leaf], grown: list[Leaf] | None = None, rows_per_bin: int = 4096) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` for every row of ``docs``.

    Slots number each shard's rows from 0 without gaps. They are dealt in two steps so that no shard's rows meet
    in one task: rows are binned by a hash of the key and content, bin offsets come from bin counts, and only the rows
    of a bin are sorted. Copies of one key spread over the bins by their content.
    """
    grown = grow(tree) if grown is None else grown
    size = F.coalesce(F.octet_length("text").cast("long"), F.lit(0).cast("long")) + F.lit(1)
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    rows = docs.select("doc_id", size.alias("size"), crc.alias("text_crc32"), key_text(F.col("doc_id")).alias("key"))
    placed = materialize(descend(descend(rows, "key", tree, "shard"), "key", grown, "grown_shard"), "shards")
    total = placed.count()
    bins = max(1, -(-total // (rows_per_bin * len(tree))))
    spread = F.concat_ws("|", "key", F.col("size").cast("string"), F.col("text_crc32").cast("string"))
    digits = F.conv(F.substring(F.md5(spread), 1, _DRAW_DIGITS), 16, 10).cast("long")
    binned = placed.withColumn("bin", F.pmod(digits, F.lit(bins)).cast("long"))
    counts = binned.groupBy("shard", "bin").agg(F.count(F.lit(1)).alias("n"))
    # offsets: one row a bin, a running sum by shard; the count of bins is rows / rows_per_bin
    before = Window.partitionBy("shard").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "bin", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    order = Window.partitionBy("shard", "bin").orderBy("doc_id", "size", "text_crc32")
    ranked = binned.withColumn("rank", F.row_number().over(order) - F.lit(1))
    slot = (F.col("offset") + F.col("rank")).cast("long")
    return ranked.join(offsets, ["shard", "bin"]).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", slot.alias("slot"), "grown_shard")
