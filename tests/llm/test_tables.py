import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from provena.llm import branch_bound, collision_ann, mixing, sharding, urls, warc


# --- WARC -----------------------------------------------------------------------------------------------------------


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "page_id bigint, url string, html string, digest string")


def test_archive_round_trip(spark):
    big = "<p>" + "x" * 1500 + "</p>"
    rows = [(i, f"http://a/{i}", f"page {i} " * 300) for i in range(40)] + [(100, "u", big), (101, None, big), (102, "bad\r\nurl", big), (103, "u", "small"), (104, "u", "small"), (105, "u", None), (None, "u", big), (106, "u", "é" * 200000), (102, "again", big)]
    got = warc.archive_round_trip(pages(spark, rows)).collect()
    assert len(got) == len(rows)
    import hashlib

    by = defaultdict(list)
    for r in got:
        by[r.page_id].append(r)
    for page, _, html in rows:
        data = (html or "").encode()
        assert all(r.payload_bytes == len(data) and r.payload_digest == hashlib.sha1(data).hexdigest() for r in by[page])
    assert [(r.record_type, r.refers_to) for r in by[102]] == [("response", None)] * 2
    for p in (100, 101, None):
        assert (by[p][0].record_type, by[p][0].refers_to) == ("revisit", 102)
    assert all(by[p][0].record_type == "response" for p in (103, 104, 105, 106))
    assert warc.archive_round_trip(pages(spark, [])).count() == 0


def test_files_of_lost_attempts_are_not_read(spark, tmp_path):
    rows = [(i, f"http://a/{i}", f"page {i} " * 300) for i in range(50)]
    path = f"file://{tmp_path}"
    written = warc.write_archives(pages(spark, rows), path, archive_bytes=2000)
    names = sorted(r.archive for r in written.collect())
    assert sorted(p.name for p in tmp_path.glob("*.warc.zst")) == names and len(names) > 4
    # an attempt that was lost after it had written two archives, one of them cut off
    (tmp_path / "part-000000-lost-00000.warc.zst").write_bytes((tmp_path / names[0]).read_bytes())
    (tmp_path / "part-000000-lost-00001.warc.zst").write_bytes((tmp_path / names[1]).read_bytes()[:-7])
    got = warc.read_archives(spark, path, with_payload=True, archives=written).collect()
    assert sorted(r.page_id for r in got) == list(range(50))
    assert all(r.payload.decode() == rows[r.page_id][2] for r in got)
    (tmp_path / "part-000000-lost-00001.warc.zst").unlink()
    assert warc.read_archives(spark, path).count() > 50  # without the table all files of the folder count


def test_archive_errors():
    import struct

    samples = [warc.build_record(i, "u", f"text {i} of a page ".encode() * 50, b"\0" * 20, None) for i in range(60)]
    dictionary = warc.train_dictionary(samples)
    w = warc.ArchiveWriter(dictionary)
    import hashlib

    for i in range(3):
        body = f"text {i} of a page".encode()
        w.add(warc.build_record(i, "http://x/é", body, hashlib.sha1(body).digest(), None))
    data = b"".join(w.parts)
    assert struct.unpack_from("<I", data)[0] == warc.DICTIONARY_MAGIC and len(dictionary) > 0
    records = list(warc.read_archive(data))
    assert [warc.http_payload(r)[1] for r in records] == [f"text {i} of a page".encode() for i in range(3)]
    for broken in (data[:-5], data[:40], data + b"junk"):
        with pytest.raises(warc.WarcError):
            list(warc.read_archive(broken))
    good = warc.build_record(1, "u", b"abc", hashlib.sha1(b"abc").digest(), None)
    for bad in (good[:-1], good.replace(b"WARC/1.1", b"WARX/1.1"), good.replace(b"abc\r\n\r\n", b"abd\r\n\r\n"), good.replace(b"WARC-Type", b"WARC-Typo"), good + b"x"):
        with pytest.raises(warc.WarcError):
            warc.parse_record(bad)
    import zstandard

    packed = zstandard.ZstdCompressor().compress(dictionary)
    again = struct.pack("<II", warc.DICTIONARY_MAGIC, len(packed)) + packed + b"".join(w.parts[1:])
    assert len(list(warc.read_archive(again))) == 3


# --- vectors --------------------------------------------------------------------------------------------------------


def vectors(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1.0, 7) for i, v in rows], "vec_id bigint, embedding array<float>, score double, rank int")


def clean(rows, zero):
    """(id, vector) of all rows that take part; repeated rows stay."""
    out = []
    for i, v in rows:
        if i is None or v is None or not len(v) or any(x is None or not np.isfinite(x) for x in v) or (not zero and not any(v)):
            continue
        out.append((i, np.array(v, np.float32).astype(float)))
    return out


@pytest.fixture(scope="module")
def cloud():
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((12, 24))
    rows = [(i, (centres[i % 12] + 0.6 * rng.standard_normal(24)).tolist()) for i in range(3000)]
    same = rows[100][1]
    rows += [(5000 + i, same) for i in range(40)] + [(6000, None), (6001, []), (6002, [0.0] * 24), (6003, [float("nan")] * 24), (6004, [None] * 24), (6100, [1.0, 2.0]), (None, same), (200, rows[200][1])]
    return rows


def test_nearest(spark, cloud):
    got = defaultdict(list)
    for r in collision_ann.nearest(vectors(spark, cloud)).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r)
    real = clean(cloud, False)
    asked = {i: v for i, v in real if i % 100 == 0}
    by_id = dict(real)
    hit = total = 0
    for q, mine_v in asked.items():
        d = sorted((float(np.sqrt(np.square(v - mine_v).sum())), i) for i, v in real if i != q and len(v) == len(mine_v))[:10]
        mine = got.pop(q, [])
        assert [r.rank for r in mine] == list(range(1, len(d) + 1))
        assert all(abs(r.score - float(np.sqrt(np.square(by_id[r.vec_id] - mine_v).sum()))) < 1e-12 for r in mine)
        assert [(r.score, r.vec_id) for r in mine] == sorted((r.score, r.vec_id) for r in mine)
        hit += len({i for _, i in d} & {r.vec_id for r in mine})
        total += len({i for _, i in d})
    assert not got and hit / total >= 0.95


@pytest.mark.parametrize("dim", [1, 2, 3, 8, 40, 64, 200])
def test_counting_finds_the_nearest_and_prunes(dim):
    """Recall against all distances, on vectors without any clusters; with some dimensions few vectors are verified."""
    rng = np.random.default_rng(dim)
    x = rng.standard_normal((4000, dim))
    index = collision_ann.CollisionIndex(np.arange(4000), x, collision_ann.directions(dim, collision_ann.PROJECTIONS))
    hit = 0
    for q in range(40):
        d = np.sqrt(np.square(x - x[q]).sum(1))
        d[q] = np.inf
        near, distance = index.search(q, x[q], 10)
        assert np.allclose(distance, d[near]) and (np.diff(distance) >= 0).all()
        hit += len(set(near.tolist()) & set(np.argsort(d, kind="stable")[:10].tolist()))
    assert hit / 400 >= 0.95
    if 8 <= dim <= 64:
        assert index.verified / (40 * 4000) < 0.3


def test_waves_give_the_same(spark, cloud, monkeypatch):
    from provena.llm import vectors as vec

    d = vectors(spark, cloud)
    one = [collision_ann.nearest(d), branch_bound.top_products(d)]
    one = [sorted(map(tuple, x.collect())) for x in one]
    monkeypatch.setattr(vec, "WAVE", 20)
    assert sorted(map(tuple, branch_bound.top_products(d).collect())) == one[1]
    again = sorted(map(tuple, collision_ann.nearest(d).collect()))
    assert len(again) == len(one[0]) and len(set(again) & set(one[0])) >= 0.9 * len(again)


def test_top_products_are_exact(spark, cloud):
    rows = [*cloud, (7000, [3e30] * 24), (7001, [-1e30] * 24)]
    got = defaultdict(list)
    for r in branch_bound.top_products(vectors(spark, rows)).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    real = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in clean(rows, True)]
    ends = np.iinfo(np.int64)
    for q, mine in {i: v for i, v in real if i % 100 == 0}.items():
        s = [(min(max(sum(a * b for a, b in zip(mine, v, strict=True)), ends.min), ends.max), i) for i, v in real if i != q and len(v) == len(mine)]
        want = [(i, x) for x, i in sorted(s, key=lambda t: (-t[0], t[1]))[:10]]
        assert got.pop(q, []) == want
    assert not got


def test_no_vectors(spark):
    for f in (collision_ann.nearest, branch_bound.top_products):
        assert f(vectors(spark, [])).count() == 0
        assert f(vectors(spark, [(0, [1.0])])).count() == 0


# --- URLs -----------------------------------------------------------------------------------------------------------


def split_url(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    return low, re.match(r"[^?#]*", rest[len(host) :])[0]


def rule_of(host, path):
    fits = [r for r in urls.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.text), default=None)


def test_urls_equal_brute_force(spark):
    odd = [None, "", "no scheme", "http://A.Example.NET/en/x?y#z", "x://net", "x://net/", "x://a.org/fr/b#/c", "h://É.ORG?a://b/", "a://b\n.net/q", "a://xnet/", "a://example.com/de/" + "1" * 50000, "://", "http://example.com?x=1&y=2"]
    made = [f"https://{h}.{s}/{lang}/{i}{tail}" for i, (h, s, lang, tail) in enumerate((h, s, lang, t) for h in ("blog.a", "cheap-pills") for s in ("example.net", "example.com", "x.org") for lang in ("en", "de", "fr") for t in ("", "?a=1&b=2", "#top"))]
    rows = [(i, u, "x") for i, u in enumerate([*odd, *made, made[0]])]
    d = spark.createDataFrame(rows, "page_id bigint, url string, host string")
    got = {r.page_id: r for r in urls.judge(d).collect()}
    assert len(got) == len(rows)
    for i, u, _ in rows:
        host, path = split_url(u)
        rule = rule_of(host, path)
        r = got[i]
        assert (r.host, r.path, r.rule) == (host, path, rule.text if rule else None)
        assert r.verdict == (rule.verdict if rule else "block" if r.score >= 0.5 else "allow")
    assert urls.judge(d.limit(0)).count() == 0


def test_trees_learn_lexical_marks(spark):
    rows = [(f"http://site{i}.com/{'9' * 12 if i % 3 == 0 else 'page'}/{i}", int(i % 3 == 0)) for i in range(300)]
    labelled = spark.createDataFrame(rows, "url string, block int")
    d = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(rows)], "page_id bigint, url string")
    got = {r.page_id: r.verdict for r in urls.judge(d, rules=(), labelled=labelled).collect()}
    assert np.mean([got[i] == ("block" if y else "allow") for i, (_, y) in enumerate(rows)]) > 0.98


def test_sampled_training_keeps_hot_urls_at_their_part(spark):
    """A class of one url with many copies is learned from, and the prior is that of all labelled rows."""
    hot = [f"http://pills.com/{'9' * (9 + k)}/x" for k in range(2)]
    rows = [(u, 1) for u in hot for _ in range(400)] + [(f"http://site{i}.com/page/{i}", 0) for i in range(400)]
    labelled = spark.createDataFrame(rows, "url string, block int")
    known = labelled.select("url", urls.host_of(F.col("url")).alias("host"), urls.path_of(F.col("url")).alias("path"), "block")
    assert urls.fit(known, trees=1, fit_rows=60).prior == 800 / 1200
    d = spark.createDataFrame([(k, u) for k, u in enumerate([*hot, *(u for u, y in rows if not y)])], "page_id bigint, url string")
    got = {r.page_id: r.verdict for r in urls.judge(d, rules=(), labelled=labelled, fit_rows=60, trees=4).collect()}
    assert got[0] == got[1] == "block" and np.mean([v == "allow" for k, v in got.items() if k > 1]) > 0.98


def test_rates_know_every_suffix_and_whole_segments(spark):
    """Over 2000 suffixes, and first segments that differ after 40 characters: what decides is none of the other features."""
    rows = [(f"http://www.site.t{i:05d}/{'s' * 40}{'ab'[i % 2]}/x", i % 2) for i in range(5200)]
    labelled = spark.createDataFrame(rows, "url string, block int")
    known = labelled.select("url", urls.host_of(F.col("url")).alias("host"), urls.path_of(F.col("url")).alias("path"), "block")
    model = urls.fit(known, trees=2)
    assert model.rates["tld"].count() == 5200 and model.rates["section"].count() == 2
    new = [(k, f"http://www.new{k}.com/{'s' * 40}{'ab'[k % 2]}/x") for k in range(200)]
    got = {r.page_id: r.verdict for r in urls.judge(spark.createDataFrame(new, "page_id bigint, url string"), rules=(), labelled=labelled, trees=4).collect()}
    assert np.mean([got[k] == ("block" if k % 2 else "allow") for k, _ in new]) > 0.98


def test_a_row_does_not_see_its_own_label(spark):
    """Suffixes of one url each, labels by chance: rates learned on the row itself would tell them."""
    rng = np.random.default_rng(4)
    rows = [(f"http://h{i}.com{i}/p/{i}", int(y)) for i, y in enumerate(rng.integers(0, 2, 1200))]
    labelled = spark.createDataFrame(rows[:800], "url string, block int")
    d = spark.createDataFrame([(k, u) for k, (u, _) in enumerate(rows[800:])], "page_id bigint, url string")
    score = {r.page_id: r.score for r in urls.judge(d, rules=(), labelled=labelled).collect()}
    assert np.std(list(score.values())) < 0.2


def test_entropy(spark):
    got = spark.createDataFrame([("aabb",), ("",), ("abcd",)], "t string").select(urls.entropy(F.col("t"))).collect()
    assert [round(r[0], 6) for r in got] == [1.0, 0.0, 2.0]


# --- mixing ---------------------------------------------------------------------------------------------------------


def water(sizes, weights, total, cap=2.0):
    full = set()
    while True:
        left = total - sum(cap * sizes[k] for k in full)
        level = left / sum(weights[k] for k in sizes if k not in full)
        more = {k for k in sizes if k not in full and weights[k] * level > cap * sizes[k]}
        if not more:
            return {k: cap * sizes[k] if k in full else weights[k] * level for k in sizes}
        full |= more


def test_mixing(spark):
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(["w"] * int(rng.integers(1, 60))), s) for i, s in enumerate(rng.choice(["b", "a", "é", "Z"], 1500, p=[0.5, 0.2, 0.2, 0.1]))]
    rows += [(9000 + i, "x\u00a0y z\x0bq", None) for i in range(50)] + [(9900, None, "a"), (9901, "", "empty"), (None, "one two", "a"), (5, rows[5][1], rows[5][2])]
    d = spark.createDataFrame([(*r, 3) for r in rows], "doc_id bigint, text string, source string, size int")
    got = mixing.entropy_mix(d).toPandas()
    assert len(got) == len(rows)
    word = re.compile(r"[^\x20\x09-\x0D]+")
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(word.findall(t or ""))
    order = sorted((s for s in sizes if s is not None)) + [None]
    want = water(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, 1.5 * sum(sizes.values()))
    got["source"] = got["source"].astype(object).where(got["source"].notna(), None)
    for s in order:
        part = got[got.source.isna()] if s is None else got[got.source == s]
        assert np.allclose(part.target, want[s]) and (part.source_size == sizes[s]).all()
        assert abs(part.taken.sum() - want[s]) <= 30
        # rates are an exponential tilt of the size, held at 2, and meet the target in expectation
        real = part[part["size"] > 0]
        assert abs((real.rate * real["size"]).sum() - want[s]) <= 1e-6 * max(want[s], 1)
        free = real[(real.rate < 2) & (real.rate > 0)]
        if len(free):
            tilt = np.log(free.rate) / free["size"]
            assert tilt.max() - tilt.min() < 1e-9
        assert ((part.copies - part.rate).abs() < 1 + 1e-9).all()
    assert (got.taken <= 2 * got["size"]).all()
    again = mixing.entropy_mix(d.repartition(7)).toPandas()
    key = ["doc_id", "size", "taken"]
    assert got[key].sort_values(key).fillna(-1).values.tolist() == again[key].sort_values(key).fillna(-1).values.tolist()
    copies = mixing.mix_copies(d)
    assert copies.columns == d.columns and copies.count() == got.copies.sum()
    assert mixing.entropy_mix(d.limit(0)).count() == 0


@pytest.mark.parametrize("n", [40, 3000])
@pytest.mark.parametrize("share", [0.5, 1.5])
def test_a_wish_met_at_the_edge_of_a_bin(spark, n, share):
    """Documents of one size: the wanted words end with a document, and mostly with a bin."""
    d = spark.createDataFrame([(i, "a b c", "s") for i in range(n)], "doc_id bigint, text string, source string")
    got = mixing.entropy_mix(d, share=share).agg(F.first("target"), F.sum("taken"), F.count(F.lit(1))).first()
    assert tuple(got) == (share * 3 * n, share * 3 * n, n)
    assert mixing.mix_copies(d, share=share).count() == share * n


def test_the_dual_says_when_it_has_not_converged(spark):
    rows = [(i, "w " * int(n), "ab"[i % 2]) for i, n in enumerate(np.random.default_rng(1).integers(1, 2000, 300))]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    sizes = d.select("source", mixing.word_count(F.col("text")).alias("size")).groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    sums = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("n_docs"))
    wish = sums.withColumn("target", F.col("source_size") * F.when(F.col("source") == "a", 0.01).otherwise(1.97))
    found = {r.source: r for r in mixing.solve_dual(sizes, wish).collect()}
    assert found["a"].tilt < 0 < found["b"].tilt
    with pytest.raises(RuntimeError, match="not converged"):
        mixing.solve_dual(sizes, wish, rounds=3)


def test_copies_of_one_row_at_the_cut(spark):
    """A third of a source is one row, repeated: it is one entry of the order, and the rest meets the target around it."""
    rows = [(7, "a b c", "s")] * 300 + [(100 + i, "a b c", "s") for i in range(600)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = mixing.entropy_mix(d, share=0.5).groupBy("doc_id").agg(F.max("copies").alias("most"), F.min("copies").alias("least"), F.sum("taken").alias("t")).toPandas()
    assert (got.most == got.least).all() and abs(got.t.sum() - 1350) <= 450


def test_sources_of_equal_documents_meet_their_targets(spark):
    rows = [(i, "one", "abcd"[i % 4]) for i in range(1600)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = mixing.entropy_mix(d).groupBy("source").agg(F.first("target").alias("target"), F.sum("taken").alias("taken")).toPandas()
    assert (abs(got.taken - got.target) <= 0.5 + 1e-9).all()


# --- sharding -------------------------------------------------------------------------------------------------------


def test_sharding(spark):
    rows = [(i, f"text {i % 7} é") for i in range(4000)] + [(None, None), (3, "x"), (3, "x"), (5000, "")]
    d = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id bigint, text string, shard int, size int")
    got = sharding.assign_shards(d, sharding.balanced_tree(8), rows_per_bin=64).toPandas()
    assert len(got) == len(rows)
    for _, part in got.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part))) and 380 < len(part) < 640
    moved = got[got["shard"] != got.grown_shard]
    assert (moved.grown_shard == 8).all() and 0.07 < len(moved) / len(got) < 0.16
    texts = dict(rows)
    one = got[got.doc_id == 10].iloc[0]
    assert (one["size"], one.text_crc32) == (len(texts[10].encode()) + 1, zlib.crc32(texts[10].encode()))
    null = got[got.doc_id.isna()].iloc[0]
    assert (null["size"], null.text_crc32) == (1, 0)
    assert got[got.doc_id == 3]["shard"].nunique() == 1
    assert sharding.assign_shards(d.limit(0), sharding.balanced_tree(8)).count() == 0


def shards(spark, n, tree):
    return spark.range(n).transform(lambda d: sharding.shard_of(d, "id", tree)).orderBy("id").toPandas()["shard"].to_numpy()


def by_hand(key, tree):
    """The tree's descent in plain Python."""
    import hashlib
    import math

    at = ()
    for level in range(3):
        weights = {}
        for leaf in tree:
            path = (leaf.region, leaf.rack, str(leaf.shard))[: level + 1]
            if path[:-1] == at and leaf.weight > 0:
                weights[path] = weights.get(path, 0.0) + leaf.weight
        draw = {p: -math.log((int(hashlib.md5(f"{key}|{'/'.join(p)}".encode()).hexdigest()[:13], 16) + 0.5) / 16**13) / w for p, w in weights.items()}
        at = min(draw, key=draw.get) if len(weights) > 1 else next(iter(weights))
    return int(at[-1])


def test_descent_equals_plain_python(spark):
    rng = np.random.default_rng(3)
    tree = [sharding.replace(x, weight=float(w)) for x, w in zip(sharding.balanced_tree(11), rng.choice([0, 0.5, 1, 3], 11), strict=True)]
    tree[0] = sharding.replace(tree[0], weight=1.0)
    assert shards(spark, 1500, tree).tolist() == [by_hand(i, tree) for i in range(1500)]


def test_the_levels_decide(spark):
    """Drawn node by node, the result is not that of one flat draw over all leaves."""
    import hashlib
    import math

    tree = sharding.balanced_tree(8)
    path = {x.shard: f"{x.region}/{x.rack}/{x.shard}" for x in tree}
    flat = [min(path, key=lambda s: -math.log((int(hashlib.md5(f"{i}|{path[s]}".encode()).hexdigest()[:13], 16) + 0.5) / 16**13)) for i in range(2000)]
    assert 0.3 < (shards(spark, 2000, tree) != np.array(flat)).mean() < 0.95


def test_weights_confine_movement(spark):
    tree = sharding.balanced_tree(8)
    place = {x.shard: (x.region, x.rack) for x in tree}
    for weight in (2.0, 0.25, 0.0):
        changed = [sharding.replace(x, weight=weight) if x.shard == 5 else x for x in tree]
        a, b = shards(spark, 6000, tree), shards(spark, 6000, changed)
        moved = [(place[x], place[y], x, y) for x, y in zip(a.tolist(), b.tolist(), strict=True) if x != y]
        assert moved
        for (ra, ka), (rb, kb), x, y in moved:
            # across regions into the heavier one or out of the lighter; else between racks of shard 5's region or inside its rack
            if ra != rb:
                assert (rb if weight > 1 else ra) == place[5][0]
            elif ka != kb:
                assert ra == place[5][0] and (kb if weight > 1 else ka) == place[5][1]
            else:
                assert ka == place[5][1] and (y if weight > 1 else x) == 5
        assert abs((b == 5).mean() - weight / (7 + weight)) < 0.03
    with pytest.raises(ValueError):
        sharding.check_tree([])


def test_a_grown_tree_moves_rows_only_into_the_new_shard(spark):
    tree = sharding.balanced_tree(8)
    for _ in range(3):
        more = sharding.grow(tree)
        a, b = shards(spark, 6000, tree), shards(spark, 6000, more)
        assert set(b[a != b].tolist()) == {len(tree)} and abs((a != b).mean() - 1 / len(more)) < 0.03
        tree = more


def test_a_level_draws_by_subtree_weight(spark):
    tree = [sharding.Leaf("r0", "k0", 0, 1.0), sharding.Leaf("r0", "k0", 1, 3.0), sharding.Leaf("r1", "k1", 2, 4.0)]
    found = shards(spark, 8000, tree)
    assert np.allclose([(found == k).mean() for k in range(3)], [1 / 8, 3 / 8, 1 / 2], atol=0.03)
