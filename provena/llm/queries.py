"""Queries of the training-data operators, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from provena.llm.sharding import Leaf, balanced_tree, grow

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from provena.llm.minhash import near_duplicate_classes

    return near_duplicate_classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from provena.llm.warc import archive_round_trip

    return archive_round_trip(table(spark, sf_dir, "pages"))


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from provena.llm.collision_ann import nearest

    return nearest(table(spark, sf_dir, "embeddings"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from provena.llm.toxicity import detect_toxicity

    return detect_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from provena.llm.mixing import entropy_mix

    return entropy_mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from provena.llm.branch_bound import top_products

    return top_products(table(spark, sf_dir, "embeddings"))


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from provena.llm.urls import judge

    return judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from provena.llm.langid import identify_languages

    return identify_languages(table(spark, sf_dir, "documents"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from provena.llm.sentencepiece_bpe import encode_documents, load_model

    return encode_documents(table(spark, sf_dir, "documents"), load_model(tokenizer_path()))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from provena.llm.sharding import assign_shards

    return assign_shards(table(spark, sf_dir, "documents"), balanced_tree(8))


def _crc32_sql(data: str) -> str:
    """CRC-32 of a blob, byte by byte; the table's entry of a byte is the exclusive or of those of its bits."""
    of_bit = []
    for k in range(8):
        c = 1 << k
        for _ in range(8):
            c = (c >> 1) ^ (0xEDB88320 if c & 1 else 0)
        of_bit.append(c)
    step = "c >> 8"
    for k, entry in enumerate(of_bit):
        step = f"xor({step}, ((xor(c, b) >> {k}) & 1) * {entry})"
    ones = "4294967295::UBIGINT"
    listed = f"list_transform(regexp_extract_all(hex({data}), '..'), lambda h: ('0x' || h)::UBIGINT)"
    return f"xor(list_reduce({listed}, lambda c, b: {step}, {ones}), {ones})::BIGINT"


def _descent_sql(tree: list[Leaf], key: str) -> str:
    """Shard of a key: at each level the child whose exponential arrival is first."""

    def enter(path: tuple[str, ...]) -> str:
        children: dict[str, float] = {}
        for leaf in tree:
            own = (leaf.region, leaf.rack, str(leaf.shard))
            if own[: len(path)] == path:
                children[own[len(path)]] = children.get(own[len(path)], 0.0) + leaf.weight
        last = len(path) == 2
        if len(children) == 1:
            only = next(iter(children))
            return only if last else enter((*path, only))
        draws = []
        for k, (name, weight) in enumerate(children.items()):
            digits = f"('0x' || substr(md5({key} || '|{'/'.join((*path, name))}'), 1, 13))::BIGINT"
            draws.append(f"{{'t': -ln(({digits} + 0.5) / {16**13}.0::DOUBLE) / {weight}, 'n': {name if last else k}}}")
        first = f"list_sort([{', '.join(draws)}])[1].n"
        if last:
            return first
        return f"CASE {first} " + " ".join(f"WHEN {k} THEN {enter((*path, name))}" for k, name in enumerate(children)) + " END"

    return enter(())


def _sharding_sql() -> str:
    tree = balanced_tree(8)
    return f"""
        WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS body, coalesce(doc_id::VARCHAR, chr(0) || 'null') AS k FROM documents),
        s AS (SELECT doc_id, k, octet_length(body)::BIGINT + 1 AS size, {_crc32_sql("body")} AS text_crc32,
                     ({_descent_sql(tree, "k")})::INTEGER AS shard, ({_descent_sql(grow(tree), "k")})::INTEGER AS grown_shard FROM d),
        b AS (SELECT *, ('0x' || substr(md5(concat_ws('|', k, size, text_crc32)), 1, 13))::BIGINT
                        % greatest(1, ceil((SELECT count(*) FROM documents) / (4096 * 8.0)))::BIGINT AS bin FROM s)
        SELECT doc_id, size, text_crc32, 'key' AS law, shard, grown_shard,
               row_number() OVER (PARTITION BY shard ORDER BY bin, doc_id NULLS FIRST, size, text_crc32) - 1 AS slot
        FROM b
    """


QUERIES: dict[str, Query] = {
    "op1_minhash": op1_minhash,
    "op2_warc": op2_warc,
    "op3_ann": op3_ann,
    "op4_toxicity": op4_toxicity,
    "op5_mixing": op5_mixing,
    "op6_topk": op6_topk,
    "op7_urls": op7_urls,
    "op8_langid": op8_langid,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_sharding": op10_sharding,
}

ORACLE_SQL: dict[str, str] = {
    # exact weighted Jaccard of all pairs that share a shingle, and its components
    "op1_minhash": r"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS ws FROM documents),
        g AS (SELECT doc_id, array_to_string(ws[i : i + 4], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
        e AS (SELECT doc_id, s, count(*) AS k FROM g GROUP BY doc_id, s),
        n AS (SELECT doc_id, sum(k) AS n FROM e GROUP BY doc_id),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, sum(least(a.k, b.k)) AS common FROM e a JOIN e b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
        l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE common::DOUBLE / (x.n + y.n - common)::DOUBLE >= 0.8),
        r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
        c AS (SELECT a AS doc_id, min(b) AS class_id FROM r GROUP BY a)
        SELECT doc_id, class_id, count(*) OVER (PARTITION BY class_id) AS class_size FROM c
    """,
    "op2_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
        s AS (SELECT page_id, strlen(body) AS payload_bytes, sha1(body) AS payload_digest FROM p),
        g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS last FROM s)
        SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN last END AS refers_to
        FROM g
    """,
    "op6_topk": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
                   WHERE embedding IS NOT NULL AND len(embedding) > 0
                     AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, list_dot_product(a.e, b.e)::BIGINT AS score
              FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
    """,
    "op10_sharding": _sharding_sql(),
}
