"""One query for each operator of this subpackage, over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, langid, packing, quality, secrets, sentencepieces, sharding, simhash, vectors, warc
from .common import read, spread


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.shard(read(spark, sf_dir, "documents"), 8)
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = spread(read(spark, sf_dir, "documents").select("doc_id", "text")), langid.held_out("doc_id", 5, 0)
    model = quality.fit(docs, read(spark, sf_dir, "labels"), learn="crc32(cast(doc_id as string)) % 5 <> 0")
    return quality.classify(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(spread(read(spark, sf_dir, "documents").select("doc_id", "text")))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = langid.fit(docs, learn="crc32(cast(doc_id as string)) % 4 <> 2")
    return langid.identify(spread(docs.select("doc_id", "text")), model).select("doc_id", langid.held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(read(spark, sf_dir, "documents"))


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(read(spark, sf_dir, "embeddings"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.encode_decode(spread(read(spark, sf_dir, "documents").select("doc_id", "text")), tokenizer("piece_bpe_32k.model"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(read(spark, sf_dir, "pages"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(spread(read(spark, sf_dir, "documents").select("doc_id", "text")), tokenizer("byte_bpe_50k.json"), tokenizer("byte_bpe_50k.tiktoken"))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(spread(read(spark, sf_dir, "documents").select("doc_id", "text")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_sharding, op2_quality_classifier, op3_secret_scans, op4_language_id, op5_exact_dedup, op6_embedding_near_dedup, op7_sentencepiece, op8_warc, op9_best_fit_packing, op10_simhash_near_dedup)
}

ORACLE = {
    "op1_sharding": """
        WITH RECURSIVE k(n, c, i) AS (SELECT n, n, 0 FROM range(256) t(n) UNION ALL SELECT n, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i + 1 FROM k WHERE i < 8),
             tab AS (SELECT list(c ORDER BY n) AS t FROM k WHERE i = 8),
             d AS (SELECT doc_id, coalesce(text, '') AS t, strlen(coalesce(text, ''))::BIGINT + 1 AS size FROM documents),
             b AS (SELECT t, list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda x: (strpos('0123456789ABCDEF', x[1]) - 1) * 16 + strpos('0123456789ABCDEF', x[2]) - 1) AS bytes FROM (SELECT DISTINCT t FROM d)),
             c AS (SELECT b.t, xor(list_reduce(list_prepend(4294967295, bytes), lambda a, x: xor(a >> 8, tab.t[(xor(a, x) & 255) + 1])), 4294967295)::BIGINT AS text_crc32 FROM b, tab),
             g AS (SELECT t, min(doc_id) AS first, sum(size)::BIGINT AS size FROM d GROUP BY t),
             p AS (SELECT t, sum(size) OVER (ORDER BY first)::BIGINT AS prefix, size FROM g),
             total AS (SELECT max(prefix) AS total, max(size) AS largest FROM p),
             -- halves the span of capacities until one is left; "fits" walks greedily through eight shards
             s(lo, hi) AS (
               SELECT greatest(largest, (total + 7) // 8) - 1, total FROM total
               UNION ALL
               SELECT CASE WHEN fits THEN lo ELSE mid END, CASE WHEN fits THEN mid ELSE hi END FROM (
                 SELECT lo, hi, (lo + hi) // 2 AS mid, list_reduce(list_prepend(0::BIGINT, list_transform(range(8), lambda z: ((lo + hi) // 2)::BIGINT)), lambda a, m: list_aggregate(list_filter(ends, lambda e: e <= a + m), 'max')) = total AS fits
                 FROM s, total, (SELECT list_prepend(0::BIGINT, list(prefix ORDER BY prefix)) AS ends FROM p) WHERE hi - lo > 1)),
             capacity AS (SELECT min(hi) AS capacity FROM s),
             cuts(k, "at") AS (SELECT 0, 0::BIGINT UNION ALL SELECT k + 1, (SELECT max(prefix) FROM p, capacity WHERE prefix <= cuts."at" + capacity) FROM cuts, total WHERE cuts."at" < total),
             placed AS (SELECT t, prefix, (SELECT count(*) FROM cuts WHERE k > 0 AND cuts."at" < p.prefix)::INT AS shard FROM p)
        SELECT doc_id, d.size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY prefix, doc_id) - 1 AS slot, NULL::INT AS grown_shard FROM d JOIN placed USING (t) JOIN c USING (t)
    """,
    "op5_exact_dedup": r"""
        WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
             g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM n JOIN g USING (t)
    """,
    "op6_embedding_near_dedup": """
        WITH RECURSIVE v AS (
               SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
               WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
             links AS (
               SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
               WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
             reach AS (
               SELECT vec_id AS a, vec_id AS b FROM embeddings
               UNION
               SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
             c AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
             n AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a)
        SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)
    """,
    "op8_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), g AS (SELECT h, min(page_id) AS first FROM p GROUP BY h),
             x AS (SELECT page_id, first, strlen(h)::BIGINT AS payload_bytes,
                          array_to_string(list_transform(string_split(sha1(h), ''), lambda c: ['0000', '0001', '0010', '0011', '0100', '0101', '0110', '0111', '1000', '1001', '1010', '1011', '1100', '1101', '1110', '1111'][strpos('0123456789abcdef', c)]), '') AS bits FROM p JOIN g USING (h)),
             d AS (SELECT *, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum(list_transform(range(5), lambda k: substr(bits, (5 * i + k + 1)::INT, 1)::INT * (16 >> k)))::INT, 1)), '') AS payload_digest FROM x)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM d
    """,
}
