"""The thin queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_codec, language, near_dedup, packing, quality, secret_scan, sharding, substring_dedup, token_counts, topk

BYTE_BPE, WORD_BPE, END_OF_DOCUMENT = "byte_bpe_50k.json", "word_bpe_49k.json", 50256


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.round_trip_digests(_table(spark, sf_dir, "documents"), _tokenizer(BYTE_BPE))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(_table(spark, sf_dir, "documents"))


def op4_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents"), 24)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_bit_sliced_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, 10)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.document_token_counts(_table(spark, sf_dir, "documents"), _tokenizer(BYTE_BPE), END_OF_DOCUMENT)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(_table(spark, sf_dir, "documents"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_passages(_table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), _tokenizer(WORD_BPE))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Every operator's query by its name."""
    every = (op1_near_dedup, op2_bpe_codec, op3_secret_scan, op4_jump_sharding, op5_quality_rules, op6_bit_sliced_topk, op7_token_counts, op8_language_id, op9_substring_dedup, op10_packing)
    return {f.__name__: f for f in every}


OP6_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
  WHERE a.vec_id % 100 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


# The checksum goes byte by byte through the usual table, the shard step by step through the published generator.
OP4_SQL = """
WITH RECURSIVE crc AS (
  SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, _: CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS v FROM range(256) r(i))
), d AS (
  SELECT row_number() OVER () AS id, CAST(doc_id AS BIGINT) AS doc_id, encode(coalesce(text, '')) AS body FROM documents
), k AS (
  SELECT id, doc_id, octet_length(body) + 8 AS size,
    xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(body), '..'), lambda x: CAST('0x' || x AS BIGINT))), lambda c, b: xor(t[1 + (xor(c, b) & 255)], c >> 8))) AS text_crc32
  FROM d, crc
), jumps(id, state, place) AS (
  SELECT id, CAST('0x' || md5(coalesce(CAST(doc_id AS VARCHAR), chr(10) || 'null'))[1:16] AS HUGEINT), CAST(0 AS BIGINT) FROM d
  UNION ALL
  SELECT id, next, CAST(floor((place + 1) * (2147483648.0::DOUBLE / CAST(next // 8589934592 + 1 AS DOUBLE))) AS BIGINT)
  FROM (SELECT id, place, (state * 2862933555777941757 + 1) % 18446744073709551616 AS next FROM jumps WHERE place < 25)
), s AS (
  SELECT id, CAST(max(place) FILTER (place < 24) AS INTEGER) AS shard, CAST(max(place) FILTER (place < 25) AS INTEGER) AS grown_shard FROM jumps GROUP BY id
)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'key' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY CAST('0x' || md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || text_crc32)[1:4] AS BIGINT) % 256, doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, grown_shard
FROM k JOIN s USING (id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_jump_sharding": OP4_SQL, "op6_bit_sliced_topk": OP6_SQL}
