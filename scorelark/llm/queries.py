"""The thin queries over the operators of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelark.llm import bpe, jaccard, leaks, licenses, privacy, quality, secrets, sharding, vafile, warc
from scorelark.llm.common import table


def op1_bounded_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = sharding.shard_rows(table(spark, sf_dir, "documents"), 8)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_va_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vafile.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


OP2_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 5
"""


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), bpe.default_ranks(), bpe.default_pattern(), with_ids=False).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op4_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = warc.write(table(spark, sf_dir, "pages"))
    return warc.digests(warc.captures(spark, at, with_payload=False))


def op5_license_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.clusters(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_site_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that are kept, with their posteriors."""
    return quality.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).where("keep")


def op9_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return privacy.scan(table(spark, sf_dir, "documents"))


def op10_credentials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents")).drop("found")


QUERIES = {
    "op1_bounded_ring": op1_bounded_ring,
    "op2_va_file": op2_va_file,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_warc_transactions": op4_warc_transactions,
    "op5_license_votes": op5_license_votes,
    "op6_ngram_jaccard": op6_ngram_jaccard,
    "op7_decontamination": op7_decontamination,
    "op8_site_bayes": op8_site_bayes,
    "op9_disclosure": op9_disclosure,
    "op10_credentials": op10_credentials,
}
ORACLES = {
    "op2_va_file": OP2_SQL,
    "op5_license_votes": licenses.oracle(),
}
