"""From raw documents to tokens: quality, near duplicates, benchmark leaks, personal data, encoding.

Each stage works on all that its predecessor kept, written as Parquet and read
again, so a lost executor never costs more than its own stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelark.llm import bpe, jaccard, leaks, privacy, quality
from scorelark.llm.common import kept, release, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near duplicates."""
    return jaccard.one_of_each(docs)


def unseen(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return leaks.clean(docs, table(spark, sf_dir, "benchmark"))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and what discloses it out of their texts; ``n_chars`` follows."""
    return privacy.sanitise(docs).withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars")))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` of every document."""
    return bpe.encode(docs, bpe.default_ranks(), bpe.default_pattern(), with_ids=False).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", good),
    ("ngram_jaccard_join", distinct),
    ("benchmark_decontamination", unseen),
    ("personal_data", private),
    ("byte_level_bpe", tokens),
]

#: A fitted classifier can't be written in SQL; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens of what all stages keep; a stage's input goes once its output is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir), name)
        if before is not None:
            release(spark, before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
