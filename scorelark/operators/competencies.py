"""Competencies: how many distinct terms of each a document holds. The terms are a parameter.

A few hundred terms are literals (``facts.term_hits``); more come as a table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelark.functions import lexicons as lx
from scorelark.functions import text as tx

MOST, FULL_AT, STEP = 6.0, 5, 0.5
#: Terms that may be sent to all tasks.
SENT = 1_000_000


def grams(words, longest: int):
    """All runs of one to ``longest`` words of an array, joined by blanks."""
    if longest == 1:
        return F.array_distinct(words)

    def of(n: int):
        return F.transform(F.sequence(F.lit(0), F.size(words) - 1), lambda k: F.array_join(F.slice(words, k + 1, n), " "))

    return F.when(F.size(words) > 0, F.array_distinct(F.flatten(F.array(*map(of, range(1, longest + 1)))))).otherwise(F.array().cast("array<string>"))


def found(lines: DataFrame, terms: DataFrame, longest: int = 3) -> DataFrame:
    """``doc_id``, ``competency``, ``n_lines``, ``n_terms``: an equi-join of runs of words with the terms (``term``, ``competency``), in place of a search for each.

    Lines that hold no term end where they are read, as the terms are sent to them.
    """
    terms = terms.distinct()
    terms = F.broadcast(terms) if terms.limit(SENT + 1).count() <= SENT else terms
    low = lines.select("doc_id", "line_no", F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9][a-z0-9+&'/-]*"), F.lit(0)).alias("w"))
    each = low.select("doc_id", "line_no", F.explode(grams(F.col("w"), longest)).alias("term"))
    return each.join(terms, "term").groupBy("doc_id", "competency").agg(F.count_distinct("line_no").alias("n_lines"), F.count_distinct("term").alias("n_terms"))


def points(hits: DataFrame) -> DataFrame:
    """Points in steps of a half, ties to the even step; full marks from five terms on."""
    p = F.bround(MOST * F.least(F.lit(1.0), F.col("n_terms") / FULL_AT) / STEP) * STEP
    state = F.when(p >= 5, "Good Job!").when(p >= 2.5, "On Track!").otherwise("Needs Work!")
    return hits.withColumn("points", p).withColumn("status", state)


def spoken_languages(lines: DataFrame) -> DataFrame:
    """``doc_id``, ``n``, ``text``: the line that names most spoken languages, the first on a tie, of lines that are labelled so or stand in a section of languages."""
    words = F.array_distinct(tx.found(F.lower("text"), "[a-z]+"))
    named = F.size(F.array_intersect(words, F.array(*map(F.lit, lx.SPOKEN_LANGUAGES))))
    labelled = (F.coalesce(F.col("canonical"), F.lit("")) == "languages") | F.col("text").rlike(r"(?i)\b(?:spoken\s+)?languages?\b\s*[:–—-]")
    best = lines.where(labelled & (F.col("section") > 0)).select("doc_id", "seq", "text", named.alias("n")).where("n > 0")
    return best.groupBy("doc_id").agg(F.max_by(F.struct("n", F.substring("text", 1, 110).alias("text")), F.struct("n", -F.col("seq"))).alias("x")).select("doc_id", "x.*")


def seniority(headers: DataFrame) -> DataFrame:
    """``headers`` (``text`` of the lines above a role) with ``level``: the highest that any title in it shows, else 0."""
    low = F.lower("text")
    level = F.greatest(*(F.when(low.rlike(rf"\b{tx.any_of(titles)}\b"), k).otherwise(0) for k, titles in lx.SENIORITY.items()))
    return headers.withColumn("level", level)
