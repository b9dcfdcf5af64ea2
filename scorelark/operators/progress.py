"""Roles over time: how long bullets are, what entries hold, and whether roles grow. Parts that are computed and shown, but that no shipped profile scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scorelark.operators import competencies, structure

LENGTH, CAREER = 4.0, 4.0
DATED = ("experience", "leadership", "research", "projects")
LISTED = ("experience", "leadership")
GAP_MONTHS, LEVELS, GROWS = 6, 3, 0.4


def entries(lines: DataFrame) -> DataFrame:
    """One row an entry of ``structure.placed_lines``: ``doc_id``, ``section``, ``entry``, ``canonical``, ``n_headers``, ``n_bullets``, ``header`` and, from the dates of its header lines, ``start_month`` and ``end_month``."""
    own = lines.where(F.col("role").isin("header", "bullet"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == "header", F.struct("seq", "text")))), lambda x: x["text"]), " | ")
    each = own.groupBy("doc_id", "section", "entry").agg(F.first("canonical").alias("canonical"), F.count_if(F.col("role") == "header").alias("n_headers"), F.count_if(F.col("role") == "bullet").alias("n_bullets"), text.alias("header"))
    heads = own.where("role = 'header'").select("doc_id", "section", "entry", F.col("seq").alias("line_no"), "text")
    dates = structure.date_spans(heads).join(heads.select("doc_id", "line_no", "section", "entry"), ["doc_id", "line_no"])
    # a single date has no end of its own
    spans = dates.groupBy("doc_id", "section", "entry").agg(F.min("start_month").alias("start_month"), F.max(F.when(F.col("kind") == "range", F.col("end_month")).otherwise(F.col("start_month"))).alias("end_month"))
    return each.join(spans, ["doc_id", "section", "entry"], "left")


def bullet_length(bullets: DataFrame, found: DataFrame, ideal: tuple[int, int] = (12, 55), least: int = 2) -> DataFrame:
    """``doc_id``, ``n_short``, ``n_long``, ``n_thin``, ``mean_words``, ``points``: short bullets cost more than long ones, and so do entries with too few of them."""
    n = F.col("word_count")
    by = bullets.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(n < ideal[0]).alias("n_short"), F.count_if(n > ideal[1]).alias("n_long"), F.bround(F.avg(n), 1).alias("mean_words"))
    thin = (F.col("n_headers") > 0) & (F.col("n_bullets").between(1, least - 1) | (F.col("n_bullets") == 0) & (F.col("n_headers") < 3))
    few = found.where(F.col("canonical").isin(*LISTED) & thin).groupBy("doc_id").agg(F.count("*").alias("n_thin"))
    out = by.join(few, "doc_id", "left").withColumn("n_thin", F.coalesce("n_thin", F.lit(0)))
    lost = LENGTH * F.least(F.lit(0.55), (F.col("n_short") + 0.25 * F.col("n_long")) / F.col("n") * 0.8) + LENGTH * F.least(F.lit(0.3), 0.12 * F.col("n_thin"))
    return out.select("doc_id", "n_short", "n_long", "n_thin", "mean_words", F.greatest(F.lit(0.0), LENGTH - lost).alias("points"))


def career(found: DataFrame) -> DataFrame:
    """``doc_id``, ``n_roles``, ``n_gaps``, ``growth``, ``points``: roles in the order in which they began, the gaps between them, and the share of steps that don't go down, if the later half stands lower than the earlier one."""
    dated = found.where(F.col("canonical").isin(*DATED) & (F.col("n_headers") > 0) & F.col("start_month").isNotNull())
    order = Window.partitionBy("doc_id").orderBy("start_month", "section", "entry")
    placed = competencies.seniority(dated.withColumn("text", F.col("header"))).withColumns({"next": F.lead("start_month").over(order), "place": F.row_number().over(order)})
    gap = (F.col("end_month") < structure.FOREVER) & (F.col("next") - F.col("end_month") > GAP_MONTHS)
    levels = F.transform(F.array_sort(F.collect_list(F.when(F.col("level") > 0, F.struct("place", "level")))), lambda x: x["level"])
    by = placed.groupBy("doc_id").agg(F.count("*").alias("n_roles"), F.count_if(gap).alias("n_gaps"), levels.alias("levels"))
    n = F.size("levels")
    middle = F.floor(n / 2).cast("int")
    mean = lambda xs: F.aggregate(xs, F.lit(0.0), lambda acc, x: acc + x) / F.greatest(F.lit(1), F.size(xs))
    early, late = mean(F.slice("levels", F.lit(1), middle)), mean(F.slice("levels", middle + 1, n))
    up = F.size(F.filter(F.sequence(F.lit(1), n - 1), lambda k: F.get("levels", k) >= F.get("levels", k - 1)))
    growth = F.when(n >= LEVELS, F.when(late >= early, 1.0).otherwise(up / (n - 1)))
    lost = F.when(growth < GROWS, 0.2 * CAREER).otherwise(0.0) + CAREER * F.least(F.lit(0.35), 0.15 * F.col("n_gaps"))
    points = F.when(F.col("n_roles") < 2, 0.6 * CAREER).otherwise(F.greatest(F.lit(0.0), CAREER - lost))
    return by.select("doc_id", "n_roles", "n_gaps", growth.alias("growth"), points.alias("points"))
