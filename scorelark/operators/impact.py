"""Impact: how the lines of a document are worded. Every function takes lines (``doc_id``, ``line_no``, ``text``).

Lines turn into numbers where they are read; a document's lines are in one
partition, so the sums that are shuffled are one row a document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scorelark.functions import lexicons as lx
from scorelark.functions import text as tx

ACTION, SPECIFICS, OVERUSE, AVOIDED = 12.0, 12.0, 8.0, 8.0
WEIGHTS = {"strong": 1.0, "standard": 0.92, "weak": 0.35, "none": 0.0}
QUANTIFIED_AT, TOOLS_AT, PASSIVE_MOST, PASSIVE_RATE = 0.6, 0.15, 0.25, 0.5
FILLER_FULL, PRONOUN_FULL, FILLER_SHARE, PRONOUN_SHARE = 16.0, 8.0, 0.6, 0.4
LENGTH_IDEAL, LENGTH_HARD = (12, 55), (8, 80)
OVERUSED_FROM = 3


def kept_lines(lines: DataFrame) -> DataFrame:
    """Lines that hold more than a glyph."""
    return lines.where(~tx.is_stray(F.col("text")))


def word_counts(lines: DataFrame) -> DataFrame:
    return kept_lines(lines).groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.sum(tx.word_count(F.col("text"))).alias("n_words"))


def numbers(lines: DataFrame) -> DataFrame:
    """Per document the lines, those with a quantity, their share, and the quantities."""
    n = tx.number_count(F.col("text"))
    return kept_lines(lines).select("doc_id", n.alias("n")).groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count_if(F.col("n") > 0).alias("n_quantified"), F.avg((F.col("n") > 0).cast("double")).alias("share"), F.sum("n").alias("n_numbers"))


def bullets(lines: DataFrame) -> DataFrame:
    """Lines as bullets, ``body`` without its glyph: lists and credentials are none."""
    body = F.col("body")
    fit = tx.computed(lines, body=tx.body_text(F.col("text"))).where(~tx.is_bare(body) & ~tx.is_list(body) & ~tx.is_credential(body))
    return tx.computed(fit, sp=tx.spaced(body))


def specifics(lines: DataFrame) -> DataFrame:
    """Half for quantities, half for tools, less for passive voice."""
    body = F.col("body")
    each = bullets(lines).select("doc_id", (tx.number_count(body, F.col("sp")) > 0).cast("double").alias("q"), (F.size(tx.tools(body)) > 0).cast("double").alias("t"), tx.is_passive(body, F.col("sp")).cast("double").alias("p"))
    shares = each.groupBy("doc_id").agg(F.avg("q").alias("quantified"), F.avg("t").alias("tooled"), F.avg("p").alias("passive"))
    raw = 0.5 * F.least(F.lit(1.0), F.col("quantified") / QUANTIFIED_AT) + 0.5 * F.least(F.lit(1.0), F.col("tooled") / TOOLS_AT)
    less = F.least(F.lit(PASSIVE_MOST), F.col("passive") * PASSIVE_RATE)
    return shares.withColumn("points", F.greatest(F.lit(0.0), F.least(F.lit(SPECIFICS), SPECIFICS * (raw - less))))


def poor_sections(lines: DataFrame, by: str) -> DataFrame:
    """Of the bullets of a group (column ``by``) how many there are and how many hold no quantity, for groups where fewer than ``QUANTIFIED_AT`` of them do."""
    each = bullets(lines).select(by, (tx.number_count(F.col("body")) == 0).alias("m"))
    return each.groupBy(by).agg(F.count("*").alias("total"), F.count_if("m").alias("missing")).where(F.col("total") - F.col("missing") < QUANTIFIED_AT * F.col("total"))


def avoided(lines: DataFrame) -> DataFrame:
    """Filler words and pronouns of a document, and what they cost."""
    text = F.col("text")
    each = lines.withColumn("sp", tx.spaced(text)).select("doc_id", F.size(tx.words(text)).alias("w"), tx.filler_count(text, F.col("sp")).alias("f"), tx.pronoun_count(text, F.col("sp")).alias("p"))
    sums = each.groupBy("doc_id").agg(F.sum("w").alias("n_words"), F.sum("f").alias("n_filler"), F.sum("p").alias("n_pronouns"))
    lost = AVOIDED * F.least(F.lit(1.0), FILLER_SHARE * F.least(F.lit(1.0), F.col("n_filler") / FILLER_FULL) + PRONOUN_SHARE * F.least(F.lit(1.0), F.col("n_pronouns") / PRONOUN_FULL))
    state = F.when(F.col("n_pronouns") > 0, "Needs Work!").when(F.col("n_filler") > 0, "On Track!").otherwise("Good Job!")
    return sums.withColumn("points", AVOIDED - lost).withColumn("status", state)


def tiers(lines: DataFrame, standard: list[str]) -> DataFrame:
    """``doc_id``, ``line_no``, ``tier``, ``token`` (the word that tells); ``detail`` marks lines that state a fact."""
    body = F.col("body")
    each = bullets(lines).select("doc_id", "line_no", tx.verb(body, standard).alias("v"), tx.is_detail(body).alias("detail"))
    return each.select("doc_id", "line_no", "v.tier", "v.token", "detail")


def action(lines: DataFrame, standard: list[str]) -> DataFrame:
    """The mean weight of how a document's lines open; detail lines count only if there are no others."""
    weight = F.create_map(*(F.lit(x) for pair in WEIGHTS.items() for x in pair))[F.col("tier")]
    each = tiers(lines, standard).withColumn("weight", weight)
    counts = [F.count_if(F.col("tier") == t).alias(f"n_{t}") for t in WEIGHTS]
    out = each.groupBy("doc_id").agg(*counts, F.coalesce(F.avg(F.when(~F.col("detail"), F.col("weight"))), F.avg("weight")).alias("mean_weight"))
    return out.withColumn("points", ACTION * F.col("mean_weight"))


def passive(lines: DataFrame) -> DataFrame:
    return kept_lines(lines).select("doc_id", tx.is_passive(F.col("text")).alias("p")).groupBy("doc_id").agg(F.count_if("p").alias("n_passive"), F.avg(F.col("p").cast("double")).alias("share"))


def tools_named(lines: DataFrame) -> DataFrame:
    each = lines.select("doc_id", F.explode(tx.tools(F.col("text"))).alias("tool"))
    return each.groupBy("doc_id", "tool").agg(F.count("*").alias("n_lines"))


def flags(lines: DataFrame, standard: list[str]) -> DataFrame:
    """What to mend in a bullet, in order; bullets without a flag stay out."""
    body = F.col("body")
    sp = F.col("sp")
    made = {"n": F.size(tx.found(body, tx.LENGTH_TOKEN)).cast("int"), "v": tx.verb(body, standard), "p": tx.is_passive(body, sp), "q": tx.number_count(body, sp) == 0, "t": F.size(tx.tools(body)) == 0, "a": tx.avoided(body, sp)}
    each = tx.computed(bullets(lines).select("doc_id", "line_no", "body", "sp"), **made)
    n, count = F.col("n"), F.col("n").cast("string")
    (low, high), (least, most) = LENGTH_IDEAL, LENGTH_HARD
    marks = F.array(
        F.when(F.col("v.tier") == "none", "no action verb").when(F.col("v.tier") == "weak", F.concat(F.lit("weak verb “"), F.col("v.token"), F.lit("”"))),
        F.when(F.col("p"), "passive voice"), F.when(F.col("q"), "no quantification"), F.when(F.col("t"), "no tool or method named"),
        F.when(F.size("a") > 0, F.concat(F.lit("filler: "), F.array_join(F.slice("a", 1, 4), ", "))),
        F.when(n < least, F.concat(F.lit("too short ("), count, F.lit(" words)"))).when(n > most, F.concat(F.lit("too long ("), count, F.lit(" words)"))).when(~n.between(low, high), F.concat(F.lit("length "), count, F.lit(f" words (aim {low}-{high})"))),
    )
    return each.select("doc_id", "line_no", n.alias("n_tokens"), F.array_join(F.array_compact(marks), "; ").alias("flags")).where("flags <> ''")


def overused(lines: DataFrame, verbs: list[str]) -> DataFrame:
    """Words taken together by their shortest base that a document uses three times or more, half the time as a verb's past or participle: ``doc_id``, ``label``, ``total``, ``rank``.

    ``verbs`` are those that count; words that may be a strong verb don't. Two
    counts, first by form, then by base; the forms of a word are found once for
    each document that has it.
    """
    # a line without the beginning of any form has none
    forms = {v[: max(2, len(v) - 1)][:4] for v in verbs} | {past for past, v in lx.IRREGULAR_PAST.items() if v in verbs}
    may = F.col("text").rlike("(?i)" + tx.any_of(sorted(forms)))
    tok = lines.where(may).select("doc_id", F.explode(tx.words(F.col("text"))).alias("w")).select("doc_id", F.lower("w").alias("w"))
    tok = tok.where((F.length("w") >= 4) & ~F.col("w").isin(*lx.STOPWORDS, *lx.PRONOUNS, *lx.ARTICLES)).groupBy("doc_id", "w").agg(F.count("*").alias("n"))
    tok = tok.where(tx.form_of(F.col("w"), verbs) & ~tx.form_of(F.col("w"), lx.STRONG_VERBS)).withColumn("forms", tx.lemmas(F.col("w")))
    key = F.coalesce(F.array_min(F.transform(F.filter("forms", lambda x: F.length(x) >= 4), lambda x: F.struct(F.length(x).alias("n"), x.alias("x"))))["x"], F.col("w"))
    inflected = F.col("w").rlike("(ed|ing)$") | F.col("w").isin(*lx.IRREGULAR_PAST)
    shown = F.concat(F.upper(F.substring("w", 1, 1)), F.substring("w", 2, 1000))
    by_key = tok.groupBy("doc_id", key.alias("base")).agg(F.sum("n").alias("total"), F.sum(F.when(inflected, F.col("n")).otherwise(0)).alias("inflected"), F.array_join(F.array_sort(F.collect_set(shown)), "/").alias("label"))
    flagged = by_key.where((F.col("total") >= OVERUSED_FROM) & (F.col("inflected") * 2 >= F.col("total")))
    return flagged.select("doc_id", "label", "total", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("total"), "label")).alias("rank"))


def contacts(lines: DataFrame) -> DataFrame:
    text = F.col("text")
    each = lines.select("doc_id", *(F.size(tx.found(text, p)).alias(n) for n, p in (("n_email", tx.EMAIL), ("n_phone", tx.PHONE), ("n_url", tx.URL))), text.rlike(tx.REFERENCES).alias("r"))
    return each.groupBy("doc_id").agg(*(F.sum(n).alias(n) for n in ("n_email", "n_phone", "n_url")), F.bool_or("r").alias("asks_references")).where((F.col("n_email") + F.col("n_phone") + F.col("n_url") > 0) | F.col("asks_references"))


def endings(lines: DataFrame) -> DataFrame:
    """Whether a document ends its lines of four words or more in one way: all with a full stop or its kin, or none."""
    each = kept_lines(lines).where(tx.word_count(F.col("text")) >= 4).select("doc_id", F.col("text").rlike(r"[.!?]\s*$").alias("e"))
    return each.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count_if("e").alias("n_ended"), (F.bool_and("e") | ~F.bool_or("e")).alias("passed"))
