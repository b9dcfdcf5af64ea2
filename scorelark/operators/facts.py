"""All that scoring asks of a document's lines, in one pass and one shuffle.

Each line turns into numbers and flags where it is read; a document's lines are
in one partition, so what is shuffled is a row for each heading of a document,
then a row a document. Lines are those of ``structure.placed_lines``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelark.functions import lexicons as lx
from scorelark.functions import text as tx
from scorelark.operators import structure
from scorelark.rules import Rules

# ---- fixed values ----
EXPECTED_LIKE = r"(?i)\b(?:incoming|expected|anticipated|present|current)\b"
DATE_BEARING = r"(?i)\b(?:19|20)\d{2}\b|\b(?:jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec)(?:uary|ruary|ch|il|e|y|ust|tember|ober|ember)?\.?\b"
MONTH_YEAR_OK = r"(?i)\b(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec|january|february|march|april|june|july|august|september|october|november|december)\.?\s+(?:19|20)\d{2}\b"
GPA = r"(?i)\bGPA\b[^\n]{0,28}"
GPA_SCALE = r"(?i)/|out\s+of"
DEGREE = r"(?i)\b(?:B\.?A|B\.?S|B\.?Sc|H\.?B\.?Sc|M\.?A|M\.?S|M\.?Sc|M\.?Eng|MBA|Ph\.?D|Bachelor|Master|Doctor|Associate)\b"
DEGREE_SHORT = r"\b(?:B\.?A|B\.?S|B\.?Sc|H\.?B\.?Sc|M\.?A|M\.?S|M\.?Sc|M\.?Eng|Ph\.?D)\.?\b"
ROUND_GLYPHS = "•●▪"
MINOR_WORDS = "and of in the a an for to or &".split()
# ---- end of the fixed values ----

def heading_case(text: Column) -> Column:
    """caps, title (minor words aside) or other."""
    words = text.rlike("[A-Za-z&/]")
    small = F.size(F.filter(F.regexp_extract_all(text, F.lit("[A-Za-z&/]+"), F.lit(0)), lambda w: ~w.rlike("^[A-Z]") & ~F.lower(w).isin(*MINOR_WORDS)))
    return F.when(~words | ~text.rlike(r"\p{L}"), "other").when(tx.is_all_caps(text), "caps").when(small == 0, "title").otherwise("other")


def alignment(x0: Column, x1: Column, left: Column, right: Column) -> Column:
    """left, right, center or indented, by the gaps to the edges of the page's content."""
    before, after = x0 - left, right - x1
    centred = F.abs(before - after) <= F.greatest(F.lit(12.0), 0.06 * (before + after))
    return F.when(left.isNull() | (before <= 6), "left").when(after <= 6, "right").when(centred, "center").otherwise("indented")


def date_texts(text: Column) -> Column:
    """All that a line's dates say, put together: ranges, months with a year, and years if there is neither."""
    without = F.regexp_replace(text, structure.RANGE, " ")
    ranges, months = tx.found(text, structure.RANGE), tx.found(without, structure.MONTH_YEAR)
    return F.array_join(F.concat(ranges, months), " ")


def skipped(names) -> Column:
    return F.coalesce(F.col("canonical"), F.lit("")).isin(*names)


def overused_tokens(body: Column) -> Column:
    """The words of a text that may be forms of the verbs that count as overused."""
    may = body.rlike("(?i)analy|provid|develop|support|buil")
    low = tx.words(body)
    fit = lambda w: (F.length(w) >= 4) & ~F.lower(w).isin(*lx.STOPWORDS, *lx.PRONOUNS, *lx.ARTICLES) & tx.form_of(w, lx.COMMON_VERBS) & ~tx.form_of(w, lx.STRONG_VERBS)
    return F.when(may, F.filter(low, fit)).otherwise(F.array().cast("array<string>"))


def overused(tokens: Column, rules: Rules) -> Column:
    """Words taken together by their shortest base: (``label``, ``n``), the commonest first; those used often enough, and half the time as a past or participle."""

    def key(w: Column) -> Column:
        bases = F.filter(tx.lemmas(w), lambda x: F.length(x) >= 4)
        return F.coalesce(F.array_min(F.transform(bases, lambda x: F.struct(F.length(x).alias("n"), x.alias("x"))))["x"], F.lower(w))

    def capital(w: Column) -> Column:
        return F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, F.lit(2), F.length(w))))

    def groups(keyed: Column) -> Column:
        def group(k: Column) -> Column:
            own = F.filter(keyed, lambda x: x["k"] == k)
            past = F.filter(own, lambda x: x["low"].rlike("(?:ed|ing)$") | x["low"].isin(*lx.IRREGULAR_PAST))
            return F.struct((-F.size(own)).alias("less"), F.array_join(F.array_sort(F.array_distinct(F.transform(own, lambda x: x["w"]))), "/").alias("label"), F.size(own).alias("n"), F.size(past).alias("past"))

        every = F.transform(F.array_distinct(F.transform(keyed, lambda x: x["k"])), group)
        return F.array_sort(F.filter(every, lambda g: (g["n"] >= int(rules["impact.overuse_rules.flag_at_occurrences"])) & (g["past"] * 2 >= g["n"])))

    made = tx.bound(F.transform(tokens, lambda w: F.struct(key(w).alias("k"), capital(w).alias("w"), F.lower(w).alias("low"))), groups)
    empty = F.array().cast("array<struct<less:int,label:string,n:int,past:int>>")
    return F.transform(F.when(F.size(tokens) > 0, made).otherwise(empty), lambda g: F.struct(g["label"].alias("label"), g["n"].alias("n")))


def _plain(terms) -> list[str]:
    return [t for t in terms if t.isascii() and t.isalpha()]


def plain_hits(low: Column, terms: list[str]) -> Column:
    """The terms of letters alone that a lower-case text holds between other characters than letters."""
    return F.array_intersect(F.split(low, "[^a-z]+"), F.array(*map(F.lit, _plain(terms))).cast("array<string>"))


def term_hits(low: Column, terms: list[str], hits: Column | None = None) -> Column:
    """The distinct terms that a lower-case text holds: those of letters alone between other characters than letters, those with a blank or a stroke anywhere.

    ``hits``: ``plain_hits`` of these and other terms, if they are there already; most lines have none.
    """
    plain, none = _plain(terms), F.array().cast("array<string>")
    parts = []
    if plain:
        own = F.array(*map(F.lit, plain))
        parts.append(plain_hits(low, terms) if hits is None else F.when(F.size(hits) > 0, F.array_intersect(hits, own)).otherwise(none))
    inside = [F.when(low.contains(t), t) for t in terms if " " in t or "/" in t]
    between = [F.when(low.rlike(rf"(?<![a-z]){tx.any_of([t])}(?![a-z])"), t) for t in terms if t not in plain and " " not in t and "/" not in t]
    if inside or between:
        parts.append(F.array_compact(F.array(*inside, *between)))
    return F.array_distinct(F.concat(*parts)) if parts else F.array().cast("array<string>")


def features(lines: DataFrame, standard: list[str], terms: dict[str, list[str]], rules: Rules, evidence: bool = False) -> DataFrame:
    """``lines`` with the features of each; ``evidence`` keeps the words that findings show."""
    skip = rules["impact.bullets.skip_sections"]
    base = tx.computed(lines, body=tx.body_text(F.col("text")))
    body = F.col("body")
    unit = F.col("role").isin("header", "bullet", "line")
    out = base.withColumns({
        "is_unit": unit, "is_detail": tx.is_detail(body),
        "is_scored": (F.col("role") == "bullet") & ~skipped(skip) & ~tx.is_list(body) & ~tx.is_credential(body),
        "spaced": tx.spaced(body), "n_counted": tx.word_count(body), "n_text": tx.word_count(F.col("text")), "marked": (F.col("role") == "bullet") | F.coalesce(F.col("is_bullet"), F.lit(False)) & (F.col("section") > 0),
    })
    when = lambda cond, value, other: F.when(cond, value).otherwise(other)
    scored, said, sp = F.col("is_scored"), F.col("is_unit"), F.col("spaced")
    own = {
        "verb": F.when(scored, tx.verb(body, standard)), "n_numbers": when(scored, tx.number_count(body, sp), 0), "tools": F.when(scored, tx.tools(body)),
        "passive": when(scored, tx.is_passive(body, sp), False), "n_filler": when(said, tx.filler_count(body, sp), 0), "n_pronouns": when(said, tx.pronoun_count(body, sp), 0),
        "over": F.when(said & ~skipped(rules["impact.overuse_rules.skip_sections"]), overused_tokens(body)),
        "ended": body.rlike(r"[.!?]\s*$"),
        "said": F.when((F.col("section") > 0) & (F.col("role") != "heading") & ~skipped(rules["competencies.skip_sections"]) & ~((F.col("role") == "header") & tx.is_date_only(body)), F.lower(body)),
        "dates": F.when(F.col("role") == "header", date_texts(F.col("text"))),
        "odd_date": when((F.col("section") > 0) & (F.col("role") != "heading"), F.col("text").rlike(DATE_BEARING) & F.col("text").rlike(EXPECTED_LIKE) & ~F.col("text").rlike(MONTH_YEAR_OK), False),
    }
    out = out.withColumns(own)
    out = tx.computed(out, plain=F.when(F.col("said").isNotNull(), plain_hits(F.col("said"), [t for ts in terms.values() for t in ts])))
    return out.withColumns({f"terms_{c}": F.when(F.col("said").isNotNull(), term_hits(F.col("said"), ts, F.col("plain"))) for c, ts in terms.items()})


def _some(condition, value) -> Column:
    """The values where the condition holds, as an array; other lines add nothing to it."""
    return F.collect_list(F.when(condition, value))


def document_facts(lines: DataFrame, standard: list[str], terms: dict[str, list[str]], rules: Rules) -> DataFrame:
    """One row a document. ``lines`` have to keep ``blob``, ``name`` and ``structure.GEOMETRY``."""
    each = features(lines, standard, terms, rules)
    scored, first = F.col("is_scored"), F.col("first_of")
    quick = lambda c: F.count_if(c)
    header = F.col("role") == "header"
    bullets = F.col("marked")
    months = lambda names: F.coalesce(F.lower("dates").rlike(rf"(?<![a-z]){tx.any_of(names)}(?![a-z])"), F.lit(False))
    degree = first & (F.col("canonical") == "education") & header & F.col("body").rlike(DEGREE)
    style = F.struct(F.round("size", 1).alias("size"), F.col("first_bold").alias("bold"), F.col("first_italic").alias("italic"))
    heading = F.col("role") == "heading"
    tier = F.col("verb.tier")
    facts = {
        "n_bullets": quick(scored), "n_plain": quick(scored & ~F.col("is_detail")),
        **{f"n_{t}": quick(scored & ~F.col("is_detail") & (tier == t)) for t in ("strong", "standard", "weak", "none")},
        **{f"all_{t}": quick(scored & (tier == t)) for t in ("strong", "standard", "weak", "none")},
        "n_quantified": quick(scored & (F.col("n_numbers") > 0)), "n_tooled": quick(scored & (F.size("tools") > 0)), "n_passive": quick(scored & F.col("passive")),
        "n_units": quick(F.col("is_unit")), "n_over_units": quick(F.col("over").isNotNull()), "n_filler": F.sum("n_filler"), "n_pronouns": F.sum("n_pronouns"),
        "over": F.flatten(_some(F.size("over") > 0, F.col("over"))),
        "n_marked": quick(bullets), "indents": F.collect_set(F.when(bullets, F.col("indent"))), "odd_glyphs": F.max(bullets & (F.coalesce(F.col("glyph"), F.lit("")) != "") & ~F.col("glyph").isin(*ROUND_GLYPHS)),
        "n_prose": quick(bullets & (F.col("n_counted") >= 4)), "n_ended": quick(bullets & (F.col("n_counted") >= 4) & F.col("ended")),
        "listed_bullets": F.max(F.coalesce(F.col("is_bullet"), F.lit(False)) & F.coalesce(F.col("canonical"), F.lit("")).isin("skills", "coursework") & ~heading),
        "bad_month": F.max(header & ((F.col("dates") != "") | F.col("text").rlike(tx.YEAR)) & F.lower("text").rlike(structure.BAD_MONTH)), "odd_date": F.max("odd_date"),
        "full_month": F.max(months(lx.FULL_MONTHS)), "short_month": F.max(months(lx.ABBREVIATED_MONTHS)),
        "sizes": F.collect_set(F.when((F.col("n_counted") >= 4) & ~heading & (F.col("size") > 0), F.round("size", 1))),
        "references": F.max(F.col("text").rlike(tx.REFERENCES)),
        "n_heads": quick(heading), "n_unknown": quick(heading & F.col("canonical").isNull()), "canonicals": F.collect_set(F.when(heading, F.col("canonical"))),
        "thin_heads": quick(heading & (F.col("bold") < 0.5)), "italic_heads": quick(heading & F.coalesce(F.col("italic"), F.lit(False))),
        "cases": F.collect_set(F.when(heading, heading_case(F.col("raw_heading")))), "aligns": F.collect_set(F.when(heading, F.coalesce("align", F.lit("left")))),
        "gpa": F.min(F.when(first & (F.col("canonical") == "education") & ~heading & F.col("text").rlike(GPA), F.struct("seq", F.regexp_extract("text", GPA, 0).alias("text")))),
        "bad_degrees": quick(degree & F.col("body").rlike(DEGREE_SHORT)), "italic_degrees": quick(degree & F.coalesce(F.col("italic"), F.lit(False))), "degree_styles": F.collect_set(F.when(degree, style)),
        "title_styles": F.collect_set(F.when(first & (F.col("canonical") == "experience") & header & F.col("opens"), style)),
        "n_entries": quick(F.col("opens")), "n_words": F.coalesce(F.sum("n_text"), F.lit(0)), "n_lines": F.count("seq"),
        **{f"terms_{c}": F.flatten(_some(F.size(f"terms_{c}") > 0, F.col(f"terms_{c}"))) for c in terms},
        **{f"lines_{c}": quick(F.size(f"terms_{c}") > 0) for c in terms},
        "n_said": quick(F.col("said").isNotNull()),
    }
    whole = ["blob", "name", *structure.GEOMETRY]
    # first a row a heading of a document, as some rules look at sections by their headings
    by_head = each.groupBy("doc_id", "raw_heading").agg(*(c.alias(k) for k, c in facts.items()), *(F.first(k).alias(k) for k in whole))
    target = rules["impact.specifics_rules.quantified_bullet_target"]
    poor = (F.col("n_bullets") > 0) & (F.col("n_quantified") < target * F.col("n_bullets"))
    merged = {"poor": F.collect_list(F.when(poor, F.struct((F.col("n_quantified") - F.col("n_bullets")).alias("missing"), F.coalesce("raw_heading", F.lit("")).alias("heading"))))}
    for k in facts:
        if k in ("over", *(f"terms_{c}" for c in terms)):
            merged[k] = F.flatten(F.collect_list(k))
        elif k in ("indents", "sizes", "canonicals", "cases", "aligns", "degree_styles", "title_styles"):
            merged[k] = F.array_distinct(F.flatten(F.collect_list(k)))
        elif k == "gpa":
            merged[k] = F.min(k)
        elif k in ("odd_glyphs", "listed_bullets", "bad_month", "odd_date", "full_month", "short_month", "references"):
            merged[k] = F.coalesce(F.max(k), F.lit(False))
        else:
            merged[k] = F.sum(k)
    out = by_head.groupBy("doc_id").agg(*(c.alias(k) for k, c in merged.items()), *(F.first(k).alias(k) for k in whole))
    flagged = overused(F.col("over"), rules)
    return out.withColumn("poor", F.array_sort("poor")).withColumn("overused", flagged).drop("over")
