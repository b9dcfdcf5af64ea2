"""Structure: headings, sections, entries, dates.

A document is a row with the array of its lines, so its structure is found
within the row: no shuffle, and only documents that have a heading are folded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scorelark.functions import lexicons as lx
from scorelark.functions import text as tx

#: Letters by which a heading may be longer or shorter than the one that holds it, or that it holds.
NEAR = 6
ESSENTIAL_LOSS, UNKNOWN_LOSS, UNKNOWN_MOST, MANY_LOSS, MANY_FROM, SECTIONS_MOST = 4.5, 1.0, 2.0, 1.35, 9, 9.0
#: A line with its place and style; lines of plain texts have neither.
LINE = {
    "seq": "int", "page": "int", "text": "string", "x0": "double", "x1": "double", "top": "double", "bottom": "double", "size": "double",
    "max_size": "double", "bold": "double", "first_bold": "boolean", "first_italic": "boolean", "italic": "boolean", "is_bullet": "boolean",
    "glyph": "string", "indent": "double", "space_above": "double", "align": "string",
}
#: What is known of a document besides its lines.
GEOMETRY = {"n_pages": "int", "last_fill": "double", "n_images": "int", "least_margin": "double", "two_column": "boolean", "n_warnings": "int"}
HEADING_CHARS, HEADING_WORDS, BANNER, STYLED, KNOWN_WORDS, EMPHASISED_WORDS = 60, 7, 1.35, 0.6, 4, 5
ENTRY_HEADERS, RESIDUE, FIRST_CHARS, NAME_CHARS = 6, 3, 400, 80

_HEADINGS = [(h, c) for c, hs in lx.SECTIONS.items() for h in hs]
#: Exact headings (of one in two sections the last counts) in the order in which they first occur, and headings without blanks (the first counts).
EXACT = dict(_HEADINGS)
SQUASHED = {h.replace(" ", ""): c for h, c in reversed(_HEADINGS)}


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in pairs.items() for x in pair))


def canonical_of(heading: Column) -> Column:
    """The section that a heading names: by its key, by its key without blanks, or by the first heading that holds it or that it holds, nearly as long; else null."""

    def by(key: Column) -> Column:
        known = F.array(*(F.struct(F.lit(h).alias("h"), F.lit(c).alias("c")) for h, c in EXACT.items()))
        near = F.filter(known, lambda x: (x["h"].contains(key) | key.contains(x["h"])) & (F.abs(F.length(x["h"]) - F.length(key)) <= NEAR))
        return F.coalesce(F.try_element_at(_map(EXACT), key), F.try_element_at(_map(SQUASHED), tx.squashed(key)), F.when(F.length(key) > 0, F.get(near, F.lit(0))["c"]))

    return tx.bound(tx.heading_key(heading), by)


def is_known(heading: Column) -> Column:
    """Whether the list of headings has this one, with or without blanks."""
    return tx.bound(tx.heading_key(heading), lambda key: key.isin(*EXACT) | tx.squashed(key).isin(*SQUASHED))


def canonical(headings: DataFrame) -> DataFrame:
    """``doc_id``, ``heading`` to ``canonical``."""
    return headings.select("doc_id", "heading", canonical_of(F.col("heading")).alias("canonical"))


def ampersand(heading: Column) -> Column:
    """How a heading is better written, with an ampersand; else null."""
    squashed = {"".join(ch for ch in k if ch.isalnum() or ch == "&"): v for k, v in lx.AMPERSAND.items()}
    return tx.bound(tx.heading_key(heading), lambda key: F.coalesce(F.try_element_at(_map(lx.AMPERSAND), key), F.try_element_at(_map(squashed), tx.squashed(key))))


def looks_like_heading(line: Column, body_size: Column) -> Column:
    """Whether a line (a struct of ``LINE``) is a heading: short, no bullet, nothing personal in it, and known or set off from the body."""
    text = tx.stripped(line["text"])
    n = tx.word_count(tx.body_text(text))
    size, sized = F.coalesce(line["size"], F.lit(0.0)), body_size > 0
    large = sized & (size >= body_size + STYLED)
    bold = F.coalesce(line["bold"], F.lit(0.0)) >= 0.6
    caps = tx.is_all_caps(text)
    short = (F.length(text) > 0) & (F.length(text) <= HEADING_CHARS)
    # the first condition turns nearly all lines of a plain text away
    fit = ~F.coalesce(line["is_bullet"], F.lit(False)) & (n <= HEADING_WORDS) & ~text.rlike("[.,;]$") & ~text.rlike(tx.EMAIL) & ~text.rlike(tx.PHONE) & ~text.rlike(tx.URL)
    known = is_known(text)
    listed = known & (caps | bold | large | (n <= KNOWN_WORDS))
    set_off = ~known & ~(sized & (size >= body_size * BANNER)) & (bold | large) & caps & (n <= EMPHASISED_WORDS) & ~text.rlike("[0-9]")
    known_set_off = known & (bold | large) & caps & (n <= EMPHASISED_WORDS) & ~text.rlike("[0-9]")
    return F.when(short, fit & (listed | set_off | known_set_off)).otherwise(F.lit(False))


def modal(values: Column) -> Column:
    """The commonest value of an array, the smallest on a tie; 0 for an empty one."""
    counted = F.transform(F.array_distinct(values), lambda v: F.struct(F.size(F.filter(values, lambda x: x == v)).alias("n"), (-v).alias("v")))
    return F.coalesce(-F.array_max(counted)["v"], F.lit(0.0))


def body_size(lines: Column) -> Column:
    """The commonest size of lines of four words or more; of all lines if there are none; 0 for lines without a size."""
    sized = F.filter(lines, lambda x: x["size"] > 0)
    long = F.filter(sized, lambda x: tx.word_count(tx.body_text(x["text"])) >= 4)
    of = lambda xs: F.transform(xs, lambda x: F.round(x["size"], 1))
    return F.when(F.size(sized) == 0, F.lit(0.0)).when(F.size(long) > 0, modal(of(long))).otherwise(modal(of(sized)))


def plain_documents(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``doc_id``, ``lines`` and the columns of ``GEOMETRY`` of plain texts: lines that aren't blank, on one page, without a style."""
    split = F.filter(F.transform(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n"), tx.stripped), lambda t: t != "")
    blank = {k: F.lit(None).cast(t).alias(k) for k, t in LINE.items()}
    made = {"page": F.lit(1), "size": F.lit(0.0), "max_size": F.lit(0.0), "bold": F.lit(0.0), "first_bold": F.lit(False), "first_italic": F.lit(False), "italic": F.lit(False), "indent": F.lit(0.0), "space_above": F.lit(0.0), "align": F.lit("left")}

    def line(t: Column, k: Column) -> Column:
        own = made | {"seq": k, "text": t, "is_bullet": tx.is_bullet(t), "glyph": tx.glyph(t)}
        return F.struct(*(own[name].alias(name) if name in own else blank[name] for name in LINE))

    whole = {"n_pages": F.lit(1), "last_fill": F.lit(0.0), "n_images": F.lit(0), "least_margin": F.lit(None), "two_column": F.lit(False), "n_warnings": F.lit(0)}
    return docs.select("doc_id", F.transform(split, line).alias("lines"), *(whole[k].cast(t).alias(k) for k, t in GEOMETRY.items()))


def _starts(text: Column) -> Column:
    """Whether a header line has a date and three words besides: then it opens an entry."""
    ranges, months = text.rlike(RANGE), text.rlike(MONTH_YEAR)
    without = F.when(ranges | months, F.regexp_replace(F.regexp_replace(text, RANGE, " "), MONTH_YEAR, " ")).otherwise(F.regexp_replace(text, tx.YEAR, " "))
    return (ranges | months | text.rlike(tx.YEAR)) & (F.size(F.regexp_extract_all(without, F.lit("[A-Za-z]+"), F.lit(0))) >= RESIDUE)


_STATE = "struct<section:int,entry:int,headers:int,bulleted:boolean,bold:double,out:array<struct<section:int,entry:int,role:string,opens:boolean>>>"


def _folded(lines: Column) -> Column:
    """For each line (with ``heading``) its section, its entry within it, its role, and whether it opens the entry."""

    def state(section, entry, headers, bulleted, bold, out, role, opens) -> Column:
        place = F.struct(section.alias("section"), entry.alias("entry"), role.alias("role"), opens.alias("opens"))
        return F.struct(section.cast("int").alias("section"), entry.cast("int").alias("entry"), headers.cast("int").alias("headers"), bulleted.alias("bulleted"), bold.alias("bold"), F.concat(out, F.array(place)).alias("out")).cast(_STATE)

    def step(at: Column, x: Column) -> Column:
        no, none = F.lit(False), F.lit(0)
        keep = (at["headers"], at["bulleted"], at["bold"], at["out"])
        bold = F.coalesce(x["bold"], F.lit(0.0))
        opens = (at["entry"] == 0) | at["bulleted"] | (at["headers"] >= ENTRY_HEADERS) | _starts(x["text"]) | (bold >= 0.5) & (bold >= at["bold"] - 0.05)
        first = F.greatest(at["entry"], F.lit(1))
        return (
            F.when(x["heading"], state(at["section"] + 1, none, none, no, F.lit(0.0), at["out"], F.lit("heading"), no))
            .when(at["section"] == 0, state(at["section"], none, *keep, F.lit("contact"), no))
            .when(tx.is_stray(x["text"]), state(at["section"], at["entry"], *keep, F.lit("line"), no))
            .when(F.coalesce(x["is_bullet"], no), state(at["section"], first, at["headers"], F.lit(True), at["bold"], at["out"], F.lit("bullet"), at["entry"] == 0))
            .when(opens, state(at["section"], at["entry"] + 1, F.lit(1), no, bold, at["out"], F.lit("header"), F.lit(True)))
            .otherwise(state(at["section"], at["entry"], at["headers"] + 1, at["bulleted"], at["bold"], at["out"], F.lit("header"), no))
        )

    start = F.struct(F.lit(0).alias("section"), F.lit(0).alias("entry"), F.lit(0).alias("headers"), F.lit(False).alias("bulleted"), F.lit(0.0).alias("bold"), F.array().alias("out")).cast(_STATE)
    return F.aggregate(lines, start, step, lambda at: at["out"])


def structured(documents: DataFrame, loose: bool = False, headings: bool = True) -> DataFrame:
    """``documents`` with ``heads`` (``raw`` and ``canonical`` of each section), ``places`` (see ``_folded``), ``body`` (the body's size),
    ``blob`` (the contact block, else the first characters) and ``name``.

    ``loose``: a document without a heading is one section of bullets; otherwise all of its lines are its contact block.
    Without ``headings`` none is looked for.
    """
    lines, no_heads = F.col("lines"), F.array().cast("array<struct<raw:string,canonical:string>>")
    role = lambda x: F.when(tx.is_stray(x["text"]), "line").otherwise("bullet") if loose else F.lit("contact")
    alone = lambda x: F.struct(F.lit(1 if loose else 0).alias("section"), F.lit(1 if loose else 0).alias("entry"), role(x).alias("role"), F.lit(False).alias("opens"))
    if not headings:
        plain = documents.withColumns({"body": F.lit(0.0), "lines": F.transform("lines", lambda x: x.withField("heading", F.lit(False))), "heads": no_heads})
        return _with_contact(plain.withColumn("places", F.transform("lines", alone)))
    sized = documents.withColumn("body", body_size(lines))
    flags = F.transform(lines, lambda x: looks_like_heading(x, F.col("body")))
    flagged = sized.withColumn("__flags", flags)
    flagged = flagged.withColumn("lines", F.transform("lines", lambda x, k: x.withField("heading", F.get("__flags", k))))
    any_heading = F.exists("__flags", lambda x: x)
    heads = F.when(any_heading, F.transform(F.filter("lines", lambda x: x["heading"]), lambda x: F.struct(tx.stripped(x["text"]).alias("raw"), canonical_of(x["text"]).alias("canonical"))))
    heads = F.coalesce(heads, no_heads)
    return _with_contact(flagged.withColumn("places", F.when(any_heading, _folded(F.col("lines"))).otherwise(F.transform("lines", alone))).withColumn("heads", heads).drop("__flags"))


def _with_contact(out: DataFrame) -> DataFrame:
    """With the contact block (or the first characters) and the name in it."""
    contact = F.filter(F.transform("lines", lambda x, k: F.when(F.get("places", k)["role"] == "contact", x.withField("k", k))), lambda x: x.isNotNull())
    out = out.withColumn("__contact", contact)
    texts = F.transform("__contact", lambda x: x["text"])
    blob = F.when(F.size("__contact") > 0, F.array_join(texts, " ")).otherwise(F.substring(F.array_join(F.transform("lines", lambda x: x["text"]), "\n"), 1, FIRST_CHARS))
    best = F.array_max(F.transform("__contact", lambda x: F.struct(F.coalesce(x["max_size"], F.lit(0.0)).alias("size"), F.coalesce(x["bold"], F.lit(0.0)).alias("bold"), (-x["seq"]).alias("seq"), x["text"].alias("text"))))["text"]
    name = F.substring(tx.stripped(F.regexp_replace(F.regexp_replace(tx.stripped(best), tx.EMAIL, ""), "[|•·]+", " ")), 1, NAME_CHARS)
    return out.withColumn("blob", blob).withColumn("name", F.coalesce(name, F.lit(""))).drop("__contact")


def placed_lines(found: DataFrame, *keep: str) -> DataFrame:
    """One row a line of ``structured`` documents: ``doc_id``, ``keep``, the line's fields, ``heading``, ``section``, ``entry``, ``role``, ``opens``, ``raw_heading``, ``canonical``, and whether its section is the first of its kind (``first_of``)."""
    each = found.select("doc_id", *keep, "heads", F.explode_outer(F.arrays_zip("lines", "places")).alias("x"))
    head = F.get("heads", F.col("section") - 1)
    out = each.select("doc_id", *keep, "heads", "x.lines.*", "x.places.*")
    first = F.array_position(F.transform("heads", lambda h: F.coalesce(h["canonical"], F.lit(""))), F.coalesce(head["canonical"], F.lit("")))
    return out.withColumns({"raw_heading": head["raw"], "canonical": head["canonical"], "first_of": first == F.col("section")}).drop("heads")


def essential(sections: DataFrame) -> DataFrame:
    """Points for having the sections that belong (``doc_id``, ``canonical``; null: a heading that nothing knows)."""
    has = lambda *names: F.bool_or(F.coalesce(F.col("canonical").isin(*names), F.lit(False)))
    out = sections.groupBy("doc_id").agg(has("education").alias("education"), has(*lx.EXPERIENCE_CLASS).alias("experience"), has(*lx.EXTRACURRICULAR).alias("extracurricular"), F.count_if(F.col("canonical").isNull()).alias("n_unknown"), F.count("*").alias("n_sections"))
    lost = F.when(~F.col("education"), ESSENTIAL_LOSS).otherwise(0.0) + F.when(~F.col("experience"), ESSENTIAL_LOSS).otherwise(0.0)
    lost = lost + F.least(F.lit(UNKNOWN_MOST), UNKNOWN_LOSS * F.col("n_unknown")) + F.when(F.col("n_sections") >= MANY_FROM, MANY_LOSS).otherwise(0.0)
    return out.withColumn("points", F.greatest(F.lit(0.0), SECTIONS_MOST - lost)).withColumn("extra_points", F.when(F.col("extracurricular"), 6.0).otherwise(0.0))


def html_lines(pages: DataFrame) -> DataFrame:
    """``doc_id``, ``line_no``, ``tag``, ``text`` of the headings, paragraphs and list items of web pages."""
    blocks = F.posexplode(F.regexp_extract_all("html", F.lit(r"(?is)<(?:h[1-6]|p|li)(?:\s[^>]*)?>[^<]*"), F.lit(0)))
    each = pages.select(F.col("page_id").alias("doc_id"), blocks.alias("line_no", "b"))
    return each.select("doc_id", "line_no", F.lower(F.regexp_extract("b", r"^<([A-Za-z0-9]+)", 1)).alias("tag"), F.trim(F.regexp_replace("b", r"^<[^>]*>", "")).alias("text"))


def filled(lines: DataFrame) -> DataFrame:
    """Every line with its section: headings open one, which lasts to the next; 0 is what stands before the first."""
    order = Window.partitionBy("doc_id").orderBy("line_no")
    return lines.withColumn("section", F.sum(F.col("tag").rlike("^h[1-6]$").cast("int")).over(order))


def section_sizes(lines: DataFrame) -> DataFrame:
    return filled(lines).groupBy("doc_id", "section").agg(F.count("*").alias("n_lines"), F.count_if(F.col("tag") == "li").alias("n_items"), F.min_by("text", "line_no").alias("heading"))


def entries(turns: DataFrame) -> DataFrame:
    """Entries of a sequence with roles: a header opens one if it is the first, or follows a bullet."""
    order = Window.partitionBy("doc_id").orderBy("seq")
    opens = (F.col("role") == "header") & (F.coalesce(F.lag("role").over(order), F.lit("bullet")) == "bullet")
    placed = turns.withColumn("opens", opens).withColumn("entry", F.sum(F.col("opens").cast("int")).over(order))
    return placed.groupBy("doc_id", "entry").agg(F.count_if(F.col("role") == "header").alias("n_headers"), F.count_if(F.col("role") == "bullet").alias("n_bullets"), F.min("seq").alias("first_seq"))


# ---- fixed values ----
_MONTH = "(?:" + "|".join([*lx.MONTHS, *lx.MONTHS_SHORT, "sept"]) + ")"
_PART = rf"(?:{_MONTH}\.?(?:\s*(?:19|20)\d{{2}})?|(?:19|20)\d{{2}})"
RANGE = rf"(?i){_PART}(?:\s*[-–—]\s*|\s+to\s+|\s+until\s+)(?:{_PART}|present|current|now|ongoing)"
MONTH_YEAR = rf"(?i)\b{_MONTH}\.?\s*(?:19|20)\d{{2}}\b"
PRESENT = r"(?i)\b(?:present|current|ongoing|now|to date)\b"
EXPECTED = r"(?i)\b(?:expected|anticipated|in progress)\b"
#: A month that is cut short in a way that isn't wanted.
BAD_MONTH = "(?<![a-z])" + tx.any_of(lx.BAD_MONTHS) + "(?![a-z])"
#: What a range should have between its parts, besides words.
SPACED_DASH = r"^\s[-–—]\s$"
# ---- end of the fixed values ----
FOREVER = 9999 * 12


def month_style(token: Column) -> Column:
    """full or abbreviated; null for May, which is spelled alike, and for what is no month."""
    low = F.regexp_replace(F.lower(token), r"^\.+|\.+$", "")
    return F.when(low.isin(*lx.FULL_MONTHS), "full").when(low.isin(*lx.ABBREVIATED_MONTHS), "abbrev")


def date_style(raw: Column) -> Column:
    """numeric, full-month (May counts as full), abbrev-month, year-only or other."""
    low = F.lower(raw)
    named = lambda names: low.rlike(rf"\b{tx.any_of(names)}\b")
    return F.when(low.rlike(r"\b(?:0?[1-9]|1[0-2])[/-](?:19|20)?\d{2}\b"), "numeric").when(named(lx.MONTHS), "full-month").when(named(lx.ABBREVIATED_MONTHS), "abbrev-month").when(low.rlike(tx.YEAR), "year-only").otherwise("other")


def _ordinal(part, default: int):
    month = F.lower(F.regexp_extract(part, rf"(?i)({_MONTH})", 1))
    index = F.create_map(*(F.lit(x) for k, m in enumerate(lx.MONTHS_SHORT, 1) for x in (m, k)))
    year = F.try_to_number(F.nullif(F.regexp_extract(part, r"((?:19|20)\d{2})", 1), F.lit("")), F.lit("9999")).cast("int")
    number = F.coalesce(F.try_element_at(index, F.substring(month, 1, 3)), F.lit(default))
    return F.when(part.rlike(PRESENT), FOREVER).otherwise(year * 12 + number), year


def date_spans(lines: DataFrame) -> DataFrame:
    """The dates of a line as months counted from year 0: ranges, else single months, else bare years. A start without a year has the end's.

    ``bad_abbreviation`` and ``expected`` are of the whole line; ``spaced`` says whether a range has blanks about its dash, or a word for it.
    """
    text = F.col("text")
    ranges, without = tx.found(text, RANGE), F.regexp_replace(text, RANGE, " ")
    singles = tx.found(without, MONTH_YEAR)
    years = F.when((F.size(ranges) == 0) & (F.size(singles) == 0), tx.found(text, tx.YEAR)).otherwise(F.array().cast("array<string>"))
    tagged = F.concat(F.transform(ranges, lambda x: F.struct(F.lit("range").alias("kind"), x.alias("raw"))), F.transform(singles, lambda x: F.struct(F.lit("month").alias("kind"), x.alias("raw"))), F.transform(years, lambda x: F.struct(F.lit("year").alias("kind"), x.alias("raw"))))
    each = lines.select("doc_id", "line_no", text.rlike(EXPECTED).alias("expected"), F.lower(text).rlike(BAD_MONTH).alias("bad_abbreviation"), F.explode(tagged).alias("d")).select("doc_id", "line_no", "expected", "bad_abbreviation", "d.*")
    split = r"\s*[-–—]\s*|\s+(?i:to|until)\s+"
    left = F.when(F.col("kind") == "range", F.get(F.split("raw", split), F.lit(0))).otherwise(F.col("raw"))
    right = F.when(F.col("kind") == "range", F.get(F.split("raw", split), F.lit(1))).otherwise(F.col("raw"))
    (_, left_year), (end, right_year) = _ordinal(left, 1), _ordinal(right, 12)
    start, _ = _ordinal(F.when(left_year.isNull() & right_year.isNotNull(), F.concat(left, F.lit(" "), right_year.cast("string"))).otherwise(left), 1)
    separator = F.regexp_extract("raw", r"(?i)(\s*[-–—]\s*|\s+(?:to|until)\s+)", 1)
    spaced = F.when(F.col("kind") == "range", F.trim(F.lower(separator)).isin("to", "until") | separator.rlike(SPACED_DASH)).otherwise(F.lit(True))
    return each.select("doc_id", "line_no", "kind", "raw", "expected", "bad_abbreviation", spaced.alias("spaced"), start.alias("start_month"), end.alias("end_month"))


def gaps(roles: DataFrame, least: int = 6) -> DataFrame:
    """Of dated roles (``who``, ``start_month``, ``end_month``) the neighbours that lie more than ``least`` months apart."""
    order = Window.partitionBy("who").orderBy("start_month", "end_month")
    following = roles.withColumn("next_start", F.lead("start_month").over(order))
    return following.where(F.col("next_start") - F.col("end_month") > least).select("who", "end_month", "next_start", (F.col("next_start") - F.col("end_month")).alias("gap"))
