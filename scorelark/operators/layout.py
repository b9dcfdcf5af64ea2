"""Layout from words with geometry: ``doc_id``, ``page``, ``word_pos``, ``text``, ``x0``, ``x1``, ``top``, ``bottom``, ``size``, ``font``.

Rows and clusters are anchored: a word belongs to the row of its first word, not
of its neighbour, so they are folded in order, a page at a time. ``documents``
does all of that a document at a time, in Python, as each step changes what the
next sees; a document's words are bounded by ``PAGES``.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorelark.functions import lexicons as lx
from scorelark.functions import text as tx
from scorelark.operators import structure

ROW_TOLERANCE, ROW_SHARE, INDENT = 2.6, 0.30, 3.0


def anchored(values, tolerance: float):
    """The first value of each cluster of a sorted array: a value further than the tolerance from the last anchor is the next."""
    return F.aggregate(values, F.array().cast("array<double>"), lambda acc, x: F.when((F.size(acc) == 0) | (x - F.element_at(acc, -1) > tolerance), F.concat(acc, F.array(x))).otherwise(acc))


def rows(words: DataFrame) -> DataFrame:
    """Words with the top of the row they stand in (``row_top``), which is that of its first word."""
    page = words.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("top", "size"))).alias("w"))
    start = F.array().cast("array<struct<top:double,size:double>>")
    tops = page.select("doc_id", "page", F.aggregate("w", start, lambda acc, x: F.when((F.size(acc) == 0) | (x["top"] - F.element_at(acc, -1)["top"] > F.greatest(F.lit(ROW_TOLERANCE), ROW_SHARE * F.element_at(acc, -1)["size"])), F.concat(acc, F.array(x))).otherwise(acc)).alias("anchors"))
    own = F.array_max(F.transform(F.filter("anchors", lambda a: a["top"] <= F.col("top")), lambda a: a["top"]))
    return words.join(tops, ["doc_id", "page"]).withColumn("row_top", own).drop("anchors")


def lines(words: DataFrame) -> DataFrame:
    """The rows as lines: text from left to right, box, commonest size (ties to the smaller), gap to the line above."""
    placed = rows(words)
    sizes = placed.groupBy("doc_id", "page", "row_top", F.round("size", 1).alias("s")).agg(F.count("*").alias("n"))
    modal = sizes.groupBy("doc_id", "page", "row_top").agg(F.min_by("s", F.struct(-F.col("n"), F.col("s"))).alias("size"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "word_pos", "text"))), lambda x: x["text"]), " ")
    box = placed.groupBy("doc_id", "page", "row_top").agg(text.alias("text"), F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("top").alias("top"), F.max("bottom").alias("bottom"))
    order = Window.partitionBy("doc_id", "page").orderBy("row_top")
    above = F.coalesce(F.col("top") - F.lag("bottom").over(order), F.lit(0.0))
    return box.join(modal, ["doc_id", "page", "row_top"]).withColumn("space_above", above).withColumn("line_no", F.row_number().over(order) - 1).drop("row_top")


def margins(words: DataFrame, pages: DataFrame) -> DataFrame:
    """The four margins of each page (``width`` and ``height`` in ``pages``) and how far down it is filled."""
    box = words.groupBy("doc_id", "page").agg(F.min("x0").alias("l"), F.max("x1").alias("r"), F.min("top").alias("t"), F.max("bottom").alias("b"))
    both = pages.join(box, ["doc_id", "page"])
    fill = F.least(F.greatest((F.col("b") - F.col("t")) / F.nullif(F.col("height") - F.col("t"), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    return both.select("doc_id", "page", F.col("l").alias("left_margin"), (F.col("width") - F.col("r")).alias("right_margin"), F.col("t").alias("top_margin"), (F.col("height") - F.col("b")).alias("bottom_margin"), fill.alias("fill_ratio"))


def indent_clusters(bullets: DataFrame) -> DataFrame:
    """How many indents a document's bullets (``doc_id``, ``indent``) have; one passes."""
    out = bullets.groupBy("doc_id").agg(F.array_sort(F.collect_set("indent")).alias("v"))
    clusters = F.size(anchored(F.col("v"), INDENT))
    return out.select("doc_id", clusters.alias("n_clusters"), (clusters <= 1).alias("passed"))


def gutters(words: DataFrame) -> DataFrame:
    """Free stretches of a page between its words, left to right."""
    order = Window.partitionBy("doc_id", "page").orderBy("x0", "x1", "word_pos").rowsBetween(Window.unboundedPreceding, -1)
    swept = words.withColumn("reach", F.max("x1").over(order))
    return swept.where(F.col("x0") > F.col("reach")).select("doc_id", "page", F.col("reach").alias("gap_from"), F.col("x0").alias("gap_to"))


# ---- fixed values: limits of what is read, and tolerances in points ----
PAGES, PAGE_POINTS = 30, 3400.0
GLUED_FROM, GLUE_TOKENS, GLUE_FINE = 22, 12, 0.02
BAND, GUTTER_WORDS, GUTTER_BANDS, GUTTER_WIDTH, GUTTER_ROWS, GUTTER_SHARE = 3.0, 20, 6, 0.28 * 72, 4, 0.20
CENTRE_SHARE, CAPS_GAP, CAPS_BASE, CAPS_LESS = 0.35, 1.2, 1.5, 0.4
DATE_TAIL = r"(?i)(?:19|20)\d{2}\s*$|present\s*$|current\s*$"
# ---- end of the fixed values ----


def glued(words: DataFrame, by: list[str]) -> DataFrame:
    """``by`` and ``ratio``: the share of tokens too long to be one word; 0 where there are too few to tell."""
    tokens = words.select(*by, F.explode_outer(F.regexp_extract_all("text", F.lit("[A-Za-z]{2,}"), F.lit(0))).alias("t"))
    n, long = F.count("t"), F.count_if(F.length("t") >= GLUED_FROM)
    return tokens.groupBy(*by).agg(F.when(n < GLUE_TOKENS, 0.0).otherwise(long / n).alias("ratio"))


def best_attempt(words: DataFrame) -> DataFrame:
    """Of the attempts at a page's words (``attempt`` from 0) the first that isn't glued, else the one that is least; ``warning`` says if it took more than the first."""
    ratio = glued(words, ["doc_id", "page", "attempt"])
    fine = F.col("ratio") <= GLUE_FINE
    key = F.struct((~fine).cast("int").alias("a"), F.when(fine, F.col("attempt").cast("double")).otherwise(F.col("ratio")).alias("b"), F.col("attempt").alias("c"))
    best = ratio.groupBy("doc_id", "page").agg(F.min_by(F.struct("attempt", "ratio"), key).alias("x"))
    warning = F.when(F.col("x.ratio") > GLUE_FINE, "words could not be separated").when(F.col("x.attempt") > 0, "words were separated more tightly")
    chosen = best.select("doc_id", "page", F.col("x.attempt").alias("attempt"), warning.alias("warning"))
    return words.join(chosen, ["doc_id", "page", "attempt"])


def pinned(chars: DataFrame) -> DataFrame:
    """Characters (``doc_id``, ``page``, ``char_pos``, ``text``, ``x0``, ``x1``, ``top``) with those of no width put just left of the next one in their row."""
    order = Window.partitionBy("doc_id", "page").orderBy("char_pos")
    after, row = F.lead("x0").over(order), F.lead("top").over(order)
    flat = (F.col("x1") - F.col("x0") <= 0.01) & (F.col("text") != "") & (F.abs(row - F.col("top")) <= 1.0)
    marked = chars.withColumns({"__flat": F.coalesce(flat, F.lit(False)), "__after": after})
    return marked.withColumns({"x0": F.when(F.col("__flat"), F.col("__after") - 0.01).otherwise(F.col("x0")), "x1": F.when(F.col("__flat"), F.col("__after")).otherwise(F.col("x1"))}).drop("__flat", "__after")


def intake(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The pages that are read, and (``doc_id``, ``reason``) of documents that aren't: too many pages, or too large a page."""
    reason = F.when(F.count("*") > PAGES, F.concat(F.lit("it has "), F.count("*").cast("string"), F.lit(f" pages; {PAGES} are read at most"))).when(F.max(F.greatest("width", "height")) > PAGE_POINTS, F.lit("a page is larger than any that is read"))
    refused = pages.groupBy("doc_id").agg(reason.alias("reason")).where(F.col("reason").isNotNull())
    return pages.join(refused, "doc_id", "left_anti"), refused


def normal(text: str) -> str:
    """Glyph numbers to what they stand for, and compatible forms to plain ones."""

    def glyph(m: re.Match) -> str:
        n = int(m.group(1))
        return lx.GLYPH_NUMBERS.get(n, chr(n) if 32 <= n < 127 else "")

    return unicodedata.normalize("NFKC", re.sub(r"\(cid:(\d+)\)", glyph, text)).replace("\u00a0", " ")


@dataclass
class Word:
    text: str
    x0: float
    x1: float
    top: float
    bottom: float
    size: float
    font: str

    @property
    def bold(self) -> bool:
        return re.search(tx.BOLD, self.font) is not None

    @property
    def italic(self) -> bool:
        return re.search(tx.ITALIC, self.font) is not None


@dataclass
class Row:
    """A line of words: a box about them, and a text that may have taken in the lines it was wrapped over."""

    page: int
    words: list[Word]
    text: str
    x0: float
    x1: float
    top: float
    bottom: float
    glyph: str

    @property
    def bold(self) -> float:
        return sum(w.bold for w in self.words) / len(self.words)

    @property
    def size(self) -> float:
        """The commonest size, the smaller on a tie."""
        sizes = [round(w.size, 1) for w in self.words]
        return min(set(sizes), key=lambda s: (-sizes.count(s), s))


def small_capitals(words: list[Word]) -> list[Word]:
    """A capital or two joined to the smaller capitals right behind, as they are one word."""
    out: list[Word] = []
    for w in words:
        a = out[-1] if out else None
        if a and len(a.text) <= 2 and len(w.text) >= 2 and a.text.isupper() and w.text.isupper() and a.size > w.size + CAPS_LESS and abs(w.x0 - a.x1) <= CAPS_GAP and abs(w.bottom - a.bottom) <= CAPS_BASE:
            out[-1] = replace(a, text=a.text + w.text, x1=w.x1, top=min(a.top, w.top), bottom=max(a.bottom, w.bottom))
        else:
            out.append(w)
    return out


def glyph_of(text: str) -> str:
    """The glyph that makes a line a bullet, or nothing."""
    first, after = text[:1], text[1:2]
    if not first or first not in lx.GLYPHS:
        return ""
    if first in lx.AMBIGUOUS_GLYPHS:
        return "" if after not in (" ", "\t") or not after or first in "-–—" and re.match(r"^[-–—]\s*\d", text) else first
    return first if not after or after in " \t" or after.isalnum() else ""


def together(w: Word, first: Word) -> bool:
    """Whether a word stands in the row that another began: about as high, or centred alike."""
    size = min(w.size, first.size) or max(w.size, first.size) or 10.0
    if abs(w.top - first.top) <= max(ROW_TOLERANCE, ROW_SHARE * size):
        return True
    low = min(w.bottom - w.top, first.bottom - first.top)
    return low > 0 and abs((w.top + w.bottom) - (first.top + first.bottom)) / 2 <= CENTRE_SHARE * low


def grouped(words: list[Word], page: int) -> list[Row]:
    """The rows of a page or a column, from the top."""
    groups: list[list[Word]] = []
    for w in sorted(words, key=lambda w: (round(w.top, 1), w.x0)):
        if groups and together(w, groups[-1][0]):
            groups[-1].append(w)
        else:
            groups.append([w])
    out = []
    for group in groups:
        own = small_capitals(sorted(group, key=lambda w: w.x0))
        text = normal(" ".join(w.text for w in own)).strip()
        if text:
            out.append(Row(page, own, text, min(w.x0 for w in own), max(w.x1 for w in own), min(w.top for w in own), max(w.bottom for w in own), glyph_of(text)))
    return sorted(out, key=lambda r: r.top)


def bands(words: list[Word]) -> list[list[Word]]:
    """Words by their height, each band measured from its first word."""
    out: list[list[Word]] = []
    for w in sorted(words, key=lambda w: w.top):
        if out and w.top - out[-1][0].top <= BAND:
            out[-1].append(w)
        else:
            out.append([w])
    return out


def gutter(words: list[Word], width: float) -> tuple[float, float] | None:
    """The free stretch between two columns: of those in the middle of the page that many rows have words on both sides of, the one most rows share, then the widest.

    A column of dates makes such a stretch too, but never has a row of its own.
    """
    body = [w for w in words if w.text.strip()]
    across = bands(body)
    if len(body) < GUTTER_WORDS or len(across) < GUTTER_BANDS:
        return None
    low, high = 0.2 * width, 0.8 * width
    free, reach = [], low
    for x0, x1 in sorted((w.x0, w.x1) for w in body if w.x1 > low and w.x0 < high):
        if x0 > reach:
            free.append((reach, min(x0, high)))
        reach = max(reach, x1)
    if reach < high:
        free.append((reach, high))
    best, best_key = None, (0, 0.0)
    for a, b in free:
        middle = (a + b) / 2
        left = [any(w.x1 <= middle for w in band) for band in across]
        right = [any(w.x0 >= middle for w in band) for band in across]
        only = any(all(w.x1 <= middle for w in band) or all(w.x0 >= middle for w in band) for band in across)
        shared = sum(x and y for x, y in zip(left, right, strict=True))
        if b - a >= GUTTER_WIDTH and shared >= max(GUTTER_ROWS, GUTTER_SHARE * len(across)) and only and (shared, b - a) > best_key:
            best, best_key = (a, b), (shared, b - a)
    return best


def unwrapped(rows: list[Row], left: float) -> list[Row]:
    """Bullets with the lines that they were wrapped over taken in; a hyphen before a small letter goes."""
    out: list[Row] = []
    for row in rows:
        a = out[-1] if out else None
        close = a is not None and row.top - a.bottom <= max(6.0, 0.9 * a.size)
        beneath = close and row.x0 >= a.x0 - 1 and row.x0 > left + 3 and row.bold < 0.5 and abs(row.size - a.size) < 0.6
        if beneath and a.glyph and not row.glyph and not re.search(DATE_TAIL, row.text):
            hyphen = a.text.endswith("-") and row.text[:1].islower()
            text = a.text[:-1] + row.text if hyphen else f"{a.text} {row.text}"
            out[-1] = replace(a, words=a.words + row.words, text=text.strip(), x1=max(a.x1, row.x1), bottom=max(a.bottom, row.bottom))
        else:
            out.append(row)
    return out


def _aligned(row: Row, left: float, right: float) -> str:
    before, after = row.x0 - left, right - row.x1
    if before <= 6:
        return "left"
    if after <= 6:
        return "right"
    return "center" if abs(before - after) <= max(12.0, 0.06 * (before + after)) else "indented"


def _document(words: pd.DataFrame, pages: pd.DataFrame) -> dict:
    """The lines and the geometry of one document."""
    lines, margins, fill, two = [], [], 0.0, False
    for page in pages.sort_values("page").itertuples():
        own = [Word(normal(w.text), w.x0, w.x1, w.top, w.bottom, w.size or 0.0, w.font or "") for w in words[words["page"] == page.page].sort_values("word_pos").itertuples()]
        free = gutter(own, page.width)
        middle = sum(free) / 2 if free else None
        rows = grouped(own, page.page) if free is None else grouped([w for w in own if w.x1 <= middle], page.page) + grouped([w for w in own if w.x0 >= middle], page.page)
        two = two or free is not None
        left, right, top, bottom = (min(r.x0 for r in rows), max(r.x1 for r in rows), min(r.top for r in rows), max(r.bottom for r in rows)) if rows else (0.0, page.width, 0.0, page.height)
        margins += [left, page.width - right, top, page.height - bottom] if rows else [0.0]
        fill = max(0.0, min(1.0, (bottom - top) / (page.height - top))) if rows and page.height > top else 0.0
        above = None
        rows = unwrapped(rows, left)
        for row in rows if free else sorted(rows, key=lambda r: r.top):
            w = row.words[0]
            lines.append({
                "seq": len(lines), "page": row.page, "text": row.text, "x0": row.x0, "x1": row.x1, "top": row.top, "bottom": row.bottom, "size": row.size, "max_size": max(x.size for x in row.words), "bold": row.bold,
                "first_bold": w.bold, "first_italic": w.italic, "italic": any(x.italic for x in row.words), "is_bullet": bool(row.glyph), "glyph": row.glyph, "indent": round(row.x0 - left, 1),
                "space_above": 0.0 if above is None else round(row.top - above, 1), "align": _aligned(row, left, right),
            })
            above = row.bottom
    images = int(pages["n_images"].sum()) if "n_images" in pages else 0
    return {"lines": lines, "n_pages": len(pages), "last_fill": fill, "n_images": images, "least_margin": min(margins, default=None), "two_column": two, "n_warnings": int(bool(len(pages)) and not lines)}


def documents(words: DataFrame, pages: DataFrame) -> DataFrame:
    """``doc_id``, ``lines`` (structs of ``structure.LINE``) and ``structure.GEOMETRY`` of words and pages (``page``, ``width``, ``height``, ``n_images``).

    Pages should have passed ``intake``, which bounds what a document brings.
    """
    line = "array<struct<" + ",".join(f"{k}:{t}" for k, t in structure.LINE.items()) + ">>"
    kind = pages.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, lines {line}, " + ", ".join(f"{k} {t}" for k, t in structure.GEOMETRY.items())

    def run(key: tuple, words: pd.DataFrame, pages: pd.DataFrame) -> pd.DataFrame:
        names = ["doc_id", "lines", *structure.GEOMETRY]
        return pd.DataFrame([{"doc_id": key[0]} | _document(words, pages)])[names] if len(pages) else pd.DataFrame(columns=names)

    given = words.select("doc_id", "page", "word_pos", "text", "x0", "x1", "top", "bottom", "size", "font")
    return given.groupBy("doc_id").cogroup(pages.groupBy("doc_id")).applyInPandas(run, schema)


def bold_share(words: DataFrame) -> DataFrame:
    """(doc_id, page, row_top, bold, italic, all_caps): of the rows of a page the share of bold words, whether one is italic, and whether all is in capitals."""
    placed = rows(words)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "word_pos", "text"))), lambda x: x["text"]), " ")
    return placed.groupBy("doc_id", "page", "row_top").agg(F.avg(F.col("font").rlike(tx.BOLD).cast("double")).alias("bold"), F.bool_or(F.col("font").rlike(tx.ITALIC)).alias("italic"), tx.is_all_caps(text).alias("all_caps"))


def page_totals(pages: DataFrame, filled: Column) -> DataFrame:
    """(doc_id, n_pages, has_graphics, effective_pages): the last page counts by how far it is filled, a twentieth at least."""
    graphics = F.bool_or(F.coalesce("n_images", F.lit(0)) + F.coalesce("n_rects", F.lit(0)) + F.coalesce("n_curves", F.lit(0)) > 0)
    return pages.groupBy("doc_id").agg(F.count("*").alias("n_pages"), graphics.alias("has_graphics"), (F.count("*") - 1 + F.greatest(F.lit(0.05), F.max_by(filled, "page"))).alias("effective_pages"))
