"""PDF files as words and pages, where a PDF parser is installed; layout, structure and scores need none."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelark.operators import layout

#: Tolerances between words that are tried in turn: share of the size, points.
ATTEMPTS = ((0.18, 1.5), (0.12, 1.0), (None, 0.8))
WORDS = "doc_id string, page int, attempt int, word_pos int, text string, x0 double, x1 double, top double, bottom double, size double, font string"
PAGES = "doc_id string, page int, width double, height double, n_images int, n_rects int, n_curves int, links array<string>, problem string"


def files(spark: SparkSession, path: str) -> DataFrame:
    """All PDF files below a folder, however deep, by path."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.pdf").load(path).select(F.col("path").alias("doc_id"), "content")


def _opened(frames: Iterable[pd.DataFrame], per_page, problem) -> Iterator[pd.DataFrame]:
    try:
        import pdfplumber
    except ImportError as e:
        raise RuntimeError("reading PDF files needs the package pdfplumber; words and pages as tables need nothing") from e
    import io

    for frame in frames:
        for doc, content in zip(frame["doc_id"], frame["content"], strict=True):
            try:
                with pdfplumber.open(io.BytesIO(content)) as pdf:
                    if len(pdf.pages) > layout.PAGES:
                        yield problem(doc, f"it has {len(pdf.pages)} pages; {layout.PAGES} are read at most")
                        continue
                    for number, page in enumerate(pdf.pages, 1):
                        yield per_page(doc, number, page)
            except Exception as e:  # noqa: BLE001 - one file that can't be read must not end the job
                yield problem(doc, f"it can't be opened: {type(e).__name__}")


def pages(given: DataFrame) -> DataFrame:
    """``PAGES``; a file that can't be read has one row with its ``problem``."""
    names = [c.split()[0] for c in PAGES.split(", ")]

    def one(doc: str, number: int, page) -> pd.DataFrame:
        links = [x["uri"] for x in page.hyperlinks or [] if x.get("uri")]
        return pd.DataFrame([[doc, number, float(page.width), float(page.height), len(page.images), len(page.rects), len(page.curves), links, None]], columns=names)

    def bad(doc: str, why: str) -> pd.DataFrame:
        return pd.DataFrame([[doc, None, None, None, None, None, None, None, why]], columns=names)

    return given.mapInPandas(lambda frames: _opened(frames, one, bad), PAGES)


def words(given: DataFrame) -> DataFrame:
    """The words of all pages, by the attempt at them that is least glued."""
    names = [c.split()[0] for c in WORDS.split(", ")]

    def one(doc: str, number: int, page) -> pd.DataFrame:
        if max(float(page.width), float(page.height)) > layout.PAGE_POINTS:
            return pd.DataFrame(columns=names)
        rows = []
        for attempt, (ratio, points) in enumerate(ATTEMPTS):
            got = page.extract_words(keep_blank_chars=False, use_text_flow=False, extra_attrs=["size", "fontname"], x_tolerance=points, **({} if ratio is None else {"x_tolerance_ratio": ratio}))
            rows += [[doc, number, attempt, k, w["text"], w["x0"], w["x1"], w["top"], w["bottom"], w.get("size") or 0.0, w.get("fontname") or ""] for k, w in enumerate(got)]
        return pd.DataFrame(rows, columns=names)

    return layout.best_attempt(given.mapInPandas(lambda frames: _opened(frames, one, lambda doc, why: pd.DataFrame(columns=names)), WORDS)).drop("attempt", "warning")


def links(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "page", F.explode("links").alias("link"))
