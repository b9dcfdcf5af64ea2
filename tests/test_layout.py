import pytest
from pyspark.sql import functions as F

from scorelark.operators import layout
from scorelark.operators.layout import Word
from scorelark.sources import samples


def word(text, x0, top, size=10.0, font="Sans", x1=None):
    return Word(text, x0, x1 if x1 is not None else x0 + 5 * len(text), top, top + size, size, font)


def test_glyphs_and_compatible_forms():
    assert layout.normal("(cid:127) ﬁve (cid:65)(cid:3)\u00a0x") == "• five A x"
    assert [layout.glyph_of(t) for t in ("• did", "•", "•did", "- did", "-did", "- 2019", "o did", "of us", "* x", "")] == ["•", "•", "•", "-", "", "", "o", "", "*", ""]


def test_rows_are_measured_from_their_first_word():
    drift = [word(c, 10 * k, 2.0 * k) for k, c in enumerate("abcd")]
    assert [r.text for r in layout.grouped(drift, 1)] == ["a b", "c d"]
    large = [word("NAME", 0, 10, 25.0), word("contact", 0, 38), word("beside", 120, 17.5)]
    assert [r.text for r in layout.grouped(large, 1)] == ["NAME beside", "contact"]


def test_small_capitals_are_one_word():
    got = layout.small_capitals([word("E", 10, 10, 12.0, x1=16.0), Word("DUCATION", 16.5, 60.0, 12.4, 22.0, 9.6, "Sans"), word("AT", 70, 10)])
    assert [w.text for w in got] == ["EDUCATION", "AT"] and got[0].size == 12.0


def test_wrapped_bullets_are_taken_in():
    rows = layout.grouped([word("•", 14, 0), word("built", 22, 0), word("a", 50, 0), word("pendu-", 60, 0), word("lum", 22, 14), word("rig", 40, 14), word("Role", 10, 28), word("2024", 22, 56)], 1)
    got = layout.unwrapped(rows, 10.0)
    assert [r.text for r in got] == ["• built a pendulum rig", "Role", "2024"]


def test_gutter_needs_rows_on_both_sides_and_a_row_of_its_own():
    def page(rows, left_only=0):
        out = []
        for k in range(rows):
            out += [word("left", 50, 14.0 * k), word("text", 80, 14.0 * k), *([word("right", 400, 14.0 * k), word("side", 440, 14.0 * k)] if k >= left_only else [])]
        return out

    assert layout.gutter(page(8), 612.0) is None  # a column of dates
    low, high = layout.gutter(page(10, 2), 612.0)
    assert (low, high) == (122.4, 400) and layout.gutter(page(3, 1), 612.0) is None


def test_documents_of_the_samples(spark):
    docs = {r.doc_id: r for r in layout.documents(samples.words(spark), samples.pages(spark)).collect()}
    assert {k: (r.two_column, r.n_pages, r.n_images) for k, r in docs.items()} == {"weak": (False, 1, 0), "strong": (False, 1, 0), "columns": (True, 1, 0)}
    assert all(r.least_margin > 25.2 - 2 for r in docs.values()) and 0 < docs["strong"].last_fill < 1
    assert sum(x.is_bullet for x in docs["strong"].lines) == 7 and [x.glyph for x in docs["weak"].lines if x.is_bullet] == ["-"] * 3
    assert docs["columns"].lines[2].text == "SKILLS" and docs["columns"].lines[12].text == "EXPERIENCE"


def test_empty_pages_and_intake(spark):
    pages = spark.createDataFrame([("a", k, 612.0, 792.0, 0, 0, 0) for k in range(1, 32)] + [("b", 1, 3500.0, 100.0, 0, 0, 0), ("c", 1, 612.0, 792.0, 1, 0, 0), ("c", 2, 612.0, 792.0, 0, 0, 0)], samples.PAGES)
    fine, refused = layout.intake(pages)
    assert {r.doc_id for r in fine.collect()} == {"c"} and {r.doc_id: r.reason[:5] for r in refused.collect()} == {"a": "it ha", "b": "a pag"}
    got = layout.documents(spark.createDataFrame([], samples.WORDS), fine).collect()
    assert [(r.doc_id, r.n_pages, r.n_images, len(r.lines), r.n_warnings) for r in got] == [("c", 2, 1, 0, 1)]
    totals = layout.page_totals(pages.where("doc_id = 'c'"), F.lit(0.01)).first()
    assert (totals.n_pages, totals.has_graphics, totals.effective_pages) == (2, True, 1.05)


def test_flat_characters_go_before_the_next(spark):
    chars = [("d", 1, 0, "v", 10.0, 15.0, 5.0), ("d", 1, 1, "fi", 20.4, 20.4, 5.0), ("d", 1, 2, "v", 20.0, 25.0, 5.2), ("d", 1, 3, "e", 25.0, 25.0, 5.0), ("d", 1, 4, "x", 0.0, 5.0, 30.0)]
    got = {r.char_pos: (r.x0, r.x1) for r in layout.pinned(spark.createDataFrame(chars, "doc_id string, page int, char_pos int, text string, x0 double, x1 double, top double")).collect()}
    assert got[1] == (pytest.approx(19.99), 20.0) and got[3] == (25.0, 25.0) and got[0] == (10.0, 15.0)


def test_the_first_attempt_that_is_not_glued(spark):
    fine, bad = ["word"] * 20, ["SomeUniversityOfTheWholeWorld"] * 20
    rows = [("a", 1, 0, k, t) for k, t in enumerate(bad)] + [("a", 1, 1, k, t) for k, t in enumerate(fine)] + [("a", 1, 2, k, t) for k, t in enumerate(fine)]
    rows += [("b", 1, 0, k, t) for k, t in enumerate(bad + fine)] + [("b", 1, 1, k, t) for k, t in enumerate(bad)] + [("c", 1, 0, 0, bad[0])]
    words = spark.createDataFrame(rows, "doc_id string, page int, attempt int, word_pos int, text string")
    ratio = {(r.doc_id, r.attempt): r.ratio for r in layout.glued(words, ["doc_id", "page", "attempt"]).collect()}
    assert ratio == {("a", 0): 1.0, ("a", 1): 0.0, ("a", 2): 0.0, ("b", 0): 0.5, ("b", 1): 1.0, ("c", 0): 0.0}
    got = {r.doc_id: (r.attempt, r.warning is None) for r in layout.best_attempt(words).collect()}
    assert got == {"a": (1, False), "b": (0, False), "c": (0, True)}


def test_bold_italic_and_capitals_by_row(spark):
    got = {r.row_top: (r.bold, r.italic, r.all_caps) for r in layout.bold_share(samples.words(spark).where("doc_id = 'weak'")).collect()}
    assert got[40.0] == (1.0, False, False) and (1.0, False, True) in got.values() and got[min(t for t in got if t > 60)] == (0.0, False, False)


def test_pdf_files_need_a_parser(spark, tmp_path):
    from scorelark.sources import pdf

    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.pdf").write_bytes(b"%PDF-1.4 nothing")
    (tmp_path / "b.txt").write_text("no")
    found = pdf.files(spark, f"file://{tmp_path}")
    assert found.count() == 1
    try:
        import pdfplumber  # noqa: F401
    except ImportError:
        with pytest.raises(Exception, match="pdfplumber"):
            pdf.pages(found).collect()
    else:
        assert pdf.pages(found).first().problem is not None
