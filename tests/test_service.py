import io
import json

import pytest
from pyspark.sql import functions as F

from scorelark import service
from scorelark.operators import progress, report, scoring, structure
from scorelark.plans import resumes
from scorelark.sources import samples

from test_scores import document
from test_text import each

TYPE = 'multipart/form-data; boundary="xyz"'


def form(content, name="a.pdf"):
    return b"--xyz\r\nContent-Disposition: form-data; name=\"file\"; filename=\"" + name.encode() + b"\"\r\nContent-Type: x\r\n\r\n" + content + b"\r\n--xyz--\r\nepilogue"


@pytest.mark.parametrize("content", [b"%PDF tail\r\n", b"\r\n\r\n", b"a\r\n--xy z", b"end\n\n\n"])
def test_forms_are_read_to_the_byte(content):
    assert service.form_fields(form(content), TYPE) == {"file": [("a.pdf", content)]}


def test_forms_that_are_none():
    assert service.form_fields(form(b"x"), "text/plain") == service.form_fields(form(b"x"), "multipart/form-data; boundary=" + "b" * 71) == {}
    assert service.form_fields(b"--xyz\r\nno header\r\n--xyz--", TYPE) == {}


def call(app, body=b"", method="POST", path="/api/score", **more):
    said = {}
    environ = {"REQUEST_METHOD": method, "PATH_INFO": path, "CONTENT_TYPE": TYPE, "CONTENT_LENGTH": str(len(body)), "wsgi.input": io.BytesIO(body), "wsgi.errors": io.StringIO(), "HTTP_HOST": "here"} | more
    data = b"".join(app(environ, lambda status, headers: said.update(status=int(status[:3]), headers=dict(headers))))
    return said["status"], json.loads(data) if data else None, said["headers"]


def test_answers():
    seen = []
    app = service.Application(lambda name, content: seen.append((name, content)) or {"overall": 1.0})
    assert call(app, form(b"text", "C:\\x\\b\n.txt"))[:2] == (200, {"overall": 1.0}) and seen == [("b.txt", b"text")]
    assert call(app, b"")[0] == 400 and call(app, form(b""))[0] == 400 and call(app, form(b"x"), path="/other")[0] == 404
    assert call(app, method="GET", path="/etc/passwd")[0] == 404 and call(app, method="PUT")[0] == 405 and call(app, method="PUT")[2]["Allow"] == "GET, HEAD, POST"
    assert call(app, form(b"x"), HTTP_ORIGIN="https://evil")[0] == 403 and call(app, form(b"x"), HTTP_ORIGIN="https://here")[0] == 200
    assert call(app, b"", CONTENT_LENGTH=str(service.MOST_BYTES + 1))[0] == 413 and call(app, form(b"x"), CONTENT_LENGTH="no")[0] == 400

    def broken(name, content):
        raise RuntimeError("/secret/path")

    status, said, _ = call(service.Application(broken), form(b"x"))
    assert status == 500 and "secret" not in said["error"]
    assert [service.bare_name(x) for x in (None, "../../a/b.pdf", "n" * 200)] == ["resume.pdf", "b.pdf", "n" * 120]


def test_a_text_is_scored(spark):
    app = service.Application(service.text_scorer(spark, resumes.STANDARD, resumes.TERMS))
    text = "Jo Doe\njo@example.com\nEXPERIENCE\nHelper, Shop Jun 2024 - Aug 2024\n• Led a team of 5 people\nEDUCATION\nSome College\n"
    status, said, _ = call(app, form(text.encode(), "jo.txt"))
    assert status == 200 and said["filename"] == "jo.txt" and said["bullets"][0]["verb"] == "Led" and said["meta"]["name"] == "Jo Doe"
    assert call(app, form(b"\xff\xfe\x00"))[0] == 400


def test_pins_previews_and_names(spark):
    _, found, marked = resumes.found(spark, resumes.Rules())
    got = [(r.pin, r.line_index, r.severity, r.n) for r in report.pins(found, marked).where("doc_id = 'weak'").orderBy("pin").collect()]
    assert got == [(1, 0, "error", 2), (2, 1, "warn", 1), (3, 2, "error", 2)]
    rolled = {(r.module, r.part): r.lost for r in scoring.rolled_up(found).where("doc_id = 'weak'").collect()}
    assert rolled[None, None] == pytest.approx(sum(v for (m, p), v in rolled.items() if m and p is None)) and rolled["presentation", None] > 16
    pages = spark.createDataFrame([("a", k, 612.0, 792.0) for k in range(1, 6)] + [("b", 1, 3400.0, 3400.0), ("c", 1, 0.0, 5.0)], "doc_id string, page int, width double, height double")
    assert sorted((r.doc_id, r.page, r.dpi) for r in report.preview_pages(pages).collect()) == [("a", 1, 200), ("a", 2, 200), ("a", 3, 200), ("b", 1, 73), ("c", 1, 200)]
    lines = resumes.lines(spark)
    assert report.preview_lines(lines).where("doc_id = 'strong' AND bullet").count() == 7
    name = lambda t: report.download_name(t, F.lit(81.6), F.lit("2024-05-06 07:08:00").cast("timestamp"), "json")
    assert each(spark, ["/x/My: résumé.PDF", "..", "con", "a" * 99], name) == ["My_ résumé-score-82-20240506-0708.json", "_-score-82-20240506-0708.json", "resume-score-82-20240506-0708.json", "a" * 80 + "-score-82-20240506-0708.json"]


def test_roles_over_time(spark):
    rows = [("EXPERIENCE", 1.0, False)]
    for title, dates in (("Intern, Big Shop Group", "Jun 2020 - Aug 2020"), ("Engineer, Other Shop Group", "Jan 2021 - Dec 2022"), ("Director, Third Shop Group", "Jan 2024 - Present")):
        rows += [(f"{title} {dates}", 0.0, False), ("Did a thing with care and said so", 0.0, True)]
    down = [("EXPERIENCE", 1.0, False)]
    for title, dates in (("Director, Big Shop Group", "Jan 2020 - Feb 2020"), ("Engineer, Other Shop Group", "Mar 2020 - Apr 2020"), ("Volunteer, Third Shop Group", "May 2020")):
        down.append((f"{title} {dates}", 0.0, False))
    lines = structure.placed_lines(structure.structured(document(spark, [("up", *r) for r in rows] + [("down", *r) for r in down] + [("one", *r) for r in rows[:3]])), "blob", "name", *structure.GEOMETRY)
    found = progress.entries(lines)
    assert {(r.doc_id, r.entry): (r.n_headers, r.n_bullets, r.start_month, r.end_month) for r in found.collect()}["up", 2] == (1, 1, 2021 * 12 + 1, 2022 * 12 + 12)
    got = {r.doc_id: (r.n_roles, r.n_gaps, r.growth, round(r.points, 6)) for r in progress.career(found).collect()}
    assert got == {"up": (3, 1, 1.0, 3.4), "down": (3, 0, 0.0, 3.2), "one": (1, 0, None, 2.4)}
    bullets = report.bullets(lines, resumes.STANDARD, resumes.TERMS, resumes.Rules())
    length = {r.doc_id: (r.n_short, r.n_long, r.n_thin, r.mean_words, round(r.points, 6)) for r in progress.bullet_length(bullets, found).collect()}
    assert length == {"up": (3, 0, 3, 8.0, round(4 - 4 * 0.55 - 4 * 0.3, 6)), "one": (1, 0, 1, 8.0, round(4 - 4 * 0.55 - 4 * 0.12, 6))}


def test_dates_have_a_style(spark):
    assert each(spark, ["May.", "Sept", "december", "x"], structure.month_style) == [None, "abbrev", "full", None]
    assert each(spark, ["05/2024", "May 2024", "Sep 2024", "2024", "soon"], structure.date_style) == ["numeric", "full-month", "abbrev-month", "year-only", "other"]


def test_modules_of_two_versions(spark):
    cards = lambda x: spark.createDataFrame([("a", x, 20.0, 10.0, x + 30)], "doc_id string, impact double, presentation double, competencies double, overall double")
    got = {r.module: r.change for r in scoring.modules_apart(cards(10.0), cards(12.5)).collect()}
    assert got == {"impact": 2.5, "presentation": 0.0, "competencies": 0.0, "overall": 2.5}
    assert samples.PAGES.startswith("doc_id")
