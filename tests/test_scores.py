import json

import pytest
from pyspark.sql import functions as F

from scorelark.operators import competencies, facts, report, scoring, spelling, structure
from scorelark.plans import resumes
from scorelark.rules import Rules
from scorelark.sources import tables

from test_text import each


def document(spark, rows, **more):
    """Documents of lines: (doc_id, text, bold, is_bullet)."""
    fields = list(structure.LINE)
    of = {}
    for doc, text, bold, bullet in rows:
        own = of.setdefault(doc, [])
        own.append({k: None for k in fields} | {"seq": len(own), "page": 1, "text": text, "size": 10.0, "max_size": 10.0, "bold": bold, "is_bullet": bullet, "glyph": "•" if bullet else "", "indent": 4.0 if bullet else 0.0, "italic": False, "first_bold": bold > 0.5, "first_italic": False, "align": "left"})
    line = "array<struct<" + ",".join(f"{k}:{t}" for k, t in structure.LINE.items()) + ">>"
    schema = f"doc_id string, lines {line}, " + ", ".join(f"{k} {t}" for k, t in structure.GEOMETRY.items())
    whole = {"n_pages": 1, "last_fill": 0.5, "n_images": 0, "least_margin": 40.0, "two_column": False, "n_warnings": 0} | more
    return spark.createDataFrame([(d, [tuple(x[k] for k in fields) for x in xs], *(whole[k] for k in structure.GEOMETRY)) for d, xs in of.items()], schema)


def placed(spark, rows):
    got = structure.placed_lines(structure.structured(document(spark, rows)), "blob", "name", *structure.GEOMETRY)
    return got.orderBy("doc_id", "seq").collect()


def test_headings_open_sections(spark):
    lines = [("Jo Doe", 1.0, False), ("EDUCATION", 1.0, False), ("Some College", 0.0, False), ("Skills and Interests", 0.0, False), ("MY STORY", 1.0, False), ("my story", 1.0, False), ("MY STORY 2", 1.0, False), ("EDUCATION.", 1.0, False), ("• Experience", 0.0, True), ("Experience in the making of very many tools", 0.0, False)]
    got = placed(spark, [("a", *x) for x in lines])
    assert [(r.role == "heading", r.section, r.canonical) for r in got] == [(False, 0, None), (True, 1, "education"), (False, 1, "education"), (True, 2, "skills"), (True, 3, None), *[(False, 3, None)] * 5]
    assert got[0].name == "Jo Doe" and got[0].blob == "Jo Doe"


def test_entries(spark):
    head = ("EXPERIENCE", 1.0, False)
    role = ("Helper at a Shop Jun 2024 - Aug 2024", 0.0, False)
    rows = [head, role, ("Sept. 2022 - May 2026", 0.0, False), ("• did", 0.0, True), ("Second role", 0.0, False), ("More of it", 0.0, False), ("Bold role", 0.9, False), role, ("•", 0.0, False), *[(f"line {k}", 0.0, False) for k in range(7)]]
    got = placed(spark, [("a", *x) for x in rows])
    assert [(r.role, r.entry, r.opens) for r in got[1:]] == [
        ("header", 1, True), ("header", 1, False), ("bullet", 1, False), ("header", 2, True), ("header", 2, False), ("header", 3, True), ("header", 4, True), ("line", 4, False),
        *[("header", 4, False)] * 5, ("header", 5, True), ("header", 5, False),
    ]
    first = placed(spark, [("b", "PROJECTS", 1.0, False), ("b", "• made it", 0.0, True), ("b", "Title", 0.0, False)])
    assert [(r.role, r.entry, r.opens) for r in first[1:]] == [("bullet", 1, True), ("header", 2, True)]


def test_documents_without_a_heading(spark):
    docs = spark.createDataFrame([(1, "Led a team\n\n - did it\n•"), (2, None), (3, "")], "doc_id long, text string")
    plain = structure.plain_documents(docs)
    alone = structure.placed_lines(structure.structured(plain)).orderBy("doc_id", "seq").collect()
    assert [(r.doc_id, r.text, r.role) for r in alone] == [(1, "Led a team", "contact"), (1, "- did it", "contact"), (1, "•", "contact"), (2, None, None), (3, None, None)]
    loose = structure.placed_lines(structure.structured(plain, loose=True)).orderBy("doc_id", "seq").collect()
    assert [(r.role, r.glyph) for r in loose][:3] == [("bullet", ""), ("bullet", "-"), ("line", "•")]


def test_ampersands(spark):
    assert each(spark, ["Leadership and Activities", "Leadership & Activities", "SKILLS AND INTERESTS:"], structure.ampersand) == ["Leadership & Activities", None, "Skills & Interests"]


def test_sections_by_name(spark):
    given = {"EDUCATION:": "education", "Research": "research", "R esearch": "experience", "T ECHNICAL S KILLS": "skills", "Nothing known": None, "Clubs and Organizations": "leadership", "Qualifications": "summary", "Work History:": "experience", "Project": "projects"}
    assert dict(zip(given, each(spark, list(given), structure.canonical_of), strict=True)) == given


def test_wording_of_lines(spark):
    from scorelark.functions import text as tx

    (avoided,) = each(spark, ["Successfully helped with various tasks as needed"], tx.avoided)
    assert avoided == ["as needed", "successfully", "various"]
    assert each(spark, ["their own", "a number of the lots", "such as it is", "plain"], tx.avoided) == [["their"], ["a number of", "lots", "the"], ["it", "such as"], []]
    assert each(spark, ["Worked there in 2023", "GPA 3.22/4.0", "I-III and II", "Cut latency by 38%"], tx.numbers) == [[], ["3.22", "4.0", "3.22/4.0"], ["I-III", "II"], ["38%"]]
    assert each(spark, ["Reference on request", "References available upon request", "references upon completion", "references upon request"], lambda t: t.rlike(tx.REFERENCES)) == [True, False, False, True]
    assert each(spark, ["June 2026 - Present", "Jun 2024, to now", "Present at work", ""], tx.is_date_only) == [True, True, False, False]
    assert each(spark, ["ÉDUCATION 2", "Title", "42"], tx.is_all_caps) == [True, False, False]
    assert each(spark, ["Responsible for it", "Independently built a tool", "Platform Team – Wrote code", "Zorking"], lambda t: tx.verb(t, ["build", "write"])["token"]) == ["responsible for", "built", "Wrote", "Zorking"]
    assert each(spark, ["Skills: 2019 workshop", "DAFx 2026 - Accepted Demo", "In 2020. and then accepted"], tx.is_credential) == [False, True, False]
    assert each(spark, ["SKILLS & TOOLS", "Skills and Tools", "Skills and tools", "4"], facts.heading_case) == ["caps", "title", "other", "other"]


def test_alignment(spark):
    frame = spark.createDataFrame([(54.0, 300.0), (400.0, 557.0), (254.0, 358.0), (120.0, 300.0)], "x0 double, x1 double")
    assert [r[0] for r in frame.select(facts.alignment(F.col("x0"), F.col("x1"), F.lit(54.0), F.lit(558.0))).collect()] == ["left", "right", "center", "indented"]


@pytest.fixture(scope="module")
def resume(spark):
    rules = Rules()
    cards, found, marked = resumes.found(spark, rules)
    return cards.cache(), found.cache(), marked.cache()


def test_better_documents_score_higher(resume):
    cards, _, _ = resume
    got = {r.doc_id: r for r in cards.collect()}
    assert got["strong"].overall > got["columns"].overall > got["weak"].overall and got["strong"].overall > got["weak"].overall + 30 and got["weak"].overall < 50
    for r in got.values():
        assert abs(sum(p.most for p in r.parts) - 100) < 1e-9 and all(0 <= p.points <= p.most + 1e-9 for p in r.parts)
        assert abs(r.impact + r.presentation + r.competencies - r.overall) <= 0.05 + 1e-9 and not r.scored


def test_findings_add_up_to_what_is_lost(resume):
    cards, found, _ = resume
    lost = {}
    for f in found.collect():
        lost[f.doc_id, f.part] = lost.get((f.doc_id, f.part), 0.0) + f.points_lost
    for r in cards.collect():
        for p in r.parts:
            assert abs(lost.get((r.doc_id, p.part), 0.0) - (p.most - p.points)) <= 0.05, (r.doc_id, p.part)


def test_profiles_choose_checks_and_parts(spark):
    standard, technical = Rules(), Rules().with_profile("technical")
    assert Rules().with_profile("no such").profile is Rules().profile and standard.profile["degrees"] == "no italics"
    assert len(standard.profile["format_checks"]) == 9 and len(technical.profile["format_checks"]) == 11
    assert sum(scoring.most(standard)["impact"].values()) == pytest.approx(40) and scoring.most(technical)["impact"]["action_oriented"] == 12.0


def test_rules_from_a_file(tmp_path, monkeypatch):
    path = tmp_path / "rules.yaml"
    path.write_text("impact:\n  bullets:\n    min_words: 5\nbenchmark:\n  default: mine\n  mine: {label: Mine, mean: 60, stdev: 10, n: 3}\n")
    rules = Rules.load(str(path))
    assert rules["impact.bullets.min_words"] == 5 and rules["impact.bullets.max_words"] == 80 and rules.get("no.such.name", 7) == 7
    monkeypatch.setenv("SCORELARK_RULES", str(path))
    assert Rules.load()["benchmark.mine.mean"] == 60 and Rules()["benchmark.default"] == "general"
    with pytest.raises(KeyError):
        rules["no.such"]


def test_cohorts(spark, tmp_path):
    rules = Rules()
    assert tables.cohort(spark, rules).first().mean == 70.0 and tables.cohort(spark, rules, "other").first().mean == 62.0
    (tmp_path / "mine.json").write_text(json.dumps({"label": "Mine", "n": 2, "mean": 61.5, "stdev": 3.0, "files": ["secret.pdf"]}))
    got = tables.cohort(spark, rules, "mine", f"file://{tmp_path}").first()
    assert (got.name, got.mean, got.median) == ("mine", 61.5, None) and "files" not in got.asDict()
    stats = scoring.cohort(spark.createDataFrame([("a", 1.0), ("a", 3.0)], "g string, overall double"), "g")
    tables.write_cohort(stats, f"file://{tmp_path}/out")
    assert spark.read.json(f"file://{tmp_path}/out").first().mean == 2.0


def test_competency_points_are_quantised(spark):
    names = {c: [] for c in Rules()["competencies.list"]}
    frame = spark.createDataFrame([(k, [f"t{i}" for i in range(k)]) for k in range(7)], "k int, terms array<string>").select("k", *(F.col("terms").alias(f"terms_{c}") for c in names))
    points = scoring.competency_parts(Rules())["analytical"][1]
    assert [r[0] for r in frame.orderBy("k").select(points).collect()] == [0.0, 1.0, 2.5, 3.5, 5.0, 6.0, 6.0]
    hits = each(spark, ["led r&d in c++ and a/b testing", "rledc++x"], lambda t: facts.term_hits(t, ["led", "r", "c++", "a/b test", "data"]))
    assert [sorted(h) for h in hits] == [["a/b test", "c++", "led", "r"], []]


def test_spelling_stages(spark):
    known = spark.createDataFrame([(w,) for w in "received the model manufacture build back end honor write code launch web site".split()], "word string")
    find = lambda text, **kw: {r.form: r.colour for r in spelling.unknown(spark.createDataFrame([(1, text)], "doc_id long, text string"), known, **kw).collect()}
    assert find("recieved the model") == {"recieved": "red"}
    assert find("Honours honour") == {} and set(find("Honours honour", commonwealth=False)) == {"Honours"}
    assert find("Northwind") == {"Northwind": "yellow"} and find("Northwind", strict=False) == {}
    assert find("see jo@mail.com or https://x.io/abc and site.dev/x solve_ivp") == {"see": "yellow", "and": "yellow"}
    assert find("pre-launch web-site xq-launch launch-xqz definer lifecycle january") == {"launch-xqz": "red", "definer": "red"}
    assert find("WebSocket WebSockets") == {"WebSockets": "yellow"} and find("webhook Webhook") == {"webhook": "red"} and find("Webhook webhook") == {"Webhook": "yellow"}
    assert find("manufacturability rebuild backend honoours", strict=False) == {"honoours": "red"}
    names = spark.createDataFrame([(1, "yuxuan")], "doc_id long, word string")
    assert find("Yuxuan", names=names) == {}
    for word, colour in {"rebasing": "red", "webhook": "red", "idempotency": "red", "Soniox": "yellow", "JSONL": "yellow", "vLLM": "yellow", "vfi": "yellow"}.items():
        assert each(spark, [word], spelling.colour) == [colour]


def test_word_lists_from_affix_files(spark, tmp_path):
    (tmp_path / "en.aff").write_text("SET UTF-8\nPFX A Y 1\nPFX A 0 re .\nPFX N N 1\nPFX N 0 un .\nSFX D Y 4\nSFX D 0 ed [aeiou]y\nSFX D y ied [^aeiou]y\nSFX D 0 ed [^ey]\nSFX D 0 d e\n")
    (tmp_path / "en.dic").write_text("4\nbuild/A\ntry/D\nplay/AD\nonly/Nc\nx2/D\nlike/ND\n")
    words = spelling.affix_forms(spelling.read_stems(spark, f"file://{tmp_path}/en.dic"), spelling.read_rules(spark, f"file://{tmp_path}/en.aff"))
    assert {r.word for r in words.collect()} == {"build", "rebuild", "try", "tried", "play", "replay", "played", "replayed", "like", "unlike", "liked"}
    spelling.word_list(words, f"file://{tmp_path}/list")
    assert sorted(r.value for r in spark.read.text(f"file://{tmp_path}/list").collect())[:2] == ["build", "like"]


def test_reports(spark, resume):
    cards, found, marked = resume
    rules = Rules()
    reports = report.documents(cards, found, marked, rules).cache()
    data = {r.doc_id: json.loads(r.report) for r in reports.collect()}
    weak = data["weak"]
    assert [m["key"] for m in weak["modules"]] == ["impact", "presentation", "competencies"] and [len(m["subscores"]) for m in weak["modules"]] == [5, 5, 5]
    assert weak["bullets"][1]["flags"][0] == "weak verb “Helped”" and weak["blockers"][0].startswith("Only 59 words") and len(weak["top_actions"]) <= 10
    assert all(a["points"] >= b["points"] for a, b in zip(weak["top_actions"], weak["top_actions"][1:]))
    hostile = spark.createDataFrame([("x", json.dumps({"filename": "<b>&\"'.pdf", "overall": 1, "zone": "red", "modules": [], "t": "<!--<script>\u2028</script>"}, ensure_ascii=False))], "doc_id string, report string")
    page = report.as_html(hostile).first().page
    assert "<!--" not in page.split("const report")[1] and "\\u003c!--\\u003cscript\\u003e\\u2028" in page and "&lt;b&gt;&amp;&quot;&#x27;.pdf" in page
    text = {r.doc_id: r.summary for r in report.as_text(cards, found, rules).collect()}
    assert "OVERALL" in text["weak"] and "BLOCKERS" in text["weak"] and "BIGGEST WINS AVAILABLE" in text["strong"] and "(1 issue)" in text["weak"]
    assert each(spark, ["/home/x/a.pdf", "C:\\x\\b.pdf", "", "n" * 200], report.filename) == ["a.pdf", "b.pdf", "resume.pdf", "n" * 120]
    assert each(spark, ["go-getter", "MY", "i am"], report.title) == ["Go-Getter", "My", "I Am"]


def test_languages_seniority_and_anchors(spark):
    rows = [("a", "LANGUAGES", 1.0, False), ("a", "English, French and Basque", 0.0, False), ("a", "SKILLS", 1.0, False), ("a", "Spoken languages: Latin, Thai", 0.0, False), ("a", "English only", 0.0, False)]
    lines = structure.placed_lines(structure.structured(document(spark, rows)))
    assert [(r.n, r.text) for r in competencies.spoken_languages(lines).collect()] == [(3, "English, French and Basque")]
    titles = spark.createDataFrame([("Senior Research Assistant",), ("Co-founder",), ("Barista",), ("teaching assistant",)], "text string")
    assert [r.level for r in competencies.seniority(titles).collect()] == [4, 5, 0, 3]
    cards = spark.createDataFrame([("a", 69.5), ("b", 76.0)], "doc_id string, overall double")
    got = scoring.anchors(cards, spark.createDataFrame([("a", 69.0), ("b", 77.0), ("c", 1.0)], "doc_id string, given double")).first()
    assert (got.n, got.mean_error, got.worst) == (2, 0.75, 1.0)
