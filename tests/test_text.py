import pytest
from pyspark.sql import functions as F

from scorelark.functions import text as tx
from scorelark.operators import impact, layout, scoring, spelling, structure
from scorelark.sources import tables
from scorelark.streaming import intake

STANDARD = ["analyze", "author", "plan", "build", "lead", "write", "teach", "oversee", "run"]


def each(spark, values, column):
    frame = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, text string")
    return [r[0] for r in frame.orderBy("k").select(column(F.col("text"))).collect()]


def test_verb_tier(spark):
    cases = {
        "Spearheaded the migration": "strong", "Analyzed 400 records": "standard", "Helped the team": "weak", "Responsible for filing": "none", "Market research on 3 firms": "none",
        "Led a team": "standard", "Wrote code": "standard", "Taught pupils": "standard", "Co-authored a paper": "standard", "Working on reports": "weak", "Independently built a tool": "standard",
        "Platform Team – Built the pipeline": "standard", "Blorbing a thing": "weak", "": "none", "42": "none",
    }
    assert dict(zip(cases, each(spark, list(cases), lambda t: tx.verb_tier(t, STANDARD)), strict=True)) == cases


def test_lemmas(spark):
    got = dict(zip(["planned", "optimizing", "studies", "co-led", "redesigns"], each(spark, ["planned", "optimizing", "studies", "co-led", "redesigns"], tx.lemmas), strict=True))
    assert "plan" in got["planned"] and "optimize" in got["optimizing"] and "study" in got["studies"] and "led" in got["co-led"] and "redesign" in got["redesigns"]


def test_passive(spark):
    assert each(spark, ["Was awarded a scholarship", "Reports were generated weekly", "Generated 40 reports weekly", "Engineered a pipeline in Python"], tx.is_passive) == [True, True, False, False]


def test_numbers(spark):
    assert [n > 0 for n in each(spark, ["Cut latency by 38%", "Raised $450K in sponsorship", "Managed 2.4M records", "Worked there in 2023", "Phase II", "five of them"], tx.number_count)] == [True, True, True, False, True, True]


def test_tools_and_avoided(spark):
    assert each(spark, ["Built it in Python and SQL", "Dashboards in Tableau", "scripted"], tx.tools) == [["python", "sql"], ["tableau"], []]
    assert each(spark, ["Successfully helped with various tasks as needed", "MY PLAN", "the team and the rest"], tx.filler_count) == [2, 0, 2]
    assert each(spark, ["MY PLAN", "MY plan", "I am here", "it is"], tx.pronoun_count) == [0, 1, 2, 0]


def test_headings(spark):
    assert each(spark, ["  EDUCATION:  "], tx.heading_key) == ["education"]
    got = structure.canonical(spark.createDataFrame([(1, "EDUCATION:"), (1, "Research"), (1, "Nothing known")], "doc_id long, heading string"))
    assert {r.heading: r.canonical for r in got.collect()} == {"EDUCATION:": "education", "Research": "research", "Nothing known": None}


def test_dates(spark):
    given = [(0, 0, "Jun - Aug 2017"), (0, 1, "Sep 2023 - Present"), (0, 2, "Expected May 2027"), (0, 3, "2019"), (0, 4, "Jan 2018 to March 2019, then May 2020")]
    got = {(r.line_no, r.raw): r for r in structure.date_spans(spark.createDataFrame(given, "doc_id long, line_no int, text string")).collect()}
    first = got[0, "Jun - Aug 2017"]
    assert (first.start_month, first.end_month) == (2017 * 12 + 6, 2017 * 12 + 8)
    assert got[1, "Sep 2023 - Present"].end_month == structure.FOREVER
    assert got[2, "May 2027"].expected and got[3, "2019"].kind == "year" and (4, "May 2020") in got and len(got) == 6


@pytest.mark.parametrize("score,zone", [(0.0, "red"), (32.9, "red"), (33.0, "yellow"), (85.9, "yellow"), (86.0, "green"), (100.0, "green")])
def test_zone(spark, score, zone):
    assert spark.range(1).select(scoring.zone(F.lit(score))).first()[0] == zone


def test_percentile_is_the_normal_distribution(spark):
    import math

    got = spark.range(0, 1001).select((F.col("id") / 10).alias("s")).select("s", scoring.percentile(F.col("s")).alias("p")).collect()
    assert all(abs(r.p - 100 * 0.5 * (1 + math.erf((r.s - 70) / 14 / math.sqrt(2)))) <= 0.051 for r in got)


def test_points_stay_within_bounds_and_claims_add_up(spark):
    lines = tables.fixture(spark)
    for frame, most in ((impact.action(lines, STANDARD), 12), (impact.specifics(lines), 12), (impact.avoided(lines), 8)):
        assert all(0 <= r.points <= most for r in frame.collect())
    claims = spark.createDataFrame([(1, 0, 2.0, 6.0), (1, 1, 4.0, 6.0), (2, 0, 5.0, 0.0)], "doc_id long, seq int, claim double, deficit double")
    got = scoring.reconcile(claims).collect()
    assert sorted((r.doc_id, r.lost) for r in got) == [(1, 2.0), (1, 4.0), (2, 0.0)]


def test_anchored_folds_do_not_drift(spark):
    got = spark.range(1).select(layout.anchored(F.array(*(F.lit(float(x)) for x in (0, 2, 4, 6, 9))), 3.0)).first()[0]
    assert got == [0.0, 4.0, 9.0]


def test_difference_and_cohort(spark):
    a = spark.createDataFrame([("x", 1.0), ("y", 2.0)], "part string, points double")
    b = spark.createDataFrame([("x", 1.04), ("z", 3.0)], "part string, points double")
    assert sorted((r.part, r.change) for r in scoring.difference(a, b, ["part"]).collect()) == [("y", -2.0), ("z", 3.0)]
    scores = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 4.0)], "g string, overall double")
    assert [(r.name, r.n, r.stdev) for r in scoring.cohort(scores, "g").collect()] == [("a", 2, 1.0)]


def test_spelling(spark):
    docs = spark.createDataFrame([(1, "webhook Webhook recieved recieveds known")], "doc_id long, text string")
    got = {r.form: (r.n, r.colour) for r in spelling.unknown(docs, spark.createDataFrame([("known",)], "word string")).collect()}
    assert got == {"webhook": (2, "red"), "recieveds": (2, "red")}


def test_lexicon_files_and_stream(spark, tmp_path):
    from scorelark.functions import lexicons

    (tmp_path / "verbs.txt").write_text("Plan\nplan\n\nbuild\n")
    assert sorted(r.term for r in lexicons.terms(spark, f"file://{tmp_path}/verbs.txt").collect()) == ["build", "plan"]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("Led a team of five\nHelped us")
    stream = intake.documents(spark, f"file://{tmp_path}/in")
    run = intake.score_into(stream, lambda batch: impact.word_counts(tables.lines(batch)), f"file://{tmp_path}/out", f"file://{tmp_path}/state")
    run.awaitTermination(60)
    assert [(r.n_lines, r.n_words) for r in spark.read.parquet(f"file://{tmp_path}/out").collect()] == [(2, 7)]
    assert tables.text_folder(spark, f"file://{tmp_path}/in").count() == 2


def test_competencies_count_distinct_terms(spark):
    from scorelark.operators import competencies

    lines = spark.createDataFrame([(1, 0, "Led the team and led a machine learning project"), (1, 1, "C++ and machine learning"), (2, 0, "")], "doc_id long, line_no int, text string")
    terms = spark.createDataFrame([("led", "leadership"), ("machine learning", "analytical"), ("c++", "analytical"), ("sql", "analytical")], "term string, competency string")
    got = {r.competency: (r.n_lines, r.n_terms, r.points) for r in competencies.points(competencies.found(lines, terms)).collect()}
    assert got == {"leadership": (1, 1, 1.0), "analytical": (2, 2, 2.5)}
