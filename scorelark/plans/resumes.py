"""Queries over small documents with a layout, against rows that are stated: what the rules give, gone through by hand when they were put down."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelark.operators import facts, layout, report, scoring, spelling, structure
from scorelark.rules import Rules
from scorelark.sources import samples

#: Everyday verbs, the terms of competencies and the vocabulary are parameters; these few stand in for them.
STANDARD = ["analyze", "author", "build", "lead", "manage", "plan", "present", "study", "teach", "test", "write"]
TERMS = {"analytical": ["python", "sql", "simulation"], "communication": ["presented", "workshop"], "leadership": ["led", "raised", "president", "membership", "team of"], "teamwork": ["team", "c++"], "initiative": ["launch", "won"]}
MISSPELT = ("till", "customers")
QUERIES, ORACLES = {}, {}


def golden(columns: str, rows: list[tuple]):
    """A query whose rows are stated: ``columns`` as DuckDB's, ``rows`` as literals."""

    def literal(x) -> str:
        return "NULL" if x is None else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)

    names = [c.strip().split() for c in columns.split(",")]
    picked = ", ".join(f"CAST({n} AS {t}) AS {n}" for n, t in names)

    def put(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = f"SELECT {picked} FROM (VALUES {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)}) AS v({', '.join(n for n, _ in names)})"
        return f

    return put


def structured(spark: SparkSession) -> DataFrame:
    return structure.structured(layout.documents(samples.words(spark), samples.pages(spark)))


def lines(spark: SparkSession) -> DataFrame:
    return structure.placed_lines(structured(spark), "blob", "name", *structure.GEOMETRY)


def unknown(spark: SparkSession, each: DataFrame) -> DataFrame:
    """Every word that isn't one of ``MISSPELT`` is in the vocabulary."""
    texts = each.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "\n").alias("text"))
    known = spelling.vocabulary(texts).where(~F.col("word").isin(*MISSPELT))
    own = each.select("doc_id", F.explode(F.split(F.lower("name"), " ")).alias("word"))
    return spelling.unknown(texts, known, own)


def scored(spark: SparkSession, each: DataFrame, rules: Rules) -> DataFrame:
    spelt = spelling.score(unknown(spark, each)).select("doc_id", "n_red", "n_yellow")
    return scoring.scores(facts.document_facts(each, STANDARD, TERMS, rules).join(spelt, "doc_id", "left").fillna(0, ["n_red", "n_yellow"]), rules)


def found(spark: SparkSession, rules: Rules) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Scores, findings and bullets. All three read the lines, which are few, so they are laid out once."""
    each = lines(spark).persist()
    cards, marked = scored(spark, each, rules), report.bullets(each, STANDARD, TERMS, rules)
    return cards, report.findings(cards, report.evidence(each, marked, unknown(spark, each)), rules), marked


@golden("doc_id VARCHAR, seq INTEGER, role VARCHAR, section INTEGER, entry INTEGER, canonical VARCHAR, is_bullet BOOLEAN, indent DOUBLE, align VARCHAR, size DOUBLE, bold DOUBLE, text VARCHAR", [
    ('columns', 0, 'contact', 0, 0, '', False, 0.0, 'left', 18.0, 1.0, 'Kim Poe'),
    ('columns', 1, 'contact', 0, 0, '', False, 0.0, 'left', 10.0, 0.0, 'kim@example.com'),
    ('columns', 2, 'heading', 1, 0, 'skills', False, 0.0, 'left', 11.0, 1.0, 'SKILLS'),
    ('columns', 3, 'header', 1, 1, 'skills', False, 0.0, 'left', 10.0, 0.0, 'Tool A'),
    ('columns', 4, 'header', 1, 1, 'skills', False, 0.0, 'left', 10.0, 0.0, 'Tool B'),
    ('columns', 5, 'header', 1, 1, 'skills', False, 0.0, 'left', 10.0, 0.0, 'Tool C'),
    ('columns', 6, 'header', 1, 1, 'skills', False, 0.0, 'left', 10.0, 0.0, 'Tool D'),
    ('columns', 7, 'header', 1, 1, 'skills', False, 0.0, 'left', 10.0, 0.0, 'Tool E'),
    ('columns', 8, 'header', 1, 1, 'skills', False, 0.0, 'left', 10.0, 0.0, 'Tool F'),
    ('columns', 9, 'heading', 2, 0, 'languages', False, 0.0, 'left', 11.0, 1.0, 'LANGUAGES'),
    ('columns', 10, 'header', 2, 1, 'languages', False, 0.0, 'left', 10.0, 0.0, 'French'),
    ('columns', 11, 'header', 2, 1, 'languages', False, 0.0, 'left', 10.0, 0.0, 'German'),
    ('columns', 12, 'heading', 3, 0, 'experience', False, 196.0, 'indented', 11.0, 1.0, 'EXPERIENCE'),
    ('columns', 13, 'bullet', 3, 1, 'experience', True, 200.0, 'right', 10.0, 0.0, '• Built part 1 of the engine with care'),
    ('columns', 14, 'bullet', 3, 1, 'experience', True, 200.0, 'right', 10.0, 0.0, '• Built part 2 of the engine with care'),
    ('columns', 15, 'bullet', 3, 1, 'experience', True, 200.0, 'right', 10.0, 0.0, '• Built part 3 of the engine with care'),
    ('columns', 16, 'bullet', 3, 1, 'experience', True, 200.0, 'right', 10.0, 0.0, '• Built part 4 of the engine with care'),
    ('columns', 17, 'bullet', 3, 1, 'experience', True, 200.0, 'right', 10.0, 0.0, '• Built part 5 of the engine with care'),
    ('columns', 18, 'bullet', 3, 1, 'experience', True, 200.0, 'right', 10.0, 0.0, '• Built part 6 of the engine with care'),
    ('columns', 19, 'heading', 4, 0, 'education', False, 196.0, 'indented', 11.0, 1.0, 'EDUCATION'),
    ('columns', 20, 'header', 4, 1, 'education', False, 196.0, 'indented', 10.0, 0.0, 'Some College'),
    ('columns', 21, 'header', 4, 1, 'education', False, 196.0, 'indented', 10.0, 0.0, '2024'),
    ('columns', 22, 'heading', 5, 0, 'awards', False, 196.0, 'indented', 10.0, 0.0, 'Honors'),
    ('strong', 0, 'contact', 0, 0, '', False, 0.0, 'left', 18.0, 1.0, 'Alex Roe'),
    ('strong', 1, 'contact', 0, 0, '', False, 0.0, 'left', 10.0, 0.0, '(555) 010-0199 | alex@example.com | Spri'),
    ('strong', 2, 'heading', 1, 0, 'education', False, 0.0, 'left', 11.0, 1.0, 'EDUCATION'),
    ('strong', 3, 'header', 1, 1, 'education', False, 0.0, 'left', 10.0, 0.78, 'Springfield University, Bachelor of Scie'),
    ('strong', 4, 'bullet', 1, 1, 'education', True, 4.0, 'left', 10.0, 0.0, '• GPA: 3.9/4.0'),
    ('strong', 5, 'heading', 2, 0, 'experience', False, 0.0, 'left', 11.0, 1.0, 'EXPERIENCE'),
    ('strong', 6, 'header', 2, 1, 'experience', False, 0.0, 'left', 10.0, 0.5, 'Software Engineer Intern, Northwind Syst'),
    ('strong', 7, 'bullet', 2, 1, 'experience', True, 4.0, 'left', 10.0, 0.0, '• Engineered a Python pipeline that cut '),
    ('strong', 8, 'bullet', 2, 1, 'experience', True, 4.0, 'left', 10.0, 0.0, '• Automated 35 reports in SQL and Tablea'),
    ('strong', 9, 'bullet', 2, 1, 'experience', True, 4.0, 'left', 10.0, 0.0, '• Led a team of four to launch a dashboa'),
    ('strong', 10, 'header', 2, 2, 'experience', False, 0.0, 'left', 10.0, 0.5, 'Research Assistant, Springfield Robotics'),
    ('strong', 11, 'bullet', 2, 2, 'experience', True, 4.0, 'left', 10.0, 0.0, '• Optimized a simulation in C++ and redu'),
    ('strong', 12, 'bullet', 2, 2, 'experience', True, 4.0, 'left', 10.0, 0.0, '• Presented results to 80 people at a re'),
    ('strong', 13, 'heading', 3, 0, 'leadership', False, 0.0, 'left', 11.0, 1.0, 'LEADERSHIP & ACTIVITIES'),
    ('strong', 14, 'header', 3, 1, 'leadership', False, 0.0, 'left', 10.0, 0.6, 'President, Student Computing Society of '),
    ('strong', 15, 'bullet', 3, 1, 'leadership', True, 4.0, 'left', 10.0, 0.0, '• Raised $4,500 in sponsorship and doubl'),
    ('strong', 16, 'heading', 4, 0, 'skills', False, 0.0, 'left', 11.0, 1.0, 'SKILLS'),
    ('strong', 17, 'header', 4, 1, 'skills', False, 0.0, 'left', 10.0, 0.0, 'Python, SQL, Java, Tableau, Linux, Git'),
    ('weak', 0, 'contact', 0, 0, '', False, 0.0, 'left', 18.0, 1.0, 'Sam Doe'),
    ('weak', 1, 'contact', 0, 0, '', False, 0.0, 'left', 10.0, 0.0, 'sam.doe@example.com'),
    ('weak', 2, 'heading', 1, 0, 'summary', False, 0.0, 'left', 11.0, 1.0, 'OBJECTIVE'),
    ('weak', 3, 'header', 1, 1, 'summary', False, 0.0, 'left', 10.0, 0.0, 'I am looking for a role where I can use '),
    ('weak', 4, 'heading', 2, 0, 'experience', False, 0.0, 'left', 11.0, 1.0, 'EXPERIENCE'),
    ('weak', 5, 'header', 2, 1, 'experience', False, 0.0, 'left', 10.0, 0.63, 'Shop Helper, Corner Store Group Sept 202'),
    ('weak', 6, 'bullet', 2, 1, 'experience', True, 4.0, 'left', 10.0, 0.0, '- Responsible for the till and various t'),
    ('weak', 7, 'bullet', 2, 1, 'experience', True, 4.0, 'left', 10.0, 0.0, '- Helped customers find many things'),
    ('weak', 8, 'bullet', 2, 1, 'experience', True, 4.0, 'left', 10.0, 0.0, '- Was given the keys to the shop.'),
    ('weak', 9, 'heading', 3, 0, 'education', False, 0.0, 'left', 11.0, 1.0, 'EDUCATION'),
    ('weak', 10, 'header', 3, 1, 'education', False, 0.0, 'left', 10.0, 0.71, 'Bachelor of Arts, Some College May 2025'),
    ('weak', 11, 'header', 3, 1, 'education', False, 0.0, 'left', 10.0, 0.0, 'GPA 3.2'),
    ('weak', 12, 'header', 3, 1, 'education', False, 0.0, 'left', 10.0, 0.0, 'References available upon request'),
])
def resume_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words with a layout as lines, with their sections, entries and roles."""
    each = lines(spark)
    return each.select("doc_id", "seq", "role", "section", "entry", F.coalesce("canonical", F.lit("")).alias("canonical"), "is_bullet", "indent", "align", "size", F.round("bold", 2).alias("bold"), F.substring("text", 1, 40).alias("text"))


@golden("doc_id VARCHAR, index INTEGER, section VARCHAR, verb VARCHAR, verb_tier VARCHAR, active_voice BOOLEAN, quantifiers VARCHAR, tools VARCHAR, flags VARCHAR", [
    ('columns', 0, 'EXPERIENCE', 'Built', 'standard', True, '1', '', 'no tool or method named; filler: the; length 8 words (aim 12-55)'),
    ('columns', 1, 'EXPERIENCE', 'Built', 'standard', True, '2', '', 'no tool or method named; filler: the; length 8 words (aim 12-55)'),
    ('columns', 2, 'EXPERIENCE', 'Built', 'standard', True, '3', '', 'no tool or method named; filler: the; length 8 words (aim 12-55)'),
    ('columns', 3, 'EXPERIENCE', 'Built', 'standard', True, '4', '', 'no tool or method named; filler: the; length 8 words (aim 12-55)'),
    ('columns', 4, 'EXPERIENCE', 'Built', 'standard', True, '5', '', 'no tool or method named; filler: the; length 8 words (aim 12-55)'),
    ('columns', 5, 'EXPERIENCE', 'Built', 'standard', True, '6', '', 'no tool or method named; filler: the; length 8 words (aim 12-55)'),
    ('strong', 0, 'EDUCATION', 'GPA', 'none', True, '3.9|4.0|3.9/4.0', '', 'no action verb; no tool or method named; too short (2 words)'),
    ('strong', 1, 'EXPERIENCE', 'Engineered', 'strong', True, '9|40|12', 'pipeline|python', 'filler: the'),
    ('strong', 2, 'EXPERIENCE', 'Automated', 'strong', True, '35|20', 'sql|tableau', ''),
    ('strong', 3, 'EXPERIENCE', 'Led', 'standard', True, '300|four|first', 'dashboard', 'filler: its'),
    ('strong', 4, 'EXPERIENCE', 'Optimized', 'strong', True, '45%|two', 'c++|simulation', 'filler: its'),
    ('strong', 5, 'EXPERIENCE', 'Presented', 'standard', True, '80|25|second', '', 'no tool or method named'),
    ('strong', 6, 'LEADERSHIP & ACTIVITIES', 'Raised', 'strong', True, '$4,500|120|one', '', 'no tool or method named'),
    ('weak', 0, 'EXPERIENCE', 'responsible for', 'none', True, '', '', 'no action verb; no quantification; no tool or method named; filler: the, various; too short (7 words)'),
    ('weak', 1, 'EXPERIENCE', 'Helped', 'weak', True, '', '', 'weak verb “Helped”; no quantification; no tool or method named; filler: many; too short (5 words)'),
    ('weak', 2, 'EXPERIENCE', 'Was', 'none', False, '', '', 'no action verb; passive voice; no quantification; no tool or method named; filler: the; too short (7 words)'),
])
def resume_bullets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every scored bullet with what the rules say of it."""
    marked = report.bullets(lines(spark), STANDARD, TERMS, Rules())
    return marked.select("doc_id", "index", "section", "verb", "verb_tier", "active_voice", F.array_join("quantifiers", "|").alias("quantifiers"), F.array_join("tools", "|").alias("tools"), F.array_join("flags", "; ").alias("flags"))


@golden("doc_id VARCHAR, module VARCHAR, part VARCHAR, points DOUBLE, most DOUBLE, status VARCHAR", [
    ('columns', 'competencies', 'analytical', 0.0, 6.0, 'Needs Work!'),
    ('columns', 'competencies', 'communication', 0.0, 6.0, 'Needs Work!'),
    ('columns', 'competencies', 'initiative', 0.0, 6.0, 'Needs Work!'),
    ('columns', 'competencies', 'leadership', 0.0, 6.0, 'Needs Work!'),
    ('columns', 'competencies', 'teamwork', 0.0, 6.0, 'Needs Work!'),
    ('columns', 'impact', 'action_oriented', 9.6, 10.4348, 'Good Job!'),
    ('columns', 'impact', 'avoided_words', 5.3913, 6.9565, 'On Track!'),
    ('columns', 'impact', 'extracurriculars', 5.2174, 5.2174, 'Good Job!'),
    ('columns', 'impact', 'overuse', 5.7971, 6.9565, 'On Track!'),
    ('columns', 'impact', 'specifics', 5.2174, 10.4348, 'Good Job!'),
    ('columns', 'presentation', 'essential_sections', 9.0, 9.0, 'Good Job!'),
    ('columns', 'presentation', 'number_of_pages', 1.0, 1.0, 'Good Job!'),
    ('columns', 'presentation', 'overall_format', 0.0, 16.0, 'Needs Work!'),
    ('columns', 'presentation', 'section_specific', 0.0, 1.0, 'Needs Work!'),
    ('columns', 'presentation', 'spell_check', 3.0, 3.0, 'Good Job!'),
    ('strong', 'competencies', 'analytical', 3.5, 6.0, 'On Track!'),
    ('strong', 'competencies', 'communication', 2.5, 6.0, 'On Track!'),
    ('strong', 'competencies', 'initiative', 2.5, 6.0, 'On Track!'),
    ('strong', 'competencies', 'leadership', 6.0, 6.0, 'Good Job!'),
    ('strong', 'competencies', 'teamwork', 2.5, 6.0, 'On Track!'),
    ('strong', 'impact', 'action_oriented', 10.1565, 10.4348, 'Good Job!'),
    ('strong', 'impact', 'avoided_words', 6.6957, 6.9565, 'On Track!'),
    ('strong', 'impact', 'extracurriculars', 5.2174, 5.2174, 'Good Job!'),
    ('strong', 'impact', 'overuse', 6.9565, 6.9565, 'Good Job!'),
    ('strong', 'impact', 'specifics', 10.4348, 10.4348, 'Good Job!'),
    ('strong', 'presentation', 'essential_sections', 9.0, 9.0, 'Good Job!'),
    ('strong', 'presentation', 'number_of_pages', 1.0, 1.0, 'Good Job!'),
    ('strong', 'presentation', 'overall_format', 16.0, 16.0, 'Good Job!'),
    ('strong', 'presentation', 'section_specific', 1.0, 1.0, 'Good Job!'),
    ('strong', 'presentation', 'spell_check', 3.0, 3.0, 'Good Job!'),
    ('weak', 'competencies', 'analytical', 0.0, 6.0, 'Needs Work!'),
    ('weak', 'competencies', 'communication', 0.0, 6.0, 'Needs Work!'),
    ('weak', 'competencies', 'initiative', 0.0, 6.0, 'Needs Work!'),
    ('weak', 'competencies', 'leadership', 0.0, 6.0, 'Needs Work!'),
    ('weak', 'competencies', 'teamwork', 0.0, 6.0, 'Needs Work!'),
    ('weak', 'impact', 'action_oriented', 1.2174, 10.4348, 'Needs Work!'),
    ('weak', 'impact', 'avoided_words', 4.4348, 6.9565, 'Needs Work!'),
    ('weak', 'impact', 'extracurriculars', 0.0, 5.2174, 'Needs Work!'),
    ('weak', 'impact', 'overuse', 6.9565, 6.9565, 'Good Job!'),
    ('weak', 'impact', 'specifics', 0.0, 10.4348, 'Needs Work!'),
    ('weak', 'presentation', 'essential_sections', 9.0, 9.0, 'Good Job!'),
    ('weak', 'presentation', 'number_of_pages', 1.0, 1.0, 'Good Job!'),
    ('weak', 'presentation', 'overall_format', 0.0, 16.0, 'Needs Work!'),
    ('weak', 'presentation', 'section_specific', 0.0, 1.0, 'Needs Work!'),
    ('weak', 'presentation', 'spell_check', 1.0, 3.0, 'Needs Work!'),
])
def resume_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The points and the chip of every part of a score."""
    return scoring.subscores(scored(spark, lines(spark), Rules())).select("doc_id", "module", "part", F.bround("points", 4).alias("points"), F.bround("most", 4).alias("most"), "status")


@golden("doc_id VARCHAR, profile VARCHAR, failed_format VARCHAR, failed_details VARCHAR, overall DOUBLE, zone VARCHAR, percentile DOUBLE, n_blockers INTEGER", [
    ('columns', 'standard', 'bullet_alignment,section_styling', 'phone_number', 44.2, 'yellow', 3.3, 1),
    ('columns', 'technical', 'bullet_alignment,section_styling', 'phone_number', 42.9, 'yellow', 2.6, 1),
    ('strong', 'standard', '', '', 86.5, 'green', 88.1, 1),
    ('strong', 'technical', '', '', 86.4, 'green', 87.9, 1),
    ('weak', 'standard', 'bullet_check,date_formatting', 'phone_number,gpa_check', 23.6, 'red', 0.0, 1),
    ('weak', 'technical', 'bullet_check,date_formatting', 'phone_number,gpa_check', 25.5, 'red', 0.1, 1),
])
def resume_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The checks that fail by profile, and the score that comes of them."""
    each, out = lines(spark), None
    for profile in ("standard", "technical"):
        cards = scored(spark, each, Rules().with_profile(profile))
        one = cards.select("doc_id", F.lit(profile).alias("profile"), F.array_join("failed_format", ",").alias("failed_format"), F.array_join("failed_details", ",").alias("failed_details"), "overall", "zone", "percentile", F.size("blockers").alias("n_blockers"))
        out = one if out is None else out.unionByName(one)
    return out


@golden("doc_id VARCHAR, module VARCHAR, part VARCHAR, seq INTEGER, severity VARCHAR, message VARCHAR, points_lost DOUBLE, evidence VARCHAR, line_index INTEGER", [
    ('columns', 'competencies', 'analytical', 0, 'error', 'We recommend you to add more experiences which reflect your analytical skills well.', 6.0, '', None),
    ('columns', 'competencies', 'communication', 0, 'error', 'We recommend you to add more experiences which reflect your communication skills well.', 6.0, '', None),
    ('columns', 'competencies', 'initiative', 0, 'error', 'We recommend you to add more experiences which reflect your initiative skills well.', 6.0, '', None),
    ('columns', 'competencies', 'leadership', 0, 'error', 'We recommend you to add more experiences which reflect your leadership skills well.', 6.0, '', None),
    ('columns', 'competencies', 'teamwork', 0, 'error', 'We recommend you to add more experiences which reflect your teamwork skills well.', 6.0, '', None),
    ('columns', 'impact', 'action_oriented', 0, 'warn', '6 of 6 bullets open with an ordinary verb rather than a strong one.', 0.835, '', None),
    ('columns', 'impact', 'avoided_words', 0, 'warn', 'You have used some words which are usually considered as filler words.', 1.565, 'The 6', None),
    ('columns', 'impact', 'extracurriculars', 0, 'good', 'You have included extra-curricular involvement.', 0.0, 'Honors', None),
    ('columns', 'impact', 'overuse', 0, 'warn', 'You have overused a few words :', 1.159, 'Built 6', None),
    ('columns', 'impact', 'specifics', 0, 'warn', 'Few bullets name the tool, method or system you used.', 5.217, '', None),
    ('columns', 'presentation', 'essential_sections', 0, 'good', 'All essential sections present and correctly titled.', 0.0, '', None),
    ('columns', 'presentation', 'number_of_pages', 0, 'good', '1 page(s) - within the 1-page benchmark.', 0.0, '', None),
    ('columns', 'presentation', 'overall_format', 0, 'error', 'Bullet Alignment', 8.0, '', None),
    ('columns', 'presentation', 'overall_format', 1, 'error', 'Section Styling', 8.0, '', None),
    ('columns', 'presentation', 'overall_format', 2, 'good', '7 Checks meet guidelines', 0.0, 'Bullet Check, Date Formatting, Font Size Check, References, Page Margins, Image Check, Section Spacing', None),
    ('columns', 'presentation', 'section_specific', 0, 'error', 'Phone Number', 1.0, '', None),
    ('columns', 'presentation', 'section_specific', 1, 'good', '8 Checks meet guidelines', 0.0, 'Font Size Check, Name Check, Email Address, GPA Check, Degree Styling, University Name, University Styling, Job Title Styling', None),
    ('columns', 'presentation', 'spell_check', 0, 'good', 'We did not find any spelling errors in the resume.', 0.0, '', None),
    ('strong', 'competencies', 'analytical', 0, 'warn', 'We recommend you to add more experiences which reflect your analytical skills well.', 2.5, '', None),
    ('strong', 'competencies', 'communication', 0, 'warn', 'We recommend you to add more experiences which reflect your communication skills well.', 3.5, '', None),
    ('strong', 'competencies', 'initiative', 0, 'warn', 'We recommend you to add more experiences which reflect your initiative skills well.', 3.5, '', None),
    ('strong', 'competencies', 'leadership', 0, 'good', 'You are doing a great job reflecting your leadership skills!', 0.0, '', None),
    ('strong', 'competencies', 'teamwork', 0, 'warn', 'We recommend you to add more experiences which reflect your teamwork skills well.', 3.5, '', None),
    ('strong', 'impact', 'action_oriented', 0, 'warn', '2 of 6 bullets open with an ordinary verb rather than a strong one.', 0.278, '', None),
    ('strong', 'impact', 'avoided_words', 0, 'warn', 'You have used some words which are usually considered as filler words.', 0.261, 'The 1', None),
    ('strong', 'impact', 'extracurriculars', 0, 'good', 'You have included extra-curricular involvement.', 0.0, 'LEADERSHIP & ACTIVITIES', None),
    ('strong', 'impact', 'overuse', 0, 'good', 'No overused words detected.', 0.0, '', None),
    ('strong', 'impact', 'specifics', 0, 'good', 'Bullets are concrete: numbers and named tools throughout.', 0.0, '', None),
    ('strong', 'presentation', 'essential_sections', 0, 'good', 'All essential sections present and correctly titled.', 0.0, '', None),
    ('strong', 'presentation', 'number_of_pages', 0, 'good', '1 page(s) - within the 1-page benchmark.', 0.0, '', None),
    ('strong', 'presentation', 'overall_format', 0, 'good', '9 Checks meet guidelines', 0.0, 'Bullet Alignment, Bullet Check, Date Formatting, Font Size Check, References, Page Margins, Section Styling, Image Check, Section Spacing', None),
    ('strong', 'presentation', 'section_specific', 0, 'good', '9 Checks meet guidelines', 0.0, 'Phone Number, Font Size Check, Name Check, Email Address, GPA Check, Degree Styling, University Name, University Styling, Job Title Styling', None),
    ('strong', 'presentation', 'spell_check', 0, 'good', 'We did not find any spelling errors in the resume.', 0.0, '', None),
    ('weak', 'competencies', 'analytical', 0, 'error', 'We recommend you to add more experiences which reflect your analytical skills well.', 6.0, '', None),
    ('weak', 'competencies', 'communication', 0, 'error', 'We recommend you to add more experiences which reflect your communication skills well.', 6.0, '', None),
    ('weak', 'competencies', 'initiative', 0, 'error', 'We recommend you to add more experiences which reflect your initiative skills well.', 6.0, '', None),
    ('weak', 'competencies', 'leadership', 0, 'error', 'We recommend you to add more experiences which reflect your leadership skills well.', 6.0, '', None),
    ('weak', 'competencies', 'teamwork', 0, 'error', 'We recommend you to add more experiences which reflect your teamwork skills well.', 6.0, '', None),
    ('weak', 'impact', 'action_oriented', 0, 'error', 'Bullet 1 does not start with an action verb.', 3.687, 'Responsible for the till and various tasks.', 0),
    ('weak', 'impact', 'action_oriented', 1, 'error', 'Bullet 3 does not start with an action verb.', 3.687, 'Was given the keys to the shop.', 2),
    ('weak', 'impact', 'action_oriented', 2, 'warn', 'Bullet 2 opens with the weak verb “Helped”.', 1.843, 'Helped customers find many things', 1),
    ('weak', 'impact', 'action_oriented', 3, 'warn', 'Bullet 3 is in the passive voice.', 0.0, 'Was given the keys to the shop.', 2),
    ('weak', 'impact', 'avoided_words', 0, 'warn', 'You have used some words which are usually considered as filler words.', 1.261, 'The 3', None),
    ('weak', 'impact', 'avoided_words', 1, 'error', 'You have included personal pronouns which should be avoided.', 1.261, 'I 2  I Am 1  I Can 1  My 1', None),
    ('weak', 'impact', 'extracurriculars', 0, 'error', 'Your resume shows no extra-curricular involvement.', 5.217, '', None),
    ('weak', 'impact', 'overuse', 0, 'good', 'No overused words detected.', 0.0, '', None),
    ('weak', 'impact', 'specifics', 0, 'error', 'Include more quantification of the impact and scope of your work in the following sections:', 5.217, 'experience', 0),
    ('weak', 'impact', 'specifics', 1, 'warn', 'Few bullets name the tool, method or system you used.', 5.217, '', None),
    ('weak', 'presentation', 'number_of_pages', 0, 'good', '1 page(s) - within the 1-page benchmark.', 0.0, '', None),
    ('weak', 'presentation', 'overall_format', 0, 'error', 'Bullet Check', 8.0, '', None),
    ('weak', 'presentation', 'overall_format', 1, 'error', 'Date Formatting', 8.0, '', None),
    ('weak', 'presentation', 'overall_format', 2, 'good', '7 Checks meet guidelines', 0.0, 'Bullet Alignment, Font Size Check, References, Page Margins, Section Styling, Image Check, Section Spacing', None),
    ('weak', 'presentation', 'section_specific', 0, 'error', 'Phone Number', 0.5, '', None),
    ('weak', 'presentation', 'section_specific', 1, 'error', 'GPA Check', 0.5, '', None),
    ('weak', 'presentation', 'section_specific', 2, 'good', '7 Checks meet guidelines', 0.0, 'Font Size Check, Name Check, Email Address, Degree Styling, University Name, University Styling, Job Title Styling', None),
    ('weak', 'presentation', 'spell_check', 0, 'error', 'We found some spelling errors in your resume. Please reconsider the highlighted words.', 2.0, 'till  customers', None),
])
def resume_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All findings; what a part's claim adds up to what the part has lost."""
    return found(spark, Rules())[1].select("doc_id", "module", "part", "seq", "severity", "message", "points_lost", "evidence", "line_index")


@golden("doc_id VARCHAR, rank INTEGER, module VARCHAR, part VARCHAR, message VARCHAR, points DOUBLE", [
    ('columns', 1, 'presentation', 'overall_format', 'Bullet Alignment', 8.0),
    ('columns', 2, 'presentation', 'overall_format', 'Section Styling', 8.0),
    ('columns', 3, 'competencies', 'analytical', 'We recommend you to add more experiences which reflect your analytical skills well.', 6.0),
    ('columns', 4, 'competencies', 'communication', 'We recommend you to add more experiences which reflect your communication skills well.', 6.0),
    ('columns', 5, 'competencies', 'leadership', 'We recommend you to add more experiences which reflect your leadership skills well.', 6.0),
    ('columns', 6, 'competencies', 'teamwork', 'We recommend you to add more experiences which reflect your teamwork skills well.', 6.0),
    ('columns', 7, 'competencies', 'initiative', 'We recommend you to add more experiences which reflect your initiative skills well.', 6.0),
    ('columns', 8, 'impact', 'specifics', 'Few bullets name the tool, method or system you used.', 5.22),
    ('columns', 9, 'impact', 'avoided_words', 'You have used some words which are usually considered as filler words.', 1.56),
    ('columns', 10, 'impact', 'overuse', 'You have overused a few words :', 1.16),
    ('strong', 1, 'competencies', 'communication', 'We recommend you to add more experiences which reflect your communication skills well.', 3.5),
    ('strong', 2, 'competencies', 'teamwork', 'We recommend you to add more experiences which reflect your teamwork skills well.', 3.5),
    ('strong', 3, 'competencies', 'initiative', 'We recommend you to add more experiences which reflect your initiative skills well.', 3.5),
    ('strong', 4, 'competencies', 'analytical', 'We recommend you to add more experiences which reflect your analytical skills well.', 2.5),
    ('strong', 5, 'impact', 'action_oriented', '2 of 6 bullets open with an ordinary verb rather than a strong one.', 0.28),
    ('strong', 6, 'impact', 'avoided_words', 'You have used some words which are usually considered as filler words.', 0.26),
    ('weak', 1, 'presentation', 'overall_format', 'Bullet Check', 8.0),
    ('weak', 2, 'presentation', 'overall_format', 'Date Formatting', 8.0),
    ('weak', 3, 'competencies', 'analytical', 'We recommend you to add more experiences which reflect your analytical skills well.', 6.0),
    ('weak', 4, 'competencies', 'communication', 'We recommend you to add more experiences which reflect your communication skills well.', 6.0),
    ('weak', 5, 'competencies', 'leadership', 'We recommend you to add more experiences which reflect your leadership skills well.', 6.0),
    ('weak', 6, 'competencies', 'teamwork', 'We recommend you to add more experiences which reflect your teamwork skills well.', 6.0),
    ('weak', 7, 'competencies', 'initiative', 'We recommend you to add more experiences which reflect your initiative skills well.', 6.0),
    ('weak', 8, 'impact', 'specifics', 'Include more quantification of the impact and scope of your work in the following sections:', 5.22),
    ('weak', 9, 'impact', 'extracurriculars', 'Your resume shows no extra-curricular involvement.', 5.22),
    ('weak', 10, 'impact', 'specifics', 'Few bullets name the tool, method or system you used.', 5.22),
])
def resume_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten findings that cost most."""
    return report.wins(found(spark, Rules())[1], Rules()).select("doc_id", "rank", "module", "part", "message", "points")


@golden("doc_id VARCHAR, filename VARCHAR, overall DOUBLE, zone VARCHAR, second VARCHAR, presentation DOUBLE, verb VARCHAR, first_win VARCHAR, delta DOUBLE, words BIGINT", [
    ('columns', 'columns', 44.2, 'yellow', 'specifics', 13.0, 'Built', 'Bullet Alignment', -25.8, 74),
    ('strong', 'strong', 86.5, 'green', 'specifics', 30.0, 'GPA', 'We recommend you to add more experiences which reflect your communication skills well.', 16.5, 163),
    ('weak', 'weak', 23.6, 'red', 'specifics', 11.0, 'responsible for', 'Bullet Check', -46.4, 59),
])
def report_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report as JSON, read again."""
    rules = Rules()
    reports = report.documents(*found(spark, rules), rules)
    at = lambda path: F.get_json_object("report", path)
    return reports.select("doc_id", at("$.filename").alias("filename"), at("$.overall").cast("double").alias("overall"), at("$.zone").alias("zone"), at("$.modules[0].subscores[1].key").alias("second"), at("$.modules[1].points").cast("double").alias("presentation"), at("$.bullets[0].verb").alias("verb"), at("$.top_actions[0].message").alias("first_win"), at("$.benchmark.delta_from_mean").cast("double").alias("delta"), at("$.meta.word_count").cast("long").alias("words"))


@golden("doc_id VARCHAR, summary VARCHAR", [
    ('columns', '==============================================================================\n  columns\n  OVERALL  44.2 / 100     YELLOW ZONE     3th percentile\n==============================================================================\n  Impact          31.2 / 40   [######################......]\n      Action Oriented                 9.6 / 10    (1 issue)\n      Specifics                       5.2 / 10    (1 issue)\n      Overuse                         5.8 / 7     (1 issue)\n      Avoided Words                   5.4 / 7     (1 issue)\n      Extra-curriculars               5.2 / 5   \n  Presentation    13.0 / 30   [############................]\n      Overall Format                  0.0 / 16    (2 issues)\n      Number of Pages                 1.0 / 1   \n      Essential Sections              9.0 / 9   \n      Section Specific                0.0 / 1     (1 issue)\n      Spell Check                     3.0 / 3   \n  Competencies     0.0 / 30   [............................]\n      Analytical Skills               0.0 / 6     (1 issue)\n      Communication Skills            0.0 / 6     (1 issue)\n      Leadership Skills               0.0 / 6     (1 issue)\n      Teamwork Skills                 0.0 / 6     (1 issue)\n      Initiative Skills               0.0 / 6     (1 issue)\n\n  BLOCKERS\n    ! Only 74 words. At least 200 are needed before a score means anything: add 126 more.\n\n  BIGGEST WINS AVAILABLE\n    +8.0   Bullet Alignment\n    +8.0   Section Styling\n    +6.0   We recommend you to add more experiences which reflect your analytical skills well.\n           -> Add a bullet on an experience that shows it.\n    +6.0   We recommend you to add more experiences which reflect your communication skills well.\n           -> Add a bullet on an experience that shows it.\n    +6.0   We recommend you to add more experiences which reflect your leadership skills well.\n           -> Add a bullet on an experience that shows it.\n    +6.0   We recommend you to add more experiences which reflect your teamwork skills well.\n           -> Add a bullet on an experience that shows it.\n    +6.0   We recommend you to add more experiences which reflect your initiative skills well.\n           -> Add a bullet on an experience that shows it.\n    +5.2   Few bullets name the tool, method or system you used.\n           -> Name what the work was done with.\n=============================================================================='),
    ('strong', '==============================================================================\n  strong\n  OVERALL  86.5 / 100     GREEN ZONE     88th percentile\n==============================================================================\n  Impact          39.5 / 40   [############################]\n      Action Oriented                10.2 / 10    (1 issue)\n      Specifics                      10.4 / 10  \n      Overuse                         7.0 / 7   \n      Avoided Words                   6.7 / 7     (1 issue)\n      Extra-curriculars               5.2 / 5   \n  Presentation    30.0 / 30   [############################]\n      Overall Format                 16.0 / 16  \n      Number of Pages                 1.0 / 1   \n      Essential Sections              9.0 / 9   \n      Section Specific                1.0 / 1   \n      Spell Check                     3.0 / 3   \n  Competencies    17.0 / 30   [################............]\n      Analytical Skills               3.5 / 6     (1 issue)\n      Communication Skills            2.5 / 6     (1 issue)\n      Leadership Skills               6.0 / 6   \n      Teamwork Skills                 2.5 / 6     (1 issue)\n      Initiative Skills               2.5 / 6     (1 issue)\n\n  BLOCKERS\n    ! Only 163 words. At least 200 are needed before a score means anything: add 37 more.\n\n  BIGGEST WINS AVAILABLE\n    +3.5   We recommend you to add more experiences which reflect your communication skills well.\n           -> Add a bullet on an experience that shows it.\n    +3.5   We recommend you to add more experiences which reflect your teamwork skills well.\n           -> Add a bullet on an experience that shows it.\n    +3.5   We recommend you to add more experiences which reflect your initiative skills well.\n           -> Add a bullet on an experience that shows it.\n    +2.5   We recommend you to add more experiences which reflect your analytical skills well.\n           -> Add a bullet on an experience that shows it.\n    +0.3   2 of 6 bullets open with an ordinary verb rather than a strong one.\n           -> Trade a few for stronger verbs.\n    +0.3   You have used some words which are usually considered as filler words.\n           -> Leave them out.\n=============================================================================='),
    ('weak', '==============================================================================\n  weak\n  OVERALL  23.6 / 100     RED ZONE     0th percentile\n==============================================================================\n  Impact          12.6 / 40   [#########...................]\n      Action Oriented                 1.2 / 10    (4 issues)\n      Specifics                       0.0 / 10    (2 issues)\n      Overuse                         7.0 / 7   \n      Avoided Words                   4.4 / 7     (2 issues)\n      Extra-curriculars               0.0 / 5     (1 issue)\n  Presentation    11.0 / 30   [##########..................]\n      Overall Format                  0.0 / 16    (2 issues)\n      Number of Pages                 1.0 / 1   \n      Essential Sections              9.0 / 9   \n      Section Specific                0.0 / 1     (2 issues)\n      Spell Check                     1.0 / 3     (1 issue)\n  Competencies     0.0 / 30   [............................]\n      Analytical Skills               0.0 / 6     (1 issue)\n      Communication Skills            0.0 / 6     (1 issue)\n      Leadership Skills               0.0 / 6     (1 issue)\n      Teamwork Skills                 0.0 / 6     (1 issue)\n      Initiative Skills               0.0 / 6     (1 issue)\n\n  BLOCKERS\n    ! Only 59 words. At least 200 are needed before a score means anything: add 141 more.\n\n  BIGGEST WINS AVAILABLE\n    +8.0   Bullet Check\n    +8.0   Date Formatting\n    +6.0   We recommend you to add more experiences which reflect your analytical skills well.\n           -> Add a bullet on an experience that shows it.\n    +6.0   We recommend you to add more experiences which reflect your communication skills well.\n           -> Add a bullet on an experience that shows it.\n    +6.0   We recommend you to add more experiences which reflect your leadership skills well.\n           -> Add a bullet on an experience that shows it.\n    +6.0   We recommend you to add more experiences which reflect your teamwork skills well.\n           -> Add a bullet on an experience that shows it.\n    +6.0   We recommend you to add more experiences which reflect your initiative skills well.\n           -> Add a bullet on an experience that shows it.\n    +5.2   Include more quantification of the impact and scope of your work in the following sections:\n           -> Say how many, how often, how much.\n=============================================================================='),
])
def resume_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report as text."""
    rules = Rules()
    cards, all_found, _ = found(spark, rules)
    return report.as_text(cards, all_found, rules)
