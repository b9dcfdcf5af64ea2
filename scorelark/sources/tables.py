"""Inputs: tables, the lines of documents, text files, and folders of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelark.rules import Rules


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes up to which a table is dealt anew before costly work on its texts.
SMALL = 64 << 20


def spread(docs: DataFrame, by: str = "doc_id") -> DataFrame:
    """A small table dealt over all cores, as its one row group is read by one task; a large table has splits enough and isn't moved."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return docs.repartition(docs.sparkSession.sparkContext.defaultParallelism, by) if size <= SMALL else docs


def lines(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``line_no`` from 0, ``text``: a row a line. Documents without a text have none."""
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "text"))


def text_folder(spark: SparkSession, path: str, pattern: str = "*.txt") -> DataFrame:
    """``doc_id`` (the file's path), ``line_no``, ``text`` of all files below a folder, however deep, in the order of their paths within a file's lines."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).option("wholetext", "true").text(path)
    return lines(files.select(F.input_file_name().alias("doc_id"), F.col("value").alias("text")))


#: What is known of a cohort that nothing is known of.
NO_COHORT = {"name": "general", "label": "General cohort", "mean": 62.0, "stdev": 14.0, "n": 0}
COHORT = "label string, n long, mean double, stdev double, median double, min double, max double, module_means map<string,double>"


def cohorts(spark: SparkSession, path: str) -> DataFrame:
    """Cohort statistics as JSON files, named by their file, with the fields that are public."""
    files = spark.read.schema(COHORT).option("multiLine", "true").json(path)
    return files.select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1).alias("name"), "*")


def cohort(spark: SparkSession, rules: Rules, name: str | None = None, path: str | None = None) -> DataFrame:
    """One cohort: of the rules, else of the files, else the one that stands for none."""
    name = name or rules["benchmark.default"]
    inline = rules.get(f"benchmark.{name}")
    schema = "name string, " + COHORT
    if isinstance(inline, dict):
        known = {"name": name} | inline
    elif path is not None:
        there = cohorts(spark, path).where(F.col("name") == name)
        if not there.isEmpty():
            return there
        known = NO_COHORT
    else:
        known = NO_COHORT
    fields = [f.split()[0] for f in schema.split(", ")]
    return spark.createDataFrame([tuple(known.get(f) for f in fields)], schema)


def write_cohort(stats: DataFrame, path: str) -> None:
    """Write cohort statistics as JSON lines."""
    stats.write.mode("overwrite").json(path)


#: Lines that make every rule of the engine fire: document, line, text.
FIXTURE = [
    (-1, 0, "Spearheaded the migration of 2.4M records, cutting cost by 38%"),
    (-1, 1, "Led a team of five engineers and raised $450K in sponsorship"),
    (-1, 2, "Successfully helped with various tasks as needed"),
    (-1, 3, "Responsible for filing; I was able to learn, such as I can"),
    (-1, 4, "Reports were generated weekly and the award was given to us"),
    (-1, 5, "Independently tested dashboards in Tableau, Python and SQL"),
    (-2, 0, "Market research on 3 firms"),
    (-2, 1, "Co-authored a paper in 2023; GPA: 3.9/4.0"),
    (-2, 2, "Platform Team – Built the pipeline with scikit-learn and c++"),
    (-2, 3, "Working on reports: planned studies I-III"),
    (-2, 4, "We have my own view; MY plan and my PLAN"),
    (-2, 5, "• Relevant Coursework: Modern Control Theory"),
    (-2, 6, "- GPA: 3.75 / 4.00"),
    (-2, 7, "DAFx 2026 - Accepted Demo: synthesis"),
    (-3, 0, "Write to jo@example.com or (843) 555-7672, https://example.com/a?b=1"),
    (-3, 1, "References available on request"),
    (-3, 2, "-"),
    (-3, 3, "o joined and used and made; joined using, making; joined, used"),
    (-3, 4, "• ● operated"),
    (-3, 5, "  "),
    (-4, 0, "Analyzed data in SQL, then analyzed logs; analyzing several reports; a number of people"),
    (-4, 1, "Provided help, providing support; built and rebuilt, built a tool, building it"),
    (-4, 2, "Supported 3 teams; supporting them and supported us; developed it, developed that, developing this"),
    (-4, 3, "Their work was quickly and carefully reviewed; reference on request"),
    (-4, 4, "Skills: 2019 workshop presented by her"),
    (-4, 5, "Incoming analyst, 2025; expected to lead"),
    (-5, 0, "Engineered a Python model that cut cost by 40% for five teams and saved much time."),
    (-5, 1, "Automated twelve dashboards in Tableau with SQL and raised use by 30% within two months."),
]


def fixture(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FIXTURE, "doc_id long, line_no int, text string")


def with_fixture(docs: DataFrame) -> DataFrame:
    """The lines of documents and of the fixture, together."""
    return lines(docs).unionByName(fixture(docs.sparkSession))


def fixture_sql() -> str:
    return ", ".join(f"({d}, {n}, '" + t.replace("'", "''") + "')" for d, n, t in FIXTURE)


#: The same lines in DuckDB's SQL.
LINES_SQL = f"""lines AS (
  SELECT doc_id, CAST(line_no - 1 AS INTEGER) AS line_no, text
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents)
  UNION ALL SELECT CAST(doc_id AS BIGINT), CAST(line_no AS INTEGER), text FROM (VALUES {fixture_sql()}) AS f(doc_id, line_no, text))"""
