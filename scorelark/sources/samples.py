"""Small documents with a layout, laid out here word by word: what the rules of structure and presentation are tried on.

Pages are of US letter size. A line is put as it would be set: names large and
bold, headings bold, roles bold with their dates at the right, bullets hanging.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

WIDTH, HEIGHT, MARGIN, LEADING, EM = 612.0, 792.0, 54.0, 14.0, 0.5
WORDS = "doc_id string, page int, word_pos int, text string, x0 double, x1 double, top double, bottom double, size double, font string"
PAGES = "doc_id string, page int, width double, height double, n_images int, n_rects int, n_curves int"
PLAIN, BOLD, ITALIC = "Sans", "Sans-Bold", "Sans-Oblique"

WEAK = [
    ("name", "Sam Doe"), ("plain", "sam.doe@example.com"), ("gap", ""),
    ("head", "OBJECTIVE"), ("plain", "I am looking for a role where I can use my skills"), ("gap", ""),
    ("head", "EXPERIENCE"), ("role", "Shop Helper, Corner Store Group", "Sept 2021-May 2025"),
    ("dash", "Responsible for the till and various tasks."), ("dash", "Helped customers find many things"), ("dash", "Was given the keys to the shop."), ("gap", ""),
    ("head", "EDUCATION"), ("role", "Bachelor of Arts, Some College", "May 2025"), ("plain", "GPA 3.2"), ("gap", ""),
    ("plain", "References available upon request"),
]
STRONG = [
    ("name", "Alex Roe"), ("plain", "(555) 010-0199 | alex@example.com | Springfield, IL"), ("gap", ""),
    ("head", "EDUCATION"), ("role", "Springfield University, Bachelor of Science in Computing", "May 2026"), ("bullet", "GPA: 3.9/4.0"), ("gap", ""),
    ("head", "EXPERIENCE"), ("role", "Software Engineer Intern, Northwind Systems", "Jun 2025 - Aug 2025"),
    ("bullet", "Engineered a Python pipeline that cut nightly processing from 9 hours to 40 minutes for 12 teams across the company"),
    ("bullet", "Automated 35 reports in SQL and Tableau, saving 20 hours of manual work a week for analysts"),
    ("bullet", "Led a team of four to launch a dashboard used by 300 people in its first month after release"),
    ("role", "Research Assistant, Springfield Robotics Laboratory", "Sep 2024 - May 2025"),
    ("bullet", "Optimized a simulation in C++ and reduced its memory use by 45% over two semesters of careful work"),
    ("bullet", "Presented results to 80 people at a regional workshop and won second prize among 25 entries"), ("gap", ""),
    ("head", "LEADERSHIP & ACTIVITIES"), ("role", "President, Student Computing Society of Springfield", "Sep 2023 - Present"),
    ("bullet", "Raised $4,500 in sponsorship and doubled membership to 120 students within one academic year overall"), ("gap", ""),
    ("head", "SKILLS"), ("plain", "Python, SQL, Java, Tableau, Linux, Git"),
]
#: A column of facts beside one of prose.
COLUMNS = [("name", "Kim Poe"), ("plain", "kim@example.com")], [
    ("head", "SKILLS"), *(("plain", f"Tool {k}") for k in "ABCDEF"), ("head", "LANGUAGES"), ("plain", "French"), ("plain", "German"),
], [
    ("head", "EXPERIENCE"), *(("bullet", f"Built part {k} of the engine with care") for k in range(1, 7)), ("head", "EDUCATION"), ("plain", "Some College"), ("plain", "2024"), ("plain", "Honors"),
]


class Sheet:
    def __init__(self, doc: str):
        self.doc, self.rows = doc, []

    def put(self, text: str, x: float, y: float, size: float = 10.0, font: str = PLAIN) -> float:
        for word in text.split():
            end = x + len(word) * size * EM
            self.rows.append((self.doc, 1, len(self.rows), word, round(x, 2), round(end, 2), round(y, 2), round(y + size, 2), size, font))
            x = end + size * EM
        return x

    def right(self, text: str, y: float) -> None:
        self.put(text, WIDTH - MARGIN - (len(text)) * 10 * EM, y)

    def lines(self, items, x: float, y: float, room: float = WIDTH - 2 * MARGIN) -> float:
        for kind, text, *more in items:
            if kind == "gap":
                y += 6
                continue
            if kind == "name":
                self.put(text, x, y, 18.0, BOLD)
                y += 10
            elif kind == "head":
                self.put(text, x, y, 11.0, BOLD)
            elif kind == "role":
                self.put(text, x, y, 10.0, BOLD)
                self.right(more[0], y)
            elif kind in ("bullet", "dash"):
                self.put("•" if kind == "bullet" else "-", x + 4, y)
                line = ""
                for word in [*text.split(), None]:
                    if word is None or len(f"{line} {word}") * 10 * EM > room - 12:
                        self.put(line, x + 12, y)
                        y, line = (y + LEADING if word is not None else y), word
                    else:
                        line = f"{line} {word}".strip()
            else:
                self.put(text, x, y)
            y += LEADING
        return y


def rows() -> list[tuple]:
    out = []
    for name, items in (("weak", WEAK), ("strong", STRONG)):
        sheet = Sheet(name)
        sheet.lines(items, MARGIN, 40.0)
        out += sheet.rows
    sheet = Sheet("columns")
    top = sheet.lines(COLUMNS[0], MARGIN, 40.0)
    sheet.lines(COLUMNS[1], MARGIN, top + 10, 140.0)
    sheet.lines(COLUMNS[2], 250.0, top + 10, 300.0)
    return out + sheet.rows


def words(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(rows(), WORDS)


def pages(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(doc, 1, WIDTH, HEIGHT, 0, 0, 0) for doc in ("weak", "strong", "columns")], PAGES)
