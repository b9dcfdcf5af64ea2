"""One document at a time over HTTP: a WSGI application around a function that scores.

``POST /api/score`` takes a form with a ``file``; everything else is refused.
Uploads are bounded before they are read, and never touch a disk. Batches go
through DataFrames instead.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable
from http import HTTPStatus

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from scorelark.operators import report, scoring, structure
from scorelark.rules import Rules

MOST_BYTES, CHUNK, DRAINED = 8 << 20, 1 << 16, 2 << 20
#: Characters of a form's boundary.
BOUNDARY = (1, 70)


class Refused(Exception):
    """A request that isn't scored: a status, and what the sender is told."""

    def __init__(self, status: int, why: str):
        super().__init__(why)
        self.status, self.why = status, why


def form_fields(body: bytes, content_type: str) -> dict[str, list[tuple[str | None, bytes]]]:
    """(file name, content) by field of a multipart form, to the byte: the line end before a delimiter is the delimiter's."""
    named = re.search(r'(?i)boundary=(?:"([^"]+)"|([^\s;]+))', content_type or "")
    boundary = (named.group(1) or named.group(2)) if named else ""
    if not BOUNDARY[0] <= len(boundary) <= BOUNDARY[1]:
        return {}
    out: dict[str, list[tuple[str | None, bytes]]] = {}
    for part in (b"\r\n" + body).split(b"\r\n--" + boundary.encode("latin-1", "replace"))[1:]:
        if part.startswith(b"--"):
            break
        head, found, content = part.partition(b"\r\n")[2].partition(b"\r\n\r\n")
        told = head.decode("utf-8", "replace")
        name, file = re.search(r'(?<![a-z])name="([^"]*)"', told), re.search(r'filename="([^"]*)"', told)
        if found and name:
            out.setdefault(name.group(1), []).append((file.group(1) if file else None, content))
    return out


def _chunks(stream, size: int) -> Iterable[bytes]:
    while size > 0 and (piece := stream.read(min(CHUNK, size))):
        size -= len(piece)
        yield piece


def read_body(environ: dict) -> bytes:
    """As many bytes as the request says it has, no more than ``MOST_BYTES``; of a longer one a part is read away, so that the answer arrives."""
    try:
        size = int(environ.get("CONTENT_LENGTH") or 0)
    except ValueError:
        size = 0
    if size > MOST_BYTES:
        for _ in _chunks(environ["wsgi.input"], DRAINED):
            pass
        raise Refused(413, f"file too large (limit {MOST_BYTES >> 20} MB)")
    return b"".join(_chunks(environ["wsgi.input"], size))


def bare_name(raw: str | None) -> str:
    """The last part of a path, of either kind, without line ends, no longer than a name may be."""
    name = re.sub(r"[\r\n\0]", "", re.split(r"[/\\]", raw or "")[-1]).strip()
    return name[:120] or "resume.pdf"


class Application:
    def __init__(self, score: Callable[[str, bytes], dict], origins: Iterable[str] = ()):
        self.score, self.origins = score, {o.rstrip("/") for o in origins}

    def _own(self, environ: dict) -> bool:
        origin, host = environ.get("HTTP_ORIGIN", "").rstrip("/"), environ.get("HTTP_HOST", "")
        return not origin or origin in self.origins or origin in (f"http://{host}", f"https://{host}")

    def answer(self, environ: dict) -> dict:
        method, path = environ.get("REQUEST_METHOD", "GET"), environ.get("PATH_INFO", "/")
        if method != "POST":
            raise Refused(404 if method in ("GET", "HEAD") else 405, "not found" if method in ("GET", "HEAD") else "method not allowed")
        if path != "/api/score":
            raise Refused(404, "unknown endpoint")
        if not self._own(environ):
            raise Refused(403, "cross-origin upload rejected")
        body = read_body(environ)
        if not body:
            raise Refused(400, "empty upload")
        name, content = next(iter(form_fields(body, environ.get("CONTENT_TYPE", "")).get("file", [])), (None, b""))
        if not content:
            raise Refused(400, "no file received")
        try:
            return self.score(bare_name(name), content)
        except MemoryError as e:
            raise Refused(503, "this document was too large to analyse") from e
        except Refused:
            raise
        except Exception as e:  # noqa: BLE001 - what went wrong inside is not for the sender
            environ["wsgi.errors"].write(f"scoring failed: {type(e).__name__}: {e}\n")
            raise Refused(500, "could not analyse this document") from e

    def __call__(self, environ: dict, start_response) -> list[bytes]:
        try:
            status, said = 200, self.answer(environ)
        except Refused as e:
            status, said = e.status, {"error": e.why}
        data = json.dumps(said, ensure_ascii=False).encode()
        allow = [("Allow", "GET, HEAD, POST")] if status == 405 else []
        start_response(f"{status} {HTTPStatus(status).phrase}", [("Content-Type", "application/json; charset=utf-8"), ("Content-Length", str(len(data))), ("X-Content-Type-Options", "nosniff"), ("Referrer-Policy", "no-referrer"), ("Cache-Control", "no-store"), *allow])
        return [b"" if environ.get("REQUEST_METHOD") == "HEAD" else data]


def text_scorer(spark: SparkSession, standard: list[str], terms: dict[str, list[str]], rules: Rules | None = None) -> Callable[[str, bytes], dict]:
    """Scores plain text in UTF-8; spelling is left out, as a vocabulary is a batch's."""
    from scorelark.operators import facts

    rules = rules or Rules.load()

    def score(name: str, content: bytes) -> dict:
        try:
            text = content.decode("utf-8")
        except UnicodeDecodeError as e:
            raise Refused(400, "that does not look like text") from e
        docs = spark.createDataFrame([(name, text)], "doc_id string, text string")
        lines = structure.placed_lines(structure.structured(structure.plain_documents(docs)), "blob", "name", *structure.GEOMETRY).persist()
        none = spark.createDataFrame([], "doc_id string, form string, n long, colour string, first int")
        whole = facts.document_facts(lines, standard, terms, rules).withColumns({"n_red": F.lit(0), "n_yellow": F.lit(0)})
        cards, marked = scoring.scores(whole, rules).persist(), report.bullets(lines, standard, terms, rules).persist()
        found = report.findings(cards, report.evidence(lines, marked, none), rules)
        out = json.loads(report.documents(cards, found, marked, rules).first().report)
        for held in (lines, cards, marked):
            held.unpersist()
        return out

    return score
