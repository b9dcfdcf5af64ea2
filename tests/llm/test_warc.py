import base64
import gzip
import hashlib

import pytest

from scorelark.llm import warc

SCHEMA = "page_id long, url string, html string, size string, hex string"


def want(rows, least=0):
    first = {}
    for i, _, h, *_ in rows:
        h = h or ""
        if i is not None and len(h.encode()) >= least:
            first[h] = min(first.get(h, i), i)
    out = []
    for i, _, h, *_ in rows:
        h = h or ""
        refers = first.get(h)
        refers = None if refers is None or refers == i or len(h.encode()) < least else refers
        out.append((i, len(h.encode()), base64.b32encode(hashlib.sha1(h.encode()).digest()).decode(), "response" if refers is None else "revisit", refers))
    return sorted(out, key=str)


PAGES = [
    (5, "https://a.example.com/x?y=1#z", "<p>one</p>", "s", "h"), (2, "http://b.example.com", "<p>one</p>", "s", "h"), (9, None, "<p>one</p>", "s", "h"),
    (1, "http://c/", None, "s", "h"), (3, "http://c/", "", "s", "h"), (4, "bad url\r\nWARC-Type: x", "été\r\n\r\nWARC/1.1\r\n\r\n漢 🙂\n\n", None, None),
    (7, "http://d/", "only", "s", "h"), (7, "http://d/", "only", "s", "h"), (None, "http://e/", "<p>one</p>", "s", "h"), (None, "http://e/", "nameless", "s", "h"), (None, "http://e/", "nameless", "s", "h"),
    (11, "http://long/", "x" * 3_000_000, "s", "h"),
]


@pytest.mark.parametrize("least", [0, 5])
def test_round_trip(spark, least, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 1 << 20)
    rows = PAGES + [(100 + i, f"http://x/{i}", f"page {i % 40}", "s", "h") for i in range(200)]
    path = warc.write(spark.createDataFrame(rows, SCHEMA), least=least)
    found = warc.captures(spark, path)
    got = sorted((tuple(r) for r in warc.digests(found).collect()), key=str)
    assert got == want(rows, least)
    texts = {(r.metadata.fields.get("page-id"), r.capture.payload) for r in found.collect() if r.capture.type == "response"}
    assert {("4", PAGES[5][2]), ("11", PAGES[-1][2])} <= texts
    assert all(r.request is not None and r.metadata is not None for r in found.collect())


def test_records_of_other_writers():
    one = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 5\r\n\r\na\r\n\r\n" + b"\r\n\r\n"
    two = b"WARC/1.0\r\nwarc-type: response\r\nContent-Length: 0\r\n\r\n" + b"\r\n\r\n"
    for data in (one + two, gzip.compress(one + two), gzip.compress(one) + gzip.compress(two)):
        for step in (1, 7, 1 << 20):
            got = list(warc.records(warc.unpacked(data, step)))
            assert [(h["warc-type"], b) for h, b in got] == [("warcinfo", b"a\r\n\r\n"), ("response", b"")]
    with pytest.raises(ValueError):
        list(warc.records([one[:-6]]))


def test_empty(spark):
    path = warc.write(spark.createDataFrame([], SCHEMA))
    assert warc.digests(warc.captures(spark, path)).count() == 0
