import random
import re

import pytest

from scorelark.llm import licenses

SCHEMA = "doc_id long, text string, h string, w string, label string"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def brute(text):
    got = words(text)
    places = [(k, label) for label, phrase in licenses.PHRASES for k in range(len(got)) if got[k : k + len(phrase.split())] == phrase.split()]
    return len(got), len(places), min((k for k, _ in places), default=None), max((k for k, _ in places), default=None), ",".join(sorted({label for _, label in places}))


def corpus(seed):
    rng = random.Random(seed)
    bits = ["cc", "by", "general", "public", "license", "all", "rights", "reserved", "GNU", "x", "café", "Kind", "the", "Licensed under CC BY-NC 4.0.", "All rights reserved", "0"]
    glue = [" ", "-", "\n", ", ", "_", "\x7f", "  "]
    rows = [(i, "".join(rng.choice(bits) + rng.choice(glue) for _ in range(rng.randint(0, 40))), "a", "b", "c") for i in range(150)]
    rows += [(200, None, "a", "b", "c"), (201, "", "a", "b", "c"), (202, "!!!", "a", "b", "c"), rows[3], rows[3], (None, "cc by", "a", "b", "c"), (None, "cc by cc by", "a", "b", "c")]
    rows += [(300, "Licensed under the Apache License, Version 2.0", "", "", ""), (301, "licensed under the very old apache license version 2.0", "", "", ""), (302, "Apache License", "", "", ""), (303, "word " * 50_000 + "Released under the MIT License.", "", "", "")]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_base_against_brute_force(spark, seed):
    rows = corpus(seed)
    got = licenses.scan(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_base, str(r.first_word), str(r.last_word), r.base_labels) for r in got) == sorted((str(i), n, b, str(f), str(z), s) for i, t, *_ in rows for n, b, f, z, s in [brute(t)])
    by_id = {r.doc_id: r for r in got}
    assert by_id[300].labels == "apache-2.0" and by_id[300].score == 1.0
    assert by_id[301].labels == "apache-2.0" and 0.8 <= by_id[301].score < 1
    assert by_id[302].labels == "" and by_id[302].score == 0.0
    assert by_id[303].labels == "mit"
    assert all(set(r.base_labels.split(",")) <= set(r.labels.split(",")) for r in got if r.base_labels)


def test_no_python_in_the_plan(spark):
    plan = licenses.scan(spark.createDataFrame(corpus(1), SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan)


def test_empty(spark):
    assert licenses.scan(spark.createDataFrame([], SCHEMA)).count() == 0


def brute_labels(text, templates):
    """(label, share) of every template that some band of diagonals covers, hit by hit."""
    got, out = words(text), []
    for label, template in templates:
        t = words(template)
        k = licenses.RUNS[len(t) >= licenses.LONG]
        gap = max(1, int(len(t) * (licenses.STRETCH - 1)))
        hits = {(i - a, a) for a in range(len(t) - k + 1) for i in range(len(got) - k + 1) if got[i : i + k] == t[a : a + k]}
        best = max((len({a for d, a in hits if first <= d <= first + gap}) for first in {d for d, _ in hits}), default=0) / (len(t) - k + 1)
        if best >= licenses.COVER:
            out.append((label, best))
    return out


def test_labels_against_brute_force(spark):
    rng = random.Random(5)
    long = " ".join(rng.choice(["of", "the", "any", *(f"w{i}" for i in range(600))]) for _ in range(1500))
    templates = [*licenses.TEMPLATES, ("long", long)]
    rows = []
    for i in range(120):
        text = rng.choice(templates)[1].split()
        for _ in range(rng.randint(0, 6)):
            at = rng.randrange(len(text) + 1)
            text[at : at + rng.choice([0, 0, 1, 3])] = [rng.choice(["extra", "2.0", "the of any"])] * rng.choice([0, 1, 2])
        rows.append((i, "filler word " * rng.randint(0, 20) + " ".join(text) + " 2.0 2.0" * rng.randint(0, 2), "", "", ""))
    rows += [(200, "x " * (licenses.STRETCH_WORDS - 4) + long, "", "", ""), (201, " ".join([long] * 3), "", "", ""), (202, long[: len(long) // 2], "", "", "")]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, SCHEMA), templates=templates).collect()}
    for i, text, *_ in rows:
        found = brute_labels(text, templates)
        base = brute(text)[4].split(",") if brute(text)[4] else []
        assert got[i].labels == ",".join(sorted({label for label, _ in found} | set(base))), i
        assert abs(got[i].score - max([share for _, share in found] + [1.0] * bool(base), default=0.0)) < 1e-12
    assert {got[i].labels for i in (200, 201)} == {"long"} and got[202].labels == ""


def test_inserted_and_repeated_words(spark):
    rows = [(0, "Licensed under the terms of the Apache License, Version 2.0", "", "", ""), (1, "Licensed under the Apache License, Version 2.0 2.0 2.0 2.0", "", "", ""), (2, "of the under the in the " * 50, "", "", "")]
    frame = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r for r in licenses.scan(frame).collect()}
    assert got[0].labels == got[1].labels == "apache-2.0" and got[1].score == 1.0 and got[2].labels == ""
    found = {(r.doc_id, r.label, r.start_word, r.end_word) for r in licenses.spans(frame).collect()}
    # the last two diagonals of "2.0" lie within the words by which a span may outgrow its template
    assert {(0, "apache-2.0", 0, 11), (1, "apache-2.0", 0, 12)} <= found
    whole = spark.createDataFrame([(9, "see: cc by, all rights reserved", "", "", "")], SCHEMA)
    assert {(r.label, r.start_word, r.end_word) for r in licenses.spans(whole).collect()} == {("cc-by", 1, 3), ("reserved", 3, 6)}
