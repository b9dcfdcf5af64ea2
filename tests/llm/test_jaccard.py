import random

import pytest

from scorelark.llm import jaccard
from scorelark.llm.components import components

SCHEMA = "doc_id long, text string, n string, sid string"


def shingles(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def brute(rows):
    sets = [shingles(t) for _, t, _, _ in rows]
    at = list(range(len(rows)))

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                at[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        least[root(i)] = min(least.get(root(i), r[0]), r[0])
    return sorted((r[0], len(sets[i]), least[root(i)]) for i, r in enumerate(rows))


def near(rng, words, edits):
    out = list(words)
    for _ in range(edits):
        out[rng.randrange(len(out))] = f"e{rng.random()}"
    return " ".join(out)


def corpus(seed):
    rng = random.Random(seed)
    passage = " ".join(f"p{i}" for i in range(60))
    rows, i = [], 0

    def add(text):
        nonlocal i
        rows.append((i, text, "x", "y"))
        i += 1

    for _ in range(12):  # families near and beyond the limit, chains among them
        words = [f"w{rng.randrange(400)}" for _ in range(rng.randint(6, 120))]
        for _ in range(rng.randint(1, 14)):
            add(near(rng, words, rng.choice([0, 0, 1, 2, 3, 5])))
        chain = words
        for _ in range(6):
            chain = near(rng, chain, 1).split()
            add(" ".join(chain))
    for _ in range(30):
        add(passage + " " + " ".join(f"u{rng.random()}" for _ in range(rng.choice([0, 3, 12, 16, 80]))))
    for _ in range(40):
        add(" ".join(f"u{rng.random()}" for _ in range(rng.randint(1, 60))))
    for text in (None, "", "  \n\t", "one", "ONE", "a b c d", "A  b c\nd", "a b c d e", "a b c d e f", "é x", "É x", "x\x1cy z", "x\x1cy z"):
        add(text)
    rng.shuffle(rows)
    rows += rows[:3]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = corpus(seed)
    got = jaccard.clusters(spark.createDataFrame(rows, SCHEMA).repartition(5))
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == brute(rows)


@pytest.mark.parametrize("bits", [7, 12])
def test_same_links_when_the_tables_hold_few_shingles(spark, monkeypatch, bits):
    rows = corpus(7)
    monkeypatch.setattr(jaccard, "MAP_BITS", bits)
    monkeypatch.setattr(jaccard, "SLOT_BITS", 6)
    monkeypatch.setattr(jaccard, "FLUSH", 500)
    got = jaccard.clusters(spark.createDataFrame(rows, SCHEMA))
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == brute(rows)


def test_one_of_each_and_nulls(spark):
    rows = [(2, "a b c d e f g", "x", "y"), (1, "a b c d e f g", "x", "y"), (3, None, "x", "y"), (4, "", "x", "y"), (None, "q r s", "x", "y"), (1, "a b c d e f g", "x", "y")]
    kept = jaccard.one_of_each(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["1", "3", "4", "None"]


def test_empty(spark):
    assert jaccard.clusters(spark.createDataFrame([], SCHEMA)).count() == 0


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(5, 5), (200, 201)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 140), 100), 200: 200, 201: 200}


def test_ids_that_repeat_with_other_texts(spark):
    x, y = "a b c d e f g h", "k l m n o p q r"
    rows = [(1, x), (5, x), (5, y), (6, y), (7, y), (8, None), (8, None), (8, "")]
    for n in (1, 5):
        got = jaccard.one_of_each(spark.createDataFrame([(*r, "e", "f") for r in rows], SCHEMA).repartition(n)).collect()
        assert sorted((r.doc_id, str(r.text)) for r in got if r.doc_id != 8) == [(1, x), (5, y)] and sum(r.doc_id == 8 for r in got) == 1


def test_very_long_text(spark):
    long = " ".join(f"w{i}" for i in range(300_000))
    got = jaccard.clusters(spark.createDataFrame([(1, long, "", ""), (2, long + " more", "", ""), (3, "w1 w2 w3 w4 w5", "", "")], SCHEMA)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == [(1, 299_996, 1), (2, 299_997, 1), (3, 1, 3)]
