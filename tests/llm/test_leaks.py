import random

import pytest

from scorelark.llm import leaks

DOCS, ITEMS = "doc_id long, text string, item_id string", "item_id long, text string, doc_id string"


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)] + ["the", "of", "and", "in"] * 200
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, f"{say(rng.randint(8, 60))}. {say(rng.randint(5, 20))}?", "x") for i in range(60)] + [(60, say(300), "x"), (61, None, "x"), (62, "", "x"), (63, items_one := "lone word", "x")]
    docs, planted = [], set()
    for d in range(150):
        text = say(rng.randint(0, 900))
        if d % 5 == 0:
            item = items[rng.randrange(61)]
            words = text.split()
            cut = rng.randint(0, len(words))
            text = " ".join([*words[:cut], item[1].upper().replace(" ", "\n", 2), *words[cut:]])
            planted.add((d, item[0]))
        docs.append((d, text, "z"))
    docs += [(500, None, "z"), (501, "", "z"), (502, f"just a {items_one} here", "z"), docs[0]]
    return docs, items, planted | {(502, 63)}


def brute(docs, items):
    """Every item against every document by shingles alone."""
    out = set()
    for d, text, _ in docs:
        tokens = leaks.words(text or "")
        there = {n: {tuple(tokens[i : i + n]) for i in range(len(tokens) - n + 1)} for n in range(1, leaks.SHINGLE + 1)}
        for i, item, _ in items:
            if not item:
                continue
            question, answer = leaks.parts(item)
            sets = [leaks.shingles(leaks.words(item)), leaks.shingles(question), leaks.shingles(answer)]
            whole, q, a = [(sum(g in there[len(g)] for g in s) / len(s)) if s else 1.0 for s in sets]
            if whole >= leaks.SAME and q and a:
                out.add((d, i))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_planted_and_brute_force(spark, seed):
    docs, items, planted = corpus(seed)
    got = leaks.leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()
    found = {(r.doc_id, r.item_id) for r in got}
    assert found == brute(docs, items) == planted
    assert len(got) == len(found) + sum(d == 0 for d, _ in found)  # the repeated document has its own rows


def test_wand_retrieves_all_above_threshold():
    docs, items, _ = corpus(3)
    index = leaks.ItemIndex([(i, t) for i, t, _ in items])
    rng = random.Random(4)
    for _ in range(300):
        terms = rng.sample(range(len(index.term)), 60) + index.item_of[:0]
        entry = rng.randrange(len(index.threshold))
        own = [t for t, p in enumerate(index.postings) if any(e == entry for e, _ in p)]
        terms = list(set(terms + rng.sample(own, max(1, len(own) * 3 // 4))))
        scores = {}
        for t in terms:
            for e, x in index.postings[t]:
                scores[e] = scores.get(e, 0.0) + x
        want = {e for e, s in scores.items() if s >= index.threshold[e] + 1e-9}
        assert want <= {e for e, _ in index.query(terms)} <= {e for e, s in scores.items() if s >= index.threshold[e] - 1e-9}


def test_index_in_shares_gives_the_same(spark, monkeypatch):
    docs, items, planted = corpus(5)
    monkeypatch.setattr(leaks, "INDEX_POSTINGS", 900)
    frame, bench = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    assert {(r.doc_id, r.item_id) for r in leaks.leaks(frame, bench).collect()} == planted
    assert sorted(r.doc_id for r in leaks.clean(frame, bench).collect()) == sorted(d for d, _, _ in docs if d not in {d for d, _ in planted})


def test_empty_tables(spark):
    docs, items, _ = corpus(6)
    assert leaks.leaks(spark.createDataFrame([], DOCS), spark.createDataFrame(items, ITEMS)).count() == 0
    assert leaks.leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame([], ITEMS)).count() == 0
    assert leaks.clean(spark.createDataFrame(docs, DOCS), spark.createDataFrame([], ITEMS)).count() == len(docs)


def test_edited_and_partly_quoted_items():
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(3000)] + ["the", "of", "and", "in"] * 200
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [say(n) for n in (9, 15, 25, 28, 40, 60, 300)]
    two = [[*say(n), ".", *say(m)] for n, m in ((8, 5), (20, 5), (55, 5), (30, 20))]
    joined = lambda x: " ".join(x).replace(" .", ".")
    index = leaks.ItemIndex([(k, joined(x)) for k, x in enumerate(items + two)] + [(100 + k, joined(say(30))) for k in range(60)])
    found = lambda words: {x["item_id"] for x in index.search(joined([*say(200), *words, *say(200)]).encode())}
    for k, item in enumerate(items + two):
        assert found(item) == {k}
        for at in range(len(item)):
            if item[at] != ".":
                assert found([*item[:at], "edited", *item[at + 1 :]]) == {k}, (k, at)
                assert found([*item[:at], "edited", *item[at:]]) == {k}, (k, at)
    assert all(found(items[6][a : a + 200]) == {6} for a in (0, 50, 100))
    assert found(two[3][:31]) == set() and found(two[3][10:45]) == {10}
    assert not any(found(say(300)) for _ in range(20))


def test_very_long_text_and_repeated_items(spark):
    docs, items, _ = corpus(11)
    text = "w1 the of " * 200_000 + items[3][1] + " and in" * 200_000
    got = leaks.leaks(spark.createDataFrame([(1, text, "z")], DOCS), spark.createDataFrame([items[3], items[3], (3, items[4][1], "x")], ITEMS)).collect()
    assert [(r.doc_id, r.item_id) for r in got] == [(1, 3)] * 2


def test_an_index_at_its_bound_is_small():
    import tracemalloc

    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(20_000)]
    items = [(i, " ".join(rng.choices(vocabulary, k=100))) for i in range(leaks.INDEX_POSTINGS // 1000)]  # a tenth of the bound
    tracemalloc.start()
    index = leaks.ItemIndex(items)
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert len(index.entries) > 90_000 and held < 50 << 20
