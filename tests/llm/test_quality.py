import random

import numpy as np
import pytest

from scorelark.llm import quality

DOCS = "doc_id long, text string, lang string, source string, host string, quality int"
LABELS = "doc_id long, quality int, toxic int"


def corpus(seed, n=600):
    rng = random.Random(seed)
    common = [f"word{i}" for i in range(300)]
    docs, truth = [], {}
    for i in range(n):
        words = [rng.choice(common) for _ in range(rng.randint(5, 120))]
        poor, toxic = rng.random() < 0.2, rng.random() < 0.15
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(["blockhead", "numskull"])
        text = "### ".join(words).upper() + "!!!" if poor else " ".join(words) + "."
        docs.append((i, text, rng.choice(["en", "fr", None]), "big" if i % 3 == 0 else f"s{i % 40}", "x", 7))
        truth[i] = (poor, toxic)
    return docs, truth


@pytest.fixture(scope="module")
def given(spark):
    docs, truth = corpus(1)
    labels = [(i, int(not p), int(t)) for i, (p, t) in truth.items() if i % 2 == 0] + [(0, int(not truth[0][0]), int(truth[0][1])), (None, 0, 1), (99999, 1, 0), (1, None, None)]
    return docs, truth, spark.createDataFrame(labels, LABELS)


def test_held_out_documents(spark, given):
    docs, truth, labels = given
    got = {r.doc_id: r for r in quality.judged(spark.createDataFrame(docs, DOCS), labels).collect()}
    assert len(got) == len(docs)
    held_out = [i for i in truth if i % 2]
    right = sum(got[i].keep == (not any(truth[i])) for i in held_out)
    assert right >= 0.97 * len(held_out)
    assert all(0 <= r.p_poor <= 1 and 0 <= r.p_toxic <= 1 for r in got.values())


def test_accepted_keeps_rows_and_columns(spark, given):
    docs, truth, labels = given
    more = [(7000, None, None, None, None, None), (7001, "", "en", "only", None, None), docs[2], docs[2]]
    frame = spark.createDataFrame(docs + more, DOCS)
    got = quality.accepted(frame, labels)
    assert got.columns == frame.columns
    ids = [r.doc_id for r in got.collect()]
    decided = {}
    for r in quality.judged(frame, labels).collect():
        decided.setdefault(r.doc_id, []).append(r.keep)
    assert sorted(ids) == sorted(i for i, keeps in decided.items() for k in keeps if k)
    assert ids.count(2) in (0, 3)


def test_sparse_sites_shrink_to_what_is_above_them(spark):
    rows = [("big", "a", 2.0 if i < 80 else -3.0) for i in range(100)] + [("calm", "a", -3.0) for _ in range(100)] + [("calm", "b", 3.0), ("new", "a", 3.0)]
    scored = spark.createDataFrame(rows, "source string, lang string, __toxic double")
    sites = {(r.host, r.path): r for r in quality.site_rates(scored, {"toxic": None}).collect()}
    rates = {k: r.toxic_rate for k, r in sites.items()}
    whole = sites["big", "a"].toxic_all
    p = 1 / (1 + np.exp(-np.array([x for _, _, x in rows])))
    assert abs(whole - p.mean()) < 1e-9
    assert rates["calm", "a"] < whole < rates["big", "a"]
    assert rates["calm", "b"] < 0.95 and abs(rates["calm", "b"] - 0.95) > 0.1 and abs(rates["new", "a"] - whole) < abs(0.95 - whole)


def test_empty_tables_and_no_labels(spark, given):
    docs, _, labels = given
    assert quality.accepted(spark.createDataFrame([], DOCS), labels).count() == 0
    assert quality.accepted(spark.createDataFrame(docs[:20], DOCS), spark.createDataFrame([], LABELS)).count() == 20


def test_posteriors_against_numpy(spark, given):
    docs, _, labels = given
    frame = spark.createDataFrame(docs + [(8000, None, None, None, None, None), (8001, "word1 " * 300_000, "en", "only", "x", 1)], DOCS)
    models = quality.train(frame, labels)
    rows = [tuple(r) for r in frame.collect()]
    chance = lambda x: 1 / (1 + np.exp(-np.clip(x, -30, 30)))
    p = {}
    for t, model in models.items():
        logits = np.array([model.logit(w, np.array(s)) for w, s in (quality.features((r[1] or "").encode()) for r in rows)])
        own, everywhere = chance(logits), chance(logits).mean()
        hosts, paths = {}, {}
        for r, x in zip(rows, own):
            hosts.setdefault(r[3], []).append(x)
            paths.setdefault((r[3], r[2]), []).append(x)

        def strength(rates, n, over):
            rates, n, over = map(np.array, (rates, n, over))
            noise = over.mean() * (1 - over.mean())
            beyond = max((n * (rates - over) ** 2).sum() / n.sum() - noise / (n.sum() / len(n)), 1e-6)
            return min(max(noise / beyond - 1, 1.0), 1e6)

        kh = strength([np.mean(x) for x in hosts.values()], [len(x) for x in hosts.values()], [everywhere] * len(hosts))
        above = {h: (sum(x) + kh * everywhere) / (len(x) + kh) for h, x in hosts.items()}
        kp = strength([np.mean(x) for x in paths.values()], [len(x) for x in paths.values()], [above[h] for h, _ in paths])
        odds = lambda x: np.log(x / (1 - x))
        for r, logit, x in zip(rows, logits, own):
            h, s = hosts[r[3]], paths[r[3], r[2]]
            over = (sum(h) - x + kh * everywhere) / (len(h) - 1 + kh)
            rate = (sum(s) - x + kp * over) / (len(s) - 1 + kp)
            sway = np.clip(odds(np.clip(rate, 1e-6, 1 - 1e-6)) - odds(np.clip(everywhere, 1e-6, 1 - 1e-6)), -quality.SWAY, quality.SWAY)
            p[t, r[0]] = chance(logit + sway)
    for limit in (quality.SITES_SENT, 3):  # sites sent to all tasks, and joined by salt
        before, quality.SITES_SENT = quality.SITES_SENT, limit
        try:
            got = quality.judged(frame, labels).collect()
        finally:
            quality.SITES_SENT = before
        assert len(got) == len(rows)
        for r in got:
            assert abs(r.p_poor - p["poor", r.doc_id]) < 1e-6 and abs(r.p_toxic - p["toxic", r.doc_id]) < 1e-6
            assert r.keep == (r.p_poor < quality.REJECT and r.p_toxic < quality.REJECT)


def test_repeated_labelled_ids_give_the_same_sample(spark, monkeypatch):
    docs, _ = corpus(4, 200)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(200)], LABELS)
    again = docs + [(i, t + " other", lang, s, h, q) for i, t, lang, s, h, q in docs[:60]] + docs[:30]
    monkeypatch.setattr(quality, "SAMPLE", 50)
    samples = [sorted((r["__id"], r.quality, tuple(r.words)) for r in quality.sample(spark.createDataFrame(again, DOCS).repartition(n), labels).collect()) for n in (1, 7)]
    assert samples[0] == samples[1] and len(samples[0]) == 50 == len({i for i, _, _ in samples[0]})
