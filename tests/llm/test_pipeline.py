import hashlib
import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

import corpus_pipeline
from scorelark.llm import bpe, leaks, privacy, quality
from test_jaccard import brute as brute_clusters
from test_jaccard import near

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(900)]
    items = [(i, " ".join(rng.choice(words) for _ in range(30)) + "? " + " ".join(rng.choice(words) for _ in range(8)) + ".") for i in range(8)]
    rows, labels = [], []
    for i in range(300):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(20, 120)))
        bad = i % 7 == 3
        if i % 10 == 1 and rows:
            text = near(rng, rng.choice([r[1] for r in rows if "!!!" not in r[1]]).split(), 1)
        if i % 25 == 2:
            text += " " + items[i // 25 % 8][1]
        if i % 11 == 5:
            text += f" mail to jo{i}@example.com or +1 (843) 555-7{i:03d}"
        if bad:
            text = " ".join(f"{w.upper()}!!!" for w in text.split())
        rows.append((i, text, rng.choice(["en", "fr"]), f"s{i % 5}", len(text)))
        if i % 2:
            labels.append((i, int(not bad), 0))
    rows += [(400, None, None, None, None), (401, "", "en", "s1", 0)]
    at = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"file://{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"file://{at}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"file://{at}/benchmark.parquet")
    return f"file://{at}", items


def test_every_stage_against_brute_force(spark, tables):
    at, items = tables
    docs = spark.read.parquet(f"{at}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = sorted((tuple(r) for r in docs.collect()), key=lambda r: r[0])
        docs = corpus_pipeline.kept(stage(spark, docs, at), name)
        after = {r[0]: r for r in docs.collect()}
        seen[name] = len(before), len(after)
        if name == "quality_classifier":
            keep = {r.doc_id for r in quality.judged(spark.createDataFrame(before, SCHEMA), spark.read.parquet(f"{at}/labels.parquet")).collect() if r.keep}
            want = {r[0]: r for r in before if r[0] in keep}
            assert not any((r[1] or "").count("!!!") > 3 for r in after.values()) and len(after) >= 0.97 * sum((r[1] or "").count("!!!") < 3 for r in before)
        elif name == "ngram_jaccard_join":
            want = {r[0]: r for r, (_, _, least) in zip(before, brute_clusters([(r[0], r[1], 0, 0) for r in before]), strict=True) if r[0] == least}
        elif name == "benchmark_decontamination":
            held = [set(leaks.shingles(leaks.words(t))) for _, t in items]
            want = {r[0]: r for r in before if not any(len(h & leaks.shingles(leaks.words(r[1] or ""))) >= 0.8 * len(h) for h in held)}
        elif name == "personal_data":
            texts = {r[0]: r[1] if r[1] is None else privacy.rewrite(r[1], [(a, b, k) for k, a, b in privacy.base_spans(r[1])]) for r in before}
            want = {r[0]: (r[0], texts[r[0]], r[2], r[3], r[4] if r[1] is None else len(texts[r[0]])) for r in before}
        else:
            codec = bpe.codec_for(open(bpe.default_ranks(), "rb").read(), bpe.default_pattern())
            want = {r[0]: (r[0], len(codec.encode(r[1] or "")) // 4, hashlib.sha256(codec.encode(r[1] or "")).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in before}
        assert {k: tuple(v) for k, v in after.items()} == {k: tuple(v) for k, v in want.items()}, name
        if name != "byte_level_bpe":
            assert docs.columns == columns
    assert all(a < b for b, a in list(seen.values())[:3]) and seen["personal_data"][0] == seen["personal_data"][1]
    assert sorted(map(tuple, corpus_pipeline.run(spark, at).collect())) == sorted(map(tuple, docs.collect()))


def test_empty_documents(spark, tables):
    at, _ = tables
    docs = spark.createDataFrame([], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.kept(stage(spark, docs, at), name)
        assert docs.count() == 0


CLASHING = ["n", "host", "path", "sid", "grp", "first", "txt", "key", "term", "kind", "leaks", "spans", "component_id", "data", "keep"]


def test_repeated_rows_long_texts_and_columns_with_clashing_names(spark, tables):
    at, items = tables
    docs = spark.read.parquet(f"{at}/documents.parquet")
    long = " ".join(f"word{i}" for i in range(60_000)) + " write to jo@long.example.com"
    more = spark.createDataFrame([(900, long, "en", "s1", len(long))] * 3 + [(901, long + " end", "fr", "s2", len(long) + 4), (902, "hello " + items[0][1], "en", "s1", 5), (902, "hello " + items[0][1], "en", "s1", 5)], SCHEMA)
    wide = docs.unionByName(more)
    for name in CLASHING:
        wide = wide.withColumn(name, wide.doc_id.cast("string"))
    for name, stage in corpus_pipeline.STAGES:
        wide = corpus_pipeline.kept(stage(spark, wide, at), name)
        if name != "byte_level_bpe":
            assert wide.columns == [*docs.columns, *CLASHING] and wide.where("doc_id <> CAST(n AS LONG)").count() == 0
    got = [r.doc_id for r in wide.collect()]
    assert len(got) == len(set(got)) and 900 in got and 901 not in got and 902 not in got
