import zlib
from collections import Counter

import pytest

from scorelark.llm import sharding

SCHEMA = "doc_id long, text string, shard string, size string"


def placed(spark, rows, shards=8):
    return sharding.shard_rows(spark.createDataFrame(rows, SCHEMA), shards).collect()


@pytest.mark.parametrize("n", [0, 1, 7, 8, 9, 1003])
def test_counts_and_slots(spark, n):
    got = placed(spark, [(i, "x" * (i % 50), "a", "b") for i in range(n)])
    counts = Counter(r.shard for r in got)
    assert len(got) == n and (n < 8 or max(counts.values()) - min(counts.values()) <= 1) and max(counts.values(), default=0) <= -(-n // 8)
    for shard, rows in counts.items():
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(rows))


def test_values_nulls_repeats_and_one_hot_key(spark):
    rows = [(None, "été" + str(i % 5), None, None) for i in range(300)] + [(5, None, "a", "b")] * 200 + [(i, "", "a", "b") for i in range(100)]
    got = placed(spark, rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _, _ in rows)
    counts = Counter(r.shard for r in got)
    assert [counts[s] for s in range(8)] == sharding.bounds(600, 8)
    for shard, n in counts.items():
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(n))


def test_overflow_goes_clockwise_only(spark):
    counts = {(p, 0): 1 + p % 3 for p in range(0, sharding.PLACES, 2)}
    around = sharding.ring(8)
    starts = [p for p, _ in around]
    plan = sharding.deal(counts, 8)
    assert sum(x[3] - x[2] + 1 for x in plan) == sum(counts.values())
    home = sum(x[3] - x[2] + 1 for x in plan if around[sharding.bisect_left(starts, x[0]) % len(starts)][1] == x[4])
    assert home > 0.85 * sum(counts.values())


def test_few_rows_move_when_a_shard_joins(spark):
    rows = [(i, "t", "a", "b") for i in range(4000)]
    before = {r.doc_id: r.shard for r in placed(spark, rows, 8)}
    after = {r.doc_id: r.shard for r in placed(spark, rows, 9)}
    assert sum(before[i] != after[i] for i in before) < 0.4 * len(rows)  # dealing by the remainder moves eight ninths


@pytest.mark.parametrize("shards,seed", [(8, 1), (9, 1), (3, 2)])
def test_ring_row_by_row(spark, shards, seed):
    """Every row walks the ring by itself: its own shard if that has room, and once all have tried theirs, the next with room clockwise."""
    import random

    rng = random.Random(seed)
    rows = [(rng.randrange(700), "t" * rng.randrange(30) + str(i % 9), "a", "b") for i in range(900)] + [(7, f"hot {i}", "", "") for i in range(500)] + [(None, "x" * 300_000, "", ""), (5, "", "", ""), (5, None, "", "")]
    frame = spark.createDataFrame(rows, SCHEMA)
    cells = sorted((r["__place"], r["__layer"], r.doc_id is not None, r.doc_id or 0, r.text_crc32, r.size) for r in sharding.located(frame).collect())
    around = sharding.ring(shards)
    room, filled = sharding.bounds(len(rows), shards), [0] * shards
    after = lambda place: next((k for k, (p, _) in enumerate(around) if p >= place), 0)
    want, over = Counter(), []
    for cell in cells:
        home = around[after(cell[0])][1]
        if filled[home] < room[home]:
            want[(*cell[2:], home, filled[home], home)] += 1
            filled[home] += 1
        else:
            over.append((cell, home))
    for cell, home in over:
        k = after(cell[0])
        while filled[around[k % len(around)][1]] >= room[around[k % len(around)][1]]:
            k += 1
        shard = around[k % len(around)][1]
        want[(*cell[2:], shard, filled[shard], home)] += 1
        filled[shard] += 1
    got = Counter((r.doc_id is not None, r.doc_id or 0, r.text_crc32, r.size, r.shard, r.slot, r.home_shard) for r in sharding.shard_rows(frame, shards).collect())
    assert got == want


def test_a_hot_key_is_cut_into_layers(spark):
    frame = spark.createDataFrame([(1, f"text {i}", "a", "b") for i in range(30_000)] + [(i, "t", "a", "b") for i in range(60_000)], SCHEMA)
    counts = [r["count"] for r in sharding.located(frame).groupBy("__place", "__layer").count().collect()]
    assert max(counts) <= 120 and len(counts) <= 2 * sharding.PLACES
