import numpy as np
import pytest
from pyspark.sql import functions as F

from scorelark.llm import vafile

SCHEMA = "vec_id long, embedding array<float>, score string"


def brute(rows, k):
    import math

    fine = {}
    for i, v, _ in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            fine[i, tuple(math.floor(256 * float(np.float32(x))) for x in v)] = None
    out = set()
    for i, v in fine:
        if i % 10 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in fine if j != i and len(w) == len(v))[:k]
            out |= {(i, rank, j, -s) for rank, (s, j) in enumerate(best, 1)}
    return out


@pytest.mark.parametrize("seed,ties", [(1, False), (2, True)])
def test_against_brute_force(spark, seed, ties, monkeypatch):
    rng = np.random.default_rng(seed)
    monkeypatch.setattr(vafile, "BLOCK_ROWS", 100)
    monkeypatch.setattr(vafile, "BLOCK_QUERIES", 16)
    draw = (lambda: rng.integers(-2, 3, 6) / 4) if ties else (lambda: rng.normal(size=6))
    rows = [(i, [float(x) for x in draw()], "x") for i in range(400)] + [(400 + i, [0.5] * 6, "copy") for i in range(150)]
    rows += [(1000, None, ""), (1010, [1.0, None, 0.0, 0.0, 0.0, 0.0], ""), (1020, [float("nan")] * 6, ""), (1030, [float("inf")] * 6, ""), (1040, [1.0, 2.0], ""), (1041, [1.5, -2.0], ""), (None, [0.1] * 6, ""), (1050, [], ""), rows[20], rows[20]]
    got = vafile.top_k(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 10 == 0)
    assert {(r.query_id, r.rank, r.vec_id, r.score) for r in got.collect()} == brute(rows, 5)
    assert got.count() == len(brute(rows, 5))


def test_large_components_stay_exact(spark):
    rows = [(i, [float(2**20 + i), float(-(2**21) - 3 * i)], "") for i in range(20)]
    got = vafile.top_k(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 10 == 0)
    assert {(r.query_id, r.rank, r.vec_id, r.score) for r in got.collect()} == brute(rows, 5)


def test_empty(spark):
    assert vafile.top_k(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 10 == 0).count() == 0


def test_cells_are_bytes_and_few_exact_vectors_are_read():
    rng = np.random.default_rng(3)
    vectors = np.floor(256 * rng.normal(size=(4000, 32)))
    block = vafile.Block(np.arange(4000), vectors)
    assert block.file.cells.dtype == np.uint8 and block.file.cells.nbytes * 8 == vectors.nbytes
    low, high = block.file.bounds(vectors[:40])
    exact = vectors[:40] @ vectors.T
    assert (low <= exact).all() and (exact <= high).all()
    for i in range(40):
        want = sorted((-int(s), j) for j, s in enumerate(exact[i]) if j != i)[:5]
        assert block.best(vectors[i], low[i], high[i], i, 5) == want
    assert block.reads < 40 * 0.02 * 4000


@pytest.mark.parametrize("size", [2.0**52, 2.0**70, 2.0**300])
def test_scores_beyond_doubles_use_the_same_file(size):
    rng = np.random.default_rng(4)
    vectors = np.floor(rng.normal(size=(1500, 12)) * size)
    block = vafile.Block(np.arange(1500), vectors)
    low, high = block.file.bounds(vectors[:10])
    for i in range(10):
        exact = [sum(int(a) * int(b) for a, b in zip(vectors[i], v)) for v in vectors]
        assert block.best(vectors[i], low[i], high[i], i, 5, True) == sorted((-s, j) for j, s in enumerate(exact) if j != i)[:5]
    assert block.reads < 10 * 0.1 * 1500


def test_extra_columns_no_queries_and_equal_vectors(spark):
    rows = [(i, [1.0, 2.0], "x") for i in range(40)]
    got = vafile.top_k(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") == 7).collect()
    assert [(r.rank, r.vec_id) for r in sorted(got, key=lambda r: r.rank)] == [(1, 0), (2, 1), (3, 2), (4, 3), (5, 4)]
    assert vafile.top_k(spark.createDataFrame(rows, SCHEMA), F.lit(False)).count() == 0
