"""Exact top-k search by inner product over vector-approximation files.

Rows are dealt into blocks. A block's approximation file holds one byte for
each component of each vector: its cell, of ``CELLS`` equal ones between the
least and the largest value of the component in the block. A scan of the cells
gives an upper and a lower bound of every score of a query, at the cost of one
product with the bytes. Exact vectors are then read in the order of the upper
bounds until the kth score so far is above the next bound, which makes the
result certain. The blocks' results are merged by rank.

Each component x becomes floor(scale * x), x as double; scores are integers.
Bounds are taken in doubles with a margin for their rounding. Scores are taken
in doubles where these hold every integer that can occur, and in whole numbers
of any size beyond. Queries are dealt into blocks too, so a task holds one block
of each, of a bounded number of rows; the number of tasks grows with the
product, as a stated query set against all rows must. Nothing is broadcast.

Vectors that are null or hold a null, NaN or infinite component take no part.
Vectors only meet those of their own length. Rows equal in id and vector count
once; ids, not rows, are excluded as a query's own. Null ids take no part. Equal
scores go by the smaller id; of an id with several vectors each may be found. An
empty vector scores 0 with all empty ones. Scores beyond a long raise an error.
An empty table, or one without queries, gives no rows. Extra columns stay out.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELLS = 256
#: Rows of a block on average, and queries.
BLOCK_ROWS, BLOCK_QUERIES = 8_192, 8_192
#: Exact vectors are read so many at a time; bounds are scanned for so many queries and rows at a time.
READ, SCAN, SCAN_ROWS = 32, 128, 1024
#: Doubles hold all integers below; and the share of the largest score by which bounds may be off.
WHOLE, MARGIN = 2**51, 2.0**-40
OUT = "query_id long, vec_id long, score long"


class Approximation:
    """The approximation file of one block: a byte a component, and each component's grid."""

    def __init__(self, vectors: np.ndarray):
        self.low = vectors.min(0)
        self.step = (vectors.max(0) / CELLS - self.low / CELLS) * (1 + 1e-12)  # the largest value is in the last cell
        step = np.where(self.step > 0, self.step, 1.0)
        self.cells = np.empty(vectors.shape, np.uint8)
        for start in range(0, len(vectors), SCAN_ROWS):
            part = vectors[start : start + SCAN_ROWS]
            self.cells[start : start + SCAN_ROWS] = np.clip(np.floor((part - self.low) / step), 0, CELLS - 1)
        self.reach = np.maximum(np.abs(vectors.max(0)), np.abs(self.low))

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of all scores, a row a query."""
        steps, n = queries * self.step, len(self.cells)
        low = np.empty((len(queries), n))
        for start in range(0, n, SCAN_ROWS):
            low[:, start : start + SCAN_ROWS] = steps @ self.cells[start : start + SCAN_ROWS].T.astype(np.float64)
        low += (queries @ self.low)[:, None]
        margin = MARGIN * (np.abs(queries) @ self.reach) + MARGIN
        # a value is at most one step above its cell's lower limit
        high = low + (np.maximum(steps, 0).sum(1) + margin)[:, None]
        low += (np.minimum(steps, 0).sum(1) - margin)[:, None]
        return low, high


class Block:
    """Exact vectors behind an approximation file; ``reads`` counts those that were read."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors, self.reads = ids, vectors, 0
        self.file = Approximation(vectors)

    def scores(self, rows: np.ndarray, query: np.ndarray, whole: bool) -> list[int]:
        self.reads += len(rows)
        if not whole:
            return [int(s) for s in self.vectors[rows] @ query]
        q = [int(x) for x in query]
        return [sum(a * int(b) for a, b in zip(q, v, strict=True)) for v in self.vectors[rows]]

    def best(self, query: np.ndarray, low: np.ndarray, high: np.ndarray, own: int, k: int, whole: bool = False) -> list[tuple[int, int]]:
        """The k best (negative score, id) but for the query's own, ties to the smaller id."""
        low = np.where(self.ids == own, -np.inf, low)
        sure = np.partition(low, len(low) - k)[len(low) - k] if len(low) > k else -np.inf  # k rows reach this
        near = np.flatnonzero((high >= sure) & (self.ids != own))
        near = near[np.argsort(-high[near], kind="stable")]
        found: list[tuple[int, int]] = []
        for start in range(0, len(near), READ):
            rows = near[start : start + READ]
            if len(found) == k and -found[-1][0] > high[rows[0]]:
                break
            found = sorted(found + [(-s, int(i)) for s, i in zip(self.scores(rows, query, whole), self.ids[rows], strict=True)])[:k]
        return found


def _search(k: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        asks, rows = pdf[pdf["is_query"]], pdf[~pdf["is_query"]]
        if not len(asks) or not len(rows):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        vectors = np.stack(rows["v"].to_numpy()).astype(np.float64, copy=False).reshape(len(rows), -1)
        queries = np.stack(asks["v"].to_numpy()).astype(np.float64, copy=False).reshape(len(asks), -1)
        whole = np.abs(vectors).max(initial=0) * np.abs(queries).max(initial=0) * max(1, vectors.shape[1]) >= WHOLE
        block, own = Block(rows["vec_id"].to_numpy(), vectors), asks["vec_id"].to_numpy()
        out: list[tuple[int, int, int]] = []
        for start in range(0, len(queries), SCAN):
            part = queries[start : start + SCAN]
            for q, low, high, me in zip(part, *block.file.bounds(part), own[start : start + SCAN], strict=True):
                out += [(int(me), i, -s) for s, i in block.best(q, low, high, me, k, whole)]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id``, ``rank`` from 1, ``vec_id``, ``score``: the k best rows of every query, itself left out."""
    blocks, turns = (max(1, -(-df.count() // size)) for df, size in ((vectors, BLOCK_ROWS), (vectors.where(is_query), BLOCK_QUERIES)))
    fine = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("is_query"))
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    fine = fine.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.coalesce(sound, F.lit(False)))
    # floor() gives a long, which would clip; such large products are whole numbers already
    scaled = F.transform("v", lambda x: F.when(F.abs(x) < 2.0**45, F.floor(x * F.lit(scale)).cast("double")).otherwise(x * F.lit(scale)))
    fine = fine.select("vec_id", "is_query", scaled.alias("v"))
    fine = fine.withColumn("h", F.xxhash64("vec_id", "v")).dropDuplicates(["vec_id", "h"])
    numbers = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    candidates = fine.select(F.pmod("h", F.lit(blocks)).alias("block"), numbers(turns).alias("turn"), F.size("v").alias("dims"), F.lit(False).alias("is_query"), "vec_id", "v")
    queries = fine.where("is_query").select(numbers(blocks).alias("block"), F.pmod("h", F.lit(turns)).alias("turn"), F.size("v").alias("dims"), F.lit(True).alias("is_query"), "vec_id", "v")
    local = candidates.unionByName(queries).groupBy("block", "turn", "dims").applyInPandas(_search(k), OUT)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return local.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
