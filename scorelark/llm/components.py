"""Connected components of a graph of edges, by large and small stars, with no neighbourhood ever gathered in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelark.llm.common import kept, release


def _smallest(directed: DataFrame) -> DataFrame:
    """(v, u, m): the edges with the smallest neighbour of v, or v itself if that is smaller."""
    least = directed.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("m"))
    return directed.join(least, "v")


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """``node`` and ``component`` (its smallest node) of all nodes of ``edges`` (columns ``a`` and ``b``, long).

    Each round every node passes its smallest neighbour on, first to larger
    neighbours, then to smaller ones, until only stars are left. The rounds
    grow with the logarithm of the graph; each is written to the shared folder.
    """
    stars = kept(edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).where("v <> u").distinct(), label)
    while True:
        both = stars.unionByName(stars.select(F.col("u").alias("v"), F.col("v").alias("u")))
        large = _smallest(both).where("u > v").select(F.col("u").alias("v"), F.col("m").alias("u")).where("v <> u").distinct()
        small = _smallest(large)
        after = small.select(F.col("u").alias("v"), F.col("m").alias("u")).unionByName(small.select("v", F.col("m").alias("u"))).where("v <> u").distinct()
        after = kept(after, label)
        same = after.join(stars, ["v", "u"], "left_anti").isEmpty() and after.count() == stars.count()
        release(edges.sparkSession, stars)
        stars = after
        if same:
            break
    return stars.select(F.col("v").alias("node"), F.col("u").alias("component")).unionByName(stars.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct())
