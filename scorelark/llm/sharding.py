"""Consistent-hash ring with virtual nodes and bounded loads.

Every shard owns many virtual nodes on a ring; a row belongs to the first node
clockwise from its key's place. Each shard takes so many rows only: the bounds
add up to all rows and differ by one at most, so the counts do too. Rows that
overflow a full shard continue clockwise to the next shard with room.

The ring is cut into ``PLACES`` places, and a place with more than its part of
the rows into layers, as many as parts it holds: at most twice ``PLACES`` cells
in all, so the only thing that the driver sees is one count a cell, whatever the
size of the table. From the counts it walks the ring once and gives each cell's
rows, by their order in the cell, to shards: a plan of a bounded number of
ranges, which is broadcast. Rows are numbered within their own cell only.

A row's place comes from its key; its layer, which spreads rows of one hot key,
from its content, so only rows equal in key and text share a cell whatever
happens. Null keys hash like any key; a null text counts as an empty one, and
its size is 1; a very long text moves as its size and checksum only; repeated
rows each get their own slot; an empty table gives no rows. Extra columns of the
input stay out.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scorelark.llm.common import kept

PLACES = 1 << 12
#: Virtual nodes of a shard.
NODES = 64


def ring(shards: int, nodes: int = NODES, places: int = PLACES) -> list[tuple[int, int]]:
    """(place, shard) of all virtual nodes, clockwise. A taken place sends the node one further."""
    if shards * nodes > places // 2:
        raise ValueError(f"{shards} shards of {nodes} nodes need a ring of more than {places} places")
    taken: dict[int, int] = {}
    for shard in range(shards):
        for node in range(nodes):
            place = int.from_bytes(hashlib.sha256(f"{shard}/{node}".encode()).digest()[:8], "big") % places
            while place in taken:
                place = (place + 1) % places
            taken[place] = shard
    return sorted(taken.items())


def bounds(rows: int, shards: int) -> list[int]:
    return [rows // shards + (shard < rows % shards) for shard in range(shards)]


def deal(counts: dict[tuple[int, int], int], shards: int, nodes: int = NODES, places: int = PLACES) -> list[tuple[int, int, int, int, int, int]]:
    """(place, layer, first, last, shard, slot of the first): who takes which rows of a cell.

    First every shard takes the rows of its own cells, clockwise, up to its
    bound. Then what overflowed goes on clockwise, cell after cell.
    """
    around = ring(shards, nodes, places)
    starts = [place for place, _ in around]
    room = bounds(sum(counts.values()), shards)
    filled = [0] * shards
    onward: list[list[int]] = [[]] * len(around)  # from each node the shards in the order in which a row meets them
    for k in range(len(around)):
        onward[k] = list(dict.fromkeys(around[(k + i) % len(around)][1] for i in range(len(around))))
    plan, over = [], []

    def give(cell: tuple[int, int], first: int, rows: int, shard: int) -> None:
        plan.append((*cell, first, first + rows - 1, shard, filled[shard]))
        filled[shard] += rows

    for cell in sorted(counts):
        node = bisect_left(starts, cell[0]) % len(starts)
        shard = around[node][1]
        take = min(counts[cell], room[shard] - filled[shard])
        if take:
            give(cell, 1, take, shard)
        if take < counts[cell]:
            over.append((cell, take + 1, counts[cell] - take, node))
    for cell, first, rows, node in over:
        for shard in onward[node]:
            take = min(rows, room[shard] - filled[shard])
            if take:
                give(cell, first, take, shard)
                first, rows = first + take, rows - take
            if not rows:
                break
    return plan


def located(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``size``, ``text_crc32``, ``__place`` and ``__layer`` of every row. Texts are read once."""
    data = F.encode(F.coalesce(F.col(text_col), F.lit("")), "utf-8")
    rows = docs.select(F.col(id_col), (F.octet_length(data) + 1).cast("long").alias("size"), F.crc32(data).alias("text_crc32"))
    rows = kept(rows.withColumn("__place", F.pmod(F.xxhash64(F.lit("place"), F.col(id_col).cast("string")), F.lit(PLACES)).cast("int")), "rows")
    counts = {r[0]: r[1] for r in rows.groupBy("__place").count().collect()}  # PLACES at most
    part = max(1, -(-sum(counts.values()) // PLACES))
    layers = docs.sparkSession.createDataFrame([(place, -(-n // part)) for place, n in counts.items()], "__place int, __layers long")
    layer = F.pmod(F.xxhash64(F.lit("layer"), F.col(id_col).cast("string"), "text_crc32", "size"), F.col("__layers")).cast("int")
    return rows.join(F.broadcast(layers), "__place").select(id_col, "size", "text_crc32", "__place", layer.alias("__layer"))


def shard_rows(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", nodes: int = NODES) -> DataFrame:
    """One row a document: ``id_col``, ``size`` (UTF-8 bytes and 1), ``text_crc32``, ``shard``, ``slot``, ``home_shard`` (whose node comes first)."""
    rows = located(docs, id_col, text_col)
    counts = {(r[0], r[1]): r[2] for r in rows.groupBy("__place", "__layer").count().collect()}  # 2 * PLACES at most
    around = ring(shards, nodes)
    starts = [place for place, _ in around]
    plan = [(*x, around[bisect_left(starts, x[0]) % len(starts)][1]) for x in deal(counts, shards, nodes)]
    ranges = docs.sparkSession.createDataFrame(plan, "__place int, __layer int, __first long, __last long, shard int, __slot long, home_shard int")
    order = Window.partitionBy("__place", "__layer").orderBy(F.col(id_col), "text_crc32", "size")
    numbered = rows.withColumn("__n", F.row_number().over(order))
    # a cell of a bounded number and a few more for the cells that are split: the plan's size is proven
    dealt = numbered.join(F.broadcast(ranges), (numbered["__place"] == ranges["__place"]) & (numbered["__layer"] == ranges["__layer"]) & F.col("__n").between(F.col("__first"), F.col("__last")))
    return dealt.select(id_col, "size", "text_crc32", "shard", (F.col("__slot") + F.col("__n") - F.col("__first")).alias("slot"), "home_shard")
