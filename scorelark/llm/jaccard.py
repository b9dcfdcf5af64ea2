"""Exact n-gram Jaccard join by grouped prefixes, and its connected components.

A document is the set of its five-word shingles. Sets of a similarity of 0.8
or more share a shingle among the first few of either in any common order, its
prefix. In the order by frequency prefixes hold rare shingles, and shingles that
no other document has can be left out of them, so most documents drop out
before anything is compared:

1. ``rarity``: all shingles of all documents are counted, as sorted blocks of
   48-bit keys split over ranges of the key space. A bitmap and a table of
   fixed size say which occur again and how often, roughly; what they say
   wrongly only changes the order, never the result.
2. ``prefixes``: each set's prefix in that order, without unique shingles.
   Documents of the same set become one node; nodes with the same prefix and
   size become one group, and only groups meet by the shingles of their prefix.
3. Every node is verified against the first node of its group, and every group
   against the first group of each shingle: a number of pairs in proportion to
   the nodes, however large a family of copies is. Their links make components.
4. Groups whose nodes lie in different components meet in full, shingle by
   shingle, are filtered by size and by the place of the shingle in either
   set, expanded to their nodes and verified: first a few pairs for every two
   components, then all that still lie apart. Pairs inside a component need no
   look: they can't change it.

So no link between different sets is lost, and copies are never paired up.
Sets are named by a 64-bit hash (wrong merges are expected once in 10^19 / n^2
tables of n different sets).

Null texts and texts without words have an empty set and link with nothing.
Repeated rows each give their row. Null ids take part, but never name a
component unless it has no other. Rows that share an id but not a text are two
documents. Very long texts are shingled whole, in their own task; an empty table
gives no rows; extra columns stay out of ``clusters`` and stay in ``one_of_each``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scorelark.llm.common import kept, release, resident, vacate
from scorelark.llm.components import components

WIDTH = 5
#: Two sets link when SHARE_OF * intersection >= SHARE * union.
SHARE, SHARE_OF = 80, 100
#: Shingles that a task holds before it hands them on, bytes of text whose shingles one range of keys takes on average, and ranges of a task.
FLUSH, RANGE_BYTES, RANGES_A_TASK, MOST_TASKS = 1 << 20, 1 << 23, 4, 1 << 16
KEY_BITS = 48
#: Pairs of groups that are tried first for two components; all others follow.
FIRST_TRIES = 8
#: Bits of the bitmap of shingles that occur again (of ``AGAIN`` times, or more if too many do), and slots of the table of common ones.
MAP_BITS, SLOT_BITS = 28, 22
AGAIN = (2, 8, 64, 512)
WORDS_KNOWN = 1 << 17
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_KNOWN:
            self.clear()
        got = self[word] = xxhash.xxh3_64_intdigest(word)
        return got


def shingle_set(data: bytes) -> np.ndarray:
    """The sorted distinct shingles of a text as 64-bit hashes. Bytes split at the six blanks of ASCII and lower A-Z only."""
    words = data.lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(resident("words", _Words).__getitem__, words), np.uint64, n)
    width = min(n, WIDTH)
    out = np.full(n - width + 1, width, np.uint64)
    for k in range(width):
        out += h[k : n - width + 1 + k] * ODD[k]
    out ^= out >> np.uint64(32)  # one-to-one, and spreads the order
    out *= ODD[0]
    out ^= out >> np.uint64(29)
    return np.unique(out)


def links(a: int, b: int, common: int) -> bool:
    return common > 0 and SHARE_OF * common >= SHARE * (a + b - common)


def prefix_size(n: int) -> int:
    return n - -(-SHARE * n // SHARE_OF) + 1 if n else 0


def _pack(keys: np.ndarray) -> bytes:
    """Sorted keys as differences."""
    gaps = np.diff(keys, prepend=np.uint64(0))
    small = len(gaps) == 0 or gaps[1:].max(initial=0) < 1 << 32
    return b"\0" + keys[:1].tobytes() + gaps[1:].astype("<u4").tobytes() if small else b"\1" + keys.tobytes()


def _unpack(data: bytes) -> np.ndarray:
    if data[:1] == b"\1":
        return np.frombuffer(data, "<u8", offset=1)
    gaps = np.frombuffer(data, "<u4", offset=9)
    return np.cumsum(np.concatenate((np.frombuffer(data, "<u8", 1, 1), gaps.astype(np.uint64))))


def _data(docs: DataFrame, text_col: str):
    return F.encode(F.coalesce(F.col(text_col), F.lit("")), "utf-8").alias("data")


def _count_ranges(docs: DataFrame, text_col: str, ranges: int) -> DataFrame:
    """(part, tag, keys): per task and range of keys, the keys that are in one of its documents, and again those in several (tag: how many)."""
    shift = np.uint64(64 - KEY_BITS)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def blocks() -> pa.RecordBatch:
            keys, counts = np.unique(np.concatenate(held) >> shift, return_counts=True)
            cuts = np.searchsorted(keys, (np.arange(ranges + 1, dtype=np.float64) * (2.0**KEY_BITS / ranges)).astype(np.uint64))
            part, packed, times = [], [], []
            for k in np.flatnonzero(cuts[1:] > cuts[:-1]):
                own, many = keys[cuts[k] : cuts[k + 1]], counts[cuts[k] : cuts[k + 1]]
                part.append(int(k))
                packed.append(_pack(own))
                times.append(zlib.compress(np.minimum(many, 65535).astype("<u2").tobytes(), 1))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(packed, pa.binary()), pa.array(times, pa.binary())], names=["part", "keys", "times"])

        total = 0
        for batch in batches:
            for data in batch.column(0).to_pylist():
                got = shingle_set(data)
                held.append(got)
                total += len(got)
                if total >= FLUSH:
                    yield blocks()
                    total = 0
        if total:
            yield blocks()
        vacate()

    return docs.select(_data(docs, text_col)).mapInArrow(run, "part long, keys binary, times binary")


def rarity(docs: DataFrame, text_col: str = "text") -> tuple[bytes, bytes, int]:
    """The bitmap of shingles that occur again, the table of common ones, and from how many times on the bitmap has them.

    That is 2, so that no bit means a unique shingle, as long as fewer shingles
    occur again than the bitmap has bits. Then it is the least value of
    ``AGAIN`` that few enough reach, and prefixes keep their unique shingles.
    The table has the bit length of counts, from the least that a quarter of
    its slots can hold. Both are of fixed size.
    """
    ranges, size = 16, docs.agg(F.coalesce(F.sum(F.octet_length(text_col).cast("long")), F.lit(0))).first()[0]
    while ranges * RANGE_BYTES < size:
        ranges *= 2
    map_bits, slot_bits, width = MAP_BITS, SLOT_BITS, max(8, (1 << MAP_BITS) // ranges)

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = np.concatenate([_unpack(x) for x in pdf["keys"]])
        times = np.concatenate([np.frombuffer(zlib.decompress(x), "<u2") for x in pdf["times"]]).astype(np.int64)
        order = np.argsort(keys, kind="stable")
        keys, times = keys[order], times[order]
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        counts, keys = np.add.reduceat(times, first), keys[first]
        keys, counts = keys[counts > 1], counts[counts > 1]
        out = {"part": int(pdf["part"].iloc[0])}
        place = (keys >> np.uint64(KEY_BITS - map_bits)).astype(np.int64) - out["part"] * width
        for k in AGAIN:
            bits = np.zeros(width, np.uint8)
            bits[place[counts >= k]] = 1
            out[f"n{k}"], out[f"b{k}"] = int((counts >= k).sum()), np.packbits(bits, bitorder="little").tobytes()
        levels = np.minimum(np.frexp(counts.astype(np.float64))[1], 31).astype(np.uint8)
        slots = (keys >> np.uint64(KEY_BITS - slot_bits)).astype("<u4")
        reach = np.bincount(levels, minlength=32)[::-1].cumsum()[::-1]
        least = int(np.flatnonzero(reach <= (1 << slot_bits) // 4 // ranges)[0])  # each range has its share of the table
        out |= {"slots": slots[levels >= max(least, 3)].tobytes(), "levels": levels[levels >= max(least, 3)].tobytes(), "least": max(least, 3)}
        return pd.DataFrame([out])

    schema = "part long, " + "".join(f"n{k} long, b{k} binary, " for k in AGAIN) + "slots binary, levels binary, least long"
    # so many tasks that what each reads doesn't grow with the table
    blocks = _count_ranges(docs, text_col, ranges).repartition(min(ranges // RANGES_A_TASK, MOST_TASKS), "part")
    parts = kept(blocks.groupBy("part").applyInPandas(merge, schema), "rarity")
    total = parts.agg(*(F.coalesce(F.sum(f"n{k}"), F.lit(0)).alias(f"n{k}") for k in AGAIN), F.max("least").alias("least")).first()
    again = next((k for k in AGAIN if total[f"n{k}"] <= 1 << MAP_BITS), AGAIN[-1])
    bitmap, table = np.zeros((1 << MAP_BITS) // 8, np.uint8), np.zeros(1 << SLOT_BITS, np.uint8)
    for row in parts.select("part", F.col(f"b{again}").alias("bits"), "slots", "levels").toLocalIterator():
        at = row["part"] * width // 8
        bitmap[at : at + width // 8] = np.frombuffer(row["bits"], np.uint8)
        slots, levels = np.frombuffer(row["slots"], "<u4"), np.frombuffer(row["levels"], np.uint8)
        np.maximum.at(table, slots[levels >= total["least"]], levels[levels >= total["least"]])
    release(docs.sparkSession, parts)
    return bitmap.tobytes(), table.tobytes(), again


PREFIXES = "txt long, n long, odd long, sid long, grp long, tokens array<long>, rests array<int>, shingles array<long>"


def prefixes(docs: DataFrame, known: tuple[bytes, bytes, int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``txt`` (the text's hash), ``n``, ``odd`` (shingles that no other document has), and for sets that may link ``sid``, ``grp``, ``tokens`` (the prefix), ``rests`` (for each how many shingles stand from it on), ``shingles``; else nulls."""
    sent, least = docs.sparkSession.sparkContext.broadcast(known[:2]), known[2]
    del known
    to_map, to_slot = np.uint64(64 - MAP_BITS), np.uint64(64 - SLOT_BITS)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, table = (np.frombuffer(x, np.uint8) for x in sent.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                n, odd, sid, grp, tokens, rests, every = [], [], [], [], [], [], []
                for data in part.column(2).to_pylist():
                    own = shingle_set(data)
                    size = prefix_size(len(own))
                    bit = (own >> to_map).astype(np.int64)
                    level = bitmap[bit >> 3] >> (bit & 7).astype(np.uint8) & 1
                    n.append(len(own))
                    odd.append(len(own) - np.count_nonzero(level))
                    # with least 2 a shingle without a bit is in no other document
                    if not len(own) or least == 2 and len(own) - np.count_nonzero(level) >= size:
                        sid.append(None), grp.append(None), tokens.append(None), rests.append(None), every.append(None)
                        continue
                    level += level * table[(own >> to_slot).astype(np.int64)]
                    order = np.argsort((level.astype(np.uint64) << np.uint64(58)) | (own >> np.uint64(6)), kind="stable")[:size]
                    rest = len(own) - np.arange(size, dtype=np.int32)
                    if least == 2:
                        rest, order = rest[level[order] > 0], order[level[order] > 0]
                    first = own[order].view(np.int64)
                    sid.append(xxhash.xxh3_64_intdigest(own.tobytes()) - (1 << 63))
                    grp.append(xxhash.xxh3_64_intdigest(first.tobytes(), seed=len(own)) - (1 << 63))
                    tokens.append(first)
                    rests.append(rest)
                    every.append(own.view(np.int64))
                longs = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n, pa.int64()), pa.array(odd, pa.int64()), pa.array(sid, pa.int64()), pa.array(grp, pa.int64()), pa.array(tokens, longs), pa.array(rests, pa.list_(pa.int32())), pa.array(every, longs)], names=[id_col, "txt", "n", "odd", "sid", "grp", "tokens", "rests", "shingles"])
        vacate()

    given = docs.select(F.col(id_col), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("txt"), _data(docs, text_col))
    return given.mapInArrow(run, f"`{id_col}` {given.schema[0].dataType.simpleString()}, {PREFIXES}")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes that link. Sizes are compared before the sets are fetched."""
    sizes = sets.select("sid", "n")
    near = pairs.join(sizes.select(F.col("sid").alias("a"), F.col("n").alias("n_a")), "a").join(sizes.select(F.col("sid").alias("b"), F.col("n").alias("n_b")), "b")
    near = near.where(SHARE_OF * F.least("n_a", "n_b") >= SHARE * F.greatest("n_a", "n_b"))
    near = near.join(sets.select(F.col("sid").alias("a"), F.col("shingles").alias("s_a")), "a").join(sets.select(F.col("sid").alias("b"), F.col("shingles").alias("s_b")), "b")
    common = F.size(F.array_intersect("s_a", "s_b"))
    return near.withColumn("common", common).where((F.col("common") > 0) & (SHARE_OF * F.col("common") >= SHARE * (F.col("n_a") + F.col("n_b") - F.col("common")))).select("a", "b")


def _enough(m: str, n: str):
    """Whether two sets of the sizes ``m`` and ``n`` may link if the shingle at hand is the first that they share.

    They share no more than what stands from it on in either.
    """
    return (SHARE_OF + SHARE) * F.least("rest_a", "rest_b") >= SHARE * (F.col(m) + F.col(n))


@dataclass
class _Met:
    placed: DataFrame
    within: DataFrame
    open: DataFrame
    meeting: DataFrame


def _meeting(heads: DataFrame, members: DataFrame, of: DataFrame) -> _Met:
    """Where components meet: nodes (``placed``) and groups (``within``) with their component, the shingles
    that several components have (``open``), and the pairs of components at them (``meeting``).

    Components meet before their groups do, so that the groups of one component never meet each other.
    """
    placed = members.join(of.withColumnRenamed("node", "sid"), "sid", "left").select("sid", "grp", F.coalesce("component", "sid").alias("comp"))
    within = placed.select("grp", "comp").distinct()
    at = heads.join(within, "grp")
    several = at.groupBy("token").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("token")
    open_tokens = kept(at.join(several, "token", "left_semi").select("token", "grp", "sid", "odd", "n", "rest", "comp"), "open")
    reach = open_tokens.groupBy("token", "comp").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.max("rest").alias("rest"))
    x, y = (reach.select("token", F.col("comp").alias(f"c_{s}"), F.col("low").alias(f"low_{s}"), F.col("high").alias(f"high_{s}"), F.col("rest").alias(f"rest_{s}")) for s in "ab")
    sized = (F.col("c_a") < F.col("c_b")) & (SHARE_OF * F.col("high_a") >= SHARE * F.col("low_b")) & (SHARE_OF * F.col("high_b") >= SHARE * F.col("low_a")) & _enough("low_a", "low_b")
    return _Met(placed, within, open_tokens, x.join(y, "token").where(sized).select("token", "c_a", "c_b"))


def _pairs(met: _Met, few: bool) -> DataFrame:
    """(a, b): nodes of different components that share a shingle of a prefix and may link.

    With ``few``, of two components at a shingle only ``FIRST_TRIES`` groups on either side, and one node of a group.
    """
    side = met.open
    if few:
        some = Window.partitionBy("token", "comp").orderBy("odd", F.xxhash64("token", "grp"))
        side = side.withColumn("k", F.row_number().over(some)).where(F.col("k") <= FIRST_TRIES)
    left, right = (side.select("token", F.col("grp").alias(f"g_{s}"), F.col("n").alias(f"n_{s}"), F.col("rest").alias(f"rest_{s}"), F.col("comp").alias(f"c_{s}")) for s in "ab")
    compatible = (SHARE_OF * F.least("n_a", "n_b") >= SHARE * F.greatest("n_a", "n_b")) & _enough("n_a", "n_b")
    pairs = met.meeting.join(left, ["token", "c_a"]).join(right, ["token", "c_b"]).where(compatible).select("g_a", "c_a", "g_b", "c_b").distinct()
    if few:
        some = Window.partitionBy("c_a", "c_b").orderBy(F.xxhash64("g_a", "g_b"))
        pairs = pairs.withColumn("k", F.row_number().over(some)).where(F.col("k") <= FIRST_TRIES).drop("k")
        nodes = met.placed.groupBy("grp", "comp").agg(F.min("sid").alias("sid"))
    else:
        # and the nodes of one group, if it is split itself
        split = met.within.groupBy("grp").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("grp")
        inside = met.within.join(split, "grp", "left_semi")
        pairs = pairs.unionByName(inside.select(F.col("grp").alias("g_a"), F.col("comp").alias("c_a")).join(inside.select(F.col("grp").alias("g_b"), F.col("comp").alias("c_b")), F.col("g_a") == F.col("g_b")).where("c_a < c_b").select("g_a", "c_a", "g_b", "c_b")).distinct()
        nodes = met.placed
    first, second = (nodes.select(F.col("sid").alias(s), F.col("grp").alias(f"g_{s}"), F.col("comp").alias(f"c_{s}")) for s in "ab")
    return pairs.join(first, ["g_a", "c_a"]).join(second, ["g_b", "c_b"]).select("a", "b").distinct()


def _clusters(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id_col``, ``txt``, ``n``, and ``first``: (``no_id``, ``id``, ``txt``) of the first row of its component, null for a row that links with nothing."""
    spark = docs.sparkSession
    rows = kept(prefixes(docs, rarity(docs, text_col), id_col, text_col), "prefixes")
    may = rows.where("sid is not null")
    nodes = kept(may.groupBy("sid").agg(F.first("n").alias("n"), F.first("odd").alias("odd"), F.first("grp").alias("grp"), F.first("tokens").alias("tokens"), F.first("rests").alias("rests"), F.first("shingles").alias("shingles")), "nodes")
    members = nodes.select("sid", "grp")
    # the node with the fewest shingles of its own is likest to what a family was copied from, so it goes first
    foremost = F.min(F.struct("odd", "sid"))["sid"]
    groups = nodes.groupBy("grp").agg(foremost.alias("head"))
    heads = nodes.join(groups.select(F.col("head").alias("sid")), "sid", "left_semi").select("sid", "grp", "n", "odd", F.explode(F.arrays_zip("tokens", "rests")).alias("t")).select("sid", "grp", "n", "odd", F.col("t.tokens").alias("token"), F.col("t.rests").alias("rest"))
    shared = heads.groupBy("token").agg(F.min("sid").alias("low"), F.max("sid").alias("high"), foremost.alias("first")).where("low <> high").select("token", "first")
    heads = kept(heads.join(shared, "token"), "heads")

    star = members.join(groups, "grp").where("sid <> head").select(F.col("sid").alias("a"), F.col("head").alias("b"))
    star = star.unionByName(heads.where("sid <> first").select(F.col("sid").alias("a"), F.col("first").alias("b"))).distinct()
    links = [kept(_verified(star, nodes), "links")]
    edges = links[0]
    of = kept(components(edges), "components")

    # first a few groups of two components, which joins most that belong together; then all that still lie apart
    for few in (True, False):
        met = _meeting(heads, members, of)
        rest = kept(_pairs(met, few), "pairs")
        links.append(kept(_verified(rest, nodes), "links"))
        release(spark, rest, met.open)
        if not links[-1].isEmpty():
            edges = edges.unionByName(links[-1])
            before, of = of, kept(components(edges), "components")
            release(spark, before)

    by_set = may.groupBy("sid").agg(F.min(F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), "txt")).alias("least"))
    by_set = by_set.join(of.withColumnRenamed("node", "sid"), "sid", "left").select("sid", "least", F.coalesce("component", "sid").alias("comp"))
    names = by_set.groupBy("comp").agg(F.min("least").alias("first"))
    named = kept(by_set.join(names, "comp").select("sid", "first"), "named")
    release(spark, nodes, heads, of, *links)
    return rows.select(id_col, "txt", "n", "sid").join(named, "sid", "left").select(id_col, "txt", "n", "first")


def clusters(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: ``id_col``, ``n_shingles``, ``component_id`` (the smallest id reachable by links)."""
    return _clusters(docs, id_col, text_col).select(id_col, F.col("n").alias("n_shingles"), F.coalesce("first.id", F.col(id_col)).alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of one row of each component: the first by id, then by the text's hash; rows without an id come last.

    Rows equal in id and text count as one, also if the text has no words; rows
    that share an id but not a text are told apart.
    """
    found = kept(_clusters(docs, id_col, text_col), "clusters")
    me, txt = F.col(id_col), F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    gone = found.where(F.col("first").isNotNull() & ~(me.eqNullSafe(F.col("first.id")) & (F.col("txt") == F.col("first.txt")))).select(me.alias("__id"), F.col("txt").alias("__txt")).distinct()
    again = found.groupBy(me.alias("__id"), F.col("txt").alias("__txt")).agg(F.count("*").alias("n")).where("n > 1").drop("n")
    named = docs.withColumn("__key", txt)
    same = lambda keys: named[id_col].eqNullSafe(keys["__id"]) & (named["__key"] == keys["__txt"])
    if again.isEmpty():
        return named.join(gone, same(gone), "left_anti").select(*docs.columns)
    out = named.join(again, same(again), "left_anti").unionByName(named.join(again, same(again), "left_semi").dropDuplicates([id_col, "__key"]))
    named = out
    return out.join(gone, same(gone), "left_anti").select(*docs.columns)
