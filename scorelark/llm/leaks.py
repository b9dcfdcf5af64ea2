"""Benchmark decontamination by a BM25 index of the test items and block-max WAND.

The items are indexed once: for each term a postings list of (item, impact) in
blocks, each block with its largest impact. Every passage of every document, a
window of ``PASSAGE`` words, is a query. An item is indexed in entries of at
most ``ENTRY`` words, so that some window holds any of its entries whole; all
entries that score at least a share ``REACH`` of their own text's score are
retrieved. Two bounds save most of the work: the terms of a whole segment of
the text score at least what any window in it scores, and so do the terms'
largest impacts, summed over a window. For windows that pass, the WAND pivot
moves through the lists and skips blocks whose largest impacts can't reach it.

An item is a question and an answer: the answer is its last sentence, or the last
third of its words if it has one sentence. A retrieved pair is verified near the
passages that retrieved it, as far on either side as the item is long: words of
the item count if they stand there next to, or one word from, the same neighbour
as in the item, so an edited word costs one or two words and not five shingles.
The item leaks if ``HALF`` of the question's and of the answer's words count; if
it has one sentence, whose answer is a guess, ``HALF`` of all its words will do.
It leaks as well if the whole text holds ``SAME`` of its five-word shingles, and
some of both parts, wherever they stand.

Items are broadcast up to ``INDEX_POSTINGS`` words and ``INDEX_BYTES``; more are taken in shares, each
of which reads the documents. A worker builds a share's index once. A document's
text is read whole, however long, in its own task. Items or texts that are null
or empty never match; repeated documents and repeated items give a row each, and
items that share an id each give their own; an empty table of documents gives no
rows, one of items no leaks; extra columns stay out.
"""

from __future__ import annotations

import hashlib
import math
import re
from array import array
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelark.llm.common import resident

K1, B = 1.2, 0.75
PASSAGE, STRIDE, ENTRY, SHINGLE = 64, 32, 32, 5
#: Words that one bound is taken for; the next segment begins so far on that no window is cut.
SEGMENT = 512
#: Share of an entry's own score that retrieves it, of an item's shingles that verifies it, and of its words near the passages.
REACH, SAME, HALF = 0.6, 0.8, 0.5
BLOCK = 32
#: Words and bytes of item texts that one index may hold; it has no more postings than words. A longer item has an index of its own.
INDEX_POSTINGS, INDEX_BYTES = 1_000_000, 16 << 20
#: Items whose shingles a worker keeps.
DETAILS = 4096
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 32 for c in range(256))
SENTENCE = re.compile(r"(?<=[.!?])\s+")


def words(text: str | bytes) -> list[bytes]:
    """Runs of letters, digits and non-ASCII bytes, A-Z in lower case."""
    return (text.encode() if isinstance(text, str) else text).translate(FOLD).split()


def shingles(of: list[bytes]) -> set[tuple[bytes, ...]]:
    return {tuple(of[i : i + SHINGLE]) for i in range(len(of) - SHINGLE + 1)} if len(of) >= SHINGLE else ({tuple(of)} if of else set())


def held(part: list[bytes], near: list[list[bytes]]) -> float:
    """The share of the words of ``part`` that stand in a stretch of ``near`` beside, or one word from, the same neighbour."""
    if len(part) < 2:
        return float(all(any(w in words for words in near) for w in part))
    there = {(gap, *pair) for words in near for gap in (1, 2) for pair in zip(words, words[gap:])}
    found = {k + d for gap in (1, 2) for k, pair in enumerate(zip(part, part[gap:])) if (gap, *pair) in there for d in (0, gap)}
    return len(found) / len(part)


def one_sentence(text: str) -> bool:
    sentences = SENTENCE.split(text.strip())
    return len(sentences) < 2 or len(words(sentences[-1])) < SHINGLE


def parts(text: str) -> tuple[list[bytes], list[bytes]]:
    """Question and answer of an item."""
    if not one_sentence(text):
        sentences = SENTENCE.split(text.strip())
        return words(" ".join(sentences[:-1])), words(sentences[-1])
    every = words(text)
    cut = max(1, len(every) * 2 // 3)
    return every[:cut], every[cut:]


class ItemIndex:
    """The inverted index of some items, in flat arrays: 12 bytes a posting, a few more a block and a term."""

    def __init__(self, items: list[tuple[int, str]]):
        self.items = [(i, text) for i, text in items if text and words(text)]
        self.details: dict[int, tuple] = {}
        self.term: dict[bytes, int] = {}
        self.item_of: list[int] = []
        size, spread, terms, times = array("i"), array("i"), array("i"), array("i")
        for item, (_, text) in enumerate(self.items):
            every = words(text)
            n = -(-len(every) // ENTRY)
            for k in range(n):
                own = Counter(every[len(every) * k // n : len(every) * (k + 1) // n])
                terms.extend(self.term.setdefault(w, len(self.term)) for w in own)
                times.extend(own.values())
                spread.append(len(own))
                size.append(sum(own.values()))
                self.item_of.append(item)
        n, t = len(size), len(self.term)
        sizes, term, tf = (np.array(x, np.int64) for x in (size, terms, times))
        entry = np.repeat(np.arange(n, dtype=np.int32), np.array(spread, np.int64))
        holds = np.bincount(term, minlength=t)
        idf = np.log(1 + (n - holds + 0.5) / (holds + 0.5))
        impact = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * sizes[entry] / sizes.mean())) if n else np.zeros(0)
        self.threshold = REACH * np.bincount(entry, impact, n)
        self.least = float(min(self.threshold, default=math.inf))
        order = np.argsort(term, kind="stable")
        self.entries, self.impacts = entry[order], impact[order]
        self.first = np.concatenate(([0], np.cumsum(holds))).astype(np.int64)
        blocks = -(-holds // BLOCK)
        self.block_first = np.concatenate(([0], np.cumsum(blocks))).astype(np.int64)
        starts = np.repeat(self.first[:-1] - BLOCK * self.block_first[:-1], blocks) + BLOCK * np.arange(self.block_first[-1])
        ends = np.minimum(starts + BLOCK, np.repeat(self.first[1:], blocks))
        self.block_last = self.entries[ends - 1] if n else np.zeros(0, np.int32)
        self.block_most = np.maximum.reduceat(self.impacts, starts) if n else np.zeros(0)
        self.top = np.concatenate((np.maximum.reduceat(self.impacts, self.first[:-1]) if n else np.zeros(0), [0.0]))

    @property
    def postings(self) -> list[list[tuple[int, float]]]:
        """By term the (entry, impact) pairs, for looking at."""
        cuts = self.first[1:-1]
        return [list(zip(e.tolist(), x.tolist(), strict=True)) for e, x in zip(np.split(self.entries, cuts), np.split(self.impacts, cuts), strict=True)]

    def detail(self, item: int) -> tuple:
        """Shingles of the whole item, its question and its answer; the words of each; whether it is one sentence. Few items are ever retrieved."""
        if item not in self.details:
            if len(self.details) >= DETAILS:
                self.details.clear()
            text = self.items[item][1]
            every, (question, answer) = words(text), parts(text)
            self.details[item] = (shingles(every), shingles(question), shingles(answer)), (every, question, answer, one_sentence(text))
        return self.details[item]

    def segment_reaches(self, ids: np.ndarray) -> bool:
        """Whether all terms of a segment together bring some entry to its threshold."""
        terms = np.unique(ids)
        terms = terms[terms < len(self.first) - 1]
        sizes = self.first[terms + 1] - self.first[terms]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.first[terms] - ends + sizes, sizes)
        scores = np.bincount(self.entries[at], self.impacts[at], len(self.threshold))
        return bool((scores >= self.threshold - 1e-9).any())

    def windows(self, ids: np.ndarray) -> np.ndarray:
        """Starts of the windows whose terms could reach the least threshold: a sum over all words, repeats included, bounds theirs."""
        n = len(ids)
        starts = np.arange(0, max(1, n - PASSAGE + STRIDE), STRIDE)
        sums = np.concatenate(([0.0], np.cumsum(self.top[ids])))
        reach = sums[np.minimum(starts + PASSAGE, n)] - sums[np.minimum(starts, n)]
        return starts[reach >= self.least]

    def query(self, terms: list[int]) -> list[tuple[int, float]]:
        """All (entry, score) that reach the entry's threshold."""
        # views give plain numbers, one at a time
        entries, impacts, first, top, threshold = map(memoryview, (self.entries, self.impacts, self.first, self.top, self.threshold))
        block_first, block_last, block_most, least = memoryview(self.block_first), memoryview(self.block_last), memoryview(self.block_most), self.least
        found = []
        cursors = [[entries[first[t]], first[t], t] for t in terms]  # entry at hand, its place, term
        while cursors:
            cursors.sort()
            bound, pivot = 0.0, -1
            for k, (_, _, t) in enumerate(cursors):
                bound += top[t]
                if bound >= least:
                    pivot = k
                    break
            if pivot < 0:
                break
            entry = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == entry:
                pivot += 1
            most, upto = 0.0, math.inf
            for _, at, t in cursors[: pivot + 1]:
                j, end = block_first[t] + (at - first[t]) // BLOCK, block_first[t + 1] - 1
                while j < end and block_last[j] < entry:
                    j += 1
                if block_last[j] >= entry:
                    most += block_most[j]
                    upto = min(upto, block_last[j])
            if most < least:  # nothing up to the nearest block's end can reach it
                goal = min(upto + 1, cursors[pivot + 1][0] if pivot + 1 < len(cursors) else math.inf)
                goal = max(goal, entry + 1) if goal != math.inf else math.inf
            elif cursors[0][0] == entry:
                score = sum(impacts[at] for _, at, _ in cursors[: pivot + 1])
                if score >= threshold[entry]:
                    found.append((entry, score))
                goal = entry + 1
            else:
                goal = entry
            moved = []
            for _, at, t in cursors[: pivot + 1]:
                begin, end = first[t], first[t + 1]
                while at < end and entries[at] < goal:
                    j = (at - begin) // BLOCK
                    at = min(begin + (j + 1) * BLOCK, end) if block_last[block_first[t] + j] < goal else at + 1
                if at < end:
                    moved.append([entries[at], at, t])
            cursors = moved + cursors[pivot + 1 :]
        return found

    def near(self, tokens: list[bytes], starts: set[int], size: int) -> list[list[bytes]]:
        """The stretches of the text that lie at most ``size`` words from passages."""
        out: list[list[int]] = []
        for start in sorted(starts):
            low, high = max(0, start - size), start + PASSAGE + size
            if out and low <= out[-1][1]:
                out[-1][1] = high
            else:
                out.append([low, high])
        return [tokens[low:high] for low, high in out]

    def search(self, data: bytes) -> list[dict]:
        """The leaks in one text: item, its best passage, that passage's score, and the shares of its shingles in the text."""
        tokens = words(data)
        get, none = self.term.get, len(self.term)
        ids = np.fromiter((get(w, none) for w in tokens), np.int64, len(tokens)) if tokens else np.empty(0, np.int64)
        best: dict[int, tuple[float, int]] = {}
        places: dict[int, set[int]] = defaultdict(set)
        for low in range(0, len(ids) if self.items else 0, SEGMENT):
            segment = ids[low : low + SEGMENT + PASSAGE - STRIDE]
            if not self.segment_reaches(segment):
                continue
            for start in self.windows(segment).tolist():
                terms = set(segment[start : start + PASSAGE].tolist()) - {none}
                for entry, score in self.query(list(terms)):
                    item = self.item_of[entry]
                    places[item].add(low + start)
                    if score > best.get(item, (0.0, 0))[0]:
                        best[item] = (score, low + start)
        if not best:
            return []
        details = {item: self.detail(item) for item in best}
        wanted = set().union(*(part for item in best for part in details[item][0]))
        there = {g for size in {len(g) for g in wanted} for i in range(len(tokens) - size + 1) if (g := tuple(tokens[i : i + size])) in wanted}
        out = []
        for item, (score, start) in sorted(best.items()):
            whole, question, answer = ((len(s & there) / len(s)) if s else 1.0 for s in details[item][0])
            leaks = whole >= SAME and question > 0 and answer > 0
            if not leaks:
                every, *two, single = details[item][1]
                near = self.near(tokens, places[item], len(every))
                q, a = (held(x, near) if x else 1.0 for x in two)
                leaks = min(q, a) >= HALF or single and held(every, near) >= HALF
            if leaks:
                out.append({"item_id": self.items[item][0], "start_word": start, "score": float(score), "overlap": whole, "question_overlap": question, "answer_overlap": answer})
        return out


FOUND = pa.struct([("item_id", pa.int64()), ("start_word", pa.int64()), ("score", pa.float64()), ("overlap", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64())])


def _shares(benchmark: DataFrame, item_col: str, item_text_col: str) -> Iterator[list[tuple[int, str]]]:
    """The items in shares that an index may hold."""
    share, n, held = [], 0, 0
    for row in benchmark.select(item_col, item_text_col).where(F.length(item_text_col) > 0).toLocalIterator():
        more, size = len(words(row[1])) + 1, len(row[1].encode())
        if share and (n + more > INDEX_POSTINGS or held + size > INDEX_BYTES):
            yield share
            share, n, held = [], 0, 0
        share.append((row[0], row[1]))
        n, held = n + more, held + size
    if share:
        yield share


def _sent(spark: SparkSession, share: list[tuple[int, str]]) -> Callable[[], ItemIndex]:
    """A share sent to the workers, and what gives its index there: one a worker process, whatever the number of its tasks."""
    sent, name = spark.sparkContext.broadcast(share), hashlib.sha256(repr(share).encode()).hexdigest()

    return lambda: resident(name, lambda: ItemIndex(sent.value))


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", columns: tuple[str, ...] = ()) -> DataFrame:
    """One row a document and share of the items: ``id_col``, ``columns``, ``leaks`` (an array, empty if clean)."""
    spark = docs.sparkSession
    given = docs.select(F.col(id_col), F.encode(F.coalesce(F.col(text_col), F.lit("")), "utf-8").alias("__data"), *columns)
    kinds = {f.name: f.dataType.simpleString() for f in given.schema}
    schema = f"`{id_col}` {kinds[id_col]}, " + "".join(f"`{c}` {kinds[c]}, " for c in columns) + "leaks array<struct<item_id:long,start_word:long,score:double,overlap:double,question_overlap:double,answer_overlap:double>>"

    def one(share: list[tuple[int, str]]) -> DataFrame:
        index_of = _sent(spark, share)

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = index_of()
            for batch in batches:
                for at in range(0, batch.num_rows, 512):
                    part = batch.slice(at, 512)
                    leaks = [index.search(data) for data in part.column(1).to_pylist()]
                    yield pa.RecordBatch.from_arrays([part.column(0), *part.columns[2:], pa.array(leaks, pa.list_(FOUND))], names=[id_col, *columns, "leaks"])

        return given.mapInArrow(run, schema)

    out = None
    for share in _shares(benchmark, item_col, item_text_col):
        out = one(share) if out is None else out.unionByName(one(share))
    return one([]) if out is None else out


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row a leak: ``id_col``, ``item_id``, ``start_word`` of the best passage, ``score``, ``overlap``, ``question_overlap``, ``answer_overlap``."""
    return matches(docs, benchmark, id_col).select(id_col, F.explode("leaks").alias("x")).select(id_col, "x.*")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents in which no item leaks, with all their columns; repeated rows stay as often as they are."""
    spark = docs.sparkSession
    out = docs
    for share in _shares(benchmark, "item_id", "text"):
        index_of = _sent(spark, share)
        at, names = docs.columns.index("text"), docs.columns

        def run(batches: Iterable[pa.RecordBatch], index_of=index_of) -> Iterator[pa.RecordBatch]:
            index = index_of()
            for batch in batches:
                for start in range(0, batch.num_rows, 512):
                    part = batch.slice(start, 512)
                    fine = [not (text and index.search(text)) for text in part.column(at).cast(pa.binary()).to_pylist()]
                    yield pa.RecordBatch.from_arrays(part.filter(pa.array(fine, pa.bool_())).columns, names=names)

        out = out.mapInArrow(run, docs.schema)
    return out
