"""Information-theoretic sanitisation of personal data.

Direct identifiers (e-mail and network addresses, card and phone numbers) are
found by form. Then the corpus tells which other terms give them away: for a
protected value e and a term t anywhere in the same text, the pointwise mutual
information log2(c(e,t) N / (c(e) c(t))), with document counts c over all N
documents, is compared with the information content log2(N / c(e)) of the
value. A share of ``REMOVE`` or more means that the term all but names the
value, and it goes; a share of ``GENERALISE`` or more, that it narrows it down,
and its kind is put in its place (``general``): at every place, in every document.
Estimates rest on at least ``SUPPORT`` different texts, so copies of one text
are no evidence.

The corpus is read for the identifiers, for the words of the texts whose values
have the support, for the counts of these words, and to mark or rewrite. Only
words rare enough to reach the share, by their exact counts, are paired with
values. What the executors get is bitmaps of fixed size that say which texts
and words may count, and shares of the disclosing terms; exact counts are
joined. Offsets are code points, ends are exclusive. A null text counts as an
empty one (and stays null when rewritten); very long texts are read whole;
repeated rows each give their row; an empty table gives no rows; extra columns
stay as they are.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelark.llm.common import Stretches, kept, release, vacate

KINDS = ("email", "ip", "card", "phone")
TERMS = ("term", "hint")
SUPPORT, GENERALISE, REMOVE = 3, 0.8, 0.95
#: Bits of the bitmaps of texts and of candidate terms.
BITMAP_BITS = 1 << 22
#: Terms that a task counts before it hands them on.
TERMS_HELD = 1 << 17
#: Disclosing terms that are sent at once.
TERMS_SENT = 1 << 18

EMAIL = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a match can only begin where a run of digits begins, so the look-behind changes nothing but the time
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]")
WORD = re.compile(r"[0-9A-Za-z\x80-\U0010ffff]+")
LOWER = {c: c + 32 for c in range(65, 91)}
#: Of the UTF-8 bytes: lower case for A-Z, a blank for all other ASCII but letters and digits.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 32 for c in range(256))


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[::-2]) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    out, last = [], 0
    for m in EMAIL.finditer(text) if "@" in text else ():
        start = at = m.start()
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        if start < at:
            out.append((start, m.end()))
            last = m.end()
        else:
            last = max(last, at)
    return out


def addresses(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m.group().split("."))]


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end), leftmost and not overlapping within a kind; failing matches go, without another try."""
    out = [("email", *span) for span in emails(text)]
    if DIGIT.search(text):
        out += [("ip", *span) for span in addresses(text)]
        for m in CARD.finditer(text):
            digits = NOT_DIGIT.sub("", m.group()) if m.end() - m.start() >= 14 else ""
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in PHONE.finditer(text) if 10 <= len(NOT_DIGIT.sub("", m.group())) <= 15]
    return out


def value_key(kind: str, value: str) -> int:
    """The protected value, however it is written, as a signed 64-bit number."""
    plain = value.lower() if kind in ("email", "ip") else NOT_DIGIT.sub("", value)
    return int.from_bytes(hashlib.blake2b(f"{kind}:{plain}".encode(), digest_size=8).digest(), "big", signed=True)


def words_outside(text: str, spans: Iterable[tuple[str, int, int]]) -> Iterator[tuple[str, int, int]]:
    """All words that no identifier touches: (term, start, end)."""
    hidden = Stretches((a, b) for _, a, b in spans)
    for m in WORD.finditer(text):
        if not hidden.meets(*m.span()):
            yield m.group().translate(LOWER), m.start(), m.end()


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b in sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]))))


MARK = "struct<start:long,end:long,kind:string>"
MARKS_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))


def _parts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    vacate()
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            yield batch.slice(at, 512)


def _texts(docs: DataFrame, text_col: str) -> DataFrame:
    """``key``, the hash of a text, and ``text``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.xxhash64(text).alias("key"), text.alias("text"))


def _slot(term: str):
    return F.pmod(F.crc32(F.encode(term, "utf-8")), F.lit(BITMAP_BITS))


def _bitmap(keys: DataFrame, slot) -> bytes | None:
    """One bit a key, gathered as whole 64-bit words: their number is fixed. None if there are no keys."""
    words = keys.select(slot.alias("s")).groupBy(F.shiftright("s", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, CAST(s % 64 AS INT)))").alias("b"))
    got = words.toPandas()
    if not len(got):
        return None
    bitmap = np.zeros(BITMAP_BITS // 64, np.uint64)
    bitmap[got["w"].to_numpy(np.int64)] = got["b"].to_numpy(np.int64).view(np.uint64)
    return bitmap.view(np.uint8).tobytes()


def _holders(docs: DataFrame, text_col: str) -> DataFrame:
    """(value, key, copies, n_value): the different texts of the values that have the support."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            keys, values = [], []
            for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                own = {value_key(kind, text[a:b]) for kind, a, b in base_spans(text)}
                keys += [key] * len(own)
                values += own
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(values, pa.int64())], names=["key", "value"])

    every = kept(_texts(docs, text_col).mapInArrow(run, "key long, value long").groupBy("value", "key").agg(F.count("*").alias("copies")), "values")
    live = every.groupBy("value").agg(F.sum("copies").alias("n_value"), F.count("*").alias("texts")).where(F.col("texts") >= SUPPORT).drop("texts")
    out = kept(every.join(live, "value"), "holders")
    release(docs.sparkSession, every)
    return out


def _terms_of(docs: DataFrame, text_col: str, bits: bytes) -> DataFrame:
    """(key, terms): the different words outside identifiers of each text that ``bits`` may have."""
    sent = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, mask = sent.value, BITMAP_BITS - 1
        for part in _parts(batches):
            part = part.filter(pa.array([bool(bits[(s := key & mask) >> 3] >> (s & 7) & 1) for key in part.column(0).to_pylist()], pa.bool_()))
            terms = [sorted({w for w, _, _ in words_outside(text, base_spans(text))}) for text in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(terms, pa.list_(pa.string()))], names=["key", "terms"])

    return _texts(docs, text_col).mapInArrow(run, "key long, terms array<string>").groupBy("key").agg(F.first("terms").alias("terms"))


def _counts(docs: DataFrame, text_col: str, bits: bytes) -> DataFrame:
    """(term, n_term): documents that hold a term, of the terms that ``bits`` may have."""
    sent = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, crc, mask = sent.value, zlib.crc32, BITMAP_BITS - 1
        counts: Counter[bytes] = Counter()

        def handed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()).cast(pa.string()), pa.array(counts.values(), pa.int64())], names=["term", "n"])
            counts.clear()
            return out

        for batch in batches:
            for data in batch.column(0).to_pylist():
                counts.update(word for word in set(data.translate(FOLD).split()) if bits[(s := crc(word) & mask) >> 3] >> (s & 7) & 1)
                if len(counts) > TERMS_HELD:
                    yield handed()
        yield handed()

    texts = docs.select(F.encode(F.coalesce(F.col(text_col), F.lit("")), "utf-8").alias("data"))
    return texts.mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n_term"))


def disclosing(docs: DataFrame, text_col: str = "text", held: list[DataFrame] | None = None) -> DataFrame | None:
    """(term, kind) of terms that disclose some protected value; None if no value has the support. ``held`` gets the tables that it reads."""
    held = [] if held is None else held
    live = _holders(docs, text_col)
    held.append(live)
    bits = _bitmap(live, F.pmod("key", F.lit(BITMAP_BITS)))
    if bits is None:
        return None
    texts = kept(_terms_of(docs, text_col, bits), "terms")
    held.append(texts)
    bits = _bitmap(texts.select(F.explode("terms").alias("term")).distinct(), _slot("term"))
    if bits is None:
        return None
    total = float(docs.count())

    # n_both is at most n_value, so a term in more documents than this has no share of GENERALISE
    def most(n):
        return total ** (1 - GENERALISE) * F.pow(n, F.lit(GENERALISE)) + 1e-6

    widest = live.agg(F.max("n_value")).first()[0]
    rare = kept(_counts(docs, text_col, bits).where(F.col("n_term").between(F.lit(SUPPORT), most(F.lit(float(widest))))), "counts")
    held.append(rare)
    bits = _bitmap(rare, _slot("term"))
    if bits is None:
        return None
    sent = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, crc, mask = sent.value, zlib.crc32, BITMAP_BITS - 1
        for part in _parts(batches):
            keys, terms = [], []
            for key, words in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                words = [w for w in words if bits[(s := crc(w.encode()) & mask) >> 3] >> (s & 7) & 1]
                keys += [key] * len(words)
                terms += words
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(terms, pa.string())], names=["key", "term"])

    each = texts.mapInArrow(run, "key long, term string").join(rare, "term")
    pairs = each.join(live, "key").where(F.col("n_term") <= most(F.col("n_value"))).groupBy("value", "term", "n_value", "n_term").agg(F.sum("copies").alias("n_both"), F.count("*").alias("texts")).where(F.col("texts") >= SUPPORT)
    told = F.log2(F.col("n_both") * total / (F.col("n_value") * F.col("n_term")))
    content = F.log2(total / F.col("n_value"))
    share = pairs.withColumn("share", F.when(content > 0, told / content)).groupBy("term").agg(F.max("share").alias("share"))
    return share.where(F.col("share") >= GENERALISE).select("term", F.when(F.col("share") >= REMOVE, TERMS[0]).otherwise(TERMS[1]).alias("kind"))


def _through(docs: DataFrame, text_col: str, schema: str, finish: Callable[[pa.RecordBatch, list[list[tuple[str, int, int]]]], pa.RecordBatch]) -> DataFrame:
    """``finish`` of every batch and, of each of its texts, the spans of all personal data: identifiers, and every place of a term that discloses a protected value.

    Terms are sent in shares of ``TERMS_SENT``; the last share is looked for where ``finish`` runs, so as a rule texts go through Python once.
    """
    spark, names, at = docs.sparkSession, docs.columns, docs.columns.index(text_col)
    shares: list[dict[bytes, str]] = [{}]
    held: list[DataFrame] = []
    terms = disclosing(docs, text_col, held)
    if terms is not None:
        found = kept(terms, "disclosing")
        held.append(found)
        for row in found.toLocalIterator():
            if len(shares[-1]) >= TERMS_SENT:
                shares.append({})
            shares[-1][row.term.encode()] = row.kind
    release(spark, *held)

    def marks(text: str | None, base: list[tuple[str, int, int]], kinds: dict[bytes, str], of: dict[str, str]) -> list[tuple[str, int, int]]:
        if not text or not kinds or kinds.keys().isdisjoint(text.encode().translate(FOLD).split()):
            return []
        return [(of[w], a, b) for w, a, b in words_outside(text, base) if w in of]

    def earlier(given: DataFrame, share: dict[bytes, str]) -> DataFrame:
        sent, columns = spark.sparkContext.broadcast(share), given.columns

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            of = {k.decode(): kind for k, kind in sent.value.items()}
            for part in _parts(batches):
                more = [m + [{"start": a, "end": b, "kind": k} for k, a, b in marks(t, base_spans(t or ""), sent.value, of)] for t, m in zip(part.column(at).to_pylist(), part.column(len(names)).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], pa.array(more, MARKS_TYPE)], names=columns)

        return given.mapInArrow(run, given.schema)

    out = docs
    if len(shares) > 1:
        out = docs.withColumn("__marks", F.array().cast(f"array<{MARK}>"))
        for share in shares[:-1]:
            out = earlier(out, share)
    last, several = spark.sparkContext.broadcast(shares[-1]), len(shares) > 1

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = last.value
        of = {k.decode(): kind for k, kind in kinds.items()}
        for part in _parts(batches):
            texts = part.column(at).to_pylist()
            more = part.column(len(names)).to_pylist() if several else [()] * len(texts)
            spans = []
            for text, known in zip(texts, more, strict=True):
                base = base_spans(text or "")
                spans.append(base + [(m["kind"], m["start"], m["end"]) for m in known] + marks(text, base, kinds, of))
            yield finish(pa.RecordBatch.from_arrays(part.columns[: len(names)], names=names), spans)

    return out.mapInArrow(run, schema)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: ``id_col``, ``n_email``, ``n_ip``, ``n_card``, ``n_phone``, ``base_sha256``, ``spans``."""
    order = KINDS + TERMS

    def told(part: pa.RecordBatch, spans: list[list[tuple[str, int, int]]]) -> pa.RecordBatch:
        counts, shas, every = [[] for _ in KINDS], [], []
        for own in spans:
            base = [s for s in own if s[0] in KINDS]
            for kind, n in zip(KINDS, counts, strict=True):
                n.append(sum(x[0] == kind for x in base))
            shas.append(hashlib.sha256(joined(base).encode()).hexdigest())
            every.append(",".join(f"{order[k]}:{a}:{b}" for a, k, b in sorted((a, order.index(kind), b) for kind, a, b in own)))
        return pa.RecordBatch.from_arrays([part.column(0), *(pa.array(n, pa.int64()) for n in counts), pa.array(shas, pa.string()), pa.array(every, pa.string())], names=[id_col, *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    given = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return _through(given, "text", f"`{id_col}` {given.schema[0].dataType.simpleString()}, {counts}, base_sha256 string, spans string", told)


PUT = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "term": "[REMOVED]", "hint": "[WORD]"}


def general(word: str) -> str:
    """What is left of a term that narrows a value down: whether it is a number, a name by its capital, or another word."""
    return "[NUMBER]" if word.isdigit() else "[NAME]" if word[:1].isupper() else PUT["hint"]


def rewrite(text: str, spans: Iterable[tuple[int, int, str]]) -> str:
    """Each span becomes its placeholder; of overlapping spans the first, then the longest, then what the others hold beyond."""
    out, at = [], 0
    for start, end, kind in sorted(spans, key=lambda s: (s[0], -s[1])):
        if end > at:
            out += [text[at : max(at, start)], general(text[start:end]) if kind == "hint" else PUT[kind]]
            at = end
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs``, with the identifiers and the disclosing terms out of the text."""
    at = docs.columns.index(text_col)

    def cleaned(part: pa.RecordBatch, spans: list[list[tuple[str, int, int]]]) -> pa.RecordBatch:
        texts = [rewrite(text, [(a, b, kind) for kind, a, b in own]) if own else text for text, own in zip(part.column(at).to_pylist(), spans, strict=True)]
        columns = list(part.columns)
        columns[at] = pa.array(texts, columns[at].type)
        return pa.RecordBatch.from_arrays(columns, names=part.schema.names)

    return _through(docs, text_col, docs.schema, cleaned)
