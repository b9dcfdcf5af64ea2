"""Byte-level BPE by longest matches and backtracking.

Tokens are looked up in an Aho-Corasick automaton over Latin-1 strings (one
character a byte). An encoding is correct exactly if every two neighbouring
tokens are compatible, that is, if merging their joined bytes yields the two
tokens again. So the encoder takes the longest match, falls back to shorter
prefixes while a neighbour is incompatible, and gives up a position for good
once no token fits there. Compatibility is memoised. Each position is given up
once at most, so the time is linear in the piece.

Nulls count as empty texts; an empty text has no tokens. Very long texts are cut
into pieces by and by and encoded whole. Repeated rows each give their row; an
empty table gives no rows. Extra columns of the input are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterable, Iterator
from itertools import islice
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelark.llm.common import resident

#: Pieces that a worker remembers, each of so many characters at most, and pairs of tokens whose compatibility it remembers.
CACHE_PIECES, CACHE_CHARS, FITS = 1 << 18, 48, 1 << 19
#: Longer texts are cut into pieces by and by, not all at once.
STREAM_CHARS, STREAM_PIECES = 1 << 20, 1 << 16
#: The rank file is sent to every executor, so its size is checked.
MAX_RANK_BYTES = 64 << 20


def read_ranks(data: bytes) -> dict[bytes, int]:
    """The lines of a rank file: a token in base64, a space, its rank."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(None, data.split(b"\n")))}


def split_pattern(pattern: str) -> regex.Pattern:
    r"""The pattern with \s and \S as the Unicode property, which is what the public library's engine takes them for."""
    return regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))


class BytePairCodec:
    """Encodes and decodes by the ranks alone; it needs no merge list."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import ahocorasick

        self.ranks = ranks
        self.find = split_pattern(pattern)
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.splits: dict[int, tuple[int, int] | None] = {}
        self.pairs: dict[tuple[int, int], int] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        self.shorter: dict[int, int | None] = {}
        self.length: dict[int, int] = {}
        self.automaton = ahocorasick.Automaton()
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if not self._learn(token, rank):
                continue  # merging never makes it; it stands only for a whole piece
            self.length[rank] = len(token)
            self.automaton.add_word(token.decode("latin-1"), rank)
        self.automaton.make_automaton()
        for rank in self.length:
            self.shorter[rank] = self._next_shorter(self.bytes_of[rank])
        self.cache = _PieceCache(self)

    def _next_shorter(self, token: bytes) -> int | None:
        for end in range(len(token) - 1, 0, -1):
            rank = self.ranks.get(token[:end])
            if rank in self.length:
                return rank
        return None

    def _learn(self, token: bytes, rank: int) -> bool:
        """Find the two tokens whose merge makes this one; both come before it."""
        if len(token) == 1:
            self.splits[rank] = None
            return True
        for cut in range(len(token) - 1, 0, -1):
            left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
            if left is not None and right is not None and left < rank and right < rank and left in self.splits and right in self.splits and self._compatible(left, right):
                self.splits[rank] = (left, right)
                self.pairs[left, right] = rank
                return True
        return False

    def _compatible(self, left: int, right: int) -> bool:
        """Whether the bytes of both, merged from scratch, end up as these two tokens.

        Walk down the seam between them, undoing the later merge first: a pair
        that would have merged before the merge just undone spoils it.
        """
        limit = 1 << 62
        while True:
            joined = self.pairs.get((left, right))
            if joined is not None and joined < limit:
                return False
            a, b = self.splits[left], self.splits[right]
            if a is None and b is None:
                return True
            # of equal ranks the right one was merged later
            if a is not None and (left > right or b is None):
                limit, left = left, a[1]
                if b is None and left < right:
                    continue
            else:
                limit, right = right + 1, b[0]

    def _fit(self, left: int, right: int) -> bool:
        known = self.fits.get((left, right))
        if known is None:
            if len(self.fits) >= FITS:
                self.fits.clear()
            known = self.fits[left, right] = self._compatible(left, right)
        return known

    def encode_piece(self, piece: bytes) -> array:
        """The ids of one match of the pattern."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return array("I", (whole,))
        n, length = len(piece), self.length
        longest = [0] * n
        for end, rank in self.automaton.iter(piece.decode("latin-1")):
            longest[end + 1 - length[rank]] = rank  # ends ascend, so the longest stays
        open_at, shorter, known, fit = bytearray(b"\1") * (n + 1), self.shorter, self.fits.get, self._fit
        out: list[int] = []
        at, token, last = 0, longest[0], -1
        while True:
            end = at + length[token]
            if open_at[end] and (last < 0 or (ok := known((last, token))) or ok is None and fit(last, token)):
                out.append(token)
                if end == n:
                    return array("I", out)
                at, last, token = end, token, longest[end]
                continue
            token = shorter[token]
            while token is None:  # nothing fits here, so no token may end here again
                open_at[at] = 0
                token = shorter[last]
                at -= length[last]
                out.pop()
                last = out[-1] if out else -1

    def encode(self, text: str) -> bytes:
        """All ids of a text as little-endian unsigned 32-bit integers."""
        look = self.cache.__getitem__
        if len(text) <= STREAM_CHARS:
            return b"".join(map(look, self.find.findall(text)))
        found, parts = (m.group() for m in self.find.finditer(text)), []
        while block := list(islice(found, STREAM_PIECES)):
            parts.append(b"".join(map(look, block)))
        return b"".join(parts)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class _PieceCache(dict):
    def __init__(self, codec: BytePairCodec):
        self.codec = codec

    def __missing__(self, piece: str) -> bytes:
        ids = self.codec.encode_piece(piece.encode()).tobytes()
        if len(piece) <= CACHE_CHARS:
            if len(self) >= CACHE_PIECES:
                self.clear()
            self[piece] = ids
        return ids


def codec_for(data: bytes, pattern: str) -> BytePairCodec:
    """One codec a worker process, whatever the number of its tasks."""
    return resident((hashlib.sha256(data).hexdigest(), pattern), lambda: BytePairCodec(read_ranks(data), pattern))


def _shipped(df: DataFrame, rank_path: str):
    data = Path(rank_path).read_bytes()
    if len(data) > MAX_RANK_BYTES:
        raise ValueError(f"{rank_path} has {len(data)} bytes; ranks of up to {MAX_RANK_BYTES} are broadcast")
    return df.sparkSession.sparkContext.broadcast(data)


def encode(docs: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Encode whole texts, decode the ids again, and give both digests.

    Returns ``id_col``, ``n_tokens`` long, ``ids_sha256`` and ``decoded_sha256``
    (lower-case hex of the little-endian ids and of the decoded bytes),
    ``round_trip`` boolean, and ``ids`` array of int unless ``with_ids`` is off.
    """
    shipped = _shipped(docs, rank_path)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, sha = codec_for(shipped.value, pattern), hashlib.sha256
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                n, ids_sha, back_sha, same, ids = [], [], [], [], []
                for text in part.column(1).to_pylist():
                    packed = codec.encode(text)
                    back = codec.decode(packed)
                    n.append(len(packed) >> 2)
                    ids_sha.append(sha(packed).hexdigest())
                    back_sha.append(sha(back).hexdigest())
                    same.append(back == text.encode())
                    if with_ids:
                        ids.append(np.frombuffer(packed, "<u4").astype("i4"))
                columns = {id_col: part.column(0), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids_sha, pa.string()), "decoded_sha256": pa.array(back_sha, pa.string()), "round_trip": pa.array(same, pa.bool_())}
                if with_ids:
                    columns["ids"] = pa.array(ids, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    given = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = f"`{id_col}` {given.schema[0].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean" + ", ids array<int>" * with_ids
    return given.mapInArrow(run, schema)


def decode(encoded: DataFrame, rank_path: str, id_col: str = "doc_id") -> DataFrame:
    """The texts of ``ids``: ``id_col`` and ``text``. Bytes that aren't UTF-8 become U+FFFD; null ids give a null text."""
    shipped = _shipped(encoded, rank_path)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = {rank: token for token, rank in read_ranks(shipped.value).items()}
        for batch in batches:
            texts = [None if ids is None else b"".join(map(tokens.__getitem__, ids)).decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    given = encoded.select(id_col, "ids")
    return given.mapInArrow(run, f"`{id_col}` {given.schema[0].dataType.simpleString()}, text string")


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN
