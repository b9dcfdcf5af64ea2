"""Secret scans with multipart credential linking.

Plain secrets (assignments, access identifiers, long hexadecimal runs) are
reported wherever they stand. Besides, weak parts are collected that mean
nothing alone: key identifiers, logins (mail addresses), opaque words that look
drawn at random, endpoints with a host, and bare network addresses. They are
joined within a scope, a stretch of neighbouring lines. An identifier and a
secret that its name tells are a credential, with or without an endpoint,
wherever they stand in the scope; endpoints of the scope belong to it. Any other
two that complement each other have to be in the same chain of parts, each
within ``REACH`` characters of the next: a login, an endpoint or an address with
a secret that has a name; a bare opaque word with an access identifier, or with
an identifier and an endpoint. The join takes no pairs: a part asks each scope
and chain for the first end and the last start of the other role.

A scope never leaves its text, so the join runs where the text is read, with no
shuffle. Offsets are code points; ends are exclusive. A null text counts as an
empty one; very long texts are read whole; parts that begin at the same place
are all reported; repeated rows each give their row; an empty table gives no
rows; extra columns stay out.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelark.llm.common import Stretches, vacate
from scorelark.llm.privacy import addresses, emails

#: Characters from part to part of a chain with a bare opaque word, and blank lines in a row that end a scope.
REACH, SCOPE_BREAK = 400, re.compile(r"\n[ \t\r]*\n[ \t\r\n]*\n")
KINDS = ("assign", "access", "hex")
LINKED = ("key_id", "opaque", "endpoint", "login", "address")

ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # a run of fewer fails, and nothing in it can succeed
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: Roles of the plain kinds in a credential.
ROLE = {"access": "id", "assign": "secret", "hex": "secret", "key_id": "id", "opaque": "secret", "endpoint": "endpoint", "login": "login", "address": "address"}
KEY_ID = re.compile(r"""(?ai)(?<![a-z0-9])(?<!secret[_-])(?:client|account|tenant|user|access|key|access[_-]?key)[_-]?(id|name|key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]{4,}+)""")
ENDPOINT = re.compile(r"""(?ai)(?<![a-z0-9+.-])[a-z][a-z0-9+.-]++://[a-z0-9.-]{3,}+(?::[0-9]{1,5})?""")
HOST = re.compile(r"""(?ai)(?<![a-z0-9])(host(?:[_-]?name)?|server|endpoint|domain|ur[il])["']?\x20*[:=]\x20*["']?([a-z0-9-]++(?:\.[a-z0-9-]++)*+(?::[0-9]{1,5}+)?+)(?!:?//)""")
OPAQUE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}+(?![A-Za-z0-9+/_=-])")
#: What stands before a secret with a name, and in how many characters it is sought.
NAMED, NAME_CHARS = re.compile(r"""(?ai)(?:secret|token|pass|pwd|cred|auth|sig|key)[a-z0-9_-]*+["']?\x20*[:=]\x20*["']?\Z"""), 200
#: A name of a secret anywhere: without one, and without an identifier, nothing can be linked.
NAME = re.compile(r"""(?ai)(?:secret|token|pass|pwd|cred|auth|sig|key)[a-z0-9_-]*+["']?\x20*[:=]""")
#: Bits a character that an opaque word has at least.
OPAQUE_BITS = 3.5


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end), leftmost and not overlapping within a kind; kind by kind."""
    out = []
    low = text.lower()
    if any(word in low for word in KEYWORDS):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return out


def bits_a_character(word: str) -> float:
    n = len(word)
    return -sum(c / n * math.log2(c / n) for c in map(word.count, set(word)))


def endpoints(text: str) -> list[tuple[str, int, int]]:
    out = [("endpoint", *m.span()) for m in ENDPOINT.finditer(text)] if "://" in text else []
    taken = Stretches((a, b) for _, a, b in out)
    hosts = (m for m in HOST.finditer(text) if m.group(1).lower().startswith("host") or "." in m.group(2) or ":" in m.group(2) or m.group(2).lower() == "localhost")
    return out + [("endpoint", *m.span(2)) for m in hosts if not taken.meets(*m.span(2))]


def weak_parts(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """The parts that mean nothing alone. A text without an identifier and without a secret's name can't complete a credential and gives none."""
    hidden = Stretches((a, b) for _, a, b in base)
    assigns = "=" in text or ":" in text
    keys = [m for m in KEY_ID.finditer(text) if not hidden.meets(*m.span(2))] if assigns else []
    named = any(kind == "assign" for kind, _, _ in base) or assigns and NAME.search(text) is not None
    if not named and not keys and not any(ROLE[kind] == "id" for kind, _, _ in base):
        return []
    ends = endpoints(text)
    hosts = Stretches((a, b) for _, a, b in ends)
    keys = [m for m in keys if not hosts.meets(*m.span(2))]
    apart = Stretches([(a, b) for _, a, b in base + ends] + [m.span(2) for m in keys])
    lone = [(kind, a, b) for kind, spans in (("login", emails(text)), ("address", addresses(text))) for a, b in spans if not apart.meets(a, b)] if named else []
    # a value named *_key may be either; one named *_id or *_name is no secret
    taken = Stretches([(a, b) for _, a, b in base + ends + lone] + [m.span(2) for m in keys if m.group(1).lower() != "key"])
    opaque = [m for m in OPAQUE.finditer(text) if not taken.meets(*m.span()) and re.search("[0-9]", m.group()) and re.search("[A-Za-z]", m.group()) and bits_a_character(m.group()) >= OPAQUE_BITS]
    return ends + lone + [("key_id", *m.span(2)) for m in keys] + [("opaque", *m.span()) for m in opaque]


class Roles:
    """The parts of one scope or chain: by role, the first end and the last start, so that another part than one's own is found at once."""

    def __init__(self):
        self.of: dict[str, tuple[int, int]] = {}

    def add(self, role: str, a: int, b: int) -> None:
        end, start = self.of.get(role, (b, a))
        self.of[role] = min(end, b), max(start, a)

    def beside(self, role: str, a: int, b: int) -> bool:
        """Whether a part of the role stands clear of this one."""
        return role in self.of and (self.of[role][0] <= a or self.of[role][1] >= b)

    def both(self, one: str, other: str) -> bool:
        return one in self.of and other in self.of and (self.of[one][0] <= self.of[other][1] or self.of[other][0] <= self.of[one][1])


def linked(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """The weak parts that credentials hold."""
    weak = weak_parts(text, base)
    if not weak:
        return []
    cuts = [m.start() for m in SCOPE_BREAK.finditer(text)]
    scopes, placed = {}, []
    chain, last, upto = Roles(), -1, 0
    for kind, a, b in sorted(base + weak, key=lambda x: x[1]):
        scope, role = bisect_right(cuts, a), ROLE[kind]
        if scope != last or a - upto >= REACH:
            chain, upto = Roles(), 0
        last, upto = scope, max(upto, b)
        named = kind == "assign" or role == "secret" and NAMED.search(text, max(0, a - NAME_CHARS), a) is not None
        whole = scopes.setdefault(scope, Roles())
        for roles in (whole, chain):
            roles.add(role, a, b)
            if named:
                roles.add("named", a, b)
            if kind == "access":
                roles.add("access", a, b)
        placed.append((kind, a, b, named, whole, chain))

    def complete(kind: str, a: int, b: int, named: bool, whole: Roles, chain: Roles) -> bool:
        near = "endpoint" in chain.of
        if kind == "key_id":
            return whole.beside("named", a, b) or near and chain.beside("secret", a, b)
        if kind == "opaque":
            return named and (whole.beside("id", a, b) or any(chain.beside(role, a, b) for role in ("login", "endpoint", "address"))) or "access" in chain.of or near and chain.beside("id", a, b)
        if chain.beside("named", a, b):
            return True
        return kind == "endpoint" and (whole.both("id", "named") or chain.both("id", "secret"))

    given = set(weak)
    return [x[:3] for x in placed if x[:3] in given and complete(*x)]


def joined(spans: list[tuple[str, int, int]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b in sorted(spans, key=lambda x: (x[1], kinds.index(x[0]))))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: ``id_col``, ``n_assign``, ``n_access``, ``n_hex``, ``base_sha256``, ``spans``, ``found`` (structs of kind, start, end, value)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vacate()
        found_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())]))
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                counts, shas, spans, found = [[], [], []], [], [], []
                for text in part.column(1).to_pylist():
                    base = base_spans(text)
                    every = base + linked(text, base)
                    for kind, n in zip(KINDS, counts, strict=True):
                        n.append(sum(x[0] == kind for x in base))
                    shas.append(hashlib.sha256(joined(base, KINDS).encode()).hexdigest())
                    spans.append(joined(every, KINDS + LINKED))
                    found.append([{"kind": k, "start": a, "end": b, "value": text[a:b]} for k, a, b in sorted(every, key=lambda x: x[1])])
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(n, pa.int64()) for n in counts), pa.array(shas, pa.string()), pa.array(spans, pa.string()), pa.array(found, found_type)], names=[id_col, "n_assign", "n_access", "n_hex", "base_sha256", "spans", "found"])

    given = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return given.mapInArrow(run, f"`{id_col}` {given.schema[0].dataType.simpleString()}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, found array<struct<kind:string,start:long,end:long,value:string>>")
