"""WARC archives: writing captures, and putting transactions together again.

A capture is written as three records: the response (or, where an earlier page
has the same payload, a revisit of it), the request, and metadata; the last two
name the first in ``WARC-Concurrent-To``. A task writes the records of a capture
together, and Spark's own writer commits the files: the text format with the
end of a record, two line ends, as its separator, compressed. So archives land
in any store, and a lost task leaves nothing behind.

Reading takes each archive whole, so writing bounds them: captures are dealt
into as many files as ``FILE_BYTES`` of payload ask for. A file is unpacked as a
stream and parsed by the records' lengths; blank lines in a payload mean
nothing. Requests and metadata are then joined to their responses by the
identifiers, and every capture becomes one nested row.

Payloads of ``least`` bytes or more that are equal make a group: the row with
the smallest page id is the response, the others revisit it. Rows that repeat
that id are responses too; rows without an id revisit if any row of their group
has one, else they are responses. A null page counts as an empty one. Groups
are found by digest, with counts added up before the shuffle, and their first
pages are looked up by digest and, for groups of a thousandth of all rows, of
which there can't be more than a thousand, by salt. So a page with a third of
all copies is spread. Extra columns stay out; an empty table gives no captures.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelark.llm.common import fresh_path, kept

#: Payload bytes of an archive, on average; parts that a hot group is spread over, and the share of all rows that makes one hot.
FILE_BYTES, SALTS, HOT = 16 << 20, 1024, 1000
END = "\r\n\r\n"
DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _line(name: str, value):
    """A header line, or nothing for a null; line ends in a value become blanks."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), F.regexp_replace(value, r"[\r\n]+", " "), F.lit("\r\n")), F.lit(""))


def _record(kind: str, name, headers, block):
    head = F.concat(F.lit(f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: "), name, F.lit(f"\r\nWARC-Date: {DATE}\r\n"), headers)
    return F.concat(head, F.lit("Content-Length: "), F.octet_length(F.encode(block, "utf-8")).cast("string"), F.lit("\r\n\r\n"), block)


def base32_sha1(hex_digest):
    """RFC 4648's base 32 of a 160-bit digest in hexadecimal: 32 digits, no filling."""
    digits = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    fives = [F.conv(F.substring(hex_digest, 1 + 5 * k, 5), 16, 10).cast("int") for k in range(8)]  # 20 bits each
    return F.concat(*(F.substring(digits, F.shiftright(x, s).bitwiseAND(31) + 1, F.lit(1)) for x in fives for s in (15, 10, 5, 0)))


def plan(pages: DataFrame, n_rows: int, files: int, least: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """``page_id``, ``url``, ``payload``, ``size``, ``digest``, ``revisit``, ``first_id`` and ``first_url`` of every page."""
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    data = F.encode(payload, "utf-8")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"), F.octet_length(data).cast("long").alias("size"), F.sha1(data).alias("hex"))
    named = rows.where(F.col("page_id").isNotNull() & (F.col("size") >= least))
    groups = named.groupBy("hex").agg(F.min("page_id").alias("first_id"), F.min_by("url", "page_id").alias("first_url"), F.count("*").alias("n"))
    nameless = rows.where(F.col("page_id").isNull() & (F.col("size") >= least)).groupBy("hex").agg(F.count("*").alias("m"))
    groups = groups.join(nameless, "hex", "left").where((F.col("n") > 1) | F.col("m").isNotNull()).withColumn("rows", F.col("n") + F.coalesce("m", F.lit(0)))
    # of groups with a HOT-th of all rows there are HOT at most, so their digests may go to all tasks
    hot = kept(groups.where(F.col("rows") >= max(16, n_rows // HOT)).select("hex"), "hot")
    salts = F.when(F.col("is_hot"), F.lit(SALTS)).otherwise(F.lit(1))
    marked = lambda df: df.join(F.broadcast(hot.withColumn("is_hot", F.lit(True))), "hex", "left").withColumn("is_hot", F.coalesce("is_hot", F.lit(False)))
    spread = marked(groups).select("hex", "first_id", "first_url", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    salted = marked(rows).withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), salts).cast("int")).drop("is_hot")
    # payloads move once: by the key of this join, into as many parts as there will be files
    out = salted.repartition(files, "hex", "salt").join(spread.hint("shuffle_hash"), ["hex", "salt"], "left")
    revisit = F.col("first_id").isNotNull() & (F.col("size") >= least) & ~F.col("first_id").eqNullSafe(F.col("page_id"))
    return out.select("page_id", "url", "payload", "size", base32_sha1(F.col("hex")).alias("digest"), revisit.alias("revisit"), F.when(revisit, F.col("first_id")).alias("first_id"), F.when(revisit, F.col("first_url")).alias("first_url"))


def write(pages: DataFrame, path: str | None = None, least: int = 0, **columns: str) -> str:
    """Write all pages as gzipped archives; returns their folder."""
    spark = pages.sparkSession
    path = path or fresh_path(spark, "warc")
    payload = pages[columns.get("payload_col", "html")]
    total = pages.agg(F.coalesce(F.sum(F.octet_length(payload).cast("long")), F.lit(0)), F.count("*")).first()
    files = max(1, -(-(total[0] + 1024 * total[1]) // FILE_BYTES))
    rows = plan(pages, int(total[1]), int(files), least, **columns)
    # the name is drawn once a row, before the records part
    rows = rows.withColumn("name", F.concat(F.lit("<urn:uuid:"), F.uuid(), F.lit(">")))
    request, metadata = (F.concat(F.lit("<urn:uuid:"), F.expr(f"regexp_replace(md5(concat(name, '{k}')), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '$1-$2-$3-$4-$5')"), F.lit(">")) for k in ("request", "metadata"))
    digest = _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest"))
    target = _line("WARC-Target-URI", F.col("url"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit("\r\n\r\n"))
    response = _record("response", F.col("name"), F.concat(target, digest, F.lit("Content-Type: application/http; msgtype=response\r\n")), F.concat(http, "payload"))
    revisit = _record("revisit", F.col("name"), F.concat(target, digest, F.lit(f"WARC-Profile: {PROFILE}\r\n"), _line("WARC-Refers-To-Target-URI", F.col("first_url")), F.lit(f"WARC-Refers-To-Date: {DATE}\r\n"), F.lit("Content-Type: application/http; msgtype=response\r\n")), http)
    together = _line("WARC-Concurrent-To", F.col("name"))
    parts = F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)([^#]*)", 1), F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)([^#]*)", 2)
    ask = F.concat(F.lit("GET "), F.when(parts[1] == "", "/").otherwise(F.regexp_replace(parts[1], r"\s+", "%20")), F.lit(" HTTP/1.1\r\nHost: "), F.regexp_replace(parts[0], r"\s+", ""), F.lit("\r\n\r\n"))
    asked = _record("request", request, F.concat(target, together, F.lit("Content-Type: application/http; msgtype=request\r\n")), ask)
    fields = F.concat(_line("page-id", F.col("page_id").cast("string")), _line("payload-bytes", F.col("size").cast("string")), _line("refers-to-page", F.col("first_id").cast("string")))
    about = _record("metadata", metadata, F.concat(target, together, F.lit("Content-Type: application/warc-fields\r\n")), fields)
    records = rows.select(F.explode(F.array(F.when(F.col("revisit"), revisit).otherwise(response), asked, about)).alias("value"))
    records.write.option("lineSep", END).option("compression", "gzip").text(path)
    return path


def unpacked(data: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    """The content of a gzip file of one member or more, piece by piece; of any other file, itself."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    rest = memoryview(data)
    while len(rest):
        stream = zlib.decompressobj(31)
        while not stream.eof and len(rest):
            yield stream.decompress(rest[:step])
            left = len(stream.unused_data)
            rest = rest[min(step, len(rest)) - left :]
        tail = stream.flush()
        if tail:
            yield tail


def records(pieces: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of a stream; header names in lower case."""
    held, source = bytearray(), iter(pieces)

    def more() -> bool:
        piece = next(source, None)
        if piece is None:
            return False
        held.extend(piece)
        return True

    at = 0
    while True:
        while (end := held.find(b"\r\n\r\n", at)) < 0 or held[at : at + 2] == b"\r\n":
            if held[at : at + 2] == b"\r\n":
                at += 2
            elif not more():
                if bytes(held[at:]).strip():
                    raise ValueError("an archive ends within a record's header")
                return
        lines = bytes(held[at:end]).decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a record: {lines[0][:40]!r}")
        headers = {name.lower(): value.strip() for name, _, value in (line.partition(":") for line in lines[1:])}
        size, start = int(headers["content-length"]), end + 4
        while len(held) < start + size:
            if not more():
                raise ValueError("an archive ends within a record")
        yield headers, bytes(held[start : start + size])
        at = start + size
        if at > 1 << 20:
            del held[:at]
            at = 0


RECORD = "type string, record_id string, concurrent_to string, target_uri string, payload_digest string, refers_to_uri string, payload_bytes long, payload string, fields map<string,string>"


def read(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row a record of all archives of a folder."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["type", "record_id", "concurrent_to", "target_uri", "payload_digest", "refers_to_uri", "payload_bytes", "payload", "fields"]
        types = [pa.string()] * 6 + [pa.int64(), pa.string(), pa.map_(pa.string(), pa.string())]

        def made(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        for batch in batches:
            for k in range(batch.num_rows):
                rows, held = [], 0
                for headers, block in records(unpacked(batch.column(0)[k].as_buffer().to_pybytes())):
                    kind = headers.get("warc-type")
                    payload, digest, fields = None, headers.get("warc-payload-digest"), None
                    if kind in ("response", "revisit"):
                        payload = block.partition(b"\r\n\r\n")[2]
                        if kind == "response":
                            own = "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
                            if digest is not None and digest != own:
                                raise ValueError(f"the payload of {headers.get('warc-record-id')} has another digest")
                            digest = own
                    elif kind == "metadata":
                        fields = [(n, v.strip()) for n, _, v in (line.partition(":") for line in block.decode("utf-8").split("\r\n") if line)]
                    rows.append((kind, headers.get("warc-record-id"), headers.get("warc-concurrent-to"), headers.get("warc-target-uri"), digest, headers.get("warc-refers-to-target-uri"), None if payload is None else len(payload), payload.decode("utf-8", "replace") if with_payload and payload is not None else None, fields))
                    held += len(block)
                    if held > 8 << 20 or len(rows) >= 2000:
                        yield made(rows)
                        rows, held = [], 0
                if rows:
                    yield made(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(run, RECORD)


def captures(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One nested row a capture: ``capture`` (the response's or revisit's struct), ``request``, ``metadata`` (null if missing)."""
    every = kept(read(spark, path, with_payload), "records")
    main = every.where(F.col("type").isin("response", "revisit")).select(F.col("record_id").alias("id"), F.struct("type", "record_id", "target_uri", "payload_digest", "refers_to_uri", "payload_bytes", "payload").alias("capture"))
    asked = every.where("type = 'request'").select(F.col("concurrent_to").alias("id"), F.struct("record_id", "target_uri").alias("request"))
    about = every.where("type = 'metadata'").select(F.col("concurrent_to").alias("id"), F.struct("record_id", "fields").alias("metadata"))
    return main.join(asked, "id", "left").join(about, "id", "left").drop("id")


def digests(found: DataFrame) -> DataFrame:
    """``page_id``, ``payload_bytes``, ``payload_digest``, ``record_type``, ``refers_to`` of captures that ``write`` has made."""
    field = lambda name: F.col("metadata.fields").getItem(name)
    return found.select(
        field("page-id").cast("long").alias("page_id"), F.when(F.col("capture.type") == "response", F.col("capture.payload_bytes")).otherwise(field("payload-bytes").cast("long")).alias("payload_bytes"),
        F.regexp_replace("capture.payload_digest", "^sha1:", "").alias("payload_digest"), F.col("capture.type").alias("record_type"), field("refers-to-page").cast("long").alias("refers_to"),
    )
