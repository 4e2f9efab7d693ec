"""WARC writing and a salvage reader.

Written archives: one gzip member per record, WARC/1.1, with block and payload
digests; of records with equal payloads the one with the smallest page_id is a
response, the others are revisits of it. Spark's own text writer puts the
members down, so any store that Spark writes to will do; the separator it wants
is an empty gzip member, which decompresses to nothing.

Reading: a member or plain record has to pass its checks (gzip checksum, header
form, Content-Length, closing blank lines, block digest). After a failed check
the reader looks for the next gzip magic or version line that starts a valid
record, recovers everything from there on, and logs the bytes between as a gap.
Inside a member it goes on at the next version line, and of a broken member it
keeps the records that inflated before the break.

Defined cases
    null html: an empty payload; equal payloads: all rows that carry the
    smallest page_id are responses; null page_id: always a response; null url:
    an empty target; payloads below ``min_bytes``: all responses; empty table:
    no archive rows; other columns are ignored.

Scale: duplicates are found on digests alone (a map-side minimum per digest;
digests of very many pages are joined by broadcast); the pages themselves are
joined with the revisits by broadcast up to a counted bound and by shuffle
beyond. Archives are cut by records and by bytes. One file is read by one task,
which holds the file and one inflated member; reading is linear in both.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from base64 import b32encode
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docdelta.llm.exprs import joined_hot
from docdelta.plans.scratch import materialize

# An empty gzip member, and the revisit profile of WARC 1.1.
EMPTY_MEMBER = bytes.fromhex("1f8b0800000000000003" "0300" "00000000" "00000000")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MAGIC = b"\x1f\x8b\x08"
_START = re.compile(rb"\x1f\x8b\x08|WARC/\d+\.\d+\r\n")
_VERSION = re.compile(rb"WARC/\d+\.\d+\r\n")
_HEAD_END = re.compile(rb"\r\n\r\n|\r\n(?=WARC/\d+\.\d+\r\n)")
_URN = "urn:docdelta:page:"
WINDOW = 1 << 16


def sha1_b32(data: bytes) -> str:
    return b32encode(hashlib.sha1(data).digest()).decode()


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One uncompressed record."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m.group()):02X}", url or "")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{_URN}{'none' if page_id is None else page_id}>",
        "WARC-Date: 2000-01-01T00:00:00Z",
        f"WARC-Target-URI: {uri}",
        "Content-Type: application/http;msgtype=response",
        f"WARC-Payload-Digest: sha1:{sha1_b32(payload)}",
        f"WARC-Block-Digest: sha1:{sha1_b32(block)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{_URN}{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 6) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low in range(0, batch.num_rows, 256):
            part = batch.slice(low, 256)
            ids, urls, html, refs = (part.column(i).to_pylist() for i in range(4))
            out = [gzip_member(record_bytes(*x)) for x in zip(ids, urls, html, refs, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["member"])


def revisits(sizes: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, sha1 and refers_to of the rows whose payload an earlier page has; ``sizes``: page_id, n, sha1."""
    seen = sizes.filter(F.col("page_id").isNotNull() & (F.col("n") >= min_bytes))
    first = seen.groupBy("sha1", "n").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("most"), F.count("*").alias("rows")).filter("refers_to <> most").drop("most")
    return joined_hot(seen, first, ["sha1", "n"], "rows", sizes.count()).filter("page_id <> refers_to").groupBy("page_id", "sha1").agg(F.min("refers_to").alias("refers_to"))


def write(pages: DataFrame, path: str, min_bytes: int = 0, records_per_file: int = 2000, file_bytes: int = 256 << 20, broadcast_rows: int = 1_000_000) -> None:
    """Write one record per page below ``path``, in files of at most ``records_per_file`` records and about ``file_bytes`` bytes.

    Pages too large for that many in a file are written apart, in files of fewer.
    """
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    sizes = materialize(pages.select(F.col("page_id").cast("long").alias("page_id"), F.octet_length(body).alias("n"), F.octet_length("url").alias("u"), F.sha1(body).alias("sha1")), "payloads")
    again = materialize(revisits(sizes, min_bytes), "revisits").withColumnRenamed("page_id", "id").withColumnRenamed("sha1", "digest")
    small = file_bytes // records_per_file
    weight = F.col("n") + F.coalesce("u", F.lit(0))
    large, most = sizes.agg(F.count_if(weight > small), F.max(weight)).first()
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", body.alias("html"))
    n = again.count()
    if n:
        rows = rows.join(F.broadcast(again) if n <= broadcast_rows else again, (F.col("page_id") == F.col("id")) & (F.sha1("html") == F.col("digest")), "left")
    else:
        rows = rows.withColumn("refers_to", F.lit(None).cast("long"))
    weight = F.octet_length("html") + F.coalesce(F.octet_length("url"), F.lit(0))
    _put(rows.filter(weight <= small), path, records_per_file)
    if large:
        _put(rows.filter(weight > small), path, max(1, file_bytes // most))


def _put(rows: DataFrame, path: str, records: int) -> None:
    members = rows.select("page_id", "url", "html", "refers_to").mapInArrow(_members, "member binary")
    (
        members.select(F.col("member").cast("string").alias("value")).write.mode("append").option("lineSep", EMPTY_MEMBER.decode("latin-1"))
        .option("encoding", "ISO-8859-1").option("maxRecordsPerFile", records).text(path)
    )


class Damaged(ValueError):
    """A record that failed a check."""


def parse_record(data: bytes, pos: int) -> tuple[dict, int]:
    """The record at a version line, and the position behind it."""
    stop = _VERSION.match(data, pos) and _HEAD_END.search(data, pos)
    if not stop or stop.group() != b"\r\n\r\n":
        raise Damaged("header")
    end = stop.start()
    head: dict[str, str] = {}
    for line in data[pos:end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("header line")
        head[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    if not re.fullmatch(r"\d{1,18}", head.get("content-length", "")):
        raise Damaged("content length")
    if not {"warc-type", "warc-record-id", "warc-date"} <= head.keys():
        raise Damaged("mandatory field")
    low = end + 4
    high = low + int(head["content-length"])
    if data[high : high + 4] != b"\r\n\r\n":
        raise Damaged("length of the block")
    block = data[low:high]
    said = head.get("warc-block-digest", "")
    if said.startswith("sha1:") and said[5:] != sha1_b32(block):
        raise Damaged("block digest")
    http, _, payload = block.partition(b"\r\n\r\n") if block.startswith(b"HTTP/") else (b"", b"", block)
    return {"head": head, "http": http, "payload": payload}, high + 4


def _inflate(data: bytes, pos: int) -> tuple[bytes, int, str]:
    """What a member holds up to its end or its damage, the position behind it, and the damage.

    The member is fed in windows, so its cost is that of its own bytes; a window
    that fails is fed once more byte by byte.
    """
    z, out, at, step = zlib.decompressobj(31), [], pos, WINDOW
    while at < len(data) and not z.eof:
        before = z.copy() if step > 1 else None
        window = data[at : at + step]
        try:
            out.append(z.decompress(window))
        except zlib.error:
            if before is None:
                return b"".join(out), at, "gzip member"
            z, step = before, 1
            continue
        at += len(window)
    return b"".join(out), at - len(z.unused_data), "" if z.eof else "unended gzip member"


def _records(inner: bytes) -> tuple[list[dict], str]:
    """All records of an inflated member that pass their checks, and the first failure."""
    found, at, reason = [], 0, ""
    while at < len(inner):
        try:
            record, at = parse_record(inner, at)
            found.append(record)
        except Damaged as e:
            reason = reason or str(e)
            ahead = _VERSION.search(inner, at + 1)
            at = ahead.start() if ahead else len(inner)
    return found, reason


def salvage(data: bytes) -> Iterator[tuple[str, int, int, object]]:
    """("record", start, end, record) and ("gap", start, end, reason) over all bytes of an archive.

    Records out of a damaged member have the span of its gap.
    """
    pos, gap, reason = 0, None, ""
    kept, seen, until = [], [], 0  # records of the members in the gap; those and earlier ones up to where members were read
    while pos < len(data):
        try:
            within = ""
            if data.startswith(MAGIC, pos):
                inner, end, broken = _inflate(data, pos)
                found, within = _records(inner)
                if broken:
                    kept, seen = kept + found, (seen if pos < until else []) + found
                    until = max(until, end) if found else until
                    raise Damaged(broken)
                if within and not found:
                    raise Damaged(within)
            else:
                record, end = parse_record(data, pos)
                if pos < until and record in seen:  # a member may hold its bytes as they are
                    raise Damaged("gzip member")
                found = [record]
        except Damaged as e:
            if gap is None:
                gap, reason = pos, str(e)
            ahead = _START.search(data, pos + 1)
            pos = ahead.start() if ahead else len(data)
            continue
        if gap is not None:
            yield "gap", gap, pos, reason
            yield from (("record", gap, pos, record) for record in kept)
            gap, kept = None, []
        if within:
            yield "gap", pos, end, within
        for record in found:
            yield "record", pos, end, record
        pos = end
    if gap is not None:
        yield "gap", gap, len(data), reason
        yield from (("record", gap, len(data), record) for record in kept)


SCHEMA = "file string, start long, stop long, gap string, record_type string, record_id string, refers_to string, uri string, payload_bytes long, payload_digest string, payload binary"


def _row(file: str, kind: str, start: int, stop: int, what: object, payload: bool) -> tuple:
    if kind == "gap":
        return (file, start, stop, str(what), *[None] * 7)
    head, http, body = what["head"], what["http"], what["payload"]
    kept = head.get("warc-type") == "revisit"
    length = re.search(rb"(?im)^content-length:\s*(\d+)\s*$", http)
    size = int(length.group(1)) if kept and length else len(body)
    digest = head.get("warc-payload-digest", "").removeprefix("sha1:") if kept else sha1_b32(body)
    bare = lambda name: head[name].strip("<>") if name in head else None
    return (file, start, stop, None, head.get("warc-type"), bare("warc-record-id"), bare("warc-refers-to"), head.get("warc-target-uri"), size, digest, body if payload else None)


def _reader(payload: bool, schema: pa.Schema):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0), batch.column(1), strict=True):
                rows: list[tuple] = []
                for found in salvage(content.as_buffer().to_pybytes()):
                    rows.append(_row(file.as_py(), *found, payload))
                    if len(rows) >= 512:
                        yield _batch(rows, schema)
                        rows = []
                if rows:
                    yield _batch(rows, schema)

    return read


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def read(spark: SparkSession, path: str, payload: bool = True, pattern: str = "*") -> DataFrame:
    """Records and gaps of all archives below a path."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content")
    return files.mapInArrow(_reader(payload, to_arrow_schema(StructType.fromDDL(SCHEMA))), SCHEMA)


def page_rows(records: DataFrame) -> DataFrame:
    """The digest by page of what was read."""
    of = lambda c: F.col(c).substr(F.lit(len(_URN) + 1), F.length(c)).try_cast("long")
    return records.filter(F.col("gap").isNull()).select(
        of("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", of("refers_to").alias("refers_to")
    )
