"""WARC archives: one gzip member per record, and a sequential reader.

`write_archives` turns rows (page_id, url, payload) into archives: each row of
its result is one archive, the concatenation of one gzip member per record.
`read_archives` walks such archives with an incremental decompressor, frames
each record by its Content-Length, and verifies its digests.

Payloads that occur more than once are stored once: the record with the
largest page_id is the response, the others are revisit records that refer to
it.  The equal payloads are found by their SHA-1 and length, with a count per
digest that is combined before the shuffle.  The digests that repeat are
broadcast while they are at most `BROADCAST_DIGESTS`, which is counted; beyond
that identifiers are joined with them, and payloads only with their own row's
key, so that a payload that fills a third of the table doesn't meet in one task.

The reader takes archives of other writers too: digests are verified where they
are given, record types and identifiers may be any, and headers may be in any
case; what breaks the framing raises `BadArchive`.

Nulls and edges: a null payload is empty, a null url is left out.  Rows with a
null page_id are written as responses and never referred to; they are read back
as null.  Rows repeated with the same page_id and payload are all written; all
of them are responses where that page_id is the largest.  Payloads of any length
are one record each.  Columns besides page_id, url and payload are not read,
whatever their names.  An empty table gives an empty table.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, row_key, scratch

ARCHIVE_BYTES = 4_000_000
BROADCAST_DIGESTS = 200_000
#: the date of records whose capture nobody has dated
UNDATED = "1970-01-01T00:00:00Z"
#: zlib's level, and gzip framing for its window bits
LEVEL, GZIP = 1, 31
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ARCHIVES = "archive binary, records long"
RECORDS = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary, record_bytes long"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_bytes(page_id: int, url: str | None, payload: bytes, refers_to: int | None, date: str = UNDATED) -> bytes:
    """One WARC/1.1 record, not compressed.

    A revisit has the HTTP header alone as its block; its full payload's length and digest stay in the headers.
    """
    digest = sha1_base32(payload)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{sha1_base32(block)}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes) -> bytes:
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, GZIP)
    return z.compress(data) + z.flush()


class Record(NamedTuple):
    headers: dict[str, str]
    block: bytes
    member_bytes: int


class BadArchive(ValueError):
    """The archive's bytes don't follow the format, or a digest doesn't match."""


def members(archive: bytes, step: int = 1 << 16) -> Iterator[tuple[bytes, int]]:
    """Each gzip member's content and its length in the archive, decompressed piece by piece."""
    at, view = 0, memoryview(archive)
    while at < len(archive):
        z, out, used = zlib.decompressobj(GZIP), [], 0
        while not z.eof:
            piece = view[at + used : at + used + step]
            if not piece:
                raise BadArchive("a gzip member is cut short")
            try:
                out.append(z.decompress(piece))
            except zlib.error as e:
                raise BadArchive(f"a gzip member can't be decompressed: {e}") from e
            used += len(piece) - len(z.unused_data)
        yield b"".join(out), used
        at += used


def records(archive: bytes) -> Iterator[Record]:
    """The archive's records in order, framed by Content-Length, their block digests verified."""
    for data, used in members(archive):
        head, sep, rest = data.partition(b"\r\n\r\n")
        lines = head.decode("utf-8", "replace").split("\r\n")
        if not sep or not lines[0].startswith("WARC/1."):
            raise BadArchive("a record doesn't start with a WARC version and headers")
        headers = headers_of(lines[1:])
        if not headers.get("content-length", "").isdigit():
            raise BadArchive("a record has no Content-Length")
        length = int(headers["content-length"])
        if rest[length:] != b"\r\n\r\n":
            raise BadArchive("a record's block doesn't have the length of its Content-Length")
        block = rest[:length]
        verify(headers.get("warc-block-digest"), block, "a block doesn't have the digest of its header")
        yield Record(headers, block, used)


def headers_of(lines: list[str]) -> dict[str, str]:
    """Header lines by their names in lower case; a line that begins with a space goes on with the one before."""
    out: dict[str, str] = {}
    name = ""
    for x in lines:
        if x[:1] in (" ", "\t") and name:
            out[name] += " " + x.strip()
        elif ":" in x:
            name, _, value = x.partition(":")
            name = name.strip().lower()
            out[name] = value.strip()
    return out


def verify(digest: str | None, data: bytes, what: str) -> None:
    """Compares a digest, if it is given and of SHA-1 (base32 or hexadecimal), with the data."""
    kind, _, value = (digest or "").partition(":")
    if kind.lower() == "sha1" and value.upper() not in (sha1_base32(data), hashlib.sha1(data).hexdigest().upper()):
        raise BadArchive(what)


def _page(urn: str | None) -> int | None:
    """The page of an identifier of ours; other writers' records have none."""
    inner = (urn or "").strip("<>").removeprefix("urn:page:")
    return int(inner) if inner.lstrip("-").isdigit() else None


def parse(record: Record) -> tuple:
    """A row of RECORDS; a response's payload is verified against its digest."""
    h, kind = record.headers, record.headers.get("warc-type", "")
    payload, size = record.block, len(record.block)
    if kind in ("response", "revisit") and record.block.startswith(b"HTTP/"):
        head, _, payload = record.block.partition(b"\r\n\r\n")
        said = headers_of(head.decode("utf-8", "replace").split("\r\n")[1:]).get("content-length", "")
        size = int(said) if said.isdigit() else len(payload)
        if kind == "response" and len(payload) != size:
            raise BadArchive("a payload doesn't have the length of its header")
    given = h.get("warc-payload-digest")
    if kind == "response":
        verify(given, payload, "a payload doesn't have the digest of its header")
    digest = given.partition(":")[2] if given else sha1_base32(payload)
    return (_page(h.get("warc-record-id")), h.get("warc-target-uri"), kind, size, digest, _page(h.get("warc-refers-to")), payload if kind != "revisit" else None, record.member_bytes)


def link_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, refers_to): refers_to is the page_id of the equal payload's response, null for responses."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce(F.col("payload").cast("string"), F.lit("")), "utf-8").alias("payload"))
    rows = rows.withColumns({"digest": F.sha1("payload"), "size": F.length("payload").cast("long")})
    known = rows.filter((F.col("size") >= min_bytes) & F.col("page_id").isNotNull()).groupBy("digest", "size").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).filter("n > 1").drop("n")
    refers = F.when(F.col("page_id") < F.col("last"), F.col("last")).alias("refers_to")
    known = cut(known)
    if known.limit(BROADCAST_DIGESTS + 1).count() <= BROADCAST_DIGESTS:
        return rows.join(F.broadcast(known), ["digest", "size"], "left").select("page_id", "url", "payload", refers)
    keyed = rows.withColumn("key", row_key("page_id", "digest"))
    ids = keyed.select("key", "page_id", "digest", "size").join(known, ["digest", "size"]).select("key", refers).filter("refers_to IS NOT NULL").distinct()
    return keyed.join(ids, "key", "left").select("page_id", "url", "payload", "refers_to")


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out, size = [], 0

    def archive() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([b"".join(out)], pa.binary()), pa.array([len(out)], pa.int64())], ["archive", "records"])

    for b in batches:
        for page_id, url, payload, refers_to in zip(*(b[c].to_pylist() for c in ("page_id", "url", "payload", "refers_to")), strict=True):
            out.append(gzip_member(record_bytes(page_id, url, payload, refers_to)))
            size += len(out[-1])
            if size >= ARCHIVE_BYTES:
                yield archive()
                out, size = [], 0
    if out:
        yield archive()


def _read(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for archive in b["archive"]:
            rows, size = [], 0
            for r in records(archive.as_py()):
                rows.append(parse(r))
                size += len(rows[-1][6] or b"")
                if size > 2 * ARCHIVE_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def write_archives(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """One row for each archive of rows (page_id, url, payload): its bytes and its number of records."""
    return link_revisits(pages, min_bytes).mapInArrow(_write, ARCHIVES)


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """One row of RECORDS for each record; payloads=False leaves the verified payloads out."""
    keep = [i for i, name in enumerate(x.split()[0] for x in RECORDS.split(", ")) if payloads or name != "payload"]
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    full = pa.schema([(n, kinds[t]) for n, t in (x.split() for x in RECORDS.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _read(batches, full):
            yield b.select([full.names[i] for i in keep])

    return archives.select("archive").mapInArrow(run, ", ".join(RECORDS.split(", ")[i] for i in keep))


def store_and_read(pages: DataFrame, path: str, min_bytes: int = 0, payloads: bool = False) -> DataFrame:
    """Writes the archives to a table at path and reads every record back from it."""
    write_archives(pages, min_bytes).write.mode("overwrite").option("compression", "uncompressed").parquet(path)
    return read_archives(pages.sparkSession.read.parquet(path), payloads)
