"""WARC archives: a writer of gzip members, and a reader that salvages damaged files.

Writing: one member per record, packed into segments of about `SEGMENT` bytes; a
segment is a file. Files are written by Spark's own committer, so a task that is
run again leaves no half file. Of records with equal payloads of `min_bytes` or
more, that with the largest page_id is a response; the others are revisits that
refer to it.

Reading: each member or plain record must inflate, parse, have its stated length
and match its digests. After a failed check the reader searches for the next gzip
member or version line that passes all of them, reports the bytes between as a gap
with the reason, and goes on. White space and zero bytes between records are no gap.

Defined results: a null payload is empty; a null page_id is written as such, is
never referred to, and revisits when an equal payload has an id; rows that share
the largest page_id and the payload are all responses; null urls are empty; an
empty table gives no files and no records; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEGMENT = 8 << 20
MIN_BYTES = 0
DATE = "2024-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
GZIP, VERSION = b"\x1f\x8b\x08", b"WARC/1."
_PADDING = b"\r\n\x00 \t"
_TOKEN = re.compile(r"[!#$%&'*+.^_`|~0-9A-Za-z-]+")
_MANDATORY = {"warc-type", "warc-record-id", "warc-date", "content-length"}


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def urn(page_id: int | None) -> str:
    return f"<urn:x-page:{'none' if page_id is None else page_id}>"


def id_of(value: str | None) -> int | None:
    tail = (value or "").strip("<>").rpartition(":")[2]
    return int(tail) if tail.lstrip("-").isdigit() else None


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str = DATE) -> bytes:
    """One uncompressed record."""
    block = HTTP if refers_to is not None else HTTP + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {urn(page_id)}",
        f"WARC-Date: {date}", f"WARC-Target-URI: {' '.join((url or '').split())}", f"WARC-Payload-Digest: sha1:{digest(payload)}",
        f"WARC-Block-Digest: sha1:{digest(block)}", "Content-Type: application/http; msgtype=response",
        f"X-Payload-Length: {len(payload)}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {urn(refers_to)}", f"WARC-Profile: {PROFILE}"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member without a time stamp."""
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


class Damaged(Exception):
    """A check that a record failed."""


@dataclass
class Record:
    offset: int
    length: int
    headers: dict[str, str]
    block: bytes = field(repr=False, default=b"")

    @property
    def payload(self) -> bytes:
        return self.block.partition(b"\r\n\r\n")[2]


@dataclass
class Gap:
    start: int
    end: int
    reason: str


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers, block and end of the plain record at `at`; Damaged if a check fails."""
    if not data.startswith(VERSION, at):
        raise Damaged("no version line")
    stop = data.find(b"\r\n\r\n", at)
    if stop < 0:
        raise Damaged("unfinished header")
    headers = {}
    for line in data[at:stop].decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if not colon or not _TOKEN.fullmatch(name):
            raise Damaged("malformed header")
        headers[name.strip().lower()] = value.strip()
    if not _MANDATORY <= headers.keys():
        raise Damaged("mandatory header missing")
    size = headers["content-length"]
    if not size.isdigit():
        raise Damaged("no content length")
    begin, end = stop + 4, stop + 4 + int(size)
    if end + 4 > len(data) or data[end : end + 4] != b"\r\n\r\n":
        raise Damaged("wrong content length")
    block = data[begin:end]
    kinds = [("warc-block-digest", block)]
    if headers.get("warc-type") == "response" and "warc-payload-digest" in headers:
        kinds.append(("warc-payload-digest", block.partition(b"\r\n\r\n")[2]))
    for name, content in kinds:
        stated = headers.get(name)
        if stated and stated.startswith("sha1:") and stated[5:] != digest(content):
            raise Damaged(f"wrong {name}")
    return headers, block, end + 4


def _inflated(data: bytes, at: int, chunk: int = 1 << 16) -> tuple[bytes, int]:
    """Content and length of the gzip member at `at`; reads no further than a chunk beyond it."""
    inflater, parts, place = zlib.decompressobj(31), [], at
    try:
        while not inflater.eof and place < len(data):
            parts.append(inflater.decompress(data[place : place + chunk]))
            place += chunk
    except zlib.error as e:
        raise Damaged(f"gzip: {e}") from e
    if not inflater.eof:
        raise Damaged("unfinished member")
    return b"".join(parts), min(place, len(data)) - at - len(inflater.unused_data)


def _at(data: bytes, at: int) -> Record:
    """The valid record that starts at `at`, plain or as a member."""
    if data.startswith(GZIP, at):
        plain, length = _inflated(data, at)
        headers, block, end = parse(plain)
        if plain[end:].strip(_PADDING):
            raise Damaged("more than a record in a member")
        return Record(at, length, headers, block)
    headers, block, end = parse(data, at)
    return Record(at, end - at, headers, block)


def salvage(data: bytes) -> Iterator[Record | Gap]:
    """All valid records of a file in order, and the gaps between them."""
    at, gap, reason = 0, None, ""
    while at < len(data):
        if gap is None and data[at] in _PADDING:
            at += 1
            continue
        try:
            found = _at(data, at)
        except Damaged as e:
            if gap is None:
                gap, reason = at, str(e)
            places = [k for k in (data.find(GZIP, at + 1), data.find(VERSION, at + 1)) if k >= 0]
            at = min(places, default=len(data))
            continue
        if gap is not None:
            yield Gap(gap, at, reason)
            gap = None
        yield found
        at += found.length
    if gap is not None:
        yield Gap(gap, len(data), reason)


def _pack(date: str, segment: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            rows = zip(*(batch[c].to_pylist() for c in ("page_id", "url", "html", "refers_to")), strict=True)
            for page_id, url, html, refers_to in rows:
                packed = member(record(page_id, url, (html or "").encode(), refers_to, date))
                held.append(packed)
                size += len(packed)
                if size >= segment:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["data"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["data"])

    return run


def write(
    pages: DataFrame, path: str, min_bytes: int = MIN_BYTES, date: str = DATE, segment: int = SEGMENT,
    id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
) -> None:
    """Write the pages as WARC files into the folder `path`."""
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"),
    ).withColumn("sha", F.when(F.octet_length("html") >= min_bytes, F.sha1(F.col("html").cast("binary"))))
    first = rows.where("sha is not null").groupBy("sha").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    first = first.where("n > 1 and first is not null").select("sha", "first")
    rows = rows.join(first, "sha", "left").withColumn(
        "refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    )
    files = rows.select("page_id", "url", "html", "refers_to").mapInArrow(_pack(date, segment), "data binary")
    # The text writer puts the bytes of a row as they are, and one line feed after them.
    files.select(F.col("data").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).text(path)


_OUT = T.StructType(
    [
        T.StructField("file", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
        T.StructField("gap", T.StringType()), T.StructField("record_type", T.StringType()),
        T.StructField("page_id", T.LongType()), T.StructField("refers_to", T.LongType()), T.StructField("url", T.StringType()),
        T.StructField("payload_digest", T.StringType()), T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload", T.BinaryType()),
    ]
)
_ARROW = pa.schema(
    [(f.name, {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}[f.dataType.simpleString()]) for f in _OUT]
)


def _row(name: str, found: Record | Gap, bodies: bool) -> dict:
    if isinstance(found, Gap):
        return {"file": name, "start": found.start, "end": found.end, "gap": found.reason}
    own = found.headers
    stated = own.get("x-payload-length", "")
    response = own.get("warc-type") == "response"
    return {
        "file": name, "start": found.offset, "end": found.offset + found.length, "record_type": own.get("warc-type"),
        "page_id": id_of(own.get("warc-record-id")), "refers_to": id_of(own.get("warc-refers-to")), "url": own.get("warc-target-uri"),
        "payload_digest": (own.get("warc-payload-digest") or "").removeprefix("sha1:") or None,
        "payload_bytes": len(found.payload) if response else int(stated) if stated.isdigit() else None,
        "payload": found.payload if bodies and response else None,
    }


def _salvage(bodies: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                rows = [_row(batch["path"][k].as_py(), x, bodies) for x in salvage(batch["content"][k].as_py())]
                yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    return run


def read(spark: SparkSession, path: str, bodies: bool = True) -> DataFrame:
    """Records and gaps (column gap: the reason) of all files under `path`."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(_salvage(bodies), _OUT)


def records(found: DataFrame) -> DataFrame:
    return found.where("gap is null").drop("gap")


def gaps(found: DataFrame) -> DataFrame:
    """The quarantine log: file, start, end, reason."""
    return found.where("gap is not null").select("file", "start", "end", F.col("gap").alias("reason"))
