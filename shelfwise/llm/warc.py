"""Web archives: a writer, and a reader whose tasks share files by byte ranges.

Every record is a gzip member of its own. A reading task scans its range for gzip's
magic bytes, takes a place for a member only if what it decodes to begins with a
record's head, and owns the records that start inside the range, reading past its end
where the last one does. A record thus belongs to one task, however files are cut.

Payloads of at least ``LEAST_SHARED`` bytes that occur more than once are stored once:
the page with the smallest id is the response, the others are revisits that name it.
Files get a new name on every attempt and count only if the manifest, committed by
Spark, lists them, so lost executors leave no doubled records.

Null payloads are empty. Rows without a page id have an empty id and are never the one
that others refer to; where no page of a payload has an id all are responses. Rows that
repeat the smallest id are responses too. Null urls leave the target out. An empty table
gives no files.

Archives of other makers are read as well. All record types come back; requests and
responses lose their HTTP head, other types keep their whole block as payload. Digests by
SHA-256, SHA-1 or MD5, in hexadecimal or base 32, are compared with the payload
(``digest_ok``), unknown or absent ones are not, and ``digest`` is the payload's SHA-256
wherever there is a payload. A page id that is no number is none. Members that are damaged,
or whose record has no sound length, are skipped; ``scan_archives`` tells how many bytes.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm.chunked import batches_of, rows
from shelfwise.sources.scratch import cut_lineage, scratch_path

LEAST_SHARED = 100
RANGE_BYTES, READ_BYTES = 8 << 20, 1 << 20
MAGIC, VERSION = b"\x1f\x8b\x08", b"WARC/1.1"
DATE = "2024-01-01T00:00:00Z"
_PAGE_IDS = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the name space of URLs
_FILES = pa.schema([("file", pa.string()), ("bytes", pa.int64()), ("records", pa.int64())])
_RECORDS = pa.schema(
    [
        ("page_id", pa.int64()),
        ("record_type", pa.string()),
        ("target", pa.string()),
        ("refers_to", pa.int64()),
        ("digest", pa.string()),
        ("payload_bytes", pa.int64()),
        ("payload", pa.binary()),
        ("digest_ok", pa.bool_()),
        ("skipped_bytes", pa.int64()),
    ]
)
_RECORDS_SQL = (
    "page_id long, record_type string, target string, refers_to long, digest string, payload_bytes long,"
    " payload binary, digest_ok boolean, skipped_bytes long"
)


def _record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(_PAGE_IDS, f'page:{page_id}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record, uncompressed; ``refers_to`` makes it a revisit without payload."""
    revisit = refers_to is not None
    http = (
        f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    ).encode()
    block = http if revisit else http + payload
    head = [
        VERSION.decode(),
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_record_id(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Page-ID: {'' if page_id is None else page_id}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=_PRINTABLE)}")
    if revisit:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"WARC-Refers-To: {_record_id(refers_to)}")
        head.append(f"X-Refers-To-Page: {refers_to}")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


_PRINTABLE = "".join(map(chr, range(33, 127)))


def with_referees(pages: DataFrame) -> DataFrame:
    """``(page_id, url, payload, digest, refers_to)`` of every page."""
    html = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    keyed = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), html.alias("payload"))
    keyed = keyed.withColumn("digest", F.sha2("payload", 256))
    shared = (
        keyed.where(F.octet_length("payload") >= LEAST_SHARED)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
        .where("n > 1 and first_id is not null")
        .select("digest", "first_id")
    )
    # Stored, so that Spark knows whether it is small enough to send to all tasks.
    joined = keyed.join(cut_lineage(shared, "shared_payloads"), "digest", "left")
    other = F.col("page_id").isNull() | (F.col("page_id") != F.col("first_id"))
    return joined.select("page_id", "url", "payload", "digest", F.when(other, F.col("first_id")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, level: int = 6) -> DataFrame:
    """Write one archive per task below ``folder``; the manifest ``(file, bytes, records)``."""

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(folder)
        name = f"part-{uuid.uuid4().hex}.warc.gz"
        size = count = 0
        out = None
        for row in rows(batches, ["page_id", "url", "payload", "digest", "refers_to"]):
            if out is None:
                store.create_dir(path, recursive=True)
                out = store.open_output_stream(f"{path}/{name}", compression=None)
            gzip = zlib.compressobj(level, zlib.DEFLATED, 31)
            data = gzip.compress(record(*row)) + gzip.flush()
            out.write(data)
            size, count = size + len(data), count + 1
        if out is not None:
            out.close()
            yield from batches_of([(f"{folder}/{name}", size, count)], _FILES)

    listed = with_referees(pages).mapInArrow(write, "file string, bytes long, records long")
    return cut_lineage(listed, "manifest")


class _Bytes:
    """Reads of a file in large steps, the last step kept."""

    def __init__(self, file: pa.NativeFile, size: int):
        self.file, self.size, self.start, self.held = file, size, 0, b""

    def at(self, place: int) -> bytes:
        """Some bytes from ``place`` on, none at the end."""
        if not self.start <= place < self.start + len(self.held):
            self.file.seek(place)
            self.start, self.held = place, self.file.read(READ_BYTES)
        return self.held[place - self.start :]


def _head(data: bytes) -> dict[str, str] | None:
    """The head fields of a decoded record, or None if it is none."""
    end = data.find(b"\r\n\r\n")
    if end < 0 or not data.startswith(b"WARC/1."):
        return None
    lines = data[:end].decode("utf-8", "replace").split("\r\n")[1:]
    return {name.lower(): value.strip() for name, _, value in (line.partition(":") for line in lines)}


def _member(source: _Bytes, place: int, whole: bool) -> tuple[bytes, int] | None:
    """The member at ``place`` decoded, and where the next one begins.

    Without ``whole`` only as much as shows the head. None if there is no member.
    """
    gzip, parts, at = zlib.decompressobj(31), [], place
    try:
        while not gzip.eof:
            data = source.at(at)
            if not data:
                return None
            if not whole:
                data = data[:65536]
            parts.append(gzip.decompress(data))
            at += len(data)
            if not parts[0].startswith(b"WARC/1."[: len(parts[0])]):
                return None
            if not whole and b"\r\n\r\n" in (start := b"".join(parts)):
                return (start, at) if _head(start) is not None else None
    except zlib.error:
        return None
    return b"".join(parts), at - len(gzip.unused_data)


def _next_member(source: _Bytes, place: int, end: int) -> int | None:
    """The first place in ``[place, end)`` where a record's member starts."""
    while place < end:
        data = source.at(place)
        if len(data) < len(MAGIC) and place + len(data) < source.size:
            source.held = b""  # the magic bytes may lie across two reads
            data = source.at(place)
        found = data.find(MAGIC)
        if found < 0:
            if place + len(data) >= source.size:
                return None
            place += max(1, len(data) - len(MAGIC) + 1)
        elif place + found >= end:
            return None
        elif _member(source, place + found, whole=False):
            return place + found
        else:
            place += found + 1
    return None


def _number(text: str | None) -> int | None:
    text = (text or "").strip()
    return int(text) if text.isascii() and text.removeprefix("-").isdigit() and len(text) < 19 else None


def _digest(declared: str) -> tuple[str, bytes | None]:
    """Algorithm and bytes of a digest field; no bytes where it cannot be read."""
    name, _, value = declared.partition(":")
    name, value = name.strip().lower().replace("-", ""), value.strip()
    size = {"sha256": 32, "sha1": 20, "md5": 16}.get(name)
    if size is None:
        return name, None
    try:
        if len(value) == 2 * size:
            return name, bytes.fromhex(value)
        found = base64.b32decode(value.upper() + "=" * (-len(value) % 8))
        return name, found if len(found) == size else None
    except (ValueError, binascii.Error):
        return name, None


def parse(data: bytes) -> tuple | None:
    """A decoded record's row, or None if its length does not agree."""
    head = _head(data)
    if head is None:
        return None
    start = data.index(b"\r\n\r\n") + 4
    length = _number(head.get("content-length"))
    if length is None or length < 0 or len(data) < start + length:
        return None
    block, kind = data[start : start + length], head.get("warc-type", "")
    http, blank, payload = block.partition(b"\r\n\r\n")
    if not (blank and http.startswith((b"HTTP/", b"GET ", b"POST ", b"HEAD ")) and kind in ("request", "response", "revisit")):
        http, payload = b"", block
    declared = head.get("warc-payload-digest", "") if http else head.get("warc-block-digest", head.get("warc-payload-digest", ""))
    name, expected = _digest(declared)
    if kind == "revisit":  # of the full payload only the digest and the length are told
        lines = [line.partition(b":") for line in http.split(b"\r\n")]
        sizes = [_number(value.decode("latin-1")) for field, _, value in lines if field.lower() == b"content-length"]
        digest = expected.hex() if name == "sha256" and expected else declared or None
        size, payload, sound = (sizes or [None])[0], None, None
    else:
        digest, size = hashlib.sha256(payload).hexdigest(), len(payload)
        sound = hashlib.new(name, payload).digest() == expected if expected else None
    refers = _number(head.get("x-refers-to-page"))
    return _number(head.get("x-page-id")), kind, head.get("warc-target-uri"), refers, digest, size, payload, sound, 0


def _skipped(number: int) -> tuple:
    return (*[None] * (len(_RECORDS) - 1), number)


def records_in(file: pa.NativeFile, size: int, start: int, end: int) -> Iterator[tuple]:
    """The records that start in ``[start, end)`` of a file. What had to be skipped after
    the first of them gives rows without a type."""
    source = _Bytes(file, size)
    place = _next_member(source, start, end)
    while place is not None and place < end:
        member = _member(source, place, whole=True)
        row = parse(member[0]) if member else None
        if row is not None:
            yield row
            place = member[1]
            if place >= end or source.at(place).startswith(MAGIC) or place >= size:
                continue
        following = _next_member(source, place + (row is None), end)
        yield _skipped((min(end, size) if following is None else following) - place)
        place = following


def scan_archives(spark: SparkSession, manifest: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The records of the archives ``manifest(file, bytes)`` and, as rows with a null
    ``record_type``, the ``skipped_bytes`` between them."""

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for name, size, start in rows(batches, ["file", "bytes", "start"]):
                store, path = fs.FileSystem.from_uri(name)
                with store.open_input_file(path) as file:
                    yield from records_in(file, size, start, start + range_bytes)

        yield from batches_of(each(), _RECORDS, most_bytes=4 << 20)

    step = F.lit(range_bytes).cast("long")
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), step)
    ranges = manifest.select("file", "bytes", F.explode(starts).alias("start"))
    n = max(1, min(ranges.count(), 100_000))
    return ranges.repartition(n, "file", "start").mapInArrow(read, _RECORDS_SQL)


def read_archives(spark: SparkSession, manifest: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The records of the archives ``manifest(file, bytes)``.

    ``payload_bytes`` and ``digest`` are of the full payload, also for revisits.
    """
    return scan_archives(spark, manifest, range_bytes).where("record_type is not null").drop("skipped_bytes")


def list_archives(spark: SparkSession, path: str) -> DataFrame:
    """The manifest ``(file, bytes)`` of the archives that ``path`` names, a pattern or a folder."""
    files = spark.read.format("binaryFile").load(path)
    uri = F.regexp_replace("path", "^file:/(?!/)", "file:///")
    return files.select(uri.alias("file"), F.col("length").alias("bytes"))


def archive_folder(spark: SparkSession) -> str:
    """A fresh folder that all executors reach, as a URI."""
    folder = scratch_path(spark, "archives")
    return folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
