"""WARC archives: written through Spark's committed output, read back by byte ranges.

Every record is a gzip member of its own. The text sink writes the members as they are, with an empty
gzip member as its line separator, so a file is a valid multi-member gzip file and a lost task leaves
nothing behind. The reader needs no index: a task scans its byte range for gzip magic, takes a place
for a record only if the member there decodes to a WARC header, and owns the records that start in it.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import zlib
from collections.abc import Iterator
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provenir.llm.common import stage
from provenir.session import shared_folder

MAGIC = b"\x1f\x8b\x08"
EMPTY_MEMBER = gzip.compress(b"", mtime=0)
RANGE_BYTES = 4_000_000
_READ = 1 << 20
_HEAD = 1 << 14
_WARC = b"WARC/1."

RECORDS = (
    "path string, record_offset long, record_type string, record_id string, refers_to_id string, uri string, "
    "payload_bytes long, payload_digest string, payload binary"
)


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _clean(value: str) -> str:
    return " ".join(value.split())


def record(kind: str, row: str, uri: str, payload: bytes, refers: str | None) -> bytes:
    """A gzip member with one WARC record; a revisit carries the HTTP head alone."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if kind == "revisit" else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:row:{row}>",
        f"WARC-Target-URI: {_clean(uri)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest_of(payload)}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers is not None:
        head.insert(3, f"WARC-Refers-To: <urn:row:{refers}>")
        head.insert(3, "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", compresslevel=6, mtime=0)


def write_archive(
    pages: DataFrame, folder: str, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html", least: int = 0
) -> None:
    """Write one record per row to ``folder``.

    Of rows with equal payloads of at least ``least`` bytes the one with the largest id is a response
    and the others are revisits of it; rows that share that id and payload are all responses. Smaller
    payloads are always responses. A null payload is empty, a null uri is empty, a null id is smaller
    than any other and written as an empty id. An empty table gives an archive without records.
    """
    rows = pages.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.col(uri_col).cast("string"), F.lit("")).alias("uri"),
        F.encode(F.coalesce(F.col(payload_col).cast("string"), F.lit("")), "UTF-8").alias("payload"),
    ).withColumn("sha", F.sha1("payload"))
    groups = stage(
        rows.filter(F.octet_length("payload") >= least).groupBy("sha").agg(F.max("id").alias("keeper"), F.count("*").alias("n"))
        .filter("n > 1").drop("n")
    )
    # The payload's digest is the key; a key of very many rows is split by the adaptive join.
    marked = rows.join(groups, "sha", "left").select(
        F.coalesce(F.col("id").cast("string"), F.lit("")).alias("id"),
        "uri",
        "payload",
        F.when(~F.col("id").eqNullSafe(F.col("keeper")) & F.col("keeper").isNotNull(), F.col("keeper").cast("string")).alias("refers"),
    )

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                rows = zip(*(part.column(i).to_pylist() for i in range(4)))
                made = [record("revisit" if ref is not None else "response", i, uri, body, ref) for i, uri, body, ref in rows]
                yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], ["member"])

    (
        marked.mapInArrow(members, "member binary")
        .select(F.col("member").cast("string").alias("value"))
        .write.option("lineSep", EMPTY_MEMBER.decode("latin-1"))
        .option("encoding", "ISO-8859-1")
        .option("compression", "none")
        .text(folder)
    )


class _File:
    """A sliding buffer over a file."""

    def __init__(self, handle, size: int):
        self.handle, self.size, self.start, self.data = handle, size, 0, b""

    def hold(self, start: int, n: int) -> int:
        """Have ``n`` bytes from ``start`` in the buffer, or all up to the end; returns where they begin in it."""
        have = self.start + len(self.data)
        if not self.start <= start <= have:
            self.start = have = start
            self.data = b""
        if have < min(start + n, self.size):
            kept = self.data[start - self.start :]
            self.handle.seek(have)
            self.start, self.data = start, kept + self.handle.read(min(max(_READ, start + n - have), self.size - have))
        return start - self.start

    def view(self, start: int, n: int) -> memoryview:
        at = self.hold(start, n)
        return memoryview(self.data)[at : at + n]

    def find(self, what: bytes, start: int, end: int) -> int:
        """The first place of ``what`` in [start, end), -1 without one."""
        while start < end:
            n = min(_READ, end + len(what) - 1 - start)
            at = self.hold(start, n)
            found = self.data.find(what, at, at + n)
            if found >= 0:
                return self.start + found
            start += max(1, n - len(what) + 1)
        return -1


def _member(file: _File, at: int) -> tuple[bytes, int] | None:
    """The decoded member at ``at`` and where it ends, if it is a WARC record; an empty member gives b""."""
    inflate = zlib.decompressobj(31)
    pieces, head, place, most = [], b"", at, _HEAD
    while not inflate.eof:
        raw = file.view(place, most)
        if not len(raw):
            return None
        try:
            piece = inflate.decompress(raw)
        except zlib.error:
            return None
        place += len(raw) - len(inflate.unused_data)
        pieces.append(piece)
        if len(head) < len(_WARC):
            head += piece[: len(_WARC)]
            if head[: len(_WARC)] != _WARC[: len(head)]:
                return None
        most = _READ
    return b"".join(pieces), place


def records_in(file: _File, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """The records that start in [start, end), with their offsets."""
    at = start
    while (at := file.find(MAGIC, at, end)) >= 0:
        member = _member(file, at)
        if member is None:
            at += 1
            continue
        if member[0]:
            yield at, member[0]
        at = member[1]


def parse(raw: bytes) -> tuple | None:
    """Type, ids, uri, payload length and digest, payload; the payload is checked against its digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    block = rest[: int(fields.get("content-length", 0))]
    kind = fields.get("warc-type", "")
    digest = fields.get("warc-payload-digest", "").rpartition(":")[2]
    length = int(fields.get("x-payload-length", -1))
    payload = None
    if kind == "response":
        payload = block.partition(b"\r\n\r\n")[2]
        if digest and digest_of(payload) != digest:
            raise ValueError(f"payload of {fields.get('warc-record-id')} does not match its digest")
        digest, length = digest or digest_of(payload), len(payload)
    row = lambda x: x.removeprefix("<urn:row:").removesuffix(">") if x else None
    return kind, row(fields.get("warc-record-id")), row(fields.get("warc-refers-to")), fields.get("warc-target-uri"), length, digest, payload


def read_archive(spark: SparkSession, folder: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The records of all files of ``folder``: see ``RECORDS``.

    Files are cut into ranges of ``range_bytes``; a record belongs to the range it starts in, however
    far it reaches. Bytes between members, and members that are not WARC records, are passed over. A
    response whose payload does not match its digest stops the job. Tasks open the files by their URI,
    so the folder must be one that pyarrow's file systems reach.
    """
    files = spark.read.format("binaryFile").load(folder).select("path", "length")
    every = F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(range_bytes).cast("long"))
    ranges = files.filter("length > 0").select("path", "length", F.explode(every).alias("start"))
    # One task a range, as far as that is a sensible number of tasks.
    ranges = ranges.repartition(max(1, min(ranges.count(), 20_000)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        schema = pa.schema(
            [("path", pa.string()), ("record_offset", pa.int64()), *((n, pa.string()) for n in ("record_type", "record_id", "refers_to_id", "uri")), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())]
        )
        for batch in batches:
            for path, size, start in zip(*(batch.column(i).to_pylist() for i in range(3))):
                uri = path if "://" in path or not path.startswith("file:") else "file://" + path[5:]
                system, place = fs.FileSystem.from_uri(uri)
                with system.open_input_file(place) as handle:
                    rows, held = [], 0
                    for at, raw in records_in(_File(handle, size), start, min(start + range_bytes, size)):
                        rows.append((path, at, *parse(raw)))
                        held += len(raw)
                        if held > 4 * _READ:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return ranges.mapInArrow(read, RECORDS)


def archive_folder(spark: SparkSession) -> str:
    """A new folder for an archive in the shared folder."""
    return f"{shared_folder(spark)}/warc-{uuid4().hex}"
