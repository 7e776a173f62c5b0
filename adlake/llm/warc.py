"""WARC archives: one gzip member per record, read in parallel byte ranges."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adlake.llm.common import filesystem, partitions, ship, small_batches, stored

#: Start of a gzip member: two magic bytes and the deflate method; any flags may follow.
MAGIC = b"\x1f\x8b\x08"

#: Bytes per read, and of an archive that one task owns.
BUFFER = 1 << 20
RANGE = 8 << 20

#: Fixed values of the archive format.
VERSION = "WARC/1.1"
VERSIONS = b"WARC/"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"


def payload_digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(
    id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool
) -> bytes:
    """One gzip member. A revisit has no body and names the record it refers to."""
    body = b"" if revisit else payload
    lines = [
        VERSION,
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if id is None else id}>",
        f"WARC-Date: {DATE}",
    ]
    if url is not None:
        lines.append("WARC-Target-URI: " + "".join(c for c in url if c not in "\r\n"))
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}", "", ""]
    packer = zlib.compressobj(3, zlib.DEFLATED, 31)
    text = "\r\n".join(lines).encode() + body + b"\r\n\r\n"
    return packer.compress(text) + packer.flush()


def _write(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    files, base = filesystem(folder)
    files.create_dir(base, recursive=True)
    # Only the attempt that succeeds reports its file, so no other one is ever read.
    name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
    count = 0
    # By its name the file system would compress the archive as a whole once more.
    with files.open_output_stream(f"{base}/{name}", compression=None) as out:
        for batch in small_batches(batches, 2):
            ids, urls, pages, firsts = (column.to_pylist() for column in batch.columns)
            for id, url, html, first in zip(ids, urls, pages, firsts, strict=True):
                payload = (html or "").encode()
                digest = payload_digest(payload)
                out.write(record(id, url, payload, digest, first, first is not None))
                count += 1
        size = out.tell()
    yield pa.RecordBatch.from_arrays(
        [pa.array([f"{folder}/{name}"]), pa.array([size]), pa.array([count])], ["path", "size", "records"]
    )


def write_archives(
    pages: DataFrame,
    folder: str,
    id: str = "page_id",
    url: str = "url",
    html: str = "html",
    least: int = 0,
) -> DataFrame:
    """Write a record per row below ``folder`` and give the stored list of archives.

    Of rows with equal payloads of ``least`` bytes or more, the one with the smallest id
    is the response, and the others revisit it. Null payloads count as empty, so they
    equal each other; rows with a null id are responses, as nothing could name what
    they refer to, or be named; of repeated rows of one id all are responses. Payloads
    are grouped by digest, and only groups of several rows are joined back.
    """
    spark = pages.sparkSession
    ship(spark)
    body = F.coalesce(F.col(html), F.lit(""))
    long_enough = F.octet_length(body) >= least
    firsts = (
        pages.where(F.col(id).isNotNull() & long_enough)
        .groupBy(F.sha1(body.cast("binary")).alias("digest"))
        .agg(F.min(F.col(id).cast("long")).alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select("digest", "first")
    )
    shared = stored(firsts, "payloads")
    rows = pages.select(
        F.col(id).cast("long").alias("id"),
        F.col(url).cast("string").alias("url"),
        F.col(html).alias("html"),
        F.when(F.col(id).isNotNull() & long_enough, F.sha1(body.cast("binary"))).alias("digest"),
    )
    told = rows.join(shared.hint("merge"), "digest", "left").select(
        "id", "url", "html", F.when(F.col("first") != F.col("id"), F.col("first")).alias("first")
    )
    written = told.mapInArrow(partial(_write, folder=folder), "path string, size long, records long")
    return stored(written, "archives")


class _Window:
    """Bytes of a file from some place on, read in buffers and dropped when passed."""

    def __init__(self, file, size: int, at: int):
        self.file, self.size, self.start = file, size, at
        self.data = bytearray()

    def reach(self, end: int) -> bool:
        """Have bytes up to ``end``; False if the file ends before."""
        while self.start + len(self.data) < min(end, self.size):
            at = self.start + len(self.data)
            more = self.file.read_at(min(BUFFER, self.size - at), at)
            if not more:
                raise EOFError(f"the archive ends at {at}, before {self.size}")
            self.data += more
        return end <= self.size

    def find(self, at: int, end: int) -> int:
        """Where the magic begins at or after ``at`` and before ``end``; -1 if nowhere."""
        while at < end:
            self.reach(at + len(MAGIC))
            found = self.data.find(MAGIC, at - self.start)
            if found >= 0:
                return found + self.start if found + self.start < end else -1
            at = max(at, self.start + len(self.data) - len(MAGIC) + 1)
            self.drop(at)
            if not self.reach(at + len(MAGIC)):
                return -1
        return -1

    def drop(self, at: int) -> None:
        del self.data[: at - self.start]
        self.start = at

    def begins(self, at: int) -> bool:
        """Whether the bytes at ``at`` decode to the beginning of a record. If not, a magic
        found there was but bytes within another member."""
        engine, head, place = zlib.decompressobj(31), b"", at
        while len(head) < len(VERSIONS) and not engine.eof and self.reach(place + 1):
            chunk = bytes(self.data[place - self.start : place - self.start + 512])
            try:
                head += engine.decompress(chunk, 64)
            except zlib.error:
                return False
            place += len(chunk)
        return head.startswith(VERSIONS)

    def inflate(self, at: int) -> tuple[bytes, int] | None:
        """The member that begins at ``at`` and where it ends; None if it is damaged."""
        engine = zlib.decompressobj(31)
        parts: list[bytes] = []
        place = at
        while not engine.eof:
            if not self.reach(place + 1):
                return None
            chunk = bytes(self.data[place - self.start : place - self.start + (1 << 16)])
            try:
                parts.append(engine.decompress(chunk))
            except zlib.error:
                return None
            place += len(chunk)
        return b"".join(parts), place - len(engine.unused_data)


def parse(data: bytes) -> dict | None:
    """Headers (lower-cased names) and ``payload`` of a decoded record."""
    head, found, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not found or not lines[0].startswith("WARC/"):
        return None
    headers = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if colon:
            headers[name.strip().lower()] = value.strip()
    length = headers.get("content-length", "")
    if not length.isdecimal() or len(rest) < int(length):
        return None
    return headers | {"payload": rest[: int(length)]}


def records_in(file, size: int, start: int, end: int) -> Iterator[tuple[int, dict | None]]:
    """The records that start within ``[start, end)``, each with its place; the last may
    end beyond. None stands for a damaged one.

    From a range's start on, candidates for a member are tried in turn until one decodes to
    the beginning of a record. Where a member ends the next one must begin, so no bytes
    inside a member are tried, and none is passed over unseen: what does not begin there,
    or breaks off, is damaged, and the search goes on behind it. The member that begins
    where the range's last one ends is the next range's, but whether it begins is told here,
    as that range would take a damaged beginning for the end of this member.
    """
    window, at, due = _Window(file, size, start), start, start == 0
    while at < end or (due and at < size):
        if not due and (at := window.find(at, end)) < 0:
            return
        if not window.begins(at):
            if due:
                yield at, None
            at, due = at + 1, False
            continue
        if at >= end:
            return
        member = window.inflate(at)
        yield at, parse(member[0]) if member else None
        at, due = (member[1], True) if member else (at + 1, False)
        if at < end:
            window.drop(at)


def _number(urn: str | None) -> int | None:
    """The page that a record of :func:`record` is of; other records' ids name none."""
    text = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    if not text.isascii() or not text.removeprefix("-").isdecimal():
        return None
    number = int(text)
    return number if -(1 << 63) <= number < 1 << 63 else None


DAMAGED = "damaged"

RECORDS = (
    "page_id long, record_type string, refers_to long, payload_digest string, "
    "url string, payload binary, record_id string, path string, at long"
)


def _read(batches: Iterator[pa.RecordBatch], strict: bool) -> Iterator[pa.RecordBatch]:
    names = [column.split()[0] for column in RECORDS.split(", ")]
    kinds = (
        pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.string(),
        pa.string(), pa.int64(),
    )

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [()] * len(names)
        arrays = [pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, names)

    for batch in batches:
        for path, size, start, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            files, place = filesystem(path)
            rows, held = [], 0
            with files.open_input_file(place) as file:
                for at, found in records_in(file, size, start, end):
                    if found is None:
                        if strict:
                            raise ValueError(f"{path} has a damaged record at byte {at}")
                        rows.append((None, DAMAGED, *[None] * 5, path, at))
                        continue
                    rows.append(
                        (
                            _number(found.get("warc-record-id")),
                            found.get("warc-type"),
                            _number(found.get("warc-refers-to")),
                            found.get("warc-payload-digest", "").removeprefix("sha1:"),
                            found.get("warc-target-uri"),
                            found["payload"],
                            found.get("warc-record-id"),
                            path,
                            at,
                        )
                    )
                    held += len(found["payload"])
                    if held > 8 << 20:
                        yield batch_of(rows)
                        rows, held = [], 0
            yield batch_of(rows)


def read_archives(
    spark: SparkSession, archives: DataFrame, range_bytes: int = RANGE, strict: bool = True
) -> DataFrame:
    """All records of the listed archives (``path``, ``size``), of whatever type and made by
    whatever program, one gzip member each: ``page_id``, ``record_type``, ``refers_to``,
    ``payload_digest``, ``url``, ``payload``, ``record_id``, ``path`` and ``at``, its first
    byte. Record ids that name no page give a null ``page_id`` and ``refers_to``.

    Archives are cut into byte ranges, each read by whichever task gets it; a record
    belongs to the range it starts in. A damaged record ends the job, or, unless ``strict``,
    is a row of the type "damaged" with nothing but ``path`` and ``at``. An empty list gives
    no rows.
    """
    ship(spark)
    ranges = archives.where("size > 0").select(
        "path",
        "size",
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(range_bytes).cast("long"))).alias("start"),
    ).withColumn("end", F.least("size", F.col("start") + range_bytes))
    spread = ranges.repartition(partitions(spark), "path", "start")
    return spread.mapInArrow(partial(_read, strict=strict), RECORDS)
