"""A binary file of token ids: blocks transposed to bit planes, each plane compressed.

Layout: ``MAGIC``; the planes of block after block; an Arrow stream with the documents
(``doc_id``, ``n_tokens``); an Arrow stream with the chunk index (``block``, ``plane``,
``at``, ``size``); the trailer: lengths of the two streams and the number of ids as
three little-endian 64-bit integers, block length and planes as two 32-bit ones, and
``MAGIC`` again.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import ipc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from adlake.llm import bpe
from adlake.llm.common import filesystem, partitions, ship, small_batches, stored

MAGIC = b"IDPLANE1"
TRAILER = struct.Struct("<QQQII8s")

#: Ids per block, a multiple of 8.
BLOCK = 1 << 16


def to_planes(ids: np.ndarray, planes: int, by: int) -> list[bytes]:
    """``planes`` planes of ``by`` bits (1 or 8) of ids of 16 or 32 bits, lowest first."""
    width = ids.dtype.itemsize
    raw = np.ascontiguousarray(ids).view(np.uint8).reshape(-1, width)
    whole = [np.ascontiguousarray(raw[:, k]) for k in range(min(width, -(-planes * by // 8)))]
    if by == 8:
        return [part.tobytes() for part in whole]
    return [
        np.packbits(whole[k // 8] & (1 << k % 8), bitorder="little").tobytes() for k in range(planes)
    ]


def from_planes(planes: list[bytes], count: int, by: int) -> np.ndarray:
    """The ids that :func:`to_planes` took apart."""
    raw = np.zeros((count, 4), np.uint8)
    if by == 8:
        for k, plane in enumerate(planes):
            raw[:, k] = np.frombuffer(plane, np.uint8)
    else:
        for first in range(0, len(planes), 8):
            part = np.zeros(count, np.uint8)
            for k, plane in enumerate(planes[first : first + 8]):
                bits = np.unpackbits(np.frombuffer(plane, np.uint8), count=count, bitorder="little")
                part |= bits << k
            raw[:, first // 8] = part
    return raw.view("<u4").reshape(-1)


def _stream(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with ipc.new_stream(sink, table.schema, options=ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


class Writer:
    """Appends documents; holds one block and the documents' lengths."""

    def __init__(self, out, planes: int, by: int, block: int = BLOCK):
        self.out, self.planes, self.by, self.block = out, planes, by, block
        self.pack = zstandard.ZstdCompressor(level=1).compress
        self.docs: list[tuple] = []
        self.chunks: list[tuple] = []
        self.open: list[np.ndarray] = []
        self.held = self.total = self.blocks = 0
        self.at = out.write(MAGIC)

    def add(self, id: int | None, ids: np.ndarray) -> None:
        self.docs.append((id, len(ids)))
        self.open.append(ids)
        self.held += len(ids)
        self.total += len(ids)
        if self.held >= self.block:
            joined = np.concatenate(self.open)
            whole = len(joined) - len(joined) % self.block
            for at in range(0, whole, self.block):
                self._put(joined[at : at + self.block])
            self.open, self.held = [joined[whole:]], len(joined) - whole

    def _put(self, ids: np.ndarray) -> None:
        for k, plane in enumerate(to_planes(ids, self.planes, self.by)):
            data = self.pack(plane)
            self.chunks.append((self.blocks, k, self.at, len(data)))
            self.at += self.out.write(data)
        self.blocks += 1

    def close(self) -> None:
        if self.held:
            self._put(np.concatenate(self.open))
        ids, lengths = zip(*self.docs, strict=True) if self.docs else ((), ())
        docs = pa.table({"doc_id": pa.array(ids, pa.int64()), "n_tokens": pa.array(lengths, pa.int64())})
        names = ("block", "plane", "at", "size")
        columns = zip(*self.chunks, strict=True) if self.chunks else [()] * 4
        index = pa.table({n: pa.array(c, pa.int64()) for n, c in zip(names, columns, strict=True)})
        parts = _stream(docs), _stream(index)
        for part in parts:
            self.out.write(part)
        self.out.write(
            TRAILER.pack(*map(len, parts), self.total, self.block, self.planes * 256 + self.by, MAGIC)
        )


class Reader:
    """Documents and blocks of one file; reads only what is asked for."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        docs, index, self.total, self.block, shape, magic = TRAILER.unpack(
            file.read_at(TRAILER.size, size - TRAILER.size)
        )
        if magic != MAGIC:
            raise ValueError("no file of id planes")
        self.planes, self.by = divmod(shape, 256)
        end = size - TRAILER.size
        self.docs = ipc.open_stream(file.read_at(docs, end - index - docs)).read_all()
        self.index = ipc.open_stream(file.read_at(index, end - index)).read_all()
        self.places = list(
            zip(self.index.column("at").to_pylist(), self.index.column("size").to_pylist(), strict=True)
        )
        self.unpack = zstandard.ZstdDecompressor().decompress

    def ids(self, block: int) -> np.ndarray:
        count = min(self.block, self.total - block * self.block)
        most = count if self.by == 8 else -(-count // 8)
        places = self.places[block * self.planes : (block + 1) * self.planes]
        planes = [self.unpack(self.file.read_at(n, at), max_output_size=most) for at, n in places]
        return from_planes(planes, count, self.by)

    def documents(self) -> Iterator[tuple[int | None, int, list[np.ndarray]]]:
        """``doc_id``, ids before it in this file, and its ids in pieces, block by block."""
        block, ids, at, start = -1, np.empty(0, "<u4"), 0, 0
        for id, length in zip(
            self.docs.column("doc_id").to_pylist(), self.docs.column("n_tokens").to_pylist(), strict=True
        ):
            pieces, left = [], length
            while left:
                if at == len(ids):
                    block, at = block + 1, 0
                    ids = self.ids(block)
                pieces.append(ids[at : at + left])
                at += len(pieces[-1])
                left -= len(pieces[-1])
            yield id, start, pieces
            start += length


MANIFEST = "part long, path string, n_docs long, n_tokens long, n_bytes long"


def _write(
    batches: Iterator[pa.RecordBatch], folder: str, path: str, end: int, planes: int, by: int
) -> Iterator[pa.RecordBatch]:
    encoder = bpe.encoder(path)
    last = np.array([end], encoder.dtype).tobytes()
    files, base = filesystem(folder)
    files.create_dir(base, recursive=True)
    part = TaskContext.get().partitionId()
    # Only the attempt that succeeds reports its file, so no other one is ever read.
    name = f"ids-{part:06d}-{uuid.uuid4().hex}.planes"
    with files.open_output_stream(f"{base}/{name}") as out:
        writer = Writer(out, planes, by)
        for batch in small_batches(batches, 1):
            for id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                writer.add(id, np.frombuffer(encoder.encode(text or "") + last, encoder.dtype))
        writer.close()
        size = out.tell()
    row = (part, f"{folder}/{name}", len(writer.docs), writer.total, size)
    names = [column.split()[0] for column in MANIFEST.split(", ")]
    yield pa.RecordBatch.from_arrays([pa.array([value]) for value in row], names)


def write_ids(
    docs: DataFrame,
    folder: str,
    id: str = "doc_id",
    text: str = "text",
    end: int = 2,
    path: str | None = None,
    by: int = 1,
) -> DataFrame:
    """Write all documents in ascending order of id below ``folder`` (one file per
    range of ids) and give the stored manifest: ``part``, ``path``, ``n_docs``,
    ``n_tokens``, ``n_bytes``.

    Null text counts as empty and has its end id only; null ids come first; rows of
    equal id are ordered by text; an empty table gives files without documents, or
    none. A task holds one batch and one block, however many rows have one id.
    """
    path = path or bpe.default_path()
    spark = docs.sparkSession
    ship(spark)
    bits = 16 if bpe.width(path) == "<u2" else 32
    ordered = (
        docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
        .repartitionByRange(partitions(spark), "id", F.xxhash64("text"))
        .sortWithinPartitions("id", F.xxhash64("text"), "text")
    )
    written = ordered.mapInArrow(
        partial(_write, folder=folder, path=path, end=end, planes=bits // by, by=by), MANIFEST
    )
    return stored(written, "manifest")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
    for batch in batches:
        for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            files, at = filesystem(path)
            rows: list[tuple] = []
            with files.open_input_file(at) as file:
                for id, start, pieces in Reader(file).documents():
                    crc = 0
                    for piece in pieces:
                        crc = zlib.crc32(piece.tobytes(), crc)
                    rows.append((id, base + start, sum(map(len, pieces)), crc))
                    if len(rows) == 8192:
                        yield _rows(rows, names)
                        rows = []
            yield _rows(rows, names)


def _rows(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)


def read_ids(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """``doc_id``, ``start`` over all files in order, ``n_tokens`` and ``ids_crc32`` of
    every document, from the files that a manifest lists."""
    ship(spark)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.select(
        "path", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base")
    )
    return placed.repartition(partitions(spark), "path").mapInArrow(
        _read, "doc_id long, start long, n_tokens long, ids_crc32 long"
    )
