"""Packing along a space-filling curve: similar documents share training sequences."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adlake.llm import bpe
from adlake.llm.common import partitions, ship, small_batches, stored

#: Buckets that token ids are hashed to, dimensions they are projected to, and bits of
#: the curve's key in each; a key has ``DIMENSIONS * BITS`` bits, below 63.
BUCKETS = 4096
DIMENSIONS = 4
BITS = 15


@lru_cache(maxsize=1)
def _projection() -> np.ndarray:
    return np.random.default_rng(5).standard_normal((BUCKETS, DIMENSIONS))


def position(ids: np.ndarray) -> np.ndarray:
    """Where a document lies: its hashed vector of damped counts, scaled to length one,
    on ``DIMENSIONS`` random directions, each mapped to ``[0, 2**BITS)``."""
    hashed = (ids.astype(np.uint32) * np.uint32(2654435761)) >> np.uint32(20)
    counts = np.log1p(np.bincount(hashed, minlength=BUCKETS))
    at = counts @ _projection() / max(np.sqrt(counts @ counts), 1e-12)
    even = 1 / (1 + np.exp(-1.702 * at))
    return np.minimum(even * (1 << BITS), (1 << BITS) - 1).astype(np.int64)


def hilbert_keys(points: np.ndarray, bits: int) -> np.ndarray:
    """Distance along the Hilbert curve of each row of cell coordinates.

    Level by level from the top the coordinates are reflected and exchanged into the
    frame of the cell they fall in; the Gray code of what results is the key.
    """
    x = points.T.astype(np.int64).copy()
    top = 1 << (bits - 1)
    level = top
    while level > 1:
        low = level - 1
        for i in range(len(x)):
            set_here = (x[i] & level) != 0
            swap = np.where(set_here, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(set_here, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        level >>= 1
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    turned = np.zeros_like(x[0])
    level = top
    while level > 1:
        turned = np.where((x[-1] & level) != 0, turned ^ (level - 1), turned)
        level >>= 1
    x ^= turned
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for axis in x:
            key = (key << 1) | ((axis >> bit) & 1)
    return key


def _tokens(batches: Iterator[pa.RecordBatch], path: str, end: int) -> Iterator[pa.RecordBatch]:
    encoder = bpe.encoder(path)
    last = np.array([end], encoder.dtype).tobytes()
    for batch in small_batches(batches, 1):
        ids = encoder.encode_all(pc.fill_null(batch.column(1), ""), last)
        where = [position(np.frombuffer(data.as_buffer(), encoder.dtype)) for data in ids]
        keys = hilbert_keys(np.stack(where), BITS)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(keys), ids.cast(pa.binary())], ["id", "key", "ids"]
        )


def placed_tokens(docs: DataFrame, id: str, text: str, path: str, end: int) -> DataFrame:
    """``id``, ``ids`` (little-endian, with the end id) and ``key`` along the curve."""
    ship(docs.sparkSession)
    picked = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    return picked.mapInArrow(partial(_tokens, path=path, end=end), "id long, key long, ids binary")


class _Packer:
    """Cuts a stream of documents into full sequences, and its rest by powers of two."""

    def __init__(self, length: int, first: int):
        self.length, self.next, self.used = length, first, 0
        self.open: list[tuple] = []
        self.done: list[tuple] = []

    def add(self, id: int | None, ids: np.ndarray) -> None:
        at = 0
        while at < len(ids):
            take = min(self.length - self.used, len(ids) - at)
            self.open.append((id, at, ids[at : at + take], len(ids)))
            self.used += take
            at += take
            if self.used == self.length:
                self._close(self.open)
                self.open, self.used = [], 0

    def _close(self, pieces: list[tuple]) -> None:
        offset = 0
        for id, start, ids, total in pieces:
            crc = zlib.crc32(ids.astype("<u4").tobytes())
            self.done.append((id, start, len(ids), crc, total, self.next, offset))
            offset += len(ids)
        self.next += 1

    def finish(self) -> None:
        """Sequences of a power of two need no padding, so what is left, fewer tokens
        than a sequence holds, goes into such ones, the largest first."""
        rest, self.open = self.open, []
        while rest:
            room = 1 << (sum(len(piece[2]) for piece in rest).bit_length() - 1)
            taken = []
            while room:
                id, start, ids, total = rest.pop(0)
                taken.append((id, start, ids[:room], total))
                if len(ids) > room:
                    rest.insert(0, (id, start + room, ids[room:], total))
                room -= len(taken[-1][2])
            self._close(taken)


PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
    "sequence_id long, offset long"
)


def _pieces(
    batches: Iterator[pa.RecordBatch], width: str, length: int
) -> Iterator[pa.RecordBatch]:
    packer = _Packer(length, TaskContext.get().partitionId() << 40)

    def ready() -> pa.RecordBatch:
        columns = zip(*packer.done, strict=True) if packer.done else [[]] * 7
        names = [column.split()[0] for column in PIECES.split(", ")]
        arrays = [pa.array(column, pa.int64()) for column in columns]
        packer.done = []
        return pa.RecordBatch.from_arrays(arrays, names)

    for batch in batches:
        for id, ids in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            packer.add(id, np.frombuffer(ids.as_buffer(), width))
        if len(packer.done) > 4096:
            yield ready()
    packer.finish()
    yield ready()


def pack(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    length: int = 1024,
    end: int = 0,
    path: str | None = None,
) -> DataFrame:
    """One row per piece: ``doc_id``, ``start`` and ``length`` in its document's ids,
    ``ids_crc32``, ``doc_tokens``, ``sequence_id`` and ``offset``.

    Documents are tokenized once and stored, sorted by range of their Hilbert key, and
    cut as they come, so each sequence but a range's last is full; those last ones are
    powers of two. Ranges are split by key and id, so copies that share a key spread
    over tasks. Null text counts as empty and has its end id only; null ids come first
    among equal keys; repeated rows are packed once each; an empty table gives no rows.
    A task holds one batch and one open sequence.
    """
    path = path or bpe.default_path()
    spark = docs.sparkSession
    tokens = stored(placed_tokens(docs, id, text, path, end), "tokens")
    ordered = tokens.repartitionByRange(partitions(spark), "key", "id").sortWithinPartitions(
        "key", "id", "ids"
    )
    width = bpe.width(path)
    return ordered.select("id", "ids").mapInArrow(
        partial(_pieces, width=width, length=length), PIECES
    )
