"""BPE encoding with reuse of content-defined chunks, repaired where they join."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adlake.llm import bpe
from adlake.llm.common import ship, small_batches

#: A cut is made where the low bits of the rolling hash are zero: every 2**BITS bytes
#: on average, and never before LEAST bytes.
BITS = 10
LEAST = 128

#: Characters of encoded chunks that a worker keeps for other documents.
KEPT = 16 << 20

_GEAR = np.random.default_rng(17).integers(0, 1 << 32, 256, dtype=np.uint32)


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks of ``data``, each between two UTF-8 characters.

    The rolling hash at a byte sums the 16 bytes up to it, each shifted by its
    distance; it is built by doubling the window, so a text costs a few passes.
    """
    if len(data) <= LEAST:
        return [len(data)] if data else []
    raw = np.frombuffer(data, np.uint8)
    rolled = _GEAR[raw]
    for step in (1, 2, 4, 8):
        rolled[step:] = rolled[step:] + (rolled[:-step] << np.uint32(step))
    ends, last = [], 0
    for at in (np.flatnonzero((rolled >> np.uint32(6)) & np.uint32((1 << BITS) - 1) == 0) + 1).tolist():
        while at < len(data) and raw[at] & 0xC0 == 0x80:
            at += 1
        if at - last >= LEAST and at < len(data):
            ends.append(at)
            last = at
    return [*ends, len(data)]


#: Units at either end of a chunk that are kept one by one.
EDGE = 2


class Chunk:
    """A chunk encoded by itself: its ids, and units one by one only near its ends.

    A chunk of few units is kept as ``head`` alone.
    """

    __slots__ = ("head", "head_ids", "middle", "tail", "tail_ids", "size")

    def __init__(self, text: str, encoder: bpe.Encoder):
        units, ids = encoder.parts(text)
        self.size = len(text)
        self.head, self.head_ids, self.middle = units, ids, b""
        self.tail, self.tail_ids = [], []
        if len(units) > 2 * EDGE:
            self.head, self.head_ids = units[:EDGE], ids[:EDGE]
            self.middle = b"".join(ids[EDGE:-EDGE])
            self.tail, self.tail_ids = units[-EDGE:], ids[-EDGE:]


class ChunkEncoder:
    """Encodes documents chunk by chunk; a chunk met before is not encoded again."""

    def __init__(self, encoder: bpe.Encoder):
        self.encoder = encoder
        self.known: dict[bytes, Chunk] = {}
        self.size = 0
        self.reused = self.made = 0

    def _chunk(self, data: bytes) -> Chunk:
        key = hashlib.blake2b(data, digest_size=16).digest()
        chunk = self.known.get(key)
        if chunk is None:
            chunk = Chunk(data.decode(), self.encoder)
            self.made += 1
            if self.size > KEPT:
                self.known, self.size = {}, 0
            self.known[key] = chunk
            self.size += chunk.size
        else:
            self.reused += 1
        return chunk

    def encode(self, text: str) -> bytes:
        """Ids of a whole text.

        At every join the units on both sides are encoded anew as one window, which must
        begin with the ids that its first unit had and end with those that its last unit
        had: units are cut where no token can cross, so beyond them both sides stand. A
        window that takes in a whole side needs no agreement there. Where a window
        disagrees the text is encoded as a whole.
        """
        data = text.encode()
        done: list[bytes] = []
        units: list[str] = []  # the last units, whose ids aren't in ``done`` yet
        ids: list[bytes] = []
        start = 0
        for end in cuts(data):
            chunk = self._chunk(data[start:end])
            if start:
                window = " ".join(units) + " ".join(chunk.head)
                again, made = self.encoder.parts(" " + window if done else window)
                if done:  # the space that stands before a unit belongs to its ids
                    del again[0], made[0]
                    if again[0] != units[0] or made[0] != ids[0]:
                        return self.encoder.encode(text)
                if chunk.tail and (again[-1] != chunk.head[-1] or made[-1] != chunk.head_ids[-1]):
                    return self.encoder.encode(text)
            else:
                again, made = list(chunk.head), list(chunk.head_ids)
            if chunk.tail:
                done += made
                done.append(chunk.middle)
                units, ids = list(chunk.tail), list(chunk.tail_ids)
            else:
                keep = max(0, len(again) - EDGE)
                done += made[:keep]
                units, ids = again[keep:], made[keep:]
            start = end
        return b"".join(done + ids)


@lru_cache(maxsize=2)
def chunk_encoder(path: str) -> ChunkEncoder:
    """The worker's encoder; its chunks outlive a task."""
    return ChunkEncoder(bpe.encoder(path))


def _encode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    encoder = chunk_encoder(path)
    for batch in small_batches(batches, 1):
        ids = [encoder.encode(text or "") for text in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], ["id", "ids"])


def encode(docs: DataFrame, id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """``id`` and ``ids`` (little-endian, 16 bits where the vocabulary fits) of every row.

    Null text counts as empty and has no ids; null ids and repeated rows are kept; an
    empty table gives no rows; the work on a text is linear in its length. Nothing is
    shuffled: sharing chunks over tasks would move every text and all ids once more,
    which costs more than it saves, so each worker keeps the chunks it has met.
    """
    path = path or bpe.default_path()
    ship(docs.sparkSession)
    picked = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    return picked.mapInArrow(partial(_encode, path=path), "id long, ids binary")


def _decode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    encoder = bpe.encoder(path)
    for batch in small_batches(batches, 1):
        texts = [
            encoder.decode(np.frombuffer(data, encoder.dtype)) for data in batch.column(1).to_pylist()
        ]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "text"])


def decode(tokens: DataFrame, path: str | None = None) -> DataFrame:
    """``id`` and ``text`` for ``id`` and ``ids`` as :func:`encode` gives them."""
    path = path or bpe.default_path()
    ship(tokens.sparkSession)
    return tokens.select("id", "ids").mapInArrow(partial(_decode, path=path), "id long, text string")


def _digests(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    encoder = bpe.encoder(path)
    written = [str(i) for i in range(len(encoder.bytes_of))]
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    for batch in small_batches(batches, 1):
        rows = []
        for data in batch.column(1).to_pylist():
            ids = np.frombuffer(data, encoder.dtype)
            decimal = ",".join([written[i] for i in ids.tolist()])
            rows.append(
                (
                    len(ids),
                    hashlib.sha256(decimal.encode()).hexdigest(),
                    hashlib.sha256(encoder.decode(ids).encode()).hexdigest(),
                )
            )
        columns = zip(*rows, strict=True) if rows else [()] * 3
        kinds = (pa.int64(), pa.string(), pa.string())
        arrays = [pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names)


def digests(tokens: DataFrame, path: str | None = None) -> DataFrame:
    """Count and digests of the ids, and of what they decode to."""
    path = path or bpe.default_path()
    ship(tokens.sparkSession)
    return tokens.select("id", "ids").mapInArrow(
        partial(_digests, path=path),
        "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string",
    )
