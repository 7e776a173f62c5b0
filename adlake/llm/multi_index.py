"""Approximate nearest neighbours by multi-index hashing of learned binary codes.

Vectors are rotated so that their signs lose least (iterative quantization, fitted on a
bounded sample) and become binary codes. A code is cut into substrings, each with an
index of its own. Codes within Hamming radius ``r`` of a query agree with it on one of
``m`` substrings up to ``r // m`` bits, so probing those neighbourhoods finds all of
them; what they hold is compared as whole codes, and what is within the radius is
ranked by cosine of the original vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from adlake.llm.common import partitions, ship, stored

#: Bits of a code and of a substring; a substring indexes up to 65,536 buckets.
BITS = 256
PART = 16

#: Vectors the rotations and the radius are fitted on, a bounded sample by hash: up to
#: twice as many.
SAMPLE = 4096

#: Share of the sample's nearest neighbours that must lie within the radius.
COVERED = 0.98

#: Vectors indexed and queries searched in one task.
SHARD = 1 << 14
QUERIES = 1 << 12


@dataclass(frozen=True)
class Codebook:
    """Directions whose signs make the code, and the radius that neighbours lie in."""

    directions: np.ndarray
    radius: int

    def codes(self, vectors: np.ndarray) -> np.ndarray:
        """One row of 64-bit words per vector."""
        bits = vectors @ self.directions > 0
        return np.packbits(bits, axis=1, bitorder="little").view("<u8")


def fit(sample: np.ndarray, k: int) -> Codebook:
    """Learn rotations, one after another until all bits are used, and the radius."""
    rng = np.random.default_rng(13)
    unit = sample / np.linalg.norm(sample, axis=1)[:, None]
    size = min(unit.shape[1], BITS)
    _, _, axes = np.linalg.svd(unit, full_matrices=False)
    axes = axes[:size].T
    low = unit @ axes
    columns: list[np.ndarray] = []
    while sum(c.shape[1] for c in columns) < BITS:
        turn, _ = np.linalg.qr(rng.standard_normal((low.shape[1], low.shape[1])))
        for _ in range(30):
            left, _, right = np.linalg.svd(np.where(low @ turn > 0, 1.0, -1.0).T @ low)
            turn = (left @ right).T
        columns.append(axes @ turn)
    book = Codebook(np.hstack(columns)[:, :BITS], 0)
    codes = book.codes(unit)
    seen = []
    for i in range(0, len(unit), max(1, len(unit) // 512)):
        near = unit @ unit[i]
        near[i] = -np.inf
        best = np.argsort(-near, kind="stable")[: min(k, len(unit) - 1)]
        seen += np.bitwise_count(codes[best] ^ codes[i]).sum(1).tolist()
    radius = int(np.quantile(seen, COVERED)) if seen else BITS
    return Codebook(book.directions, radius)


class Shard:
    """Indexed codes: for each substring its distinct values and the rows of each."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        parts = np.ascontiguousarray(codes).view("<u2").reshape(len(codes), -1)
        self.index = []
        for column in parts.T:
            values, rows = np.unique(column, return_inverse=True)
            self.index.append((values, rows))

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows within ``radius`` bits of ``code``, by probing every substring."""
        reach, more = divmod(radius, len(self.index))
        hit = np.zeros(len(self.codes), bool)
        for i, ((values, rows), part) in enumerate(
            zip(self.index, code.view("<u2"), strict=True)
        ):
            # Were the first ``more + 1`` parts apart by over ``reach`` bits and the
            # others by ``reach`` or more, the codes would differ in over ``radius``.
            near = np.bitwise_count(values ^ part) <= reach - (i > more)
            if near.any():
                hit |= near[rows]
        found = np.flatnonzero(hit)
        apart = np.bitwise_count(self.codes[found] ^ code).sum(1)
        return found[apart <= radius]


def _codes(batches: Iterator[pa.RecordBatch], book: Codebook) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        vectors = np.stack([np.asarray(v, np.float64) for v in batch.column(1).to_pylist()])
        codes = book.codes(vectors)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array([row.tobytes() for row in vectors], pa.binary()),
                pa.array([row.tobytes() for row in codes], pa.binary()),
            ],
            ["id", "vector", "code"],
        )


def _matrix(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    data = column.to_pylist()
    return np.frombuffer(b"".join(data), kind).reshape(len(data), -1)


def _search(cell: pa.Table, radius: int, k: int) -> pa.Table:
    """The ``k`` best rows of a shard for each of a block of queries."""
    asked = cell.filter(cell.column("asks"))
    held = cell.filter(pa.compute.invert(cell.column("asks")))
    rows: list[tuple] = []
    if asked.num_rows and held.num_rows:
        ids = held.column("id").to_numpy()
        vectors = _matrix(held.column("vector"), "<f8")
        lengths = np.sqrt((vectors * vectors).sum(1))
        shard = Shard(_matrix(held.column("code"), "<u8"))
        asking = _matrix(asked.column("vector"), "<f8")
        codes = _matrix(asked.column("code"), "<u8")
        for query, vector, code in zip(asked.column("id").to_pylist(), asking, codes, strict=True):
            reach = radius
            others = len(ids) - int((ids == query).sum())
            while True:
                found = shard.within(code, min(reach, BITS))
                found = found[ids[found] != query]
                if len(found) >= min(k, others):
                    break
                reach = reach + reach // 4 + 8
            score = (vectors[found] * vector).sum(1) / (lengths[found] * np.sqrt((vector * vector).sum()))
            best = np.lexsort((ids[found], -score))[:k]
            rows += [(query, int(ids[found[i]]), float(score[i])) for i in best]
    columns = zip(*rows, strict=True) if rows else [()] * 3
    kinds = (pa.int64(), pa.int64(), pa.float64())
    arrays = [pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)]
    return pa.table(arrays, names=["query_id", "vec_id", "score"])


def usable(table: DataFrame, id: str, vector: str) -> DataFrame:
    """``id`` and ``vector`` of rows that have both, with finite components, not all zero."""
    at = F.col(vector)
    sound = F.forall(
        at, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))
    )
    return table.where(
        F.col(id).isNotNull() & at.isNotNull() & sound & F.exists(at, lambda x: x != 0)
    ).select(F.col(id).cast("long").alias("id"), at.cast("array<double>").alias("vector"))


def nearest(
    table: DataFrame,
    queries: DataFrame,
    id: str = "vec_id",
    vector: str = "embedding",
    k: int = 5,
) -> DataFrame:
    """``query_id``, ``rank`` from 1, ``vec_id`` and ``score``, the cosine, of the ``k``
    nearest rows of ``table`` found for every row of ``queries``.

    Rows without id or vector, with null or non-finite components, or zero vectors take
    no part, nor do vectors of another length than the most frequent one. Ties go to
    the smaller id. A row with the query's id is no candidate; rows repeated under
    other ids are. Where a shard has fewer than ``k`` rows within the radius its radius
    widens, so every query gets ``k`` rows if there are as many. An empty table gives no
    rows. Shards are dealt by hash of the id, so no cluster of vectors fills one of
    them; a task holds one shard and one block of queries.
    """
    spark = table.sparkSession
    ship(spark)
    rows, asked = usable(table, id, vector), usable(queries, id, vector)
    lengths = rows.groupBy(F.size("vector").alias("size")).count()
    length = lengths.orderBy(F.desc("count"), "size").first()
    out = "query_id long, vec_id long, score double"
    if length is None:
        return spark.createDataFrame([], out).selectExpr("query_id", "0 AS rank", "vec_id", "score")
    fits = F.size("vector") == length["size"]
    rows, asked, total = rows.where(fits), asked.where(fits), length["count"]
    # One in so many by hash, so that tasks send no more than their share of the sample.
    drawn = F.pmod(F.xxhash64("id", F.lit(3)), F.lit(max(1, total // SAMPLE))) == 0
    sample = rows.where(drawn).orderBy("id").select("vector").collect()
    book = fit(np.array([row["vector"] for row in sample], np.float64), k)
    coded = partial(_codes, book=book)
    schema = "id long, vector binary, code binary"
    indexed = stored(rows.mapInArrow(coded, schema), "codes")
    asking = stored(asked.mapInArrow(coded, schema), "queries")
    # Each shard meets each block of queries in one cell: a stated query set against all
    # rows, in blocks of bounded size.
    shards = max(-(-total // SHARD), min(partitions(spark), -(-total // 512)))
    blocks = max(1, -(-asking.count() // QUERIES))
    of = lambda n: F.pmod(F.xxhash64("id"), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    cells = indexed.select(
        of(shards).alias("shard"), every(blocks).alias("block"), F.lit(False).alias("asks"), "*"
    ).unionByName(
        asking.select(
            every(shards).alias("shard"), of(blocks).alias("block"), F.lit(True).alias("asks"), "*"
        )
    )
    radius = book.radius

    def search(cell: pa.Table) -> pa.Table:
        return _search(cell, radius, k)

    found = cells.groupBy("shard", "block").applyInArrow(search, out)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
