"""Hard negatives by segment summaries.

A vector is cut into segments, and of each its mean and deviation are stored. Over a
segment of length ``s`` the inner product of two vectors is ``s`` times the product of
their means plus that of what is left of them, which is no more than ``s`` times the
product of their deviations. So a whole score lies between bounds that cost two numbers a
segment. Segments are halved from level to level; a row whose bounds rule it out on a
coarse level is not looked at on the next. On the finest, more and more segments are
taken component by component, until the rows that are left are scored. What a row must
reach is known from the most promising rows of each step, which are scored at once.

Components are scaled and rounded down to integers, so scores are exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from adlake.llm.common import partitions, ship, stored

#: Lengths of a segment on the levels, coarse to fine, as far as vectors are longer.
LEVELS = (16, 4, 2)

#: Shares of the finest segments that are then taken exactly, step by step.
SHARES = (0.5, 0.75)

#: Rows scored at once in each step, as a multiple of the rows asked for.
SEEDS = 4

#: Scores beyond it count as it, so that a hundredfold score is still 64 bits long.
MOST = 1 << 56

#: Vectors and anchors searched in one task.
SHARD = 1 << 14
ANCHORS = 1 << 11

INDEXED = "size int, id long, label string, vector binary, summary binary"
POSITIVES = "anchor_id long, positive_id long, positive_score long"
NEGATIVES = "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"


def bounds_of(size: int) -> list[np.ndarray]:
    """Where the segments of each level begin and end, for vectors of ``size``."""
    levels = [np.unique([*range(0, size, length), size]) for length in LEVELS if length < size]
    return levels or [np.array([0, size])]


def summarize(vectors: np.ndarray) -> np.ndarray:
    """Means and deviations of all segments of all levels, one row per vector, each times
    the root of its segment's length, so that products of rows are sums over segments."""
    columns = []
    for edges in bounds_of(vectors.shape[1]):
        lengths = np.diff(edges)
        means = np.add.reduceat(vectors, edges[:-1], axis=1) / lengths
        rest = vectors - np.repeat(means, lengths, axis=1)
        columns += [means * np.sqrt(lengths), np.sqrt(np.add.reduceat(rest * rest, edges[:-1], axis=1))]
    return np.hstack(columns)


def quantize(vectors: np.ndarray, scale: float) -> np.ndarray:
    """``floor(scale * x)``, at most 2**1000 either way."""
    with np.errstate(over="ignore"):
        return np.floor(np.clip(vectors * scale, -(2.0**1000), 2.0**1000))


def exact_below(size: int) -> float:
    """Components up to this one have scores that doubles hold exactly."""
    return math.isqrt((1 << 53) // max(1, size))


class Shard:
    """Rows with their summaries, sorted by label."""

    def __init__(self, rows: pa.Table, size: int):
        ids, labels = rows.column("id").to_numpy(), np.array(rows.column("label").to_pylist(), object)
        data = rows.column("vector").to_pylist()
        # Rows of one id: the first by label and vector.
        order = sorted(range(len(ids)), key=lambda i: (labels[i], ids[i], data[i]))
        seen: dict[int, int] = {}
        for i in sorted(range(len(ids)), key=lambda i: (ids[i], labels[i], data[i])):
            seen.setdefault(int(ids[i]), i)
        keep = set(seen.values())
        order = [i for i in order if i in keep]
        self.ids, self.labels = ids[order], labels[order]
        self.vectors = np.frombuffer(b"".join(data[i] for i in order), "<f8").reshape(len(order), size)
        summary = rows.column("summary").to_pylist()
        summaries = np.frombuffer(b"".join(summary[i] for i in order), "<f8").reshape(len(order), -1)
        self.levels = []
        self.steps = []
        at = 0
        for edges in bounds_of(size):
            count = len(edges) - 1
            self.steps.append((len(self.levels), 0, 0))
            self.levels.append((summaries[:, at : at + count], summaries[:, at + count : at + 2 * count]))
            at += 2 * count
        self.steps += [
            (len(self.levels) - 1, int(share * count), int(edges[int(share * count)])) for share in SHARES
        ]
        self.large = np.abs(self.vectors).max(1, initial=0) > exact_below(size)
        self.lengths = np.sqrt(sum((part * part).sum(1) for part in self.levels[-1]))
        starts = np.flatnonzero(np.r_[True, self.labels[1:] != self.labels[:-1]]) if len(order) else []
        self.spans = {
            self.labels[a]: (int(a), int(b)) for a, b in zip(starts, [*starts[1:], len(order)], strict=True)
        }
        #: Rows looked at in each step, and scored.
        self.looked = np.zeros(len(self.steps) + 1, np.int64)

    def bounds(self, asks: Shard, query: int, rows: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
        """Between which the scores of ``rows`` with a query lie, rounding included."""
        level, after, head = self.steps[step]
        (means, rest), (mean, deviation) = self.levels[level], (part[query] for part in asks.levels[level])
        self.looked[step] += len(rows)
        with np.errstate(all="ignore"):
            middle = means[rows, after:] @ mean[after:] + self.vectors[rows, :head] @ asks.vectors[query, :head]
            reach = rest[rows, after:] @ deviation[after:]
            reach += 1e-9 * (1 + self.lengths[rows] * asks.lengths[query])
            low, high = middle - reach, middle + reach
        # What doubles can't tell exactly is never ruled out.
        wild = self.large[rows] | asks.large[query] | ~np.isfinite(low) | ~np.isfinite(high)
        low[wild], high[wild] = -np.inf, np.inf
        return low, high

    def scores(self, asks: Shard, query: int, rows: np.ndarray) -> np.ndarray:
        self.looked[-1] += len(rows)
        with np.errstate(all="ignore"):
            found = self.vectors[rows] @ asks.vectors[query]
        hard = self.large[rows] | asks.large[query]
        found[hard] = 0
        scores = found.astype(np.int64)
        if hard.any():
            whole = [int(x) for x in asks.vectors[query]]
            for i in np.flatnonzero(hard):
                score = sum(int(x) * y for x, y in zip(self.vectors[rows[i]], whole, strict=True))
                scores[i] = max(-MOST, min(MOST, score))
        return np.clip(scores, -MOST, MOST)


class Found:
    """The rows of a shard that one query has been scored with."""

    def __init__(self, shard: Shard, asks: Shard, query: int):
        self.shard, self.asks, self.query = shard, asks, query
        self.rows, self.scores = np.empty(0, np.int64), np.empty(0, np.int64)

    def score(self, rows: np.ndarray) -> None:
        rows = np.setdiff1d(rows, self.rows)
        self.scores = np.r_[self.scores, self.shard.scores(self.asks, self.query, rows)]
        self.rows = np.r_[self.rows, rows]

    def score_likeliest(self, rows: np.ndarray, low: np.ndarray, high: np.ndarray, most: int) -> None:
        """Score those rows whose bounds lie highest, by their middle."""
        if len(rows) > most:
            with np.errstate(invalid="ignore"):
                middle = np.nan_to_num(low + high, nan=-np.inf)
            rows = rows[np.argpartition(middle, len(rows) - most)[len(rows) - most :]]
        self.score(rows)

    def best(self, k: int, low: float = -np.inf, high: float = np.inf) -> list[tuple[int, int]]:
        """``(id, score)`` of the ``k`` best of the scored rows between two scores."""
        fits = np.flatnonzero((self.scores >= low) & (self.scores <= high))
        ids = self.shard.ids[self.rows[fits]]
        first = np.lexsort((ids, -self.scores[fits]))[:k]
        return [(int(ids[i]), int(self.scores[fits[i]])) for i in first]


def _positives(shard: Shard, asks: Shard, k: int) -> pa.Table:
    """Per anchor the ``k`` best other rows of its label in a shard."""
    out: list[tuple] = []
    for query, (anchor, label) in enumerate(zip(asks.ids.tolist(), asks.labels, strict=True)):
        rows = np.arange(*shard.spans.get(label, (0, 0)))
        rows = rows[shard.ids[rows] != anchor]
        found = Found(shard, asks, query)
        for step in range(len(shard.steps)):
            if len(rows) <= k:
                break
            low, high = shard.bounds(asks, query, rows, step)
            found.score_likeliest(rows, low, high, SEEDS * k)
            rows = rows[high >= found.best(k)[-1][1]]
        found.score(rows)
        out += [(anchor, *row) for row in found.best(k)]
    return _table(out, ("anchor_id", "positive_id", "positive_score"))


def _negatives(
    shard: Shard, asks: Shard, wanted: dict[int, list[tuple[int, int]]], k: int, share: int
) -> pa.Table:
    """Per anchor and positive the ``k`` best rows of other labels in a shard that score
    between ``share`` percent of the positive's score and that score."""
    out: list[tuple] = []
    for query, (anchor, label) in enumerate(zip(asks.ids.tolist(), asks.labels, strict=True)):
        bands = wanted.get(anchor, [])
        first, last = shard.spans.get(label, (0, 0))
        rows = np.r_[np.arange(first), np.arange(last, len(shard.ids))]
        rows = rows[shard.ids[rows] != anchor]
        found = Found(shard, asks, query)
        # The least whole score in a band; scores are at most 2**56, so these are exact.
        floors = {score: -(-share * score // 100) for _, score in bands}
        for step in range(len(shard.steps)):
            if len(rows) <= k:
                break
            low, high = shard.bounds(asks, query, rows, step)
            found.score_likeliest(rows, low, high, SEEDS * k)
            useful = np.zeros(len(rows), bool)
            for score, floor in floors.items():
                best = found.best(k, floor, score)
                least = best[-1][1] if len(best) == k else floor
                useful |= (high >= least) & (low <= score)
            rows = rows[useful]
        found.score(rows)
        for positive, score in bands:
            out += [(anchor, positive, score, *row) for row in found.best(k, floors[score], score)]
    return _table(out, ("anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"))


def _table(rows: list[tuple], names: tuple[str, ...]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.table([pa.array(c, pa.int64()) for c in columns], names=list(names))


def _index(batches: Iterator[pa.RecordBatch], scale: float) -> Iterator[pa.RecordBatch]:
    """Vectors as integers, with the means and deviations of their segments."""
    for batch in batches:
        sizes = np.array(pa.compute.list_value_length(batch.column(2)).to_pylist(), np.int64)
        for size in np.unique(sizes).tolist():
            some = batch.filter(pa.array(sizes == size))
            vectors = quantize(np.array(some.column(2).to_pylist(), np.float64).reshape(-1, size), scale)
            with np.errstate(all="ignore"):
                summaries = summarize(vectors) if size else np.zeros((len(vectors), 2))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(vectors), size), pa.int32()),
                    some.column(0),
                    some.column(1),
                    pa.array([row.tobytes() for row in vectors], pa.binary()),
                    pa.array([row.tobytes() for row in summaries], pa.binary()),
                ],
                ["size", "id", "label", "vector", "summary"],
            )


def usable(table: DataFrame, id: str, vector: str, label: str) -> DataFrame:
    """``id``, ``label`` and ``vector`` of rows that have all three, with components that
    are all finite."""
    at = F.col(vector)
    sound = F.forall(
        at, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))
    )
    return table.where(F.col(id).isNotNull() & F.col(label).isNotNull() & at.isNotNull() & (F.size(at) > 0) & sound).select(
        F.col(id).cast("long").alias("id"),
        F.col(label).cast("string").alias("label"),
        at.cast("array<double>").alias("vector"),
    )


def _cells(indexed: DataFrame, asking: DataFrame, asked: int) -> DataFrame:
    """Every shard of rows with every block of anchors of the same vector size: a stated
    query set against all rows, in blocks of bounded size."""
    spark = indexed.sparkSession
    total = indexed.count()
    shards = max(1, -(-total // SHARD), min(partitions(spark), -(-total // 512)))
    blocks = max(1, -(-asked // ANCHORS))
    of = lambda n: F.pmod(F.xxhash64("id"), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    none = F.lit(None).cast("array<struct<positive_score:bigint,positive_id:bigint>>")
    held = indexed.select(of(shards).alias("shard"), every(blocks).alias("block"), F.lit(False).alias("asks"), "*")
    asks = asking.select(every(shards).alias("shard"), of(blocks).alias("block"), F.lit(True).alias("asks"), "*")
    if "bands" not in asking.columns:
        asks = asks.withColumn("bands", none)
    return held.withColumn("bands", none).unionByName(asks).groupBy("size", "shard", "block")


def _parts(cell: pa.Table) -> tuple[Shard, Shard, pa.Table]:
    size = cell.column("size")[0].as_py()
    asks = cell.column("asks")
    asked = cell.filter(asks)
    return Shard(cell.filter(pa.compute.invert(asks)), size), Shard(asked, size), asked


def hard_negatives(
    table: DataFrame,
    anchors: DataFrame,
    id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    positives: int = 5,
    negatives: int = 5,
    share: int = 80,
    scale: float = 256.0,
) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank`` from 1, ``negative_id``, ``positive_score``
    and ``negative_score``: for every anchor and each of its first ``positives`` other
    rows of its label, the first ``negatives`` rows of other labels that score no more
    than the positive and at least ``share`` percent of that.

    A score is the inner product of vectors whose components are ``floor(scale * x)``;
    higher ones come first, ties go to the smaller id. Rows without id, label or vector,
    or with no, null or non-finite components, take no part. Rows of one id count once, the
    first by label and vector. Vectors of different lengths have no score. Scores beyond
    2**56 count as 2**56 either way. An empty table gives no rows, as does an anchor
    without positives or a positive without negatives. Rows are dealt into shards by hash
    of the id, so no label fills one.
    """
    spark = table.sparkSession
    ship(spark)
    index = partial(_index, scale=scale)
    indexed = stored(usable(table, id, vector, label).mapInArrow(index, INDEXED), "segments")
    asking = stored(usable(anchors, id, vector, label).mapInArrow(index, INDEXED), "anchors")
    asked = asking.count()

    def nearest(cell: pa.Table) -> pa.Table:
        shard, asks, _ = _parts(cell)
        return _positives(shard, asks, positives)

    def mined(cell: pa.Table) -> pa.Table:
        shard, asks, rows = _parts(cell)
        bands = zip(rows.column("id").to_pylist(), rows.column("bands").to_pylist(), strict=True)
        wanted = {anchor: [(b["positive_id"], b["positive_score"]) for b in found] for anchor, found in bands}
        return _negatives(shard, asks, wanted, negatives, share)

    found = _cells(indexed, asking, asked).applyInArrow(nearest, POSITIVES).distinct()
    best = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    # At most ``positives`` rows an anchor are gathered here.
    bands = (
        found.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= positives)
        .groupBy(F.col("anchor_id").alias("id"))
        .agg(F.collect_list(F.struct("positive_score", "positive_id")).alias("bands"))
    )
    ready = stored(asking.join(bands, "id").select(*asking.columns, "bands"), "bands")
    best = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    return (
        _cells(indexed, ready, asked)
        .applyInArrow(mined, NEGATIVES)
        .distinct()
        .withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= negatives)
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    )
