"""Set-similarity join of n-gram sets by universe partition and pigeonhole.

Two sets of Jaccard similarity ``t`` or more differ in at most ``h = (1 - t) / (1 + t) *
(|a| + |b|)`` members. Hashing members into ``h + 1`` segments puts all of these
differences into ``h`` of them, so the sets agree in at least one: it is enough to look
among sets that share the members of one segment. ``h`` depends on sizes, so sets are put
into bands of sizes, of which only neighbouring ones can be alike, and there is one
partition for every two neighbours.

Two segments may also be taken together, for sets that differ in at most one member of
their union: if no single segment were equal and every union had two differences, there
would be ``h + 1`` of them again. Unions need an entry for every member left out, but are
far more selective. Which is cheaper depends on how many sets share a segment without
being alike, and that is counted: after one round over single segments, those that still
hold unlinked pairs are ranked, and two by two get the entries of their union if these
are fewer than the members to be compared.

In the first round each set is compared with the smallest of those it shares a segment
with. What that leaves unlinked is compared pair by pair, but only across the components
found so far, and where many sets share a segment they are first held against each other
by sketches, in parts of bounded size: the bits of a sketch are the parities of members
by hash, so two sets differ in as many members as their sketches in bits, or more. Of the
pairs that stand this, those that would connect components are compared word by word, and
in the end all that still lie across components. Copies are one set.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from adlake.llm.common import ship, small_batches, stored
from adlake.llm.components import connected_components

#: Ids that may be broadcast, of 8 bytes each; beyond, tables are joined by shuffle.
BROADCAST = 1 << 20

#: What an entry that leaves out a member costs, and two sets held against each other by
#: their sketches, in members of sets read: an entry is written, shuffled twice and
#: grouped; a pair of sketches is 32 words of 64 bits compared in bulk.
ENTRY = 4
COMPARISON = 4

#: Bits of a sketch.
BITS = 2048

#: Sets that share a key and are joined pair by pair; more are compared by sketches, in
#: parts of so many sets, and pairs of them held in memory at a time.
FEW = 16
PART = 4096
PAIRS = 1 << 20

MARKED = "id long, n long, low long, high long, band int, keys array<long>, sketch binary"

_MIX = np.uint64(0x9E3779B97F4A7C15)
_MORE = np.uint64(0xBF58476D1CE4E5B9)


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit numbers to 64-bit numbers, one to one and without a pattern."""
    x = x * _MIX
    x = (x ^ (x >> np.uint64(29))) * _MORE
    return x ^ (x >> np.uint64(32))


def words_of(text: str | None) -> list[bytes]:
    """The words of a text, with A-Z as a-z."""
    return (text or "").encode().lower().split()


def members(text: str | None, size: int) -> np.ndarray:
    """The distinct ``size``-word shingles as sorted 64-bit numbers; fewer words make one."""
    words = words_of(text)
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), len(words))], np.uint64)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    count = len(words) - size + 1
    shingle = np.zeros(count, np.uint64)
    for k in range(size):
        shingle = shingle * _MORE + hashes[k : k + count]
    return np.unique(mixed(shingle))


class Bands:
    """Sizes from ``edges[b]`` up to ``edges[b + 1]`` are band ``b``. A set and one that is
    alike lie in one band or in neighbouring ones."""

    def __init__(self, part: int, whole: int):
        self.part, self.whole = part, whole
        self.edges = [1]

    def of(self, size: int) -> int:
        while self.edges[-1] <= size:
            self.edges.append(self.edges[-1] * self.whole // self.part + 1)
        return int(np.searchsorted(self.edges, size, "right")) - 1

    def differences(self, band: int) -> int:
        """Most members in which like sets of this band, and of the next, differ."""
        while len(self.edges) < band + 2:
            self.edges.append(self.edges[-1] * self.whole // self.part + 1)
        small = self.edges[band + 1] - 1
        both = small + small * self.whole // self.part
        return (self.whole - self.part) * both // (self.whole + self.part)

    def segments(self, band: int) -> int:
        """Segments of the partition for this band and the next; equal sets need none."""
        most = self.differences(band)
        return most + 1 if most else 0


def _segment(own: np.ndarray, count: int) -> np.ndarray:
    """Equal ranges of numbers, so that sorted members are in the order of segments."""
    return ((own >> np.uint64(32)) * np.uint64(count) >> np.uint64(32)).astype(np.int64)


def _name(sums: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Keys of subsets, each given by the sum of its members, in numbered places."""
    return mixed(sums ^ mixed(place.astype(np.uint64) + np.uint64(1))).view(np.int64)


def segment_keys(own: np.ndarray, band: int, bands: Bands) -> np.ndarray:
    """A key for the subset of ``own`` in each segment of the partition of ``band``."""
    count = bands.segments(band)
    if not count:
        return np.empty(0, np.int64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(own))])
    edges = np.searchsorted(_segment(own, count), np.arange(count + 1))
    places = (np.int64(band) << 32) + np.arange(count)
    return _name(sums[edges[1:]] - sums[edges[:-1]], places)


def deletion_keys(own: np.ndarray, band: int, first: int, second: int, bands: Bands) -> np.ndarray:
    """Keys for what two segments hold together, whole and without each one member.

    Sets that differ there in one member have a key in common, as do those that don't."""
    at = _segment(own, bands.segments(band))
    held = mixed(own[(at == first) | (at == second)])
    whole = held.sum(dtype=np.uint64)
    sums = np.concatenate([whole[None], whole - held])
    return np.unique(_name(sums, np.full(len(sums), (band << 32) + (1 << 31) + first)))


def sketch(own: np.ndarray) -> bytes:
    """Parities of the members by hash."""
    odd = np.bincount((own % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(bool)).tobytes()


def _mark(batches: Iterator[pa.RecordBatch], size: int, part: int, whole: int) -> Iterator[pa.RecordBatch]:
    """Documents with the size and a 128-bit sum of their set, and its segment keys: those
    of its own band first, then those of the band below."""
    bands = Bands(part, whole)
    for batch in small_batches(batches, 1):
        rows: list[tuple] = []
        for text in batch.column(1).to_pylist():
            own = members(text, size)
            if not len(own):
                rows.append((0, 0, 0, -1, [], None))
                continue
            low, high = own.sum(dtype=np.uint64), (own * (own | np.uint64(1))).sum(dtype=np.uint64)
            band = bands.of(len(own))
            keys = segment_keys(own, band, bands)
            if band:
                keys = np.concatenate([keys, segment_keys(own, band - 1, bands)])
            rows.append((len(own), int(low.view(np.int64)), int(high.view(np.int64)), band, keys, sketch(own)))
        columns = list(zip(*rows, strict=True))
        kinds = [pa.int64()] * 3 + [pa.int32(), pa.list_(pa.int64()), pa.binary()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(list(c), kind) for c, kind in zip(columns, kinds, strict=True))],
            ["id", "n", "low", "high", "band", "keys", "sketch"],
        )


def _leave_out(batches: Iterator[pa.RecordBatch], size: int, part: int, whole: int) -> Iterator[pa.RecordBatch]:
    """``key``, ``id`` and ``n`` of documents, for pairs of segments in a band."""
    bands = Bands(part, whole)
    for batch in small_batches(batches, 1, 1 << 20):
        keys, ids, sizes = [], [], []
        for id, text, band, pairs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            own = members(text, size)
            found = [deletion_keys(own, band, p["first"], p["second"], bands) for p in pairs]
            keys += found
            ids += [np.full(len(some), id, np.int64) for some in found]
            sizes += [np.full(len(some), len(own), np.int64) for some in found]
        if keys:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(column)) for column in (keys, ids, sizes)], ["key", "id", "n"]
            )


def _shingles(text: str | None, size: int) -> frozenset[bytes]:
    words = words_of(text)
    if len(words) < size:
        return frozenset([b" ".join(words)] if words else [])
    return frozenset(b" ".join(words[i : i + size]) for i in range(len(words) - size + 1))


def _verify(batches: Iterator[pa.RecordBatch], size: int, part: int, whole: int) -> Iterator[pa.RecordBatch]:
    """The pairs whose sets of shingles are alike, compared word by word."""
    last: tuple[str | None, frozenset] = (None, frozenset())
    for batch in small_batches(batches, 2):
        a, b = [], []
        for one, two, left, right in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if left != last[0]:
                last = (left, _shingles(left, size))
            other = _shingles(right, size)
            shared = len(last[1] & other)
            if shared and whole * shared >= part * (len(last[1]) + len(other) - shared):
                a.append(one)
                b.append(two)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _small(ids: DataFrame) -> DataFrame:
    """A stored table of ids, to be broadcast if they were counted to be few."""
    return F.broadcast(ids) if ids.count() <= BROADCAST else ids


def _alike(pairs: DataFrame, texts: DataFrame, size: int, part: int, whole: int) -> DataFrame:
    """The rows of ``pairs`` (``a``, ``b``) that are links, stored."""
    named = stored(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "asked")
    held = stored(texts.join(_small(named), "id", "left_semi"), "texts")
    both = (
        pairs.join(held.select(F.col("id").alias("b"), F.col("text").alias("right")), "b")
        .join(held.select(F.col("id").alias("a"), F.col("text").alias("left")), "a")
        .select("a", "b", "left", "right")
    )
    check = partial(_verify, size=size, part=part, whole=whole)
    return stored(both.mapInArrow(check, "a long, b long"), "links")


def _labelled(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """``rows`` with ``root``, the smallest id that links lead to so far, stored."""
    return stored(
        rows.join(roots, F.col("id") == F.col("node"), "left")
        .withColumn("root", F.coalesce("root", "id"))
        .drop("node"),
        "labelled",
    )


def _unsettled(rows: DataFrame) -> DataFrame:
    """Keys whose rows (``key``, ``id``, ``root``) lie in several components: ``key``,
    ``total``, ``most`` (the root with the most rows) and ``crossing``, the pairs of rows between
    components."""
    sizes = rows.groupBy("key", "root").agg(F.count(F.lit(1)).alias("rows"))
    per_key = sizes.groupBy("key").agg(
        F.sum("rows").alias("total"),
        F.sum(F.col("rows") * F.col("rows")).alias("within"),
        F.max(F.struct("rows", "root")).alias("most"),
    )
    crossing = ((F.col("total") * F.col("total") - F.col("within")) / 2).cast("long")
    return per_key.select("key", "total", F.col("most.root").alias("most"), crossing.alias("crossing")).where(
        "crossing > 0"
    )


def _across(rows: DataFrame, keys: DataFrame, part: int, whole: int) -> DataFrame:
    """Pairs of rows that share one of ``keys`` and lie in different components, if their
    sizes allow for a link. Rows of a key's largest component only meet others, so the
    work is in proportion to the pairs."""
    few = rows.join(keys.select("key", "most"), "key").where("root <> most")
    few = few.select("key", "most", F.col("id").alias("x"), F.col("n").alias("x_n"), F.col("root").alias("x_root"))
    met = few.join(rows.select("key", "id", "n", "root"), "key").where(
        ((F.col("root") == F.col("most")) | (F.col("x_root") < F.col("root")))
        & (F.least("n", "x_n") * whole >= F.greatest("n", "x_n") * part)
    )
    return met.select(F.least("id", "x").alias("a"), F.greatest("id", "x").alias("b")).distinct()


def _compare(cell: pa.Table, part: int, whole: int, spanning: bool) -> pa.Table:
    """Pairs of a cell that lie in different components and that sketches don't rule out;
    of those that are ``spanning``, only as many as connect what they connect."""
    ids, n = cell.column("id").to_numpy(), cell.column("n").to_numpy()
    roots, root = np.unique(cell.column("root").to_numpy(), return_inverse=True)
    side = cell.column("side").to_numpy()
    words = np.frombuffer(b"".join(cell.column("sketch").to_pylist()), "<u8").reshape(len(ids), -1)
    parent = np.arange(len(roots))

    def top(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    left, right = np.flatnonzero(side & 1), np.flatnonzero(side & 2)
    found: list[tuple[int, int]] = []
    stripe = max(1, PAIRS // max(1, len(right)))
    for at in range(0, len(left), stripe):
        rows = left[at : at + stripe]
        apart = np.zeros((len(rows), len(right)), np.int64)
        for word in range(words.shape[1]):
            apart += np.bitwise_count(words[rows, word][:, None] ^ words[right, word][None, :])
        most = (whole - part) * (n[rows][:, None] + n[right][None, :]) // (whole + part)
        i, j = np.nonzero((apart <= most) & (root[rows][:, None] != root[right][None, :]))
        order = np.argsort(apart[i, j], kind="stable")
        for x, y in zip(rows[i[order]].tolist(), right[j[order]].tolist(), strict=True):
            if spanning:
                a, b = top(root[x]), top(root[y])
                if a == b:
                    continue
                parent[max(a, b)] = min(a, b)
            found.append((min(ids[x], ids[y]), max(ids[x], ids[y])))
    a, b = zip(*found, strict=True) if found else ((), ())
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _candidates(
    rows: DataFrame, keys: DataFrame, sketches: DataFrame, part: int, whole: int, spanning: bool
) -> DataFrame:
    """Pairs of ``rows`` that share one of ``keys`` and lie in different components.

    Sets of a crowded key are dealt out as pairs of parts, each of which is one cell."""
    few = _across(rows, keys.where(F.col("total") <= FEW), part, whole)
    splits = F.ceil(F.col("total") / PART)
    crowded = rows.join(keys.where(F.col("total") > FEW).select("key", splits.alias("splits")), "key")
    own, other = F.pmod(F.xxhash64("id"), F.col("splits")), F.col("other")
    dealt = (
        crowded.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("splits") - 1)))
        .select(
            "key",
            F.least(own, other).alias("one"),
            F.greatest(own, other).alias("two"),
            F.when(own == other, 3).when(own < other, 1).otherwise(2).alias("side"),
            "id",
            "n",
            "root",
        )
        .join(sketches, "id")
    )

    def compare(cell: pa.Table) -> pa.Table:
        return _compare(cell, part, whole, spanning)

    met = dealt.groupBy("key", "one", "two").applyInArrow(compare, "a long, b long")
    return few.unionByName(met).distinct()


def _segments(marked: DataFrame, part: int, whole: int, price: float) -> tuple[DataFrame, DataFrame]:
    """Bands with their number of segments, and with the sets and members they hold."""
    top = marked.agg(F.max("band")).first()[0]
    bands = Bands(part, whole)
    spark = marked.sparkSession
    known = [(b, bands.segments(b)) for b in range((-1 if top is None else top) + 1)]
    counts = spark.createDataFrame(known, "band int, segments int").where("segments > 0")
    held = (
        marked.where("band >= 0")
        .select(F.explode(F.array("band", F.col("band") - 1)).alias("band"), "n")
        .groupBy("band")
        .agg(F.count(F.lit(1)).alias("sets"), F.sum("n").alias("held"))
    )
    return counts, counts.join(held, "band").select("band", "segments", "sets", "held", F.lit(price).alias("price"))


def _allocate(crossing: DataFrame, held: DataFrame) -> DataFrame:
    """``band``, ``first`` and ``second`` of segments to be taken together.

    Segments of a band are ordered by the unlinked pairs they still hold, and the first
    ``2 * r`` of them are taken together two by two. A pair of sets is mostly met in many
    segments but compared once, so what is left to compare is about what the next segment
    holds; against it stand reading the band again and ``r`` times the entries of two
    segments. ``r`` is the number that costs least, in members of sets handled.
    """
    of_band = Window.partitionBy("band").orderBy(F.desc("crossing"), "segment")
    every = held.select("*", F.explode(F.sequence(F.lit(0), F.col("segments") - 1)).alias("segment"))
    ranked = (
        every.join(crossing, ["band", "segment"], "left")
        .withColumn("crossing", F.coalesce("crossing", F.lit(0).cast("long")))
        .withColumn("place", F.row_number().over(of_band) - 1)
    )
    paired = F.floor(F.col("place") / 2)
    entries = ENTRY * (F.col("sets") + 2 * F.col("held") / F.col("segments"))
    spent = F.when(paired > 0, F.col("price") * (F.col("held") + paired * entries)).otherwise(0.0)
    compared = F.col("crossing") * COMPARISON
    # In an even place 2 * r the row tells what r costs; past the last segment nothing is left.
    all_paired = F.col("price") * (F.col("held") + F.floor(F.col("segments") / 2) * entries)
    choices = ranked.where("place % 2 = 0").select("band", paired.alias("pairs"), (spent + compared).alias("cost"))
    choices = choices.unionByName(
        held.where("segments % 2 = 0").select("band", F.floor(F.col("segments") / 2).alias("pairs"), all_paired.alias("cost"))
    )
    chosen = choices.groupBy("band").agg(F.min(F.struct("cost", "pairs")).alias("least"))
    return (
        ranked.join(chosen, "band")
        .where(paired < F.col("least.pairs"))
        .groupBy("band", paired.alias("pair"))
        .agg(F.min("segment").alias("first"), F.max("segment").alias("second"))
        .select("band", "first", "second")
    )


def near_duplicates(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    size: int = 3,
    part: int = 9,
    whole: int = 10,
    price: float = 1.0,
) -> DataFrame:
    """``id``, ``n`` (distinct ``size``-word shingles) and ``component`` (the smallest id
    reachable over links) of every row of ``docs``.

    Two documents link if their sets have similarity ``part / whole`` or more. Words are
    runs without ASCII space, with A-Z as a-z; fewer than ``size`` words make one shingle,
    none an empty set, which links with nothing, as does a null text. No link is lost.
    Equal sets are told by 128-bit sums, candidates compared word by word. Rows of one id
    count as one document with the links of each of its texts; rows without an id take no
    part and have no component. Repeated rows come out once each; an empty table gives no
    rows. ``price`` weighs entries of segments taken together against pairs compared.
    """
    ship(docs.sparkSession)
    texts = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    mark = partial(_mark, size=size, part=part, whole=whole)
    marked = stored(texts.mapInArrow(mark, MARKED), "sets")
    known = marked.where("id IS NOT NULL AND n > 0")
    firsts = stored(known.groupBy("n", "low", "high").agg(F.min("id").alias("first")), "firsts")
    copies = stored(
        known.select("id", "n", "low", "high").join(firsts, ["n", "low", "high"]).where("id <> first"), "copies"
    )
    same = copies.select(F.col("first").alias("a"), F.col("id").alias("b")).distinct()

    # One row for each set and segment. The keys of the own band come first.
    counts, held = _segments(known.select("band", "n"), part, whole, price)
    sets = known.join(_small(copies.select("id", "n", "low", "high")), ["id", "n", "low", "high"], "left_anti")
    entries = sets.select("id", "n", "band", F.posexplode("keys").alias("at", "key"))
    shared = entries.groupBy("key").agg(F.min("id").alias("least"), F.max("id").alias("last"))
    rows = stored(entries.join(shared.where("least < last").select("key", "least"), "key"), "shared")

    # Each set with the smallest of those it shares a segment with.
    tried = stored(
        rows.where("id <> least").groupBy(F.col("id").alias("b")).agg(F.min("least").alias("a")).select("a", "b"),
        "tried",
    )
    links = stored(_alike(tried, texts, size, part, whole).unionByName(same), "links")

    # What is left of the segments, pair by pair across components.
    roots = connected_components(links)
    rows = _labelled(rows, roots)
    unsettled = stored(_unsettled(rows), "unsettled")
    if unsettled.isEmpty():
        return _components(marked, roots)
    own = counts.select("band", "segments")
    below = F.col("at") >= F.col("segments")
    placed = rows.join(own, "band", "left").select(
        "key",
        F.when(F.coalesce(below, F.lit(True)), F.col("band") - 1).otherwise(F.col("band")).alias("band"),
        F.when(below, F.col("at") - F.col("segments")).otherwise(F.col("at")).alias("segment"),
    )
    where = placed.join(unsettled, "key").groupBy("key").agg(
        F.min("band").alias("band"), F.min("segment").alias("segment"), F.min("crossing").alias("crossing")
    )
    where = stored(where, "places")
    crossing = where.groupBy("band", "segment").agg(F.sum("crossing").alias("crossing"))
    together = stored(_allocate(crossing, held), "together")
    either = together.select("band", F.explode(F.array("first", "second")).alias("segment"))
    single = where.join(either, ["band", "segment"], "left_anti")
    crossed = [(rows.select("key", "id", "n"), single)]
    if not together.isEmpty():
        crossed.append((stored(_left_out(sets, texts, together, size, part, whole), "left_out"), None))
    sketches = sets.select("id", "sketch")
    for spanning in (True, False):
        found = []
        for met, keys in crossed:
            met = _labelled(met, roots)
            among = met if keys is None else met.join(keys.select("key"), "key", "left_semi")
            open_keys = stored(_unsettled(among), "unsettled")
            found.append(_candidates(met, open_keys, sketches, part, whole, spanning))
        pairs = reduce(DataFrame.unionByName, found)
        pairs = stored(pairs.distinct().join(tried, ["a", "b"], "left_anti"), "pairs")
        if pairs.isEmpty():
            break
        links = stored(links.unionByName(_alike(pairs, texts, size, part, whole)), "links")
        roots = connected_components(links)
        tried = stored(tried.unionByName(pairs), "tried")
    return _components(marked, roots)


def _left_out(
    sets: DataFrame, texts: DataFrame, together: DataFrame, size: int, part: int, whole: int
) -> DataFrame:
    """``key``, ``id`` and ``n``: sets that share a key differ in one member at most in two
    segments which are taken together."""
    per_band = together.groupBy("band").agg(F.collect_list(F.struct("first", "second")).alias("pairs"))
    asked = sets.select("id", F.explode(F.array("band", F.col("band") - 1)).alias("band")).join(per_band, "band")
    keys = (
        texts.join(asked, "id")
        .select("id", "text", "band", "pairs")
        .mapInArrow(partial(_leave_out, size=size, part=part, whole=whole), "key long, id long, n long")
    )
    keys = stored(keys, "entries")
    shared = keys.groupBy("key").agg(F.min("id").alias("least"), F.max("id").alias("last")).where("least < last")
    return keys.join(shared.select("key"), "key", "left_semi")


def _components(marked: DataFrame, roots: DataFrame) -> DataFrame:
    return marked.join(roots, F.col("id") == F.col("node"), "left").select(
        "id", "n", F.coalesce("root", "id").alias("component")
    )
