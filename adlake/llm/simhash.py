"""SimHash near-duplicates, linked through a forest of vantage-point trees.

Each 64-bit word of a fingerprint is cut into blocks, and each block has a tree of its
own that splits by Hamming distance over that block. Two 64-bit fingerprints that differ
in at most ``blocks * (r + 1) - 1`` bits differ in at most ``r`` bits of some block, so
visiting every leaf that a ball of radius ``r`` overlaps finds every such pair. One tree
over all 64 bits would prune next to nothing: random fingerprints lie 32 +- 4 bits from
any vantage point, as wide as the ball searched for.

The wide fingerprints of near-dedup differ in a fifth of their bits, which no ball over a
block holds. They are dealt by drawn bits to cells, the more bits the more there are, and
meet within a cell where two of their bytes are equal (``near_links``).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adlake.llm.common import ship, small_batches, stored
from adlake.llm.components import connected_components

#: Fingerprints the trees are built from, a bounded sample by hash: up to twice as many.
SAMPLE = 1 << 15

#: Fingerprints aimed at per leaf, and the most that one task compares with others.
LEAF = 2048
MOST = 1 << 15

#: Wide fingerprints aimed at per cell; a cell of over twice as many is dealt out in parts.
CELL = 1 << 15

#: Tables in which the farthest candidates are expected to share a cell, and the keys of two
#: bytes by which the fingerprints of a cell meet.
SHARED = 8
KEYS = 128

#: Fingerprints of a cell that meet without keys, and of a key that are compared set by set.
ALL = 512
CROWD = 64

#: Texts of one family of candidates that a task compares exactly with as many others.
FAMILY = 1024

MIXERS = np.array(
    [0] + [(0x9E3779B97F4A7C15 * (2 * i + 1)) % 2**64 for i in range(1, 64)], dtype=np.uint64
)


def _mixed(hashes: np.ndarray, word: int) -> np.ndarray:
    """The hash itself for word 0, an independent one of it for every other word."""
    if word == 0:
        return hashes
    x = hashes ^ MIXERS[word]
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """XXH64 (seed 42) of all ``size``-word shingles of the lower-cased text, repeats
    included; of the whole sequence where it is shorter; nothing without words."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - size + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter(
        [digest(joined[s:e], 42) for s, e in zip(starts, ends[size - 1 :].tolist(), strict=True)],
        np.uint64,
        len(starts),
    )


def fingerprint(text: bytes | None, size: int, bits: int, once: bool = False) -> bytes:
    """``bits`` bits, big-endian words: set where over half of the hashes have it; with
    ``once`` a repeated shingle counts once."""
    hashes = shingle_hashes(text or b"", size)
    if once:
        hashes = np.unique(hashes)
    words = bits // 64
    if not len(hashes):
        return bytes(8 * words)
    ones = np.zeros((words, 64), np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at : at + (1 << 14)]
        for word in range(words):
            eights = _mixed(part, word).astype("<u8").view(np.uint8).reshape(-1, 8)
            ones[word] += np.unpackbits(eights, axis=1, bitorder="little").sum(0, dtype=np.int32)
    packed = np.packbits(2 * ones > len(hashes), axis=1, bitorder="little")
    return packed.view("<u8").astype(">u8").tobytes()


def _print_batches(
    batches: Iterator[pa.RecordBatch], size: int, bits: int, once: bool
) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(2).cast(pa.binary()).to_pylist()
        prints = pa.array([fingerprint(text, size, bits, once) for text in texts], pa.binary())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), prints], ["id", "of_text", "print"]
        )


def fingerprints(
    docs: DataFrame, id: str, text: str, size: int, bits: int, once: bool = False
) -> DataFrame:
    """``id``, a hash of the text (``of_text``) and the fingerprint (``print``)."""
    ship(docs.sparkSession)
    picked = docs.select(
        F.col(id).cast("long").alias("id"), F.xxhash64(text).alias("of_text"), F.col(text).alias("text")
    )
    return picked.mapInArrow(
        partial(_print_batches, size=size, bits=bits, once=once), "id long, of_text long, print binary"
    )


def _grow(values: np.ndarray, radius: int, depth: int, rng: np.random.Generator, share: float):
    """A tree over sampled block values: ``(vantage, bound, nearer, farther)``, or the
    share of all fingerprints that a leaf stands for."""
    if depth and len(values) >= 32:
        best = None
        for vantage in rng.choice(values, 8):
            far = np.bitwise_count(values ^ vantage)
            for bound in {int(np.median(far)), int(np.median(far)) + 1}:
                near = int((far < bound).sum())
                spill = float(((far > bound - 1 - radius) & (far < bound + radius)).mean())
                worst = max(near, len(values) - near) / len(values) + spill / 2
                if 0 < near < len(values) and (best is None or worst < best[0]):
                    best = (worst, vantage, bound, far)
        if best and best[0] < 1.2:
            _, vantage, bound, far = best
            near = values[far < bound]
            part = len(near) / len(values)
            return (
                vantage,
                bound,
                _grow(near, radius, depth - 1, rng, share * part),
                _grow(values[far >= bound], radius, depth - 1, rng, share * (1 - part)),
            )
    return share


def _number(tree, total: int, first: int):
    """Give leaves their first cell and number of splits, from left to right."""
    if isinstance(tree, tuple):
        near, first = _number(tree[2], total, first)
        far, first = _number(tree[3], total, first)
        return (tree[0], tree[1], near, far), first
    splits = max(1, -(-int(tree * total) // MOST))
    return [first, splits], first + splits * splits


def _leaves(tree, values: np.ndarray, at: np.ndarray, home: np.ndarray, radius: int):
    """Leaf by leaf: the rows whose ball overlaps it, and which of them live there."""
    if not len(at):
        return
    if not isinstance(tree, tuple):
        yield tree, at, home
        return
    vantage, bound, near, far = tree
    d = np.bitwise_count(values[at] ^ vantage).astype(np.int64)
    for child, inside, reached in (
        (near, d < bound, d - radius < bound),
        (far, d >= bound, d + radius >= bound),
    ):
        yield from _leaves(child, values, at[reached], (home & inside)[reached], radius)


def _block(words: np.ndarray, tree: int, blocks: int) -> np.ndarray:
    """What tree ``tree`` sees: one of ``blocks`` blocks of a word, near equal in width."""
    word, block = divmod(tree, blocks)
    low, high = 64 * block // blocks, 64 * (block + 1) // blocks
    return (words[:, word] >> np.uint64(low)) & np.uint64((1 << (high - low)) - 1)


def _route(
    batches: Iterator[pa.RecordBatch], forest: list, blocks: int, radius: int
) -> Iterator[pa.RecordBatch]:
    """Rows per cell of the leaves. ``side`` 1 is compared with side 2; 3 is on both."""
    for batch in batches:
        words = _words(batch.column(1))
        if not len(words):
            continue
        mixed = _mixed(words[:, 0], 7)
        for number, tree in enumerate(forest):
            values = _block(words, number, blocks)
            lived = np.zeros(len(words), bool)
            for (first, splits), at, home in _leaves(
                tree, values, np.arange(len(words)), np.ones(len(words), bool), radius
            ):
                # Leaves come in order: one of two that lie in different leaves visits
                # the other's if its own came before.
                stay = home | lived[at]
                lived[at[home]] = True
                at, home = at[stay], home[stay]
                chunk = (mixed[at] % np.uint64(splits)).astype(np.int64)
                for other in range(splits):
                    low, high = np.minimum(chunk, other), np.maximum(chunk, other)
                    if splits == 1:
                        side = np.where(home, 3, 2)
                    else:
                        side = np.where(chunk == other, 3, np.where(chunk < other, 1, 2))
                    cell = first + low * splits + high
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(cell * len(forest) + number, pa.int64()),
                            pa.array(side, pa.int32()),
                            batch.column(0).take(pa.array(at)),
                            batch.column(1).take(pa.array(at)),
                        ],
                        ["cell", "side", "id", "print"],
                    )


def _words(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    data = column.to_pylist()
    if not data:
        return np.empty((0, 1), np.uint64)
    return np.frombuffer(b"".join(data), ">u8").astype(np.uint64).reshape(len(data), -1)


LINKS = "a_id long, a_print binary, b_id long, b_print binary"


def _linked(ids: list, prints: list, a: list[int], b: list[int]) -> pa.Table:
    return pa.table(
        {
            "a_id": pa.array([ids[k] for k in a], pa.int64()),
            "a_print": pa.array([prints[k] for k in a], pa.binary()),
            "b_id": pa.array([ids[k] for k in b], pa.int64()),
            "b_print": pa.array([prints[k] for k in b], pa.binary()),
        }
    )


def _edges(found: DataFrame) -> DataFrame:
    return found.select(
        F.struct(F.col("a_id").alias("id"), F.col("a_print").alias("print")).alias("a"),
        F.struct(F.col("b_id").alias("id"), F.col("b_print").alias("print")).alias("b"),
    ).distinct()


def _link(cell: pa.Table, trees: int, blocks: int, radius: int, distance: int) -> pa.Table:
    """Of every linked set within a cell, each member but the smallest with the smallest.

    Compares block values first and whole fingerprints only where those are near. Rows
    of links are held for one stripe at a time, whatever the number of members.
    """
    number = cell.column("cell")[0].as_py() % trees
    words = _words(cell.column("print"))
    ids = cell.column("id").to_pylist()
    prints = cell.column("print").to_pylist()
    side = cell.column("side").to_numpy()
    values = _block(words, number, blocks).astype(np.uint32)
    left, right = np.flatnonzero(side & 1), np.flatnonzero(side & 2)
    parent = np.arange(len(words))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    stripe = max(1, (1 << 20) // max(1, len(right)))
    for at in range(0, len(left), stripe):
        rows = left[at : at + stripe]
        i, j = np.nonzero(np.bitwise_count(values[rows][:, None] ^ values[right][None, :]) <= radius)
        i, j = rows[i], right[j]
        other = parent[i] != parent[j]
        i, j = i[other], j[other]
        apart = np.zeros(len(i), np.int64)
        for word in range(words.shape[1]):
            apart += np.bitwise_count(words[i, word] ^ words[j, word])
        close = apart <= distance
        for a, b in zip(i[close].tolist(), j[close].tolist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        for k in np.flatnonzero(parent != np.arange(len(parent))).tolist():
            parent[k] = root(k)
    members: dict[int, list[int]] = {}
    for k in range(len(parent)):
        members.setdefault(root(k), []).append(k)
    a, b = [], []
    for group in members.values():
        if len(group) > 1:
            top = min(group, key=lambda k: (ids[k] is not None, ids[k] or 0, prints[k]))
            a += [k for k in group if k != top]
            b += [top] * (len(group) - 1)
    return _linked(ids, prints, a, b)


def links(
    nodes: DataFrame, bits: int, distance: int, blocks: int, radius: int
) -> DataFrame:
    """Edges ``a``, ``b`` that connect all fingerprints within ``distance`` bits of each
    other which the forest brings together; ``nodes`` has distinct ``print`` with ``id``.
    """
    total = nodes.count()
    # One in so many by hash, so that tasks send no more than their share of the sample.
    one_in = max(1, total // SAMPLE)
    drawn = F.pmod(F.xxhash64("print", F.lit(7)), F.lit(one_in)) == 0
    sample = nodes.where(drawn).select("print").orderBy("print").collect()
    words = _words(pa.array([bytes(row[0]) for row in sample], pa.binary()))
    trees = blocks * (bits // 64)
    rng, forest, first = np.random.default_rng(11), [], 0
    depth = max(0, int(np.ceil(np.log2(max(1, total) / LEAF))))
    for number in range(trees):
        grown = 1.0
        if len(words):
            grown = _grow(_block(words, number, blocks), radius, depth, rng, 1.0)
        tree, first = _number(grown, total, first)
        forest.append(tree)
    routed = nodes.select("id", "print").mapInArrow(
        partial(_route, forest=forest, blocks=blocks, radius=radius), "cell long, side int, id long, print binary"
    )

    def link(cell: pa.Table) -> pa.Table:
        return _link(cell, trees, blocks, radius, distance)

    return _edges(routed.groupBy("cell").applyInArrow(link, LINKS))


def _spots(total: int, bits: int, distance: int) -> np.ndarray:
    """The bits by which each table deals ``total`` fingerprints out to cells."""
    width = max(0, int(np.ceil(np.log2(max(1, total) / CELL))))
    tables = 1 if total <= ALL else int(np.ceil(SHARED / (1 - distance / bits) ** width))
    laps = np.tile(np.arange(bits), (tables * width // bits + 1, 1))
    drawn = np.random.default_rng(11).permuted(laps, axis=1).ravel()
    return drawn[: tables * width].reshape(tables, width)


def _cells(prints: np.ndarray, spots: np.ndarray) -> Iterator[np.ndarray]:
    """Table by table, the cell of each fingerprint: the bits at the table's spots."""
    ones = np.unpackbits(prints, axis=1)
    for number, at in enumerate(spots):
        key = np.full(len(prints), number, np.int64)
        for spot in at.tolist():
            key = key << 1 | ones[:, spot]
        yield key


def _bytes(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    data = column.to_pylist()
    return np.frombuffer(b"".join(data), np.uint8).reshape(len(data), -1)


def _deal(
    batches: Iterator[pa.RecordBatch], spots: np.ndarray, crowded: dict[int, int]
) -> Iterator[pa.RecordBatch]:
    """Rows per cell of each table. A crowded cell is dealt out as all pairs of its parts."""
    for batch in batches:
        if not batch.num_rows:
            continue
        prints = _bytes(batch.column(1))
        mixed = _mixed(prints.view(">u8")[:, 0].astype(np.uint64), 7)
        for cells in _cells(prints, spots):
            splits = np.ones(len(cells), np.int64)
            for cell in crowded.keys() & set(np.unique(cells).tolist()) if crowded else ():
                splits[cells == cell] = crowded[cell]
            part = (mixed % splits.astype(np.uint64)).astype(np.int64)
            for other in range(splits.max()):
                at = np.flatnonzero(other < splits)
                low, high = np.minimum(part[at], other), np.maximum(part[at], other)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(cells[at] << 32 | low << 16 | high, pa.int64()),
                        *(batch.columns if len(at) == len(cells) else batch.take(pa.array(at)).columns),
                    ],
                    ["cell", "id", "print"],
                )


def _byte_pairs(number: int, at: np.ndarray, bits: int) -> np.ndarray:
    """The pairs of bytes that are keys in a table's cells, none with a bit that is equal
    throughout a cell."""
    free = np.setdiff1d(np.arange(bits // 8), at // 8)
    pairs = np.stack(np.triu_indices(len(free), 1), axis=1)
    return free[np.random.default_rng([12, number]).permutation(pairs)[:KEYS]]


class _Sets:
    """Sets of fingerprints that links connect; only members of different sets are compared."""

    def __init__(self, prints: np.ndarray, distance: int) -> None:
        words = prints.view(np.uint64)
        # Of unlike fingerprints half the bits tell already.
        self.parts = [np.ascontiguousarray(half) for half in np.array_split(words, 2, axis=1)]
        self.distance = distance
        self.of = np.arange(len(prints))
        self.members: dict[int, list[int]] = {}
        self.compared = 0

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        """Unite the sets of all of these pairs that are near."""
        for at in range(0, len(i), 1 << 16):
            self._link(i[at : at + (1 << 16)], j[at : at + (1 << 16)])

    def _link(self, i: np.ndarray, j: np.ndarray) -> None:
        other = np.flatnonzero(self.of[i] != self.of[j])
        i, j = i[other], j[other]
        self.compared += len(i)
        apart = np.zeros(len(i), np.int64)
        for part in self.parts:
            apart += np.bitwise_count(part[i] ^ part[j]).sum(1, dtype=np.int64)
            close = apart <= self.distance
            i, j, apart = i[close], j[close], apart[close]
        for a, b in zip(i.tolist(), j.tolist(), strict=True):
            a, b = int(self.of[a]), int(self.of[b])
            if a != b:
                few, many = sorted((a, b), key=lambda k: len(self.members.get(k, (k,))))
                gone = self.members.pop(few, [few])
                self.of[gone] = many
                self.members.setdefault(many, [many]).extend(gone)

    def link_all(self, rows: np.ndarray) -> None:
        """The same for all pairs of ``rows``, without a row for each. A set that has over
        half of them keeps it, whatever is added, so its members are done with."""
        left = rows
        while len(left):
            middle = np.partition(self.of[rows], len(rows) // 2)[len(rows) // 2]
            if 2 * np.count_nonzero(self.of[rows] == middle) > len(rows):
                left = left[self.of[left] != middle]
            if len(left):
                self.link(np.full(len(rows), left[0]), rows)
                left = left[1:]


def _near_sets(prints: np.ndarray, number: int, at: np.ndarray, distance: int) -> _Sets:
    """Sets of a cell's fingerprints, linked where two that meet by a key are near."""
    sets = _Sets(prints, distance)
    if len(prints) <= ALL:
        sets.link(*np.triu_indices(len(prints), 1))
        return sets
    columns = np.ascontiguousarray(prints.T).astype(np.uint16)
    for one, two in _byte_pairs(number, at, 8 * len(columns)).tolist():
        value = columns[one] << 8 | columns[two]
        order = np.argsort(value, kind="stable")
        run = value[order]
        many = np.unique(run[CROWD:][run[CROWD:] == run[:-CROWD]])
        if len(many):
            for low, high in zip(
                np.searchsorted(run, many).tolist(), np.searchsorted(run, many, "right").tolist(), strict=True
            ):
                sets.link_all(order[low:high])
            rest = ~np.isin(run, many)
            order, run = order[rest], run[rest]
        step, first = 1, np.flatnonzero(run[1:] == run[:-1])
        while len(first):
            sets.link(order[first], order[first + step])
            step += 1
            first = first[first + step < len(run)]
            first = first[run[first] == run[first + step]]
    return sets


def _near(cell: pa.Table, spots: np.ndarray, distance: int) -> pa.Table:
    """Of every linked set within a cell, each member but the smallest with the smallest."""
    number = cell.column("cell")[0].as_py() >> 32 + spots.shape[1]
    prints, ids = cell.column("print").to_pylist(), cell.column("id").to_pylist()
    sets = _near_sets(_bytes(cell.column("print")), number, spots[number], distance)
    a, b = [], []
    for group in sets.members.values():
        top = min(group, key=lambda k: (ids[k] is not None, ids[k] or 0, prints[k]))
        a += [k for k in group if k != top]
        b += [top] * (len(group) - 1)
    return _linked(ids, prints, a, b)


def near_links(nodes: DataFrame, bits: int, distance: int) -> DataFrame:
    """Edges ``a``, ``b`` that connect fingerprints within ``distance`` bits of each other;
    ``nodes`` has distinct ``print`` with ``id``.

    A cell holds up to ``CELL`` fingerprints on average however many there are, as the bits
    that deal them out grow with the logarithm of their number. Those of a cell are compared
    where they share one of ``KEYS`` pairs of bytes, which unlike ones do once in 2**16. So
    comparisons grow with tables, not with the square of ``nodes``. Tables grow by a quarter
    with each bit, so that a pair ``distance`` bits apart shares ``SHARED`` cells on average.
    """
    total = nodes.count()
    spots = _spots(total, bits, distance)
    crowded: dict[int, int] = {}
    if spots.shape[1]:
        # One in so many by hash, so that tasks send no more than their share of the sample.
        one_in = max(1, total // SAMPLE)
        drawn = F.pmod(F.xxhash64("print", F.lit(7)), F.lit(one_in)) == 0
        sample = nodes.where(drawn).select("print").collect()
        if sample:
            for cells in _cells(_bytes(pa.array([bytes(row[0]) for row in sample])), spots):
                for cell, count in zip(*np.unique(cells, return_counts=True), strict=True):
                    parts = -(-int(count) * total // (len(sample) * CELL))
                    if parts > 2:
                        crowded[int(cell)] = min(parts, 1 << 15)
    dealt = nodes.select("id", "print").mapInArrow(
        partial(_deal, spots=spots, crowded=crowded), "cell long, id long, print binary"
    )

    def near(cell: pa.Table) -> pa.Table:
        return _near(cell, spots, distance)

    return _edges(dealt.groupBy("cell").applyInArrow(near, LINKS))


def near_duplicates(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    size: int = 4,
    bits: int = 64,
    distance: int = 4,
    blocks: int = 3,
    radius: int = 1,
) -> DataFrame:
    """``id``, ``of_text``, ``print`` and ``component`` (the smallest id reachable over
    links) of every row of ``docs``.

    Fingerprints of ``size``-word shingles link at ``distance`` differing bits or less.
    With ``bits`` 64 and ``distance`` below ``blocks * (radius + 1)`` no link is lost;
    with more words a pair is found if any block differs in ``radius`` bits or less.
    Null and wordless texts have fingerprint zero and link like any other. Null ids
    count as the smallest; equal texts share a fingerprint and are compared once;
    repeated rows come out once each; an empty table gives no rows. Leaves that grow
    past ``MOST`` fingerprints are dealt out as pairs of parts.
    """
    marked = stored(fingerprints(docs, id, text, size, bits), "prints")
    nodes = stored(marked.groupBy("print").agg(F.min("id").alias("id")), "nodes")
    linked = connected_components(links(nodes, bits, distance, blocks, radius))
    roots = stored(
        linked.select(F.col("node.print").alias("print"), F.col("root.id").alias("root_id"), F.col("root.print").alias("root_print")),
        "roots",
    )
    of_print = stored(
        nodes.join(roots, "print", "left").select(
            "print",
            F.when(F.col("root_print").isNotNull(), F.col("root_id")).otherwise(F.col("id")).alias("component"),
            F.coalesce("root_print", "print").alias("root_print"),
        ),
        "classes",
    )
    return marked.join(of_print, "print").select("id", "of_text", "print", "component", "root_print")


def _family_sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Texts with their distinct shingles; large families are dealt out as pairs of parts."""
    for batch in small_batches(batches, 4, 2 << 20):
        rows: list[tuple] = []
        for family, of_text, mark, members, text in zip(
            *(column.to_pylist() for column in batch.columns), strict=True
        ):
            own = np.unique(shingle_hashes((text or "").encode(), size)).tobytes()
            splits = -(-members // FAMILY)
            chunk = (of_text % (1 << 64)) * 0x9E3779B97F4A7C15 % (1 << 64) % splits
            for other in range(splits):
                side = 3 if chunk == other else 1 if chunk < other else 2
                rows.append((family, min(chunk, other), max(chunk, other), side, of_text, mark, own))
        if rows:
            kinds = [pa.binary(), *[pa.int64()] * 4, pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                ["family", "low", "high", "side", "of_text", "print", "own"],
            )


def _verify(cell: pa.Table, distance: int, alike: float) -> pa.Table:
    """Links between texts of a cell whose sets of shingles are alike, each connected
    set once. Pairs that links connect already aren't compared."""
    words = _words(cell.column("print"))
    ids = cell.column("of_text").to_pylist()
    side = cell.column("side").to_numpy()
    sets = [np.frombuffer(own, np.uint64) for own in cell.column("own").to_pylist()]
    sizes = np.array([len(own) for own in sets], np.int64)
    group = np.arange(len(ids))
    left, right = np.flatnonzero(side & 1), np.flatnonzero(side & 2)
    a, b = [], []
    for i in left.tolist():
        small, large = np.minimum(sizes[i], sizes[right]), np.maximum(sizes[i], sizes[right])
        near = right[(group[right] != group[i]) & (small >= alike * large)]
        near = near[np.bitwise_count(words[near] ^ words[i]).sum(1, dtype=np.int64) <= distance]
        for j in near.tolist():
            if group[i] == group[j]:
                continue
            shared = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if shared >= alike * (sizes[i] + sizes[j] - shared):
                a.append(ids[i])
                b.append(ids[j])
                group[group == group[j]] = group[i]
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def one_of_each(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    size: int = 5,
    bits: int = 768,
    distance: int = 156,
    alike: float = 0.8,
) -> DataFrame:
    """``docs`` with only the smallest id of every group of near-duplicates: of texts
    that links of similarity ``alike`` or more between sets of shingles connect.

    Fingerprints only find candidates. Sets of similarity 0.8 point in directions 27
    degrees apart, which ``bits`` 768 measures as 117 +- 10 differing bits; ``distance``
    lies four deviations above. ``near_links`` finds them. Candidates are put into families,
    and the texts of a family are compared by their shingles; texts without words are alike.
    Equal rows are one document.
    """
    marked = stored(fingerprints(docs, id, text, size, bits, once=True), "prints")
    nodes = stored(marked.groupBy("print").agg(F.min("id").alias("id")), "nodes")
    near = connected_components(near_links(nodes, bits, distance)).select(
        F.col("node.print").alias("print"), F.col("root.print").alias("family")
    )
    texts = stored(
        marked.groupBy("of_text").agg(F.min("print").alias("print"), F.min(F.struct("id", "of_text")).alias("first")),
        "texts",
    )
    placed = stored(
        texts.join(near, "print", "left").withColumn("family", F.coalesce("family", "print")), "families"
    )
    several = placed.groupBy("family").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    members = stored(placed.join(several, "family"), "members")
    rows = docs.select(
        F.struct(*[F.col(f"`{name}`") for name in docs.columns]).alias("row"),
        F.col(id).cast("long").alias("row_id"),
        F.xxhash64(text).alias("row_text"),
    )
    compared = (
        rows.select("row_id", "row_text", F.col("row")[text].alias("text"))
        .join(members, F.col("row_id").eqNullSafe(F.col("first.id")) & (F.col("row_text") == F.col("of_text")))
        .select("family", "of_text", "print", "members", "text")
        .mapInArrow(
            partial(_family_sets, size=size),
            "family binary, low long, high long, side long, of_text long, print binary, own binary",
        )
    )

    def verify(cell: pa.Table) -> pa.Table:
        return _verify(cell, distance, alike)

    sure = compared.groupBy("family", "low", "high").applyInArrow(verify, "a long, b long")
    roots = connected_components(sure.distinct())
    grouped = stored(
        texts.join(roots, F.col("of_text") == F.col("node"), "left").select(
            "of_text", "first", F.coalesce("root", "of_text").alias("group")
        ),
        "groups",
    )
    heads = grouped.groupBy("group").agg(F.min("first").alias("head"))
    heads = stored(grouped.join(heads, "group").select("of_text", "head"), "heads")
    first = F.col("id").eqNullSafe(F.col("head.id")) & (F.col("of_text") == F.col("head.of_text"))
    judged = stored(marked.select("id", "of_text").join(heads, "of_text").select("id", "of_text", first.alias("stays")), "judged")
    gone = stored(judged.where("NOT stays").select("id", "of_text").distinct(), "gone")
    left = rows.join(
        gone, F.col("row_id").eqNullSafe(F.col("id")) & (F.col("row_text") == F.col("of_text")), "left_anti"
    )
    twice = judged.where("stays").groupBy("id", "of_text").count().where("count > 1")
    if not twice.isEmpty():
        left = left.dropDuplicates(["row_id", "row_text"])
    return left.select("row.*")
