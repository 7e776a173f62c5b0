"""Words one letter apart, found with k-d trees over letter counts.

A word is placed by how often each letter occurs in it. One edit moves it by at most two
steps: a replaced letter takes one count down and another one up, a letter put in takes
one up. So words of a length meet those of the same and of the next length in a range
search: a tree splits by a count, every branch knows the box its words lie in, and a
branch out of reach is cut off. Only what is left is held letter against letter.

Counts are written as marks, 64 bits of which bit ``d`` says that dimension ``d`` occurs
and bit ``32 + d`` that it occurs twice. Steps between two words are then the bits in
which they differ, the box of a branch is the bits all of its words have and those any
has, and counts beyond two, or letters that share a dimension, can only make words look
nearer than they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adlake.llm.common import ship, stored

#: Dimensions: a to z, and six that all other letters share.
DIMENSIONS = 32

#: Words that the shared tree is grown from, a bounded sample by hash.
SAMPLE = 1 << 16

#: Words of the table in one cell of the shared tree, and of the sample at least.
CELL = 1 << 14
SAMPLED = 32

#: Words of a branch that isn't split further, and pairs held in memory at a time.
LEAF = 64
PAIRS = 1 << 20

ROUTED = "length int, cell long, role int, word string, n long"
FOUND = "word string, near long, best_n long, best string"

POINT, SAME, SHORTER = 0, 1, 2


class Split(NamedTuple):
    """Words without and with one mark."""

    bit: int
    without: Split | Cell
    having: Split | Cell


class Cell(NamedTuple):
    """Cells ``first`` to ``first + parts - 1`` hold the words that come out here."""

    first: int
    parts: int


def letters(words: list[str], length: int) -> np.ndarray:
    """Code points, one row per word; all words have ``length`` of them."""
    return np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(len(words), length)


def marks(chars: np.ndarray) -> np.ndarray:
    """Letter counts as bits: for each dimension at least one, and at least two."""
    latin = (chars >= ord("a")) & (chars <= ord("z"))
    dimension = np.where(latin, chars - ord("a"), 26 + chars % 6).astype(np.uint64)
    once = np.zeros(len(chars), np.uint64)
    twice = np.zeros(len(chars), np.uint64)
    for column in dimension.T:
        bit = np.uint64(1) << column
        twice |= once & bit
        once |= bit
    return once | twice << np.uint64(DIMENSIONS)


def _best_bit(own: np.ndarray) -> tuple[int, np.ndarray]:
    """The mark that comes nearest to halving the words, and who has it."""
    bits = np.unpackbits(own.view(np.uint8).reshape(len(own), 8), axis=1, bitorder="little")
    share = bits.sum(0, dtype=np.int64)
    bit = int(np.argmin(np.abs(2 * share - len(own))))
    return bit, bits[:, bit].astype(bool)


def grow(own: np.ndarray, scale: float, first: int = 0) -> tuple[Split | Cell, int]:
    """A tree over sampled marks, each of which stands for ``scale`` words, and the
    number of the next cell. A cell that would be too large is dealt out in parts."""
    expected = len(own) * scale
    if expected > CELL and len(own) >= 2 * SAMPLED:
        bit, has = _best_bit(own)
        if min(has.sum(), (~has).sum()) >= SAMPLED:
            without, first = grow(own[~has], scale, first)
            having, first = grow(own[has], scale, first)
            return Split(bit, without, having), first
    parts = max(1, int(-(-expected // (4 * CELL))))
    return Cell(first, parts), first + parts


def _visits(tree: Split | Cell, own: np.ndarray, up: int, down: int) -> Iterator[tuple[np.ndarray, Cell]]:
    """Which words reach which cells, within ``up`` marks more and ``down`` marks less."""
    todo = [(tree, np.arange(len(own)), np.uint64(0), np.uint64(0))]
    while todo:
        node, rows, must, never = todo.pop()
        near = (np.bitwise_count(must & ~own[rows]) <= up) & (np.bitwise_count(never & own[rows]) <= down)
        rows = rows[near]
        if not len(rows):
            continue
        if isinstance(node, Cell):
            yield rows, node
            continue
        bit = np.uint64(1) << np.uint64(node.bit)
        other = np.uint64(1) << np.uint64(node.bit ^ DIMENSIONS)
        # What occurs twice occurs, and what doesn't occur doesn't occur twice.
        todo.append((node.having, rows, must | bit | (other if node.bit >= DIMENSIONS else np.uint64(0)), never))
        todo.append((node.without, rows, must, never | bit | (other if node.bit < DIMENSIONS else np.uint64(0))))


def _route(batches: Iterator[pa.RecordBatch], forest: dict[int, Split | Cell]) -> Iterator[pa.RecordBatch]:
    """Every word to its own cell, and as a question to all others that may hold words
    near it: those of its length from its own cell on, and those of the next length."""
    alone = Cell(0, 1)
    for batch in batches:
        words = np.array(batch.column(0).to_pylist(), object)
        counts = batch.column(1).to_numpy(zero_copy_only=False)
        sizes = np.array([len(word) for word in words], np.int64)
        for size in np.unique(sizes).tolist():
            rows = np.flatnonzero(sizes == size)
            own = marks(letters(words[rows].tolist(), size))
            home = np.zeros(len(rows), np.int64)
            at = [np.arange(len(rows))]
            for found, cell in _visits(forest.get(size, alone), own, 0, 0):
                part = np.array([hash_of(word) % cell.parts for word in words[rows[found]]], np.int64)
                home[found] = cell.first + part
            cells, roles, lengths = [home], [np.full(len(rows), POINT)], [np.full(len(rows), size)]
            for role, length, down in ((SAME, size, 1), (SHORTER, size + 1, 0)):
                for found, cell in _visits(forest.get(length, alone), own, 1, down):
                    for number in range(cell.first, cell.first + cell.parts):
                        asks = found[home[found] < number] if role == SAME else found
                        at.append(asks)
                        cells.append(np.full(len(asks), number))
                        roles.append(np.full(len(asks), role))
                        lengths.append(np.full(len(asks), length))
            index = rows[np.concatenate(at)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate(lengths), pa.int32()),
                    pa.array(np.concatenate(cells), pa.int64()),
                    pa.array(np.concatenate(roles), pa.int32()),
                    pa.array(words[index].tolist(), pa.string()),
                    pa.array(counts[index], pa.int64()),
                ],
                ["length", "cell", "role", "word", "n"],
            )


def hash_of(word: str) -> int:
    """A number that is the same in every worker."""
    return int.from_bytes(word.encode("utf-32-le"), "little") % 2147483647


def _one_replaced(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a != b).sum(1) == 1


def _one_more(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Rows of ``long`` without one letter are those of ``short``."""
    head = np.logical_and.accumulate(short == long[:, :-1], axis=1).sum(1)
    tail = np.logical_and.accumulate((short == long[:, 1:])[:, ::-1], axis=1).sum(1)
    return head + tail >= short.shape[1]


def _pairs(own: np.ndarray, points: np.ndarray, same: np.ndarray, shorter: np.ndarray):
    """Candidates ``(is_same, askers, points)`` by range search over the tree of points."""
    todo = [(points, same, shorter)]
    while todo:
        points, same, shorter = todo.pop()
        low = np.bitwise_and.reduce(own[points])
        high = np.bitwise_or.reduce(own[points])
        up = lambda rows: np.bitwise_count(low & ~own[rows])
        down = lambda rows: np.bitwise_count(own[rows] & ~high)
        same = same[(up(same) <= 1) & (down(same) <= 1)]
        shorter = shorter[(up(shorter) <= 1) & (down(shorter) == 0)]
        if not len(same) and not len(shorter):
            continue
        if len(points) > LEAF and low != high:
            _, has = _best_bit(own[points])
            todo += [(points[has], same, shorter), (points[~has], same, shorter)]
            continue
        for rows, is_same, steps in ((same, True, 2), (shorter, False, 1)):
            for start in range(0, len(points), LEAF):
                some = points[start : start + LEAF]
                stripe = max(1, PAIRS // len(some))
                for first in range(0, len(rows), stripe):
                    asks = rows[first : first + stripe]
                    apart = np.bitwise_count(own[asks][:, None] ^ own[some][None, :])
                    i, j = np.nonzero(apart <= steps)
                    if len(i):
                        yield is_same, asks[i], some[j]


def _search(cell: pa.Table) -> pa.Table:
    """Per word of a cell, how many near words it has here and the best of them."""
    length = cell.column("length")[0].as_py()
    cell = cell.sort_by([("role", "ascending"), ("word", "ascending")])
    role = cell.column("role").to_numpy()
    words = cell.column("word").to_pylist()
    n = cell.column("n").to_numpy()
    split = int(np.searchsorted(role, SHORTER))
    points = int(np.searchsorted(role, SAME))
    full = letters(words[:split], length)
    short = letters(words[split:], length - 1)
    own = np.concatenate([marks(full), marks(short)])
    order = np.lexsort((np.array(words, object), -n))
    place = np.empty(len(words), np.int64)
    place[order] = np.arange(len(words))
    near = np.zeros(len(words), np.int64)
    best = np.full(len(words), len(words), np.int64)
    most = max(1, (PAIRS * 8) // length)
    every = np.arange(len(words))
    for is_same, asks, held in _pairs(own, every[:points], every[:split], every[split:]):
        if is_same:
            once = (asks >= points) | (asks < held)
            asks, held = asks[once], held[once]
        for at in range(0, len(asks), most):
            a, b = asks[at : at + most], held[at : at + most]
            sure = _one_replaced(full[a], full[b]) if is_same else _one_more(short[a - split], full[b])
            a, b = a[sure], b[sure]
            np.add.at(near, a, 1)
            np.add.at(near, b, 1)
            np.minimum.at(best, a, place[b])
            np.minimum.at(best, b, place[a])
    got = np.flatnonzero(near)
    top = order[best[got]]
    return pa.table(
        {
            "word": pa.array([words[i] for i in got], pa.string()),
            "near": pa.array(near[got], pa.int64()),
            "best_n": pa.array(n[top], pa.int64()),
            "best": pa.array([words[i] for i in top], pa.string()),
        }
    )


def near_words(words: DataFrame) -> DataFrame:
    """``word``, ``n``, ``near`` (how many words of the table differ from it by exactly one
    code point put in, taken out or replaced), ``best`` (the one of them with the largest
    ``n``, of equals the first in code-point order) and ``best_n``; 0 and null without any.

    ``words`` has distinct, non-null ``word`` and ``n``; it is read several times, so it
    should be stored. The tree that deals words out to cells is grown from a bounded
    sample, but holds for all words: a word goes to one cell, and asks in all cells whose
    box is within reach, so no pair is lost and none is counted twice.
    """
    ship(words.sparkSession)
    total = words.count()
    # One in so many by hash, so that tasks send no more than their share of the sample.
    one_in = max(1, total // SAMPLE)
    drawn = F.pmod(F.xxhash64("word", F.lit(5)), F.lit(one_in)) == 0
    sample: dict[int, list[str]] = {}
    for row in words.where(drawn).select("word").orderBy("word").collect():
        sample.setdefault(len(row["word"]), []).append(row["word"])
    forest = {size: grow(marks(letters(some, size)), one_in)[0] for size, some in sample.items()}
    routed = words.select("word", "n").mapInArrow(partial(_route, forest=forest), ROUTED)
    found = (
        routed.groupBy("length", "cell")
        .applyInArrow(_search, FOUND)
        .groupBy("word")
        .agg(F.sum("near").alias("near"), F.min(F.struct((-F.col("best_n")).alias("less"), "best")).alias("top"))
    )
    return words.select("word", "n").join(found, "word", "left").select(
        "word",
        "n",
        F.coalesce("near", F.lit(0).cast("long")).alias("near"),
        F.col("top.best").alias("best"),
        (-F.col("top.less")).alias("best_n"),
    )


def follow(steps: DataFrame) -> DataFrame:
    """``word`` and ``root``, the end of its chain, for the rows of ``steps`` (``word``,
    ``to``). Chains must end; each round halves what is left of them."""
    at = stored(steps.select("word", F.col("to").alias("root")), "roots")
    while True:
        beyond = at.select(F.col("word").alias("up"), F.col("root").alias("top"))
        at = stored(
            at.join(beyond, F.col("root") == F.col("up"), "left").select(
                "word", F.coalesce("top", "root").alias("root"), F.col("top").isNotNull().alias("moved")
            ),
            "roots",
        )
        if at.where("moved").isEmpty():
            return at.select("word", "root")
        at = at.select("word", "root")


def variants(words: DataFrame, times: int = 2) -> DataFrame:
    """``word``, ``n``, ``near``, ``form``, ``form_n`` and ``root`` of every row of
    ``words`` (distinct ``word`` with its count ``n``).

    The form is the most frequent near word, if it is at least ``times`` as frequent
    (``times`` > 1, so that chains of forms end); following forms to the last gives the
    root, the word itself without a form. Null words are left out; an empty table gives
    no rows; other columns are not looked at.
    """
    words = stored(words.select("word", F.col("n").cast("long").alias("n")).where("word IS NOT NULL AND word <> ''"), "words")
    rated = near_words(words).withColumn("has_form", F.col("best_n") >= times * F.col("n"))
    rated = stored(rated, "near_words")
    roots = follow(rated.where("has_form").select("word", F.col("best").alias("to")))
    return rated.join(roots, "word", "left").select(
        "word",
        "n",
        "near",
        F.when(F.col("has_form"), F.col("best")).alias("form"),
        F.when(F.col("has_form"), F.col("best_n")).alias("form_n"),
        F.coalesce("root", "word").alias("root"),
    )


def small_letters(word: Column) -> Column:
    """``word`` with A-Z as a-z and nothing else changed."""
    large = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.lower(word) == word, word).otherwise(F.translate(word, large, large.lower()))


def words_in(docs: DataFrame, id: str = "doc_id", text: str = "text", shortest: int = 5) -> DataFrame:
    """``id`` (as text, empty for null) and ``run``, each maximal run of ``shortest`` or
    more letters of every text, with A-Z as a-z. Null and empty texts have none; repeated
    rows count again."""
    # Fixed value: the letters that make up runs.
    run = F.lit("[A-Za-zÀ-ÿ]{%d,}" % shortest)
    return docs.select(
        F.coalesce(F.col(id).cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all(F.col(text), run, F.lit(0))).alias("run"),
    ).select("id", small_letters(F.col("run")).alias("run"))


def counted(words: DataFrame, shortest: int = 5, rarest: int = 3) -> DataFrame:
    """Distinct ``word`` of at least ``shortest`` code points with its count ``n``, from
    ``rarest`` on. A word that fills a third of all rows is one row per map task."""
    long = words.where(F.char_length("word") >= shortest)
    return long.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= rarest)
