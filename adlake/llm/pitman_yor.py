"""Language-model scores from a hierarchical Pitman-Yor process over preceding words.

Every word that occurs before another has a restaurant of the words that follow it. A
table there is a customer of the restaurant that all words share, and a table of that
draws from even probabilities over the known words and one unknown word. What follows
an unknown word is drawn from the shared restaurant. A text begins after the end of
another.

Seatings are sampled by Gibbs: all customers of one dish leave and sit down anew, given
all others. Probabilities need only numbers of customers and of tables, so these are what
is drawn, by generalised Stirling numbers, of large dishes by close approximations. A pair of words met once has one customer at one table whatever is drawn;
it costs no seat. Predictive probabilities are averaged over the seatings kept.

Pairs lie in buckets by hash, so a frequent word has its pairs in all of them, and words
in parts by hash. A sweep is two shuffles of messages: buckets send the words they hold
with their tables, summed per word, and parts answer with the totals. Texts are read
once, in blocks; a block asks for each of its pairs and words once. Words and pairs are
told apart by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as dataset
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adlake.llm.common import filesystem, ship, shuffles_dropped, small_batches
from adlake.sources import shared_dir

#: Sweeps over all pairs, and how many of them come before the first seating kept. The
#: start, one table for each pair, is that of Kneser and Ney's counts; a seating kept must
#: be some sweeps away from it.
SWEEPS = 8
BURN_IN = 5

#: Concentration of every restaurant of a preceding word, and of the shared one.
THETA = 1.0
THETA_TOP = 10.0

#: Customers of a dish up to which tables are drawn by exact Stirling numbers.
EXACT = 1024

#: Bytes of text of a block, unless one text is longer, and tokens aimed at per bucket.
BLOCK_BYTES = 20 << 20
BUCKET = 3_500_000

END = xxhash.xxh64_intdigest(b"")

BLOCKS = (
    "block long, tokens long, ids array<long>, held array<boolean>, lengths array<long>, "
    "codes binary, words binary"
)
ROW = "kind string, to long, of long, keys binary, c binary, x binary, y binary, z binary, facts array<long>"


def _arrow(schema: str) -> pa.Schema:
    kinds = {
        "string": pa.string(),
        "long": pa.int64(),
        "double": pa.float64(),
        "boolean": pa.bool_(),
        "binary": pa.binary(),
        "array<long>": pa.list_(pa.int64()),
        "array<boolean>": pa.list_(pa.bool_()),
    }
    return pa.schema([(name, kinds[kind]) for name, kind in map(str.split, schema.split(", "))])


def _pack(values: np.ndarray) -> bytes:
    """Integers from 0 on in as few bytes as the largest takes, compressed. Hashes, which
    rise, as steps. Both byte by byte: the higher bytes of most are empty."""
    if values.dtype == np.uint64:
        return _planes(np.diff(values, prepend=np.uint64(0)))
    small = values.astype(np.min_scalar_type(int(values.max(initial=0))))
    return bytes([small.itemsize]) + _planes(small)


def _planes(values: np.ndarray) -> bytes:
    width = values.itemsize
    planes = values.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _of_planes(data: bytes, width: int) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(f"<u{width}").ravel()


def _ints(data: bytes) -> np.ndarray:
    return _of_planes(data[1:], data[0]).astype(np.int64)


def _hashes(data: bytes) -> np.ndarray:
    return np.cumsum(_of_planes(data, 8), dtype=np.uint64)


def _row(kind: str, to: int, of: int | None = None, facts: list[int] | None = None, **columns) -> dict:
    return {"kind": kind, "to": to, "of": of, "facts": facts} | {k: _pack(v) for k, v in columns.items()}


def _table(rows: list[dict]) -> pa.Table:
    return pa.Table.from_pylist(rows, _arrow(ROW))


def _rows(table: pa.Table, kind: str) -> list[dict]:
    """Rows of one kind, in the order of their senders."""
    rows = table.filter(pc.equal(table.column("kind"), kind)).to_pylist()
    return sorted(rows, key=lambda row: -1 if row["of"] is None else row["of"])


# -- texts ----------------------------------------------------------------------------


def tokens(text: str | None) -> list[bytes]:
    """Words of the lower-cased text; the end is the empty word."""
    return [*(text or "").encode().lower().split(), b""]


def pair_hash(before: np.ndarray, words: np.ndarray) -> np.ndarray:
    """One hash of two."""
    mixed = before * np.uint64(0x9E3779B97F4A7C15) + words
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return mixed ^ (mixed >> np.uint64(32))


def _block(parts: list[pa.RecordBatch], number: int) -> dict:
    """Texts as places in the sorted hashes of the words that occur in them."""
    whole = pa.Table.from_batches(parts).combine_chunks()
    texts = pc.ascii_lower(pc.fill_null(whole.column("text"), "")).combine_chunks()
    split = pc.ascii_split_whitespace(texts)
    # A text that begins or ends with white space has an empty piece there.
    pieces = pc.list_flatten(split)
    real = pc.greater(pc.binary_length(pieces), 0).to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), pc.list_value_length(split).to_numpy())[real]
    lengths = np.bincount(owner, minlength=len(texts)) + 1
    coded = pieces.filter(pa.array(real)).dictionary_encode()
    del texts, split, pieces, real, owner
    listed = coded.dictionary.cast(pa.binary()).to_pylist()
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, listed), np.uint64, len(listed))
    keys, place = np.unique(np.append(hashes, np.uint64(END)), return_inverse=True)
    codes = np.full(lengths.sum(), place[-1], np.int32)
    ends = np.zeros(len(codes), bool)
    ends[np.cumsum(lengths) - 1] = True
    codes[~ends] = place[coded.indices.to_numpy()]
    return {
        "block": number,
        "tokens": len(codes),
        "ids": whole.column("id").to_pylist(),
        "held": whole.column("held_out").to_pylist(),
        "lengths": lengths.tolist(),
        "codes": _pack(codes),
        "words": _pack(keys),
    }


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId() << 32
    held: list[pa.RecordBatch] = []
    size = 0

    def flush() -> pa.RecordBatch:
        row = _block(held, number)
        held.clear()
        return pa.RecordBatch.from_pylist([row], _arrow(BLOCKS))

    for batch in small_batches(batches, 2, 2 << 20):
        held.append(batch)
        size += pc.sum(pc.binary_length(batch.column(2))).as_py() or 0
        if size >= BLOCK_BYTES:
            yield flush()
            number, size = number + 1, 0
    if held:
        yield flush()


@dataclass(frozen=True)
class Pairs:
    """The distinct pairs of a block, as places of both words in the block's ``keys``;
    where each token's pair is; and the tokens' texts."""

    keys: np.ndarray
    before: np.ndarray
    words: np.ndarray
    of_token: np.ndarray
    text_of: np.ndarray
    bucket: np.ndarray

    @classmethod
    def of(cls, row: dict, buckets: int) -> Pairs:
        keys = _hashes(row["words"])
        codes = _ints(row["codes"])
        # The last token before a text is the end of another, or of this block's last.
        codes = np.roll(codes, 1) * len(keys) + codes
        order = np.argsort(codes)
        codes = codes[order]
        new = np.append(True, codes[1:] != codes[:-1])
        of_token = np.empty(len(codes), np.int32)
        of_token[order] = np.cumsum(new, dtype=np.int32) - 1
        del order
        before, words = np.divmod(codes[new], len(keys))
        del codes
        text_of = np.repeat(np.arange(len(row["lengths"]), dtype=np.int32), row["lengths"])
        bucket = (pair_hash(keys[before], keys[words]) % np.uint64(buckets)).astype(np.int64)
        return cls(keys, before, words, of_token, text_of, bucket)


def _dealt(part: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each part that has any, the places of what belongs to it, in order."""
    # Numbers of two bytes are sorted by counting.
    order = np.argsort(part.astype(np.uint16) if parts <= 1 << 16 else part, kind="stable")
    ends = np.searchsorted(part[order], np.arange(parts + 1))
    for at in range(parts):
        if ends[at] < ends[at + 1]:
            yield at, order[ends[at] : ends[at + 1]]


def _sparse(keys: np.ndarray, before: np.ndarray, words: np.ndarray) -> dict:
    """Columns for pairs of places in ``keys``: the hashes needed, and places in these.
    The places before rise, so they are written as steps."""
    used, place = np.unique(np.concatenate([before, words]), return_inverse=True)
    first, second = np.split(place, 2)
    return {"keys": keys[used], "x": np.diff(first, prepend=0), "y": second}


def _dense(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return _hashes(row["keys"]), np.cumsum(_ints(row["x"])), _ints(row["y"])


def _by_word(keys: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    return _dealt((keys % np.uint64(parts)).astype(np.int64), parts)


def _ask_pairs(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """The pairs of a block, with how often they are to be learnt from."""
    for batch in batches:
        for row in batch.to_pylist():
            pairs = Pairs.of(row, buckets)
            learnt = ~np.array(row["held"], bool)[pairs.text_of]
            n = np.bincount(pairs.of_token[learnt], minlength=len(pairs.before))
            for to, mine in _dealt(pairs.bucket, buckets):
                met = _sparse(pairs.keys, pairs.before[mine], pairs.words[mine])
                yield from _table([_row("asked", to, row["block"], c=n[mine], **met)]).to_batches()


def _ask_words(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            keys = _hashes(row["words"])
            for to, mine in _by_word(keys, parts):
                yield from _table([_row("asked", to, row["block"], keys=keys[mine])]).to_batches()


# -- seats ----------------------------------------------------------------------------


def discount(once: int, twice: int) -> float:
    """The usual estimate from how many dishes were ordered once and twice."""
    return min(0.95, max(0.05, once / (once + 2 * twice))) if once else 0.5


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function of positive numbers."""
    far = x + 8
    series = (far - 0.5) * np.log(far) - far + 0.5 * np.log(2 * np.pi)
    series += 1 / (12 * far) - 1 / (360 * far**3) + 1 / (1260 * far**5) - 1 / (1680 * far**7)
    return series - np.log(math.prod(x + k for k in range(8)))


@lru_cache(4)
def stirling(d: float, most: int) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers: in how many ways, by weight, so
    many customers (down) sit at so many tables (across)."""
    ways = np.full((most + 1, most + 1), -np.inf)
    ways[1, 1] = 0.0
    tables = np.arange(most + 1)
    for seated in range(1, most):
        stay = ways[seated] + np.log(np.maximum(seated - d * tables, 1e-300))
        ways[seated + 1] = np.logaddexp(stay, np.append(-np.inf, ways[seated][:-1]))
    return ways


def _saddle(counts: np.ndarray, tables: np.ndarray, d: float) -> np.ndarray:
    """Saddle point of the generating function ``((1 - (1 - z) ** d) / d) ** tables``."""
    low, high = np.full(tables.shape, -700.0), np.zeros(tables.shape)
    for _ in range(60):  # of log(1 - z)
        mid = (low + high) / 2
        slope = tables * d * np.exp(mid * (d - 1)) / -np.expm1(mid * d) - counts / np.maximum(-np.expm1(mid), 1e-300)
        low, high = np.where(slope > 0, mid, low), np.where(slope > 0, high, mid)
    v, z, rest = np.exp(low), np.maximum(-np.expm1(low), 1e-300), -np.expm1(low * d)
    first = d * np.exp(low * (d - 1)) / rest
    bend = tables * ((1 - d) * first / v - first**2) + counts / z**2
    level = tables * np.log(rest) - counts * np.log(z)
    return log_gamma(counts + 1.0) + level - 0.5 * np.log(2 * np.pi * z**2 * np.maximum(bend, 1e-300))


def _series(counts: np.ndarray, tables: np.ndarray, d: float) -> np.ndarray:
    """The same coefficient by the binomial series, whose terms are below one while
    tables are fewer than ``counts ** d``."""
    term, total, before = np.ones(tables.shape), np.zeros(tables.shape), log_gamma(counts)
    for k in range(1, int(min(160, counts.min(initial=320) / 2))):
        after = log_gamma(counts - d * k)
        term = term * ((tables - k + 1) / k) * np.exp(after - before)
        before = after
        factor = math.gamma(1 + d * k) / math.pi
        total += term * (factor * math.sin(math.pi * d * k) * (-1) ** (k + 1))
        if np.abs(term).max(initial=0) * factor < 1e-14:
            break
    return log_gamma(counts) + np.log(np.maximum(total, 1e-300))


def log_stirling(counts: np.ndarray, tables: np.ndarray, d: float) -> np.ndarray:
    """The same for hundreds of customers and more (``counts``, one per row of
    ``tables``), by the series where it is sound and the saddle point beyond."""
    wide = np.broadcast_to(counts[:, None], tables.shape)
    few = tables < wide**d
    found = np.empty(tables.shape)
    found[few] = _series(wide[few], tables[few], d)
    found[~few] = _saddle(wide[~few], tables[~few], d)
    return found - log_gamma(tables + 1.0) - tables * math.log(d)


def _draw_many(counts: np.ndarray, room: np.ndarray, p: np.ndarray, d: float, rng) -> np.ndarray:
    """Tables of large dishes: the weights have one peak, which is found by halving, and
    a draw is from up to 129 cells over six deviations to both sides of it."""

    def weight(t: np.ndarray) -> np.ndarray:
        cells = t.reshape(len(counts), -1)
        found = log_stirling(counts, cells, d) + cells * np.log(d * p[:, None]) + log_gamma(room[:, None] + cells)
        return found.reshape(t.shape)

    low, high = np.ones(len(counts)), counts - 1.0
    while (low < high).any():
        mid = np.floor((low + high) / 2)
        rises = weight(mid + 1) > weight(mid)
        low, high = np.where(rises & (low < high), mid + 1, low), np.where(rises, high, np.minimum(high, mid))
    step = np.maximum(1, np.floor(np.sqrt(low) / 2))
    peak = np.maximum(low, step + 1)
    bend = 2 * weight(peak) - weight(peak - step) - weight(np.minimum(peak + step, counts - 1))
    spread = np.clip(step / np.sqrt(np.maximum(bend, 1e-12)), 1, counts)
    cell = np.maximum(1, np.ceil(6 * spread / 64))
    at = low[:, None] + cell[:, None] * np.arange(-64, 65)
    inside = (at >= 1) & (at < counts[:, None])
    level = np.where(inside, weight(np.clip(at, 1, counts[:, None] - 1)), -np.inf)
    total = np.cumsum(np.exp(level - level.max(1, keepdims=True)), axis=1)
    place = (total < (rng.random(len(at)) * total[:, -1])[:, None]).sum(1)
    within = np.floor((rng.random(len(at)) - 0.5) * cell + 0.5)
    return np.clip(at[np.arange(len(at)), place] + within, 1, counts - 1)


def draw_tables(
    counts: np.ndarray, others: np.ndarray, p: np.ndarray, theta: float, d: float, rng
) -> np.ndarray:
    """Tables of dishes, each drawn given the ``others`` of its restaurant's tables.

    The weight of t tables is the Stirling number, times the parent's probability ``p``
    for every table, times ``theta`` and ``d`` for each table there is before.
    """
    drawn = np.minimum(counts, 1).astype(np.int64)
    room = theta / d + others
    few = np.flatnonzero((counts > 1) & (counts <= EXACT))
    few = few[np.argsort(counts[few], kind="stable")]
    most = int(counts[few[-1]]) if len(few) else 1
    ways = stirling(d, 1 << (most - 1).bit_length())
    ends = np.searchsorted(counts[few], np.arange(most + 2))
    c = 1
    while c < most:
        # Dishes of about as many customers at once; more tables than customers weigh nothing.
        least, c = c + 1, min(most, c + 1 + c // 8)
        rows = max(1, 1_000_000 // c)
        for at in range(ends[least], ends[c + 1], rows):
            mine = few[at : min(at + rows, ends[c + 1])]
            weight = np.zeros((len(mine), c))
            grow = np.log(d * p[mine, None] * (room[mine, None] + np.arange(1, c)))
            np.cumsum(grow, axis=1, out=weight[:, 1:])
            weight += ways[counts[mine], 1 : c + 1]
            total = np.cumsum(np.exp(weight - weight.max(1, keepdims=True)), axis=1)
            aim = rng.random(len(mine)) * total[:, -1]
            drawn[mine] = 1 + (total < aim[:, None]).sum(1)
    many = np.flatnonzero(counts > EXACT)
    for at in range(0, len(many), 4096):
        mine = many[at : at + 4096]
        drawn[mine] = _draw_many(counts[mine].astype(float), room[mine], p[mine], d, rng)
    return drawn


@dataclass(frozen=True)
class Shared:
    """What all restaurants share: tokens learnt from, distinct words, the discounts,
    and the shared restaurant's customers and tables in one seating."""

    customers: int
    kinds: int
    d: float
    d_top: float
    served: int
    held: int

    def top(self, served: np.ndarray, held: np.ndarray) -> np.ndarray:
        """Probability in the shared restaurant of words with these customers and tables."""
        new = (THETA_TOP + self.d_top * self.held) / (self.kinds + 1)
        return (served - self.d_top * held + new) / (THETA_TOP + self.served)

    def after(self, n, tables, context, context_tables, top):
        """Probability of words with ``n`` customers at ``tables`` after a word with
        ``context`` customers at ``context_tables``."""
        room = THETA + self.d * context_tables
        return (n - self.d * tables + room * top) / (THETA + context)


def _up(bucket: int, keys, before, words, tables, parts: int) -> list[dict]:
    """For each part the tables of a bucket after its words, and those of its words."""
    after, of = [np.bincount(at, tables, len(keys)).astype(np.int64) for at in (before, words)]
    return [_row("up", to, bucket, keys=keys[m], x=after[m], y=of[m]) for to, m in _by_word(keys, parts)]


def _count(rows: pa.Table, parts: int) -> pa.Table:
    """Of one bucket: the pairs met more than once, what all pairs add to their words,
    and for every block how often its pairs are met, 2 standing for more, and where those are."""
    asked = _rows(rows, "asked")
    bucket = asked[0]["to"]
    met = [np.stack([keys[first], keys[second]]) for keys, first, second in map(_dense, asked)]
    ends = np.cumsum([pairs.shape[1] for pairs in met])[:-1]
    met = np.concatenate(met, axis=1)
    _, first, place = np.unique(pair_hash(*met), return_index=True, return_inverse=True)
    counts = np.bincount(place, np.concatenate([_ints(row["c"]) for row in asked])).astype(np.int64)
    keys, at = np.unique(met[:, first].ravel(), return_inverse=True)
    del met
    before, words = np.split(at, 2)
    order = np.argsort(before * len(keys) + words)
    often = order[counts[order] > 1]
    found = np.minimum(counts, 1)
    found[often] = 2 + np.arange(len(often))
    out = []
    for row, mine in zip(asked, np.split(found[place], ends), strict=True):
        # Pairs come in one order everywhere, so places rise and are written as steps.
        seats = (mine[mine > 1] - 2).astype(np.uint64)
        out.append(_row("place", bucket, row["of"], keys=seats, x=np.minimum(mine, 2)))
    one = counts == 1
    sums = [np.bincount(words, counts, len(keys)).astype(np.int64)]
    sums += [np.bincount(of[one], minlength=len(keys)) for of in (before, words)]
    known = np.zeros(len(keys), bool)
    known[before[counts > 0]] = known[words[counts > 0]] = True
    sums = [values[known] for values in sums]
    for to, m in _by_word(keys[known], parts):
        out.append(_row("first", to, bucket, keys=keys[known][m], c=sums[0][m], x=sums[1][m], y=sums[2][m]))
    pairs = _sparse(keys, before[often], words[often])
    tables = np.ones(len(often), np.int64)
    out += _up(bucket, pairs["keys"], np.cumsum(pairs["x"]), pairs["y"], tables, parts)
    facts = [int(one.sum()), int((counts == 2).sum())]
    out.append(_row("pairs", bucket, facts=facts, c=counts[often], z=tables, **pairs))
    return _table(out)


def _word_step(rows: pa.Table, shared: Shared | None, seed: int, keep: bool) -> pa.Table:
    """Of one part of the words: sums up the tables of all restaurants, draws those of
    the shared one, and answers every bucket. Without ``shared`` it begins, a table each."""
    part = rows.column("to")[0].as_py()
    state, firsts = _rows(rows, "words"), _rows(rows, "first")
    if state:
        (state,) = state
        keys, c, held = _hashes(state["keys"]), _ints(state["c"]), _ints(state["y"])
        once, kept = _ints(state["x"]).reshape(2, -1), _ints(state["z"])
    else:
        every = [_hashes(row["keys"]) for row in firsts]
        keys, place = np.unique(np.concatenate([*every, np.zeros(0, np.uint64)]), return_inverse=True)
        sums = np.zeros((3, len(keys)), np.int64)
        for values, name in zip(sums, "cxy", strict=True):
            np.add.at(values, place, np.concatenate([*[_ints(row[name]) for row in firsts], sums[0, :0]]))
        c, once, held, kept = sums[0], sums[1:], np.ones(len(keys), np.int64), sums[0, :0]
    after, served = once[0].copy(), once[1].copy()
    messages = _rows(rows, "up")
    places = [np.searchsorted(keys, _hashes(row["keys"])) for row in messages]
    for row, at in zip(messages, places, strict=True):
        after[at] += _ints(row["x"])
        served[at] += _ints(row["y"])
    if shared and len(keys):
        rng = np.random.default_rng([seed, part])
        held = np.minimum(held, served)
        even = np.full(len(keys), 1 / (shared.kinds + 1))
        held = draw_tables(served, np.maximum(shared.held - held, 0), even, THETA_TOP, shared.d_top, rng)
    if keep:
        kept = np.concatenate([kept, after, served, held])
    facts = [len(keys), c.sum(), (served == 1).sum(), (served == 2).sum(), served.sum(), held.sum()]
    out = [_row("words", part, facts=[int(x) for x in facts], keys=keys, c=c, x=once.ravel(), y=held, z=kept)]
    for row, at in zip(messages, places, strict=True):
        out.append(_row("down", row["of"], part, x=after[at], y=served[at], z=held[at]))
    return _table(out)


def _pair_step(rows: pa.Table, shared: Shared, parts: int, seed: int, first: bool) -> pa.Table:
    """Of one bucket: draws the tables of its pairs, given the answers of all parts. They
    are added to those before, or replace them if ``first``."""
    (state,) = _rows(rows, "pairs")
    bucket = state["to"]
    keys, before, words = _dense(state)
    counts, kept = _ints(state["c"]), _ints(state["z"])
    tables = kept[len(kept) - len(counts) :]
    answers = {row["of"]: row for row in _rows(rows, "down")}
    after, served, held = np.zeros((3, len(keys)), np.int64)
    for part, mine in _by_word(keys, parts):
        for name, values in zip("xyz", (after, served, held), strict=True):
            values[mine] = _ints(answers[part][name])
    top = shared.top(served, held)[words]
    rng = np.random.default_rng([seed, bucket, 1])
    tables = draw_tables(counts, after[before] - tables, top, THETA, shared.d, rng)
    out = _up(bucket, keys, before, words, tables, parts)
    kept = tables if first else np.concatenate([kept, tables])
    out.append(state | {"z": _pack(kept)})
    return _table(out)


def _grouped(rows: DataFrame, step: Callable[[pa.Table], pa.Table], parts: int) -> DataFrame:
    def run(group: pa.Table) -> pa.Table:
        return step(group)

    # Each bucket or part is a task; a column, as grouping by what it is cast from shuffles again.
    at = rows.withColumn("task", F.col("to").cast("int"))
    return at.repartitionById(parts, "task").groupBy("task").applyInArrow(run, ROW)


def _facts(rows: DataFrame, kind: str, many: int) -> list[int]:
    """Sums over all rows of one kind of each fact they state."""
    sums = [F.coalesce(F.sum(F.get("facts", F.lit(i))), F.lit(0)) for i in range(many)]
    return list(rows.where(F.col("kind") == kind).select(*[s.alias(f"s{i}") for i, s in enumerate(sums)]).first())


def _kinds(rows: DataFrame, *kinds: str) -> DataFrame:
    return rows.where(F.col("kind").isin(*kinds))


@dataclass(frozen=True)
class Model:
    """The texts' blocks; where their pairs are; all pairs and words with the seatings
    kept; what each of these seatings shares; and the folders of the sweep before the last,
    which nothing reads any more."""

    blocks: DataFrame
    places: DataFrame
    pairs: DataFrame
    words: DataFrame
    seatings: list[Shared]
    parts: int
    spare: dict[str, str]


def _stored(df: DataFrame, path: str) -> DataFrame:
    """``df`` written to ``path``, in place of what was there, and read again."""
    spark = df.sparkSession
    with shuffles_dropped(spark):
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def learn(docs: DataFrame) -> Model:
    """A model of the rows of ``docs`` (``id``, ``held_out``, ``text``) not held out.

    A sweep reads nothing but the one before it, so sweeps are stored in two places in
    turn, and the disk they take does not depend on how many there are.
    """
    ship(docs.sparkSession)
    root = shared_dir(docs.sparkSession, "pitman_yor")
    blocks = _stored(docs.select("id", "held_out", "text").mapInArrow(_blocks, BLOCKS), f"{root}/blocks")
    total = blocks.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    parts = max(8, -(-total // BUCKET))
    asked = blocks.drop("ids", "tokens").mapInArrow(partial(_ask_pairs, buckets=parts), ROW)
    counted = _stored(_grouped(asked, partial(_count, parts=parts), parts), f"{root}/counts")
    places, pairs = _kinds(counted, "place"), counted
    d = discount(*_facts(counted, "pairs", 2))
    step = partial(_word_step, shared=None, seed=0, keep=False)
    words = _stored(_grouped(_kinds(counted, "first", "up"), step, parts), f"{root}/words0")
    kinds, customers, once, twice, served, held = _facts(words, "words", 6)
    shared = Shared(customers, kinds, d, discount(once, twice), served, held)
    kept = []
    for sweep in range(1, SWEEPS + 1):
        keep, slot = sweep > BURN_IN, sweep % 2
        step = partial(_pair_step, shared=shared, parts=parts, seed=sweep, first=sweep <= BURN_IN + 1)
        met = _kinds(pairs, "pairs").unionByName(_kinds(words, "down"))
        pairs = _stored(_grouped(met, step, parts), f"{root}/pairs{slot}")
        step = partial(_word_step, shared=shared, seed=sweep, keep=keep)
        told = _kinds(words, "words").unionByName(_kinds(pairs, "up"))
        words = _stored(_grouped(told, step, parts), f"{root}/words{slot}")
        *_, served, held = _facts(words, "words", 6)
        shared = Shared(customers, kinds, d, shared.d_top, served, held)
        if keep:
            kept.append(shared)
    spare = {name: f"{root}/{name}{1 - SWEEPS % 2}" for name in ("words", "pairs")}
    return Model(blocks, places, _kinds(pairs, "pairs"), _kinds(words, "words"), kept, parts, spare)


# -- scores ---------------------------------------------------------------------------


def _tell_words(rows: pa.Table, kept: int) -> pa.Table:
    """What a part knows of a block's words: their counts, and for each seating tables
    after them, and customers and tables in the shared restaurant."""
    state, out = _rows(rows, "words"), []
    keys = _hashes(state[0]["keys"]) if state else np.zeros(0, np.uint64)
    known = np.zeros((1 + 3 * kept, len(keys) + 1), np.int64)
    if state:
        known[0, :-1] = _ints(state[0]["c"])
        known[1:, :-1] = _ints(state[0]["z"]).reshape(3 * kept, -1)
    for row in _rows(rows, "asked"):
        mine = _hashes(row["keys"])
        at = np.searchsorted(keys, mine)
        at[np.append(keys, np.uint64(0))[at] != mine] = len(keys)
        out.append(_row("word", row["of"], row["to"], x=known[:, at].ravel()))
    return _table(out)


def _tell_pairs(rows: pa.Table, kept: int) -> pa.Table:
    """How often a bucket has met a block's pairs, 2 standing for more; and of these
    the customers, and the tables of each seating."""
    (state,) = _rows(rows, "pairs")
    known = np.vstack([_ints(state["c"]), _ints(state["z"]).reshape(kept, -1)])
    out = []
    for row in _rows(rows, "place"):
        often = known[:, _hashes(row["keys"]).astype(np.int64)]
        out.append(_row("pair", row["of"], row["to"], y=often.ravel()) | {"x": row["x"]})
    return _table(out)


SCORES = "id long, held_out boolean, n_tokens long, n_known long, base double, score double"


def _score(row: dict, told: pa.Table, seatings: list[Shared], parts: int) -> pa.RecordBatch:
    """Scores of the texts of one block, from what it has been told."""
    pairs = Pairs.of(row, parts)
    answers = {r["of"]: _ints(r["x"]) for r in _rows(told, "word")}
    words = np.zeros((1 + 3 * len(seatings), len(pairs.keys)), np.int64)
    for part, mine in _by_word(pairs.keys, parts):
        words[:, mine] = answers[part].reshape(len(words), -1)
    met = {r["of"]: r for r in _rows(told, "pair")}
    seats = np.zeros((1 + len(seatings), len(pairs.before)), np.int64)
    for bucket, mine in _dealt(pairs.bucket, parts):
        times = _ints(met[bucket]["x"])
        seats[:, mine] = times
        seats[:, mine[times > 1]] = _ints(met[bucket]["y"]).reshape(len(seats), -1)
    n = words[0]
    chance = np.zeros(len(pairs.before))
    for at, shared in enumerate(seatings):
        after, served, held = words[1 + 3 * at : 4 + 3 * at]
        top = shared.top(served, held)[pairs.words]
        chance += shared.after(seats[0], seats[1 + at], n[pairs.before], after[pairs.before], top)
    score = np.log10(chance / len(seatings))
    base = np.log10((n + 1) / (seatings[0].customers + seatings[0].kinds + 1))
    of_word = pairs.words[pairs.of_token]

    def per_text(values: np.ndarray) -> np.ndarray:
        return np.bincount(pairs.text_of, values, len(row["lengths"]))

    known = per_text((n > 0)[of_word]).astype(np.int64)
    columns = [row["ids"], row["held"], row["lengths"], known, per_text(base[of_word]), per_text(score[pairs.of_token])]
    schema = _arrow(SCORES)
    arrays = [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def _scores(
    batches: Iterator[pa.RecordBatch], told: list[str], seatings: list[Shared], parts: int
) -> Iterator[pa.RecordBatch]:
    folders = [filesystem(path) for path in told]
    for batch in batches:
        for row in batch.to_pylist():
            found = [
                dataset.dataset(f"{path}/block={row['block']}", _arrow(ROW), "parquet", filesystem=files)
                for files, path in folders
            ]
            yield _score(row, pa.concat_tables([part.to_table() for part in found]), seatings, parts)


def score(model: Model) -> DataFrame:
    """``id``, ``held_out``, ``n_tokens``, ``n_known``, ``base`` and ``score`` (log10) of
    every row the model was made with. What the blocks are told takes the place of the
    sweep before the last; scoring once more writes the same again."""
    kept = len(model.seatings)
    asked = model.blocks.select("block", "words").mapInArrow(partial(_ask_words, parts=model.parts), ROW)
    words = _grouped(model.words.unionByName(asked), partial(_tell_words, kept=kept), model.parts)
    pairs = _grouped(model.pairs.unionByName(model.places), partial(_tell_pairs, kept=kept), model.parts)
    # A block reads its own folders, so that the texts aren't shuffled to what they are told.
    # Words and pairs are written one after the other, and the shuffles of the first are gone
    # before the second begins.
    for rows, path in ((words, model.spare["words"]), (pairs, model.spare["pairs"])):
        answers = rows.withColumn("block", F.col("to")).repartition("block")
        with shuffles_dropped(model.blocks.sparkSession):
            answers.write.mode("overwrite").partitionBy("block").parquet(path)
    told = [model.spare["words"], model.spare["pairs"]]
    scored = partial(_scores, told=told, seatings=model.seatings, parts=model.parts)
    return model.blocks.drop("tokens").mapInArrow(scored, SCORES)


def held_out_of(id: Column) -> Column:
    """Rows that aren't learnt from: crc32 of the id as text leaves 2 modulo 7."""
    return F.crc32(F.coalesce(id.cast("string"), F.lit("")).cast("binary")) % 7 == 2


def score_corpus(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Scores of all rows by a model of those that aren't held out, with
    ``train_tokens`` and ``perplexity`` per token.

    Null text counts as empty and has its end only; a null id counts as empty text for
    the choice of held-out rows; repeated rows are learnt from and scored each; an empty
    table gives no rows, and with nothing to learn from only the unknown word is left.
    """
    rows = docs.select(
        F.col(id).cast("long").alias("id"), held_out_of(F.col(id)).alias("held_out"), F.col(text).alias("text")
    )
    model = learn(rows)
    return score(model).select(
        "*",
        F.lit(model.seatings[0].customers).cast("long").alias("train_tokens"),
        F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"),
    )
