"""What is new: by time, by key, or both.

The key decides and time only narrows the search, so a row is neither taken
twice nor forgotten when a run was cut short.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    BinaryType,
    BooleanType,
    DataType,
    DateType,
    DecimalType,
    IntegralType,
    StringType,
    TimestampNTZType,
    TimestampType,
)

from adlake import spec as S
from adlake.operators.clean import drop_null_keys, first_per_key
from adlake.sources.readers import has_rows, time_literal

# Most that the keys of a batch may take up for them to be broadcast, with the
# space a hash table needs for each of them.
BROADCAST_BYTES = 64 * 1024 * 1024
BYTES_PER_KEY = 32

# Words of 64 bits that the filter over a batch's keys has at most: some 50 MB as a hash
# table. It is given four keys a word, which lets 1 in 200 other keys through, and beyond
# its full size up to 16, which let through 1 in 6; with more it would sort out too little.
FILTER_WORDS = 1 << 20
KEYS_PER_WORD = 4
MOST_PER_WORD = 16


class KeyFilter(NamedTuple):
    """A Bloom filter over keys: of each key's word, the bits its hash stands for."""

    words: DataFrame
    size: int
    types: list[DataType]


class BatchKeys(NamedTuple):
    """What is known about the keys of a batch, from one aggregate over them."""

    rows: int
    size: int
    lowest: tuple
    highest: tuple
    few: DataFrame | None
    filter: KeyFilter | None = None


def high_water_mark(df: DataFrame, ts: str) -> DataFrame:
    """Latest time in ``df`` as one row; null if there is none."""
    return df.agg(F.max(ts).alias("high_water_mark"))


def newer_than(df: DataFrame, ts: str, target: DataFrame) -> DataFrame:
    """Rows later than everything in ``target``; all rows if it has no times.

    The mark is a scalar subquery: it is not fetched to the driver, keeps the
    type of the column, and still reaches the Parquet scan as a pushed filter.
    """
    known = target.select(ts).where(F.col(ts).isNotNull())
    if not has_rows(known):
        return df
    return df.where(F.col(ts) > high_water_mark(known, ts).scalar())


def ingested_after(df: DataFrame, mark: int | None) -> DataFrame:
    """Rows ingested after a layer's high-water mark (all without a mark)."""
    if mark is None:
        return df
    return df.where(F.col(S.INGESTED_AT) > time_literal(mark))


def distinct_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.select(*keys).distinct()


def _has_order(dtype: DataType) -> bool:
    """Types whose bounds mean the same to Python, Spark and Parquet."""
    return isinstance(dtype, (IntegralType, StringType, DateType))


def _word_and_bits(df: DataFrame, keys: Sequence[str], size: int) -> tuple[Column, Column]:
    """Which of ``size`` words a key belongs to, and up to four bits of that word. Whole
    numbers of any width that are equal have the same."""
    whole = [
        F.col(name).cast("long") if isinstance(df.schema[name].dataType, IntegralType) else F.col(name)
        for name in keys
    ]
    hashed = F.xxhash64(*whole)
    one, bits = F.lit(1).cast("long"), F.lit(0).cast("long")
    for place in range(0, 24, 6):
        bit = F.shiftright(hashed, place).bitwiseAND(F.lit(63)).cast("int")
        bits = bits.bitwiseOR(F.call_function("shiftleft", one, bit))
    return F.pmod(F.shiftright(hashed, 24), F.lit(size)), bits


def key_filter(df: DataFrame, keys: Sequence[str], rows: int, most: int = FILTER_WORDS) -> KeyFilter | None:
    """A filter over the keys of ``df``, which has ``rows`` rows; None if they are too many
    for ``most`` words. Tasks combine the bits of their own keys before the words meet."""
    if rows > most * MOST_PER_WORD:
        return None
    size = 1
    while size < most and size * KEYS_PER_WORD < rows:
        size *= 2
    word, bits = _word_and_bits(df, keys, size)
    words = (
        drop_null_keys(df, keys)
        .select(word.alias("__word"), bits.alias("__bits"))
        .groupBy("__word")
        .agg(F.bit_or("__bits").alias("__bits"))
    )
    return KeyFilter(words, size, [df.schema[name].dataType for name in keys])


def _hashed_alike(a: DataType, b: DataType) -> bool:
    """Whether keys of these types that a join finds equal have the same hash for sure."""
    if isinstance(a, IntegralType) and isinstance(b, IntegralType):
        return True
    plain = (BinaryType, BooleanType, DateType, DecimalType, TimestampType, TimestampNTZType)
    return a == b and (isinstance(a, plain) or a == StringType())


def may_be_in(df: DataFrame, keys: Sequence[str], batch: KeyFilter) -> DataFrame:
    """Rows of ``df`` whose key may be one of the batch's: all that are, and few others.

    The words are broadcast, no more rows than the filter has words, so rows go where they
    are scanned, ahead of any shuffle. Keys of types that might hash differently are kept.
    """
    if not all(_hashed_alike(df.schema[name].dataType, kind) for name, kind in zip(keys, batch.types)):
        return df
    word, bits = _word_and_bits(df, keys, batch.size)
    asked = df.select("*", word.alias("__of"), bits.alias("__asked"))
    met = (F.col("__of") == F.col("__word")) & (
        F.col("__bits").bitwiseAND(F.col("__asked")) == F.col("__asked")
    )
    return asked.join(F.broadcast(batch.words), met, "left_semi").select(*df.columns)


def measure_keys(
    df: DataFrame,
    keys: Sequence[str],
    broadcast_bytes: int = BROADCAST_BYTES,
    filter_words: int = FILTER_WORDS,
) -> BatchKeys:
    """Count the rows of a batch, size its keys and find their bounds.

    ``few`` are the keys themselves if they were measured to take no more than
    ``broadcast_bytes``, so that they may be broadcast. Else it is None, and ``filter``
    is a filter over them of at most ``filter_words`` words, None if that is too small.
    """
    width = F.lit(BYTES_PER_KEY)
    for name in keys:
        if isinstance(df.schema[name].dataType, (StringType, BinaryType)):
            width = width + F.coalesce(F.octet_length(name), F.lit(0))
    bounds = [
        bound(name) if _has_order(df.schema[name].dataType) else F.lit(None)
        for bound in (F.min, F.max)
        for name in keys
    ]
    rows, size, *bounds = df.agg(
        F.count(F.lit(1)), F.coalesce(F.sum(width), F.lit(0)).cast("long"), *bounds
    ).first()
    few = df.select(*keys) if size <= broadcast_bytes else None
    filter = None if few is not None else key_filter(df, keys, rows, filter_words)
    half = len(keys)
    return BatchKeys(rows, size, tuple(bounds[:half]), tuple(bounds[half:]), few, filter)


def within_bounds(df: DataFrame, keys: Sequence[str], batch: BatchKeys) -> DataFrame:
    """Rows whose keys lie between the lowest and highest of the batch.

    Reaches the Parquet scan, which skips row groups without such keys: most of
    a layer, where keys rise over time.
    """
    for name, low, high in zip(keys, batch.lowest, batch.highest):
        if low is not None:
            df = df.where(F.col(name).between(low, high))
    return df


def unseen_rows(
    new: DataFrame,
    existing: DataFrame,
    keys: Sequence[str],
    batch: BatchKeys | None = None,
    salts: int = 1,
) -> DataFrame:
    """Rows of ``new`` whose key does not occur in ``existing``.

    Null keys are dropped: they match nothing and would come back in every run.
    The existing keys are made distinct before the join. That costs no exchange
    of its own, the join needs the same partitioning, and a key that fills a
    third of ``existing`` shrinks to one row per map task.

    ``batch`` (from :func:`measure_keys`) describes the keys of ``new``, or of
    rows that ``new`` was made from. Their bounds limit what is read of
    ``existing``; if they are few, they are broadcast to cut it down where it is
    scanned, and the keys that are left, no more than those of the batch, are
    broadcast in turn: neither side's rows are shuffled. Otherwise both sides are
    shuffled once, but of ``existing`` only what passes the filter over the batch's
    keys; what passes wrongly finds no match in the join. Beyond the filter's size all
    keys within the bounds are shuffled.

    ``salts`` > 1 splits every key of ``new`` over that many partitions, for a
    ``new`` in which one key may hold a large share; the keys of ``existing``
    are repeated as often. Not needed where keys are unique.
    """
    keys = list(keys)
    new = drop_null_keys(new, keys)
    seen = existing.select(*keys)
    if batch is not None:
        seen = within_bounds(seen, keys, batch)
        if batch.few is not None:
            met = seen.join(F.broadcast(batch.few), keys, "left_semi").distinct()
            return new.join(F.broadcast(met), keys, "left_anti")
        if batch.filter is not None:
            seen = may_be_in(seen, keys, batch.filter)
    seen = seen.distinct()
    if salts == 1:
        return new.join(seen, keys, "left_anti")
    others = [name for name in new.columns if name not in keys] or keys
    salt = F.pmod(F.xxhash64(*others), F.lit(salts)).cast("int")
    salted = new.withColumn("__salt", salt)
    every_salt = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    seen = seen.withColumn("__salt", every_salt)
    return salted.join(seen, [*keys, "__salt"], "left_anti").drop("__salt")


def new_rows(
    new: DataFrame,
    existing: DataFrame,
    keys: Sequence[str],
    order_by: Sequence[str],
    batch: BatchKeys | None = None,
) -> DataFrame:
    """Unseen keys of a batch, one row each.

    Where the batch's keys are few, seen rows go first, without a shuffle, and only the
    others are sorted out by key. Otherwise the dedupe comes first and leaves the batch
    partitioned by key, so the anti join adds no second shuffle of it, and no hot key
    reaches the join.
    """
    keyed = drop_null_keys(new, keys)
    if batch is not None and batch.few is not None:
        return first_per_key(unseen_rows(keyed, existing, keys, batch), keys, order_by)
    return unseen_rows(first_per_key(keyed, keys, order_by), existing, keys, batch)


def rows_of_keys(df: DataFrame, keys: Sequence[str], wanted: BatchKeys) -> DataFrame:
    """Rows of ``df`` whose key is one of the ``wanted`` (from :func:`measure_keys`), without
    a shuffle. Beyond those few enough to be broadcast, rows of some other keys pass too."""
    if wanted.few is not None:
        return df.join(F.broadcast(wanted.few), list(keys), "left_semi").select(*df.columns)
    return df if wanted.filter is None else may_be_in(df, keys, wanted.filter)


def union_by_name(existing: DataFrame, more: DataFrame, allow_missing: bool = False) -> DataFrame:
    """All rows of both; columns are matched by name. They must be the same, or with
    ``allow_missing`` are null where a side does not have one. Numbers take the wider type
    of both sides."""
    return existing.unionByName(more, allowMissingColumns=allow_missing)


def merge_new(
    existing: DataFrame,
    new: DataFrame,
    keys: Sequence[str],
    order_by: Sequence[str],
    batch: BatchKeys | None = None,
) -> DataFrame:
    """``existing`` plus one row for each key it does not have yet."""
    fresh = new_rows(new, existing, keys, order_by, batch)
    return union_by_name(existing, fresh)
