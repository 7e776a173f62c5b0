"""From raw rows to typed, unique, business-relevant rows."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StringType

from adlake import spec as S
from adlake.functions import parse_currency, parse_date
from adlake.sources.readers import stamp
from adlake.spec import DEFAULT_SPEC, CampaignSpec


def require_non_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows in which none of the columns is null.

    Plain null tests reach the Parquet scan; ``dropna`` would not, and it would
    drop NaN as well.
    """
    return df.where(reduce(and_, (F.col(name).isNotNull() for name in columns)))


def drop_null_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return require_non_null(df, keys)


def dedupe_order(df: DataFrame, spec: CampaignSpec = DEFAULT_SPEC) -> list[str]:
    """Columns that rank the rows of one key: the earliest ingested first, then
    the spec's tie break, or every other column to make the order total."""
    ranked = spec.tie_break or [
        field.name
        for field in df.schema.fields
        if field.name not in (*spec.keys, *S.AUDIT_COLUMNS)
        and not isinstance(field.dataType, MapType)
    ]
    first = [S.INGESTED_AT] if S.INGESTED_AT in df.columns else []
    return [*first, *ranked]


def first_per_key(
    df: DataFrame, keys: Sequence[str], order_by: Sequence[str]
) -> DataFrame:
    """One row per key: the first in ``order_by``.

    Spark plans ``row_number() = 1`` with a group limit on both sides of the
    shuffle: every map task keeps its best row per key, so a key that holds a
    third of the table still sends just one row per task.
    """
    order = order_by or keys
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    ranked = df.withColumn("__rank", rank)
    return ranked.where(F.col("__rank") == 1).drop("__rank")


def fill_nulls(df: DataFrame, spec: CampaignSpec = DEFAULT_SPEC) -> DataFrame:
    """Missing measures become 0, missing dimensions the filler text."""
    zeros = {name: 0 for name in spec.measures if name in df.columns}
    names = {name: spec.unknown for name in spec.dimensions if name in df.columns}
    return df.fillna(zeros).fillna(names)


def typed_cost(df: DataFrame, spec: CampaignSpec = DEFAULT_SPEC) -> Column:
    """The cost as number, whether the column still is currency text or not."""
    cost = F.col(spec.currency)
    is_text = isinstance(df.schema[spec.currency].dataType, StringType)
    return parse_currency(cost) if is_text else cost


def typed_date(df: DataFrame, spec: CampaignSpec = DEFAULT_SPEC) -> Column:
    """The date as date, whether the column still is text or not."""
    day = F.col(spec.date)
    is_text = isinstance(df.schema[spec.date].dataType, StringType)
    return parse_date(day, spec.date_formats) if is_text else day


def typed_rows(df: DataFrame, spec: CampaignSpec = DEFAULT_SPEC) -> DataFrame:
    """Parse cost and date; missing measures become 0.

    An unreadable cost stays null, unlike a missing one: the business filter
    drops it later.
    """
    columns = {
        name: F.coalesce(F.col(name), F.lit(0))
        for name in spec.measures
        if name != spec.currency and name in df.columns
    }
    columns[spec.currency] = typed_cost(df, spec)
    columns[spec.date] = typed_date(df, spec)
    return df.withColumns(columns)


def clean(
    df: DataFrame,
    spec: CampaignSpec = DEFAULT_SPEC,
    run_ts: datetime | None = None,
    unique: bool = False,
) -> DataFrame:
    """Silver rows: keyed, unique, typed, without missing measures.

    Null keys go before the dedupe, and parsing comes after it, so that only
    surviving rows are parsed and no null group is ever shuffled. Rows whose keys are
    known to be ``unique`` need no dedupe, and so no shuffle.
    """
    rows = drop_null_keys(df, spec.keys)
    if not unique:
        rows = first_per_key(rows, spec.keys, dedupe_order(df, spec))
    silver = typed_rows(rows, spec)
    return silver if run_ts is None else stamp(silver, S.CLEANED_AT, run_ts)


def in_business(spec: CampaignSpec = DEFAULT_SPEC) -> Column:
    """Served, with a sane cost, on a known channel, and with some response.

    Null in any of the four parts drops the row; within the response part one
    true side is enough.
    """
    served = F.col("Impressions") > 0
    sane_cost = F.col(spec.currency) >= 0
    known_channel = F.col(spec.channel).isin(*spec.channels)
    response = (F.col("Clicks") > 0) | (F.col("Conversion_Rate") > 0)
    return served & sane_cost & known_channel & response


def business_filter(
    df: DataFrame, spec: CampaignSpec = DEFAULT_SPEC, run_ts: datetime | None = None
) -> DataFrame:
    """Rows of a silver table that count for reporting."""
    kept = df.where(in_business(spec))
    return kept if run_ts is None else stamp(kept, S.FILTERED_AT, run_ts)
