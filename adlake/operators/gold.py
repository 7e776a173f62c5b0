"""The three reporting summaries.

Each is one partial/final hash aggregate. Sums and averages combine on the map
side, so a channel or day that holds a third of the rows sends one row per task.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from adlake import spec as S
from adlake.functions import safe_div
from adlake.operators.clean import (
    drop_null_keys,
    fill_nulls,
    require_non_null,
    typed_date,
)
from adlake.sources.readers import stamp
from adlake.spec import DEFAULT_SPEC, CampaignSpec

TOTALLED = ("Impressions", "Clicks", "Engagement_Score", "Acquisition_Cost")
CAMPAIGN_GRAIN = ("Campaign_ID", "Campaign_Type", "Company")


def gold_rows(df: DataFrame, spec: CampaignSpec = DEFAULT_SPEC) -> DataFrame:
    """Filtered rows made ready for grouping: no gaps, keyed, date typed."""
    filled = fill_nulls(df, spec)
    dated = filled.withColumn(spec.date, typed_date(filled, spec))
    return drop_null_keys(dated, spec.keys)


def with_date_parts(df: DataFrame, spec: CampaignSpec = DEFAULT_SPEC) -> DataFrame:
    day = F.col(spec.date)
    return df.withColumns({"year": F.year(day), "month": F.month(day)})


def _totals() -> list[Column]:
    return [F.sum(name).alias(f"Total_{name}") for name in TOTALLED]


def _sum_type(df: DataFrame, name: str) -> str:
    return "long" if isinstance(df.schema[name].dataType, IntegralType) else "double"


def _plain_averages() -> list[Column]:
    return [F.avg(name).alias(f"Avg_{name}") for name in ("Conversion_Rate", "ROI")]


def weighted_average(value: str, weight: str) -> Column:
    """Σ(value·weight) / Σ(weight), 0 without any weight."""
    return safe_div(F.sum(F.col(value) * F.col(weight)), F.sum(weight))


def _stamped(df: DataFrame, run_ts: datetime | None) -> DataFrame:
    return df if run_ts is None else stamp(df, S.AGGREGATED_AT, run_ts)


def one_row_per_group(spec: CampaignSpec) -> bool:
    """Whether rows that are unique by key are each a group of the campaign table."""
    return "Campaign_ID" in spec.keys and set(spec.keys) <= set(CAMPAIGN_GRAIN)


def campaign_summary(
    df: DataFrame,
    spec: CampaignSpec = DEFAULT_SPEC,
    run_ts: datetime | None = None,
    unique: bool = False,
) -> DataFrame:
    """Per campaign, type and company; the conversion rate is weighted by
    impressions.

    ``unique`` says that every row is a group by itself, which spares the shuffle.
    """
    if unique:
        rows = gold_rows(df, spec)
        rate, weight = F.col("Conversion_Rate"), F.col("Impressions")
        totals = [
            F.col(name).cast(_sum_type(rows, name)).alias(f"Total_{name}") for name in TOTALLED
        ]
        summary = rows.select(
            *CAMPAIGN_GRAIN,
            *totals,
            safe_div(rate * weight, weight).alias("Avg_Conversion_Rate"),
            F.col("ROI").cast("double").alias("Avg_ROI"),
        )
        return _stamped(summary, run_ts)
    summary = gold_rows(df, spec).groupBy(*CAMPAIGN_GRAIN).agg(
        *_totals(),
        weighted_average("Conversion_Rate", "Impressions").alias("Avg_Conversion_Rate"),
        safe_div(F.sum("ROI"), F.count("Campaign_ID")).alias("Avg_ROI"),
    )
    return _stamped(summary, run_ts)


def channel_summary(
    df: DataFrame, spec: CampaignSpec = DEFAULT_SPEC, run_ts: datetime | None = None
) -> DataFrame:
    summary = gold_rows(df, spec).groupBy(spec.channel).agg(
        *_totals(), *_plain_averages()
    )
    return _stamped(summary, run_ts)


def daily_summary(
    df: DataFrame, spec: CampaignSpec = DEFAULT_SPEC, run_ts: datetime | None = None
) -> DataFrame:
    """Per day, over the rows that have one."""
    dated = require_non_null(gold_rows(df, spec), [spec.date])
    summary = dated.groupBy(spec.date).agg(*_totals(), *_plain_averages())
    return _stamped(summary, run_ts)


def gold(
    df: DataFrame, spec: CampaignSpec = DEFAULT_SPEC, run_ts: datetime | None = None
) -> dict[str, DataFrame]:
    return {
        "campaign_summary": campaign_summary(df, spec, run_ts),
        "channel_summary": channel_summary(df, spec, run_ts),
        "daily_summary": daily_summary(df, spec, run_ts),
    }
