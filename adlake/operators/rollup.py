"""Mergeable totals behind the small reporting tables.

An average cannot be brought up to date by its new rows alone, a sum and a count
can. The rollup keeps both per channel, day and campaign type; the totals of two
row sets add up to those of their union. The channel, daily and metrics tables
follow from it, so a load has to look at its own rows only, however many are
stored already.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adlake import spec as S
from adlake.operators.clean import fill_nulls, require_non_null, typed_date
from adlake.operators.gold import TOTALLED
from adlake.operators.metrics import with_derivations
from adlake.sources.readers import stamp, time_literal, to_micros
from adlake.spec import DEFAULT_SPEC, CampaignSpec

DERIVED_AVERAGES = ("CTR", "Conversion_Rate", "Adjusted_ROI")
COUNTED = ("Clicks", "Impressions")


def _grain(spec: CampaignSpec) -> list[str]:
    return [spec.channel, spec.date, "Campaign_Type"]


def rollup(df: DataFrame, spec: CampaignSpec = DEFAULT_SPEC) -> DataFrame:
    """Totals of filtered rows (which all have a key).

    ``filled_`` columns take missing measures as 0, as the summaries do; the
    others leave them out, as the metrics do.
    """
    filled_names = {f"filled_{name}": F.col(name) for name in spec.measures}
    rows = with_derivations(df).withColumn(spec.date, typed_date(df, spec))
    rows = rows.withColumns(filled_names).fillna(0, subset=list(filled_names))
    totals: list[Column] = [F.count(F.lit(1)).alias("row_count")]
    totals += [F.sum(name).alias(name) for name in filled_names]
    for name in DERIVED_AVERAGES:
        totals.append(F.sum(name).alias(f"sum_{name}"))
        totals.append(F.count(name).alias(f"count_{name}"))
    totals += [F.sum(name).alias(f"sum_{name}") for name in COUNTED]
    totals.append(
        F.count_if(F.col("Conversion_Category") == "High").alias("high_performing")
    )
    totals.append(F.count_if(F.col("ROI_Risk_Level") == "High Risk").alias("high_risk"))
    return rows.groupBy(*_grain(spec)).agg(*totals)


def merge_rollups(
    first: DataFrame, second: DataFrame, spec: CampaignSpec = DEFAULT_SPEC
) -> DataFrame:
    """The rollup of both row sets together. They must not share rows."""
    grain = _grain(spec)
    totals = [name for name in first.columns if name not in grain]
    both = first.unionByName(second)
    return both.groupBy(*grain).agg(*(F.sum(name).alias(name) for name in totals))


def _summary(rolled: DataFrame, group: str) -> DataFrame:
    rows = F.sum("row_count")
    return rolled.groupBy(group).agg(
        *(F.sum(f"filled_{name}").alias(f"Total_{name}") for name in TOTALLED),
        *(
            (F.sum(f"filled_{name}") / rows).alias(f"Avg_{name}")
            for name in ("Conversion_Rate", "ROI")
        ),
    )


def _stamped(df: DataFrame, run_ts: datetime | None) -> DataFrame:
    return df if run_ts is None else stamp(df, S.AGGREGATED_AT, run_ts)


def channel_summary_of(
    rolled: DataFrame,
    spec: CampaignSpec = DEFAULT_SPEC,
    run_ts: datetime | None = None,
) -> DataFrame:
    named = fill_nulls(rolled, spec)
    return _stamped(_summary(named, spec.channel), run_ts)


def daily_summary_of(
    rolled: DataFrame,
    spec: CampaignSpec = DEFAULT_SPEC,
    run_ts: datetime | None = None,
) -> DataFrame:
    dated = require_non_null(rolled, [spec.date])
    return _stamped(_summary(dated, spec.date), run_ts)


def metrics_of(rolled: DataFrame, run_ts: datetime | None = None) -> DataFrame:
    """The metrics per campaign type, as ``campaign_metrics`` gives them."""
    averages = [
        F.try_divide(F.sum(f"sum_{name}"), F.sum(f"count_{name}")).alias(f"Avg_{name}")
        for name in DERIVED_AVERAGES
    ]
    aggregates = [
        F.sum("row_count").alias("Total_Campaigns"),
        *averages,
        *(F.sum(f"sum_{name}").alias(f"Total_{name}") for name in COUNTED),
        F.sum("high_performing").alias("High_Performing_Count"),
        F.sum("high_risk").alias("High_Risk_Count"),
    ]
    if run_ts is not None:
        now = time_literal(to_micros(run_ts))
        aggregates.append(F.max(now).alias("Latest_Metrics_Timestamp"))
    return rolled.groupBy("Campaign_Type").agg(*aggregates)
