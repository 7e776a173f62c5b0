"""Performance metrics per campaign type, as DataFrame and as SQL."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adlake import spec as S
from adlake.functions import adjusted_roi, conversion_category, ctr, roi_risk
from adlake.operators.incremental import union_by_name
from adlake.sources.readers import register_view, stamp

METRICS_VIEW = "SILVER_FILTER_FINAL"


def with_derivations(df: DataFrame) -> DataFrame:
    """Add CTR, conversion category, clamped ROI and risk level to each row."""
    roi = F.col("ROI")
    return df.withColumns(
        {
            "CTR": ctr(F.col("Clicks"), F.col("Impressions")),
            "Conversion_Category": conversion_category(F.col("Conversion_Rate")),
            "Adjusted_ROI": adjusted_roi(roi),
            "ROI_Risk_Level": roi_risk(roi),
        }
    )


def campaign_metrics(df: DataFrame, run_ts: datetime | None = None) -> DataFrame:
    """One row per campaign type. With ``run_ts`` the latest metrics time is
    added, as the audit column of this table."""
    aggregates = [
        F.count(F.lit(1)).alias("Total_Campaigns"),
        F.avg("CTR").alias("Avg_CTR"),
        F.avg("Conversion_Rate").alias("Avg_Conversion_Rate"),
        F.avg("Adjusted_ROI").alias("Avg_Adjusted_ROI"),
        F.sum("Clicks").alias("Total_Clicks"),
        F.sum("Impressions").alias("Total_Impressions"),
        F.count_if(F.col("Conversion_Category") == "High").alias("High_Performing_Count"),
        F.count_if(F.col("ROI_Risk_Level") == "High Risk").alias("High_Risk_Count"),
    ]
    rows = with_derivations(df)
    if run_ts is not None:
        rows = stamp(rows, S.METRICS_AT, run_ts)
        aggregates.append(F.max(S.METRICS_AT).alias("Latest_Metrics_Timestamp"))
    return rows.groupBy("Campaign_Type").agg(*aggregates)


def campaign_metrics_sql(
    df: DataFrame, run_ts: datetime | None = None, view: str = METRICS_VIEW
) -> DataFrame:
    """The same table through SQL.

    ``df`` is registered as ``view`` and stays available to further SQL.
    Thresholds are bound as parameters.
    """
    rows = df if run_ts is None else stamp(df, S.METRICS_AT, run_ts)
    register_view(rows, view)
    latest = "" if run_ts is None else f", max({S.METRICS_AT}) AS Latest_Metrics_Timestamp"
    text = f"""
        SELECT Campaign_Type,
               count(*) AS Total_Campaigns,
               avg(nvl2(nullif(Impressions, 0), Clicks / nullif(Impressions, 0), 0D))
                   AS Avg_CTR,
               avg(Conversion_Rate) AS Avg_Conversion_Rate,
               avg(nvl2(ROI, greatest(least(ROI, :ceiling), :floor), NULL))
                   AS Avg_Adjusted_ROI,
               sum(Clicks) AS Total_Clicks,
               sum(Impressions) AS Total_Impressions,
               count_if(Conversion_Rate > :high) AS High_Performing_Count,
               count_if(ROI IS NULL OR ROI < :medium_risk) AS High_Risk_Count
               {latest}
        FROM {view}
        GROUP BY Campaign_Type
    """
    return df.sparkSession.sql(
        text,
        {
            "ceiling": S.ROI_CEILING,
            "floor": S.ROI_FLOOR,
            "high": S.HIGH_CONVERSION_ABOVE,
            "medium_risk": S.MEDIUM_RISK_FROM,
        },
    )


def update_metrics(
    existing: DataFrame, fresh: DataFrame, mode: str = "recompute"
) -> DataFrame:
    """Bring the metrics table up to date.

    ``recompute`` takes the fresh table as it is. ``insert_only`` leaves known
    campaign types untouched and adds the others; the group without a type is a
    type like any other here, hence the null-safe match.
    """
    if mode == "recompute":
        return fresh
    if mode == "insert_only":
        known = existing.select(F.col("Campaign_Type").alias("__known"))
        same_type = F.col("Campaign_Type").eqNullSafe(F.col("__known"))
        return union_by_name(existing, fresh.join(known, same_type, "left_anti"))
    raise ValueError(f"unknown mode: {mode!r}")
