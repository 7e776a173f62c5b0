"""Summaries and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adlake.functions import safe_div as ratio
from adlake.operators import clean as C
from adlake.operators import gold as G
from adlake.operators import incremental as I
from adlake.operators import metrics as M
from adlake.operators import rollup as R
from adlake.sources import row_count as count_rows
from checks import feed
from checks.feed import SPEC, TIE_BREAK, sql
from checks.registry import checked

METRICS_SQL = """
    SELECT Campaign_Type, count(*) AS Total_Campaigns,
           round(avg(CASE WHEN Impressions = 0 OR Impressions IS NULL THEN 0
                          ELSE CAST(Clicks AS DOUBLE) / Impressions END), 6) AS Avg_CTR,
           round(avg(Conversion_Rate), 6) AS Avg_Conversion_Rate,
           round(avg(CASE WHEN ROI > 5 THEN 5 WHEN ROI < -1 THEN -1 ELSE ROI END), 6)
               AS Avg_Adjusted_ROI,
           CAST(sum(Clicks) AS BIGINT) AS Total_Clicks,
           CAST(sum(Impressions) AS BIGINT) AS Total_Impressions,
           CAST(sum(CASE WHEN Conversion_Rate > 0.10 THEN 1 ELSE 0 END) AS BIGINT)
               AS High_Performing_Count,
           CAST(sum(CASE WHEN ROI >= 0 THEN 0 ELSE 1 END) AS BIGINT) AS High_Risk_Count
    FROM {rows} GROUP BY Campaign_Type"""

GOLD_TOTALS = """
           CAST(sum(Impressions) AS BIGINT) AS Total_Impressions,
           CAST(sum(Clicks) AS BIGINT) AS Total_Clicks,
           CAST(sum(Engagement_Score) AS BIGINT) AS Total_Engagement_Score,
           round(sum(Acquisition_Cost), 2) AS Total_Acquisition_Cost"""
PLAIN_AVERAGES = """
           round(avg(Conversion_Rate), 6) AS Avg_Conversion_Rate,
           round(avg(ROI), 6) AS Avg_ROI"""


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    return df.withColumns({name: F.round(name, n) for name, n in digits.items()})


def rounded_metrics(df: DataFrame) -> DataFrame:
    return rounded(df, Avg_CTR=6, Avg_Conversion_Rate=6, Avg_Adjusted_ROI=6)


def rounded_gold(df: DataFrame) -> DataFrame:
    return rounded(df, Total_Acquisition_Cost=2, Avg_Conversion_Rate=6, Avg_ROI=6)


@checked(sql("SELECT count(*) AS row_count FROM campaigns"))
def row_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_rows(feed.campaigns(spark, sf_dir, "Campaign_ID"))


@checked("SELECT max(ts) AS high_water_mark FROM events")
def high_water_mark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.high_water_mark(feed.table(spark, sf_dir, "events"), "ts")


@checked(
    sql(
        f"""SELECT Campaign_ID, Channel_Used, "Date", {", ".join(TIE_BREAK)}
            FROM campaigns
            QUALIFY row_number() OVER (PARTITION BY Campaign_ID
                                       ORDER BY {", ".join(TIE_BREAK)}) = 1"""
    )
)
def dedupe_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per key; the rows without key count as one key here."""
    rows = feed.campaigns(spark, sf_dir, "Campaign_ID", "Channel_Used", "Date")
    return C.first_per_key(rows, SPEC.keys, SPEC.tie_break).drop("l_shipdate")


@checked(
    sql(
        """SELECT Campaign_ID,
                  round(CASE WHEN sum(Impressions) = 0 OR sum(Impressions) IS NULL THEN 0
                             ELSE sum(Conversion_Rate * Impressions) / sum(Impressions)
                        END, 10) AS weighted_rate
           FROM campaigns GROUP BY Campaign_ID"""
    )
)
def safe_div(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted rates over raw rows: many keys have no weight at all.

    Ten digits, as a rate over a few rows may end in a 5 at the seventh, which
    the engines round differently.
    """
    rows = feed.campaigns(
        spark, sf_dir, "Campaign_ID", "Conversion_Rate", "Impressions"
    )
    weighted = F.sum(F.col("Conversion_Rate") * F.col("Impressions"))
    rate = ratio(weighted, F.sum("Impressions"))
    return rows.groupBy("Campaign_ID").agg(F.round(rate, 10).alias("weighted_rate"))


@checked(
    sql(
        f"""SELECT Campaign_ID, Campaign_Type, Company, {GOLD_TOTALS},
                   round(CASE WHEN sum(Impressions) = 0 THEN 0
                              ELSE sum(Conversion_Rate * Impressions) / sum(Impressions)
                         END, 6) AS Avg_Conversion_Rate,
                   round(sum(ROI) / count(Campaign_ID), 6) AS Avg_ROI
            FROM filtered GROUP BY Campaign_ID, Campaign_Type, Company"""
    )
)
def gold_campaign_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = feed.filtered(
        spark, sf_dir, "Campaign_Type", "Company", "Engagement_Score"
    )
    return rounded_gold(G.campaign_summary(rows, SPEC))


@checked(
    sql(
        f"""SELECT coalesce(Channel_Used, 'Unknown') AS Channel_Used, {GOLD_TOTALS},
                   {PLAIN_AVERAGES} FROM filtered GROUP BY 1"""
    )
)
def gold_channel_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = feed.filtered(spark, sf_dir, "Channel_Used", "Engagement_Score")
    return rounded_gold(G.channel_summary(rows, SPEC))


@checked(
    sql(
        f"""SELECT "Date", {GOLD_TOTALS}, {PLAIN_AVERAGES}
            FROM filtered WHERE "Date" IS NOT NULL GROUP BY "Date\""""
    )
)
def gold_daily_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = feed.filtered(spark, sf_dir, "Date", "Engagement_Score")
    return rounded_gold(G.daily_summary(rows, SPEC))


@checked(sql(METRICS_SQL.format(rows="filtered")))
def sql_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = feed.filtered(spark, sf_dir, "Campaign_Type")
    return rounded_metrics(M.campaign_metrics(rows))


def merged_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of two row sets, added up."""
    rows = feed.filtered(spark, sf_dir, "Campaign_Type", "Date", "Engagement_Score")
    first, second = feed.earlier(rows), feed.later(rows)
    return R.merge_rollups(R.rollup(first, SPEC), R.rollup(second, SPEC), SPEC)


@checked(
    sql(
        f"""SELECT "Date", {GOLD_TOTALS}, {PLAIN_AVERAGES}
            FROM filtered WHERE "Date" IS NOT NULL GROUP BY "Date\""""
    )
)
def gold_daily_from_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded_gold(R.daily_summary_of(merged_rollup(spark, sf_dir), SPEC))


@checked(sql(METRICS_SQL.format(rows="filtered")))
def sql_metrics_from_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded_metrics(R.metrics_of(merged_rollup(spark, sf_dir)))


@checked(sql(METRICS_SQL.format(rows="filtered")))
def sql_metrics_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = feed.filtered(spark, sf_dir, "Campaign_Type")
    return rounded_metrics(M.campaign_metrics_sql(rows))
