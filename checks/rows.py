"""Row-wise work: filters, parsing, derived columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from adlake import functions as X
from adlake.operators import clean as C
from adlake.operators import gold as G
from adlake.operators import incremental as I
from adlake.operators import metrics as M
from adlake.operators import quality as Q
from checks import feed
from checks.feed import BUSINESS, SPEC, TIE_BREAK, sql
from checks.registry import checked

BUSINESS_LIST = ", ".join(f'"{name}"' for name in BUSINESS)
TIE_LIST = ", ".join(TIE_BREAK)
NUMERIC = (*SPEC.keys, *SPEC.measures)


def by_value(df: DataFrame, **columns: Column) -> DataFrame:
    """Every combination of the given columns with its number of rows."""
    chosen = df.select(*(column.alias(name) for name, column in columns.items()))
    return chosen.groupBy(*columns).agg(F.count(F.lit(1)).alias("row_count"))


@checked(sql(f"SELECT Campaign_ID, {TIE_LIST} FROM campaigns WHERE Campaign_ID IS NOT NULL"))
def drop_null_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = feed.campaigns(spark, sf_dir, "Campaign_ID").drop("l_shipdate")
    return C.drop_null_keys(rows, SPEC.keys)


@checked(
    sql(
        f"""SELECT Campaign_ID, Channel_Used, Clicks, {TIE_LIST} FROM campaigns
            WHERE Campaign_ID IS NOT NULL AND Channel_Used IS NOT NULL
              AND Clicks IS NOT NULL"""
    )
)
def require_non_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = ("Campaign_ID", "Channel_Used", "Clicks")
    rows = feed.campaigns(spark, sf_dir, *wanted).drop("l_shipdate")
    return C.require_non_null(rows, wanted)


@checked(sql(f"SELECT {BUSINESS_LIST} FROM filtered"))
def silver_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed.filtered(spark, sf_dir).select(*BUSINESS)


@checked(sql(f"SELECT {BUSINESS_LIST} FROM silver"))
def silver_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed.silver(spark, sf_dir).select(*BUSINESS)


LOADED_UNTIL = "2024-01-20"


@checked(
    f"""SELECT * FROM events
        WHERE ts > (SELECT max(ts) FROM events WHERE ts < TIMESTAMP '{LOADED_UNTIL}')"""
)
def newer_than_hwm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events later than all that an earlier load has stored."""
    events = feed.table(spark, sf_dir, "events")
    loaded = events.where(F.col("ts") < F.lit(LOADED_UNTIL).cast("timestamp_ntz"))
    return I.newer_than(events, "ts", loaded)


@checked(
    sql(
        f"""SELECT Campaign_ID, ROI, Acquisition_Cost, {TIE_LIST} FROM campaigns
            WHERE Campaign_ID < 0 OR Conversion_Rate < 0 OR ROI < 0 OR Clicks < 0
               OR Impressions < 0 OR Engagement_Score < 0
               OR try_cast(regexp_replace(Acquisition_Cost, '[$,]', '', 'g') AS DOUBLE) < 0"""
    )
)
def rows_any_negative(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = feed.campaigns(spark, sf_dir, *NUMERIC)
    found = Q.rows_any_negative(rows, NUMERIC, SPEC)
    return found.select("Campaign_ID", "ROI", "Acquisition_Cost", *TIE_BREAK)


CTR_SQL = """CASE WHEN Impressions = 0 OR Impressions IS NULL THEN 0
                  ELSE CAST(Clicks AS DOUBLE) / Impressions END"""
CATEGORY_SQL = """CASE WHEN Conversion_Rate > 0.10 THEN 'High'
                       WHEN Conversion_Rate >= 0.05 THEN 'Medium' ELSE 'Low' END"""
ADJUSTED_SQL = "CASE WHEN ROI > 5 THEN 5 WHEN ROI < -1 THEN -1 ELSE ROI END"
RISK_SQL = """CASE WHEN ROI >= 1 THEN 'Low Risk' WHEN ROI >= 0 THEN 'Medium Risk'
                   ELSE 'High Risk' END"""


@checked(
    sql(
        f"""SELECT Campaign_ID, Campaign_Type, round({CTR_SQL}, 6) AS CTR,
                   {CATEGORY_SQL} AS Conversion_Category,
                   CAST({ADJUSTED_SQL} AS DOUBLE) AS Adjusted_ROI,
                   {RISK_SQL} AS ROI_Risk_Level
            FROM filtered"""
    )
)
def campaign_derivations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = M.with_derivations(feed.filtered(spark, sf_dir, "Campaign_Type"))
    return rows.select(
        "Campaign_ID",
        "Campaign_Type",
        F.round("CTR", 6).alias("CTR"),
        "Conversion_Category",
        "Adjusted_ROI",
        "ROI_Risk_Level",
    )


@checked(
    sql(
        """SELECT "Date" AS day, CAST(year("Date") AS INTEGER) AS "year",
                  CAST(month("Date") AS INTEGER) AS "month", count(*) AS row_count
           FROM filtered WHERE "Date" IS NOT NULL GROUP BY ALL"""
    )
)
def date_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    dated = C.require_non_null(feed.filtered(spark, sf_dir, "Date"), ["Date"])
    rows = G.with_date_parts(dated, SPEC)
    return by_value(rows, day=F.col("Date"), year=F.col("year"), month=F.col("month"))


@checked(
    sql(
        """SELECT 'Campaign_ID' AS "column",
                  count(*) FILTER (Campaign_ID IS NULL) AS nulls_before,
                  count(*) FILTER (Campaign_ID IS NULL) AS nulls_after
           FROM campaigns
           UNION ALL
           SELECT 'Date', count(*) FILTER ("Date" IS NULL),
                  count(*) FILTER (
                      try_strptime("Date", '%Y-%m-%d') IS NULL
                      AND try_strptime("Date", '%d-%m-%Y') IS NULL
                      AND try_strptime("Date", '%m/%d/%Y') IS NULL)
           FROM campaigns"""
    )
)
def null_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = feed.campaigns(spark, sf_dir, "Campaign_ID", "Date")
    parsed = {"Date": X.parse_date(F.col("Date"), SPEC.date_formats)}
    return Q.null_audit(rows, ["Campaign_ID", "Date"], parsed)


@checked(
    sql(
        """SELECT Acquisition_Cost AS cost_text,
                  CASE WHEN Acquisition_Cost IS NULL THEN 0
                       ELSE CAST(replace(replace(Acquisition_Cost, '$', ''), ',', '')
                                 AS DOUBLE) END AS amount,
                  count(*) AS row_count
           FROM campaigns GROUP BY ALL"""
    )
)
def parse_currency(spark: SparkSession, sf_dir: str) -> DataFrame:
    cost = F.col("Acquisition_Cost")
    rows = feed.campaigns(spark, sf_dir, "Acquisition_Cost")
    return by_value(rows, cost_text=cost, amount=X.parse_currency(cost))


@checked(
    sql(
        """SELECT "Date" AS date_text,
                  CAST(coalesce(try_strptime("Date", '%Y-%m-%d'),
                                try_strptime("Date", '%d-%m-%Y'),
                                try_strptime("Date", '%m/%d/%Y')) AS DATE) AS day,
                  count(*) AS row_count
           FROM campaigns GROUP BY ALL"""
    )
)
def parse_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("Date")
    rows = feed.campaigns(spark, sf_dir, "Date")
    return by_value(rows, date_text=text, day=X.parse_date(text, SPEC.date_formats))


@checked(
    sql(
        """SELECT coalesce(Channel_Used, 'Unknown') AS Channel_Used,
                  count(*) AS row_count,
                  CAST(sum(coalesce(Clicks, 0)) AS BIGINT) AS clicks,
                  CAST(sum(coalesce(Impressions, 0)) AS BIGINT) AS impressions,
                  round(avg(coalesce(ROI, 0)), 6) AS avg_roi,
                  round(avg(coalesce(Conversion_Rate, 0)), 6) AS avg_rate
           FROM campaigns GROUP BY 1"""
    )
)
def fill_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = ("Channel_Used", "Clicks", "Impressions", "ROI", "Conversion_Rate")
    rows = C.fill_nulls(feed.campaigns(spark, sf_dir, *wanted), SPEC)
    return rows.groupBy("Channel_Used").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.sum("Clicks").alias("clicks"),
        F.sum("Impressions").alias("impressions"),
        F.round(F.avg("ROI"), 6).alias("avg_roi"),
        F.round(F.avg("Conversion_Rate"), 6).alias("avg_rate"),
    )


@checked(
    sql(
        f"""SELECT Clicks AS clicks, Impressions AS impressions,
                   round({CTR_SQL}, 6) AS ctr,
                   round(CASE WHEN Impressions > 0 THEN CAST(Clicks AS DOUBLE) / Impressions
                              ELSE 0 END, 6) AS ctr_when_served,
                   count(*) AS row_count
            FROM campaigns GROUP BY ALL"""
    )
)
def ctr(spark: SparkSession, sf_dir: str) -> DataFrame:
    clicks, impressions = F.col("Clicks"), F.col("Impressions")
    return by_value(
        feed.campaigns(spark, sf_dir, "Clicks", "Impressions"),
        clicks=clicks,
        impressions=impressions,
        ctr=F.round(X.ctr(clicks, impressions), 6),
        ctr_when_served=F.round(X.ctr_when_served(clicks, impressions), 6),
    )


@checked(
    sql(
        f"""SELECT Conversion_Rate AS rate, {CATEGORY_SQL} AS category,
                   count(*) AS row_count FROM campaigns GROUP BY ALL"""
    )
)
def conversion_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    rate = F.col("Conversion_Rate")
    rows = feed.campaigns(spark, sf_dir, "Conversion_Rate")
    return by_value(rows, rate=rate, category=X.conversion_category(rate))


@checked(
    sql(
        f"""SELECT ROI AS roi, CAST({ADJUSTED_SQL} AS DOUBLE) AS adjusted,
                   count(*) AS row_count FROM campaigns GROUP BY ALL"""
    )
)
def adjusted_roi(spark: SparkSession, sf_dir: str) -> DataFrame:
    roi = F.col("ROI")
    rows = feed.campaigns(spark, sf_dir, "ROI")
    return by_value(rows, roi=roi, adjusted=X.adjusted_roi(roi))


@checked(
    sql(
        f"""SELECT ROI AS roi, {RISK_SQL} AS risk, count(*) AS row_count
            FROM campaigns GROUP BY ALL"""
    )
)
def roi_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    roi = F.col("ROI")
    rows = feed.campaigns(spark, sf_dir, "ROI")
    return by_value(rows, roi=roi, risk=X.roi_risk(roi))
