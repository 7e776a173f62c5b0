"""Writing layers, and whole runs from raw files to reporting tables."""

from __future__ import annotations

from datetime import UTC, datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from adlake import sources as io
from adlake.operators.incremental import union_by_name
from adlake.plans import run_full, run_increment
from adlake.sources import Lake
from adlake.streaming import run_stream
from checks import feed
from checks.aggregates import GOLD_TOTALS, PLAIN_AVERAGES
from checks.feed import BUSINESS, SPEC, TIE_BREAK, sql
from checks.registry import checked
from checks.scans import write_csv

FIRST_RUN = datetime(2026, 2, 2, tzinfo=UTC)
PER_CHANNEL = """SELECT Channel_Used, count(*) AS row_count,
                        CAST(sum(Clicks) AS BIGINT) AS clicks
                 FROM campaigns GROUP BY Channel_Used"""
BUSINESS_LIST = ", ".join(f'"{name}"' for name in BUSINESS)


def per_channel(df: DataFrame) -> DataFrame:
    return df.groupBy("Channel_Used").agg(
        F.count(F.lit(1)).alias("row_count"), F.sum("Clicks").alias("clicks")
    )


@checked(sql(PER_CHANNEL))
def sink_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second write leaves nothing of the first."""
    rows = feed.campaigns(spark, sf_dir, "Channel_Used", "Clicks")
    path = io.shared_dir(spark, "sink_overwrite")
    io.overwrite(feed.earlier(rows), path)
    io.overwrite(rows, path)
    return per_channel(io.read_parquet(spark, path))


@checked(sql(PER_CHANNEL))
def sink_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two appends, the first of which creates the table."""
    rows = feed.campaigns(spark, sf_dir, "Channel_Used", "Clicks")
    path = io.shared_dir(spark, "sink_append")
    io.append_rows(feed.earlier(rows), path)
    io.append_rows(feed.later(rows), path)
    return per_channel(io.read_parquet(spark, path))


@checked(sql(PER_CHANNEL))
def snapshot_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A layer is replaced by a table made from itself."""
    rows = feed.campaigns(spark, sf_dir, "Channel_Used", "Clicks")
    lake = Lake(spark, io.shared_dir(spark, "snapshot_replace"))
    stored = lake.replace("rows", feed.earlier(rows), 1)
    lake.replace("rows", union_by_name(stored, feed.later(rows)), 2)
    return per_channel(Lake(spark, lake.root).read("rows"))


def raw_batches(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All raw rows in two loads, dealt out by something that no tie break looks at first.
    They are joined once for all loads."""
    rows = feed.stored(feed.campaigns(spark, sf_dir).select(*BUSINESS, *TIE_BREAK), "raw_batches")
    even = F.col("l_partkey") % 2 == 0
    return rows.where(even), rows.where(~even)


# A key keeps the row that came first: of the first load, then by tie break.
FIRST_COME = f"""first_come AS (
    SELECT * FROM (
        SELECT * FROM amounts
        QUALIFY row_number() OVER (PARTITION BY Campaign_ID
                                   ORDER BY l_partkey % 2, {", ".join(TIE_BREAK)}) = 1)
    WHERE Impressions > 0 AND Acquisition_Cost >= 0
      AND Channel_Used IN ('YouTube', 'Email', 'Instagram', 'Website', 'Google Ads',
                           'Facebook')
      AND (Clicks > 0 OR Conversion_Rate > 0)
)"""


@checked(sql(f"SELECT {BUSINESS_LIST} FROM first_come", FIRST_COME))
def increment_two_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two increments, and the second batch once more: first come, first kept."""
    root = io.shared_dir(spark, "increment_two_batches")
    first, second = raw_batches(spark, sf_dir)
    for hours, batch in enumerate((first, second, second)):
        run_ts = FIRST_RUN + timedelta(hours=hours)
        run_increment(spark, batch, root, SPEC, run_ts)
    return Lake(spark, root).read("filtered").select(*BUSINESS)


@checked(
    sql(
        f"""SELECT coalesce(Channel_Used, 'Unknown') AS Channel_Used, {GOLD_TOTALS},
                   {PLAIN_AVERAGES} FROM first_come GROUP BY 1""",
        FIRST_COME,
    )
)
def stream_increment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same two loads as raw files that a stream picks up as they arrive."""
    root = io.shared_dir(spark, "stream_increment")
    for hours, batch in enumerate(raw_batches(spark, sf_dir)):
        write_csv(batch, f"{root}/raw/drop_{hours}")
        run_ts = FIRST_RUN + timedelta(hours=hours)
        run_stream(spark, f"{root}/raw/*", f"{root}/lake", SPEC, run_ts)
    summary = Lake(spark, f"{root}/lake").read("channel_summary")
    return summary.select(
        "Channel_Used",
        "Total_Impressions",
        "Total_Clicks",
        "Total_Engagement_Score",
        F.round("Total_Acquisition_Cost", 2).alias("Total_Acquisition_Cost"),
        F.round("Avg_Conversion_Rate", 6).alias("Avg_Conversion_Rate"),
        F.round("Avg_ROI", 6).alias("Avg_ROI"),
    )


LAYERS = {
    "bronze": ("Campaign_ID", "Clicks", "Impressions", "NULL", "campaigns"),
    "silver": ("Campaign_ID", "Clicks", "Impressions", "Acquisition_Cost", "silver"),
    "filtered": ("Campaign_ID", "Clicks", "Impressions", "Acquisition_Cost", "filtered"),
}
SUMMARIES = {
    "campaign_summary": ("Campaign_ID", "filtered"),
    "channel_summary": ("Channel_Used", "filtered"),
    "daily_summary": ('"Date"', 'filtered WHERE "Date" IS NOT NULL'),
}


@checked(
    sql(
        " UNION ALL ".join(
            [
                f"""SELECT '{layer}' AS layer, CAST({key} AS VARCHAR) AS key,
                           CAST({clicks} AS BIGINT) AS clicks, CAST({seen} AS BIGINT) AS impressions,
                           round(CAST({cost} AS DOUBLE), 2) AS cost
                    FROM {rows}"""
                for layer, (key, clicks, seen, cost, rows) in LAYERS.items()
            ]
            + [
                f"""SELECT '{table}', CAST({key} AS VARCHAR), CAST(sum(Clicks) AS BIGINT),
                           CAST(sum(Impressions) AS BIGINT), round(sum(Acquisition_Cost), 2)
                    FROM {rows} GROUP BY {key}"""
                for table, (key, rows) in SUMMARIES.items()
            ]
            + [
                """SELECT 'sql_metrics', Campaign_Type, CAST(sum(Clicks) AS BIGINT),
                          CAST(sum(Impressions) AS BIGINT), NULL FROM filtered GROUP BY Campaign_Type""",
                """SELECT 'failed', 'ROI', count(*), NULL, NULL FROM filtered WHERE ROI < 0 HAVING count(*) > 0""",
                """SELECT 'failed', 'CTR', count(*), NULL, NULL FROM filtered WHERE Clicks > Impressions
                   HAVING count(*) > 0""",
                """SELECT 'rows', 'bronze rows', count(*), NULL, NULL FROM campaigns""",
                """SELECT 'rows', 'silver rows', count(*), NULL, NULL FROM silver""",
                """SELECT 'nulls', 'Campaign_ID', count(*) - count(Campaign_ID), count(*) - count(Campaign_ID), NULL
                   FROM campaigns""",
                """SELECT 'nulls', 'Date', 0, count(*) FILTER ("Date" = 'n/a'), NULL FROM campaigns""",
            ]
        )
    )
)
def full_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw CSV to validated reporting tables, row by row, with the reports of the run. Two
    checks fail by the nature of the data: ROI is negative in places, and some
    click-through rates are above 1."""
    root = io.shared_dir(spark, "full_pipeline")
    raw = feed.campaigns(spark, sf_dir).select(*BUSINESS, *TIE_BREAK)
    write_csv(raw, f"{root}/raw")
    made = run_full(spark, f"{root}/raw", f"{root}/lake", SPEC, FIRST_RUN)

    def rows(df: DataFrame, layer: str, key: Column, clicks: str, seen: str | None, cost: str | None) -> DataFrame:
        return df.select(
            F.lit(layer).alias("layer"),
            key.cast("string").alias("key"),
            F.col(clicks).cast("long").alias("clicks"),
            (F.col(seen) if seen else F.lit(None)).cast("long").alias("impressions"),
            F.round((F.col(cost) if cost else F.lit(None)).cast("double"), 2).alias("cost"),
        )

    parts = [
        rows(made[layer], layer, F.col(key), clicks, seen, None if cost == "NULL" else cost)
        for layer, (key, clicks, seen, cost, _) in LAYERS.items()
    ]
    totals = ("Total_Clicks", "Total_Impressions", "Total_Acquisition_Cost")
    parts += [rows(made[table], table, F.col(key.strip('"')), *totals) for table, (key, _) in SUMMARIES.items()]
    parts.append(rows(made["sql_metrics"], "sql_metrics", F.col("Campaign_Type"), *totals[:2], None))
    failed = made["validation"].where(~F.col("passed"))
    parts.append(rows(failed, "failed", F.col("column"), "violations", None, None))
    counts = made["row_counts"].where("metric = 'rows' AND stage <> 'filtered'")
    parts.append(rows(counts, "rows", F.concat_ws(" ", "stage", "metric"), "value", None, None))
    parts.append(rows(made["null_audit"], "nulls", F.col("column"), "nulls_before", "nulls_after", None))
    return reduce(DataFrame.unionByName, parts)
