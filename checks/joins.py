"""Anti joins by key and the unions that go with them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adlake.operators import incremental as I
from adlake.operators.clean import business_filter, clean, dedupe_order
from adlake.operators.metrics import campaign_metrics, update_metrics
from adlake.sources import Lake, schema_listing, shared_dir
from checks import feed
from checks.aggregates import METRICS_SQL, rounded_metrics
from checks.feed import SPEC, SPLIT_DAY, TIE_BREAK, sql
from checks.registry import checked

TIE_LIST = ", ".join(TIE_BREAK)
EARLIER = f"l_shipdate < TIMESTAMP '{SPLIT_DAY}'"
LATER = f"l_shipdate >= TIMESTAMP '{SPLIT_DAY}'"

# The filtered layer as the earlier rows alone would have made it.
STORED = f"""
stored AS (
    SELECT * FROM (
        SELECT * FROM amounts WHERE {EARLIER}
        QUALIFY row_number() OVER (
            PARTITION BY Campaign_ID
            ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) = 1)
    WHERE Impressions > 0 AND Acquisition_Cost >= 0
      AND Channel_Used IN ('YouTube', 'Email', 'Instagram', 'Website', 'Google Ads',
                           'Facebook')
      AND (Clicks > 0 OR Conversion_Rate > 0)
)"""
FILTERED_COLUMNS = ("Campaign_ID", "Channel_Used", "Clicks", "Impressions", "Date")
FILTERED_LIST = 'Campaign_ID, Channel_Used, Clicks, Impressions, "Date", l_linenumber'


def stored_and_fresh(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Filtered rows of the earlier load, and of a load of everything."""
    rows = feed.campaigns(
        spark,
        sf_dir,
        *FILTERED_COLUMNS,
        "Conversion_Rate",
        "Acquisition_Cost",
        "ROI",
    )
    stored = business_filter(clean(feed.earlier(rows), SPEC), SPEC)
    return stored, business_filter(clean(rows, SPEC), SPEC)


@checked(
    sql(
        f"""SELECT Campaign_ID, {TIE_LIST} FROM campaigns n
            WHERE {LATER} AND Campaign_ID IS NOT NULL
              AND NOT EXISTS (SELECT 1 FROM campaigns e
                              WHERE e.Campaign_ID = n.Campaign_ID AND e.{EARLIER})"""
    )
)
def anti_join_new_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Later rows, duplicates included, of keys the earlier rows do not have.

    Neither side is unique here, hence the salt.
    """
    rows = feed.campaigns(spark, sf_dir, "Campaign_ID")
    fresh = I.unseen_rows(feed.later(rows), feed.earlier(rows), SPEC.keys, salts=8)
    return fresh.drop("l_shipdate")


@checked(
    sql(
        f"""SELECT Campaign_ID, {TIE_LIST} FROM campaigns n
            WHERE {LATER} AND Campaign_ID IS NOT NULL
              AND NOT EXISTS (SELECT 1 FROM campaigns e
                              WHERE e.Campaign_ID = n.Campaign_ID AND e.{EARLIER})
            QUALIFY row_number() OVER (PARTITION BY Campaign_ID ORDER BY {TIE_LIST}) = 1"""
    )
)
def new_keys_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The increment of a layer: one row for each unseen key."""
    rows = feed.campaigns(spark, sf_dir, "Campaign_ID")
    batch, stored = feed.later(rows), feed.earlier(rows)
    measured = I.measure_keys(batch, SPEC.keys)
    fresh = I.new_rows(batch, stored, SPEC.keys, dedupe_order(batch, SPEC), measured)
    return fresh.drop("l_shipdate")


@checked(
    sql(
        f"""SELECT Campaign_ID, {TIE_LIST} FROM campaigns n
            WHERE {LATER} AND Campaign_ID IS NOT NULL
              AND NOT EXISTS (SELECT 1 FROM campaigns e
                              WHERE e.Campaign_ID = n.Campaign_ID AND e.{EARLIER})
            QUALIFY row_number() OVER (PARTITION BY Campaign_ID ORDER BY {TIE_LIST}) = 1"""
    )
)
def new_keys_beyond_broadcast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The increment of a layer by a batch whose keys count as too many to broadcast: they
    are put into a filter that the layer's rows must pass before they are shuffled."""
    rows = feed.campaigns(spark, sf_dir, "Campaign_ID")
    batch, stored = feed.later(rows), feed.earlier(rows)
    measured = I.measure_keys(batch, SPEC.keys, broadcast_bytes=0)
    fresh = I.new_rows(batch, stored, SPEC.keys, dedupe_order(batch, SPEC), measured)
    return fresh.drop("l_shipdate")


@checked(
    sql(
        f"""SELECT {FILTERED_LIST} FROM filtered
            WHERE Campaign_ID NOT IN (SELECT Campaign_ID FROM stored)""",
        STORED,
    )
)
def filtered_increment(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored, fresh = stored_and_fresh(spark, sf_dir)
    unseen = I.unseen_rows(fresh, stored, SPEC.keys)
    return unseen.select(*FILTERED_COLUMNS, "l_linenumber")


@checked(
    sql(
        f"""SELECT {FILTERED_LIST} FROM stored
            UNION ALL
            SELECT {FILTERED_LIST} FROM filtered
            WHERE Campaign_ID NOT IN (SELECT Campaign_ID FROM stored)""",
        STORED,
    )
)
def filtered_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored, fresh = stored_and_fresh(spark, sf_dir)
    merged = I.merge_new(stored, fresh, SPEC.keys, dedupe_order(fresh, SPEC))
    return merged.select(*FILTERED_COLUMNS, "l_linenumber")


@checked(
    sql(
        f"""SELECT * FROM ({METRICS_SQL.format(rows="known_types")})
            UNION ALL
            SELECT * FROM ({METRICS_SQL.format(rows="filtered")})
            WHERE Campaign_Type NOT IN (SELECT Campaign_Type FROM known_types)""",
        STORED,
        "known_types AS (SELECT * FROM stored WHERE Campaign_Type < 'M')",
    )
)
def metrics_insert_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types of the first load keep their old figures, the others are added."""
    rows = feed.campaigns(
        spark,
        sf_dir,
        *FILTERED_COLUMNS,
        "Campaign_Type",
        "Conversion_Rate",
        "Acquisition_Cost",
        "ROI",
    )
    stored = business_filter(clean(feed.earlier(rows), SPEC), SPEC)
    stored = stored.where(F.col("Campaign_Type") < "M")
    fresh = business_filter(clean(rows, SPEC), SPEC)
    table = update_metrics(
        campaign_metrics(stored), campaign_metrics(fresh), "insert_only"
    )
    return rounded_metrics(table)


@checked(sql(f"SELECT Campaign_ID, Clicks, {TIE_LIST} FROM campaigns"))
def union_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both parts together are the table again; their column orders differ."""
    rows = feed.campaigns(spark, sf_dir, "Campaign_ID", "Clicks")
    first = feed.earlier(rows).drop("l_shipdate")
    second = feed.later(rows).select(*reversed(first.columns))
    return I.union_by_name(first, second)


@checked(sql("SELECT DISTINCT Campaign_ID FROM campaigns"))
def distinct_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.distinct_keys(feed.campaigns(spark, sf_dir, "Campaign_ID"), SPEC.keys)


@checked(
    """SELECT c_custkey, c_name, CAST(NULL AS DOUBLE) AS c_acctbal FROM customer WHERE c_custkey % 2 = 0
       UNION ALL SELECT c_custkey, NULL, c_acctbal FROM customer WHERE c_custkey % 2 = 1"""
)
def union_by_name_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each half lacks a column of the other, and the second has wider keys."""
    customers = feed.table(spark, sf_dir, "customer")
    even = F.col("c_custkey") % 2 == 0
    first = customers.where(even).select(F.col("c_custkey").cast("int").alias("c_custkey"), "c_name")
    second = customers.where(~even).select("c_acctbal", F.col("c_custkey").cast("long").alias("c_custkey"))
    return I.union_by_name(first, second, allow_missing=True)


@checked(
    """SELECT c_custkey, c_name, CASE WHEN c_custkey % 2 = 1 THEN c_acctbal END AS c_acctbal,
              'c_acctbal double' AS listed FROM customer"""
)
def layer_new_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch brings a column that a stored layer does not have, and wider keys."""
    customers = feed.table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    even = F.col("c_custkey") % 2 == 0
    lake = Lake(spark, shared_dir(spark, "layer_new_column"))
    narrow = customers.where(even).withColumn("c_custkey", F.col("c_custkey").cast("int"))
    lake.replace("customers", narrow.drop("c_acctbal"), 1)
    lake.append("customers", customers.where(~even).withColumn("c_custkey", F.col("c_custkey").cast("long")), 2)
    rows = lake.read("customers")
    listed = schema_listing(rows).where("column = 'c_acctbal'")
    return rows.withColumn("listed", listed.select(F.concat_ws(" ", "column", "type")).scalar())
