"""The campaign table, derived from the star schema: one campaign per line item.

It has what cleaning is about: missing keys (one supplier in 41), several rows
per key, costs as currency text, dates in three formats or none, missing
measures and channels. Rows that share a key are ordered by ``TIE_BREAK``.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adlake.operators.clean import business_filter, clean
from adlake.sources import overwrite, shared_dir
from adlake.spec import RAW_SCHEMA, CampaignSpec

TIE_BREAK = (
    "l_linenumber",
    "l_partkey",
    "l_suppkey",
    "l_quantity",
    "l_extendedprice",
)
BUSINESS = tuple(RAW_SCHEMA.fieldNames())
SPEC = CampaignSpec(
    raw_schema=T.StructType(
        [
            *RAW_SCHEMA.fields,
            T.StructField("l_linenumber", T.IntegerType()),
            T.StructField("l_partkey", T.LongType()),
            T.StructField("l_suppkey", T.LongType()),
            T.StructField("l_quantity", T.DoubleType()),
            T.StructField("l_extendedprice", T.DoubleType()),
        ]
    ),
    tie_break=TIE_BREAK,
)
SPLIT_DAY = "1998-06-01"


def _one_in(column: str, n: int) -> Column:
    return F.col(column) % n == 0


def _campaign_columns() -> dict[str, Column]:
    supplier, line = F.col("l_suppkey") % 8, F.col("l_linenumber") % 4
    channel = F.when(supplier == 0, "YouTube")
    for number, name in enumerate(
        ("Email", "Instagram", "Website", "Google Ads", "Facebook", "Radio"), start=1
    ):
        channel = channel.when(supplier == number, name)
    duration = F.when(line == 0, "15 days").when(line == 1, "30 days")
    day = F.col("l_shipdate")
    date_text = (
        F.when(line == 0, F.date_format(day, "yyyy-MM-dd"))
        .when(line == 1, F.date_format(day, "dd-MM-yyyy"))
        .when(line == 2, F.date_format(day, "MM/dd/yyyy"))
        .otherwise("n/a")
    )
    price_text = F.concat(F.lit("$"), F.format_number("l_extendedprice", 2))
    clicks = F.when(F.col("l_quantity") > 48, 0).otherwise(
        F.col("l_quantity").cast("int")
    )
    impressions = ((F.col("l_linenumber") - 1) * 20).cast("int")
    rate = F.round(F.col("l_discount") + F.col("l_tax"), 2)
    roi = F.round(F.col("l_tax") * 100 - 2, 0)
    return {
        "Campaign_ID": F.when(~_one_in("l_suppkey", 41), F.col("l_orderkey")),
        "Company": F.col("s_name"),
        "Campaign_Type": F.col("p_type"),
        "Target_Audience": F.col("p_brand"),
        "Duration": duration.when(line == 2, "45 days").otherwise("60 days"),
        "Channel_Used": channel,
        "Conversion_Rate": F.when(~_one_in("l_partkey", 13), rate),
        "Acquisition_Cost": F.when(~_one_in("l_partkey", 11), price_text),
        "ROI": F.when(~_one_in("l_partkey", 17), roi),
        "Location": F.col("n_name"),
        "Language": F.col("l_returnflag"),
        "Clicks": F.when(~_one_in("l_partkey", 19), clicks),
        "Impressions": F.when(~_one_in("l_partkey", 23), impressions),
        "Engagement_Score": (F.col("p_size") % 10 + 1).cast("int"),
        "Customer_Segment": F.col("c_mktsegment"),
        "Date": date_text,
    }


@lru_cache
def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; its footer is looked at once per session."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def campaigns(
    spark: SparkSession, sf_dir: str, *columns: str, keep: tuple[str, ...] = ()
) -> DataFrame:
    """The campaign rows with the given business columns (all if none is given),
    the tie-break columns, the ship date, and those to ``keep`` of the line item.

    All five joins are made whatever the columns: a line item without its partners
    is no campaign. Orders meet their customers first, so that line items, the largest
    table, aren't shuffled once more for them.
    """
    wanted = columns or BUSINESS

    def partner(rows: DataFrame, name: str, foreign: str, own: str) -> DataFrame:
        return rows.join(table(spark, sf_dir, name), F.col(foreign) == F.col(own))

    buyers = partner(table(spark, sf_dir, "customer"), "nation", "c_nationkey", "n_nationkey")
    orders = table(spark, sf_dir, "orders").join(buyers, F.col("o_custkey") == F.col("c_custkey"))
    rows = partner(table(spark, sf_dir, "lineitem"), "supplier", "l_suppkey", "s_suppkey")
    rows = partner(rows, "part", "l_partkey", "p_partkey")
    rows = rows.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    expressions = _campaign_columns()
    return rows.select(
        *(expressions[name].alias(name) for name in wanted), *TIE_BREAK, "l_shipdate", *keep
    )


def earlier(df: DataFrame) -> DataFrame:
    """The part of the rows that was loaded before."""
    return df.where(F.col("l_shipdate") < F.lit(SPLIT_DAY).cast("timestamp_ntz"))


def later(df: DataFrame) -> DataFrame:
    """All other rows."""
    return df.where(F.col("l_shipdate") >= F.lit(SPLIT_DAY).cast("timestamp_ntz"))


def silver(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return clean(campaigns(spark, sf_dir, *_with_cleaned(columns)), SPEC)


def filtered(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return business_filter(silver(spark, sf_dir, *columns), SPEC)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Rows that several plans start from, written once to the shared folder."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    overwrite(df, path)
    return spark.read.schema(df.schema).parquet(path)


def _with_cleaned(columns: tuple[str, ...]) -> tuple[str, ...]:
    """Add the columns that cleaning and the business filter look at."""
    if not columns:
        return ()
    needed = {*columns, *SPEC.keys, SPEC.date, SPEC.channel, *SPEC.measures}
    if "Engagement_Score" not in columns:
        needed.discard("Engagement_Score")
    return tuple(name for name in BUSINESS if name in needed)


CTES = """
campaigns AS (
    SELECT CASE WHEN l_suppkey % 41 = 0 THEN NULL ELSE l_orderkey END AS Campaign_ID,
           s_name AS Company,
           p_type AS Campaign_Type,
           p_brand AS Target_Audience,
           CASE l_linenumber % 4 WHEN 0 THEN '15 days' WHEN 1 THEN '30 days'
                WHEN 2 THEN '45 days' ELSE '60 days' END AS Duration,
           CASE l_suppkey % 8 WHEN 0 THEN 'YouTube' WHEN 1 THEN 'Email'
                WHEN 2 THEN 'Instagram' WHEN 3 THEN 'Website' WHEN 4 THEN 'Google Ads'
                WHEN 5 THEN 'Facebook' WHEN 6 THEN 'Radio' END AS Channel_Used,
           CASE WHEN l_partkey % 13 = 0 THEN NULL
                ELSE round(l_discount + l_tax, 2) END AS Conversion_Rate,
           CASE WHEN l_partkey % 11 = 0 THEN NULL
                ELSE '$' || format('{:,.2f}', l_extendedprice) END AS Acquisition_Cost,
           CASE WHEN l_partkey % 17 = 0 THEN NULL
                ELSE round(l_tax * 100 - 2, 0) END AS ROI,
           n_name AS Location,
           l_returnflag AS Language,
           CASE WHEN l_partkey % 19 = 0 THEN NULL WHEN l_quantity > 48 THEN 0
                ELSE CAST(l_quantity AS INTEGER) END AS Clicks,
           CASE WHEN l_partkey % 23 = 0 THEN NULL
                ELSE CAST((l_linenumber - 1) * 20 AS INTEGER) END AS Impressions,
           CAST(p_size % 10 + 1 AS INTEGER) AS Engagement_Score,
           c_mktsegment AS Customer_Segment,
           CASE l_linenumber % 4 WHEN 0 THEN strftime(l_shipdate, '%Y-%m-%d')
                WHEN 1 THEN strftime(l_shipdate, '%d-%m-%Y')
                WHEN 2 THEN strftime(l_shipdate, '%m/%d/%Y') ELSE 'n/a' END AS "Date",
           l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate
    FROM lineitem
    JOIN supplier ON l_suppkey = s_suppkey
    JOIN part ON l_partkey = p_partkey
    JOIN orders ON l_orderkey = o_orderkey
    JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey
),
amounts AS (
    SELECT * REPLACE (
        CASE WHEN Acquisition_Cost IS NULL THEN 0
             ELSE try_cast(regexp_replace(Acquisition_Cost, '[$,]', '', 'g') AS DOUBLE)
        END AS Acquisition_Cost,
        coalesce(try_strptime("Date", '%Y-%m-%d'), try_strptime("Date", '%d-%m-%Y'),
                 try_strptime("Date", '%m/%d/%Y'))::DATE AS "Date",
        coalesce(Conversion_Rate, 0) AS Conversion_Rate,
        coalesce(ROI, 0) AS ROI,
        coalesce(Clicks, 0) AS Clicks,
        coalesce(Impressions, 0) AS Impressions,
        coalesce(Engagement_Score, 0) AS Engagement_Score)
    FROM campaigns WHERE Campaign_ID IS NOT NULL
),
silver AS (
    SELECT * FROM amounts
    QUALIFY row_number() OVER (
        PARTITION BY Campaign_ID
        ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) = 1
),
filtered AS (
    SELECT * FROM silver
    WHERE Impressions > 0 AND Acquisition_Cost >= 0
      AND Channel_Used IN ('YouTube', 'Email', 'Instagram', 'Website', 'Google Ads',
                           'Facebook')
      AND (Clicks > 0 OR Conversion_Rate > 0)
)
"""


def sql(body: str, *more_ctes: str) -> str:
    """``body`` over the tables campaigns, silver and filtered."""
    return "WITH " + ",\n".join([CTES, *more_ctes]) + "\n" + body
