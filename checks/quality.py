"""Profiling, validation, reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adlake.operators import gold as G
from adlake.operators import quality as Q
from checks import feed
from checks.feed import BUSINESS, SPEC, sql
from checks.registry import checked

NUMERIC = (*SPEC.keys, *SPEC.measures)
DIMENSIONS = SPEC.profiled_dimensions
COST_SQL = "try_cast(regexp_replace(Acquisition_Cost, '[$,]', '', 'g') AS DOUBLE)"
RAW_NUMBERS = {
    name: COST_SQL if name == "Acquisition_Cost" else name for name in NUMERIC
}
SERVED_CTR = "CASE WHEN Impressions > 0 THEN CAST(Clicks AS DOUBLE) / Impressions ELSE 0 END"


def _per_column(
    tests: dict[str, str], rows: str, count_name: str, first: str = ""
) -> str:
    """One SELECT per column: how many rows meet its test."""
    return " UNION ALL ".join(
        f"""SELECT {first} '{name}' AS "column",
                   count(*) FILTER ({test}) AS {count_name} FROM {rows}"""
        for name, test in tests.items()
    )


def _nulls(columns: tuple[str, ...]) -> dict[str, str]:
    return {name: f'"{name}" IS NULL' for name in columns}


NEGATIVES = {name: f"{value} < 0" for name, value in RAW_NUMBERS.items()}
OUT_OF_RANGE = {
    "CTR": f"{SERVED_CTR} < 0 OR {SERVED_CTR} > 1",
    "Conversion_Rate": "Conversion_Rate < 0 OR Conversion_Rate > 1",
}


@checked(sql(_per_column(_nulls(BUSINESS), "campaigns", "nulls")))
def null_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.null_counts(feed.campaigns(spark, sf_dir), BUSINESS)


@checked(sql(_per_column(_nulls(SPEC.critical), "campaigns", "nulls")))
def critical_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.critical_nulls(feed.campaigns(spark, sf_dir, *SPEC.critical), SPEC)


@checked(sql(_per_column(NEGATIVES, "campaigns", "negatives")))
def negative_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.negative_counts(feed.campaigns(spark, sf_dir, *NUMERIC), NUMERIC, SPEC)


@checked(sql(_per_column(OUT_OF_RANGE, "silver", "violations")))
def range_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = feed.silver(spark, sf_dir, "Clicks", "Impressions", "Conversion_Rate")
    return Q.range_violations(rows)


DUPLICATES = """SELECT Campaign_ID, count(*) AS row_count FROM campaigns
                GROUP BY Campaign_ID HAVING count(*) > 1"""


@checked(sql(DUPLICATES))
def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.duplicate_keys(feed.campaigns(spark, sf_dir, "Campaign_ID"), SPEC.keys)


DISTINCT = " UNION ALL ".join(
    f"""SELECT DISTINCT '{name}' AS "column", {name} AS "value" FROM campaigns"""
    for name in DIMENSIONS
)


@checked(sql(DISTINCT))
def distinct_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.distinct_values(feed.campaigns(spark, sf_dir, *DIMENSIONS), DIMENSIONS)


DISTINCT_COUNTS = f"""SELECT "column", count(*) AS distinct_values
                      FROM ({DISTINCT}) GROUP BY "column\""""


@checked(sql(DISTINCT_COUNTS))
def distinct_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.distinct_counts(feed.campaigns(spark, sf_dir, *DIMENSIONS), DIMENSIONS)


ANY_NEGATIVE = {"*": " OR ".join(f"({test})" for test in NEGATIVES.values())}


@checked(
    sql(
        " UNION ALL ".join(
            [
                _per_column({"*": "true"}, "campaigns", "value", """'rows' AS "check","""),
                _per_column(
                    _nulls(BUSINESS), "campaigns", "value", """'nulls' AS "check","""
                ),
                _per_column(
                    NEGATIVES, "campaigns", "value", """'negatives' AS "check","""
                ),
                _per_column(
                    ANY_NEGATIVE, "campaigns", "value", """'any_negative' AS "check","""
                ),
                f"SELECT 'distinct', * FROM ({DISTINCT_COUNTS})",
                f"SELECT 'duplicated', 'Campaign_ID', count(*) FROM ({DUPLICATES})",
            ]
        )
    )
)
def profile_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The profile's figures as one table."""
    bronze = feed.campaigns(spark, sf_dir).select(*BUSINESS)
    found = Q.profile(feed.stored(bronze, "profile_report"), SPEC)
    distinct = found["distinct_counts"].select(
        F.lit("distinct").alias("check"),
        "column",
        F.col("distinct_values").alias("value"),
    )
    duplicated = found["duplicates"].agg(F.count(F.lit(1)).alias("value")).select(
        F.lit("duplicated").alias("check"), F.lit("Campaign_ID").alias("column"), "value"
    )
    return found["counts"].unionByName(distinct).unionByName(duplicated)


def gold_tables(rows: DataFrame) -> dict[str, DataFrame]:
    return G.gold(rows, SPEC)


def _totals(table: str, scope: str, silver_rows: str, gold_rows: str) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{table}' AS "table", '{scope}' AS scope, '{metric}' AS metric,
                   s.total AS silver, g.total AS gold, s.total = g.total AS matches
            FROM (SELECT CAST(sum({metric}) AS BIGINT) AS total FROM {silver_rows}) s,
                 (SELECT CAST(sum({metric}) AS BIGINT) AS total FROM {gold_rows}) g"""
        for metric in ("Clicks", "Impressions")
    )


DATED = """dated AS (SELECT * FROM filtered WHERE "Date" IS NOT NULL)"""


@checked(
    sql(
        " UNION ALL ".join(
            [
                _totals("campaign_summary", "all", "filtered", "filtered"),
                _totals("channel_summary", "all", "filtered", "filtered"),
                _totals("daily_summary", "all", "filtered", "dated"),
                _totals("daily_summary", "dated", "dated", "dated"),
            ]
        ),
        DATED,
    )
)
def reconcile_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = feed.filtered(
        spark, sf_dir, "Campaign_Type", "Company", "Engagement_Score"
    )
    rows = feed.stored(rows, "reconcile_totals")
    return Q.reconcile_gold(rows, gold_tables(rows), SPEC)


FILTERED_NEGATIVES = {name: f"{name} < 0" for name in SPEC.measures}
PASSED = "violations = 0 AS passed"


@checked(
    sql(
        f"""SELECT *, {PASSED} FROM (
                {_per_column(_nulls(SPEC.critical), "filtered", "violations",
                             "'critical_nulls' AS " + '"check",')}
                UNION ALL
                {_per_column(FILTERED_NEGATIVES, "filtered", "violations",
                             "'negative_values' AS " + '"check",')}
                UNION ALL
                {_per_column(OUT_OF_RANGE, "filtered", "violations",
                             "'unit_range' AS " + '"check",')}
                UNION ALL
                SELECT 'totals_' || t, m, 0::BIGINT
                FROM (VALUES ('campaign_summary'), ('channel_summary'),
                             ('daily_summary')) a(t),
                     (VALUES ('Clicks'), ('Impressions')) b(m))"""
    )
)
def validation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = feed.filtered(
        spark, sf_dir, "Campaign_Type", "Company", "Engagement_Score"
    )
    rows = feed.stored(rows, "validation_report")
    return Q.validate(rows, gold_tables(rows), SPEC)


@checked(
    sql(
        f"""SELECT raw_rows, stored_rows, raw_rows - stored_rows AS new_rows
            FROM (SELECT count(*) AS raw_rows,
                         count(*) FILTER (l_shipdate < TIMESTAMP '{feed.SPLIT_DAY}')
                             AS stored_rows
                  FROM campaigns)"""
    )
)
def row_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = feed.campaigns(spark, sf_dir, "Campaign_ID")
    return Q.row_delta(rows, feed.earlier(rows))


@checked(
    sql(
        """SELECT 'bronze' AS stage, 'rows' AS metric, count(*) AS "value" FROM campaigns
           UNION ALL SELECT 'bronze', 'rows_with_key', count(Campaign_ID) FROM campaigns
           UNION ALL SELECT 'silver', 'rows', count(*) FROM silver
           UNION ALL SELECT 'filtered', 'rows', count(*) FROM filtered"""
    )
)
def stage_row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = feed.campaigns(
        spark,
        sf_dir,
        "Campaign_ID",
        "Channel_Used",
        "Conversion_Rate",
        "Acquisition_Cost",
        "ROI",
        "Clicks",
        "Impressions",
        "Date",
    )
    return Q.stage_row_counts(raw, feed.clean(raw, SPEC), SPEC)
