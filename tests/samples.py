"""Campaign rows for tests: one good row, changed where a test needs it."""

from pyspark.sql import types as T

from adlake.spec import RAW_SCHEMA

GOOD = {
    "Campaign_ID": 1,
    "Company": "Innovate Industries",
    "Campaign_Type": "Email",
    "Target_Audience": "Men 18-24",
    "Duration": "30 days",
    "Channel_Used": "Google Ads",
    "Conversion_Rate": 0.04,
    "Acquisition_Cost": "$16,174.00",
    "ROI": 6.29,
    "Location": "Chicago",
    "Language": "Spanish",
    "Clicks": 506,
    "Impressions": 1922,
    "Engagement_Score": 6,
    "Customer_Segment": "Health & Wellness",
    "Date": "2021-01-01",
}


def campaign(**changes):
    return {**GOOD, **changes}


def raw_table(spark, rows, schema: T.StructType = RAW_SCHEMA):
    return spark.createDataFrame(
        [tuple(row[name] for name in schema.names) for row in rows], schema
    )
