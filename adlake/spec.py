"""What a campaign table looks like and which fixed rules apply to it.

Everything that another fact table would need to change sits in
:class:`CampaignSpec`; the operators take the spec (or plain column names) as
an argument and hold no constants of their own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Column names and order, allowed channels, date formats, the
# filler text and the thresholds decide the results and are stated as given.
# ---------------------------------------------------------------------------
RAW_SCHEMA = T.StructType(
    [
        T.StructField("Campaign_ID", T.LongType()),
        T.StructField("Company", T.StringType()),
        T.StructField("Campaign_Type", T.StringType()),
        T.StructField("Target_Audience", T.StringType()),
        T.StructField("Duration", T.StringType()),
        T.StructField("Channel_Used", T.StringType()),
        T.StructField("Conversion_Rate", T.DoubleType()),
        T.StructField("Acquisition_Cost", T.StringType()),
        T.StructField("ROI", T.DoubleType()),
        T.StructField("Location", T.StringType()),
        T.StructField("Language", T.StringType()),
        T.StructField("Clicks", T.IntegerType()),
        T.StructField("Impressions", T.IntegerType()),
        T.StructField("Engagement_Score", T.IntegerType()),
        T.StructField("Customer_Segment", T.StringType()),
        T.StructField("Date", T.StringType()),
    ]
)

DIMENSIONS = (
    "Company",
    "Campaign_Type",
    "Target_Audience",
    "Duration",
    "Channel_Used",
    "Location",
    "Language",
    "Customer_Segment",
)
PROFILED_DIMENSIONS = (
    "Company",
    "Campaign_Type",
    "Target_Audience",
    "Duration",
    "Channel_Used",
    "Location",
    "Customer_Segment",
)
MEASURES = (
    "Conversion_Rate",
    "Acquisition_Cost",
    "ROI",
    "Clicks",
    "Impressions",
    "Engagement_Score",
)
CRITICAL_COLUMNS = ("Campaign_ID", "Company", "Channel_Used")
VALID_CHANNELS = (
    "YouTube",
    "Email",
    "Instagram",
    "Website",
    "Google Ads",
    "Facebook",
)
DATE_FORMATS = ("yyyy-MM-dd", "dd-MM-yyyy", "MM/dd/yyyy")
UNKNOWN = "Unknown"
HIGH_CONVERSION_ABOVE = 0.10
MEDIUM_CONVERSION_FROM = 0.05
ROI_FLOOR = -1.0
ROI_CEILING = 5.0
LOW_RISK_FROM = 1.0
MEDIUM_RISK_FROM = 0.0
# ---------------------------------------------------------------------------

INGESTED_AT = "ingestion_timestamp"
SOURCE_FILE = "source_file"
CORRUPT_RECORD = "corrupt_record"
QUARANTINED = "quarantined"
CLEANED_AT = "silver_cleaned_timestamp"
FILTERED_AT = "filter_timestamp"
AGGREGATED_AT = "aggregation_timestamp"
METRICS_AT = "metrics_timestamp"
AUDIT_COLUMNS = (
    SOURCE_FILE,
    CORRUPT_RECORD,
    QUARANTINED,
    INGESTED_AT,
    CLEANED_AT,
    FILTERED_AT,
    AGGREGATED_AT,
    METRICS_AT,
)


@dataclass(frozen=True)
class CampaignSpec:
    """Column roles of a campaign-style fact table.

    ``tie_break`` orders the rows that share a key; the first one survives the
    dedupe. Left empty, all remaining columns are used, so the outcome never
    depends on how the rows happen to be partitioned.
    """

    raw_schema: T.StructType = RAW_SCHEMA
    keys: tuple[str, ...] = ("Campaign_ID",)
    tie_break: tuple[str, ...] = ()
    dimensions: tuple[str, ...] = DIMENSIONS
    profiled_dimensions: tuple[str, ...] = PROFILED_DIMENSIONS
    measures: tuple[str, ...] = MEASURES
    currency: str = "Acquisition_Cost"
    date: str = "Date"
    date_formats: tuple[str, ...] = DATE_FORMATS
    channel: str = "Channel_Used"
    channels: tuple[str, ...] = VALID_CHANNELS
    critical: tuple[str, ...] = CRITICAL_COLUMNS
    unknown: str = UNKNOWN

    @property
    def bronze_schema(self) -> T.StructType:
        """Raw columns plus lineage and ingestion time."""
        return T.StructType(
            [
                *self.raw_schema.fields,
                T.StructField(SOURCE_FILE, T.StringType()),
                T.StructField(INGESTED_AT, T.TimestampType()),
            ]
        )

    @property
    def stored_schema(self) -> T.StructType:
        """Bronze with the text of records that can't be read, which are set apart."""
        return T.StructType(
            [
                *self.bronze_schema.fields,
                T.StructField(CORRUPT_RECORD, T.StringType()),
                T.StructField(QUARANTINED, T.BooleanType()),
            ]
        )


DEFAULT_SPEC = CampaignSpec()
