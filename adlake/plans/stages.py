"""The stages of a full run, each of which can be run on its own.

A stage reads the layer before it from where it is stored and writes its own, so
no stage repeats the work of an earlier one. A layer that is not there yet counts
as an empty one.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adlake.operators.clean import business_filter, clean, typed_date
from adlake.operators.incremental import unseen_rows
from adlake.operators.metrics import campaign_metrics, update_metrics
from adlake.operators.quality import null_audit, profile, stage_row_counts, validate
from adlake.plans.increment import COUNTS, as_bronze, refresh_gold
from adlake.sources import lake as L
from adlake.sources.lake import Lake
from adlake.sources.readers import (
    quarantined_rows,
    read_csv,
    read_or_empty,
    schema_listing,
    sound_rows,
    to_micros,
    with_lineage,
)
from adlake.sources.sinks import typed_empty
from adlake.spec import CORRUPT_RECORD, DEFAULT_SPEC, QUARANTINED, CampaignSpec

PRESENCE = "check string, column string, violations long"


def stored_bronze(lake: Lake, spec: CampaignSpec = DEFAULT_SPEC) -> DataFrame:
    """All raw records with the mark of those that could not be read, whether batches or
    a stream have brought them."""
    if lake.has(L.BRONZE):
        return lake.read(L.BRONZE)
    return read_or_empty(lake.spark, f"{lake.root}/{L.STREAMED}", spec.stored_schema)


def bronze_rows(lake: Lake, spec: CampaignSpec = DEFAULT_SPEC) -> DataFrame:
    """The raw rows that could be read."""
    return sound_rows(stored_bronze(lake, spec))


def quarantine(lake: Lake, spec: CampaignSpec = DEFAULT_SPEC) -> DataFrame:
    """File, ingestion time and text of raw records that could not be read. They lie in
    a partition of bronze, so nothing else is opened."""
    return quarantined_rows(stored_bronze(lake, spec))


def silver_rows(lake: Lake, spec: CampaignSpec = DEFAULT_SPEC) -> DataFrame:
    if lake.has(L.SILVER):
        return lake.read(L.SILVER)
    return clean(typed_empty(lake.spark, spec.bronze_schema), spec)


def filtered_rows(lake: Lake, spec: CampaignSpec = DEFAULT_SPEC) -> DataFrame:
    if lake.has(L.FILTERED):
        return lake.read(L.FILTERED)
    return clean(typed_empty(lake.spark, spec.bronze_schema), spec)


def explore_schema(
    lake: Lake, raw_path: str | list[str], spec: CampaignSpec = DEFAULT_SPEC
) -> DataFrame:
    """Columns and types as the raw files have them (inferred), with counts, next to
    the types expected; a column that only one side has is null on the other."""
    found = schema_listing(read_csv(lake.spark, raw_path, None))
    expected = lake.spark.createDataFrame(
        [(field.name, field.dataType.simpleString()) for field in spec.raw_schema],
        "column string, expected_type string",
    )
    return found.join(expected, "column", "full")


def ingest(
    lake: Lake,
    raw_path: str | list[str],
    run_ts: datetime,
    spec: CampaignSpec = DEFAULT_SPEC,
) -> DataFrame:
    """Raw CSV → bronze, replaced. No raw rows make an empty, typed bronze."""
    lake.replace(L.BRONZE, as_bronze(raw_rows(lake, raw_path, spec), run_ts), to_micros(run_ts), [QUARANTINED])
    return bronze_rows(lake, spec)


def raw_rows(lake: Lake, raw_path: str | list[str], spec: CampaignSpec = DEFAULT_SPEC) -> DataFrame:
    """The raw CSV files with their lineage, records that can't be read as text."""
    return with_lineage(read_csv(lake.spark, raw_path, spec.raw_schema, corrupt=CORRUPT_RECORD))


def profile_bronze(
    lake: Lake, spec: CampaignSpec = DEFAULT_SPEC
) -> dict[str, DataFrame]:
    """The profile of bronze. Its groups are stored once, for all tables made of them."""

    def stored(groups: DataFrame) -> DataFrame:
        return lake.replace(L.PROFILE_GROUPS, groups, lake.changed_to(L.BRONZE))

    return profile(bronze_rows(lake, spec), spec, stored=stored)


def audit_nulls(lake: Lake, spec: CampaignSpec = DEFAULT_SPEC) -> DataFrame:
    """Nulls in keys and dates of bronze, before and after dates are parsed."""
    rows = bronze_rows(lake, spec)
    return null_audit(rows, [*spec.keys, spec.date], {spec.date: typed_date(rows, spec)})


def count_rows(lake: Lake, spec: CampaignSpec = DEFAULT_SPEC) -> DataFrame:
    """Rows per layer: (stage, metric, value). Those in bronze are counted, all others
    are known from their writes."""
    bronze = stage_row_counts(bronze_rows(lake, spec), silver_rows(lake, spec), spec)
    names = (L.FILTERED, L.CAMPAIGN_SUMMARY, L.CHANNEL_SUMMARY, L.DAILY_SUMMARY, L.SQL_METRICS)
    known = [(name, "rows_stored", lake.row_count(name)) for name in names if lake.has(name)]
    bad = quarantine(lake, spec).agg(F.count(F.lit(1)).alias("value"))
    return (
        bronze.unionByName(lake.spark.createDataFrame(known, COUNTS))
        .unionByName(bad.select(F.lit(L.BRONZE).alias("stage"), F.lit("rows_quarantined").alias("metric"), "value"))
    )


def refine(
    lake: Lake, run_ts: datetime, spec: CampaignSpec = DEFAULT_SPEC
) -> DataFrame:
    """Bronze → silver, replaced."""
    rows = clean(bronze_rows(lake, spec), spec, run_ts)
    return lake.replace(L.SILVER, rows, lake.changed_to(L.BRONZE))


def select_business(
    lake: Lake, run_ts: datetime, spec: CampaignSpec = DEFAULT_SPEC
) -> DataFrame:
    """Silver → filtered. Rows that are there stay, unseen keys are added."""
    kept = business_filter(silver_rows(lake, spec), spec, run_ts)
    mark = lake.changed_to(L.SILVER)
    if not lake.has(L.FILTERED):
        return lake.replace(L.FILTERED, kept, mark)
    lake.append(
        L.FILTERED, unseen_rows(kept, lake.read(L.FILTERED), spec.keys), mark
    )
    return lake.read(L.FILTERED)


def summarise(
    lake: Lake,
    run_ts: datetime,
    spec: CampaignSpec = DEFAULT_SPEC,
    metrics_mode: str = "recompute",
) -> dict[str, DataFrame]:
    """Filtered → all reporting tables, and the rollup behind them.

    They are marked by the version of the filtered rows; ``run_ts`` is but their stamp.
    """
    if not lake.has(L.FILTERED):
        select_business(lake, run_ts, spec)
    mark = lake.changed_to(L.FILTERED)
    refresh_gold(lake, spec, run_ts, mark, metrics_mode, rebuild=True)
    names = (L.CAMPAIGN_SUMMARY, L.CHANNEL_SUMMARY, L.DAILY_SUMMARY, L.SQL_METRICS)
    return {name: lake.read(name) for name in names}


def measure(
    lake: Lake,
    run_ts: datetime,
    spec: CampaignSpec = DEFAULT_SPEC,
    metrics_mode: str = "recompute",
) -> DataFrame:
    """Filtered → metrics per campaign type only."""
    table = campaign_metrics(filtered_rows(lake, spec), run_ts)
    if lake.has(L.SQL_METRICS):
        table = update_metrics(lake.read(L.SQL_METRICS), table, metrics_mode)
    return lake.replace(L.SQL_METRICS, table, lake.changed_to(L.FILTERED))


def validate_gold(lake: Lake, spec: CampaignSpec = DEFAULT_SPEC) -> DataFrame:
    """Checks on the filtered rows, and of the summaries against them.

    A layer without rows, a summary that is not there, and raw records that could not be
    read are violations too.
    """
    names = (L.CAMPAIGN_SUMMARY, L.CHANNEL_SUMMARY, L.DAILY_SUMMARY)
    summaries = {name: lake.read(name) for name in names if lake.has(name)}
    found = [
        ("layer_empty", name, int(lake.row_count(name) == 0))
        for name in (L.SILVER, L.FILTERED)
    ] + [("table_absent", name, int(not lake.has(name))) for name in names]
    found.append(("quarantined", L.BRONZE, quarantine(lake, spec).count()))
    present = lake.spark.createDataFrame(found, PRESENCE).withColumn(
        "passed", F.col("violations") == 0
    )
    return validate(filtered_rows(lake, spec), summaries, spec).unionByName(present)
