"""The whole run from raw files to validated reporting tables."""

from __future__ import annotations

from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession

from adlake.plans import stages
from adlake.plans.increment import require_later, run_increment
from adlake.sources import lake as L
from adlake.sources.lake import Lake
from adlake.sources.readers import quarantine_counts, to_micros
from adlake.spec import DEFAULT_SPEC, CampaignSpec


def run_full(
    spark: SparkSession,
    raw_path: str | list[str],
    root: str,
    spec: CampaignSpec = DEFAULT_SPEC,
    run_ts: datetime | None = None,
    metrics_mode: str = "recompute",
    then_increment: bool = False,
) -> dict[str, DataFrame]:
    """Load the raw CSV files, rebuild every layer below ``root`` and report on them.

    Bronze and silver are replaced. A filtered layer that exists keeps its rows
    and gains the keys it does not have.

    ``then_increment`` looks at the raw files once more at the end, for files
    that arrived during the run; it adds nothing otherwise.

    Returns the layers and the reports: schema, quarantine per file, profile, null audit,
    row counts and validation. All of them have been computed and are stored as tables
    of the lake, reports as ``report_<name>``. An error in any stage is raised to the
    caller; what validation finds is not an error.
    """
    run_ts = run_ts or datetime.now(UTC)
    lake = Lake(spark, root)
    require_later(lake, run_ts)
    if lake.has(L.SILVER) and not lake.has(L.BRONZE):
        raise ValueError("this lake is fed by a stream of files")
    stages.ingest(lake, raw_path, run_ts, spec)
    stages.refine(lake, run_ts, spec)
    stages.select_business(lake, run_ts, spec)
    stages.summarise(lake, run_ts, spec, metrics_mode)
    if then_increment:
        later = run_ts + timedelta(microseconds=1)
        again = stages.raw_rows(lake, raw_path, spec)
        run_increment(spark, again, root, spec, later, metrics_mode)
        lake = Lake(spark, root)
    layers = (
        L.SILVER,
        L.FILTERED,
        L.CAMPAIGN_SUMMARY,
        L.CHANNEL_SUMMARY,
        L.DAILY_SUMMARY,
        L.SQL_METRICS,
    )
    profiled = stages.profile_bronze(lake, spec)
    reports = {
        "schema": stages.explore_schema(lake, raw_path, spec),
        "quarantine": quarantine_counts(stages.stored_bronze(lake, spec)),
        **{f"profile_{name}": report for name, report in profiled.items()},
        "null_audit": stages.audit_nulls(lake, spec),
        "row_counts": stages.count_rows(lake, spec),
        "validation": stages.validate_gold(lake, spec),
    }
    named = {name: f"report_{name}" for name in reports}
    lake.replace_all({named[name]: reports[name] for name in reports}, to_micros(run_ts))
    return {
        L.BRONZE: stages.bronze_rows(lake, spec),
        **{name: lake.read(name) for name in layers},
        **{name: lake.read(table) for name, table in named.items()},
    }
