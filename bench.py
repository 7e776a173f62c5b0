"""Timings at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``, as one JSON line.

``queries`` holds the headline queries from raw rows (median of three runs) and,
as ``step_*``, the stages of one run over stored layers: schema by inference, raw CSV
to bronze, profile, silver, filter, metrics, gold, an increment that brings nothing new
and one that brings only new keys, and validation; ``full_run`` is all of them at once. Every result is computed in full and thrown away.
"""

from __future__ import annotations

import json
import os
import statistics
import time
from collections.abc import Callable
from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adlake import sources as io
from adlake.plans import run_full, run_increment, stages
from adlake.sources import Lake
from checks import QUERIES, feed
from checks.feed import BUSINESS, SPEC, TIE_BREAK
from checks.scans import write_csv

HEADLINE = (
    "silver_clean",
    "silver_filter",
    "sql_metrics",
    "sql_metrics_sql",
    "gold_campaign_summary",
    "gold_channel_summary",
    "gold_daily_summary",
    "duplicate_keys",
    "null_counts",
    "distinct_counts",
    "anti_join_new_keys",
    "new_keys_once",
    "filtered_merge",
    "validation_report",
)
RUNS = 3


def compute(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(work: Callable[[], object]) -> float:
    start = time.perf_counter()
    work()
    return time.perf_counter() - start


def steps(spark: SparkSession, sf_dir: str) -> dict[str, float]:
    root = io.shared_dir(spark, "bench")
    run_ts = datetime(2026, 2, 2, tzinfo=UTC)
    write_csv(feed.campaigns(spark, sf_dir).select(*BUSINESS, *TIE_BREAK), f"{root}/raw")
    lake = Lake(spark, f"{root}/lake")

    def raw() -> DataFrame:
        return stages.raw_rows(lake, f"{root}/raw", SPEC)

    def reports() -> None:
        for report in stages.profile_bronze(lake, SPEC).values():
            compute(report)

    def nothing_new() -> None:
        later = run_ts + timedelta(hours=1)
        run_increment(spark, raw(), f"{root}/lake", SPEC, later)

    def new_rows() -> None:
        batch = raw().withColumn("Campaign_ID", -F.col("Campaign_ID") - 1)
        run_increment(spark, batch, f"{root}/lake", SPEC, run_ts + timedelta(hours=2))

    def whole() -> None:
        made = run_full(spark, f"{root}/raw", f"{root}/other", SPEC, run_ts)
        for name in ("row_counts", "validation"):
            compute(made[name])

    work: dict[str, Callable[[], object]] = {
        "step_schema": lambda: compute(stages.explore_schema(lake, f"{root}/raw", SPEC)),
        "step_bronze": lambda: stages.ingest(lake, f"{root}/raw", run_ts, SPEC),
        "step_profile": reports,
        "step_silver": lambda: stages.refine(lake, run_ts, SPEC),
        "step_filter": lambda: stages.select_business(lake, run_ts, SPEC),
        "step_metrics": lambda: stages.measure(lake, run_ts, SPEC),
        "step_gold": lambda: stages.summarise(lake, run_ts, SPEC),
        "step_increment_nothing_new": nothing_new,
        "step_increment_new_rows": new_rows,
        "step_validate": lambda: compute(stages.validate_gold(lake, SPEC)),
        "full_run": whole,
    }
    return {name: timed(step) for name, step in work.items()}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("adlake-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    compute(QUERIES["row_count"](spark, sf_dir))
    seconds = {}
    for name in HEADLINE:
        query = QUERIES[name]
        runs = [timed(lambda: compute(query(spark, sf_dir))) for _ in range(RUNS)]
        seconds[name] = statistics.median(runs)
    seconds |= steps(spark, sf_dir)
    rounded = {name: round(value, 3) for name, value in seconds.items()}
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": rounded,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
