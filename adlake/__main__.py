"""Command line: ``spark-submit -m``-style entry for the runs and reports.

    python -m adlake full RAW ROOT
    python -m adlake increment RAW ROOT
    python -m adlake stream RAW ROOT
    python -m adlake profile ROOT OUT
    python -m adlake validate ROOT
    python -m adlake read PATH [--format csv] [--rows 10]

A profile lists as many rows as there are values, so it is written, as one Parquet table
per report; what is printed has a row per column or check, and is printed whole. The Spark
session is whatever the environment configures.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from adlake.plans import run_full, run_increment, stages
from adlake.sources import Lake, overwrite, quarantine_counts, read_any, read_report
from adlake.streaming import run_stream


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="adlake", description="Campaign layers on Spark")
    commands = top.add_subparsers(dest="command", required=True)
    for name in ("full", "increment", "stream"):
        command = commands.add_parser(name)
        command.add_argument("raw")
        command.add_argument("root")
        command.add_argument(
            "--metrics", choices=["recompute", "insert_only"], default="recompute"
        )
    profile = commands.add_parser("profile")
    profile.add_argument("root")
    profile.add_argument("out")
    commands.add_parser("validate").add_argument("root")
    read = commands.add_parser("read")
    read.add_argument("path")
    read.add_argument("--format", default="parquet")
    read.add_argument("--rows", type=int, default=10)
    return top


def show_all(report: DataFrame) -> None:
    """Print a report whose rows are bounded by the columns and checks there are."""
    report = report.cache()
    report.show(report.count(), truncate=False)
    report.unpersist()


def refuse_corrupt(lake: Lake) -> None:
    """End with an error if records lie in quarantine, after listing the worst files."""
    found = quarantine_counts(stages.stored_bronze(lake)).orderBy("quarantined", ascending=False)
    if not found.isEmpty():
        found.show(20, truncate=False)
        raise SystemExit("some records can't be read; see the quarantine")


def main(arguments: list[str] | None = None) -> None:
    args = parser().parse_args(arguments)
    spark = SparkSession.builder.appName(f"adlake-{args.command}").getOrCreate()
    if args.command == "full":
        made = run_full(spark, args.raw, args.root, metrics_mode=args.metrics)
        show_all(made["validation"])
        show_all(made["row_counts"])
        refuse_corrupt(Lake(spark, args.root))
    elif args.command == "increment":
        batch = stages.raw_rows(Lake(spark, args.root), args.raw)
        show_all(run_increment(spark, batch, args.root, metrics_mode=args.metrics))
        refuse_corrupt(Lake(spark, args.root))
    elif args.command == "stream":
        added = run_stream(spark, args.raw, args.root, metrics_mode=args.metrics)
        for layer, rows in added.items():
            print(f"{layer}: {rows} rows added")
        refuse_corrupt(Lake(spark, args.root))
    elif args.command == "profile":
        for name, report in stages.profile_bronze(Lake(spark, args.root)).items():
            overwrite(report, f"{args.out}/{name}")
    elif args.command == "validate":
        show_all(stages.validate_gold(Lake(spark, args.root)))
    else:
        report = read_report(read_any(spark, args.path, args.format), show_rows=args.rows)
        show_all(report["schema"])
        report["sample"].show(args.rows, truncate=False)


if __name__ == "__main__":
    main()
