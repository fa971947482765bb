"""The whole job: raw events to tables, reports and CSV exports.

    python -m clickloom.plans.pipeline RAW_EVENTS OUTPUT

On a cluster, submit this file with the package in --py-files.
"""

from __future__ import annotations

import argparse
from collections.abc import Iterable
from dataclasses import replace
from datetime import date

from pyspark.sql import SparkSession

from clickloom.config import AnalyticsConfig
from clickloom.plans.reports import REPORTS
from clickloom.plans.statistics import STATISTIC_REPORTS
from clickloom.plans.workspace import Workspace
from clickloom.sources.events import read_events
from clickloom.sources.tables import TableStore, write_csv

# Session settings the job relies on.  All are Spark's own adaptive execution, which
# merges shuffle partitions that turn out small and splits those that are skewed.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}

# Options that set a date of the configuration.
DATES = {
    "first_date": "first day to read",
    "last_date": "last day to read",
    "cart_reliable_from": "first day on which cart events can be trusted",
    "revenue_reliable_until": "first day on which revenue can no longer be trusted",
}


def run(ws: Workspace, out: str, names: Iterable[str] | None = None) -> list[str]:
    """Build the tables a report needs, once, and export each report in order."""
    every = {report.name: report for report in (*REPORTS, *STATISTIC_REPORTS)}
    chosen = [every[n] for n in names] if names is not None else list(every.values())
    for report in chosen:
        write_csv(report.frame(ws), f"{out}/{report.name}", report.small, report.keys())
    return [report.name for report in chosen]


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description="Build the tables and export the reports.")
    parser.add_argument("events", help="raw events: Parquet, a directory per event_date")
    parser.add_argument("output", help="folder for the tables and the CSV exports")
    parser.add_argument("--report", action="append", help="export only this report (repeatable)")
    parser.add_argument(
        "--shuffle-partitions",
        type=int,
        help="partitions to start a shuffle with; about one per 200 MB of the events' shuffle, which is roughly a "
        "twentieth of the raw events (25,000 for 100 TB)",
    )
    defaults = AnalyticsConfig()
    for name, meaning in DATES.items():
        option = f"--{name.replace('_', '-')}"
        parser.add_argument(option, type=date.fromisoformat, default=getattr(defaults, name), help=meaning)
    args = parser.parse_args(argv)

    builder = SparkSession.builder.appName("clickloom")
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    if args.shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", args.shuffle_partitions)
    spark = builder.getOrCreate()
    cfg = replace(defaults, **{name: getattr(args, name) for name in DATES})
    raw = read_events(spark, args.events, cfg.first_date, cfg.last_date)
    if raw.isEmpty():
        raise SystemExit(f"{args.events} has no events from {cfg.first_date} to {cfg.last_date}")
    ws = Workspace(spark, raw, cfg, TableStore(spark, f"{args.output}/tables"), by_date=True)
    for name in run(ws, f"{args.output}/reports", args.report):
        print(name)


if __name__ == "__main__":
    main()
