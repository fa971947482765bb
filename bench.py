"""Time the job and its headline queries; print one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

A table build writes Parquet from the tables before it; a query runs to its full
result over the stored tables, as a report of the pipeline does.  Results go to
Spark's no-op sink, so that only the computation is timed.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))

BUILDS = {
    "clicks": ("events", "event_profile", "sessions", "user_days", "users", "cart_users", "fact_sessions"),
    "history": ("events", "sessions", "user_days", "users", "user_visits", "fact_sessions"),
    "items": ("events", "sessions", "user_days", "users", "item_activity", "products", "fact_product_daily"),
}
HEADLINES = (
    "dq_overview",
    "dq_obscured_values",
    "dq_daily_tracking",
    "check_sessions",
    "funnel_steps",
    "funnel_strict",
    "channel_performance",
    "channel_funnel",
    "device_performance",
    "country_performance",
    "product_groups",
    "product_quadrant_summary",
    "check_products",
    "new_vs_returning_window",
    "retention_summary",
    "retention_by_cohort_week",
    "revenue_by_visit_number",
    "first_purchase_timing",
    "period_summary",
    "weekly_trend",
    "daily_trend",
    "period_channel_mix",
    "segment_vs_rest",
    "device_tests",
    "opportunity_sizing",
    "revenue_concentration",
    "measures_funnel_stages",
)


def session() -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )


def main() -> None:
    from checks.queries import queries, workspace

    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()  # start the engine before timing
    times: dict[str, float] = {}

    def timed(name: str, action) -> None:
        start = time.perf_counter()
        action()
        times[name] = round(time.perf_counter() - start, 3)

    for source, tables in BUILDS.items():
        timed(f"build_{source}_raw", lambda source=source: workspace(spark, SF_DIR, source))
        for table in tables:
            timed(f"build_{source}_{table}", lambda s=source, t=table: getattr(workspace(spark, SF_DIR, s), t))
    registered = queries()
    for name in HEADLINES:
        timed(
            name,
            lambda name=name: registered[name](spark, SF_DIR).write.format("noop").mode("overwrite").save(),
        )
    print(
        json.dumps(
            {
                "metric": "total wall time of table builds and headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": Path(SF_DIR).name,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
