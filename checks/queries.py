"""Every operator as a query over the sample tables.

Three event sources made from the sample tables feed the operators; the derived
tables of a source are built once per session and folder, in the shared folder, as
the pipeline does.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import oracle, oracle_stats
from clickloom.functions import sketches
from clickloom.functions.columns import with_one_row
from clickloom.operators import facts, funnel, inference, product, quality, retention, sessions, userdays, users
from clickloom.operators.season import in_period
from clickloom.plans.daily import DailyTables
from clickloom.plans.reports import BY_NAME
from clickloom.plans.statistics import MEASURES, STATISTICS
from clickloom.plans.workspace import Workspace
from clickloom.schema import DASHBOARD_CSV, cohort_csv
from clickloom.sources import sample
from clickloom.sources.events import read_events
from clickloom.sources.tables import TableStore, read_csv, write_csv

Query = Callable[[SparkSession, str], DataFrame]

# Adapter, configuration, and the partition column of the stored raw events.  The
# clickstream is stored as daily directories; the others span thousands of days.
SOURCES = {
    "clicks": (sample.clickstream, sample.CLICKSTREAM, "event_date"),
    "visitors": (sample.visitors, sample.CLICKSTREAM, "event_date"),
    "history": (sample.order_history, sample.ORDER_HISTORY, None),
    "items": (sample.item_events, sample.ITEM_EVENTS, None),
}

_workspaces: dict[tuple[str, str, str], Workspace] = {}


def workspace(spark: SparkSession, sf_dir: str, source: str) -> Workspace:
    key = (spark.sparkContext.applicationId, sf_dir, source)
    if key not in _workspaces:
        adapter, cfg, partition_by = SOURCES[source]
        raw = adapter(spark, sf_dir)
        store = TableStore(spark)
        stored = store.build("raw_events", raw, partition_by)
        _workspaces[key] = Workspace(spark, stored, cfg, store, by_date=partition_by is not None)
    return _workspaces[key]


def _on(source: str, build: Callable[[Workspace], DataFrame]) -> Query:
    return lambda spark, sf_dir: build(workspace(spark, sf_dir, source))


def _report(source: str, name: str) -> Query:
    return _on(source, lambda ws: BY_NAME[name].frame(ws))


# Reports by the source that exercises them best.
REPORT_SOURCES = {
    "clicks": (
        "dq_overview", "dq_events_by_name", "dq_daily_events", "dq_obscured_values", "dq_funnel_events", "dq_purchases",
        "dq_daily_tracking", "dq_new_vs_returning", "check_sessions", "sessions_by_channel", "check_users", "funnel_steps",
        "funnel_abandonment", "funnel_open_checks", "funnel_strict", "funnel_whole_period", "funnel_window_value",
        "cart_tracking_daily", "channel_performance", "channel_funnel", "channel_sources", "device_performance",
        "device_funnel_sessions", "device_funnel_users", "country_performance", "weekly_trend", "daily_trend",
        "period_funnel", "period_channel_mix",
    ),
    "history": (
        "new_vs_returning", "new_vs_returning_window", "returner_value", "retention_summary", "retention_by_channel",
        "retention_by_cohort_week", "sessions_per_user", "revenue_by_visit_number", "first_purchase_timing",
        "period_summary",
    ),
    "items": (
        "products_export", "product_groups", "product_quadrant_summary", "check_products",
    ),
}

# The same reports over a second source, which differs in shape (many sessions a user
# against few, item events against none).
SECOND_SOURCES = {
    "clicks": ("new_vs_returning", "retention_summary", "revenue_by_visit_number", "first_purchase_timing", "sessions_per_user"),
    "history": ("funnel_steps", "channel_performance", "country_performance", "weekly_trend", "daily_trend"),
    "items": ("check_sessions", "check_users", "dq_purchases", "device_performance", "period_summary"),
}

def _daily(ws: Workspace) -> DailyTables:
    """The clickstream's tables, built in three instalments, the last of them a day that comes late."""
    every = [ws.cfg.first_date + timedelta(days=k) for k in range((ws.cfg.last_date - ws.cfg.first_date).days + 1)]
    tables = DailyTables(ws.spark, ws.store.path("daily"), ws.cfg)
    late = every[11]
    for days in ([d for d in every[:20] if d != late], every[20:], [late]):
        tables.ingest(ws.raw, days)
    return tables


def _active_days(ws: Workspace) -> DataFrame:
    words = userdays.words_for(ws.cfg.long_window)
    return userdays.visit_days(userdays.day_bitmaps(ws.user_days, words), words)


TABLES: dict[str, tuple[str, Callable[[Workspace], DataFrame]]] = {
    "clean_events": ("clicks", lambda w: sessions.clean_events(w.raw)),
    "clean_orders": (
        "clicks",
        lambda w: sessions.clean_orders(w.events, w.cfg),
    ),
    "first_touch": ("clicks", lambda w: sessions.first_touch(w.events, w.cfg)),
    "channel_label": (
        "clicks",
        lambda w: sessions.first_touch(w.events, w.cfg)
        .groupBy("acq_medium", sessions.channel_label(w.cfg).alias("acq_channel"))
        .agg(F.count(F.lit(1)).alias("users")),
    ),
    "sessions": ("clicks", lambda w: sessions.build_sessions(w.events, w.cfg, w.first_touch)),
    "users": ("history", lambda w: users.users_of(w.user_days, w.cfg)),
    "user_days": ("clicks", lambda w: w.user_days.select(*userdays.USER_DAY, *userdays.SEGMENT, *userdays.SUMS).withColumn(
        "revenue", F.col("revenue").cast("double"))),
    "active_days": ("history", _active_days),
    "daily_sessions": ("clicks", lambda w: _daily(w).read("sessions")),
    "visit_numbers": ("history", lambda w: w.visit_numbers.withColumn("revenue", F.col("revenue").cast("double"))),
    "event_profile": ("clicks", lambda w: w.event_profile.withColumn("revenue", F.col("revenue").cast("double"))),
    "cart_window_sessions": ("clicks", lambda w: w.cart_sessions),
    "cart_window_users": ("clicks", lambda w: funnel.cart_window_users(w.cart_sessions)),
    "fact_sessions": ("clicks", lambda w: facts.fact_sessions(w.user_days, w.users, w.cfg)),
    "fact_cohort_daily": ("history", lambda w: facts.fact_cohort_daily(w.users, w.cfg)),
    "fact_product_daily": ("items", lambda w: facts.fact_product_daily(w.item_activity, w.products, w.cfg)),
    "item_impressions": (
        "items",
        lambda w: product.item_impressions(w.raw, w.aliases, w.cfg),
    ),
    "item_cart_adds": ("items", lambda w: product.item_cart_adds(w.raw, w.aliases, w.cfg)),
    "item_purchases": ("items", lambda w: product.item_purchases(w.raw, w.aliases, w.cfg)),
    "product_group": (
        "items",
        lambda w: w.products.select("item_name", product.product_group("item_name", w.cfg).alias("product_group")),
    ),
    "product_quadrants": (
        "items",
        lambda w: product.product_quadrants(w.product_rates, w.cfg)
        .where("meets_view_floor")
        .select("item_name", "quadrant", "median_impressions", "median_view_to_purchase_pct"),
    ),
    "products": (
        "items",
        lambda w: product.product_quadrants(
            product.product_rates(product.product_totals(w.item_activity, w.cfg), w.cfg), w.cfg
        ),
    ),
}


def _alias_use(ws: Workspace) -> DataFrame:
    named = ws.raw.select(F.explode("items.item_name").alias("item_name"))
    used = named.groupBy("item_name").agg(F.count("item_name").alias("items"))
    return ws.aliases.join(used, F.col("raw") == F.col("item_name"), "left").select(
        "raw", "canonical", F.coalesce("items", F.lit(0)).alias("items")
    )


def _period_events(ws: Workspace) -> DataFrame:
    daily = ws.events.groupBy("event_date").agg(F.count(F.lit(1)).alias("n"))
    counts = in_period(daily, ws.periods, "event_date").groupBy("period_order").agg(F.sum("n").alias("n"))
    return ws.periods.join(counts, "period_order", "left").select(
        *ws.periods.columns, F.coalesce("n", F.lit(0)).alias("events")
    )


def _date_events(ws: Workspace, dates: DataFrame | None = None) -> DataFrame:
    dates = ws.dim_date if dates is None else dates
    daily = ws.events.groupBy(F.col("event_date").alias("date")).agg(F.count(F.lit(1)).alias("n"))
    return dates.join(daily, "date", "left").select(
        *dates.columns, F.coalesce("n", F.lit(0)).alias("events")
    )


def _stage_sessions(ws: Workspace, stages: DataFrame | None = None) -> DataFrame:
    stages = ws.funnel_stages if stages is None else stages
    counts = ws.sessions.agg(F.count(F.lit(1)).alias("sessions"), *funnel.main_step_counts())
    names = ["sessions", *funnel.MAIN_FLAGS]
    return with_one_row(stages, counts).select(
        "stage_order", "stage", F.element_at(F.array(*names), F.col("stage_order")).alias("sessions")
    )


TABLES |= {
    "item_aliases": ("items", _alias_use),
    "season_periods": ("clicks", _period_events),
    "dim_date": ("clicks", _date_events),
    "funnel_stages": ("history", _stage_sessions),
}


def _events_in_range(ws: Workspace) -> DataFrame:
    first, last = date(2024, 1, 5), date(2024, 1, 20)
    days = read_events(ws.spark, ws.store.path("raw_events"), first, last)
    return days.groupBy("event_date", "event_name").agg(F.count(F.lit(1)).alias("events"))


def _csv_export(name: str) -> Callable[[Workspace], DataFrame]:
    def there_and_back(ws: Workspace) -> DataFrame:
        path, report = ws.store.path(f"{name}_csv"), BY_NAME[name]
        write_csv(report.frame(ws), path, report.small, report.keys())
        schema = cohort_csv(ws.cfg.return_windows) if name == "fact_cohort_daily" else DASHBOARD_CSV[name]
        return read_csv(ws.spark, path, schema)

    return there_and_back


def _users_from_sketches(ws: Workspace) -> DataFrame:
    """Users by name from merged days, next to the exact count: is it within the stated error?"""
    days = ws.store.build("user_sketches", quality.user_sketches(ws.event_profile))
    some = F.col("event_date") >= F.lit(ws.cfg.cart_reliable_from)
    merged = quality.events_by_name(None, days.where(some)).withColumnRenamed("users", "estimate")
    exact = quality.events_by_name(ws.event_profile.where(some)).select("event_name", "users")
    near = F.abs(F.col("estimate") - F.col("users")) <= F.ceil(F.col("users") * sketches.distinct_error())
    return merged.join(exact, "event_name").select("event_name", "events", "users", near.alias("within_error"))


def _wait_from_sketches(ws: Workspace) -> DataFrame:
    """The median days until the first purchase from merged days: is its rank within the stated error?"""
    buyers = retention.buyers(ws.user_visits, ws.users)
    days = ws.store.build("wait_sketches", retention.wait_sketches(buyers))
    by = ["user_type", "first_purchase_on"]
    merged = sketches.merged_quantile(days, by, 0.5)
    ranks = buyers.join(merged, by).groupBy(*by, "n").agg(
        F.count(F.lit(1)).alias("buyers"),
        F.count_if(F.col("days") < F.col("quantile")).alias("below"),
        F.count_if(F.col("days") <= F.col("quantile")).alias("upto"),
    )
    slack = F.col("buyers") * sketches.rank_error() + 1
    near = (F.col("below") <= F.col("buyers") / 2 + slack) & (F.col("upto") >= F.col("buyers") / 2 - slack)
    return ranks.select(*by, "buyers", (F.col("n") == F.col("buyers")).alias("all_counted"), near.alias("within_error"))


TABLES |= {
    "events_in_range": ("clicks", _events_in_range),
    "csv_export": ("history", _csv_export("fact_cohort_daily")),
    "users_from_sketches": ("clicks", _users_from_sketches),
    "wait_from_sketches": ("history", _wait_from_sketches),
}


CSV_SOURCES = {"fact_sessions": "clicks", "fact_product_daily": "items", "products_export": "items"}
TABLES |= {f"csv_export__{name}": (source, _csv_export(name)) for name, source in CSV_SOURCES.items()}
# Configured tables, read back and set against the data.
TABLES |= {
    "csv_export__dim_date": ("clicks", lambda w: _date_events(w, _csv_export("dim_date")(w))),
    "csv_export__funnel_stages": ("history", lambda w: _stage_sessions(w, _csv_export("funnel_stages")(w))),
}


def _unmatched(ws: Workspace) -> DataFrame:
    # The sample has no product above its floor without orders, so the floor is lowered here.
    lowered = type(ws.cfg)(**{**ws.cfg.__dict__, "impression_floor": 5})
    return inference.unmatched_products(ws.products, lowered)


# Statistics and measures by the source that exercises them best.
STATISTIC_SOURCES = {
    "history": (
        "channel_intervals", "channel_tests", "segment_vs_rest", "lowest_segments",
        "small_segment_illusion", "pareto", "retention_ci", "window_purchase_test", "multi_session_share",
        "early_return_ratio", "baseline_sensitivity",
    ),
    "clicks": (
        "device_tests", "tracking_gaps", "tracking_daily_shares", "open_vs_strict", "whole_vs_window",
        "repeat_orders", "period_conversion_pivot", "full_weeks", "opportunity_sizing", "profile_users",
    ),
    "items": (
        "quadrant_yield", "quadrant_leaders", "revenue_concentration", "unmatched_products",
        "impressions_conversion_corr", "impression_reallocation", "profile_items",
    ),
    "visitors": ("tracking_gaps", "repeat_orders", "baseline_sensitivity", "opportunity_sizing", "profile_users"),
}

MEASURE_SOURCES = {
    "clicks": (
        "measures_core", "measures_ratios", "measures_funnel", "measures_abandonment",
        "measures_funnel_stages",
    ),
    "history": (
        "measures_funnel__history", "measures_abandonment__history", "measures_repeat_visits",
        "measures_return_rates",
    ),
    "items": (
        "measures_product",
    ),
}


def _statistics() -> dict[str, Query]:
    """Queries of the statistics and measures; those of a second source are named after it."""
    out: dict[str, Query] = {}
    for source, names in STATISTIC_SOURCES.items():
        for name in names:
            out[f"{name}__{source}" if source == "visitors" else name] = _on(source, STATISTICS[name])
    for source, names in MEASURE_SOURCES.items():
        out |= {name: _on(source, MEASURES[name.split("__")[0]]) for name in names}
    exact = lambda w: inference.baseline_sensitivity(
        BY_NAME["period_summary"].frame(w), inference.baseline_repeats(w.events, w.cfg), w.cfg, exact=True
    )
    return out | {"unmatched_products": _on("items", _unmatched), "baseline_sensitivity_exact": _on("visitors", exact)}


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {name: _on(source, build) for name, (source, build) in TABLES.items()}
    for source, names in REPORT_SOURCES.items():
        out |= {name: _report(source, name) for name in names}
    for source, names in SECOND_SOURCES.items():
        out |= {f"{name}__{source}": _report(source, name) for name in names}
    return out | _statistics()


def oracle_sql() -> dict[str, str]:
    special = oracle_stats.inputs_on_data()
    out = {
        name: special[name] if name in special else oracle.report(source, name) for name, (source, _) in TABLES.items()
    }
    for source, names in REPORT_SOURCES.items():
        out |= {name: oracle.report(source, name) for name in names}
    for source, names in SECOND_SOURCES.items():
        out |= {f"{name}__{source}": oracle.report(source, name) for name in names}
    return out | oracle_stats.statistics() | oracle_stats.measures()
