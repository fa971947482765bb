"""Seasonality: periods, weeks and days.

Sessions are folded to (date, user) or (date, channel) before anything else.  The
periods then meet a frame of at most a few rows per date, and no distinct count
runs next to other aggregates over sessions.  Where a function needs users by
date, ``sessions`` may be the stored user-days, which are not folded again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.config import AnalyticsConfig
from clickloom.functions.columns import (
    from_row,
    literal_table,
    money_sum,
    pct,
    ratio,
    rounded,
    share_of_total,
    week_start,
)
from clickloom.functions.intervals import join_on_range
from clickloom.operators.userdays import by_day
from clickloom.schema import SEASON_PERIODS

VALUE = ("sessions", "purchasing_sessions", "orders", "revenue")


def season_periods(spark: SparkSession, cfg: AnalyticsConfig) -> DataFrame:
    """The named date ranges."""
    rows = [(p.order, p.label, p.start, p.end, p.compared) for p in cfg.season_periods]
    return literal_table(spark, rows, SEASON_PERIODS)


def in_period(df: DataFrame, periods: DataFrame, day: str, how: str = "inner") -> DataFrame:
    """Rows with the period their date falls in; a date in no period drops out, or has none with a left join."""
    return join_on_range(df, day, periods, "start_date", "end_date", how)


def _fold_users(rows: DataFrame, by: list[str], *more: Column) -> DataFrame:
    """From user-days to groups: per (group, user) first, then per group."""
    per_user = rows.groupBy(*by, "user_pseudo_id").agg(
        *[F.sum(c).alias(c) for c in VALUE], *more
    )
    known = F.col("user_pseudo_id").isNotNull()
    return per_user.groupBy(*by).agg(
        F.count("user_pseudo_id").alias("users"),
        F.sum("sessions").alias("sessions"),
        F.sum("purchasing_sessions").alias("purchasing_sessions"),
        F.count(F.when(F.col("purchasing_sessions") > 0, F.col("user_pseudo_id"))).alias("buyers"),
        F.sum("orders").alias("orders"),
        F.sum("revenue").cast("double").alias("revenue"),
        *[F.bit_or(c).alias(c) for c in per_user.columns if c == "weekdays"],
        *[F.max(c).alias(c) for c in per_user.columns if c == "last_day"],
        *[F.sum(F.when(known, F.col(c))).alias(c) for c in per_user.columns if c == "user_days"],
    )


def period_metrics(sessions: DataFrame, users: DataFrame, periods: DataFrame) -> DataFrame:
    """Unrounded totals and per-day rates of each period; one without sessions or new users counts 0."""
    # The users of each day, added up over the days, are the user-days of the period.
    per_day = by_day(sessions, *VALUE)
    in_periods = in_period(per_day, periods, "session_date")
    totals = _fold_users(in_periods, ["period_order"], F.count(F.lit(1)).alias("user_days"))
    dates = per_day.select("session_date").distinct()
    average = in_period(dates, periods, "session_date").groupBy("period_order").agg(F.count(F.lit(1)).alias("days_seen"))
    starts = users.groupBy("first_visit_date").agg(F.count_if(F.col("user_type") == "new").alias("new_users"))
    started = (
        in_period(starts, periods, "first_visit_date")
        .groupBy("period_order")
        .agg(F.sum("new_users").alias("new_users_started"))
    )
    days = F.date_diff("end_date", "start_date") + 1
    counts = ["users", "sessions", "purchasing_sessions", "buyers", "orders", "revenue", "new_users_started"]
    return (
        periods.join(totals, "period_order", "left")
        .join(average, "period_order", "left")
        .join(started, "period_order", "left")
        .fillna(0, counts)
        .withColumn("days", days)
        .withColumns(
            {
                "avg_daily_users": ratio("user_days", "days_seen"),
                "sessions_per_day": ratio("sessions", "days"),
                "orders_per_day": ratio("orders", "days"),
                "revenue_per_day": ratio("revenue", "days"),
                "session_conversion": pct("purchasing_sessions", "sessions", None),
                "user_conversion": pct("buyers", "users", None),
                "order_value": ratio("revenue", "orders"),
            }
        )
    )


def period_summary(
    sessions: DataFrame, users: DataFrame, periods: DataFrame, cfg: AnalyticsConfig
) -> DataFrame:
    """Each period in total, per day, and against the baseline period.

    There are as many rows as configured periods, so the baseline is looked up among
    them instead of being computed a second time.
    """
    metrics = period_metrics(sessions, users, periods)
    compared = {
        "daily_users_vs_baseline_pct": "avg_daily_users",
        "sessions_per_day_vs_baseline_pct": "sessions_per_day",
        "orders_per_day_vs_baseline_pct": "orders_per_day",
        "revenue_per_day_vs_baseline_pct": "revenue_per_day",
        "conversion_vs_baseline_pct": "session_conversion",
        "aov_vs_baseline_pct": "order_value",
    }
    is_baseline = F.col("period_order") == cfg.baseline_period

    def change(c: str) -> Column:
        return rounded(F.lit(100) * (F.try_divide(F.col(c), from_row(is_baseline, c)) - 1), 1)

    return metrics.select(
        "period_order",
        "period",
        "is_comparison",
        "days",
        "users",
        rounded("avg_daily_users", 0).alias("avg_daily_users"),
        "sessions",
        rounded("sessions_per_day", 0).alias("sessions_per_day"),
        pct("new_users_started", "users").alias("pct_users_new_in_period"),
        "purchasing_sessions",
        "buyers",
        "orders",
        rounded("orders_per_day", 1).alias("orders_per_day"),
        F.round("revenue", 2).alias("revenue_usd"),
        rounded("revenue_per_day", 0).alias("revenue_per_day"),
        rounded("session_conversion", 3).alias("session_conversion_pct"),
        rounded("user_conversion", 3).alias("user_conversion_pct"),
        rounded("order_value", 2).alias("aov"),
        *[change(c).alias(name) for name, c in compared.items()],
    )


def weekly_trend(sessions: DataFrame, cfg: AnalyticsConfig) -> DataFrame:
    """Monday-start weeks.

    The days seen in a week are gathered as seven bits, which combine like a sum.
    """
    by_week = by_day(sessions, *VALUE).withColumns(
        {"week_start": week_start("session_date"), "bit": F.expr("shiftleft(1, weekday(session_date))")}
    )
    weeks = _fold_users(
        by_week, ["week_start"], F.bit_or("bit").alias("weekdays"), F.max("session_date").alias("last_day")
    )
    return weeks.select(
        "week_start",
        F.bit_count("weekdays").alias("days_in_data"),
        "users",
        "sessions",
        "buyers",
        "purchasing_sessions",
        "orders",
        F.round("revenue", 2).alias("revenue_usd"),
        pct("purchasing_sessions", "sessions", 3).alias("session_conversion_pct"),
        pct("buyers", "users", 3).alias("user_conversion_pct"),
        ratio("revenue", "orders", 2).alias("aov"),
        (F.col("last_day") < F.lit(cfg.revenue_reliable_until)).alias("purchase_data_reliable"),
    )


def daily_trend(sessions: DataFrame, users: DataFrame, cfg: AnalyticsConfig) -> DataFrame:
    """Traffic, funnel, orders and new users per day.

    A session belongs to the date on which it started.
    """
    steps = (
        "product_view_sessions",
        "add_to_cart_sessions",
        "begin_checkout_sessions",
        "add_payment_sessions",
        "purchasing_sessions",
    )
    per_user = by_day(sessions, "sessions", *steps, "orders", "revenue").withColumnRenamed("session_date", "date")
    daily = per_user.groupBy("date").agg(
        F.count("user_pseudo_id").alias("users"),
        F.sum("sessions").alias("sessions"),
        *[F.sum(name).alias(name) for name in steps],
        F.count(F.when(F.col("purchasing_sessions") > 0, F.col("user_pseudo_id"))).alias("buyers"),
        F.sum("orders").alias("orders"),
        F.round(F.sum("revenue").cast("double"), 2).alias("revenue_usd"),
    )
    new_users = users.groupBy(F.col("first_visit_date").alias("date")).agg(
        F.count_if(F.col("user_type") == "new").alias("new_users")
    )
    return daily.join(new_users, "date", "left").select(
        *daily.columns,
        F.date_format("date", "EEEE").alias("day_of_week"),
        F.coalesce("new_users", F.lit(0)).alias("new_users"),
        pct("purchasing_sessions", "sessions", 3).alias("session_conversion_pct"),
        ratio("revenue_usd", "orders", 2).alias("aov"),
        (F.col("date") >= F.lit(cfg.cart_reliable_from)).alias("add_to_cart_reliable"),
        (F.col("date") < F.lit(cfg.revenue_reliable_until)).alias("purchase_data_reliable"),
    )


def period_funnel(sessions: DataFrame, periods: DataFrame) -> DataFrame:
    """How far sessions got in each compared period.  The cart step is left out on purpose."""
    steps = {
        "views": "reached_view_item",
        "checkouts": "reached_begin_checkout",
        "payments": "reached_add_payment_info",
        "purchases": "purchased",
    }
    daily = sessions.groupBy("session_date").agg(
        F.count(F.lit(1)).alias("sessions"), *[F.count_if(flag).alias(name) for name, flag in steps.items()]
    )
    counts = (
        in_period(daily, periods.where("is_comparison"), "session_date")
        .groupBy("period_order", "period")
        .agg(*[F.sum(c).alias(c) for c in ("sessions", *steps)])
    )
    return counts.select(
        "period_order",
        "period",
        "sessions",
        pct("views", "sessions").alias("product_view_pct_of_sessions"),
        pct("checkouts", "sessions").alias("begin_checkout_pct_of_sessions"),
        pct("checkouts", "views").alias("checkout_per_100_product_view_sessions"),
        pct("payments", "checkouts").alias("payment_pct_of_checkout"),
        pct("purchases", "payments").alias("purchase_pct_of_payment"),
        pct("purchases", "sessions", 3).alias("session_conversion_pct"),
    )


def period_channel_mix(sessions: DataFrame, periods: DataFrame) -> DataFrame:
    """Traffic and conversion per channel in each compared period."""
    daily = sessions.groupBy("session_date", "acq_channel").agg(
        F.count(F.lit(1)).alias("sessions"),
        F.count_if("purchased").alias("purchasing_sessions"),
        money_sum("revenue_usd").alias("revenue"),
    )
    counts = (
        in_period(daily, periods.where("is_comparison"), "session_date")
        .groupBy("period_order", "period", "acq_channel")
        .agg(
            F.sum("sessions").alias("sessions"),
            F.sum("purchasing_sessions").alias("purchasing_sessions"),
            money_sum("revenue").alias("revenue"),
        )
    )
    return counts.select(
        "period_order",
        "period",
        "acq_channel",
        "sessions",
        share_of_total("sessions", ["period_order"]).alias("pct_of_period_sessions"),
        "purchasing_sessions",
        pct("purchasing_sessions", "sessions", 3).alias("session_conversion_pct"),
        F.round("revenue", 2).alias("revenue_usd"),
    )
