"""New and returning users, retention, and when revenue happens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.config import AnalyticsConfig
from clickloom.functions.columns import all_of, money_sum, pct, ratio, share_of_total, week_start
from clickloom.functions.sketches import quantile_sketches
from clickloom.operators.userdays import user_days
from clickloom.operators.users import eligible_flag, returned_flag
from clickloom.operators.visits import VISIT_SUMS, user_visits


def new_vs_returning(users: DataFrame) -> DataFrame:
    """New against returning users over the whole period."""
    counts = users.groupBy("user_type").agg(
        F.count(F.lit(1)).alias("users"),
        F.sum("sessions").alias("sessions"),
        F.sum("active_days").alias("active_days"),
        F.count_if("repeat_visitor").alias("repeat_visitors"),
        F.count_if("purchased").alias("buyers"),
        F.sum("orders").alias("orders"),
        F.count_if(F.col("orders") > 1).alias("repeat_buyers"),
        money_sum("revenue_usd").alias("revenue"),
    )
    return counts.select(
        "user_type",
        "users",
        share_of_total("users").alias("pct_of_users"),
        "sessions",
        ratio("sessions", "users", 3).alias("sessions_per_user"),
        ratio("active_days", "users", 3).alias("active_days_per_user"),
        "repeat_visitors",
        pct("repeat_visitors", "users").alias("repeat_visit_rate_pct"),
        "buyers",
        pct("buyers", "users").alias("purchase_rate_pct"),
        "orders",
        "repeat_buyers",
        F.round("revenue", 2).alias("revenue_usd"),
        share_of_total("revenue").alias("pct_of_revenue"),
        ratio("revenue", "users", 3).alias("revenue_per_user"),
        ratio("revenue", "orders", 2).alias("aov"),
    )


def _equal_window(users: DataFrame, sessions: DataFrame, label: str, days: int) -> DataFrame:
    """Activity of each eligible user in days 0 to ``days`` after the first visit.

    That is ``days + 1`` dates.  Every user has at least the first visit itself.
    ``sessions`` may be the stored user-days, which meet the users without a shuffle;
    sessions are folded to them first.
    """
    eligible = users.where(eligible_flag(days)).select("user_pseudo_id", label, "first_visit_date")
    age = F.date_diff("session_date", "first_visit_date")
    return (
        user_days(sessions)
        .select("user_pseudo_id", "session_date", "sessions", "orders", "revenue")
        .join(eligible, "user_pseudo_id")
        .where(age.between(0, days))
        .groupBy("user_pseudo_id", label)
        .agg(
            F.sum("sessions").alias("sessions"),
            F.sum("orders").alias("orders"),
            F.sum("revenue").cast("double").alias("revenue"),
        )
    )


def new_vs_returning_window(users: DataFrame, sessions: DataFrame, cfg: AnalyticsConfig) -> DataFrame:
    """New against returning users over an equal window after the first visit."""
    counts = (
        _equal_window(users, sessions, "user_type", cfg.long_window)
        .groupBy("user_type")
        .agg(
            F.count(F.lit(1)).alias("users"),
            F.sum("sessions").alias("sessions"),
            F.count_if(F.col("sessions") > 1).alias("repeaters"),
            F.count_if(F.col("orders") > 0).alias("buyers"),
            F.sum("orders").alias("orders"),
            money_sum("revenue").alias("revenue"),
        )
    )
    return counts.select(
        "user_type",
        "users",
        ratio("sessions", "users", 3).alias("sessions_per_user"),
        pct("repeaters", "users").alias("repeat_visit_rate_pct"),
        "buyers",
        pct("buyers", "users").alias("purchase_rate_pct"),
        "orders",
        F.round("revenue", 2).alias("revenue_usd"),
        ratio("revenue", "users", 3).alias("revenue_per_user"),
        ratio("revenue", "orders", 2).alias("aov"),
    )


def returner_value(users: DataFrame, sessions: DataFrame, cfg: AnalyticsConfig) -> DataFrame:
    """What a new user who returns is worth over the window, against one who does not."""
    back = returned_flag(cfg.long_window)
    counts = (
        _equal_window(users.where(F.col("user_type") == "new"), sessions, back, cfg.long_window)
        .groupBy(back)
        .agg(
            F.count(F.lit(1)).alias("users"),
            F.count_if(F.col("orders") > 0).alias("buyers"),
            money_sum("revenue").alias("revenue"),
        )
    )
    return counts.select(
        back,
        "users",
        "buyers",
        pct("buyers", "users").alias("purchase_rate_pct"),
        F.round("revenue", 2).alias("revenue_usd"),
        ratio("revenue", "users", 3).alias("revenue_per_user"),
    )


def _follow_up(days: int) -> list[Column]:
    """Eligible users of a window and those of them who returned."""
    return [
        F.count_if(eligible_flag(days)).alias(f"eligible_{days}"),
        F.count_if(all_of([eligible_flag(days), returned_flag(days)])).alias(f"returned_{days}"),
    ]


def retention_summary(users: DataFrame, cfg: AnalyticsConfig) -> DataFrame:
    """Return rate per user type and window, over the users with enough follow-up.

    All windows are counted in one pass; the few rows are then laid out by window.
    """
    counts = users.groupBy("user_type").agg(*[c for n in cfg.return_windows for c in _follow_up(n)])
    rows = counts.select(
        "user_type",
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(n).alias("window_days"),
                        F.col(f"eligible_{n}").alias("eligible_users"),
                        F.col(f"returned_{n}").alias("returned"),
                    )
                    for n in cfg.return_windows
                ]
            )
        ),
    )
    return rows.withColumn("return_rate_pct", pct("returned", "eligible_users"))


def _new_user_counts(users: DataFrame, by: Column, cfg: AnalyticsConfig) -> DataFrame:
    return (
        users.where(F.col("user_type") == "new")
        .groupBy(by)
        .agg(
            F.count(F.lit(1)).alias("new_users"),
            *[c for n in cfg.return_windows for c in _follow_up(n)],
            F.count_if("purchased").alias("buyers"),
            money_sum("revenue_usd").alias("revenue"),
        )
    )


def retention_by_channel(users: DataFrame, cfg: AnalyticsConfig) -> DataFrame:
    """Return rates and value of new users per channel."""
    counts = _new_user_counts(users, F.col("acq_channel"), cfg)
    windows: list[Column] = []
    for n in cfg.return_windows:
        windows.append(F.col(f"eligible_{n}").alias(f"eligible_{n}d_users"))
        if n == cfg.long_window:
            windows.append(F.col(f"returned_{n}").alias(f"returned_{n}d"))
        windows.append(pct(f"returned_{n}", f"eligible_{n}").alias(f"return_{n}d_pct"))
    return counts.select(
        "acq_channel",
        "new_users",
        *windows,
        pct("buyers", "new_users").alias("purchase_rate_pct"),
        ratio("revenue", "new_users", 3).alias("revenue_per_user"),
    )


def retention_by_cohort_week(users: DataFrame, cfg: AnalyticsConfig) -> DataFrame:
    """Return rates of new users by the week of the first visit."""
    counts = _new_user_counts(users, week_start("first_visit_date").alias("cohort_week"), cfg)
    windows: list[Column] = []
    for n in cfg.return_windows:
        windows.append(F.col(f"eligible_{n}").alias(f"eligible_{n}d_users"))
        windows.append(pct(f"returned_{n}", f"eligible_{n}").alias(f"return_{n}d_pct"))
    return counts.select("cohort_week", "new_users", *windows, pct("buyers", "new_users").alias("purchase_rate_pct"))


def sessions_bucket(sessions: str = "sessions") -> Column:
    n = F.col(sessions)
    return (
        F.when(n == 1, "1 session")
        .when(n == 2, "2 sessions")
        .when(n == 3, "3 sessions")
        .when(n <= 5, "4-5 sessions")
        .otherwise("6+ sessions")
    )


def sessions_per_user(users: DataFrame) -> DataFrame:
    """Users and revenue by number of sessions."""
    counts = (
        users.withColumn("sessions_bucket", sessions_bucket())
        .groupBy("sessions_bucket")
        .agg(
            F.min("sessions").alias("min_sessions"),
            F.count(F.lit(1)).alias("users"),
            F.count_if("purchased").alias("buyers"),
            money_sum("revenue_usd").alias("revenue"),
        )
    )
    return counts.select(
        "sessions_bucket",
        "min_sessions",
        "users",
        share_of_total("users").alias("pct_of_users"),
        "buyers",
        pct("buyers", "users").alias("purchase_rate_pct"),
        F.round("revenue", 2).alias("revenue_usd"),
        share_of_total("revenue").alias("pct_of_revenue"),
        ratio("revenue", "users", 3).alias("revenue_per_user"),
    )


def revenue_by_visit_number(sessions: DataFrame, users: DataFrame) -> DataFrame:
    """First, second and later visits of each user type.

    ``sessions`` may be the stored visits of each user (see ``visits.user_visits``); sessions are numbered first.
    """
    visits = (
        user_visits(sessions)
        .join(users.select("user_pseudo_id", "user_type"), "user_pseudo_id")
        .groupBy("user_type", "visit_number")
        .agg(*[F.sum(m).alias(m) for m in VISIT_SUMS])
        .withColumn("revenue", F.col("revenue").cast("double"))
    )
    label = (
        F.when(F.col("visit_number") == 1, "1st visit")
        .when(F.col("visit_number") == 2, "2nd visit")
        .otherwise("3rd visit or later")
    )
    return visits.select(
        "user_type",
        label.alias("visit"),
        F.col("visit_number").alias("min_visit_number"),
        "sessions",
        "purchasing_sessions",
        pct("purchasing_sessions", "sessions").alias("conversion_rate_pct"),
        "orders",
        F.round("revenue", 2).alias("revenue_usd"),
        share_of_total("revenue", ["user_type"]).alias("pct_of_user_type_revenue"),
    )


def first_purchases(sessions: DataFrame) -> DataFrame:
    """Per buyer, the visit number and date of the first purchase (from sessions, or from the visits of each user)."""
    buys = user_visits(sessions).where(F.col("first_buy_visit").isNotNull())
    return buys.groupBy("user_pseudo_id").agg(
        F.min("first_buy_date").alias("first_buy_date"), F.min("first_buy_visit").alias("first_buy_visit")
    )


def buyers(sessions: DataFrame, users: DataFrame) -> DataFrame:
    """Buyers with the visit and date of their first purchase, and the days it took them since the first visit."""
    visit = F.col("first_buy_visit")
    return (
        first_purchases(sessions)
        .join(users.select("user_pseudo_id", "user_type", "first_visit_date"), "user_pseudo_id")
        .select(
            "user_type",
            F.when(visit == 1, "First visit")
            .when(visit == 2, "Second visit")
            .otherwise("Third visit or later")
            .alias("first_purchase_on"),
            "first_buy_visit",
            "first_buy_date",
            F.date_diff("first_buy_date", "first_visit_date").alias("days"),
        )
    )


def wait_sketches(buyers: DataFrame) -> DataFrame:
    """The days until the first purchase as mergeable sketches, by user type, visit and the date of the purchase."""
    return quantile_sketches(buyers, ["user_type", "first_purchase_on", "first_buy_date"], "days")


def first_purchase_timing(sessions: DataFrame, users: DataFrame) -> DataFrame:
    """On which visit, and how long after the first visit, buyers buy for the first time."""
    counts = buyers(sessions, users).groupBy("user_type", "first_purchase_on").agg(
        F.min("first_buy_visit").alias("min_visit_number"),
        F.count(F.lit(1)).alias("buyers"),
        F.count_if(F.col("days") == 0).alias("bought_on_first_day"),
        F.percentile_approx("days", 0.5).alias("median_days_after_first_visit"),
    )
    return counts.select(
        "user_type",
        "first_purchase_on",
        "min_visit_number",
        "buyers",
        share_of_total("buyers", ["user_type"]).alias("pct_of_buyers"),
        "bought_on_first_day",
        "median_days_after_first_visit",
    )
