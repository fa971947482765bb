"""One row per user."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.config import AnalyticsConfig
from clickloom.functions.columns import all_of, money_sum, pct, with_one_row
from clickloom.operators.userdays import STEP_COUNTS, build_user_days, day_bitmaps, visit_days, words_for

REACHED_STEPS = (
    "reached_view_item",
    "reached_add_to_cart",
    "reached_begin_checkout",
    "reached_add_shipping_info",
    "reached_add_payment_info",
)


def returned_flag(days: int) -> str:
    return f"returned_within_{days}d"


def eligible_flag(days: int) -> str:
    return f"eligible_{days}d"


def build_users(sessions: DataFrame, cfg: AnalyticsConfig) -> DataFrame:
    """Who the users are: first visit, user type, activity, returns and value."""
    return users_of(build_user_days(sessions), cfg)


def users_of(user_days: DataFrame, cfg: AnalyticsConfig) -> DataFrame:
    """Users from their days.

    Active days and returns come from bitmaps of the days, everything else from sums and least values, so no
    aggregate gathers a user's days.  Both groupings are by user; of a table that is kept by user, neither shuffles.
    """
    words = words_for(cfg.long_window)
    days = visit_days(day_bitmaps(user_days, words), words)
    first = F.struct("first.session_start_ts", "first.ga_session_id", "device_category", "country")
    per_user = user_days.groupBy("user_pseudo_id").agg(
        F.min(first).alias("first"),
        F.min("min_session_number").alias("min_session_number"),
        F.min("acq").alias("acq"),
        F.sum("sessions").alias("sessions"),
        F.sum("page_views").alias("page_views"),
        *[(F.sum(name) > 0).alias(flag) for name, flag in STEP_COUNTS.items() if flag in REACHED_STEPS],
        F.sum("orders").alias("orders"),
        F.sum("revenue").cast("double").alias("revenue_usd"),
    )
    last_date = user_days.agg(F.max("session_date").alias("last_date"))
    waited = F.date_diff("next_day", "first_day")

    return with_one_row(per_user.join(days, "user_pseudo_id"), last_date).select(
        "user_pseudo_id",
        F.col("first_day").alias("first_visit_date"),
        "min_session_number",
        F.when(F.col("min_session_number") == 1, "new").otherwise("returning").alias("user_type"),
        F.col("first.device_category").alias("first_device_category"),
        F.col("first.country").alias("first_country"),
        "acq.acq_channel",
        "acq.acq_medium",
        "acq.acq_source",
        "sessions",
        (F.col("sessions") > 1).alias("repeat_visitor"),
        "active_days",
        "page_views",
        *REACHED_STEPS,
        "orders",
        (F.col("orders") > 0).alias("purchased"),
        "revenue_usd",
        *[F.coalesce(waited <= n, F.lit(False)).alias(returned_flag(n)) for n in cfg.return_windows],
        *[(F.col("first_day") <= F.date_sub("last_date", n)).alias(eligible_flag(n)) for n in cfg.return_windows],
    )


def check_users(users: DataFrame, cfg: AnalyticsConfig) -> DataFrame:
    """Totals that must agree with the sessions, and the return rates of new users."""
    new = F.col("user_type") == "new"
    totals = users.agg(
        F.count(F.lit(1)).alias("users"),
        F.count_distinct("user_pseudo_id").alias("distinct_users"),
        F.sum("sessions").alias("total_sessions"),
        F.count_if(new).alias("new_users"),
        F.count_if(F.col("user_type") == "returning").alias("returning_users"),
        F.count_if("purchased").alias("purchasing_users"),
        F.sum("orders").alias("orders"),
        F.round(money_sum("revenue_usd"), 2).alias("revenue_usd"),
        *[F.count_if(eligible_flag(n)).alias(f"eligible_{n}d_users") for n in cfg.return_windows],
        *[F.count_if(all_of([new, eligible_flag(n)])).alias(f"new_{n}") for n in cfg.return_windows],
        *[
            F.count_if(all_of([new, eligible_flag(n), returned_flag(n)])).alias(f"back_{n}")
            for n in cfg.return_windows
        ],
    )
    helpers = [f"{kind}_{n}" for kind in ("new", "back") for n in cfg.return_windows]
    return totals.withColumns(
        {f"new_user_return_{n}d_pct": pct(f"back_{n}", f"new_{n}") for n in cfg.return_windows}
    ).drop(*helpers)
