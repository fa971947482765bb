"""Acquisition channels: performance, funnel and the sources behind them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.config import AnalyticsConfig
from clickloom.functions.columns import from_row, money_sum, pct, ratio
from clickloom.operators.funnel import main_step_counts


def channel_performance(users: DataFrame, cfg: AnalyticsConfig) -> DataFrame:
    """Size, conversion and value per channel, with an all-users row as the benchmark.

    The total is rolled up from the few channel rows, not from the users.
    """
    by_channel = users.groupBy("acq_channel").agg(
        F.count(F.lit(1)).alias("users"),
        F.sum("sessions").alias("sessions"),
        F.count_if("purchased").alias("purchasers"),
        F.sum("orders").alias("orders"),
        money_sum("revenue_usd").alias("revenue"),
    )
    sums = [F.sum(c).alias(c) for c in ("users", "sessions", "purchasers", "orders")]
    # grouping() keeps the total apart from a channel that is NULL.
    with_total = by_channel.rollup("acq_channel").agg(
        *sums, money_sum("revenue").alias("revenue"), F.grouping("acq_channel").alias("is_total")
    )
    total = F.col("is_total") == 1
    rows = with_total.withColumns(
        {
            "acq_channel": F.when(total, F.lit(cfg.all_users_label)).otherwise(F.col("acq_channel")),
            "all_users": from_row(total, "users"),
            "all_revenue": from_row(total, "revenue"),
        }
    )
    return rows.select(
        "acq_channel",
        F.col("acq_channel").isin(*cfg.obscured_channels).alias("is_obscured"),
        "users",
        pct("users", "all_users").alias("pct_of_users"),
        "sessions",
        ratio("sessions", "users", 2).alias("sessions_per_user"),
        "purchasers",
        "orders",
        pct("purchasers", "users").alias("conversion_rate_pct"),
        F.round("revenue", 2).alias("revenue_usd"),
        pct("revenue", "all_revenue").alias("pct_of_revenue"),
        ratio("revenue", "users", 3).alias("revenue_per_user"),
        ratio("revenue", "orders", 2).alias("aov"),
    )


def channel_funnel(cart_users: DataFrame) -> DataFrame:
    """Step-by-step conversion of each channel's users in the cart window."""
    counts = cart_users.groupBy("acq_channel").agg(F.count(F.lit(1)).alias("users"), *main_step_counts())
    return counts.select(
        "*",
        pct("product_view", "users").alias("view_pct_of_users"),
        pct("add_to_cart", "product_view").alias("cart_pct_of_view"),
        pct("begin_checkout", "add_to_cart").alias("checkout_pct_of_cart"),
        pct("add_payment_info", "begin_checkout").alias("payment_pct_of_checkout"),
        pct("purchase", "add_payment_info").alias("purchase_pct_of_payment"),
        pct("purchase", "product_view").alias("purchase_pct_of_viewers"),
    )


def channel_sources(users: DataFrame, cfg: AnalyticsConfig) -> DataFrame:
    """Medium and source behind each channel, for combinations with enough users."""
    counts = users.groupBy("acq_channel", "acq_medium", "acq_source").agg(
        F.count(F.lit(1)).alias("users"),
        F.count_if("purchased").alias("purchasers"),
        F.sum("orders").alias("orders"),
        money_sum("revenue_usd").alias("revenue"),
    )
    return counts.where(F.col("users") >= cfg.source_min_users).select(
        "acq_channel",
        "acq_medium",
        "acq_source",
        "users",
        "purchasers",
        "orders",
        pct("purchasers", "users").alias("conversion_rate_pct"),
        F.round("revenue", 2).alias("revenue_usd"),
        ratio("revenue", "users", 3).alias("revenue_per_user"),
    )
