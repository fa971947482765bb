"""Devices and countries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.functions.columns import money_sum, pct, ratio, share_of_total
from clickloom.operators.funnel import main_step_counts


def device_performance(sessions: DataFrame) -> DataFrame:
    """Sessions, orders and value per device, over the whole period."""
    counts = sessions.groupBy("device_category").agg(
        F.count(F.lit(1)).alias("sessions"),
        F.count_distinct("user_pseudo_id").alias("users"),
        F.count_if("purchased").alias("purchase"),
        F.sum("orders").alias("orders"),
        money_sum("revenue_usd").alias("revenue"),
    )
    return counts.select(
        "device_category",
        "sessions",
        "users",
        share_of_total("sessions").alias("pct_of_sessions"),
        "purchase",
        "orders",
        F.round("revenue", 2).alias("revenue_usd"),
        share_of_total("revenue").alias("pct_of_revenue"),
        pct("purchase", "sessions").alias("conversion_rate_pct"),
        ratio("revenue", "sessions", 3).alias("revenue_per_session"),
        ratio("revenue", "orders", 2).alias("aov"),
    )


def device_funnel_sessions(cart_sessions: DataFrame) -> DataFrame:
    """Step-by-step conversion of sessions per device, in the cart window."""
    counts = cart_sessions.groupBy("device_category").agg(
        F.count(F.lit(1)).alias("sessions"),
        F.count_distinct("user_pseudo_id").alias("users"),
        *main_step_counts(),
    )
    return counts.select(
        "*",
        pct("product_view", "sessions").alias("view_pct_of_sessions"),
        pct("add_to_cart", "product_view").alias("cart_pct_of_view"),
        pct("begin_checkout", "add_to_cart").alias("checkout_pct_of_cart"),
        pct("add_payment_info", "begin_checkout").alias("payment_pct_of_checkout"),
        pct("purchase", "add_payment_info").alias("purchase_pct_of_payment"),
        pct("purchase", "sessions").alias("conversion_rate_pct"),
    )


def device_funnel_users(users: DataFrame) -> DataFrame:
    """Each user once, under the device of the first session."""
    counts = users.groupBy(F.col("first_device_category").alias("device_category")).agg(
        F.count(F.lit(1)).alias("users"),
        F.count_if("purchased").alias("purchase"),
        F.sum("orders").alias("orders"),
        F.round(money_sum("revenue_usd"), 2).alias("revenue_usd"),
    )
    return counts.withColumn("conversion_rate_pct", pct("purchase", "users"))


def country_performance(users: DataFrame) -> DataFrame:
    """Each user once, under the country of the first session."""
    counts = users.groupBy(F.col("first_country").alias("country")).agg(
        F.count(F.lit(1)).alias("users"),
        F.sum("sessions").alias("sessions"),
        F.count_if("purchased").alias("purchasers"),
        F.sum("orders").alias("orders"),
        money_sum("revenue_usd").alias("revenue"),
    )
    return counts.select(
        "country",
        "users",
        share_of_total("users").alias("pct_of_users"),
        "sessions",
        "purchasers",
        "orders",
        pct("purchasers", "users").alias("conversion_rate_pct"),
        F.round("revenue", 2).alias("revenue_usd"),
        share_of_total("revenue").alias("pct_of_revenue"),
        ratio("revenue", "users", 3).alias("revenue_per_user"),
        ratio("revenue", "orders", 2).alias("aov"),
    )
