"""Additive fact tables and dimensions for a dashboard.

Every measure is a count or a sum, so that rates can be computed after slicing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.config import AnalyticsConfig
from clickloom.functions.columns import all_of, literal_table, money_sum, week_start
from clickloom.operators.product import ACTIVITY, stack
from clickloom.operators.season import in_period
from clickloom.operators.userdays import SEGMENT, SUMS, USER_DAY, user_days
from clickloom.operators.users import eligible_flag, returned_flag
from clickloom.schema import FUNNEL_STAGES


def dim_date(spark: SparkSession, periods: DataFrame, cfg: AnalyticsConfig) -> DataFrame:
    """One row per date of the data and period it belongs to; the period of other dates is NULL."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(cfg.first_date), F.lit(cfg.last_date))).alias("date"))
    return in_period(days, periods, "date", "left").select(
        "date",
        F.date_format("date", "EEEE").alias("day_of_week"),
        week_start("date").alias("week_start"),
        F.date_format("date", "MMM yyyy").alias("month_label"),
        F.trunc("date", "month").alias("month_start"),
        "period",
        (F.col("date") >= F.lit(cfg.cart_reliable_from)).alias("add_to_cart_reliable"),
        (F.col("date") < F.lit(cfg.revenue_reliable_until)).alias("purchase_data_reliable"),
    )


def fact_sessions(sessions: DataFrame, users: DataFrame, cfg: AnalyticsConfig) -> DataFrame:
    """Sessions by date, channel, device, country and user type.

    Small countries share one label.  Which countries are small is decided by the
    users' first country and then applied to the country of each session.

    A user is first seen in the first session, whose attributes the users table
    already has; those rows are stacked on the sessions instead of numbering them.
    ``sessions`` may be the stored user-days, which meet the users without a shuffle.
    """
    grain = ["date", "acq_channel", "device_category", "country", "user_type"]
    big = (
        users.groupBy(F.col("first_country").alias("big_country"))
        .agg(F.count(F.lit(1)).alias("n"))
        .where((F.col("n") >= cfg.country_min_users) & F.col("big_country").isNotNull())
        .select("big_country")
    )

    def with_bucket(df: DataFrame) -> DataFrame:
        # The label is derived before grouping, so that it cannot be taken for the country itself.
        marked = df.join(big, F.col("country") == F.col("big_country"), "left")
        return marked.withColumn("country", F.coalesce("big_country", F.lit(cfg.small_country_label)))

    named = {
        "add_to_cart_sessions": "cart_sessions",
        "begin_checkout_sessions": "checkout_sessions",
        "add_payment_sessions": "payment_sessions",
        "revenue": "revenue_usd",
        "session_date": "date",
    }
    activity = (
        user_days(sessions)
        .select(*USER_DAY, *SEGMENT, *SUMS, "acq.acq_channel")
        .withColumnsRenamed(named)
        .join(users.select("user_pseudo_id", "user_type"), "user_pseudo_id")
        .groupBy(*grain)
        .agg(*[F.sum(named.get(c, c)).alias(named.get(c, c)) for c in SUMS])
    )
    arrivals = users.groupBy(
        F.col("first_visit_date").alias("date"),
        "acq_channel",
        F.col("first_device_category").alias("device_category"),
        F.col("first_country").alias("country"),
        "user_type",
    ).agg(F.count(F.lit(1)).alias("first_seen_users"))
    measures = [
        "sessions",
        "first_seen_users",
        "product_view_sessions",
        "cart_sessions",
        "cart_abandoned_sessions",
        "checkout_sessions",
        "checkout_abandoned_sessions",
        "payment_sessions",
        "purchasing_sessions",
        "orders",
        "revenue_usd",
    ]
    stacked = stack([with_bucket(activity), with_bucket(arrivals)], grain, measures)
    facts = stacked.groupBy(*grain).agg(*[F.sum(m).alias(m) for m in measures])
    return facts.withColumn("revenue_usd", F.round(F.col("revenue_usd").cast("double"), 2))


def fact_product_daily(activity: DataFrame, products: DataFrame, cfg: AnalyticsConfig) -> DataFrame:
    """Products by date, for dates with an impression, a cart add or an order line."""
    daily = activity.groupBy("event_date", "item_name").agg(*[F.sum(c).alias(c) for c in ACTIVITY])
    labels = products.select("item_name", "product_group", "quadrant")
    return daily.join(labels, "item_name", "left").select(
        F.col("event_date").alias("date"),
        "item_name",
        F.coalesce("product_group", F.lit(cfg.default_product_group)).alias("product_group"),
        F.coalesce("quadrant", F.lit(cfg.below_floor_label)).alias("quadrant"),
        "impressions",
        "cart_adds",
        "order_lines",
        "units",
        F.round(F.col("revenue").cast("double"), 2).alias("revenue_usd"),
    )


def fact_cohort_daily(users: DataFrame, cfg: AnalyticsConfig) -> DataFrame:
    """Users by first-visit date and user type."""
    follow_up = []
    for n in cfg.return_windows:
        follow_up.append(F.count_if(eligible_flag(n)).alias(f"eligible_{n}d_users"))
        follow_up.append(F.count_if(all_of([eligible_flag(n), returned_flag(n)])).alias(f"returned_{n}d"))
    return users.groupBy("first_visit_date", "user_type").agg(
        F.count(F.lit(1)).alias("users"),
        F.count_if("repeat_visitor").alias("repeat_visitors"),
        *follow_up,
        F.count_if("purchased").alias("buyers"),
        F.round(money_sum("revenue_usd"), 2).alias("revenue_usd"),
    )


def funnel_stages(spark: SparkSession, cfg: AnalyticsConfig) -> DataFrame:
    """The stages of the dashboard funnel, in order."""
    return literal_table(spark, [(s.order, s.label) for s in cfg.main_stages], FUNNEL_STAGES)
