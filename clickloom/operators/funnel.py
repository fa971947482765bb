"""The purchase funnel: open, strict, per window, and what is lost along the way."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickloom.config import AnalyticsConfig, FunnelStage
from clickloom.functions.columns import all_of, money_sum, pct, ratio, with_one_row
from clickloom.operators.users import REACHED_STEPS

MAIN_FLAGS = {
    "product_view": "reached_view_item",
    "add_to_cart": "reached_add_to_cart",
    "begin_checkout": "reached_begin_checkout",
    "add_payment_info": "reached_add_payment_info",
    "purchase": "purchased",
}


def main_step_counts() -> list[Column]:
    """How many rows reached each main step."""
    return [F.count_if(flag).alias(step) for step, flag in MAIN_FLAGS.items()]


def cart_window_sessions(sessions: DataFrame, cfg: AnalyticsConfig) -> DataFrame:
    """Sessions from the day on which cart tracking became reliable."""
    return sessions.where(F.col("session_date") >= F.lit(cfg.cart_reliable_from))


def cart_window_users(cart_sessions: DataFrame) -> DataFrame:
    """One row per user active in the cart window, described by those sessions alone."""
    known_device = F.when(
        F.col("device_category").isNotNull(), F.struct("session_start_ts", "ga_session_id", "device_category")
    )
    return cart_sessions.groupBy("user_pseudo_id").agg(
        F.min("acq_channel").alias("acq_channel"),
        F.min(known_device)["device_category"].alias("first_device_category"),
        F.count(F.lit(1)).alias("sessions"),
        *[F.bool_or(flag).alias(flag) for flag in (*REACHED_STEPS, "purchased")],
        F.sum("orders").alias("orders"),
        money_sum("revenue_usd").alias("revenue_usd"),
    )


def _stage_counts(df: DataFrame, stages: Sequence[FunnelStage], level: str) -> DataFrame:
    """One row with a column per stage, named ``<level>_<order>``."""
    return df.agg(
        *[
            (F.count(F.lit(1)) if s.flag is None else F.count_if(s.flag)).alias(f"{level}_{s.order}")
            for s in stages
        ]
    )


def _stage_rows(counts: DataFrame, stages: Sequence[FunnelStage], levels: Sequence[str]) -> DataFrame:
    """Turn the one-row counts into a row per stage that also holds its reference stage's counts."""
    first = stages[0].order

    def row(s: FunnelStage) -> Column:
        fields = [
            F.lit(s.order).alias("stage_order"),
            F.lit(s.label).alias("stage"),
            F.lit(s.diagnostic).alias("is_diagnostic"),
        ]
        for level in levels:
            before = F.lit(None).cast("bigint") if s.previous is None else F.col(f"{level}_{s.previous}")
            fields += [
                F.col(f"{level}_{s.order}").alias(level),
                before.alias(f"{level}_before"),
                F.col(f"{level}_{first}").alias(f"{level}_at_start"),
            ]
        return F.struct(*fields)

    return counts.select(F.inline(F.array(*[row(s) for s in stages])))


def _lost(level: str) -> Column:
    return F.col(f"{level}_before") - F.col(level)


def funnel_steps(cart_users: DataFrame, cart_sessions: DataFrame, cfg: AnalyticsConfig) -> DataFrame:
    """Users and sessions per stage, conversion, loss, and the rank of each loss."""
    stages = cfg.detailed_stages
    counts = with_one_row(
        _stage_counts(cart_users, stages, "users"), _stage_counts(cart_sessions, stages, "sessions")
    )
    rows = _stage_rows(counts, stages, ["users", "sessions"])
    ranked = (F.col("stage_order") != stages[0].order) & ~F.col("is_diagnostic")
    by_loss = Window.partitionBy(ranked).orderBy(ratio(_lost("users"), "users_before").desc_nulls_last())

    def measures(level: str) -> list[Column]:
        return [
            pct(level, f"{level}_before").alias(f"{level}_step_conversion_pct"),
            pct(level, f"{level}_at_start").alias(f"{level}_overall_conversion_pct"),
            _lost(level).alias(f"{level}_drop_off"),
            pct(_lost(level), f"{level}_before").alias(f"{level}_drop_off_pct"),
        ]

    return rows.select(
        "stage_order",
        "stage",
        "is_diagnostic",
        "users",
        "sessions",
        *measures("users"),
        *measures("sessions"),
        F.when(ranked, F.rank().over(by_loss)).alias("users_drop_off_rank"),
    )


def funnel_abandonment(cart_users: DataFrame, cart_sessions: DataFrame) -> DataFrame:
    """Those who reached the cart or the checkout and did not buy."""

    def level(name: str, df: DataFrame) -> DataFrame:
        left = ~F.col("purchased")
        counts = df.agg(
            F.count_if("reached_add_to_cart").alias("added_to_cart"),
            F.count_if(F.col("reached_add_to_cart") & left).alias("cart_abandoned"),
            F.count_if("reached_begin_checkout").alias("began_checkout"),
            F.count_if(F.col("reached_begin_checkout") & left).alias("checkout_abandoned"),
        )
        return counts.select(
            F.lit(name).alias("level"),
            "added_to_cart",
            "cart_abandoned",
            pct("cart_abandoned", "added_to_cart").alias("cart_abandonment_pct"),
            "began_checkout",
            "checkout_abandoned",
            pct("checkout_abandoned", "began_checkout").alias("checkout_abandonment_pct"),
        )

    return level("users", cart_users).unionByName(level("sessions", cart_sessions))


def funnel_open_checks(cart_users: DataFrame) -> DataFrame:
    """How many buyers and checkout users have no event for an earlier step."""

    def lacking(reached: str, step: str) -> Column:
        return F.count_if(F.col(reached) & ~F.col(step))

    counts = cart_users.agg(
        F.count_if("purchased").alias("purchasers"),
        lacking("purchased", "reached_view_item").alias("purchasers_without_product_view"),
        lacking("purchased", "reached_add_to_cart").alias("purchasers_without_add_to_cart"),
        lacking("purchased", "reached_begin_checkout").alias("purchasers_without_begin_checkout"),
        lacking("purchased", "reached_add_payment_info").alias("purchasers_without_add_payment_info"),
        F.count_if("reached_begin_checkout").alias("checkout_users"),
        lacking("reached_begin_checkout", "reached_add_to_cart").alias("checkout_users_without_add_to_cart"),
    )
    return counts.withColumns(
        {
            "pct_purchasers_without_add_to_cart": pct("purchasers_without_add_to_cart", "purchasers"),
            "pct_checkout_users_without_add_to_cart": pct("checkout_users_without_add_to_cart", "checkout_users"),
        }
    )


def funnel_strict(cart_users: DataFrame) -> DataFrame:
    """The funnel as a strict sequence: a step counts only with every earlier step.

    The steps are flags, so this asks whether all happened, not in which order.
    """
    flags = list(MAIN_FLAGS.values())
    counts = cart_users.agg(
        F.count(F.lit(1)).alias("users_all"),
        *[F.count_if(all_of(flags[: i + 1])).alias(step) for i, step in enumerate(MAIN_FLAGS)],
    )
    return counts.select(
        "*",
        pct("add_to_cart", "product_view").alias("strict_view_to_cart_pct"),
        pct("begin_checkout", "add_to_cart").alias("strict_cart_to_checkout_pct"),
        pct("add_payment_info", "begin_checkout").alias("strict_checkout_to_payment_pct"),
        pct("purchase", "add_payment_info").alias("strict_payment_to_purchase_pct"),
        pct("purchase", "users_all").alias("strict_overall_conversion_pct"),
    )


def funnel_whole_period(users: DataFrame, cfg: AnalyticsConfig) -> DataFrame:
    """The open funnel of users over all days, for comparison with the cart window."""
    rows = _stage_rows(_stage_counts(users, cfg.main_stages, "users"), cfg.main_stages, ["users"])
    return rows.select(
        "stage_order",
        "stage",
        "users",
        pct("users", "users_before").alias("users_step_conversion_pct"),
        pct(_lost("users"), "users_before").alias("users_drop_off_pct"),
    )


def funnel_window_value(cart_users: DataFrame, cfg: AnalyticsConfig) -> DataFrame:
    """Buyers, orders and revenue of the cart window."""
    totals = cart_users.agg(
        F.count(F.lit(1)).alias("users"),
        F.count_if("purchased").alias("buyers"),
        F.sum("orders").alias("orders"),
        money_sum("revenue_usd").alias("revenue"),
    )
    return totals.select(
        "users",
        "buyers",
        "orders",
        F.round("revenue", 2).alias("revenue_usd"),
        ratio("revenue", "buyers", 2).alias("revenue_per_buyer"),
        ratio("revenue", "orders", 2).alias("aov"),
        F.lit((cfg.last_date - cfg.cart_reliable_from).days + 1).alias("days_in_window"),
    )


def cart_tracking_daily(sessions: DataFrame, cfg: AnalyticsConfig) -> DataFrame:
    """Per day, the share of product-viewing sessions that also have a cart event."""
    daily = sessions.groupBy(F.col("session_date").alias("date")).agg(
        F.count(F.lit(1)).alias("sessions"),
        F.count_if("reached_view_item").alias("product_view_sessions"),
        F.count_if("reached_add_to_cart").alias("add_to_cart_sessions"),
        F.count_if("reached_begin_checkout").alias("begin_checkout_sessions"),
    )
    return daily.withColumns(
        {
            "cart_pct_of_product_view_sessions": pct("add_to_cart_sessions", "product_view_sessions"),
            "in_cart_window": F.col("date") >= F.lit(cfg.cart_reliable_from),
        }
    )
