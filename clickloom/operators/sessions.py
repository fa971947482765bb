"""Clean events, orders, first touch and sessions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.config import AnalyticsConfig
from clickloom.functions.columns import int_param, label_by_value, money_sum, raw_date, with_one_row

SESSION_KEY = ["user_pseudo_id", "ga_session_id"]

REACHED = {
    "has_session_start_event": "session_start",
    "reached_view_item": "view_item",
    "reached_add_to_cart": "add_to_cart",
    "reached_begin_checkout": "begin_checkout",
    "reached_add_shipping_info": "add_shipping_info",
    "reached_add_payment_info": "add_payment_info",
}


def clean_events(raw: DataFrame, extra: Sequence[str | Column] = ()) -> DataFrame:
    """One row per event with the needed parameters and nested fields flattened out."""
    return raw.select(
        raw_date().alias("event_date"),
        F.timestamp_micros("event_timestamp").alias("event_ts"),
        "event_name",
        "user_pseudo_id",
        int_param("ga_session_id").alias("ga_session_id"),
        int_param("ga_session_number").alias("ga_session_number"),
        F.col("device.category").alias("device_category"),
        F.col("geo.country").alias("country"),
        F.col("traffic_source.medium").alias("acq_medium"),
        F.col("traffic_source.source").alias("acq_source"),
        F.col("ecommerce.transaction_id").alias("transaction_id"),
        F.col("ecommerce.purchase_revenue_in_usd").alias("purchase_revenue_usd"),
        *extra,
    )


ORDER_COLUMNS = ("ga_session_id", "event_date", "purchase_revenue_usd")


def clean_orders(events: DataFrame, cfg: AnalyticsConfig, carry: Sequence[str] = ORDER_COLUMNS) -> DataFrame:
    """One row per order: the earliest event of each real transaction id, and every
    id-less purchase that has revenue.

    The id-less purchases share no key with one another, so they are filtered, not
    grouped.  The earliest event of an id is an aggregate rather than a row number,
    so that a much-repeated id shrinks before the shuffle.  Equal times are settled
    by user, session and revenue, whatever is carried, so that an order and its items
    come from the same event.
    """
    decided = ["event_ts", "user_pseudo_id", "ga_session_id", "purchase_revenue_usd"]
    columns = [*decided, *(c for c in carry if c not in decided)]
    purchases = events.where(F.col("event_name") == "purchase")
    transaction = F.col("transaction_id")
    no_id = transaction.isNull() | (transaction == cfg.missing_transaction_id)

    with_id = (
        purchases.where(~no_id)
        .groupBy("transaction_id")
        .agg(F.min(F.struct(*columns)).alias("earliest"))
        .select("transaction_id", "earliest.*")
    )
    without_id = purchases.where(no_id & (F.col("purchase_revenue_usd") > 0)).select("transaction_id", *columns)
    return with_id.unionByName(without_id)


def first_touch(events: DataFrame, cfg: AnalyticsConfig) -> DataFrame:
    """The earliest medium and source of each user that is not obscured, or else the earliest.

    Only the medium is tested.  A first pass keeps the earliest time of each
    medium and source with fixed-width aggregates; the second picks among those few.
    """
    return pick_touch(touch_times(events), cfg)


def touch_times(events: DataFrame, *more: str) -> DataFrame:
    """The earliest time of each medium and source of a user (and of ``more``, such as the day)."""
    return events.groupBy("user_pseudo_id", "acq_medium", "acq_source", *more).agg(F.min("event_ts").alias("ts"))


def pick_touch(seen: DataFrame, cfg: AnalyticsConfig) -> DataFrame:
    """The first touch of each user from such times, which may come from several sets of events."""
    touch = F.struct("ts", "acq_medium", "acq_source")
    named = ~F.col("acq_medium").isin(*cfg.obscured_mediums)
    picked = seen.groupBy("user_pseudo_id").agg(F.coalesce(F.min(F.when(named, touch)), F.min(touch)).alias("touch"))
    return picked.select("user_pseudo_id", "touch.acq_medium", "touch.acq_source")


def channel_label(cfg: AnalyticsConfig, medium: str | Column = "acq_medium") -> Column:
    """Acquisition channel of a medium; an unknown or missing medium has the default channel."""
    return label_by_value(medium, cfg.channel_by_medium, cfg.default_channel)


def _earliest(value: str) -> Column:
    """The value of the earliest row in which it is known."""
    known = F.when(F.col(value).isNotNull(), F.struct("first_ts", value))
    return F.min(known)[value].alias(value)


def session_activity(events: DataFrame) -> DataFrame:
    """One row per session with its counts and open-funnel flags, before orders and channel.

    Events are first folded by session, device and country, which nearly always is
    one row per session, using fixed-width aggregates only.  The earliest device and
    country are then chosen among those rows, not among all events.
    """
    return merge_activity(fold_activity(events))


def fold_activity(events: DataFrame, *more: str) -> DataFrame:
    """Events folded by session, device and country (and by ``more``, such as the day)."""
    is_event = {flag: F.col("event_name") == name for flag, name in REACHED.items()}
    return events.groupBy(*SESSION_KEY, "device_category", "country", *more).agg(
        F.min("ga_session_number").alias("ga_session_number"),
        F.min("event_ts").alias("first_ts"),
        F.min("event_date").alias("session_date"),
        F.count(F.lit(1)).alias("events"),
        F.count_if(F.col("event_name") == "page_view").alias("page_views"),
        *[F.bool_or(test).alias(flag) for flag, test in is_event.items()],
        F.count_if(F.col("event_name") == "purchase").alias("purchase_events"),
    )


def merge_activity(folded: DataFrame) -> DataFrame:
    """One row per session from folded events, which may come from several sets of events."""
    return folded.groupBy(*SESSION_KEY).agg(
        F.min("ga_session_number").alias("ga_session_number"),
        F.min("first_ts").alias("session_start_ts"),
        F.min("session_date").alias("session_date"),
        _earliest("device_category"),
        _earliest("country"),
        F.sum("events").alias("events"),
        F.sum("page_views").alias("page_views"),
        *[F.bool_or(flag).alias(flag) for flag in REACHED],
        F.sum("purchase_events").alias("purchase_events"),
    )


def build_sessions(events: DataFrame, cfg: AnalyticsConfig, touch: DataFrame | None = None) -> DataFrame:
    """One row per user and session id.

    Pass ``touch`` as a stored table where there is a store: a join of two shuffled
    tables can be split by adaptive execution at a user with very many sessions, a
    join to an aggregate cannot.
    """
    if touch is None:
        touch = first_touch(events, cfg)
    return finish_sessions(session_activity(events), clean_orders(events, cfg), touch, cfg)


def finish_sessions(activity: DataFrame, orders: DataFrame, touch: DataFrame, cfg: AnalyticsConfig) -> DataFrame:
    """Sessions from their activity, the orders and the users' first touch."""
    order_totals = (
        orders.groupBy(*SESSION_KEY)
        .agg(F.count(F.lit(1)).alias("orders"), money_sum("purchase_revenue_usd").alias("revenue_usd"))
    )
    if cfg.null_safe_sessions:
        order_totals = order_totals.withColumnsRenamed({key: f"o_{key}" for key in SESSION_KEY})
        same_session = [F.col(key).eqNullSafe(F.col(f"o_{key}")) for key in SESSION_KEY]
        with_orders = activity.join(order_totals, same_session, "left")
    else:
        with_orders = activity.join(order_totals, SESSION_KEY, "left")
    number = F.coalesce("orders", F.lit(0))
    return with_orders.join(touch, "user_pseudo_id").select(
        *SESSION_KEY,
        "ga_session_number",
        "session_start_ts",
        "session_date",
        "device_category",
        "country",
        "acq_medium",
        "acq_source",
        channel_label(cfg).alias("acq_channel"),
        "events",
        "page_views",
        *REACHED,
        "purchase_events",
        number.alias("orders"),
        (number > 0).alias("purchased"),
        F.coalesce("revenue_usd", F.lit(0.0)).alias("revenue_usd"),
    )


def check_sessions(events: DataFrame, sessions: DataFrame) -> DataFrame:
    """Reconciliation totals of clean events against sessions, in one row."""
    from_events = events.agg(
        F.count(F.lit(1)).alias("events_clean_rows"),
        F.count_if(F.col("event_name") == "page_view").alias("page_views_in_events"),
        F.count_if(F.col("event_name") == "purchase").alias("raw_purchase_events"),
    )
    # Sessions are counted per user first: one shuffle instead of two distinct counts.
    per_session = sessions.groupBy(*SESSION_KEY).agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum("page_views").alias("page_views"),
        F.sum("orders").alias("orders"),
        F.count_if("purchased").alias("purchasing"),
        money_sum("revenue_usd").alias("revenue"),
    )
    per_user = per_session.groupBy("user_pseudo_id").agg(
        F.sum("rows").alias("rows"),
        F.count("ga_session_id").alias("known_sessions"),
        F.sum("page_views").alias("page_views"),
        F.sum("orders").alias("orders"),
        F.sum("purchasing").alias("purchasing"),
        money_sum("revenue").alias("revenue"),
    )
    from_sessions = per_user.agg(
        F.sum("rows").alias("sessions"),
        F.sum(F.when(F.col("user_pseudo_id").isNotNull(), F.col("known_sessions"))).alias("distinct_sessions"),
        F.count("user_pseudo_id").alias("users"),
        F.sum("page_views").alias("page_views_in_sessions"),
        F.sum("orders").alias("orders"),
        F.sum("purchasing").alias("purchasing_sessions"),
        F.round(money_sum("revenue"), 2).alias("revenue_usd"),
    )
    return with_one_row(from_events, from_sessions).select(
        "events_clean_rows",
        "sessions",
        "distinct_sessions",
        "users",
        "page_views_in_events",
        "page_views_in_sessions",
        "raw_purchase_events",
        "orders",
        "purchasing_sessions",
        "revenue_usd",
    )


def sessions_by_channel(sessions: DataFrame) -> DataFrame:
    """Users, sessions, orders and revenue of each acquisition channel."""
    return sessions.groupBy("acq_channel").agg(
        F.count_distinct("user_pseudo_id").alias("users"),
        F.count(F.lit(1)).alias("sessions"),
        F.sum("orders").alias("orders"),
        F.round(money_sum("revenue_usd"), 2).alias("revenue_usd"),
    )
