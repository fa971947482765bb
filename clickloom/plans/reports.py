"""The catalogue of exported reports, in dependency order."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.operators import channel, funnel, product, quality, retention, season, segment, sessions, users
from clickloom.plans.workspace import Workspace


@dataclass(frozen=True)
class Report:
    """A named result; ``order`` lists sort columns, descending when prefixed with ``-``.

    ``small`` results have a handful of rows by construction and go to one file; others go to as many as they
    fill, numbered in their order.
    """

    name: str
    build: Callable[[Workspace], DataFrame]
    order: tuple[str, ...] = ()
    small: bool = True

    def frame(self, ws: Workspace) -> DataFrame:
        return self.build(ws)

    def keys(self) -> list[Column]:
        return [F.desc(k[1:]) if k.startswith("-") else F.asc(k) for k in self.order]


REPORTS = (
    Report("dq_overview", lambda w: quality.overview(w.event_profile, w.events)),
    Report("dq_events_by_name", lambda w: quality.events_by_name(w.event_profile), ("-events",)),
    Report("dq_daily_events", lambda w: quality.daily_events(w.event_profile), ("event_date",)),
    Report("dq_obscured_values", lambda w: quality.dq_obscured_values(w.raw), ("-unusable_pct",)),
    Report("dq_funnel_events", lambda w: quality.funnel_events(w.event_profile, w.cfg), ("-events",)),
    Report("dq_purchases", lambda w: quality.purchases(w.event_profile, w.events)),
    Report("dq_daily_tracking", lambda w: quality.daily_tracking(w.event_profile), ("event_date",)),
    Report("dq_new_vs_returning", lambda w: quality.new_vs_returning(w.event_profile)),
    Report("check_sessions", lambda w: sessions.check_sessions(w.events, w.sessions)),
    Report("sessions_by_channel", lambda w: sessions.sessions_by_channel(w.sessions), ("-users",)),
    Report("check_users", lambda w: users.check_users(w.users, w.cfg)),
    Report("funnel_steps", lambda w: funnel.funnel_steps(w.cart_users, w.cart_sessions, w.cfg), ("stage_order",)),
    Report("funnel_abandonment", lambda w: funnel.funnel_abandonment(w.cart_users, w.cart_sessions)),
    Report("funnel_open_checks", lambda w: funnel.funnel_open_checks(w.cart_users)),
    Report("funnel_strict", lambda w: funnel.funnel_strict(w.cart_users)),
    Report("funnel_whole_period", lambda w: funnel.funnel_whole_period(w.users, w.cfg), ("stage_order",)),
    Report("funnel_window_value", lambda w: funnel.funnel_window_value(w.cart_users, w.cfg)),
    Report("cart_tracking_daily", lambda w: funnel.cart_tracking_daily(w.sessions, w.cfg), ("date",)),
    Report("channel_performance", lambda w: channel.channel_performance(w.users, w.cfg), ("-revenue_usd",)),
    Report("channel_funnel", lambda w: channel.channel_funnel(w.cart_users), ("-users",)),
    Report("channel_sources", lambda w: channel.channel_sources(w.users, w.cfg), ("-users",), small=False),
    Report("device_performance", lambda w: segment.device_performance(w.sessions), ("-sessions",)),
    Report("device_funnel_sessions", lambda w: segment.device_funnel_sessions(w.cart_sessions), ("-sessions",)),
    Report("device_funnel_users", lambda w: segment.device_funnel_users(w.users), ("-users",)),
    Report("country_performance", lambda w: segment.country_performance(w.users), ("-users",), small=False),
    Report("products_export", lambda w: product.products_export(w.products), ("item_name",), small=False),
    Report("product_groups", lambda w: product.product_groups(w.products), ("-revenue_usd",)),
    Report("product_quadrant_summary", lambda w: product.product_quadrant_summary(w.products), ("-revenue_usd",)),
    Report("check_products", lambda w: product.check_products(w.products, w.sessions, w.cfg)),
    Report("new_vs_returning", lambda w: retention.new_vs_returning(w.users), ("-users",)),
    Report(
        "new_vs_returning_window",
        lambda w: retention.new_vs_returning_window(w.users, w.user_days, w.cfg),
        ("-users",),
    ),
    Report("returner_value", lambda w: retention.returner_value(w.users, w.user_days, w.cfg), ("users",)),
    Report("retention_summary", lambda w: retention.retention_summary(w.users, w.cfg), ("user_type", "window_days")),
    Report("retention_by_channel", lambda w: retention.retention_by_channel(w.users, w.cfg), ("-new_users",)),
    Report("retention_by_cohort_week", lambda w: retention.retention_by_cohort_week(w.users, w.cfg), ("cohort_week",)),
    Report("sessions_per_user", lambda w: retention.sessions_per_user(w.users), ("min_sessions",)),
    Report(
        "revenue_by_visit_number",
        lambda w: retention.revenue_by_visit_number(w.user_visits, w.users),
        ("user_type", "min_visit_number"),
    ),
    Report(
        "first_purchase_timing",
        lambda w: retention.first_purchase_timing(w.user_visits, w.users),
        ("user_type", "min_visit_number"),
    ),
    Report(
        "period_summary",
        lambda w: season.period_summary(w.user_days, w.users, w.periods, w.cfg),
        ("period_order",),
    ),
    Report("weekly_trend", lambda w: season.weekly_trend(w.user_days, w.cfg), ("week_start",)),
    Report("daily_trend", lambda w: season.daily_trend(w.user_days, w.users, w.cfg), ("date",)),
    Report("period_funnel", lambda w: season.period_funnel(w.sessions, w.periods), ("period_order",)),
    Report(
        "period_channel_mix",
        lambda w: season.period_channel_mix(w.sessions, w.periods),
        ("period_order", "-sessions"),
    ),
    Report("dim_date", lambda w: w.dim_date, ("date",)),
    Report(
        "fact_sessions",
        lambda w: w.fact_sessions,
        ("date", "acq_channel", "device_category", "country", "user_type"),
        small=False,
    ),
    Report("fact_product_daily", lambda w: w.fact_product_daily, ("date", "item_name"), small=False),
    Report("fact_cohort_daily", lambda w: w.fact_cohort_daily, ("first_visit_date", "user_type"), small=False),
    Report("funnel_stages", lambda w: w.funnel_stages, ("stage_order",)),
)

BY_NAME = {report.name: report for report in REPORTS}

__all__ = ["BY_NAME", "REPORTS", "Report"]
