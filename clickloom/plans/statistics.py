"""Statistics and dashboard measures as reports of the job, over the tables of a workspace."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.functions.columns import rounded
from clickloom.operators import inference, metrics, quality
from clickloom.plans.reports import BY_NAME, Report
from clickloom.plans.workspace import Workspace


def _get(ws: Workspace, name: str) -> DataFrame:
    return BY_NAME[name].frame(ws)


def _tested_countries(ws: Workspace) -> DataFrame:
    return inference.segment_vs_rest(_get(ws, "country_performance"), ws.cfg)


STATISTICS: dict[str, Callable[[Workspace], DataFrame]] = {
    "channel_intervals": lambda w: inference.channel_intervals(_get(w, "channel_performance"), w.cfg),
    "channel_tests": lambda w: inference.channel_tests(_get(w, "channel_performance"), w.cfg),
    "device_tests": lambda w: inference.device_tests(
        _get(w, "device_funnel_sessions"), _get(w, "device_performance"), _get(w, "device_funnel_users"), w.cfg
    ),
    "segment_vs_rest": _tested_countries,
    "lowest_segments": lambda w: inference.lowest_segments(_tested_countries(w)),
    "small_segment_illusion": lambda w: inference.small_segment_illusion(_get(w, "country_performance"), w.cfg),
    "pareto": lambda w: inference.pareto(_get(w, "country_performance")),
    "tracking_gaps": lambda w: inference.tracking_gaps(quality.daily_tracking(w.event_profile), w.cfg),
    "tracking_daily_shares": lambda w: inference.tracking_daily_shares(quality.daily_tracking(w.event_profile)),
    "open_vs_strict": lambda w: inference.open_vs_strict(_get(w, "funnel_steps"), _get(w, "funnel_strict")),
    "whole_vs_window": lambda w: inference.whole_vs_window(_get(w, "funnel_whole_period"), _get(w, "funnel_steps")),
    "quadrant_yield": lambda w: inference.quadrant_yield(_get(w, "product_quadrant_summary")),
    "quadrant_leaders": lambda w: inference.quadrant_leaders(w.products),
    "revenue_concentration": lambda w: inference.revenue_concentration(w.products),
    "unmatched_products": lambda w: inference.unmatched_products(w.products, w.cfg),
    "impressions_conversion_corr": lambda w: inference.impressions_conversion_corr(w.products),
    "impression_reallocation": lambda w: inference.impression_reallocation(_get(w, "product_quadrant_summary"), w.cfg),
    "retention_ci": lambda w: inference.retention_ci(_get(w, "retention_summary"), w.cfg),
    "window_purchase_test": lambda w: inference.window_purchase_test(_get(w, "new_vs_returning_window")),
    "multi_session_share": lambda w: inference.multi_session_share(_get(w, "sessions_per_user")),
    "early_return_ratio": lambda w: inference.early_return_ratio(_get(w, "retention_by_cohort_week"), w.cfg),
    "repeat_orders": lambda w: inference.repeat_orders(w.events, w.cfg),
    "baseline_sensitivity": lambda w: inference.baseline_sensitivity(
        _get(w, "period_summary"), inference.baseline_repeats(w.events, w.cfg), w.cfg
    ),
    "period_conversion_pivot": lambda w: inference.period_conversion_pivot(_get(w, "period_channel_mix"), w.cfg),
    "full_weeks": lambda w: inference.full_weeks(_get(w, "weekly_trend")),
    "opportunity_sizing": lambda w: inference.opportunity_sizing(
        _get(w, "funnel_steps"),
        _get(w, "funnel_abandonment"),
        _get(w, "funnel_window_value"),
        _get(w, "channel_funnel"),
        _get(w, "retention_by_channel"),
        _get(w, "returner_value"),
        w.cfg,
    ),
    "profile_users": lambda w: inference.profile_users(w.events, w.sessions, w.cfg),
    "profile_items": lambda w: inference.profile_items(w.raw, w.cfg),
}


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({c: rounded(F.col(f"`{c}`"), 6) for c in names})


def _board(ws: Workspace, *needed: str) -> metrics.Dashboard:
    """The dashboard tables a measure needs; the others are left out."""
    parts = {
        "sessions": lambda: ws.fact_sessions,
        "products_daily": lambda: ws.fact_product_daily,
        "cohorts": lambda: ws.fact_cohort_daily,
        "dates": lambda: ws.dim_date,
        "products": lambda: ws.products,
        "stages": lambda: ws.funnel_stages,
    }
    return metrics.Dashboard(**{name: part() if name in needed else None for name, part in parts.items()})


def _core(ws: Workspace) -> DataFrame:
    names = ["Total Sessions", "Total Users", "Total Orders", "Total Revenue", "Purchasing Sessions"]
    return metrics.session_measures(_board(ws, "sessions", "dates"), names, ["acq_channel"])


def _ratios(ws: Workspace) -> DataFrame:
    names = ["Conversion Rate", "AOV", "Revenue per User", "Revenue per Session"]
    board = _board(ws, "sessions", "dates")
    return _rounded(metrics.session_measures(board, names, ["device_category"], {"user_type": "new"}), *names)


def _funnel(ws: Workspace) -> DataFrame:
    names = [name for _, name in metrics.STAGE_MEASURES]
    return metrics.session_measures(_board(ws, "sessions", "dates"), names, ["period"])


def _abandonment(ws: Workspace) -> DataFrame:
    names = ["Funnel Conversion", "Cart Abandonment", "Checkout Abandonment"]
    return _rounded(metrics.session_measures(_board(ws, "sessions", "dates"), names, ["country"]), *names)


def _funnel_stages(ws: Workspace) -> DataFrame:
    stages = metrics.funnel_by_stage(_board(ws, "sessions", "dates", "stages"), ["device_category"])
    return _rounded(stages, "Step Conversion", "Step Drop-off")


def _product(ws: Workspace) -> DataFrame:
    names = ["Product Revenue", "Product Impressions", "Product Orders"]
    return metrics.product_measures(_board(ws, "products_daily", "dates"), names, ["product_group", "quadrant"])


def _repeat_visits(ws: Workspace) -> DataFrame:
    rates = metrics.repeat_visit_rate(_board(ws, "cohorts", "dates"), ["month_label"])
    return _rounded(rates, "Repeat-visit Rate")


def _return_rates(ws: Workspace) -> DataFrame:
    board, by = _board(ws, "cohorts", "dates"), ["period", "user_type"]
    short, long = (metrics.return_rate(board, days, by) for days in ws.cfg.return_windows)
    long = long.withColumnsRenamed({c: f"long_{c}" for c in by})
    same = [F.col(c).eqNullSafe(F.col(f"long_{c}")) for c in by]
    names = [f"{days}-day Return Rate" for days in ws.cfg.return_windows]
    return _rounded(short.join(long, same).select(*by, *[f"`{c}`" for c in names]), *names)


MEASURES: dict[str, Callable[[Workspace], DataFrame]] = {
    "measures_core": _core,
    "measures_ratios": _ratios,
    "measures_funnel": _funnel,
    "measures_abandonment": _abandonment,
    "measures_funnel_stages": _funnel_stages,
    "measures_product": _product,
    "measures_repeat_visits": _repeat_visits,
    "measures_return_rates": _return_rates,
}

#: Results of a few rows by construction, but for the lists of products and of days.
STATISTIC_REPORTS = tuple(
    Report(name, build, small=name not in ("quadrant_leaders", "unmatched_products", "tracking_daily_shares", "segment_vs_rest"))
    for name, build in (STATISTICS | MEASURES).items()
)
