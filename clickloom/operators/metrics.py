"""Dashboard measures over the fact tables.

A measure is an aggregate expression; ``measure`` joins a fact table to its date or
product dimension, filters, groups by any slicers and evaluates the expressions.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.functions.columns import money_sum, ratio

Filters = Mapping[str, object]


@dataclass(frozen=True)
class Dashboard:
    """The tables the measures run over."""

    sessions: DataFrame
    products_daily: DataFrame
    cohorts: DataFrame
    dates: DataFrame
    products: DataFrame
    stages: DataFrame


def _sum(c: str) -> Column:
    return money_sum(c) if c == "revenue_usd" else F.sum(c)


def _reliable(c: str) -> Column:
    """Sum over the dates with reliable cart tracking, on top of any filter in force."""
    return F.sum(F.when(F.col("add_to_cart_reliable"), F.col(c)))


# Factories rather than Columns: a Column can be made only once a session exists.
SESSION_MEASURES = {
    "Total Sessions": lambda: _sum("sessions"),
    "Total Users": lambda: _sum("first_seen_users"),
    "Total Orders": lambda: _sum("orders"),
    "Total Revenue": lambda: _sum("revenue_usd"),
    "Purchasing Sessions": lambda: _sum("purchasing_sessions"),
    "Conversion Rate": lambda: ratio(_sum("purchasing_sessions"), _sum("sessions")),
    "AOV": lambda: ratio(_sum("revenue_usd"), _sum("orders")),
    "Revenue per User": lambda: ratio(_sum("revenue_usd"), _sum("first_seen_users")),
    "Revenue per Session": lambda: ratio(_sum("revenue_usd"), _sum("sessions")),
    "Funnel Sessions": lambda: _reliable("sessions"),
    "Funnel Product View": lambda: _reliable("product_view_sessions"),
    "Funnel Cart": lambda: _reliable("cart_sessions"),
    "Funnel Checkout": lambda: _reliable("checkout_sessions"),
    "Funnel Payment": lambda: _reliable("payment_sessions"),
    "Funnel Purchase": lambda: _reliable("purchasing_sessions"),
    "Funnel Conversion": lambda: ratio(_reliable("purchasing_sessions"), _reliable("sessions")),
    "Cart Abandonment": lambda: ratio(_reliable("cart_abandoned_sessions"), _reliable("cart_sessions")),
    "Checkout Abandonment": lambda: ratio(_reliable("checkout_abandoned_sessions"), _reliable("checkout_sessions")),
}

PRODUCT_MEASURES = {
    "Product Revenue": lambda: _sum("revenue_usd"),
    "Product Impressions": lambda: _sum("impressions"),
    "Product Orders": lambda: _sum("order_lines"),
}

COHORT_MEASURES = {"Repeat-visit Rate": lambda: ratio(_sum("repeat_visitors"), _sum("users"))}

# The funnel measure of each stage, in stage order.
STAGE_MEASURES = (
    (1, "Funnel Sessions"),
    (2, "Funnel Product View"),
    (3, "Funnel Cart"),
    (4, "Funnel Checkout"),
    (5, "Funnel Payment"),
    (6, "Funnel Purchase"),
)


def _filtered(df: DataFrame, filters: Filters | None) -> DataFrame:
    """Keep the rows whose columns have the given value, or one of the given values."""
    for name, wanted in (filters or {}).items():
        values = list(wanted) if isinstance(wanted, (list, tuple, set)) else [wanted]
        df = df.where(F.col(name).isin(*values))
    return df


def _with_dates(facts: DataFrame, dates: DataFrame, day: str) -> DataFrame:
    attributes = dates.withColumnRenamed("date", "dim_date")
    return facts.join(attributes, F.col(day) == F.col("dim_date"), "left")


def session_measures(
    board: Dashboard, names: Sequence[str], by: Sequence[str] = (), filters: Filters | None = None
) -> DataFrame:
    """Measures over the session facts, sliced by session or date attributes."""
    rows = _filtered(_with_dates(board.sessions, board.dates, "date"), filters)
    return rows.groupBy(*by).agg(*[SESSION_MEASURES[n]().alias(n) for n in names])


def product_measures(
    board: Dashboard, names: Sequence[str], by: Sequence[str] = (), filters: Filters | None = None
) -> DataFrame:
    """Measures over the product facts, sliced by product, its attributes or date attributes."""
    rows = _with_dates(board.products_daily, board.dates, "date")
    # The product dimension is joined only for attributes that the facts do not carry.
    missing = [c for c in (*by, *(filters or {})) if c not in rows.columns]
    if missing:
        rows = rows.join(board.products.select("item_name", *dict.fromkeys(missing)), "item_name", "left")
    return _filtered(rows, filters).groupBy(*by).agg(*[PRODUCT_MEASURES[n]().alias(n) for n in names])


def repeat_visit_rate(board: Dashboard, by: Sequence[str] = (), filters: Filters | None = None) -> DataFrame:
    rows = _filtered(_with_dates(board.cohorts, board.dates, "first_visit_date"), filters)
    return rows.groupBy(*by).agg(*[make().alias(n) for n, make in COHORT_MEASURES.items()])


def return_rate(board: Dashboard, days: int, by: Sequence[str] = (), filters: Filters | None = None) -> DataFrame:
    """Return rate of new users.

    New users replace any choice of user type: a filter on it is dropped, and where
    the user type is a slicer every value shows the rate of new users.
    """
    name = f"{days}-day Return Rate"
    kept = {c: v for c, v in (filters or {}).items() if c != "user_type"}
    rows = _filtered(_with_dates(board.cohorts, board.dates, "first_visit_date"), kept)
    others = [c for c in by if c != "user_type"]
    rates = (
        rows.where(F.col("user_type") == "new")
        .groupBy(*others)
        .agg(ratio(_sum(f"returned_{days}d"), _sum(f"eligible_{days}d_users")).alias(name))
    )
    if "user_type" not in by:
        return rates
    shown = _filtered(_with_dates(board.cohorts, board.dates, "first_visit_date"), filters)
    slices = shown.select(*by).distinct()
    if not others:
        return slices.crossJoin(F.broadcast(rates)).select(*by, name)
    renamed = rates.withColumnsRenamed({c: f"of_{c}" for c in others})
    same = [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in others]
    return slices.join(renamed, same, "left").select(*by, name)


def funnel_by_stage(board: Dashboard, by: Sequence[str] = (), filters: Filters | None = None) -> DataFrame:
    """Funnel value, previous value, step conversion and drop-off of each stage, sliced by ``by``.

    The stages are not related to the facts: all their values come from one
    aggregate, whose columns are laid out as rows and matched to the stage list by order.
    """
    values = session_measures(board, [m for _, m in STAGE_MEASURES], by, filters)

    def stage(i: int) -> Column:
        order, name = STAGE_MEASURES[i]
        before = F.col(STAGE_MEASURES[i - 1][1]) if i else F.lit(None).cast("bigint")
        return F.struct(
            F.lit(order).alias("stage_order"),
            F.col(name).alias("Funnel Value"),
            before.alias("Funnel Previous"),
        )

    rows = values.select(*by, F.inline(F.array(*[stage(i) for i in range(len(STAGE_MEASURES))])))
    conversion = ratio("Funnel Value", "Funnel Previous")
    return rows.join(board.stages, "stage_order").select(
        *by,
        "stage_order",
        "stage",
        "Funnel Value",
        "Funnel Previous",
        conversion.alias("Step Conversion"),
        (F.lit(1.0) - conversion).alias("Step Drop-off"),
    )


_BY_STAGE = ("Funnel Value", "Funnel Previous", "Step Conversion", "Step Drop-off")
_RETURN_RATE = "-day Return Rate"


def measure(board: Dashboard, name: str, by: Sequence[str] = (), filters: Filters | None = None) -> DataFrame:
    """One measure by its name; those of the funnel stages have a row per stage."""
    if name in SESSION_MEASURES:
        return session_measures(board, [name], by, filters)
    if name in PRODUCT_MEASURES:
        return product_measures(board, [name], by, filters)
    if name in COHORT_MEASURES:
        return repeat_visit_rate(board, by, filters).select(*by, name)
    if name in _BY_STAGE:
        return funnel_by_stage(board, by, filters).select(*by, "stage_order", "stage", name)
    if name.endswith(_RETURN_RATE):
        return return_rate(board, int(name.removesuffix(_RETURN_RATE)), by, filters)
    raise KeyError(f"no measure is named {name!r}")

