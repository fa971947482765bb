"""Explicit schemas: nothing is inferred on read."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import types as T

EVENT_PARAM = T.StructType(
    [
        T.StructField("key", T.StringType()),
        T.StructField(
            "value",
            T.StructType([T.StructField("string_value", T.StringType()), T.StructField("int_value", T.LongType())]),
        ),
    ]
)

ITEM = T.StructType(
    [
        T.StructField("item_id", T.StringType()),
        T.StructField("item_name", T.StringType()),
        T.StructField("quantity", T.LongType()),
        T.StructField("item_revenue_in_usd", T.DoubleType()),
    ]
)

RAW_EVENTS = T.StructType(
    [
        T.StructField("event_date", T.StringType()),
        T.StructField("event_timestamp", T.LongType()),
        T.StructField("event_name", T.StringType()),
        T.StructField("user_pseudo_id", T.StringType()),
        T.StructField("user_id", T.StringType()),
        T.StructField("event_params", T.ArrayType(EVENT_PARAM)),
        T.StructField(
            "device",
            T.StructType(
                [
                    T.StructField("category", T.StringType()),
                    T.StructField("operating_system", T.StringType()),
                    T.StructField("language", T.StringType()),
                    T.StructField("web_info", T.StructType([T.StructField("browser", T.StringType())])),
                ]
            ),
        ),
        T.StructField(
            "geo",
            T.StructType(
                [
                    T.StructField("country", T.StringType()),
                    T.StructField("region", T.StringType()),
                    T.StructField("city", T.StringType()),
                ]
            ),
        ),
        T.StructField(
            "traffic_source",
            T.StructType(
                [
                    T.StructField("source", T.StringType()),
                    T.StructField("medium", T.StringType()),
                    T.StructField("name", T.StringType()),
                ]
            ),
        ),
        T.StructField(
            "ecommerce",
            T.StructType(
                [
                    T.StructField("transaction_id", T.StringType()),
                    T.StructField("purchase_revenue_in_usd", T.DoubleType()),
                ]
            ),
        ),
        T.StructField("items", T.ArrayType(ITEM)),
    ]
)

SEASON_PERIODS = T.StructType(
    [
        T.StructField("period_order", T.IntegerType()),
        T.StructField("period", T.StringType()),
        T.StructField("start_date", T.DateType()),
        T.StructField("end_date", T.DateType()),
        T.StructField("is_comparison", T.BooleanType()),
    ]
)

ITEM_ALIASES = T.StructType([T.StructField("raw", T.StringType()), T.StructField("canonical", T.StringType())])

FUNNEL_STAGES = T.StructType([T.StructField("stage_order", T.IntegerType()), T.StructField("stage", T.StringType())])


def _columns(**types: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, dtype) for name, dtype in types.items()])


_STR, _LONG, _DBL, _DATE, _BOOL = T.StringType(), T.LongType(), T.DoubleType(), T.DateType(), T.BooleanType()

# Declared types of the dashboard tables once they have been exported as CSV.
DASHBOARD_CSV = {
    "dim_date": _columns(
        date=_DATE,
        day_of_week=_STR,
        week_start=_DATE,
        month_label=_STR,
        month_start=_DATE,
        period=_STR,
        add_to_cart_reliable=_BOOL,
        purchase_data_reliable=_BOOL,
    ),
    "fact_sessions": _columns(
        date=_DATE,
        acq_channel=_STR,
        device_category=_STR,
        country=_STR,
        user_type=_STR,
        sessions=_LONG,
        first_seen_users=_LONG,
        product_view_sessions=_LONG,
        cart_sessions=_LONG,
        cart_abandoned_sessions=_LONG,
        checkout_sessions=_LONG,
        checkout_abandoned_sessions=_LONG,
        payment_sessions=_LONG,
        purchasing_sessions=_LONG,
        orders=_LONG,
        revenue_usd=_DBL,
    ),
    "fact_product_daily": _columns(
        date=_DATE,
        item_name=_STR,
        product_group=_STR,
        quadrant=_STR,
        impressions=_LONG,
        cart_adds=_LONG,
        order_lines=_LONG,
        units=_LONG,
        revenue_usd=_DBL,
    ),
    "funnel_stages": _columns(stage_order=T.IntegerType(), stage=_STR),
    "products_export": _columns(
        item_name=_STR,
        product_group=_STR,
        impressions=_LONG,
        impression_users=_LONG,
        impressions_cart_window=_LONG,
        cart_adds=_LONG,
        cart_users=_LONG,
        order_lines=_LONG,
        order_lines_cart_window=_LONG,
        buyers=_LONG,
        units=_LONG,
        revenue_usd=_DBL,
        avg_unit_price=_DBL,
        view_to_cart_pct=_DBL,
        cart_to_purchase_pct=_DBL,
        view_to_purchase_pct=_DBL,
        revenue_per_view=_DBL,
        meets_view_floor=_BOOL,
        quadrant=_STR,
        median_impressions=_DBL,
        median_view_to_purchase_pct=_DBL,
    ),
}


def cohort_csv(return_windows: Sequence[int] = (7, 30)) -> T.StructType:
    """Declared types of the cohort facts, whose columns depend on the return windows."""
    follow_up = {}
    for days in return_windows:
        follow_up |= {f"eligible_{days}d_users": _LONG, f"returned_{days}d": _LONG}
    return _columns(
        first_visit_date=_DATE,
        user_type=_STR,
        users=_LONG,
        repeat_visitors=_LONG,
        **follow_up,
        buyers=_LONG,
        revenue_usd=_DBL,
    )


DASHBOARD_CSV["fact_cohort_daily"] = cohort_csv()
