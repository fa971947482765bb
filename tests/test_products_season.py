"""Products, periods and facts on hand-made events."""

from __future__ import annotations

from dataclasses import replace
from datetime import date

from pyspark.sql import functions as F

from clickloom.config import AnalyticsConfig, SeasonPeriod
from clickloom.operators import facts, product, season
from clickloom.plans.workspace import Workspace
from tests.conftest import event, rows_of

CFG = AnalyticsConfig()


def shown(user, when, *names):
    return event(user, when, "view_item", items=[{"name": n} for n in names])


def test_product_groups_first_rule_wins(spark):
    expected = {
        "Gift Cards for all": "Gift cards",  # the first rule needs only the start of a word
        "Blue Water Bottle Bag": "Drinkware and kitchen",
        "Bucket Hat": "Headwear",
        "Flap Pack Green": "Bags",
        "Campus T-Shirt": "Apparel",
        "Capital letters": "Other",  # CAP must be a whole word
        "usb stick": "Tech and accessories",
        "Sticker Sheet": "Stationery and office",
        "Chess Set": "Fun and gifts",
        "": "Other",
    }
    df = spark.createDataFrame([(n,) for n in expected], "name string")
    got = df.select("name", product.product_group("name", CFG).alias("g")).collect()
    assert {r.name: r.g for r in got} == expected


def test_impressions_are_distinct_by_canonical_name(spark, raw):
    aliases = product.item_aliases(spark, replace(CFG, item_aliases=(("Old Tee", "New Tee"),)))
    events = raw(
        shown("a", "2020-11-30T10:00", "Old Tee", "New Tee", "Mug", "Mug", "(not set)", "", None),
        shown("a", "2020-11-30T10:00", "Mug"),  # the same user and time
        shown("b", "2020-11-30T10:00", "Mug &quot;L&quot;"),
        event("b", "2020-11-30T11:00", "view_item", items=None),
        event("b", "2020-11-30T12:00", "view_item", items=[]),
        event("b", "2020-11-30T12:00", "page_view", items=[{"name": "Mug"}]),
    )
    got = product.item_impressions(events, aliases, CFG)
    assert rows_of(got, "user_pseudo_id", "item_name") == [("a", "Mug"), ("a", "New Tee"), ("b", 'Mug "L"')]


def activity(spark, raw, cfg):
    events = raw(
        *[shown(f"u{i}", f"2020-12-01T10:{i:02d}", "Mug", "Cap") for i in range(10)],
        shown("early", "2020-11-02T10:00", "Mug"),
        event("u1", "2020-12-01T11:00", "add_to_cart", items=[{"name": "Mug", "quantity": 2}, {"name": "Cap"}]),
        event(
            "u1",
            "2020-12-01T12:00",
            "purchase",
            transaction_id="T1",
            revenue=20.0,
            items=[{"name": "Mug", "quantity": 2, "revenue": 14.0}, {"name": "Pen", "quantity": 3, "revenue": 6.0}],
        ),
        event(
            "u1",
            "2020-12-01T12:01",
            "purchase",
            transaction_id="T1",
            revenue=20.0,
            items=[{"name": "Mug", "quantity": 2, "revenue": 14.0}],
        ),
    )
    return Workspace(spark, events, cfg)


def test_products_join_views_carts_and_orders(spark, raw):
    ws = activity(spark, raw, replace(CFG, impression_floor=5))
    got = {r.item_name: r for r in ws.products.collect()}
    assert set(got) == {"Mug", "Cap", "Pen"}
    mug = got["Mug"]
    assert (mug.impressions, mug.impression_users, mug.impressions_cart_window) == (11, 11, 10)
    assert (mug.cart_adds, mug.cart_users, mug.order_lines, mug.buyers, mug.units) == (1, 1, 1, 1, 2)
    assert (mug.revenue_usd, mug.avg_unit_price, mug.view_to_cart_pct) == (14.0, 7.0, 10.0)
    assert mug.quadrant == "Strong products"
    assert got["Cap"].quadrant == "Weak products"
    assert (got["Cap"].median_impressions, got["Pen"].quadrant, got["Pen"].meets_view_floor) == (10.5, None, False)
    assert got["Pen"].view_to_purchase_pct is None  # no impressions to divide by


def test_products_are_kept_when_none_meets_the_floor(spark, raw):
    rows = activity(spark, raw, CFG).products.collect()
    assert len(rows) == 3
    assert {(r.quadrant, r.median_impressions, r.meets_view_floor) for r in rows} == {(None, None, False)}


def test_daily_products_add_up_to_products(spark, raw):
    ws = activity(spark, raw, replace(CFG, impression_floor=5))
    daily = ws.fact_product_daily
    sums = daily.groupBy("item_name").agg(F.sum("impressions"), F.sum("order_lines"), F.sum("revenue_usd"))
    assert rows_of(sums, *sums.columns) == rows_of(
        ws.products, "item_name", "impressions", "order_lines", "revenue_usd"
    )
    assert {r.quadrant for r in daily.where("item_name = 'Pen'").collect()} == {"Below 5 impressions"}


PERIODS = (
    SeasonPeriod(1, "base", date(2020, 11, 1), date(2020, 11, 2), True),
    SeasonPeriod(2, "all", date(2020, 11, 2), date(2020, 11, 10), True),  # overlaps the first
    SeasonPeriod(9, "quiet", date(2020, 11, 20), date(2020, 11, 21), False),
    SeasonPeriod(10, "empty", date(2020, 12, 1), date(2020, 12, 2), False),
)


def test_periods(spark, raw):
    cfg = replace(CFG, season_periods=PERIODS, first_date=date(2020, 11, 1), last_date=date(2020, 11, 21))
    events = raw(
        event("a", "2020-11-01T10:00", "page_view", session=1),
        event("a", "2020-11-02T10:00", "view_item", session=2, number=2),
        event("b", "2020-11-02T10:00", "purchase", session=1, transaction_id="T", revenue=9.0),
        event("b", "2020-11-15T10:00", "page_view", session=2, number=2),  # in no period
        event("b", "2020-11-20T10:00", "page_view", session=3, number=3),
    )
    ws = Workspace(spark, events, cfg)
    summary = season.period_summary(ws.sessions, ws.users, ws.periods, cfg).orderBy("period_order").collect()
    # Nobody was seen for the first time in the quiet period, and nobody at all in the last.
    assert [r.period for r in summary] == ["base", "all", "quiet", "empty"]
    assert (summary[2].sessions, summary[2].users, summary[2].pct_users_new_in_period) == (1, 1, 0.0)
    assert (summary[3].sessions, summary[3].revenue_usd, summary[3].aov, summary[3].avg_daily_users) == (0, 0.0, None, None)
    assert (summary[0].sessions, summary[0].users, summary[0].buyers, summary[0].days) == (3, 2, 1, 2)
    assert (summary[1].sessions, summary[1].users, summary[1].orders) == (2, 2, 1)
    assert summary[1].orders_per_day_vs_baseline_pct == -77.8
    mix = season.period_channel_mix(ws.sessions, ws.periods)
    assert rows_of(mix, "period_order", "sessions", "pct_of_period_sessions") == [(1, 3, 100.0), (2, 2, 100.0)]
    dates = facts.dim_date(spark, ws.periods, cfg)
    assert dates.count() == 2 + 9 + 9 + 2  # a date in two periods appears in both
    assert dates.where("period is null").count() == 9  # and a date in none is kept
    weekly = {r.week_start: r for r in season.weekly_trend(ws.sessions, cfg).collect()}
    assert weekly[date(2020, 10, 26)].days_in_data == 1
    assert (weekly[date(2020, 11, 2)].days_in_data, weekly[date(2020, 11, 2)].users) == (1, 2)


def test_small_countries_share_a_label_derived_before_grouping(spark, raw):
    cfg = replace(CFG, country_min_users=2)
    events = raw(
        event("a", "2020-11-01T10:00", "page_view", country="Chile"),
        event("b", "2020-11-01T10:00", "page_view", country="Chile"),
        event("b", "2020-11-01T12:00", "page_view", session=2, number=2, country="Peru"),
        event("c", "2020-11-01T10:00", "page_view", country="Cuba"),
        event("d", "2020-11-01T10:00", "page_view", country=None),
    )
    ws = Workspace(spark, events, cfg)
    got = rows_of(ws.fact_sessions, "country", "sessions", "first_seen_users")
    assert got == [("Chile", 2, 2), ("Other (under 2 users)", 3, 2)]


def test_dim_date_calendar(spark):
    got = {r.date: r for r in facts.dim_date(spark, season.season_periods(spark, CFG), CFG).collect()}
    assert len(got) == 92
    first = got[date(2020, 11, 1)]
    assert (first.day_of_week, first.week_start, first.month_label) == ("Sunday", date(2020, 10, 26), "Nov 2020")
    assert (first.month_start, first.period) == (date(2020, 11, 1), "Early November (baseline)")
    assert (first.add_to_cart_reliable, got[date(2020, 11, 26)].add_to_cart_reliable) == (False, True)
    assert (got[date(2021, 1, 25)].purchase_data_reliable, got[date(2021, 1, 26)].purchase_data_reliable) == (
        True,
        False,
    )
