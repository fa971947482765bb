"""Every registered query against its check SQL, and invariants between results."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from checks import queries as registered
from checks.compare import compare, connection
from clickloom.operators import funnel, season, users
from tests.conftest import one

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = registered.queries(), registered.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connection(SF)


def test_every_query_has_its_check():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_its_check(spark, duck, name):
    # At the smallest scale some floors leave a report empty on both sides.
    assert compare(spark, duck, SF, QUERIES[name], SQL[name]) in (None, "no rows")


@pytest.fixture(params=["clicks", "history", "items"])
def ws(request, spark):
    return registered.workspace(spark, SF, request.param)


def total(df, *names):
    return tuple(one(df.agg(*[F.sum(F.col(n).cast("decimal(28,4)")).alias(n) for n in names])).values())


def test_purchases_are_orders_repeats_or_excluded(ws):
    purchases = ws.events.where("event_name = 'purchase'")
    anonymous = F.coalesce("transaction_id", F.lit("(not set)")) == "(not set)"
    kept = purchases.where(~anonymous).select("transaction_id").distinct().count()
    kept += purchases.where(anonymous & (F.col("purchase_revenue_usd") > 0)).count()
    from clickloom.operators.sessions import clean_orders

    assert clean_orders(ws.events, ws.cfg).count() == kept


def test_sums_agree_across_tables(ws):
    sessions = total(ws.sessions, "orders", "revenue_usd")
    assert total(ws.users, "orders", "revenue_usd") == sessions
    assert total(ws.users, "sessions")[0] == ws.sessions.count()
    assert total(ws.fact_sessions, "sessions", "first_seen_users") == (ws.sessions.count(), ws.users.count())
    assert total(ws.fact_sessions, "orders")[0] == sessions[0]
    assert total(ws.fact_cohort_daily, "users")[0] == ws.users.count()


def test_page_views_survive(ws):
    in_events = ws.events.where("event_name = 'page_view'").count()
    assert (total(ws.sessions, "page_views")[0] or 0) == in_events


def test_returns_and_eligibility_are_nested(ws):
    short, long = ws.cfg.return_windows
    back, able = users.returned_flag, users.eligible_flag
    assert ws.users.where(F.col(back(short)) & ~F.col(back(long))).count() == 0
    assert ws.users.where(F.col(able(long)) & ~F.col(able(short))).count() == 0


def test_strict_funnel_is_within_the_open_one(ws):
    strict = one(funnel.funnel_strict(ws.cart_users))
    open_counts = one(ws.cart_users.agg(*funnel.main_step_counts()))
    assert all(strict[step] <= open_counts[step] for step in funnel.MAIN_FLAGS)


def test_daily_and_weekly_totals_agree(ws):
    daily = total(season.daily_trend(ws.sessions, ws.users, ws.cfg), "sessions", "orders", "new_users")
    assert daily[:2] == total(season.weekly_trend(ws.sessions, ws.cfg), "sessions", "orders")
    assert daily[2] == ws.users.where("user_type = 'new'").count()


def test_total_row_is_the_sum_of_the_channels(ws):
    from clickloom.operators.channel import channel_performance

    rows = channel_performance(ws.users, ws.cfg).collect()
    (total_row,) = [r for r in rows if r.acq_channel == "All users"]
    others = [r for r in rows if r.acq_channel != "All users"]
    for name in ("users", "sessions", "purchasers", "orders"):
        assert sum(r[name] for r in others) == total_row[name]
    assert abs(sum(r.pct_of_users for r in others) - 100) < 0.1
