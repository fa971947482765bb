"""Orders, first touch, sessions and users on hand-made events."""

from __future__ import annotations

from dataclasses import replace
from datetime import date

import pytest

from clickloom.config import AnalyticsConfig
from clickloom.operators import quality, sessions, users
from tests.conftest import event, one, rows_of

CFG = AnalyticsConfig()


def buy(user, when, tx=None, revenue=None, **kw):
    return event(user, when, "purchase", transaction_id=tx, revenue=revenue, **kw)


def test_order_rule(raw):
    events = sessions.clean_events(
        raw(
            buy("a", "2020-11-01T10:00", "T1", 10.0),
            buy("a", "2020-11-01T11:00", "T1", 99.0),  # repeat, later
            buy("b", "2020-11-01T09:00", "T1", 7.0),  # the same id of another user, earlier
            buy("c", "2020-11-02T09:00", "T2", 0.0),  # a real id counts without revenue
            buy("c", "2020-11-02T09:30", "T3", None),
            buy("d", "2020-11-03T09:00", None, 5.0),
            buy("d", "2020-11-03T09:00", None, 5.0),  # id-less purchases are not compared
            buy("d", "2020-11-03T09:05", "(not set)", 6.0),
            buy("d", "2020-11-03T09:06", "(not set)", 0.0),
            buy("d", "2020-11-03T09:07", None, None),
            event("e", "2020-11-03T09:07", "view_item"),
        )
    )
    got = rows_of(sessions.clean_orders(events, CFG), "transaction_id", "user_pseudo_id", "purchase_revenue_usd")
    assert got == sorted(
        [
            ("T1", "b", 7.0),
            ("T2", "c", 0.0),
            ("T3", "c", None),
            (None, "d", 5.0),
            (None, "d", 5.0),
            ("(not set)", "d", 6.0),
        ],
        key=str,
    )
    # Every raw purchase is an order, a repeated id, or an excluded id-less event.
    raw_purchases = events.where("event_name = 'purchase'").count()
    assert raw_purchases == len(got) + 2 + 2


def test_equal_times_are_settled_by_user(raw):
    rows = [buy("z", "2020-11-01T10:00", "T", 1.0), buy("y", "2020-11-01T10:00", "T", 2.0)]
    for order in (rows, rows[::-1]):
        orders = sessions.clean_orders(sessions.clean_events(raw(*order)), CFG)
        assert one(orders.select("user_pseudo_id")) == {"user_pseudo_id": "y"}


def test_first_touch_prefers_named_mediums(raw):
    events = sessions.clean_events(
        raw(
            event("a", "2020-11-01T10:00", "page_view", medium="<Other>", source="x"),
            event("a", "2020-11-01T11:00", "page_view", medium="cpc", source="y"),
            event("a", "2020-11-01T12:00", "page_view", medium="organic", source="z"),
            event("b", "2020-11-01T10:00", "page_view", medium="(data deleted)", source="p"),
            event("b", "2020-11-01T11:00", "page_view", medium="<Other>", source="q"),
            event("c", "2020-11-01T10:00", "page_view", medium=None, source="r"),
            # An obscured source does not matter, only the medium does.
            event("d", "2020-11-01T10:00", "page_view", medium="referral", source="<Other>"),
        )
    )
    touch = sessions.first_touch(events, CFG)
    labelled = touch.withColumn("channel", sessions.channel_label(CFG))
    assert rows_of(labelled, "user_pseudo_id", "acq_medium", "acq_source", "channel") == [
        ("a", "cpc", "y", "Paid (cpc)"),
        ("b", "(data deleted)", "p", "Data deleted"),
        ("c", None, "r", "Other (obscured)"),
        ("d", "referral", "<Other>", "Referral"),
    ]


@pytest.fixture(scope="module")
def night(raw):
    """A session across midnight, one without an id, and one that buys."""
    return raw(
        event("a", "2020-11-01T23:50", "session_start", session=1, device=None, country="Chile"),
        event("a", "2020-11-01T23:55", "page_view", session=1, device="mobile", country=None),
        event("a", "2020-11-02T00:10", "add_to_cart", session=1, device="desktop", country="Peru"),
        event("a", "2020-11-02T00:20", "view_item", session=None, number=None),
        buy("a", "2020-11-02T00:30", "T1", 3.0, session=None, number=None),
        event("b", "2020-11-05T08:00", "page_view", session=1, number=2),
        buy("b", "2020-11-05T08:05", "T2", 4.0, session=1, number=2),
        buy("b", "2020-11-05T08:06", "T4", 2.5, session=1, number=2),
    )


def test_sessions(night):
    built = sessions.build_sessions(sessions.clean_events(night), CFG)
    got = {(r.user_pseudo_id, r.ga_session_id): r for r in built.collect()}
    assert set(got) == {("a", 1), ("a", None), ("b", 1)}
    first = got["a", 1]
    assert first.session_date == date(2020, 11, 1)  # the date on which it began
    assert (first.device_category, first.country) == ("mobile", "Chile")  # earliest known values
    assert (first.events, first.page_views, first.has_session_start_event) == (3, 1, True)
    assert (first.reached_add_to_cart, first.reached_view_item) == (True, False)
    assert (got["b", 1].orders, got["b", 1].revenue_usd, got["b", 1].purchase_events) == (2, 6.5, 2)
    # An order without a session id matches no session.
    assert (got["a", None].orders, got["a", None].purchased, got["a", None].revenue_usd) == (0, False, 0.0)


def test_null_safe_sessions_keep_orders_without_session_id(night):
    cfg = replace(CFG, null_safe_sessions=True)
    built = sessions.build_sessions(sessions.clean_events(night), cfg)
    got = {(r.user_pseudo_id, r.ga_session_id): r.revenue_usd for r in built.collect()}
    assert got == {("a", 1): 0.0, ("a", None): 3.0, ("b", 1): 6.5}


def test_sessions_check(night):
    events = sessions.clean_events(night)
    got = one(sessions.check_sessions(events, sessions.build_sessions(events, CFG)))
    assert got == {
        "events_clean_rows": 8,
        "sessions": 3,
        "distinct_sessions": 2,
        "users": 2,
        "page_views_in_events": 2,
        "page_views_in_sessions": 2,
        "raw_purchase_events": 3,
        "orders": 2,
        "purchasing_sessions": 1,
        "revenue_usd": 6.5,
    }


def test_users_returns_and_eligibility(raw):
    events = raw(
        event("new", "2020-11-01T10:00", "page_view", session=1, number=1),
        event("new", "2020-11-01T18:00", "page_view", session=2, number=2),  # the same day: no return
        event("week", "2020-11-01T10:00", "page_view", session=1, number=1),
        event("week", "2020-11-08T10:00", "page_view", session=2, number=2),  # day 7
        event("month", "2020-11-01T10:00", "page_view", session=1, number=1),
        event("month", "2020-12-01T10:00", "page_view", session=2, number=2),  # day 30
        event("old", "2020-11-01T10:00", "page_view", session=1, number=4),
        event("late", "2020-12-01T10:00", "page_view", session=1, number=1),
        # Opened out of order: session 2 starts before session 1.
        event("tabs", "2020-11-02T10:00", "page_view", session=2, number=2, device="tablet"),
        event("tabs", "2020-11-02T10:05", "page_view", session=1, number=1, device="mobile"),
        # Equal start times: the lower session id is first.
        event("tie", "2020-11-03T10:00", "page_view", session=9, number=1, device="mobile"),
        event("tie", "2020-11-03T10:00", "page_view", session=3, number=2, device="tablet"),
    )
    built = users.build_users(sessions.build_sessions(sessions.clean_events(events), CFG), CFG)
    got = {r.user_pseudo_id: r for r in built.collect()}
    flags = {
        name: (r.returned_within_7d, r.returned_within_30d, r.eligible_7d, r.eligible_30d, r.repeat_visitor)
        for name, r in got.items()
    }
    assert flags["new"] == (False, False, True, True, True)
    assert flags["week"] == (True, True, True, True, True)
    assert flags["month"] == (False, True, True, True, True)
    assert flags["old"] == (False, False, True, True, False)
    assert flags["late"] == (False, False, False, False, False)
    assert (got["old"].user_type, got["tabs"].user_type) == ("returning", "new")
    assert (got["tabs"].first_device_category, got["tie"].first_device_category) == ("tablet", "tablet")
    assert got["new"].active_days == 1
    assert got["week"].active_days == 2


def test_obscured_values_keep_the_five_states_apart(raw):
    rows = [
        event("a", "2020-11-01T10:00", "page_view", country=c, page="/x")
        for c in (None, "", "(data deleted)", "<Other>", "(not set)", "Chile", "Chile", "Chile")
    ]
    got = {r.column_name: r for r in quality.dq_obscured_values(raw(*rows)).collect()}
    assert len(got) == 14
    c = got["country"]
    assert (c.rows_checked, c.null_rows, c.empty_rows, c.data_deleted_rows, c.other_rows, c.not_set_rows) == (
        8, 1, 1, 1, 1, 1,
    )
    assert c.unusable_pct == 62.5
    assert (got["user_id"].null_pct, got["page_location"].unusable_pct) == (100.0, 0.0)


def test_overview_counts_only_identified_sessions(raw):
    got = one(
        quality.dq_overview(
            raw(
                event("a", "2020-11-01T10:00", "page_view", session=1),
                event("a", "2020-11-03T10:00", "page_view", session=None),
                event(None, "2020-11-03T10:00", "page_view", session=5),
                event("b", "2020-11-03T10:00", "page_view", session=1),
            )
        )
    )
    assert got == {
        "total_events": 4,
        "daily_tables": 2,
        "first_date": date(2020, 11, 1),
        "last_date": date(2020, 11, 3),
        "users": 2,
        "sessions_with_id": 2,
    }
