"""Tables kept day by day against tables built at once."""

from __future__ import annotations

import random
from datetime import UTC, date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from clickloom.config import AnalyticsConfig
from clickloom.operators import quality, sessions, userdays, users
from clickloom.plans.daily import DailyTables
from tests.conftest import event

CFG = AnalyticsConfig()
FIRST = date(2020, 11, 1)


def random_day(rng: random.Random, day: date, n: int) -> list[tuple]:
    start = datetime(day.year, day.month, day.day, tzinfo=UTC)
    rows = []
    for _ in range(n):
        name = rng.choice(["page_view", "view_item", "add_to_cart", "purchase", "purchase"])
        buys = {"transaction_id": rng.choice([None, "(not set)", *[f"T{i}" for i in range(9)]]), "revenue": rng.choice([None, 0.0, 5.25])}
        rows.append(
            event(
                f"u{rng.randint(0, 9)}", (start + timedelta(seconds=rng.randrange(86400))).replace(tzinfo=None).isoformat(), name,
                rng.choice([None, 1, 2, 3]), rng.choice([None, 1, 2]), device=rng.choice([None, "desktop", "mobile"]),
                country=rng.choice([None, "Chile", "Peru"]), medium=rng.choice([None, "organic", "<Other>", "cpc"]),
                **(buys if name == "purchase" else {}),
            )
        )
    return rows


def same(got, want):
    assert sorted(got.select(want.columns).collect(), key=str) == sorted(want.collect(), key=str)


def check(tables: DailyTables, raw) -> None:
    events = sessions.clean_events(raw)
    built = sessions.build_sessions(events, CFG)
    same(tables.read("events_clean"), events)
    same(tables.read("event_profile"), quality.event_profile(events, CFG))
    same(tables.read("orders"), sessions.clean_orders(events, CFG))
    same(tables.read("sessions"), built)
    same(tables.read("user_days"), userdays.build_user_days(built))
    same(tables.workspace(raw).users, users.build_users(built, CFG))


def test_instalments_give_what_one_build_gives(raw, spark, tmp_path):
    """Days in three instalments, one of them late; then a day delivered again, and one that loses all its events."""
    rng = random.Random(1)
    days = {FIRST + timedelta(days=k): random_day(rng, FIRST + timedelta(days=k), 25) for k in range(5)}
    late = FIRST + timedelta(days=1)
    order = [[FIRST, FIRST + timedelta(days=2)], [FIRST + timedelta(days=3), FIRST + timedelta(days=4)], [late]]
    tables, come = DailyTables(spark, str(tmp_path), CFG), []
    for instalment in order:
        come += instalment
        so_far = raw(*[e for d in come for e in days[d]])
        tables.ingest(so_far, instalment)
    check(tables, so_far)
    again = FIRST + timedelta(days=3)
    days[again], days[late] = random_day(rng, again, 12), []
    so_far = raw(*[e for d in come for e in days[d]])
    tables.ingest(so_far, [again, late])
    check(tables, so_far)


def test_a_new_day_writes_only_what_differs(raw, spark, tmp_path):
    old = [event("a", "2020-11-01T10:00", "purchase", transaction_id="T", revenue=1.0), event("b", "2020-11-01T10:00", "page_view")]
    new = [event("a", "2020-11-02T10:00", "purchase", session=2, transaction_id="T", revenue=1.0)]
    tables = DailyTables(spark, str(tmp_path), CFG)
    assert tables.ingest(raw(*old), [FIRST]) == [FIRST]
    stamp = {p: p.stat().st_mtime_ns for p in tmp_path.glob("*/*=2020-11-01/*.parquet")}
    assert tables.ingest(raw(*old, *new), [FIRST + timedelta(days=1)]) == [FIRST + timedelta(days=1)]
    kept = {p for p in stamp if p.parent.parent.name != "orders"}
    assert kept and all(p.exists() and p.stat().st_mtime_ns == stamp[p] for p in kept)
    assert not list(tmp_path.glob("_staged")) and not list(tmp_path.glob("_pending"))
    assert tables.read("orders").count() == 1  # the repeated purchase is no order


def test_a_run_that_broke_off_can_be_run_again(raw, spark, tmp_path, monkeypatch):
    rng = random.Random(7)
    one, two = random_day(rng, FIRST, 20), random_day(rng, FIRST, 20)
    tables = DailyTables(spark, str(tmp_path), CFG)
    tables.ingest(raw(*one), [FIRST])
    with monkeypatch.context() as m:
        m.setattr(DailyTables, "_update_orders", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError, match="lost"):
            tables.ingest(raw(*two), [FIRST])
    tables.ingest(raw(*two), [FIRST])
    check(tables, raw(*two))


def test_no_days_and_days_without_events(raw, spark, tmp_path):
    tables = DailyTables(spark, str(tmp_path), CFG)
    assert tables.ingest(raw(), []) == []
    tables.ingest(raw(event("a", "2020-11-01T10:00", "page_view")), [FIRST])
    assert tables.ingest(raw(event("a", "2020-11-01T10:00", "page_view")), [date(2020, 11, 9)]) == []
    assert tables.read("sessions").agg(F.count("*")).first()[0] == 1


def test_an_instalment_writes_its_parts_aside_once(raw, spark, tmp_path, monkeypatch):
    aside, staged = [], DailyTables._staged
    monkeypatch.setattr(DailyTables, "_staged", lambda self, name, rows: aside.append(name) or staged(self, name, rows))
    tables = DailyTables(spark, str(tmp_path), CFG)
    days = [date(2020, 11, 1)]
    events = raw(event("u", "2020-11-01T10:00", "purchase", transaction_id="a", revenue=1.0))
    assert tables.ingest(events, days) == days
    assert tables.ingest(events, days) == []  # the same again: no session differs
    for name in ("events_clean", "event_profile", "session_parts", "touch_parts", "order_parts"):
        assert aside.count(name) == 2
