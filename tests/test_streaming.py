"""Streams of event files against batch results."""

from __future__ import annotations

from datetime import date

from clickloom.config import AnalyticsConfig
from clickloom.operators import sessions
from clickloom.plans.daily import DailyTables
from clickloom.sources.events import read_events
from clickloom.streaming.daily import follow_days, follow_orders
from tests.conftest import event

CFG = AnalyticsConfig()


def add(df, path):
    df.write.mode("append").partitionBy("event_date").parquet(path)


def test_daily_tables_follow_files_and_late_files(raw, spark, tmp_path):
    path, check = str(tmp_path / "raw"), str(tmp_path / "check")
    tables = DailyTables(spark, str(tmp_path / "tables"), CFG)
    first = [
        event("a", "2020-11-01T10:00", "page_view", medium="<Other>"),
        event("a", "2020-11-03T10:00", "purchase", session=2, transaction_id="T", revenue=5.0),
    ]
    late = [  # an earlier purchase of the same order, an earlier touch, and more of a session that is there
        event("a", "2020-11-02T10:00", "purchase", session=3, transaction_id="T", revenue=5.0, medium="cpc"),
        event("a", "2020-11-01T09:00", "view_item", medium="organic"),
    ]
    for rows in (first, late):
        add(raw(*rows), path)
        query = follow_days(spark, path, tables, check)
        query.awaitTermination()
        events = sessions.clean_events(read_events(spark, path))
        want = sessions.build_sessions(events, CFG)
        got = tables.read("sessions").select(want.columns)
        assert sorted(got.collect(), key=str) == sorted(want.collect(), key=str)
    assert {r["session_date"]: r["orders"] for r in got.collect()} == {date(2020, 11, 1): 0, date(2020, 11, 2): 1, date(2020, 11, 3): 0}
    before = tables.read("sessions").count()
    follow_days(spark, path, tables, check).awaitTermination()  # no new files, nothing to do
    assert tables.read("sessions").count() == before


def test_orders_are_told_from_repeats_across_batches(raw, spark, tmp_path):
    path, out, check = (str(tmp_path / name) for name in ("raw", "out", "check"))
    batches = [
        [event("a", "2020-11-01T10:00", "purchase", transaction_id="T", revenue=5.0), event("b", "2020-11-01T10:00", "purchase", revenue=2.0)],
        [
            event("a", "2020-11-02T10:00", "purchase", transaction_id="T", revenue=5.0),
            event("c", "2020-11-02T10:00", "purchase", transaction_id="U", revenue=1.0),
            event("c", "2020-11-02T10:00", "purchase", transaction_id="(not set)", revenue=0.0),
            event("c", "2020-11-02T11:00", "purchase", transaction_id="(not set)", revenue=4.0),
            event("c", "2020-11-02T11:00", "purchase", transaction_id="(not set)", revenue=4.0),
        ],
    ]
    for rows in batches:
        add(raw(*rows), path)
        follow_orders(spark, path, out, CFG, check).awaitTermination()
    got = spark.read.parquet(out)
    want = sessions.clean_orders(sessions.clean_events(read_events(spark, path)), CFG).select(got.columns)
    assert sorted(got.collect(), key=str) == sorted(want.collect(), key=str)
