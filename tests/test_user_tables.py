"""User-days, active-day bitmaps, visit numbers, the event profile, and what keeping tables by user or day saves."""

from __future__ import annotations

import random
import re
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from checks import queries as registered
from clickloom.functions.ranks import prefix_ranks
from clickloom.operators import funnel, inference, quality, sessions, userdays, users, visits
from clickloom.plans.workspace import Workspace
from clickloom.sources.sample import CLICKSTREAM, clickstream
from clickloom.sources.tables import TableStore
from tests.test_sources_plans import plan

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def ws(spark, tmp_path_factory):
    """The clickstream with every table stored, events and sessions by day."""
    store = TableStore(spark, str(tmp_path_factory.mktemp("tables")), buckets=4)
    return Workspace(spark, store.build("raw", clickstream(spark, SF), "event_date"), CLICKSTREAM, store, by_date=True)


def executed(df) -> str:
    """The plan that ran, with joins as if no side were small."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        again = df.select("*")
        again.collect()
        return again._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def shuffles_by_user(text: str) -> int:
    return len(re.findall(r"Exchange hashpartitioning\(user_pseudo_id", text.split("== Initial Plan ==")[0]))


# --- bitmaps -----------------------------------------------------------------------


@pytest.mark.parametrize("words", [1, 2, 3])
def test_visit_days_equal_sets_of_dates(spark, words):
    rng = random.Random(words)
    span = words * userdays.WORD_DAYS
    days = {}
    for user in range(120):
        start = date(1969, 6, 1) + timedelta(days=rng.randrange(40_000))
        gaps = [rng.choice([0, 1, 2, span - 1, span, span + 1, rng.randrange(4 * span)]) for _ in range(rng.randrange(6))]
        days[f"u{user}"] = [start + timedelta(days=sum(gaps[:k])) for k in range(len(gaps) + 1)]
    rows = spark.createDataFrame([(u, d) for u, ds in days.items() for d in ds], "user_pseudo_id string, session_date date")
    halves = rows.randomSplit([0.5, 0.5], seed=1)
    whole = userdays.day_bitmaps(rows, words)
    merged = userdays.merge_bitmaps(
        userdays.day_bitmaps(halves[0], words).unionByName(userdays.day_bitmaps(halves[1], words)), words
    )
    assert sorted(whole.collect()) == sorted(merged.collect())
    for row in userdays.visit_days(merged, words).collect():
        own = sorted(set(days[row["user_pseudo_id"]]))
        later = own[1] if len(own) > 1 and (own[1] - own[0]).days <= span else None
        assert (row["active_days"], row["first_day"], row["next_day"]) == (len(own), own[0], later)


def test_a_window_longer_than_a_word_takes_more_words(spark):
    assert [userdays.words_for(n) for n in (0, 1, 62, 63, 180)] == [1, 1, 1, 2, 3]
    rows = spark.createDataFrame(
        [("a", date(2020, 1, 1)), ("a", date(2020, 6, 1)), ("b", date(2020, 1, 1))], "user_pseudo_id string, session_date date"
    )
    got = {r[0]: r["next_day"] for r in userdays.visit_days(userdays.day_bitmaps(rows, 3), 3).collect()}
    assert got == {"a": date(2020, 6, 1), "b": None}


# --- tables kept by user --------------------------------------------------------------


def test_users_are_built_from_user_days_without_gathering_or_shuffling(ws):
    text = executed(users.users_of(ws.user_days, ws.cfg))
    assert "ObjectHashAggregate" not in text and "collect_set" not in text
    assert shuffles_by_user(text) == 0
    assert ws.users.count() == ws.sessions.select("user_pseudo_id").distinct().count()


@pytest.mark.parametrize(
    "name", ["new_vs_returning_window", "returner_value", "revenue_by_visit_number", "first_purchase_timing", "fact_sessions"]
)
def test_users_meet_their_days_and_visits_without_a_shuffle(ws, name):
    text = executed(ws.__class__.fact_sessions.func(_unstored(ws)) if name == "fact_sessions" else registered.BY_NAME[name].frame(ws))
    assert "SortMergeJoin [user_pseudo_id" in text or "ShuffledHashJoin [user_pseudo_id" in text
    assert shuffles_by_user(text) == 0
    assert "/sessions]" not in text  # sessions are not read again


def _unstored(ws):
    lazy = Workspace(ws.spark, ws.raw, ws.cfg)
    lazy.__dict__ |= {"user_days": ws.user_days, "users": ws.users}
    return lazy


@pytest.mark.parametrize("name", ["period_summary", "weekly_trend", "daily_trend"])
def test_trends_add_up_stored_user_days(ws, name):
    text = plan(registered.BY_NAME[name].frame(ws))
    assert "/user_days]" in text and "/sessions]" not in text


def test_user_days_give_the_same_as_sessions(ws):
    from clickloom.operators import retention, season

    for build in (
        lambda rows: season.weekly_trend(rows, ws.cfg),
        lambda rows: season.daily_trend(rows, ws.users, ws.cfg),
        lambda rows: season.period_summary(rows, ws.users, ws.periods, ws.cfg),
        lambda rows: retention.new_vs_returning_window(ws.users, rows, ws.cfg),
    ):
        assert sorted(map(str, build(ws.user_days).collect())) == sorted(map(str, build(ws.sessions).collect()))
    for build in (retention.revenue_by_visit_number, retention.first_purchase_timing):
        stored, again = build(ws.user_visits, ws.users), build(ws.sessions, ws.users)
        assert sorted(map(str, stored.collect())) == sorted(map(str, again.collect()))


def test_bucketed_tables_can_be_replaced(spark, tmp_path):
    store = TableStore(spark, str(tmp_path), buckets=3)
    first = store.build("t", spark.range(50).withColumn("x", F.lit(1)), bucket_by="id")
    assert first.count() == 50 and len(list((tmp_path / "t").glob("part-*"))) == 3
    assert store.build("t", spark.range(7).withColumn("x", F.lit(2)), bucket_by="id").agg(F.sum("x")).first()[0] == 14


# --- visit numbers ----------------------------------------------------------------------


def test_visit_numbers_equal_row_numbers(ws):
    from pyspark.sql import Window

    by_time = Window.partitionBy("user_pseudo_id").orderBy("session_start_ts", "ga_session_id")
    want = ws.sessions.select("user_pseudo_id", "ga_session_id", F.row_number().over(by_time).cast("bigint").alias("visit_number"))
    got = ws.visit_numbers.select(want.columns)
    assert sorted(got.collect(), key=str) == sorted(want.collect(), key=str)


def test_a_hot_user_is_numbered_in_several_parts(spark, tmp_path):
    n = 20_000
    user = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.concat(F.lit("u"), F.col("id") % 50))
    rows = spark.range(n).select(user.alias("u"), (F.col("id") * 7919 % n).alias("t")).repartition(4)
    store = TableStore(spark, str(tmp_path))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ranked = prefix_ranks(rows, "u", ["t"], "k", store).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = store.read("k_parts", spark.read.parquet(store.path("k_parts")).schema)
    assert parts.where("u = 'hot'").select("_part").distinct().count() > 1
    seen = {}
    for r in sorted(ranked, key=lambda r: (r["u"] or "", r["t"])):
        seen[r["u"]] = seen.get(r["u"], 0) + 1
        assert r["k"] == seen[r["u"]]
    assert len(ranked) == n


# --- quality reports ------------------------------------------------------------------------


def test_quality_reports_read_raw_events_twice_in_all(ws):
    names = [r for r in registered.BY_NAME if r.startswith("dq_")]
    read_raw = [name for name in names if "/raw]" in plan(registered.BY_NAME[name].frame(ws))]
    assert len(names) == 8 and read_raw == ["dq_obscured_values"]  # and once for the clean events


def test_reports_from_raw_equal_reports_from_the_profile(ws):
    raw, cfg = ws.raw, ws.cfg
    for direct, name in (
        (quality.dq_overview(raw), "dq_overview"),
        (quality.dq_events_by_name(raw), "dq_events_by_name"),
        (quality.dq_daily_events(raw), "dq_daily_events"),
        (quality.dq_funnel_events(raw, cfg), "dq_funnel_events"),
        (quality.dq_purchases(raw, cfg), "dq_purchases"),
        (quality.dq_daily_tracking(raw, cfg), "dq_daily_tracking"),
        (quality.dq_new_vs_returning(raw), "dq_new_vs_returning"),
    ):
        stored = registered.BY_NAME[name].frame(ws)
        assert sorted(direct.collect(), key=str) == sorted(stored.collect(), key=str), name


def test_reports_on_no_events(ws):
    none = ws.raw.limit(0)
    (row,) = quality.dq_overview(none).collect()
    assert tuple(row) == (0, 0, None, None, 0, 0)
    (row,) = quality.dq_purchases(none, ws.cfg).collect()
    assert row["purchase_events"] == 0 and row["null_revenue"] == 0 and row["total_revenue_usd"] is None


# --- tables by day ----------------------------------------------------------------------------


def test_reports_on_some_days_open_only_these(ws):
    text = plan(funnel.cart_window_sessions(ws.sessions, ws.cfg))
    assert re.search(r"PartitionFilters: \[[^\]]*session_date#\d+ >= ", text)
    text = plan(inference.baseline_repeats(ws.events, ws.cfg))
    assert re.search(r"PartitionFilters: \[[^\]]*event_date#\d+ >= .*event_date#\d+ <= ", text)
    assert "PartitionFilters: []" not in text
    # A period table that is not known beforehand prunes while the query runs.
    periods = ws.periods.where("period_order = 2")
    days = ws.dim_date.join(periods, F.col("date").between(F.col("start_date"), F.col("end_date"))).select("date")
    text = plan(ws.sessions.join(F.broadcast(days), F.col("session_date") == F.col("date")).groupBy("date").count())
    assert "dynamicpruning" in text


def test_tables_by_day_hold_the_same_rows(ws):
    plain = sessions.clean_events(ws.raw)
    assert sorted(ws.events.collect(), key=str) == sorted(plain.collect(), key=str)
    assert ws.sessions.columns == sessions.build_sessions(plain, ws.cfg).columns
    assert visits.visit_numbers(ws.sessions).count() == ws.sessions.count()
