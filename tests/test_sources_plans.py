"""Storage, the pipeline job, and the shape of the plans."""

from __future__ import annotations

import re
from dataclasses import replace
from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from checks import queries as registered
from clickloom import schema
from clickloom.config import AnalyticsConfig
from clickloom.operators import metrics, product, quality, sessions
from clickloom.plans import pipeline
from clickloom.plans.reports import REPORTS
from clickloom.plans.statistics import STATISTIC_REPORTS
from clickloom.plans.workspace import Workspace
from clickloom.sources import sample
from clickloom.sources.events import read_events, write_events
from clickloom.sources.tables import TableStore, read_csv, write_csv
from tests.conftest import event, one

SF = "/root/testdata/sf0.001"
CFG = AnalyticsConfig()


def plan(df) -> str:
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple")


@pytest.fixture(scope="module")
def stored(raw, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("raw"))
    write_events(
        raw(*[event(f"u{d}", f"2020-11-{d:02d}T10:00", "page_view", page="/x") for d in range(1, 11)]), path
    )
    return path


def test_date_range_prunes_directories(spark, stored):
    some = read_events(spark, stored, date(2020, 11, 3), date(2020, 11, 5))
    assert some.count() == 3
    assert len(re.findall(r"PartitionFilters: \[[^\]]*20201103", plan(some))) == 1
    assert one(quality.dq_overview(read_events(spark, stored)))["daily_tables"] == 10


def test_number_parameters_do_not_read_strings(spark, stored):
    text = plan(sessions.clean_events(read_events(spark, stored)))
    read = "".join(re.findall(r"ReadSchema: .*", text))
    assert "int_value" in read
    assert "string_value" not in read
    for unread in ("operating_system", "region", "items", "user_id"):
        assert unread not in read.replace("user_pseudo_id", "")


def test_item_fields_are_read_one_by_one(spark, stored):
    raw = read_events(spark, stored)
    text = plan(product.item_cart_adds(raw, product.item_aliases(spark, CFG), CFG))
    read = "".join(re.findall(r"ReadSchema: .*", text))
    assert "item_name" in read and "quantity" in read
    assert "item_id" not in read and "item_revenue_in_usd" not in read
    assert "PushedFilters: [IsNotNull(event_name), EqualTo(event_name,add_to_cart)]" in text


def test_aliases_are_broadcast_by_size(spark, stored):
    text = plan(product.item_impressions(read_events(spark, stored), product.item_aliases(spark, CFG), CFG))
    assert "BroadcastHashJoin" in text
    many = tuple((f"raw {i}" + "x" * 400, f"name {i}") for i in range(50))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1000")
    try:
        aliases = spark.createDataFrame(list(many), schema.ITEM_ALIASES)
        text = plan(product.item_impressions(read_events(spark, stored), aliases, CFG))
        assert "BroadcastHashJoin" not in text
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_no_plan_joins_without_bound(spark):
    """No Cartesian product, and no window over the rows of a large table in one partition."""
    for name, query in registered.queries().items():
        text = plan(query(spark, SF))
        assert "CartesianProduct" not in text, name
        # A window in a single partition sits on an aggregate, never straight on a scan.
        for block in text.split("Window [")[1:]:
            if "Exchange SinglePartition" in block.split("Aggregate")[0]:
                assert "FileScan" not in block.split("Aggregate")[0], name


def test_visits_are_numbered_once_and_folded_before_they_meet_users(spark):
    for name in ("revenue_by_visit_number", "first_purchase_timing"):
        text = plan(registered.queries()[name](spark, SF))
        assert "/user_visits]" in text and "/sessions]" not in text and "row_number" not in text


def test_a_user_with_most_sessions_is_split_over_tasks(spark, tmp_path):
    """The join of sessions to users is split where one user has a third of the rows."""
    n = 60_000
    user = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("u"), (F.col("id") % 20_000).cast("string")))
    when = F.timestamp_micros(F.col("id") * 1_000_000 + 1_604_224_800_000_000)
    events = spark.range(n).select(
        when.cast("date").alias("event_date"),
        when.alias("event_ts"),
        F.lit("page_view").alias("event_name"),
        user.alias("user_pseudo_id"),
        F.col("id").alias("ga_session_id"),
        F.lit(1).cast("bigint").alias("ga_session_number"),
        F.lit("desktop").alias("device_category"),
        F.lit("Chile").alias("country"),
        F.lit("organic").alias("acq_medium"),
        F.lit("s").alias("acq_source"),
        F.lit(None).cast("string").alias("transaction_id"),
        F.lit(None).cast("double").alias("purchase_revenue_usd"),
    )
    lowered = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10k",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
    }
    for key, value in lowered.items():
        spark.conf.set(key, value)
    try:
        store = TableStore(spark, str(tmp_path))
        stored = store.build("events", events)
        touch = store.build("touch", sessions.first_touch(stored, CFG))
        built = sessions.build_sessions(stored, CFG, touch).cache()
        assert built.count() == n
        assert "skew=true" in plan(built)
        built.unpersist()
    finally:
        for key in lowered:
            spark.conf.unset(key)


def test_table_store_reads_back_what_it_wrote(spark, tmp_path):
    store = TableStore(spark, str(tmp_path))
    df = spark.createDataFrame([(1, "a", date(2020, 1, 1)), (2, None, date(2020, 1, 2))], "x int, y string, d date")
    back = store.build("t", df, partition_by="d")
    assert back.schema.simpleString() == df.schema.simpleString()
    assert sorted(back.collect()) == sorted(df.collect())


def test_pipeline_exports_every_report_with_header(spark, tmp_path):
    base = registered.workspace(spark, SF, "items")
    ws = Workspace(spark, base.raw, base.cfg, TableStore(spark, str(tmp_path / "tables")))
    names = pipeline.run(ws, str(tmp_path / "reports"))
    assert names == [r.name for r in (*REPORTS, *STATISTIC_REPORTS)]
    assert len(names) == 48 + 28 + 8
    back = read_csv(spark, str(tmp_path / "reports/products_export"), schema.DASHBOARD_CSV["products_export"])
    assert back.count() == ws.products.count()
    assert one(back.agg(F.sum("order_lines").alias("n"))) == one(ws.products.agg(F.sum("order_lines").alias("n")))
    facts = read_csv(spark, str(tmp_path / "reports/fact_sessions"), schema.DASHBOARD_CSV["fact_sessions"])
    assert facts.schema == schema.DASHBOARD_CSV["fact_sessions"]
    assert one(facts.agg(F.sum("sessions").alias("n")))["n"] == ws.sessions.count()


def test_csv_keeps_nulls_and_types(spark, tmp_path):
    df = spark.createDataFrame([(1, 'say "hi", twice', 0.5), (2, None, None)], "x bigint, y string, z double")
    write_csv(df, str(tmp_path / "c"))
    assert sorted(read_csv(spark, str(tmp_path / "c"), df.schema).collect()) == sorted(df.collect())


@pytest.fixture(scope="module")
def board(spark, raw):
    cfg = replace(CFG, country_min_users=1)
    events = raw(
        event("a", "2020-11-10T10:00", "view_item", device="mobile"),
        event("a", "2020-11-30T10:00", "add_to_cart", session=2, number=2, device="mobile"),
        event("a", "2020-11-30T10:05", "begin_checkout", session=2, number=2, device="mobile"),
        event("b", "2020-11-30T10:00", "view_item"),
        event("b", "2020-11-30T10:01", "add_to_cart"),
        event("b", "2020-11-30T10:02", "purchase", transaction_id="T", revenue=30.0),
        event("c", "2020-11-10T10:00", "page_view", number=7),
        event("c", "2020-11-11T10:00", "page_view", session=2, number=8),
        event("z", "2021-01-25T10:00", "page_view"),
    )
    return Workspace(spark, events, cfg).dashboard


def test_funnel_measures_keep_to_reliable_dates(board):
    names = ["Total Sessions", "Funnel Sessions", "Funnel Product View", "Funnel Cart", "Cart Abandonment", "Total Users"]
    got = one(metrics.session_measures(board, names))
    assert got == {
        "Total Sessions": 6,
        "Funnel Sessions": 3,
        "Funnel Product View": 1,
        "Funnel Cart": 2,
        "Cart Abandonment": 0.5,
        "Total Users": 4,
    }
    # A user's own date filter narrows it further.
    only = one(metrics.session_measures(board, ["Funnel Sessions", "AOV"], filters={"month_label": "Nov 2020"}))
    assert only == {"Funnel Sessions": 2, "AOV": 30.0}
    none = one(metrics.session_measures(board, ["Conversion Rate"], filters={"country": "Nowhere"}))
    assert none == {"Conversion Rate": None}


def test_stage_measures_have_no_step_before_the_first(board):
    got = {r.stage: r for r in metrics.funnel_by_stage(board).collect()}
    assert len(got) == 6
    first = got["Sessions"]
    assert (first["Funnel Value"], first["Funnel Previous"], first["Step Conversion"], first["Step Drop-off"]) == (
        3, None, None, None,
    )
    assert got["Begin checkout"]["Step Drop-off"] == 0.5


def test_return_rate_replaces_the_user_type(board):
    name = "7-day Return Rate"
    everyone = one(metrics.return_rate(board, 7))[name]
    assert one(metrics.return_rate(board, 7, filters={"user_type": "returning"}))[name] == everyone
    sliced = {r.user_type: r[name] for r in metrics.return_rate(board, 7, ["user_type"]).collect()}
    assert sliced == {"new": everyone, "returning": everyone}
    assert everyone == 0.0


def test_product_measures_join_the_product_dimension_only_when_asked(spark):
    ws = registered.workspace(spark, SF, "items")
    rows = metrics.product_measures(ws.dashboard, ["Product Impressions"], ["meets_view_floor"]).collect()
    assert sum(r["Product Impressions"] for r in rows) == one(
        ws.products.agg(F.sum("impressions").alias("n"))
    )["n"]


def test_command_line_builds_only_what_a_report_needs(spark, stored, tmp_path, capsys):
    pipeline.main([stored, str(tmp_path), "--report", "funnel_steps"])
    assert capsys.readouterr().out.split() == ["funnel_steps"]
    assert (tmp_path / "reports" / "funnel_steps").is_dir()
    assert sorted(p.name for p in (tmp_path / "tables").iterdir()) == [
        "events_clean",
        "first_touch",
        "sessions",
        "users_cart_window",
    ]


def _items_folder(spark, folder, lines, orders, parts):
    """The three tables that ``item_events`` reads, from rows of a test."""
    spark.createDataFrame(
        lines,
        "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
        "l_extendedprice double, l_discount double, l_returnflag string, l_linestatus string, l_shipdate timestamp",
    ).write.parquet(f"{folder}/lineitem.parquet")
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").write.parquet(f"{folder}/orders.parquet")
    spark.createDataFrame(
        parts, "p_partkey long, p_name string, p_brand string, p_type string, p_size int"
    ).write.parquet(f"{folder}/part.parquet")
    return str(folder)


def test_lines_are_read_and_joined_once_for_all_their_events(spark, tmp_path):
    at = datetime(1998, 5, 4)
    folder = _items_folder(
        spark,
        tmp_path,
        [
            (1, 5, 2, 1, 3.0, 10.0, 0.1, "N", "F", at),  # seen, added without a quantity, bought
            (1, 6, 2, 2, 4.0, 10.0, 0.0, "A", "F", at),  # seen, added
            (1, 6, 2, 3, 4.0, 10.0, 0.0, "R", "O", at),  # seen, bought
            (1, 6, 2, 4, 4.0, 10.0, 0.0, None, None, at),  # seen
            (2, 6, 2, 1, 4.0, 10.0, 0.0, "N", "F", at),  # of an order that is not there
            (None, 6, 2, 1, 4.0, 10.0, 0.0, "N", "F", at),
        ],
        [(1, 70), (1, 80), (None, 90)],  # an order that is there twice
        [(5, "old rod", "B", "T", 1), (6, "ring", "B", "T", 10)],
    )
    raw = sample.item_events(spark, folder)
    text = plan(raw)
    assert len(re.findall(r"FileScan parquet .*l_orderkey", text)) == 1
    found = raw.groupBy("event_name").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_pseudo_id").alias("u"))
    assert {r.event_name: (r.n, r.u) for r in found.collect()} == {
        "view_item": (8, 2), "add_to_cart": (4, 2), "purchase": (4, 2)
    }
    added = raw.where("event_name = 'add_to_cart' AND user_pseudo_id = '70'").select(F.inline("items"))
    assert sorted(((r.item_name, r.quantity) for r in added.collect()), key=str) == [
        ("&quot;ring&quot;", 4), ("B T", None), ("B T", None), ("old rod", None)
    ]
    assert {r[0] for r in raw.where("event_name != 'purchase'").select("ecommerce.transaction_id").collect()} == {None}


def test_item_activity_moves_events_and_orders_only(spark, stored):
    raw = read_events(spark, stored)
    activity = product.item_activity(raw, product.item_aliases(spark, CFG), CFG)
    moved = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan(activity))
    assert len(moved) == 2  # views by user, date and quarter of an hour; purchases by transaction
    assert not [keys for keys in moved if "item_name" in keys]


def test_products_fold_flags_by_user_not_sums(spark, frame):
    activity = frame(
        "event_date date, item_name string, user_pseudo_id string, impressions long, cart_adds long, "
        "order_lines long, units long, revenue decimal(28,4)",
        (CFG.cart_reliable_from, "a", "u", 2, 0, 0, 0, Decimal(0)),
        (CFG.first_date, "a", "u", 1, 0, 0, 0, Decimal(0)),
        (CFG.cart_reliable_from, "a", None, 1, 1, 0, 0, Decimal(0)),
        (CFG.cart_reliable_from, "a", "v", 0, 0, 1, 3, Decimal(7)),
        (CFG.first_date, "a", "v", 0, 0, 1, 2, Decimal(5)),
    )
    totals = product.product_totals(activity, CFG)
    by_user = [line for line in plan(totals).split("\n") if "Aggregate(keys=[item_name" in line and "user_pseudo_id" in line]
    assert by_user
    assert not [line for line in by_user if "sum(" in line]
    assert one(totals) == {
        "item_name": "a", "impressions": 4, "impression_users": 1, "impressions_cart_window": 3, "cart_adds": 1,
        "cart_users": 0, "order_lines": 2, "order_lines_cart_window": 1, "buyers": 1, "units": 5, "revenue_usd": 12.0,
    }


def test_stored_tables_are_zstd(spark, tmp_path):
    store = TableStore(spark, str(tmp_path))
    rows = spark.range(10).withColumn("k", F.col("id") % 2)
    assert store.build("plain", rows).count() == 10
    assert store.build("split", rows, partition_by="k").count() == 10
    assert store.build("kept", rows, bucket_by="id").count() == 10
    files = [p.name for p in tmp_path.rglob("*.parquet")]
    assert len(files) >= 3
    assert all("zstd" in name for name in files)
