"""Mergeable sketches, joins to many ranges, and ordered exports."""

from __future__ import annotations

import random
from bisect import bisect_left, bisect_right
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from clickloom.functions import sketches
from clickloom.functions.intervals import join_on_range
from clickloom.sources.tables import write_csv
from tests.test_sources_plans import plan

DAY = date(2020, 1, 1)


def test_distinct_counts_of_merged_days_are_within_the_error(spark):
    rows = spark.range(200_000).select(
        (F.col("id") % 10).alias("day"), (F.col("id") % 3).alias("name"), F.when(F.col("id") % 7 > 0, F.col("id") % 60_007).alias("user")
    )
    days = sketches.distinct_sketches(rows, ["day", "name"], "user", F.count("*").alias("events"))
    got = {r["name"]: r for r in sketches.merged_distinct(days, ["name"], F.sum("events").alias("events")).collect()}
    for r in rows.groupBy("name").agg(F.count_distinct("user").alias("n"), F.count("*").alias("events")).collect():
        assert abs(got[r["name"]]["distinct"] - r["n"]) <= sketches.distinct_error() * r["n"]
        assert got[r["name"]]["events"] == r["events"]
    # Merging in two steps, or a part twice, changes nothing.
    half = days.where("day < 6").unionByName(days.where("day > 3"))
    again = {r["name"]: r["distinct"] for r in sketches.merged_distinct(half, ["name"]).collect()}
    assert again == {k: r["distinct"] for k, r in got.items()}


@pytest.mark.parametrize("fraction", [0.1, 0.5, 0.9])
def test_quantiles_of_merged_days_are_within_the_rank_error(spark, fraction):
    rng = random.Random(3)
    values = [(k % 9, int(rng.expovariate(0.0001))) for k in range(60_000)] + [(3, None)]
    days = sketches.quantile_sketches(spark.createDataFrame(values, "day int, x int"), ["day"], "x")
    (row,) = sketches.merged_quantile(days, [], fraction).collect()
    ordered = sorted(x for _, x in values if x is not None)
    low, high = bisect_left(ordered, row["quantile"]), bisect_right(ordered, row["quantile"])
    slack = sketches.rank_error() * len(ordered) + 1
    assert row["n"] == len(ordered) and low - slack <= fraction * len(ordered) <= high + slack


def test_many_overlapping_ranges_meet_their_days_without_a_nested_loop(spark):
    n = 100_000
    start = F.date_add(F.lit(DAY), (F.col("id") % 3000).cast("int"))
    ranges = spark.range(n).select(F.col("id").alias("k"), start.alias("a"), F.date_add(start, (F.col("id") % 91).cast("int")).alias("b"))
    days = spark.range(0, 3200, 37).select(F.date_add(F.lit(DAY), F.col("id").cast("int")).alias("day"))
    joined = join_on_range(days, "day", ranges, "a", "b")
    assert "NestedLoop" not in plan(joined) and "Cartesian" not in plan(joined)
    got = {r["day"]: (r["n"], r["s"]) for r in joined.groupBy("day").agg(F.count("*").alias("n"), F.sum("k").alias("s")).collect()}
    for d in range(0, 3200, 37):
        own = [k for k in range(n) if k % 3000 <= d <= k % 3000 + k % 91]
        assert got.get(DAY + timedelta(days=d), (0, None)) == (len(own), sum(own) if own else None)


@pytest.mark.parametrize("cell", [1, 7, 28])
def test_ranges_equal_brute_force(spark, cell):
    rng = random.Random(cell)
    day = lambda: rng.choice([None, DAY + timedelta(days=rng.randrange(-40, 80))])
    ranges = [(k, day(), day()) for k in range(60)] + [(99, date(1969, 12, 20), date(1970, 1, 9))]
    days = [(k, day()) for k in range(80)] + [(900, date(1969, 12, 31)), (901, date(1970, 1, 1))]
    rows, spans = spark.createDataFrame(days, "d int, day date"), spark.createDataFrame(ranges, "k int, a date, b date")
    inner = join_on_range(rows, "day", spans, "a", "b", cell_days=cell).select("d", "k").collect()
    want = [(d, k) for d, x in days for k, a, b in ranges if None not in (x, a, b) and a <= x <= b]
    assert sorted(map(tuple, inner)) == sorted(want)
    left = join_on_range(rows, "day", spans, "a", "b", "left", cell).select("d", "k").collect()
    hit = {d for d, _ in want}
    assert sorted(map(str, map(tuple, left))) == sorted(map(str, want + [(d, None) for d, _ in days if d not in hit]))


def test_a_large_export_is_in_order_over_several_files(spark, tmp_path):
    rows = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("x"), (F.col("id") % 13).alias("y")).repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        write_csv(rows, str(tmp_path / "c"), single_file=False, order=[F.desc("y"), F.asc("x")])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = sorted((tmp_path / "c").glob("part-*.csv"))
    got = [tuple(map(int, line.split(","))) for f in files for line in f.read_text().splitlines()[1:]]
    assert len(files) > 1
    assert got == sorted(((r["x"], r["y"]) for r in rows.collect()), key=lambda r: (-r[1], r[0]))
