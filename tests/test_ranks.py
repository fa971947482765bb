"""Exact order statistics."""

from __future__ import annotations

import random
import statistics

import pytest
from pyspark.sql import functions as F

from clickloom.functions.ranks import exact_medians, value_at_ranks
from tests.conftest import one


@pytest.mark.parametrize("size", [1, 2, 3, 4, 7, 100, 1001])
def test_median_of_small_sets(spark, size):
    rng = random.Random(size)
    values = [rng.randint(-20, 20) for _ in range(size)]
    df = spark.createDataFrame([(v,) for v in values], "x bigint")
    assert one(exact_medians(df, ["x"]))["median_x"] == statistics.median(values)


def test_median_ignores_nulls_and_may_be_null(spark):
    df = spark.createDataFrame([(None,), (3.0,), (5.0,)], "x double")
    assert one(exact_medians(df, ["x"]))["median_x"] == 4.0
    assert one(exact_medians(df.where("x < 0"), ["x"]))["median_x"] is None


@pytest.mark.parametrize("size", [99, 100, 999, 1000, 9_999, 10_000, 20_001])
def test_median_at_every_width_of_the_bracket(spark, size):
    # Heavily repeated values and a long tail.
    df = spark.range(size).select(
        F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise((F.col("id") * 7919) % 100_003).alias("x")
    )
    values = [r.x for r in df.collect()]
    assert one(exact_medians(df, ["x"]))["median_x"] == statistics.median(values)


def test_medians_of_several_columns_at_once(spark):
    df = spark.createDataFrame([(1, 0.5), (2, None), (4, 1.5), (9, 2.5)], "x bigint, y double")
    assert one(exact_medians(df, ["x", "y"])) == {"median_x": 3.0, "median_y": 1.5}


def test_value_at_a_high_rank(spark):
    df = spark.range(50_000).select(((F.col("id") * 104_729) % 50_021).alias("x"))
    values = sorted(r.x for r in df.collect())
    got = one(value_at_ranks(df, ["x"], 0.8, {"v": lambda n: n - F.floor(n * 0.2)}))["x_v"]
    assert got == values[50_000 - 10_000]


def test_concentration_counts_ties_at_the_cut_off(spark):
    from clickloom.operators.inference import revenue_concentration

    rows = [(f"p{i}", 10.0 if i < 6 else 1.0, 1) for i in range(20)] + [("unsold", 0.0, 0)]
    products = spark.createDataFrame(rows, "item_name string, revenue_usd double, order_lines int")
    got = one(revenue_concentration(products, k=3))
    # 74 in all; the top fifth is 4 of 20, all of them at the cut-off of 10.
    assert (got["sold_products"], got["top_products"]) == (20, 4)
    assert got["top_3_pct_of_revenue"] == pytest.approx(round(3000 / 74, 2))
    assert got["top_fraction_pct_of_revenue"] == pytest.approx(round(4000 / 74, 2))
