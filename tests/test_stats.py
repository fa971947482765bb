"""Interval and test expressions against the standard library and known results."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from clickloom.config import AnalyticsConfig
from clickloom.functions.columns import pct, ratio, rounded
from clickloom.functions.stats import two_prop_ztest, two_sided_p, wilson
from clickloom.operators import inference
from tests.conftest import one

CFG = AnalyticsConfig()


def test_normal_tail_matches_erfc(spark):
    rows = spark.range(-90, 91).select((F.col("id") / 10).alias("z")).withColumn("p", two_sided_p("z")).collect()
    for z, p in rows:
        assert p == pytest.approx(math.erfc(abs(z) / math.sqrt(2)), rel=2e-7)


def test_wilson_interval(spark):
    got = one(spark.range(1).select(wilson(F.lit(10), F.lit(50)).alias("ci")))["ci"]
    p, n, z = 0.2, 50, 1.96
    centre = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    assert got.lo == pytest.approx(centre - half)
    assert got.hi == pytest.approx(centre + half)
    assert one(spark.range(1).select(wilson(F.lit(0), F.lit(0)).alias("ci")))["ci"].lo is None


def test_ztest_without_variance_is_null(spark):
    t = one(spark.range(1).select(two_prop_ztest(F.lit(5), F.lit(5), F.lit(3), F.lit(3)).alias("t")))["t"]
    assert (t.z, t.p) == (None, None)
    t = one(spark.range(1).select(two_prop_ztest(F.lit(9), F.lit(5), F.lit(3), F.lit(3)).alias("t")))["t"]
    assert t.z is None  # more in the step than in the one before it


def test_rates_on_zero_and_half(spark):
    row = one(
        spark.range(1).select(
            ratio(F.lit(1), F.lit(0)).alias("zero"),
            pct(F.lit(1), F.lit(3)).alias("third"),
            rounded(F.lit(1.005), 2).alias("half"),
        )
    )
    assert row == {"zero": None, "third": 33.33, "half": 1.01}


# Users and buyers per channel, as published for the reference data set.
CHANNELS = (
    ("Organic", 104122, 1610),
    ("Direct", 66233, 1068),
    ("Referral", 42669, 889),
    ("Paid (cpc)", 14441, 209),
    ("Other (obscured)", 40863, 240),
    ("Data deleted", 1826, 39),
    ("All users", 270154, 4055),
)


def test_channel_tests_known_results(frame):
    performance = frame("acq_channel string, users bigint, purchasers bigint", *CHANNELS)
    got = {r.comparison: r for r in inference.channel_tests(performance, CFG).collect()}
    assert set(got) == {"Referral vs Organic", "Paid (cpc) vs Organic", "Direct vs Organic"}
    assert got["Referral vs Organic"].z == pytest.approx(7.225, abs=5e-4)
    assert got["Referral vs Organic"].significant
    assert got["Paid (cpc) vs Organic"].z == pytest.approx(-0.907, abs=5e-4)
    assert got["Paid (cpc) vs Organic"].p_value == pytest.approx(0.3644, abs=5e-5)
    assert got["Direct vs Organic"].p_value == pytest.approx(0.2841, abs=5e-5)
    assert not got["Direct vs Organic"].significant
    assert inference.channel_intervals(performance, CFG).count() == 6


def test_segment_against_rest_known_result(frame):
    countries = frame(
        "country string, users bigint, purchasers bigint, revenue_usd double, pct_of_users double, pct_of_revenue double",
        ("Indonesia", 2408, 23, 2025.0, 0.89, 0.6),
        ("(not set)", 5000, 50, 1.0, 1.0, 1.0),
        ("Everywhere else", 270154 - 2408 - 5000, 4055 - 23 - 50, 1.0, 1.0, 1.0),
        ("Tiny", 0, 0, 0.0, 0.0, 0.0),
    )
    got = {r.country: r for r in inference.segment_vs_rest(countries, CFG).collect()}
    assert set(got) == {"Indonesia", "Everywhere else"}
    assert got["Indonesia"].p_value == pytest.approx(0.0269, abs=5e-5)
    assert got["Indonesia"].significant
    assert not got["Indonesia"].significant_corrected  # 0.0269 is above 0.05 / 2


def test_device_overall_known_result(frame):
    steps = "sessions bigint, product_view bigint, add_to_cart bigint, begin_checkout bigint, add_payment_info bigint, purchase bigint"
    funnel = frame(
        f"device_category string, {steps}",
        ("desktop", 1000, 200, 50, 26, 17, 11),
        ("mobile", 1000, 210, 55, 28, 20, 12),
        ("tablet", 100, 20, 5, 3, 2, 1),
    )
    performance = frame(
        "device_category string, sessions bigint, purchase bigint",
        ("desktop", 208942, 2526),
        ("mobile", 143185, 1818),
        ("tablet", 8002, 91),
    )
    users = frame("device_category string, users bigint, purchase bigint", ("desktop", 10, 1), ("mobile", 9, 2))
    got = {r.check_order: r for r in inference.device_tests(funnel, performance, users, CFG).collect()}
    assert len(got) == 8
    assert got[6].z == pytest.approx(1.604, abs=5e-4)
    assert got[6].p_value == pytest.approx(0.1087, abs=5e-5)
    largest = [r.check_order for r in got.values() if r.largest_gap]
    assert largest == [max(range(1, 7), key=lambda i: abs(got[i].gap_pp))]


def test_quadrant_yield_known_results(frame):
    quadrants = frame(
        "quadrant string, products bigint, impressions bigint, pct_of_impressions double, revenue_usd double, pct_of_revenue double, avg_unit_price double",
        ("Strong products", 45, 561751, 21.55, 128963.0, 42.25, 22.05),
        ("High traffic, low conversion", 98, 1642042, 62.99, 97363.0, 31.9, 18.38),
        ("Hidden winners", 98, 264629, 10.15, 73621.0, 24.12, 18.55),
        ("Weak products", 44, 138209, 5.3, 5313.0, 1.74, 16.96),
    )
    got = {r.quadrant: round(r.revenue_per_1k_impressions, 1) for r in inference.quadrant_yield(quadrants).collect()}
    assert got == {
        "Strong products": 229.6,
        "High traffic, low conversion": 59.3,
        "Hidden winners": 278.2,
        "Weak products": 38.4,
    }
    assert round(one(inference.impression_reallocation(quadrants, CFG))["monthly_gain"]) == 4273


def test_opportunity_sizing_known_results(frame):
    steps = frame(
        "stage string, users bigint",
        ("Product view", 45104),
        ("Add to cart", 12021),
        ("Begin checkout", 6509),
        ("Add payment info", 4253),
        ("Purchase", 3010),
    )
    abandonment = frame("level string, cart_abandonment_pct double", ("users", 79.21), ("sessions", 83.06))
    value = frame("revenue_usd double, revenue_per_buyer double, days_in_window int", (247298.0, 82.16, 67))
    funnel = frame(
        "acq_channel string, cart_pct_of_view double, checkout_pct_of_cart double, payment_pct_of_checkout double",
        ("Referral", 29.04, 56.37, 69.78),
        ("Organic", 26.46, 54.99, 67.11),
    )
    retention = frame(
        "acq_channel string, eligible_30d_users bigint, returned_30d bigint, return_30d_pct double",
        ("Organic", 67428, 7860, 11.66),
        ("Direct", 42345, 5178, 12.23),
        ("Other (obscured)", 26486, 487, 1.84),
        ("Referral", 26646, 3601, 13.51),
        ("Paid (cpc)", 9534, 1081, 11.34),
        ("Data deleted", 439, 13, 2.96),
    )
    worth = frame("returned_within_30d boolean, revenue_per_user double", (False, 0.401), (True, 8.32))
    got = inference.opportunity_sizing(steps, abandonment, value, funnel, retention, worth, CFG).orderBy("scenario_order")
    rows = got.collect()
    assert [round(r.upper_bound_per_month) for r in rows] == [19679, 12379, 8239]
    assert [round(r.extra_users, 1) for r in rows][1:] == [336.5, 224.0]
    assert round(rows[0].extra_users) == 5136
    assert all(r.estimate_per_month == pytest.approx(r.upper_bound_per_month / 2, abs=1e-3) for r in rows)
    assert round(rows[0].pct_of_monthly_revenue, 1) == 8.9


def test_baseline_sensitivity_known_results(frame):
    summary = frame(
        "period_order int, period string, is_comparison boolean, days int, orders bigint, orders_per_day double, orders_per_day_vs_baseline_pct double",
        (1, "baseline", True, 14, 645, 46.1, 0.0),
        (2, "week", True, 7, 597, 85.3, 85.1),
        (3, "December", True, 31, 2303, 74.3, 61.3),
        (4, "January", True, 25, 841, 33.6, -27.0),
        (8, "late", False, 6, 48, 8.0, -80.0),
    )
    repeats = frame("repeats bigint", (35,))
    got = inference.baseline_sensitivity(summary, repeats, CFG).orderBy("period_order").collect()
    assert [round(r.adjusted_vs_baseline_pct) for r in got] == [96, 71, -23]


def test_early_return_ratio_known_results(frame):
    from datetime import date, timedelta

    weeks = (
        (1974, 1974, 6.23, 7.6),
        (16732, 16732, 9.2, 12.05),
        (14813, 14813, 10.41, 14.07),
        (17100, 17100, 10.44, 14.27),
        (19296, 19296, 9.3, 12.05),
        (21436, 21436, 9.71, 11.92),
        (27970, 27970, 7.45, 9.15),
        (24477, 24477, 6.64, 8.49),
        (17215, 17215, 5.36, 7.2),
        (16463, 11865, 4.97, 6.51),
    )
    rows = [(date(2020, 10, 26) + timedelta(weeks=i), *week) for i, week in enumerate(weeks)]
    cohorts = frame(
        "cohort_week date, new_users bigint, eligible_30d_users bigint, return_7d_pct double, return_30d_pct double", *rows
    )
    got = one(inference.early_return_ratio(cohorts, CFG))
    assert (got["cohorts"], round(got["lowest_pct"]), round(got["highest_pct"])) == (8, 73, 81)


def test_pareto_and_shares(frame):
    countries = frame(
        "country string, users bigint, purchasers bigint, conversion_rate_pct double, revenue_usd double, pct_of_revenue double",
        ("A", 5000, 10, 0.2, 60.0, 60.0),
        ("B", 2000, 10, 0.5, 30.0, 30.0),
        ("C", 10, 5, 50.0, 10.0, 10.0),
    )
    got = inference.pareto(countries, 2).orderBy("cum_pct").collect()
    assert [(r.country, r.cum_pct) for r in got] == [("A", 60.0), ("B", 90.0)]
    assert [r.country for r in inference.small_segment_illusion(countries, CFG).collect()] == ["C"]
