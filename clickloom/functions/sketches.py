"""Mergeable approximations: distinct counts and quantiles that are kept by day and put together on demand.

Exact counts stay the default of every report.  A sketch has a fixed size whatever it has seen, and sketches of
disjoint or overlapping sets of rows merge, so a question about any range of days reads a line for each day.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Logarithm of the buckets of a distinct count (4 to 21): 2^14 buckets take about 10 kB at most.
LG_K = 14
#: Size of a quantile sketch (8 to 65535).
K = 400


def distinct_error(lg_k: int = LG_K, deviations: float = 3) -> float:
    """The share by which a merged distinct count may be off, at so many standard deviations."""
    return deviations * 1.04 / sqrt(2**lg_k)


def rank_error(k: int = K) -> float:
    """The share of the values by which a quantile's rank may be off, with 99 % confidence."""
    return 2.296 / k**0.9723


def distinct_sketches(rows: DataFrame, by: Sequence[str], value: str, *more: Column, lg_k: int = LG_K) -> DataFrame:
    """(by, sketch, ...): a distinct-count sketch of the values of each group; NULL is not counted."""
    return rows.groupBy(*by).agg(F.hll_sketch_agg(value, lg_k).alias("sketch"), *more)


def merged_distinct(sketches: DataFrame, by: Sequence[str], *more: Column) -> DataFrame:
    """(by, distinct, ...) from the sketches of several groups."""
    return sketches.groupBy(*by).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct"), *more)


def quantile_sketches(rows: DataFrame, by: Sequence[str], value: str, k: int = K) -> DataFrame:
    """(by, sketch): a quantile sketch of the whole-number values of each group; groups without a value go."""
    known = rows.where(F.col(value).isNotNull())
    return known.groupBy(*by).agg(F.kll_sketch_agg_bigint(F.col(value).cast("bigint"), k).alias("sketch"))


def merged_quantile(sketches: DataFrame, by: Sequence[str], fraction: float, k: int = K) -> DataFrame:
    """(by, n, quantile) from the sketches of several groups."""
    merged = sketches.groupBy(*by).agg(F.kll_merge_agg_bigint("sketch", k).alias("sketch"))
    return merged.select(
        *by,
        F.kll_sketch_get_n_bigint("sketch").alias("n"),
        F.kll_sketch_get_quantile_bigint("sketch", F.lit(fraction)).alias("quantile"),
    )
