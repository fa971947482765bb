"""Exact order statistics and row numbers without sorting everything, or a large group, in one task."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickloom.sources.tables import TableStore

ACCURACY = 10_000
#: Half widths of the bracket, as fractions; the first that spans so many ranks is used.
MARGINS = (0.001, 0.01, 0.1, 1.0)
RANKS = 10


def value_at_ranks(
    df: DataFrame, values: Sequence[str], fraction: float, ranks: dict[str, Callable[[Column], Column]]
) -> DataFrame:
    """The values of each column at given ranks (zero-based, ascending), as one row.

    ``ranks`` maps a name to the rank as a function of the number of non-NULL values;
    all of them must lie near ``fraction`` of that number.  The results are named
    ``<column>_<name>``, are doubles, and are NULL where there is no such rank.

    A quantile sketch brackets the fraction (its rank error is at most a tenth of the
    margin), the values below the bracket are only counted, and only the distinct
    values inside it are put in order: a five-hundredth of much data, and more of
    little, so that the bracket always spans some ranks.  The result is exact.
    """
    long = df.select(
        F.inline(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("v")) for c in values]))
    ).where(F.col("v").isNotNull())
    ends = [max(0.0, fraction - m) for m in MARGINS] + [min(1.0, fraction + m) for m in MARGINS]
    found = long.groupBy("c").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("v", ends, ACCURACY).alias("q"))
    too_narrow = sum((F.col("n") * m < RANKS).cast("int") for m in MARGINS[:-1])
    bounds = found.select(
        "c", "n", F.get("q", too_narrow).alias("lo"), F.get("q", too_narrow + len(MARGINS)).alias("hi")
    )
    # One row of bounds per named column.
    bracketed = long.join(F.broadcast(bounds), "c").where(F.col("v") <= F.col("hi"))
    # Everything below the bracket becomes the single NULL value, which sorts first.
    counted = bracketed.groupBy("c", "n", F.when(F.col("v") >= F.col("lo"), F.col("v")).alias("v")).agg(
        F.count(F.lit(1)).alias("rows")
    )
    upto = F.sum("rows").over(Window.partitionBy("c").orderBy(F.col("v").asc_nulls_first()))
    placed = counted.select("c", "v", "n", (upto - F.col("rows")).alias("first_rank"), (upto - 1).alias("last_rank"))

    def at(c: str, rank: Callable[[Column], Column]) -> Column:
        here = rank(F.col("n")).between(F.col("first_rank"), F.col("last_rank"))
        return F.max(F.when((F.col("c") == c) & here, F.col("v")))

    return placed.agg(*[at(c, rank).alias(f"{c}_{name}") for c in values for name, rank in ranks.items()])


def exact_medians(df: DataFrame, values: Sequence[str]) -> DataFrame:
    """The median of each column, as one row of ``median_<column>``.

    With an even number of values it is the mean of the two in the middle.
    """
    middle = value_at_ranks(
        df, values, 0.5, {"low": lambda n: F.floor((n - 1) / 2), "high": lambda n: F.floor(n / 2)}
    )
    return middle.select(
        *[((F.col(f"{c}_low") + F.col(f"{c}_high")) / F.lit(2.0)).alias(f"median_{c}") for c in values]
    )


def prefix_ranks(df: DataFrame, group: str, order: Sequence[str], name: str, store: TableStore) -> DataFrame:
    """Add each row's place in its group, from 1, in ascending order.

    Rows are range-sorted by group and order, so a large group fills as many parts as it needs.  A row's place is its
    place in its part, plus the group's rows in earlier parts, of which there is one count for each part and group.
    The sorted rows are stored, so that both steps see the same parts even if an executor is lost between them.
    """
    placed = (
        df.repartitionByRange(group, *order)
        .sortWithinPartitions(group, *order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_row", F.monotonically_increasing_id())
    )
    placed = store.build(f"{name}_parts", placed)
    spans = placed.groupBy(F.col(group).alias("_group"), F.col("_part").alias("_in")).agg(
        F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n")
    )
    earlier = Window.partitionBy("_group").orderBy("_in").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    same = F.col(group).eqNullSafe(F.col("_group")) & (F.col("_part") == F.col("_in"))
    number = F.col("_row") - F.col("_first") + F.col("_before") + 1
    return placed.join(spans, same).select(*df.columns, number.alias(name))
