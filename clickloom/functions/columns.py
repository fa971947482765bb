"""Small Column helpers: rates, exact money sums, event parameters, labels."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

MONEY = "decimal(18,4)"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- counts, sums and rates ---------------------------------------------------


def money_sum(amount: str | Column) -> Column:
    """Sum of an amount, added up as decimals.

    A sum of doubles depends on the order of the rows, so it may change when a
    task is retried or the partitioning differs; a sum of decimals does not.
    """
    return F.sum(col(amount).cast(MONEY)).cast("double")


def rounded(value: str | Column, digits: int) -> Column:
    """Round half up on the decimal value, so that 1.005 is not taken for 1.00499999."""
    return F.round(col(value).cast("decimal(38,9)"), digits).cast("double")


def ratio(numerator: str | Column, denominator: str | Column, digits: int | None = None) -> Column:
    """``numerator / denominator``, NULL for a zero denominator."""
    value = F.try_divide(col(numerator), col(denominator))
    return value if digits is None else rounded(value, digits)


def pct(numerator: str | Column, denominator: str | Column, digits: int | None = 2) -> Column:
    """``100 * numerator / denominator``, NULL for a zero denominator."""
    return ratio(F.lit(100) * col(numerator), denominator, digits)


def share_of_total(value: str | Column, within: Sequence[str] = (), digits: int = 2) -> Column:
    """Percentage of the total over all rows, or over the rows sharing ``within``.

    Only for frames that are already aggregated down to a small number of groups
    (channels, devices, countries, periods): the window holds all of them at once.
    """
    return pct(value, F.sum(col(value)).over(Window.partitionBy(*within)), digits)


def from_row(condition: Column, value: str | Column) -> Column:
    """The value of the one row that meets the condition, next to every row.

    Like ``share_of_total``, only for frames that are already down to a few groups.
    """
    return F.max(F.when(condition, col(value))).over(Window.partitionBy())


def all_of(flags: Iterable[str | Column]) -> Column:
    return reduce(lambda a, b: a & b, [col(f) for f in flags])


def with_one_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Append the columns of a single-row frame (a global aggregate) to every row."""
    return df.crossJoin(F.broadcast(one_row))


# --- raw event fields ----------------------------------------------------------


def _param(key: str, kind: str) -> Column:
    """The value of an event parameter; NULL when the key is absent.

    Keys and values are read as two parallel arrays, so that a scan for a number
    does not read the strings, which are most of an event.
    """
    position = F.array_position("event_params.key", key)
    return F.get(f"event_params.value.{kind}", (position - 1).cast("int"))


def int_param(key: str) -> Column:
    return _param(key, "int_value")


def string_param(key: str) -> Column:
    return _param(key, "string_value")


def raw_date(event_date: str | Column = "event_date") -> Column:
    """The DateType value of a ``yyyymmdd`` string."""
    day = col(event_date).cast("int")
    return F.make_date((day / 10_000).cast("int"), (day / 100).cast("int") % 100, day % 100)


def week_start(day: str | Column) -> Column:
    """Monday of the week."""
    return F.date_trunc("week", col(day)).cast("date")


# --- labels --------------------------------------------------------------------


def label_by_value(value: str | Column, labels: dict[str, str], default: str) -> Column:
    """The label of a value; the default for any other value and for NULL."""
    out = None
    for key, label in labels.items():
        hit = col(value) == key
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return F.lit(default) if out is None else out.otherwise(F.lit(default))


def group_by_words(
    name: str | Column,
    word_starts: Sequence[tuple[str, str]],
    whole_words: Sequence[tuple[str, str]],
    default: str,
) -> Column:
    """The first group one of whose words occurs in the upper-cased name."""
    upper = F.upper(col(name))
    rules = [(group, rf"\b({words})") for group, words in word_starts]
    rules += [(group, rf"\b({words})\b") for group, words in whole_words]
    out = F.lit(default)
    for group, pattern in reversed(rules):
        out = F.when(upper.rlike(pattern), group).otherwise(out)
    return out


# --- literal tables --------------------------------------------------------------


def literal_table(spark: SparkSession, rows: Sequence[tuple], schema: T.StructType) -> DataFrame:
    """A table typed into the configuration.

    Built from literals so that its size is known to the optimizer, which then
    broadcasts it on its own when (and only when) it is under the threshold.
    """
    structs = [
        F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(row, schema.fields, strict=True)])
        for row in rows
    ]
    if not structs:
        return spark.createDataFrame([], schema)
    return spark.range(1).select(F.inline(F.array(*structs)))
