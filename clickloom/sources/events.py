"""The raw event table: one Parquet directory per day."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.schema import RAW_EVENTS


def in_range(raw: DataFrame, first: date | None = None, last: date | None = None) -> DataFrame:
    """The raw events of a range of days."""
    if first is not None:
        raw = raw.where(F.col("event_date") >= first.strftime("%Y%m%d"))
    if last is not None:
        raw = raw.where(F.col("event_date") <= last.strftime("%Y%m%d"))
    return raw


def read_events(spark: SparkSession, path: str, first: date | None = None, last: date | None = None) -> DataFrame:
    """Raw events of a range of days.

    ``event_date`` is the partition column, so the range selects directories and
    the other days are never opened.
    """
    return in_range(spark.read.schema(RAW_EVENTS).parquet(path), first, last)


def write_events(raw: DataFrame, path: str) -> None:
    """Write raw events as daily directories.

    The rebalance hint gathers each day into files of the advisory size and splits
    a busy day over several tasks, instead of one task (or thousands of files) a day.
    """
    raw.hint("rebalance", "event_date").write.mode("overwrite").partitionBy("event_date").parquet(path)
