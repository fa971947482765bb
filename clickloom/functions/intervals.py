"""Joins of dates to date ranges, however many ranges there are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Days in a cell.  A range has one line for each cell that it touches, a date lies in one cell.
CELL_DAYS = 28


def join_on_range(
    rows: DataFrame, day: str, ranges: DataFrame, start: str, end: str, how: str = "inner", cell_days: int = CELL_DAYS
) -> DataFrame:
    """Rows with every range their date falls in; ends included, ranges may overlap.

    Ranges are cut into cells of the calendar and meet the rows by an equality, so Spark may hash, sort or broadcast
    them by their size, where a bare range test would compare every row with every range.  Within a cell the range
    itself is tested.  A range holds a date in one of its cells only, so no pair is found twice.  A range that ends
    before it starts, or lacks an end, holds no date.
    """

    def cell(name: str):
        return F.floor(F.unix_date(name) / cell_days)

    ordered = F.when(F.col(start) <= F.col(end), F.sequence(cell(start), cell(end)))
    cut = ranges.withColumn("_cell", F.explode(ordered))
    marked = rows.withColumn("_own_cell", cell(day))
    same = (F.col("_own_cell") == F.col("_cell")) & F.col(day).between(F.col(start), F.col(end))
    return marked.join(cut, same, how).drop("_own_cell", "_cell")
