from __future__ import annotations

import sys
from collections.abc import Iterator
from datetime import UTC, datetime
from pathlib import Path

import pytest
from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from clickloom.schema import RAW_EVENTS  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory) -> Iterator[SparkSession]:
    session = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.maxMetadataStringLength", "100000")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    if not session.conf.get("spark.checkpoint.dir", None):
        session.conf.set("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
    yield session
    session.stop()


def event(user, when, name, session=1, number=1, **fields):
    """A raw event row; ``when`` is an ISO time."""
    ts = datetime.fromisoformat(when).replace(tzinfo=UTC)
    params = []
    if session is not None:
        params.append(("ga_session_id", (None, session)))
    if number is not None:
        params.append(("ga_session_number", (None, number)))
    if "page" in fields:
        params.append(("page_location", (fields["page"], None)))
    items = [
        (i.get("id"), i.get("name"), i.get("quantity"), i.get("revenue")) for i in fields.get("items") or []
    ]
    return (
        ts.strftime("%Y%m%d"),
        int(ts.timestamp() * 1_000_000),
        name,
        user,
        None,
        params,
        (fields.get("device", "desktop"), "Windows", "en", ("Chrome",)),
        (fields.get("country", "Norway"), "r", "c"),
        (fields.get("source", "s"), fields.get("medium", "organic"), "n"),
        (fields.get("transaction_id"), fields.get("revenue")),
        None if "items" in fields and fields["items"] is None else items,
    )


@pytest.fixture(scope="session")
def raw(spark):
    """Makes a raw event table from ``event`` rows."""

    def make(*rows) -> DataFrame:
        return spark.createDataFrame(list(rows), RAW_EVENTS)

    return make


@pytest.fixture(scope="session")
def frame(spark):
    """Makes a table from dictionaries and a schema string."""

    def make(schema: str, *rows: tuple) -> DataFrame:
        return spark.createDataFrame(list(rows), schema)

    return make


def rows_of(df: DataFrame, *names: str) -> list[tuple]:
    return sorted((tuple(r) for r in df.select(*names).collect()), key=str)


def one(df: DataFrame) -> dict:
    (row,) = df.collect()
    return row.asDict()
