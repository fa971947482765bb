"""The daily tables and orders, kept up with a folder of event files that keeps growing."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from clickloom.config import AnalyticsConfig
from clickloom.operators.sessions import clean_events
from clickloom.plans.daily import DailyTables
from clickloom.schema import RAW_EVENTS
from clickloom.sources.events import read_events


def stream_events(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """Raw events of a folder with a directory per day, as files arrive."""
    return spark.readStream.schema(RAW_EVENTS).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def follow_days(spark: SparkSession, path: str, tables: DailyTables, checkpoint: str, files_per_batch: int = 1000) -> StreamingQuery:
    """Take every day for which files have come since the last run into the daily tables.

    A batch says which days have new files; these days are then read whole and replaced, so a file that comes late,
    a batch that is run again after a failure, and a file that two batches see give the tables that one build gives.
    Only the days' names pass through the driver.
    """

    def take_in(batch: DataFrame, _: int) -> None:
        named = [r[0] for r in batch.select("event_date").distinct().collect() if r[0] is not None]
        days = [datetime.strptime(name, "%Y%m%d").date() for name in named]
        if days:
            tables.ingest(read_events(spark, path, min(days), max(days)), days)

    stream = stream_events(spark, path, files_per_batch)
    return stream.writeStream.foreachBatch(take_in).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_orders(events: DataFrame, cfg: AnalyticsConfig, delay: str = "3 days") -> DataFrame:
    """Orders as they arrive: the first purchase seen of each transaction id, and id-less purchases with revenue.

    ``events`` is a stream of clean events.  Ids are remembered for ``delay`` after the latest event time, which bounds
    the state; a repeat that is later than that counts again.  Unlike the batch orders, which take the earliest event,
    an id keeps the event that arrived first, as the earlier one may not have come yet.
    """
    buys = events.where(F.col("event_name") == "purchase").withWatermark("event_ts", delay)
    no_id = F.coalesce(F.col("transaction_id") == cfg.missing_transaction_id, F.lit(True))
    # Id-less purchases get a key of their own, so that one stateful step serves both kinds.
    own = F.concat_ws("|", F.lit("no id"), F.col("user_pseudo_id"), F.col("event_ts").cast("string"), F.uuid())
    kept = buys.where(~no_id | (F.col("purchase_revenue_usd") > 0)).withColumn("_key", F.when(no_id, own).otherwise(F.col("transaction_id")))
    orders = kept.dropDuplicatesWithinWatermark(["_key"])
    return orders.select("transaction_id", "event_ts", "user_pseudo_id", "ga_session_id", "event_date", "purchase_revenue_usd")


def follow_orders(
    spark: SparkSession, path: str, out: str, cfg: AnalyticsConfig, checkpoint: str, delay: str = "3 days", files_per_batch: int = 1000
) -> StreamingQuery:
    """Write the orders of new event files to a folder."""
    orders = stream_orders(clean_events(stream_events(spark, path, files_per_batch)), cfg, delay)
    writer = orders.writeStream.outputMode("append").option("checkpointLocation", checkpoint).option("path", out)
    return writer.format("parquet").trigger(availableNow=True).start()
