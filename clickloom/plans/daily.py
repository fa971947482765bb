"""The derived tables, kept up to date day by day.

An instalment is any set of days: the next one, one that comes late, or one that is delivered again.  What is folded
by day (clean events, their profile, the parts of sessions, of first touches and of orders) replaces that day's
directories.  Orders are told from repeated purchases by a table of the order ids seen so far, not by the purchases
of all days.  Sessions are put together again, from folded parts, for the users whom the instalment touches, and only
the days on which one of them comes out different are written.  Events of other days are never read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from datetime import date

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickloom.config import AnalyticsConfig
from clickloom.operators import quality, sessions, userdays, users
from clickloom.plans.workspace import Workspace
from clickloom.sources.tables import TableStore

USER = "user_pseudo_id"

#: The day by which each table is kept.
DAYS = {
    "events_clean": "event_date",
    "event_profile": "event_date",
    "session_parts": "event_date",
    "touch_parts": "event_date",
    "order_parts": "event_date",
    "orders": "event_date",
    "sessions": "session_date",
    "user_days": "session_date",
}


class DailyTables:
    def __init__(self, spark: SparkSession, folder: str, cfg: AnalyticsConfig):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self.cfg = cfg
        self._schemas: dict[str, T.StructType] = {}

    # --- tables by day ----------------------------------------------------------

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def read(self, name: str, like: DataFrame | None = None) -> DataFrame:
        """A table as it is; one without rows has the columns of ``like``, or of the last instalment's rows."""
        schema = self._schemas.get(name) if like is None else like.schema
        try:
            table = self.spark.read.parquet(self.path(name))
        except AnalysisException:  # no instalment has written a row of it
            if schema is None:
                raise
            return self.spark.createDataFrame([], schema)
        return table if schema is None else table.select(*schema.fieldNames())

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)

    def _replace(self, name: str, rows: DataFrame, days: Iterable[date]) -> None:
        """Put rows in the place of what the table has on these days; a day without rows goes."""
        self._put(name, self._staged(name, rows), days)

    def _put(self, name: str, staged: DataFrame, days: Iterable[date]) -> None:
        """The same with rows that are written aside already."""
        day = DAYS[name]
        left = {r[0] for r in staged.select(day).distinct().collect()}
        writer = staged.hint("rebalance", day).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy(day).parquet(self.path(name))
        for gone in set(days) - left:
            self._delete(f"{self.path(name)}/{day}={gone.isoformat()}")

    def _staged(self, name: str, rows: DataFrame) -> DataFrame:
        """Rows written aside, so that a table can be read while its new days are made."""
        path = f"{self.folder}/_staged/{name}-{uuid.uuid4().hex}"
        rows.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    # --- an instalment -----------------------------------------------------------

    def ingest(self, raw: DataFrame, days: Iterable[date]) -> list[date]:
        """Take in the raw events of some days, and return the days on which a session came out different.

        A run that breaks off is to be run again with the same days: what it touches is written down before any table
        changes, and worked off by the next run.
        """
        days = sorted(set(days))
        if not days:
            return []
        some = raw.where(F.col("event_date").isin(*[d.strftime("%Y%m%d") for d in days]))
        new = self._staged("events_clean", sessions.clean_events(some))
        parts = {
            "event_profile": self._by_day(quality.event_profile(new, self.cfg)),
            "session_parts": self._by_day(sessions.fold_activity(new, "event_date")),
            "touch_parts": self._by_day(sessions.touch_times(new, "event_date")),
            "order_parts": self._by_day(self._orders_of_days(new)),
        }
        # Each is read several times below: by the ids, the users, and the table it goes to.
        parts = {name: self._staged(name, part) for name, part in parts.items()}
        self._schemas = {name: part.schema for name, part in parts.items()} | {"orders": parts["order_parts"].schema}
        in_days = F.col("event_date").isin(*days)
        before = {name: self.read(name, part).where(in_days) for name, part in parts.items()}
        ids = self._touched_ids(before["order_parts"], parts["order_parts"])
        touched = self._touched_users(before["session_parts"], parts["session_parts"], ids, parts["order_parts"])

        self._put("events_clean", new, days)
        for name, part in parts.items():
            self._put(name, part, days)
        self._update_orders(ids, days)
        changed = self._update_sessions(self._staged("touched", touched))
        self._delete(f"{self.folder}/_pending")
        self._delete(f"{self.folder}/_staged")
        return changed

    def _by_day(self, part: DataFrame) -> DataFrame:
        return part.select(*[c for c in part.columns if c != "event_date"], "event_date")

    def _orders_of_days(self, events: DataFrame) -> DataFrame:
        """Each day's orders: the earliest event of an id on that day, and purchases without an id."""
        columns = [*sessions.ORDER_COLUMNS, "event_ts", USER]
        decided = F.struct("event_ts", USER, "ga_session_id", "purchase_revenue_usd")
        buys = events.where(F.col("event_name") == "purchase").select("transaction_id", *columns)
        no_id = F.coalesce(F.col("transaction_id") == self.cfg.missing_transaction_id, F.lit(True))
        first = buys.where(~no_id).groupBy("transaction_id", "event_date").agg(F.min(decided).alias("e"))
        first = first.select("transaction_id", "e.ga_session_id", "event_date", "e.purchase_revenue_usd", "e.event_ts", f"e.{USER}")
        return first.unionByName(buys.where(no_id & (F.col("purchase_revenue_usd") > 0)))

    def _known(self, orders: DataFrame) -> DataFrame:
        return orders.where(F.col("transaction_id").isNotNull() & (F.col("transaction_id") != self.cfg.missing_transaction_id))

    def _pending(self, name: str, rows: DataFrame) -> DataFrame:
        """Distinct rows, with those that runs before this one wrote down and did not come to work off."""
        path = f"{self.folder}/_pending/{name}"
        self._staged(name, rows.distinct()).write.mode("append").parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path).distinct()

    def _touched_ids(self, before: DataFrame, now: DataFrame) -> DataFrame:
        """(transaction_id, seen): ids of the instalment, as it was and as it is, and whether another day has them too.

        Ids not seen yet, which are nearly all of a new day's, need nothing from other days.
        """
        found = self._known(before).select("transaction_id").union(self._known(now).select("transaction_id"))
        ids = self._pending("ids", found)
        seen = self._known(self.read("orders", now)).select("transaction_id").distinct()
        fresh = ids.join(seen, "transaction_id", "left_anti").withColumn("seen", F.lit(False))
        return self._staged("ids", fresh.unionByName(ids.join(seen, "transaction_id", "left_semi").withColumn("seen", F.lit(True))))

    def _touched_users(self, before: DataFrame, now: DataFrame, ids: DataFrame, orders: DataFrame) -> DataFrame:
        """Users of the instalment, as it was and as it is, and users whose order it may move."""
        found = before.select(USER).union(now.select(USER))
        moved = self.read("order_parts", orders).join(ids.where("seen"), "transaction_id", "left_semi").select(USER)
        return self._pending("users", found.union(moved).where(F.col(USER).isNotNull()))

    def _update_orders(self, ids: DataFrame, days: list[date]) -> None:
        """Orders of the ids and days of the instalment; those of other ids and days stay."""
        parts = self.read("order_parts")
        in_days = F.col("event_date").isin(*days)
        fresh = self._known(parts.where(in_days)).join(ids.where("not seen"), "transaction_id", "left_semi")
        again = self._known(parts).join(ids.where("seen"), "transaction_id", "left_semi")
        decided = F.struct("event_ts", USER, "ga_session_id", "purchase_revenue_usd", "event_date")
        first = fresh.unionByName(again).groupBy("transaction_id").agg(F.min(decided).alias("e")).select("transaction_id", "e.*")
        known = F.col("transaction_id").isNotNull() & (F.col("transaction_id") != self.cfg.missing_transaction_id)
        without = parts.where(in_days & ~F.coalesce(known, F.lit(False)))
        new = self._staged("new_orders", first.select(*parts.columns).unionByName(without))
        old = self.read("orders", parts)
        gone = old.join(ids, "transaction_id", "left_semi").unionByName(old.where(in_days & ~F.coalesce(known, F.lit(False))))
        gone = self._staged("old_orders", gone)
        written = {r[0] for r in new.select("event_date").union(gone.select("event_date")).distinct().collect()} | set(days)
        here = F.col("event_date").isin(*written)
        kept = old.where(here).join(ids, "transaction_id", "left_anti")
        kept = kept.where(F.coalesce(known, F.lit(False)) | ~in_days)
        self._replace("orders", kept.unionByName(new), written)

    def _update_sessions(self, touched: DataFrame) -> list[date]:
        """Sessions of the touched users, put together again, and user-days of the days that differ."""
        of_users = lambda name: self.read(name).join(touched, USER, "left_semi")
        activity = sessions.merge_activity(of_users("session_parts").drop("event_date"))
        touch = sessions.pick_touch(of_users("touch_parts"), self.cfg)
        rebuilt = self._staged("rebuilt", sessions.finish_sessions(activity, of_users("orders"), touch, self.cfg))
        every = self.read("sessions", rebuilt)
        old = every.join(touched, USER, "left_semi")
        # A row that is not there as often on both sides differs; one grouping sees it from either side.
        both = rebuilt.withColumn("_n", F.lit(1)).unionByName(old.withColumn("_n", F.lit(-1)))
        differ = both.groupBy(*rebuilt.columns).agg(F.sum("_n").alias("_n")).where(F.col("_n") != 0)
        differ = differ.select("session_date")
        days = sorted(r[0] for r in differ.distinct().collect())
        if days:
            here = F.col("session_date").isin(*days)
            others = every.where(here).join(touched, USER, "left_anti")
            self._replace("sessions", others.unionByName(rebuilt.where(here)), days)
            folded = userdays.build_user_days(self.read("sessions").where(here))
            self._replace("user_days", folded, days)
        return days

    # --- what is read --------------------------------------------------------------

    def workspace(self, raw: DataFrame, store: TableStore | None = None) -> Workspace:
        """A workspace over the tables as they are: its reports read them, and build only what is not kept by day."""
        ws = Workspace(self.spark, raw, self.cfg, store or TableStore(self.spark, f"{self.folder}/reports-{uuid.uuid4().hex}"))
        kept = {"events": "events_clean", "event_profile": "event_profile", "sessions": "sessions", "user_days": "user_days"}
        ws.__dict__ |= {name: self.read(table) for name, table in kept.items()}
        ws.__dict__["users"] = users.users_of(ws.user_days, self.cfg)
        return ws
