"""The derived tables of one event source.

Each table is built on first use from the tables before it.  With a store it is
written as Parquet and read back, so that later stages scan only the columns and
dates they need and losing an executor never replays the whole history; without
one the tables stay lazy and everything is one plan.

Tables with a bounded number of rows a user (user-days, users, a user's visits) are
kept by user, so that they meet and are grouped by user without a shuffle.  With
``by_date``, events and sessions are written as a directory for each day, so that
reports on a range of days open only these.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from clickloom.config import AnalyticsConfig
from clickloom.operators import facts, funnel, product, quality, season, sessions, userdays, users, visits
from clickloom.operators.metrics import Dashboard
from clickloom.sources.tables import TableStore


class Workspace:
    def __init__(
        self,
        spark: SparkSession,
        raw: DataFrame,
        cfg: AnalyticsConfig,
        store: TableStore | None = None,
        by_date: bool = False,
    ):
        self.spark = spark
        self.raw = raw
        self.cfg = cfg
        self.store = store
        self.by_date = by_date

    def _table(self, name: str, df: DataFrame, partition_by: str | None = None) -> DataFrame:
        return df if self.store is None else self.store.build(name, df, partition_by)

    def _dated(self, name: str, df: DataFrame, day: str) -> DataFrame:
        return self._table(name, df, day if self.by_date else None)

    def _by_user(self, name: str, df: DataFrame) -> DataFrame:
        return df if self.store is None else self.store.build(name, df, bucket_by="user_pseudo_id")

    @cached_property
    def events(self) -> DataFrame:
        return self._dated("events_clean", sessions.clean_events(self.raw), "event_date")

    @cached_property
    def event_profile(self) -> DataFrame:
        return self._table("event_profile", quality.event_profile(self.events, self.cfg))

    @cached_property
    def first_touch(self) -> DataFrame:
        return self._table("first_touch", sessions.first_touch(self.events, self.cfg))

    @cached_property
    def sessions(self) -> DataFrame:
        built = sessions.build_sessions(self.events, self.cfg, self.first_touch)
        return self._dated("sessions", built, "session_date")

    @cached_property
    def user_days(self) -> DataFrame:
        return self._by_user("user_days", userdays.build_user_days(self.sessions))

    @cached_property
    def users(self) -> DataFrame:
        return self._by_user("users", users.users_of(self.user_days, self.cfg))

    @cached_property
    def visit_numbers(self) -> DataFrame:
        return self._table("visit_numbers", visits.visit_numbers(self.sessions, self.store))

    @cached_property
    def user_visits(self) -> DataFrame:
        return self._by_user("user_visits", visits.fold_visits(self.visit_numbers))

    @cached_property
    def cart_sessions(self) -> DataFrame:
        # A date filter on a stored table: reading it again costs less than storing it twice.
        return funnel.cart_window_sessions(self.sessions, self.cfg)

    @cached_property
    def cart_users(self) -> DataFrame:
        return self._table("users_cart_window", funnel.cart_window_users(self.cart_sessions))

    @cached_property
    def aliases(self) -> DataFrame:
        return product.item_aliases(self.spark, self.cfg)

    @cached_property
    def item_activity(self) -> DataFrame:
        return self._table("item_activity", product.item_activity(self.raw, self.aliases, self.cfg))

    @cached_property
    def product_rates(self) -> DataFrame:
        totals = product.product_totals(self.item_activity, self.cfg)
        return self._table("product_rates", product.product_rates(totals, self.cfg))

    @cached_property
    def products(self) -> DataFrame:
        return self._table("products", product.product_quadrants(self.product_rates, self.cfg))

    @cached_property
    def periods(self) -> DataFrame:
        return season.season_periods(self.spark, self.cfg)

    @cached_property
    def dim_date(self) -> DataFrame:
        return facts.dim_date(self.spark, self.periods, self.cfg)

    @cached_property
    def fact_sessions(self) -> DataFrame:
        return self._table("fact_sessions", facts.fact_sessions(self.user_days, self.users, self.cfg))

    @cached_property
    def fact_product_daily(self) -> DataFrame:
        daily = facts.fact_product_daily(self.item_activity, self.products, self.cfg)
        return self._table("fact_product_daily", daily)

    @cached_property
    def fact_cohort_daily(self) -> DataFrame:
        return self._table("fact_cohort_daily", facts.fact_cohort_daily(self.users, self.cfg))

    @cached_property
    def funnel_stages(self) -> DataFrame:
        return facts.funnel_stages(self.spark, self.cfg)

    @property
    def dashboard(self) -> Dashboard:
        return Dashboard(
            sessions=self.fact_sessions,
            products_daily=self.fact_product_daily,
            cohorts=self.fact_cohort_daily,
            dates=self.dim_date,
            products=self.products,
            stages=self.funnel_stages,
        )
