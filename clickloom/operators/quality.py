"""Data quality reports.

All but the one on obscured values, which reads columns that nothing else does, come from one profile of the
clean events, so a job reads the raw events once for them and once for the obscured values.  Obscured and missing
values are counted and reported, never dropped.  The functions named dq_ take raw events and profile them first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.config import AnalyticsConfig
from clickloom.functions.columns import MONEY, int_param, pct, ratio, share_of_total, string_param, with_one_row
from clickloom.functions.sketches import distinct_sketches, merged_distinct
from clickloom.operators.sessions import clean_events


#: Purchase events by what is wrong with them; the names of counts in the profile.
ODD_PURCHASES = ("null_transaction_id", "not_set_transaction_id", "null_revenue", "zero_revenue")


def event_profile(events: DataFrame, cfg: AnalyticsConfig) -> DataFrame:
    """Clean events folded to (day, name, user): the counts, sums and extremes of which the reports are made.

    Everything in it is a sum, a least or a greatest value, so profiles of several days, or of parts of a day, are
    merged by folding them again, and distinct users are counted among far fewer rows than there are events.
    """
    buys = F.col("event_name") == "purchase"
    revenue = F.when(buys, F.col("purchase_revenue_usd"))
    odd = {
        "null_transaction_id": F.col("transaction_id").isNull(),
        "not_set_transaction_id": F.col("transaction_id") == cfg.missing_transaction_id,
        "null_revenue": F.col("purchase_revenue_usd").isNull(),
        "zero_revenue": F.col("purchase_revenue_usd") == 0,
    }
    return events.groupBy("event_date", "event_name", "user_pseudo_id").agg(
        F.count(F.lit(1)).alias("events"),
        F.count_if(F.col("ga_session_id").isNull()).alias("missing_session_id"),
        F.min("ga_session_number").alias("min_session_number"),
        *[F.count_if(buys & test).alias(name) for name, test in odd.items()],
        F.sum(revenue.cast(MONEY)).alias("revenue"),
        F.count(revenue).alias("with_revenue"),
        F.min(revenue).alias("min_revenue"),
        F.max(revenue).alias("max_revenue"),
    )


def _profile(raw: DataFrame, cfg: AnalyticsConfig | None = None) -> DataFrame:
    return event_profile(clean_events(raw), cfg or AnalyticsConfig())


def dq_overview(raw: DataFrame) -> DataFrame:
    """Size and coverage of raw events, in one row."""
    return overview(_profile(raw), clean_events(raw))


def overview(profile: DataFrame, events: DataFrame) -> DataFrame:
    """Size and coverage of the data, in one row.

    Sessions are counted up level by level (session, user, total) from clean events, as a distinct count of pairs
    would multiply every event.
    """
    users = profile.groupBy("user_pseudo_id").agg(F.sum("events").alias("events"))
    totals = users.agg(
        F.coalesce(F.sum("events"), F.lit(0)).alias("total_events"), F.count("user_pseudo_id").alias("users")
    )
    days = profile.groupBy("event_date").agg(F.count(F.lit(1)).alias("rows")).agg(
        F.count(F.lit(1)).alias("daily_tables"),
        F.min("event_date").alias("first_date"),
        F.max("event_date").alias("last_date"),
    )
    known = F.col("user_pseudo_id").isNotNull() & F.col("ga_session_id").isNotNull()
    sessions = events.where(known).select("user_pseudo_id", "ga_session_id").distinct()
    counted = sessions.agg(F.count(F.lit(1)).alias("sessions_with_id"))
    return with_one_row(with_one_row(totals, days), counted).select(
        "total_events", "daily_tables", "first_date", "last_date", "users", "sessions_with_id"
    )


def _reach(profile: DataFrame, by: str, *counts: str) -> DataFrame:
    """Sums of the counts and the number of users, by name or day; users are told apart before they are counted."""
    per_user = profile.groupBy(by, "user_pseudo_id").agg(*[F.sum(c).alias(c) for c in ("events", *counts)])
    return per_user.groupBy(by).agg(
        F.sum("events").alias("events"),
        F.count("user_pseudo_id").alias("users"),
        F.sum(F.when(F.col("user_pseudo_id").isNull(), F.col("events")).otherwise(0)).alias("missing_user"),
        *[F.sum(c).alias(c) for c in counts],
    )


def dq_events_by_name(raw: DataFrame) -> DataFrame:
    """Volume, share and reach of each event name."""
    return events_by_name(_profile(raw))


def events_by_name(profile: DataFrame, sketches: DataFrame | None = None) -> DataFrame:
    """From the profile, or approximately from the user sketches of the days that are asked for."""
    if sketches is None:
        counts = _reach(profile, "event_name")
    else:
        counts = merged_distinct(sketches, ["event_name"], F.sum("events").alias("events")).withColumnRenamed(
            "distinct", "users"
        )
    return counts.select("event_name", "events", share_of_total("events").alias("pct_of_events"), "users")


def dq_daily_events(raw: DataFrame) -> DataFrame:
    """Events and users per day."""
    return daily_events(_profile(raw))


def user_sketches(profile: DataFrame) -> DataFrame:
    """(event_date, event_name, sketch, events): the users of each name and day as mergeable sketches."""
    return distinct_sketches(profile, ["event_date", "event_name"], "user_pseudo_id", F.sum("events").alias("events"))


def daily_events(profile: DataFrame, sketches: DataFrame | None = None) -> DataFrame:
    """From the profile, or approximately from user sketches."""
    if sketches is not None:
        return merged_distinct(sketches, ["event_date"], F.sum("events").alias("events")).select(
            "event_date", "events", F.col("distinct").alias("users")
        )
    return _reach(profile, "event_date").select("event_date", "events", "users")


def inspected_columns() -> dict[str, Column]:
    """The columns checked for obscured values, all as strings."""
    return {
        "device_category": F.col("device.category"),
        "device_os": F.col("device.operating_system"),
        "browser": F.col("device.web_info.browser"),
        "device_language": F.col("device.language"),
        "country": F.col("geo.country"),
        "region": F.col("geo.region"),
        "city": F.col("geo.city"),
        "acq_source": F.col("traffic_source.source"),
        "acq_medium": F.col("traffic_source.medium"),
        "acq_campaign": F.col("traffic_source.name"),
        "user_id": F.col("user_id"),
        "ga_session_id": int_param("ga_session_id").cast("string"),
        "ga_session_number": int_param("ga_session_number").cast("string"),
        "page_location": string_param("page_location"),
    }


def dq_obscured_values(raw: DataFrame, columns: dict[str, Column] | None = None) -> DataFrame:
    """Per column, how many values are NULL or one of the placeholders.

    All counts are taken in one wide aggregate; only its single row is turned into
    one row per column.
    """
    columns = columns or inspected_columns()
    kinds = {
        "null_rows": lambda v: v.isNull(),
        "empty_rows": lambda v: v == "",
        "data_deleted_rows": lambda v: v == "(data deleted)",
        "other_rows": lambda v: v == "<Other>",
        "not_set_rows": lambda v: v == "(not set)",
    }
    values = raw.select(*[value.alias(name) for name, value in columns.items()])
    wide = values.agg(
        F.count(F.lit(1)).alias("rows_checked"),
        *[F.count_if(test(F.col(name))).alias(f"{name}__{kind}") for name in columns for kind, test in kinds.items()],
    )
    long = wide.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(name).alias("column_name"),
                        F.col("rows_checked"),
                        *[F.col(f"{name}__{kind}").alias(kind) for kind in kinds],
                    )
                    for name in columns
                ]
            )
        )
    )
    unusable = sum((F.col(kind) for kind in list(kinds)[1:]), F.col("null_rows"))
    return long.select(
        "*",
        *[pct(f"{kind}_rows", "rows_checked").alias(f"{kind}_pct") for kind in ("null", "data_deleted", "other", "not_set")],
        pct(unusable, "rows_checked").alias("unusable_pct"),
    )


def dq_funnel_events(raw: DataFrame, cfg: AnalyticsConfig) -> DataFrame:
    """Volume and reach of the funnel events, and how many lack a user or session id."""
    return funnel_events(_profile(raw, cfg), cfg)


def funnel_events(profile: DataFrame, cfg: AnalyticsConfig) -> DataFrame:
    counts = _reach(profile.where(F.col("event_name").isin(*cfg.funnel_events)), "event_name", "missing_session_id")
    return counts.select(
        "event_name",
        "events",
        "users",
        F.col("missing_user").alias("events_missing_user"),
        F.col("missing_session_id").alias("events_missing_session_id"),
        pct("missing_session_id", "events").alias("missing_session_id_pct"),
    )


def dq_purchases(raw: DataFrame, cfg: AnalyticsConfig) -> DataFrame:
    """Repeated ids, missing ids and the revenue range of purchase events."""
    return purchases(_profile(raw, cfg), clean_events(raw))


def purchases(profile: DataFrame, events: DataFrame) -> DataFrame:
    """Everything from the profile but the distinct transaction ids, which need the purchase events."""
    buys = F.col("event_name") == "purchase"
    totals = profile.where(buys).agg(
        F.coalesce(F.sum("events"), F.lit(0)).alias("purchase_events"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in (*ODD_PURCHASES, "with_revenue")],
        F.sum("revenue").cast("double").alias("revenue"),
        F.min("min_revenue").alias("min_revenue"),
        F.max("max_revenue").alias("max_revenue"),
    )
    ids = events.where(buys & F.col("transaction_id").isNotNull()).select("transaction_id").distinct()
    distinct = ids.agg(F.count(F.lit(1)).alias("distinct_transactions"))
    return with_one_row(totals, distinct).select(
        "purchase_events",
        "distinct_transactions",
        (F.col("purchase_events") - F.col("distinct_transactions")).alias("duplicate_or_null_id_events"),
        "null_transaction_id",
        "not_set_transaction_id",
        "null_revenue",
        "zero_revenue",
        F.round("revenue", 2).alias("total_revenue_usd"),
        F.round("min_revenue", 2).alias("min_revenue_usd"),
        ratio("revenue", "with_revenue", 2).alias("avg_revenue_usd"),
        F.round("max_revenue", 2).alias("max_revenue_usd"),
    )


def dq_daily_tracking(raw: DataFrame, cfg: AnalyticsConfig) -> DataFrame:
    """Does each funnel event fire steadily?  Counts per day."""
    return daily_tracking(_profile(raw, cfg))


def daily_tracking(profile: DataFrame) -> DataFrame:
    tracked = ("view_item", "add_to_cart", "begin_checkout", "add_payment_info", "purchase")

    def of(name: str) -> Column:
        return F.sum(F.when(F.col("event_name") == name, F.col("events")).otherwise(0)).alias(f"{name}_events")

    return profile.groupBy("event_date").agg(
        *[of(name) for name in tracked],
        F.sum(F.col("null_transaction_id") + F.col("not_set_transaction_id")).alias("purchase_events_without_id"),
        F.sum(F.col("null_revenue") + F.col("zero_revenue")).alias("purchase_events_zero_revenue"),
    )


def dq_new_vs_returning(raw: DataFrame) -> DataFrame:
    """How many users already look returning the first time they are seen."""
    return new_vs_returning(_profile(raw))


def new_vs_returning(profile: DataFrame) -> DataFrame:
    lowest = profile.groupBy("user_pseudo_id").agg(F.min("min_session_number").alias("number"))
    counts = lowest.agg(
        F.count(F.lit(1)).alias("users"),
        F.count_if(F.col("number") == 1).alias("new_in_period"),
        F.count_if(F.col("number") > 1).alias("returning_at_first_sight"),
        F.count_if(F.col("number").isNull()).alias("unknown_session_number"),
    )
    return counts.withColumn("returning_at_first_sight_pct", pct("returning_at_first_sight", "users"))
