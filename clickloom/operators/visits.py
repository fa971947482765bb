"""The visit number of every session, and the visits of each user that reports tell apart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.functions.columns import MONEY
from clickloom.functions.ranks import prefix_ranks
from clickloom.sources.tables import TableStore

#: Visits from this one on are counted together.
LATER = 3
VISIT_SUMS = ("sessions", "purchasing_sessions", "orders", "revenue")


def visit_numbers(sessions: DataFrame, store: TableStore | None = None) -> DataFrame:
    """Every session with its place among the user's sessions, by time (the session id settles equal times), from 1.

    A user with most of the sessions is numbered in as many tasks as those fill.
    """
    rows = sessions.select(
        "user_pseudo_id",
        "session_start_ts",
        "ga_session_id",
        "session_date",
        "purchased",
        "orders",
        F.col("revenue_usd").cast(MONEY).alias("revenue"),
    )
    order = ["session_start_ts", "ga_session_id"]
    return prefix_ranks(rows, "user_pseudo_id", order, "visit_number", store or TableStore(sessions.sparkSession))


def fold_visits(visits: DataFrame) -> DataFrame:
    """Numbered visits folded to at most three rows a user: the first, the second and the later ones.

    ``first_buy_visit`` and ``first_buy_date`` are the earliest visit with a purchase and the earliest date of one
    among a row's visits, NULL without a purchase.
    """
    bought = F.col("purchased")
    number = F.least("visit_number", F.lit(LATER))
    return visits.groupBy("user_pseudo_id", number.alias("visit_number")).agg(
        F.count(F.lit(1)).alias("sessions"),
        F.count_if(bought).alias("purchasing_sessions"),
        F.sum("orders").alias("orders"),
        F.sum("revenue").alias("revenue"),
        F.min(F.when(bought, F.col("visit_number"))).alias("first_buy_visit"),
        F.min(F.when(bought, F.col("session_date"))).alias("first_buy_date"),
    )


def user_visits(rows: DataFrame) -> DataFrame:
    """Folded visits as they are, or sessions numbered and folded to them."""
    return rows if "first_buy_visit" in rows.columns else fold_visits(visit_numbers(rows))
