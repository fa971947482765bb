"""User-days: sessions folded by user, day, device and country; and the active days of a user as bitmaps.

Users, trends, equal windows and the dashboard's sessions are sums of user-days.  A user has no more of them than days
times places and devices, however many sessions there are, so a table of user-days can be kept together by user
without a task growing with one user's activity; what groups it by user then needs no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.functions.columns import MONEY

#: Days in a word of a bitmap: the bits of a long that arithmetic cannot push into its sign.
WORD_DAYS = 62

USER_DAY = ["user_pseudo_id", "session_date"]
SEGMENT = ["device_category", "country"]

#: How many sessions reached a step, by the flag that says so.
STEP_COUNTS = {
    "product_view_sessions": "reached_view_item",
    "add_to_cart_sessions": "reached_add_to_cart",
    "begin_checkout_sessions": "reached_begin_checkout",
    "add_shipping_sessions": "reached_add_shipping_info",
    "add_payment_sessions": "reached_add_payment_info",
    "purchasing_sessions": "purchased",
}

#: Sessions that reached a step and did not buy.
LEFT_COUNTS = {
    "cart_abandoned_sessions": "reached_add_to_cart",
    "checkout_abandoned_sessions": "reached_begin_checkout",
}

SUMS = ("sessions", "page_views", *STEP_COUNTS, *LEFT_COUNTS, "orders", "revenue")
LEAST = ("min_session_number", "first", "acq")


def build_user_days(sessions: DataFrame) -> DataFrame:
    """Sessions folded to (user, day, device, country); ``first`` is the earliest of them."""
    return sessions.groupBy(*USER_DAY, *SEGMENT).agg(
        F.count(F.lit(1)).alias("sessions"),
        F.sum("page_views").alias("page_views"),
        *[F.count_if(flag).alias(name) for name, flag in STEP_COUNTS.items()],
        *[F.count_if(F.col(flag) & ~F.col("purchased")).alias(name) for name, flag in LEFT_COUNTS.items()],
        F.sum("orders").alias("orders"),
        F.sum(F.col("revenue_usd").cast(MONEY)).alias("revenue"),
        F.min("ga_session_number").alias("min_session_number"),
        F.min(F.struct("session_start_ts", "ga_session_id")).alias("first"),
        F.min(F.struct("acq_channel", "acq_medium", "acq_source")).alias("acq"),
    )


def user_days(rows: DataFrame) -> DataFrame:
    """User-days as they are, or sessions folded to them."""
    return rows if "first" in rows.columns else build_user_days(rows)


def by_day(rows: DataFrame, *names: str) -> DataFrame:
    """One row per user and day with the sums of ``names``; of a table kept by user, without a shuffle."""
    return user_days(rows).groupBy(*USER_DAY).agg(*[F.sum(c).alias(c) for c in names])


# --- bitmaps of active days ---------------------------------------------------------


def words_for(days: int) -> int:
    """Words of a block that spans at least so many days."""
    return max(1, -(-days // WORD_DAYS))


def word(k: int) -> str:
    return f"days_{k}"


def day_number(day: str | Column) -> Column:
    return F.unix_date(day)


def day_bitmaps(days: DataFrame, words: int, key: str = "user_pseudo_id", day: str = "session_date") -> DataFrame:
    """(key, block, days_0, ...): the active days of a key, by blocks of ``words`` words; bit n is the block's day n.

    Bitmaps of one key and block are merged by ``bit_or`` and counted by ``bit_count``, whatever days they come from.
    A key has a row only for blocks in which it is active, and a block costs 8 bytes for 62 days.
    """
    span = words * WORD_DAYS
    number = day_number(day)
    block = F.floor(number / span).cast("int")
    at = F.pmod(number, F.lit(span))
    one = F.lit(1).cast("bigint")
    bits = [
        F.bit_or(
            F.when(F.floor(at / WORD_DAYS) == k, F.call_function("shiftleft", one, (at % WORD_DAYS).cast("int"))).otherwise(0)
        ).alias(word(k))
        for k in range(words)
    ]
    return days.groupBy(key, block.alias("block")).agg(*bits)


def merge_bitmaps(bitmaps: DataFrame, words: int, key: str = "user_pseudo_id") -> DataFrame:
    """Bitmaps of several sources as one."""
    return bitmaps.groupBy(key, "block").agg(*[F.bit_or(word(k)).alias(word(k)) for k in range(words)])


def _lowest(bits: Column) -> Column:
    """The number of the lowest bit; NULL where none is set."""
    alone = bits.bitwiseAND(-bits)
    return F.when(bits != 0, F.bit_count(alone - 1))


def _first_day(words: list[Column], block: Column) -> Column:
    """The number of the first active day of a block; NULL where there is none."""
    start = block.cast("bigint") * len(words) * WORD_DAYS
    return F.coalesce(*[start + k * WORD_DAYS + _lowest(w) for k, w in enumerate(words)])


def visit_days(bitmaps: DataFrame, words: int, key: str = "user_pseudo_id") -> DataFrame:
    """(key, active_days, first_day, next_day) from bitmaps: how many days, the first, and the next active one.

    ``next_day`` is NULL where it is more than a block's span (``words`` * 62 days) after the first.  A day within the
    span is in the first block or in the block after it, whose number has the other parity, so the first days of
    odd and of even blocks are all that must be kept: aggregates of fixed width, which combine in every task.
    """
    columns = [F.col(word(k)) for k in range(words)]
    lowest, rest, seen = [], [], F.lit(False)
    for w in columns:
        # Without the first active day of the block: that word loses its lowest bit, the words before it are empty.
        rest.append(F.when(seen | (w == 0), w).otherwise(w.bitwiseAND(w - 1)))
        lowest.append(w)
        seen = seen | (w != 0)
    block = F.col("block")
    per_block = bitmaps.select(
        key,
        (F.abs(block) % 2 == 0).alias("even"),
        sum((F.bit_count(w).cast("bigint") for w in columns[1:]), F.bit_count(columns[0]).cast("bigint")).alias("n"),
        _first_day(lowest, block).alias("first"),
        _first_day(rest, block).alias("second"),
    )
    merged = per_block.groupBy(key).agg(
        F.sum("n").alias("active_days"),
        F.min(F.when(F.col("even"), F.col("first"))).alias("even"),
        F.min(F.when(~F.col("even"), F.col("first"))).alias("odd"),
        F.min("second").alias("second"),
    )
    first = F.least("even", "odd")
    # least passes over NULLs; with blocks of one parity only, the other block's first day is not there.
    other = F.when(F.col("even").isNotNull() & F.col("odd").isNotNull(), F.greatest("even", "odd"))
    after = F.least("second", other)
    return merged.select(
        key,
        "active_days",
        F.date_from_unix_date(first.cast("int")).alias("first_day"),
        F.when(after - first <= words * WORD_DAYS, F.date_from_unix_date(after.cast("int"))).alias("next_day"),
    )
