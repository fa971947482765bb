"""Adapters: raw event tables made from the generic sample tables.

Each adapter only renames, computes and joins, so that every row of its input
becomes at least one event.  They give the operators three differently shaped
inputs: a clickstream, a long order history, and events that carry items.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.config import AnalyticsConfig, SeasonPeriod
from clickloom.schema import ITEM, RAW_EVENTS

MICROS = 1_000_000


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def _param(key: str, string_value: Column | None = None, int_value: Column | None = None) -> Column:
    return F.struct(
        F.lit(key).alias("key"),
        F.struct(
            (F.lit(None) if string_value is None else string_value).cast("string").alias("string_value"),
            (F.lit(None) if int_value is None else int_value).cast("bigint").alias("int_value"),
        ).alias("value"),
    )


def _raw(df: DataFrame, params: list[Column], **fields: Column) -> DataFrame:
    """Wrap flat columns into the nested raw event layout; a field left out is NULL."""

    def f(name: str) -> Column:
        return fields.get(name, F.lit(None)).cast("string").alias(name)

    return df.select(
        fields["event_date"].alias("event_date"),
        fields["event_timestamp"].alias("event_timestamp"),
        fields["event_name"].alias("event_name"),
        fields["user_pseudo_id"].cast("string").alias("user_pseudo_id"),
        F.lit(None).cast("string").alias("user_id"),
        # Events without a session id carry no session parameters at all.
        F.filter(F.array(*params), lambda p: p["key"].isNotNull()).alias("event_params"),
        F.struct(
            f("category"), f("operating_system"), f("language"), F.struct(f("browser")).alias("web_info")
        ).alias("device"),
        F.struct(f("country"), f("region"), f("city")).alias("geo"),
        F.struct(f("source"), f("medium"), f("name")).alias("traffic_source"),
        F.struct(
            f("transaction_id"),
            fields.get("revenue", F.lit(None)).cast("double").alias("purchase_revenue_in_usd"),
        ).alias("ecommerce"),
        fields.get("items", F.array()).cast(ITEM_ARRAY).alias("items"),
    )


ITEM_ARRAY = RAW_EVENTS["items"].dataType


def _pick(index: Column, *values: str) -> Column:
    """The value at a zero-based index."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


# --- clickstream -----------------------------------------------------------------

CLICKSTREAM = AnalyticsConfig(
    first_date=date(2024, 1, 1),
    last_date=date(2024, 1, 30),
    cart_reliable_from=date(2024, 1, 8),
    revenue_reliable_until=date(2024, 1, 28),
    return_windows=(1, 3),
    season_periods=(
        SeasonPeriod(1, "Early January (baseline)", date(2024, 1, 1), date(2024, 1, 7), True),
        SeasonPeriod(2, "Second week", date(2024, 1, 12), date(2024, 1, 18), True),
        SeasonPeriod(3, "Third week", date(2024, 1, 19), date(2024, 1, 27), True),
        SeasonPeriod(8, "Last days (not compared)", date(2024, 1, 28), date(2024, 1, 30), False),
        SeasonPeriod(9, "Between (not compared)", date(2024, 1, 8), date(2024, 1, 11), False),
    ),
    source_min_users=3,
    country_min_users=5,
)


#: Visitors that ``visitors`` makes of a user of the sample, and days on which its cart tracking is out.
VISITORS = 8
CART_OUT = (9, 17)


def visitors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as website events of many visitors with few events each.

    Unlike the clickstream, not everybody reaches every step, sessions are weeks, some visitors' session numbers fall,
    many purchases have no id and few different values, and there are days without cart events.
    """
    return clickstream(spark, sf_dir, VISITORS)


def clickstream(spark: SparkSession, sf_dir: str, split: int = 1) -> DataFrame:
    """``events`` as website events: sessions are user-days (``split``: see ``visitors``)."""
    customers = _table(spark, sf_dir, "customer").join(
        _table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left"
    )
    events = (
        _table(spark, sf_dir, "events")
        .withColumn("k", F.get_json_object("props", "$.k").cast("int"))
        .withColumn("day", F.date_diff(F.col("ts").cast("date"), F.lit(date(2024, 1, 1))))
        .join(customers.select("c_custkey", "n_name"), F.col("user_id") == F.col("c_custkey"), "left")
        .withColumn("user_id", F.col("user_id") * split + F.col("event_id") % split)
    )
    many = split > 1
    k, user, day, kind = F.col("k"), F.col("user_id"), F.col("day"), F.col("event_type")
    name = (
        F.when(kind == "purchase", "purchase")
        .when(kind == "view", F.when(k < 80, "view_item").otherwise("session_start"))
        .when(kind == "click", F.when(k < 60, "add_to_cart").otherwise("page_view"))
        .when(kind == "signup", F.when(k < 70, "begin_checkout").otherwise("add_shipping_info"))
        .when(kind == "error", F.when(k < 50, "add_payment_info").otherwise("page_view"))
    )
    if many:
        name = F.when((name == "add_to_cart") & day.isin(*CART_OUT), "page_view").otherwise(name)
    buys = kind == "purchase"
    first_id = 40 if many else 10
    transaction = F.when(
        buys & (k >= first_id),
        F.when(k < first_id + 5, "(not set)").otherwise(F.concat_ws("-", user.cast("string"), k.cast("string"))),
    )
    value = F.when(k < first_id, (k % 3).cast("double") * 5).otherwise(F.col("value")) if many else F.col("value")
    revenue = F.when(buys, F.when((k < 15) & (k % 2 == 0), 0.0).otherwise(value))
    medium = F.when(user % 7 == 0, _pick(k % 2, "<Other>", "(data deleted)")).otherwise(
        F.when(
            k % 8 != 7,
            _pick(k % 8, "<Other>", "(data deleted)", "organic", "cpc", "referral", "(none)", "organic", ""),
        )
    )
    # A session id is missing on some events, and then so is the session number.
    known = F.col("event_id") % 97 != 0
    session_id = F.date_format("ts", "yyyyMMdd").cast("bigint")
    session_number = F.greatest(F.lit(1), day - 3) + F.when(user % 10 == 0, 1).otherwise(0)
    if many:
        session_id = F.floor(day / 7).cast("bigint")
        session_number = F.when(user % 10 == 3, 40 - day).otherwise(session_number)
    return _raw(
        events,
        [
            F.when(known, _param("ga_session_id", int_value=session_id)),
            F.when(known, _param("ga_session_number", int_value=session_number)),
            _param("page_location", string_value=F.when(k % 5 != 0, F.concat(F.lit("/page/"), k.cast("string")))),
        ],
        event_date=F.date_format("ts", "yyyyMMdd"),
        event_timestamp=_micros(F.col("ts")),
        event_name=name,
        user_pseudo_id=user,
        category=_pick((user + day) % 3, "desktop", "mobile", "tablet"),
        operating_system=_pick(k % 4, "Windows", "Android", "<Other>", "iOS"),
        language=F.when(k % 3 != 0, _pick(k % 2, "en-us", "")),
        browser=_pick(k % 5, "Chrome", "Safari", "<Other>", "Firefox", "Edge"),
        country=F.col("n_name"),
        region=_pick(k % 6, "(not set)", "North", "South", "East", "West", ""),
        city=_pick(k % 10, "(not set)", "(not set)", "(data deleted)", "A", "B", "C", "D", "E", "F", "<Other>"),
        source=F.concat(F.lit("src"), (k % 5).cast("string")),
        medium=medium,
        name=F.when(k % 2 == 0, "(data deleted)").otherwise("campaign"),
        transaction_id=transaction,
        revenue=revenue,
    )


# --- order history ------------------------------------------------------------------

ORDER_HISTORY = AnalyticsConfig(
    first_date=date(1995, 1, 1),
    last_date=date(2004, 12, 31),
    cart_reliable_from=date(1996, 1, 1),
    revenue_reliable_until=date(2003, 1, 1),
    return_windows=(30, 180),
    season_periods=(
        SeasonPeriod(1, "1997 (baseline)", date(1997, 1, 1), date(1997, 12, 31), True),
        SeasonPeriod(2, "1998-1999", date(1998, 1, 1), date(1999, 12, 31), True),
        SeasonPeriod(3, "2000", date(2000, 1, 1), date(2000, 12, 31), True),
    ),
    source_min_users=20,
    country_min_users=60,
)


def order_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` as visits spread over years, with first visits spread out as well."""
    nations = _table(spark, sf_dir, "customer").join(
        _table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left"
    )
    user, key, status = F.col("o_custkey"), F.col("o_orderkey"), F.col("o_orderstatus")
    orders = (
        _table(spark, sf_dir, "orders")
        .join(nations.select("c_custkey", "n_name", "c_mktsegment"), user == F.col("c_custkey"), "left")
        .withColumn("day", F.date_add(F.col("o_orderdate").cast("date"), ((user % 7) * 180).cast("int")))
    )
    name = F.when(status == "F", "purchase").when(status == "O", "begin_checkout").otherwise("view_item")
    buys = status == "F"
    return _raw(
        orders,
        [
            _param("ga_session_id", int_value=F.date_format("day", "yyyyMMdd").cast("bigint")),
            _param("ga_session_number", int_value=1 + key % 5 + F.when(user % 10 == 0, 1).otherwise(0)),
        ],
        event_date=F.date_format("day", "yyyyMMdd"),
        event_timestamp=F.unix_date("day").cast("bigint") * 86_400 * MICROS + (key % 86_400) * MICROS + key,
        event_name=name,
        user_pseudo_id=user,
        category=_pick(key % 3, "desktop", "mobile", "tablet"),
        country=F.col("n_name"),
        source=F.col("c_mktsegment"),
        medium=_pick(user % 6, "organic", "cpc", "referral", "(none)", "<Other>", "(data deleted)"),
        transaction_id=F.when(buys, key.cast("string")),
        revenue=F.when(buys, F.col("o_totalprice")),
    )


# --- item events ---------------------------------------------------------------------

ITEM_EVENTS = AnalyticsConfig(
    first_date=date(1995, 1, 1),
    last_date=date(2001, 12, 31),
    cart_reliable_from=date(1997, 1, 1),
    revenue_reliable_until=date(2001, 6, 1),
    return_windows=(30, 180),
    season_periods=(
        SeasonPeriod(1, "1995-1996 (baseline)", date(1995, 1, 1), date(1996, 12, 31), True),
        SeasonPeriod(2, "1997-1998", date(1997, 1, 1), date(1998, 12, 31), True),
        SeasonPeriod(9, "1999-2001 (not compared)", date(1999, 1, 1), date(2001, 12, 31), False),
    ),
    country_min_users=60,
    impression_floor=600,
    item_aliases=(("small gear", "large gear"), ("old rod", "new rod")),
    product_group_word_starts=(("Hardware", "BOL"),),
    product_group_words=(("Rings", "RING|RINGS"), ("Rods and gears", "ROD|GEAR"), ("Gadgets", "GIZMO|WIDGET")),
)


def item_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` as product views, cart adds and purchases that carry items."""
    # Lines meet parts and orders once, whatever events they become, and carry only what these need.  Orders come last:
    # where the join is by sorting, that leaves an order's events together, so that what folds them folds early.
    line = _table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_partkey",
        "l_suppkey",
        "l_linenumber",
        F.col("l_quantity").cast("bigint").alias("quantity"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("amount"),
        F.col("l_shipdate").cast("date").alias("day"),
        (F.col("l_returnflag") != "N").alias("counted"),
        (F.col("l_linestatus") == "F").alias("added"),
        (F.col("l_returnflag") != "A").alias("bought"),
    )
    size = F.col("p_size")
    shown_name = (
        F.when(size == 7, "(not set)")
        .when(size == 8, "")
        .when(size == 10, F.concat(F.lit("&quot;"), F.col("p_name"), F.lit("&quot;")))
        .when(size != 9, F.col("p_name"))
    )
    parts = _table(spark, sf_dir, "part").select(
        "p_partkey", "p_size", shown_name.alias("name"), F.concat_ws(" ", "p_brand", "p_type").alias("other")
    )
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    lines = line.join(parts, F.col("l_partkey") == F.col("p_partkey")).join(
        orders, F.col("l_orderkey") == F.col("o_orderkey")
    )
    part, user = F.col("l_partkey"), F.col("o_custkey")
    name, other = F.col("name"), F.col("other")
    quantity, amount, day = F.col("quantity"), F.col("amount"), F.col("day")

    def items(event: str) -> Column:
        def item(item_name: Column, qty: Column, revenue: Column) -> Column:
            return F.struct(
                F.concat(F.lit("P"), part.cast("string")).alias("item_id"),
                item_name.alias("item_name"),
                qty.cast("bigint").alias("quantity"),
                revenue.cast("double").alias("item_revenue_in_usd"),
            )

        if event == "view_item":
            shown = F.array(
                item(name, F.lit(None), F.lit(None)),
                item(other, F.lit(None), F.lit(None)),
                # The spelling variant of a name that is shown as well counts once.
                item(F.replace(name, F.lit("small gear"), F.lit("large gear")), F.lit(None), F.lit(None)),
            )
            return F.when(size % 3 == 0, F.array().cast(ITEM_ARRAY)).otherwise(shown)
        if event == "add_to_cart":
            # Only the item that was added carries a quantity, and it is not always known.
            return F.array(
                item(name, F.when(F.col("counted"), quantity), F.lit(None)),
                item(other, F.lit(None), F.lit(None)),
            )
        return F.array(item(name, quantity, amount))

    transaction = F.when(
        F.col("l_suppkey") % 10 != 0,
        F.when(F.col("l_suppkey") % 10 == 1, "(not set)").otherwise(F.col("l_orderkey").cast("string")),
    )
    revenue = F.when((F.col("l_linenumber") == 3) & (F.col("l_suppkey") % 10 < 2), 0.0).otherwise(amount)

    kinds = F.array(F.lit("view_item"), F.when(F.col("added"), "add_to_cart"), F.when(F.col("bought"), "purchase"))
    event = F.col("event")
    buys = event == "purchase"
    carried = F.when(buys, items("purchase").cast(ITEM_ARRAY))
    for kind in ("add_to_cart", "view_item"):
        carried = carried.when(event == kind, items(kind).cast(ITEM_ARRAY))
    return _raw(
        lines.withColumn("event", F.explode(F.array_compact(kinds))),
        [
            _param("ga_session_id", int_value=F.col("l_orderkey")),
            _param("ga_session_number", int_value=F.col("l_linenumber")),
        ],
        event_date=F.date_format(day, "yyyyMMdd"),
        event_timestamp=F.unix_date(day).cast("bigint") * 86_400 * MICROS
        + (F.col("l_partkey") % 80_000) * MICROS
        + F.col("l_suppkey"),
        event_name=event,
        user_pseudo_id=user,
        category=_pick(part % 3, "desktop", "mobile", "tablet"),
        country=F.concat(F.lit("Country "), (user % 20).cast("string")),
        source=F.lit("src"),
        medium=_pick(user % 5, "organic", "cpc", "referral", "(none)", "<Other>"),
        transaction_id=F.when(buys, transaction),
        revenue=F.when(buys, revenue),
        items=carried,
    )


__all__ = ["CLICKSTREAM", "ITEM", "ITEM_EVENTS", "ORDER_HISTORY", "clickstream", "item_events", "order_history"]
