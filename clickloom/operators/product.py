"""Products: impressions, cart adds, purchases, groups and quadrants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.config import QUADRANTS, AnalyticsConfig
from clickloom.functions.columns import (
    MONEY,
    group_by_words,
    literal_table,
    money_sum,
    pct,
    ratio,
    raw_date,
    share_of_total,
    with_one_row,
)
from clickloom.functions.ranks import exact_medians
from clickloom.operators.sessions import clean_events, clean_orders
from clickloom.schema import ITEM_ALIASES


def item_aliases(spark, cfg: AnalyticsConfig) -> DataFrame:
    """Spelling variants of product names and the name to use instead."""
    return literal_table(spark, cfg.item_aliases, ITEM_ALIASES)


def _usable(name: Column, cfg: AnalyticsConfig) -> Column:
    return name.isNotNull() & ~name.isin(*cfg.unusable_item_names)


def _unescaped(name: Column) -> Column:
    return F.replace(name, F.lit("&quot;"), F.lit('"'))


def _canonical(rows: DataFrame, aliases: DataFrame) -> DataFrame:
    """Replace ``item_name`` by the name to use.

    The join carries no hint: the optimizer broadcasts the aliases only while their
    known size is under its threshold.
    """
    renamed = rows.join(aliases, F.col("item_name") == F.col("raw"), "left")
    return renamed.withColumn("item_name", F.coalesce("canonical", "item_name")).drop("raw", "canonical")


def _items(events: DataFrame, keys: list[str], fields: dict[str, str], cfg: AnalyticsConfig) -> DataFrame:
    """One row per item with a usable name, unescaped.

    The fields are taken out of ``items`` one by one, which lets the scan skip the
    others; the keys are computed before the explode, once per event.
    """
    zipped = F.arrays_zip(*[F.col(f"items.{field}").alias(field) for field in ("item_name", *fields)])
    rows = events.select(*keys, F.explode(zipped).alias("item"))
    return rows.where(_usable(F.col("item.item_name"), cfg)).select(
        *keys,
        _unescaped(F.col("item.item_name")).alias("item_name"),
        *[F.col(f"item.{field}").alias(name) for field, name in fields.items()],
    )


VISIT = ["user_pseudo_id", "event_date", "quarter_hour"]


def _shown(raw: DataFrame, aliases: DataFrame, cfg: AnalyticsConfig) -> DataFrame:
    """Distinct impressions, partitioned by user, date and quarter of an hour.

    Events are shuffled, not the names in them: the distinct then needs no further
    shuffle, and a user who is shown products all day is spread over a hundred
    partitions.  A name repeated inside an event is dropped before.
    """
    usable = F.filter("items.item_name", lambda n: _usable(n, cfg))
    names = F.array_distinct(F.transform(usable, _unescaped))
    events = raw.where(F.col("event_name") == "view_item").select(
        "user_pseudo_id",
        "event_timestamp",
        raw_date().alias("event_date"),
        F.floor(F.col("event_timestamp") / 900_000_000).alias("quarter_hour"),
        names.alias("names"),
    )
    together = events.where(F.size("names") > 0).repartition(*VISIT)
    shown = together.select(*VISIT, "event_timestamp", F.explode("names").alias("item_name"))
    return _canonical(shown, aliases).distinct()


def item_impressions(raw: DataFrame, aliases: DataFrame, cfg: AnalyticsConfig) -> DataFrame:
    """Each product shown, once per user and event time, under its canonical name."""
    return _shown(raw, aliases, cfg).select("user_pseudo_id", "event_timestamp", "event_date", "item_name")


def item_cart_adds(raw: DataFrame, aliases: DataFrame, cfg: AnalyticsConfig) -> DataFrame:
    """Items added to the cart: only the added item of an event carries a quantity."""
    events = raw.where(F.col("event_name") == "add_to_cart").select(
        "user_pseudo_id", raw_date().alias("event_date"), "items"
    )
    listed = _items(events, ["user_pseudo_id", "event_date"], {"quantity": "quantity"}, cfg)
    return _canonical(listed.where(F.col("quantity").isNotNull()).drop("quantity"), aliases)


def item_purchases(raw: DataFrame, aliases: DataFrame, cfg: AnalyticsConfig) -> DataFrame:
    """The item lines of the clean orders."""
    orders = clean_orders(clean_events(raw, ["items"]), cfg, carry=["event_date", "items"])
    fields = {"quantity": "quantity", "item_revenue_in_usd": "revenue"}
    return _canonical(_items(orders, ["user_pseudo_id", "event_date"], fields, cfg), aliases)


def product_group(name: str | Column, cfg: AnalyticsConfig) -> Column:
    """Product group from the words in the name."""
    return group_by_words(
        name, cfg.product_group_word_starts, cfg.product_group_words, cfg.default_product_group
    )


def stack(frames: list[DataFrame], keys: list[str], measures: list[str]) -> DataFrame:
    """Put frames that measure different things about the same keys on top of each other.

    Each frame has zeros for the measures it lacks, so that one grouping of the
    result does the work of a chain of full outer joins.
    """

    def widened(df: DataFrame) -> DataFrame:
        return df.select(*keys, *[F.col(m) if m in df.columns else F.lit(0).alias(m) for m in measures])

    stacked = widened(frames[0])
    for df in frames[1:]:
        stacked = stacked.unionByName(widened(df))
    return stacked


ACTIVITY = ("impressions", "cart_adds", "order_lines", "units", "revenue")


def item_activity(raw: DataFrame, aliases: DataFrame, cfg: AnalyticsConfig) -> DataFrame:
    """Impressions, cart adds and order lines by date, product and user.

    The product table and the daily product facts are both sums over this one, so
    the items of the raw events are taken apart once.  It is not unique by its key:
    what one key has may come in several rows.
    """
    keys = ["event_date", "item_name", "user_pseudo_id"]
    one = F.lit(1).cast("bigint")
    shown = _shown(raw, aliases, cfg).select(*keys, one.alias("impressions"))
    added = item_cart_adds(raw, aliases, cfg).select(*keys, one.alias("cart_adds"))
    bought = item_purchases(raw, aliases, cfg).select(
        *keys,
        one.alias("order_lines"),
        F.coalesce("quantity", F.lit(0)).alias("units"),
        F.coalesce(F.col("revenue").cast(MONEY), F.lit(0)).cast("decimal(28,4)").alias("revenue"),
    )
    return stack([shown, added, bought], keys, list(ACTIVITY))


def product_totals(activity: DataFrame, cfg: AnalyticsConfig) -> DataFrame:
    """One row per product with its counts.

    Sums combine in every task.  Only what counts users is folded to (product, user),
    and that carries a flag for each count instead of the sums.
    """
    in_window = F.col("event_date") >= F.lit(cfg.cart_reliable_from)
    sums = activity.groupBy("item_name").agg(
        *[F.sum(c).alias(c) for c in ACTIVITY],
        F.sum(F.when(in_window, F.col("impressions")).otherwise(0)).alias("impressions_cart_window"),
        F.sum(F.when(in_window, F.col("order_lines")).otherwise(0)).alias("order_lines_cart_window"),
    )
    counted = {"impression_users": "impressions", "cart_users": "cart_adds", "buyers": "order_lines"}
    by_user = activity.groupBy("item_name", "user_pseudo_id").agg(
        *[F.bool_or(F.col(c) > 0).alias(name) for name, c in counted.items()]
    )
    users = by_user.groupBy("item_name").agg(
        *[F.count(F.when(F.col(name), F.col("user_pseudo_id"))).alias(name) for name in counted]
    )
    order = [
        "impressions",
        "impression_users",
        "impressions_cart_window",
        "cart_adds",
        "cart_users",
        "order_lines",
        "order_lines_cart_window",
        "buyers",
        "units",
        "revenue",
    ]
    totals = stack([sums, users], ["item_name"], order).groupBy("item_name").agg(*[F.sum(c).alias(c) for c in order])
    return totals.withColumn("revenue", F.col("revenue").cast("double")).withColumnRenamed("revenue", "revenue_usd")


def product_rates(totals: DataFrame, cfg: AnalyticsConfig) -> DataFrame:
    """Product group and rates.  The cart rate sets all cart adds against cart-window impressions."""
    return totals.select(
        "item_name",
        product_group("item_name", cfg).alias("product_group"),
        *totals.columns[1:],
        ratio("revenue_usd", "units", 2).alias("avg_unit_price"),
        pct("cart_adds", "impressions_cart_window", 3).alias("view_to_cart_pct"),
        pct("order_lines_cart_window", "cart_adds", 2).alias("cart_to_purchase_pct"),
        pct("order_lines", "impressions", 3).alias("view_to_purchase_pct"),
        ratio("revenue_usd", "impressions", 4).alias("revenue_per_view"),
    )


def product_quadrants(rated: DataFrame, cfg: AnalyticsConfig) -> DataFrame:
    """Place products above the impression floor against the medians of those products.

    Where no product meets the floor the products are kept, without a quadrant.
    """
    strong, busy, hidden, weak = QUADRANTS
    meets_floor = F.col("impressions") >= cfg.impression_floor
    floor = rated.where(meets_floor)
    medians = exact_medians(floor, ["impressions", "view_to_purchase_pct"])
    seen = F.col("impressions") >= F.col("median_impressions")
    sells = F.col("view_to_purchase_pct") >= F.col("median_view_to_purchase_pct")
    quadrant = F.when(seen & sells, strong).when(seen, busy).when(sells, hidden).otherwise(weak)
    return with_one_row(rated, medians).select(
        *rated.columns,
        meets_floor.alias("meets_view_floor"),
        F.when(meets_floor, quadrant).alias("quadrant"),
        "median_impressions",
        "median_view_to_purchase_pct",
    )


def build_products(raw: DataFrame, aliases: DataFrame, cfg: AnalyticsConfig) -> DataFrame:
    """One row per product, in one plan.

    The medians read the rates several times; a job that can store the rates should
    do so and build on them, as the workspace does.
    """
    return product_quadrants(product_rates(product_totals(item_activity(raw, aliases, cfg), cfg), cfg), cfg)


def products_export(products: DataFrame) -> DataFrame:
    """All products, the best sellers first."""
    return products.orderBy(F.desc("revenue_usd"), F.desc("impressions"), "item_name")


def product_groups(products: DataFrame) -> DataFrame:
    """Totals per product group; rates use whole-period impressions."""
    counts = products.groupBy("product_group").agg(
        F.count(F.lit(1)).alias("products"),
        *[F.sum(c).alias(c) for c in ("impressions", "cart_adds", "order_lines", "units")],
        money_sum("revenue_usd").alias("revenue"),
    )
    return counts.select(
        "product_group",
        "products",
        "impressions",
        "cart_adds",
        "order_lines",
        "units",
        F.round("revenue", 2).alias("revenue_usd"),
        share_of_total("revenue").alias("pct_of_revenue"),
        pct("cart_adds", "impressions", 3).alias("view_to_cart_pct"),
        pct("order_lines", "impressions", 3).alias("view_to_purchase_pct"),
    )


def product_quadrant_summary(products: DataFrame) -> DataFrame:
    """Totals per quadrant, over the products that meet the floor."""
    counts = (
        products.where("meets_view_floor")
        .groupBy("quadrant")
        .agg(
            F.count(F.lit(1)).alias("products"),
            F.sum("impressions").alias("impressions"),
            F.sum("order_lines").alias("order_lines"),
            money_sum("revenue_usd").alias("revenue"),
            money_sum("avg_unit_price").alias("price"),
            F.count("avg_unit_price").alias("priced"),
        )
    )
    return counts.select(
        "quadrant",
        "products",
        "impressions",
        share_of_total("impressions").alias("pct_of_impressions"),
        "order_lines",
        F.round("revenue", 2).alias("revenue_usd"),
        share_of_total("revenue").alias("pct_of_revenue"),
        ratio("price", "priced", 2).alias("avg_unit_price"),
    )


def check_products(products: DataFrame, sessions: DataFrame, cfg: AnalyticsConfig) -> DataFrame:
    """Coverage of the products, and item revenue against order revenue."""
    other = F.col("product_group") == cfg.default_product_group
    totals = products.agg(
        F.count(F.lit(1)).alias("products"),
        F.count_if("meets_view_floor").alias("products_meeting_view_floor"),
        F.count_if(F.col("order_lines") > 0).alias("products_sold"),
        F.sum("impressions").alias("total_impressions"),
        F.sum("cart_adds").alias("identified_cart_adds"),
        F.sum("order_lines").alias("order_lines"),
        F.sum("units").alias("units"),
        money_sum("revenue_usd").alias("item_revenue"),
        F.count_if(other).alias("products_in_other_group"),
        money_sum(F.when(other, F.col("revenue_usd")).otherwise(0.0)).alias("other_revenue"),
    )
    order_revenue = sessions.agg(money_sum("revenue_usd").alias("order_revenue"))
    return with_one_row(totals, order_revenue).select(
        "products",
        "products_meeting_view_floor",
        "products_sold",
        "total_impressions",
        "identified_cart_adds",
        "order_lines",
        "units",
        F.round("item_revenue", 2).alias("item_revenue_usd"),
        F.round(F.col("item_revenue") - F.col("order_revenue"), 2).alias("item_minus_order_revenue_usd"),
        "products_in_other_group",
        pct("other_revenue", "item_revenue").alias("pct_revenue_in_other_group"),
    )
