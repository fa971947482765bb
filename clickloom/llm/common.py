"""Stored tables between steps, distributed ranks and connected components."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors reach: ``spark.checkpoint.dir``; where that is unset, one in the warehouse."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        named = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_steps"
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write the rows to the shared folder and read them back: the lineage ends there."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def as_text(df: DataFrame, key: str, text: str, *more: Column) -> DataFrame:
    """(_key, _text, ...) for a Python step.

    The key goes as a string, as pandas would turn a column of integers and nulls into floats; the step's result
    casts it back.
    """
    return df.select(F.col(key).cast("string").alias("_key"), F.col(text).alias("_text"), *more)


def ranked(df: DataFrame, group: str, *order: Column | str, rank: str = "slot") -> DataFrame:
    """Add each row's place (from 0) within its group, in the given order.

    No group is gathered in one task: rows are range-sorted by group and order, numbered inside their partition,
    and moved up by the number of rows that earlier partitions hold of the group.  The sorted rows are stored, so
    that both steps see the same partitions.  Rows of a null group are numbered as one group.
    """
    placed = (
        df.repartitionByRange(F.col(group), *order)
        .sortWithinPartitions(F.col(group), *order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_row", F.monotonically_increasing_id())
    )
    placed = stored(placed, "ranked")
    # One row for each partition, and one more for each group that begins inside one.
    spans = placed.groupBy(F.col(group).alias("_group"), F.col("_part").alias("_p")).agg(
        F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n")
    )
    earlier = Window.partitionBy("_group").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    joined = placed.join(spans, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_part") == F.col("_p")))
    return joined.withColumn(rank, F.col("_row") - F.col("_first") + F.col("_before")).drop(
        "_part", "_row", "_group", "_p", "_first", "_n", "_before"
    )


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of the links; the component is the smallest node that links reach.

    Contraction: in each round every node joins the neighbour (or itself) with the smallest hash of that round,
    links move to the joined nodes, and those inside one node go.  Each round at least about halves the nodes, and
    stars end at once.  All steps are grouped minima, which combine before the shuffle, and joins of stored tables,
    which adaptive execution can split at a hot node; nothing is gathered by node.
    """
    edges = stored(links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct(), "links")
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    joins: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        seed = F.lit(len(joins))
        order = lambda c: F.struct(F.xxhash64(c, seed).alias("h"), F.col(c).alias("node"))
        nearest = both.groupBy(F.col("a").alias("node")).agg(F.min(order("b")).alias("m"))
        own = order("node")
        to = stored(nearest.select("node", F.least(F.col("m"), own)["node"].alias("to")), "joined")
        joins.append(to)
        moved = (
            edges.join(to.select(F.col("node").alias("a"), F.col("to").alias("x")), "a")
            .join(to.select(F.col("node").alias("b"), F.col("to").alias("y")), "b")
            .where("x <> y")
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
            .distinct()
        )
        edges = stored(moved, "links")
    root = None
    for to in reversed(joins):  # the smallest map first
        if root is not None:
            later = root.select(F.col("node").alias("to"), F.col("root"))
            to = stored(to.join(later, "to", "left").select("node", F.coalesce("root", "to").alias("root")), "roots")
        else:
            to = to.withColumnRenamed("to", "root")
        root = to
    if root is None:
        return nodes.withColumn("component", F.col("node"))
    least = root.groupBy("root").agg(F.min("node").alias("component"))
    return stored(root.join(stored(least, "least"), "root").select("node", "component"), "components")
