"""Derived tables between stages, and CSV exports."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import types as T


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``; where that is unset, one in the warehouse."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        named = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_tables"
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


#: How the files of stored tables are written.
STORED = {"compression": "zstd"}


class TableStore:
    """Parquet tables in one folder; writing one cuts the lineage behind it.

    Tables that are kept by a key are catalogue tables in ``buckets`` buckets (by default the session's shuffle
    partitions), sorted by the key: joins and groupings by it need no shuffle.  One bucket is one task, so that is for
    tables in which a key has a bounded number of rows.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.folder = folder or f"{shared_folder(spark)}/tables-{uuid.uuid4().hex}"
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self._prefix = f"tables_{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def build(
        self, name: str, df: DataFrame, partition_by: str | None = None, bucket_by: str | None = None
    ) -> DataFrame:
        """Replace the table and return it as read back from storage.

        Files are compressed with zstd, which makes them about half as large as the default does.
        ``partition_by`` writes a directory for each value, its rows in files of the advisory size.
        """
        if bucket_by is not None:
            table = f"{self._prefix}_{name}"
            whole = df.repartition(self.buckets, bucket_by)  # one file for each bucket
            writer = whole.write.mode("overwrite").bucketBy(self.buckets, bucket_by).sortBy(bucket_by)
            writer.options(path=self.path(name), **STORED).format("parquet").saveAsTable(table)
            return self.spark.table(table)
        if partition_by is not None:
            writer = df.hint("rebalance", partition_by).write.mode("overwrite").options(**STORED)
            writer.partitionBy(partition_by).parquet(self.path(name))
        else:
            df.write.mode("overwrite").options(**STORED).parquet(self.path(name))
        return self.read(name, df.schema)

    def read(self, name: str, schema: T.StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(self.path(name)).select(*schema.fieldNames())


def write_csv(df: DataFrame, path: str, single_file: bool = True, order: Sequence[str | Column] = ()) -> None:
    """Export with a header row; ``single_file`` is for results of a few rows.

    With an ``order``, the rows are dealt into ranges of it, one for each file and sorted in it, and files are numbered
    in that order: read by name one after the other, they are the sorted result, which no single task has held.
    """
    if single_file:
        out = (df.orderBy(*order) if order else df).coalesce(1)
    elif order:
        out = df.repartitionByRange(*order).sortWithinPartitions(*order)
    else:
        out = df
    out.write.mode("overwrite").option("header", True).option("nullValue", "").csv(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Read an export back with declared types."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)
