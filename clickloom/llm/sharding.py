"""Operator 7: shards by jump consistent hashing."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickloom.llm.common import ranked

#: Fixed values of the published algorithm: the step of its generator, and 2 to the power 31.
STEP = np.uint64(2862933555777941757)
ONE = np.float64(1 << 31)


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard (from 0) of each 64-bit key; all keys jump together until none is left to jump."""
    key = keys.astype(np.int64).view(np.uint64).copy()
    out = np.zeros(len(key), np.int64)
    moving = np.arange(len(key))
    with np.errstate(over="ignore"):
        while len(moving):
            key[moving] = key[moving] * STEP + np.uint64(1)
            draw = ((key[moving] >> np.uint64(33)) + np.uint64(1)).astype(np.float64)
            to = ((out[moving] + 1) * (ONE / draw)).astype(np.int64)
            stays = to >= shards
            moving, to = moving[~stays], to[~stays]
            out[moving] = to
    return out


def shard_of(key: Column, shards: int) -> Column:
    """The shard of a key column; a null key has a shard as well, always the same."""
    if shards < 1:
        raise ValueError("at least one shard is needed")

    @F.pandas_udf(T.IntegerType())
    def jumped(hashes: pd.Series) -> pd.Series:
        return pd.Series(jump(hashes.to_numpy(), shards).astype(np.int32))

    return jumped(F.xxhash64(key))


def sharded(df: DataFrame, shards: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Put every row into a shard by its key, number it there, and say where it goes with one more shard.

    Returns (key, size = UTF-8 bytes + 1, text_crc32, law, shard, slot, grown_shard), a row for each row.  A null
    text has no bytes.  Rows with the same key share a shard, whatever they hold; slots go by key and then by
    content.  An empty table gives an empty result.  A shard is not gathered in one task.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(
        F.col(key).alias("_key"),
        (F.octet_length(whole).cast("long") + 1).alias("size"),
        F.crc32(whole.cast("binary")).alias("text_crc32"),
        shard_of(F.col(key), shards).alias("shard"),
        shard_of(F.col(key), shards + 1).alias("grown_shard"),
    )
    rows = ranked(rows, "shard", "_key", "size", "text_crc32", rank="slot")
    return rows.select(
        F.col("_key").alias(key), "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )


def write_shards(df: DataFrame, path: str, shards: int, key: str = "doc_id") -> None:
    """Write the whole rows, one folder ``shard=N`` for each shard; every task writes to its own files."""
    df.withColumn("shard", shard_of(F.col(key), shards)).write.partitionBy("shard").parquet(path)
