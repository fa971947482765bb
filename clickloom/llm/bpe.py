"""Operator 9: BPE encoding and decoding of a column of texts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickloom.llm.common import as_text
from clickloom.llm.numpy_bpe import loaded
from clickloom.llm.units import Flat, batches

#: Characters of the texts that are encoded together.
BATCH = 1 << 19


def _ids(texts: list[str], path: str) -> Iterator[list[int]]:
    _, table = loaded(path)
    for start, end in batches(texts, BATCH):
        ids = table(texts[start:end])
        for low, n in zip(ids.starts.tolist(), ids.counts.tolist(), strict=True):
            yield ids.values[low : low + n].tolist()


def _spans(parts: Flat, ids: Flat) -> tuple[memoryview, list[tuple[int, int]]]:
    """What the ids of all texts stand for, and from where to where that of each text goes."""
    edges = np.r_[0, np.cumsum(parts.counts)][np.r_[0, np.cumsum(ids.counts)]].tolist()
    return memoryview(parts.values), list(pairwise(edges))


def encoded(df: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """Add the token ids of each whole text (null text: no ids)."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def encode(texts: pd.Series) -> pd.Series:
        return pd.Series(list(_ids(texts.fillna("").tolist(), path)), dtype=object)

    return df.withColumn(out, encode(F.col(text)))


def decoded(df: DataFrame, path: str, ids: str = "ids", out: str = "text") -> DataFrame:
    """Add the text of each list of ids (null list: empty text)."""

    @F.pandas_udf(T.StringType())
    def decode(lists: pd.Series) -> pd.Series:
        bpe, _ = loaded(path)
        return lists.map(lambda x: "" if x is None else bpe.decode(list(x)))

    return df.withColumn(out, decode(F.col(ids)))


def round_trip(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode each whole text, decode the ids again, and report both.

    Returns (key, n_tokens, ids_sha256 of the decimal ids joined by commas, decoded_sha256 of the decoded UTF-8), a
    row for each row.  A null text is an empty one.  Special strings inside a text become their one id.  Repeated
    rows and null keys are kept as they are; an empty table gives an empty result.  Ids never leave the task.
    """
    kind = df.schema[key].dataType

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe, table = loaded(path)
        for frame in frames:
            texts, rows = frame["_text"].fillna("").tolist(), []
            for start, end in batches(texts, BATCH):
                ids = table(texts[start:end])
                decimal, told = _spans(bpe.decimals.take(ids.values), ids)
                spelled, back = _spans(bpe.spelled.take(ids.values), ids)
                for n, (i, j), (k, m) in zip(ids.counts.tolist(), told, back, strict=True):
                    listed = hashlib.sha256(decimal[i : max(i, j - 1)])  # without the last comma
                    text = str(spelled[k:m], "utf-8", "replace").encode()
                    rows.append((n, listed.hexdigest(), hashlib.sha256(text).hexdigest()))
            out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
            out.insert(0, "_key", frame["_key"].to_numpy())
            yield out

    schema = T.StructType(
        [
            T.StructField("_key", T.StringType()),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("ids_sha256", T.StringType()),
            T.StructField("decoded_sha256", T.StringType()),
        ]
    )
    rows = as_text(df, key, text).mapInPandas(run, schema)
    return rows.select(F.col("_key").cast(kind).alias(key), *schema.names[1:])
