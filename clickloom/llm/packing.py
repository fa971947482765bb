"""Operator 3: packing documents into sequences by bulk-synchronous best fit."""

from __future__ import annotations

import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache
from itertools import compress

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickloom.llm.common import as_text, ranked, stored
from clickloom.llm.tokens import library
from clickloom.llm.units import Flat, UnitTable, batches


LINE = re.compile(r"\n[^\s\x1c-\x1f]+")


class UnitIds:
    """Ids (32-bit, as bytes) of units, encoded many at a time.

    Units of a space and then no other are joined to one text: each begins with the only token in it whose first byte
    is a space, so the ids are cut there.  So are units of a line's end and then no white space.  All others are
    encoded alone.
    """

    def __init__(self, path: str, together: int = 500):
        self.tokenizer = library(path)
        self.together = together
        self.begins = np.zeros((2, self.tokenizer.get_vocab_size()), bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.begins[:, i] = token.startswith("\u0120"), token.startswith("\u010a")

    def kind(self, unit: str) -> int:
        """Which units it is joined with: 0 those of a space, 1 of a line's end, 2 none."""
        if "<|" in unit:
            return 2
        return 0 if not unit.rfind(" ") else 1 if LINE.fullmatch(unit) else 2

    def some(self, texts: list[str], at_once: int = 16) -> Iterator[bytes]:
        """Ids of each text; the library's encodings, far larger than ids, are held of a few texts at once."""
        for i in range(0, len(texts), at_once):
            yield from self.ids(texts[i : i + at_once])

    def ids(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def __call__(self, units: list[str]) -> list[bytes]:
        flat = self.flat(units)
        ids, ends = flat.values.tobytes(), (4 * np.cumsum(flat.counts)).tolist()
        return [ids[lo:hi] for lo, hi in zip([0, *ends], ends, strict=False)]

    def flat(self, units: list[str]) -> Flat:
        kind = np.fromiter(map(self.kind, units), np.int8, len(units))
        found = Flat.of(self.ids(list(compress(units, kind == 2))), "<u4")
        for k in (1, 0):
            some = list(compress(units, kind == k))
            groups = ["".join(some[i : i + self.together]) for i in range(0, len(some), self.together)]
            ids = np.frombuffer(b"".join(self.some(groups)), "<u4")
            found = Flat(ids, np.diff(np.flatnonzero(self.begins[k, ids]), append=len(ids))).followed_by(found)
        return found.take(np.argsort(np.argsort(kind, kind="stable")))


@lru_cache(maxsize=2)
def _loaded(path: str, size: int = 600_000) -> UnitTable:
    return UnitTable(UnitIds(path).flat, size)


def pieces(
    df: DataFrame,
    path: str,
    capacity: int,
    end_id: int,
    key: str = "doc_id",
    text: str = "text",
    with_ids: bool = False,
    units: int = 600_000,
) -> DataFrame:
    """Cut each document's ids (its text's, then ``end_id``) into pieces of at most ``capacity``.

    Only longer documents are cut; all their pieces but the first are full.  Returns (key, piece, start, length,
    ids_crc32), and the ids themselves if asked for.  Each Python worker keeps the ids of up to ``units`` units.
    """
    fields = [
        T.StructField("_key", T.StringType()),
        T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
    ]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
    names = [f.name for f in fields]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = _loaded(path, units)
        for frame in frames:
            pa.default_memory_pool().release_unused()  # what earlier steps left with this worker
            keys, texts, rows = frame["_key"].tolist(), frame["_text"].fillna("").tolist(), []
            for first, last in batches(texts, 1 << 19):
                found = table(texts[first:last])
                ends = np.cumsum(found.counts)
                ids = np.insert(found.values, ends, end_id)
                view = memoryview(ids).cast("B")
                stops = (ends + np.arange(1, len(ends) + 1)).tolist()
                for k, low, high in zip(keys[first:last], [0, *stops], stops, strict=False):
                    n = high - low
                    start, stop, piece = 0, n % capacity or capacity, 0
                    stop = min(stop, n)
                    while start < n:
                        crc = zlib.crc32(view[4 * (low + start) : 4 * (low + stop)])
                        row = (k, piece, start, stop - start, crc)
                        rows.append((*row, ids[low + start : low + stop].astype(np.int32)) if with_ids else row)
                        start, stop, piece = stop, stop + capacity, piece + 1
            yield pd.DataFrame(rows, columns=names)

    cut = as_text(df, key, text).mapInPandas(run, T.StructType(fields))
    return cut.select(F.col("_key").cast(df.schema[key].dataType).alias(key), *names[1:])


class Gaps:
    """Open sequences by free space, as runs (first sequence, number) of equal space."""

    def __init__(self, capacity: int):
        self.capacity, self.sequences = capacity, 0
        self.sizes: list[int] = []
        self.runs: dict[int, list[tuple[int, int]]] = {}

    def put(self, free: int, first: int, number: int) -> None:
        if free and number:
            if free not in self.runs:
                insort(self.sizes, free)
            self.runs.setdefault(free, []).append((first, number))

    def successor(self, length: int) -> int | None:
        """The least free space that holds the length."""
        i = bisect_left(self.sizes, length)
        return self.sizes[i] if i < len(self.sizes) else None

    def take(self, free: int) -> tuple[int, int]:
        run = self.runs[free].pop()
        if not self.runs[free]:
            del self.runs[free]
            del self.sizes[bisect_left(self.sizes, free)]
        return run

    def open(self, number: int) -> None:
        self.put(self.capacity, self.sequences, number)
        self.sequences += number


def sweep(counts: dict[int, int], capacity: int) -> pd.DataFrame:
    """Which gap each document gets, for all documents of a length at once.

    Documents of one length are interchangeable, and so are sequences with the same free space, so the sorted
    documents are kept as at most ``capacity`` runs (length, number) and the gaps as runs too: what is swept
    does not grow with the corpus.  In a superstep the longest documents left meet the gaps: those of the
    least space that holds them take as many as fit, lower ranks first, so two documents never ask for one place;
    the gaps are updated, and the rest goes on to the next larger gaps, or opens sequences.  This is best fit in
    decreasing order, in bulk.  A row of the result: documents of ``length`` with ranks from ``rank`` on
    go to the sequences from ``sequence`` on, ``each`` to a sequence, from ``offset`` on.
    """
    gaps, out = Gaps(capacity), []
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            free = gaps.successor(length)
            if free is None:
                gaps.open(-(-left // (capacity // length)))
                continue
            first, number = gaps.take(free)
            each = free // length
            used = min(number, -(-left // each))
            placed = min(left, used * each)
            out.append((length, rank, first, each, capacity - free))
            full, some = divmod(placed, each)
            gaps.put(free - each * length, first, full)
            gaps.put(free - some * length, first + full, 1 if some else 0)
            gaps.put(free, first + used, number - used)
            rank, left = rank + placed, left - placed
    return pd.DataFrame(out, columns=["length", "rank", "sequence", "each", "offset"], dtype="int64")


def packed(cut: DataFrame, capacity: int, key: str = "doc_id") -> DataFrame:
    """Add sequence_id and offset to pieces of at most ``capacity``.

    Pieces are range-sorted by length, and every piece gets its rank among those of its length without gathering a
    length in one task; the sweep over the runs of lengths says where each rank goes.
    """
    cut = stored(cut, "pieces")
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = sweep(counts, capacity).sort_values(["length", "rank"], ignore_index=True)
    steps = {c: plan[c].to_numpy() for c in plan}
    by_length = {int(n): (int(lo), int(hi)) for n, lo, hi in _runs(steps["length"])}
    names = cut.columns
    rows = ranked(cut, "length", key, "piece", *(c for c in names if c not in (key, "piece", "length", "ids")), rank="_rank")
    kind = cut.schema[key].dataType
    schema = T.StructType([f if f.name != key else T.StructField(key, T.StringType()) for f in cut.schema])
    schema = schema.add("sequence_id", T.LongType()).add("offset", T.LongType())

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            length, rank = frame["length"].to_numpy(), frame.pop("_rank").to_numpy()
            step = np.zeros(len(frame), np.int64)
            for n in np.unique(length):
                lo, hi = by_length[int(n)]
                of = length == n
                step[of] = lo - 1 + np.searchsorted(steps["rank"][lo:hi], rank[of], side="right")
            at = rank - steps["rank"][step]
            frame["sequence_id"] = steps["sequence"][step] + at // steps["each"][step]
            frame["offset"] = steps["offset"][step] + at % steps["each"][step] * length
            yield frame

    placed = rows.select(*names, "_rank").withColumn(key, F.col(key).cast("string")).mapInPandas(place, schema)
    return placed.withColumn(key, F.col(key).cast(kind))


def _runs(values: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(value, from, to) of each run of equal values."""
    edges = np.flatnonzero(np.r_[True, values[1:] != values[:-1], True]) if len(values) else np.array([0])
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        yield values[lo], lo, hi


def pack(
    df: DataFrame,
    path: str,
    capacity: int = 2048,
    end_id: int = 0,
    key: str = "doc_id",
    text: str = "text",
    with_ids: bool = False,
    units: int = 600_000,
) -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` tokens.

    Returns, a row for each piece: (key, piece, start, length, ids_crc32, sequence_id, offset), and ids if asked
    for.  Null and empty texts are the end token alone.  Repeated rows and null keys are packed like others; which
    of equal rows comes first does not matter.  An empty table gives an empty result.  More ``units`` (see ``pieces``)
    take more memory, and fewer more time.
    """
    return packed(pieces(df, path, capacity, end_id, key, text, with_ids, units), capacity, key)
