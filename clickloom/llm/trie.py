"""Operator 13: the trie of conversation prefixes, in minimal-perfect-hash node tables.

A prefix is named by the XOR of 128-bit hashes of its turns, each taken with its position, so that the names of a
conversation's prefixes are running values: they are taken part by part over range-sorted turns and put together with
one line for each part, and no conversation has to fit in one task.  Prefixes are grouped into nodes, with their
members counted.

Nodes with many members (``heavy``) form the crown of the trie.  Their number is bounded, whatever the input: each
accounts for more than ``limit`` of the turns.  Below the crown hang subtrees of at most ``limit`` members.  Whole
subtrees are dealt into shards.  In a shard, a minimal perfect hash gives every node a slot; counts are scattered into
flat arrays by slot, parents become slots too, and sums over subtrees go up level by level.  What the subtrees' tops
hold is added to the crown, which is then treated as a shard itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickloom.llm.common import stored
from clickloom.llm.shingles import mixed

#: Nodes of the crown at most, and members of a node outside it at least.
CROWN = 1 << 18
LEAST = 256
#: Nodes of a shard, on average.
SHARD = 1 << 17
#: Conversation ids that are joined into one piece of text before their node's hash is taken.
PIECE = 1 << 10
#: Levels of a subtree that are treated together; a longer conversation is cut into bands, the deepest first.
BAND = 1 << 16
_WORD_ENDS = r"[^\x20\x09-\x0D]+"
_SEED = 0x51ED270B


# --- turns ---------------------------------------------------------------------


def _hashes(*c: str) -> list[Column]:
    return [F.xxhash64(*c).alias("t1"), F.xxhash64(F.lit(_SEED), *reversed(c)).alias("t2")]


def _in_parts(df: DataFrame, *by: Column) -> DataFrame:
    """The rows, sorted, in parts that each take a range; _part is a part's number."""
    return df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_part", F.spark_partition_id())


def ordered_turns(df: DataFrame, key: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, place, t1, t2, words): the turns of each conversation, numbered from 0; two hashes and the words of each.

    By turn, null first; equal turns by role, then text.  Of the texts nothing is stored.
    """
    whole = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    named = df.where(F.col(key).isNotNull()).select(
        F.col(key).cast("long").alias("conv"), F.col(turn).alias("turn"), whole(role).alias("role"), whole(text).alias("text")
    )
    words = (F.regexp_count("text", F.lit(_WORD_ENDS))).cast("long").alias("words")
    hashed = named.select("*", *_hashes("role", "text"), words)
    by = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    placed = _in_parts(hashed, *by).withColumn("_row", F.monotonically_increasing_id())
    placed = stored(placed.select("conv", "_part", "_row", "t1", "t2", "words"), "turns")
    spans = placed.groupBy("conv", "_part").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("conv").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("_before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    place = F.col("_row") - F.col("_first") + F.col("_before")
    return placed.join(spans, ["conv", "_part"]).select("conv", place.alias("place"), "t1", "t2", "words")


def shared_turns(conv: Column, of: int = 4) -> Column:
    """How many turns a conversation takes from its base: the CRC-32 of its decimal id modulo ``of``."""
    return (F.crc32(conv.cast("string")) % of).cast("long")


def rebuilt(turns: DataFrame, every: int = 20, of: int = 4) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations) in which conversations share beginnings.

    Every conversation begins with its base's first turns (the base is the last id divisible by ``every``; how many: see
    ``shared_turns``), and goes on with its own after that many.  Returns (conv, place, t1, t2, words) and (conv, n).
    """
    convs = turns.groupBy("conv").agg(F.count(F.lit(1)).alias("own"))
    heads = turns.where(F.col("place") < of - 1).withColumnRenamed("conv", "base")
    base = F.col("conv") - F.pmod(F.col("conv"), F.lit(every))
    taken = convs.select("conv", "own", shared_turns(F.col("conv"), of).alias("h"), base.alias("base"))
    lengths = heads.groupBy("base").agg(F.count(F.lit(1)).alias("there"))
    taken = taken.join(lengths, "base", "left").withColumn("from_base", F.least("h", F.coalesce("there", F.lit(0))))
    taken = stored(taken.withColumn("n", F.col("from_base") + F.greatest(F.col("own") - F.col("h"), F.lit(0))), "convs")
    first = taken.join(heads, "base").where("place < h").select("conv", "place", "t1", "t2", "words")
    later = turns.join(taken.select("conv", "h", "from_base"), "conv").where("place >= h")
    later = later.select("conv", (F.col("place") - F.col("h") + F.col("from_base")).alias("place"), "t1", "t2", "words")
    return first.unionByName(later), taken.select("conv", "n")


def _running(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Add the running XOR of g1, g2 over a conversation's rows in this part (r), and the one of the row before (q)."""
    conv, so_far = None, {"1": np.int64(0), "2": np.int64(0)}
    for pdf in frames:
        if not len(pdf):
            continue
        convs = pdf["conv"].to_numpy()
        first = np.flatnonzero(np.r_[True, convs[1:] != convs[:-1]])
        runs = np.diff(np.r_[first, len(convs)])
        for k, start in so_far.items():
            g = pdf.pop(f"g{k}").to_numpy()
            total = np.bitwise_xor.accumulate(g)
            base = (total ^ g)[first]
            if convs[0] == conv:  # the batch goes on with the conversation of the last one
                base[0] = start
            pdf[f"r{k}"] = total ^ np.repeat(base, runs)
            pdf[f"q{k}"] = pdf[f"r{k}"] ^ g
            so_far[k] = pdf[f"r{k}"].to_numpy()[-1]
        conv = convs[-1]
        yield pdf


def prefixes(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """(conv, depth, p1, p2, q1, q2, words, last): a line for each turn, with the names of the prefix that ends there (p)
    and of the one before it (q)."""
    salted = [F.xxhash64("place", f"t{k}", f"t{3 - k}").alias(f"g{k}") for k in (1, 2)]
    rows = _in_parts(turns.select("conv", "place", "words", *salted), F.col("conv"), F.col("place"))
    schema = "conv long, place long, words long, _part int, r1 long, q1 long, r2 long, q2 long"
    placed = stored(rows.mapInPandas(_running, schema), "running")
    spans = placed.groupBy("conv", "_part").agg(F.max_by(F.struct("r1", "r2"), "place").alias("r"))
    earlier = Window.partitionBy("conv").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = [F.coalesce(F.bit_xor(f"r.r{k}").over(earlier), F.lit(0)).alias(f"b{k}") for k in (1, 2)]
    spans = spans.select("conv", "_part", *before).join(lengths, "conv")
    names = [F.col(f"{of}{k}").bitwiseXOR(F.col(f"b{k}")).alias(f"{to}{k}") for of, to in (("r", "p"), ("q", "q")) for k in (1, 2)]
    depth = F.col("place") + 1
    whole = placed.join(spans, ["conv", "_part"])
    return stored(whole.select("conv", depth.alias("depth"), *names, "words", (depth == F.col("n")).alias("last")), "prefixes")


# --- nodes ---------------------------------------------------------------------

NAME = ["p1", "p2", "depth"]


def nodes_of(paths: DataFrame) -> DataFrame:
    """One line for each prefix: its members, the smallest of them, its parent's name, words of its last text."""
    same = lambda c: F.min(c) == F.max(c)
    nodes = paths.groupBy(*NAME).agg(
        F.count(F.lit(1)).alias("n"),
        F.min("conv").alias("least"),
        F.min("q1").alias("q1"),
        F.min("q2").alias("q2"),
        F.max("words").alias("words"),
        (same("q1") & same("q2") & same("words")).alias("one"),
    )
    nodes = stored(nodes, "nodes")
    if not nodes.where("not one").isEmpty():
        raise RuntimeError("two prefixes have one name of 128 bits")
    return nodes.drop("one")


class PerfectHash:
    """A minimal perfect hash of 128-bit names, and the names by slot, so that strangers are told from members.

    Names that are alone in their cell of a level's bit array have the rank of that bit as slot; the others go on to the
    next level.  Arrays have two cells a name, so about four in ten go on.
    """

    def __init__(self, a: np.ndarray, b: np.ndarray):
        self.levels: list[tuple[int, np.ndarray, np.ndarray]] = []
        left, placed = np.arange(len(a)), 0
        while len(left):
            if len(self.levels) == 200:
                raise ValueError("the names are not distinct")
            size = 2 * len(left) + 1
            cell = self._cells(a[left], b[left], size, len(self.levels))
            alone = np.bincount(cell, minlength=size) == 1
            rank = np.cumsum(alone) - 1 + placed
            self.levels.append((size, alone, rank))
            placed += int(alone.sum())
            left = left[~alone[cell]]
        self.a, self.b = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
        slots = self._slots(a, b)
        self.a[slots], self.b[slots] = a, b

    @staticmethod
    def _cells(a: np.ndarray, b: np.ndarray, size: int, level: int) -> np.ndarray:
        seed = np.array([level], np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed(a.view(np.uint64) ^ mixed(b.view(np.uint64) + seed)) % np.uint64(size)).astype(np.int64)

    def _slots(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        slots, left = np.full(len(a), -1), np.arange(len(a))
        for level, (size, alone, rank) in enumerate(self.levels):
            cell = self._cells(a[left], b[left], size, level)
            here = alone[cell]
            slots[left[here]] = rank[cell[here]]
            left = left[~here]
        return slots

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The slot of each name, -1 for one that is not in the table."""
        slots = self._slots(a, b)
        known = slots >= 0
        known[known] = (self.a[slots[known]] == a[known]) & (self.b[slots[known]] == b[known])
        return np.where(known, slots, -1)


SHARD_COLUMNS = [*NAME, "q1", "q2", "n", "least", "words", "children", "leaves", "saved"]
TOTALS = (
    "p1 long, p2 long, depth long, q1 long, q2 long, n long, least long, children long, leaves long, saved long, "
    "parent long, top boolean"
)


def accumulated(pdf: pd.DataFrame) -> pd.DataFrame:
    """Sums over subtrees of a shard's nodes; children, leaves and saved hold what comes from outside, below them."""
    # Arrow's columns may be read-only views; the table's arrays are new ones.
    column = {c: np.ascontiguousarray(pdf[c].to_numpy(), np.int64) for c in SHARD_COLUMNS}
    table = PerfectHash(column["p1"], column["p2"])
    slot = table.find(column["p1"], column["p2"])
    flat = {c: np.zeros(len(slot), np.int64) for c in column}
    for c, values in column.items():
        flat[c][slot] = values
    parent = table.find(flat["q1"], flat["q2"])
    inside = parent >= 0
    flat["children"] += np.bincount(parent[inside], minlength=len(parent))
    flat["leaves"] += flat["children"] == 0
    flat["saved"] += (flat["n"] - 1) * flat["words"]
    by_depth = np.argsort(flat["depth"], kind="stable")
    level = np.flatnonzero(np.diff(flat["depth"][by_depth], prepend=-1))
    for first, last in zip(level[::-1], [len(by_depth), *level[:0:-1]], strict=True):
        at = by_depth[first:last]
        at = at[inside[at]]
        for c in ("leaves", "saved"):
            np.add.at(flat[c], parent[at], flat[c][at])
    above = pd.array(np.where(inside, flat["least"][parent], 0), "Int64")
    above[~inside] = pd.NA
    return pd.DataFrame(flat | {"parent": above, "top": ~inside}).drop(columns="words")


def _with_sums(nodes: DataFrame, tops: DataFrame | None) -> DataFrame:
    """Nodes with what the subtrees that hang from them bring: the tops' number, leaves and savings by parent."""
    if tops is None:
        return nodes.withColumns({c: F.lit(0).cast("long") for c in ("children", "leaves", "saved")})
    sums = tops.groupBy(F.col("q1").alias("p1"), F.col("q2").alias("p2"), (F.col("depth") - 1).alias("depth")).agg(
        F.count(F.lit(1)).alias("children"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")
    )
    return nodes.join(sums, NAME, "left").fillna(0, ["children", "leaves", "saved"])


def subtree_totals(
    nodes: DataFrame, paths: DataFrame, root: tuple[int, int], crown: int, least: int, shard: int, band: int
) -> DataFrame:
    """``TOTALS`` of all nodes, the root included (``root``: its members and the smallest of them)."""
    spark = nodes.sparkSession
    turns, depth = nodes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("depth"), F.lit(0))).first()
    limit = max(least, turns // crown)  # fewer than ``crown`` nodes have more members than this
    heavy = nodes.where(F.col("n") > limit)
    light = nodes.where(F.col("n") <= limit)
    marks = F.broadcast(heavy.select(*NAME, F.lit(True).alias("heavy")))
    in_band = F.floor((F.col("depth") - 1) / band).alias("band")
    # The top of a node's subtree is the first light prefix (in the band) of any of its members.
    tops = (
        paths.join(marks, NAME, "left")
        .where("heavy is null")
        .groupBy(F.col("conv").alias("least"), in_band)
        .agg(F.min(F.struct("depth", "p1", "p2")).alias("_top"))
    )
    shards = max(1, light.count() // shard)
    dealt = light.withColumn("band", in_band).join(tops, ["least", "band"])
    dealt = stored(dealt.withColumn("shard", F.pmod(F.xxhash64("_top"), F.lit(shards))).drop("_top"), "dealt")
    done, above = [], None
    for b in range((depth - 1) // band if depth else -1, -1, -1):
        own = _with_sums(dealt.where(F.col("band") == b), above)
        totals = own.select("shard", *SHARD_COLUMNS).groupBy("shard").applyInPandas(
            lambda pdf: accumulated(pdf.drop(columns="shard")), TOTALS
        )
        done.append(stored(totals, "subtrees"))
        # What hangs from light nodes is met by the next band; what hangs from the crown waits.
        above = done[-1].where("top")
    top = spark.createDataFrame([(0, 0, 0, 0, 1, root[0], root[1], 0)], "p1 long, p2 long, depth long, q1 long, q2 long, n long, least long, words long")
    hanging = None
    for totals in done:
        hanging = totals.where("top") if hanging is None else hanging.unionByName(totals.where("top"))
    whole = top.unionByName(heavy.select(*top.columns))
    final = _with_sums(whole, hanging).select(F.lit(0).alias("shard"), *SHARD_COLUMNS).groupBy("shard")
    summit = stored(final.applyInPandas(lambda pdf: accumulated(pdf.drop(columns="shard")), TOTALS), "crown")
    out = summit
    parents = F.broadcast(summit.select(F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("least").alias("_above")))
    for totals in done:
        out = out.unionByName(totals.join(parents, ["q1", "q2"], "left").withColumn("parent", F.coalesce("parent", "_above")).drop("_above"))
    if len(done) > 1:  # tops whose parent is a light node of the band above
        light = nodes.select(F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("least").alias("_above"))
        lost = F.col("parent").isNull() & (F.col("depth") > 0)
        found = out.where(lost).join(light, ["q1", "q2"], "left").withColumn("parent", F.col("_above")).drop("_above")
        out = out.where(~lost).unionByName(found)
    return out


# --- ends ----------------------------------------------------------------------


def _pieces(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The ids of each name's run of rows, joined by commas, at most ``PIECE`` together."""
    number = 0
    for pdf in frames:
        if not len(pdf):
            continue
        p1, p2 = pdf["p1"].to_numpy(), pdf["p2"].to_numpy()
        new = np.flatnonzero(np.r_[True, (p1[1:] != p1[:-1]) | (p2[1:] != p2[:-1])])
        ids = pdf["conv"].to_numpy()
        bounds = [(at, min(at + PIECE, b)) for a, b in zip(new, [*new[1:], len(ids)], strict=True) for at in range(a, b, PIECE)]
        yield pd.DataFrame(
            {
                "p1": [p1[a] for a, _ in bounds],
                "p2": [p2[a] for a, _ in bounds],
                "part": pdf["_part"].to_numpy()[[a for a, _ in bounds]],
                "piece": range(number, number + len(bounds)),
                "ids": [",".join(map(str, ids[a:b].tolist())) for a, b in bounds],
            }
        )
        number += len(bounds)


def _digests(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The hash of each name's pieces, as they stream by."""
    name, state = None, None
    for pdf in frames:
        out = []
        for p1, p2, ids in zip(pdf["p1"], pdf["p2"], pdf["ids"], strict=True):
            if (p1, p2) == name:
                state.update(b",")
            else:
                if name is not None:
                    out.append((*name, state.hexdigest()))
                name, state = (p1, p2), hashlib.sha256()
            state.update(ids.encode())
        yield pd.DataFrame(out, columns=["p1", "p2", "ends"])
    if name is not None:
        yield pd.DataFrame([(*name, state.hexdigest())], columns=["p1", "p2", "ends"])


def end_digests(paths: DataFrame, lengths: DataFrame) -> DataFrame:
    """(p1, p2, ends): for each prefix that is all of some conversations, the SHA-256 of their ids."""
    zero = F.lit(0).cast("long")
    ends = paths.where("last").select("p1", "p2", "conv")
    ends = ends.union(lengths.where("n = 0").select(zero, zero, "conv"))
    parts = _in_parts(ends, F.col("p1"), F.col("p2"), F.col("conv"))
    pieces = stored(parts.mapInPandas(_pieces, "p1 long, p2 long, part int, piece long, ids string"), "pieces")
    by_name = pieces.repartition("p1", "p2").sortWithinPartitions("p1", "p2", "part", "piece")
    return by_name.select("p1", "p2", "ids").mapInPandas(_digests, "p1 long, p2 long, ends string")


# --- the trie ------------------------------------------------------------------


def prefix_trie(
    df: DataFrame,
    key: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    every: int = 20,
    of: int = 4,
    crown: int = CROWN,
    least: int = LEAST,
    shard: int = SHARD,
    band: int = BAND,
) -> DataFrame:
    """A line for each node of the trie of the rebuilt conversations' prefixes (see ``rebuilt``).

    Returns (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256): the smallest
    member (conversation that begins with the prefix), turns, the parent's smallest member (null for the root), members,
    children, leaves of the subtree, words that sharing the subtree's texts saves, and the SHA-256 of the decimal ids,
    rising and joined by commas, of the members that end there (of nothing if none does).

    Ids are integers; rows without one belong to no conversation.  Turns are ordered by number (null first), then role,
    then text; a repeated row is a turn of its own; null roles and texts are empty.  Conversations that rebuilding
    leaves without turns are members of the root alone; an empty table has no root, so the result is empty.  Only the
    named columns are read.  Nodes are told apart by 128-bit names, and a name with two parents raises an error.
    """
    spark = df.sparkSession
    turns, lengths = rebuilt(ordered_turns(df, key, turn, role, text), every, of)
    n, smallest = lengths.agg(F.count(F.lit(1)), F.min("conv")).first()
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    if not n:
        return spark.createDataFrame([], ", ".join(f"{c} long" for c in names) + ", ends_sha256 string")
    paths = prefixes(turns, lengths)
    totals = subtree_totals(nodes_of(paths), paths, (n, smallest), crown, least, shard, band)
    out = totals.join(end_digests(paths, lengths), ["p1", "p2"], "left")
    columns = ["least", "depth", "parent", "n", "children", "leaves", "saved"]
    nothing = hashlib.sha256().hexdigest()
    return out.select(
        *[F.col(c).alias(name) for c, name in zip(columns, names, strict=True)],
        F.coalesce("ends", F.lit(nothing)).alias("ends_sha256"),
    )
