"""Operator 10: n-gram Jaccard join with token-combination prefixes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.llm.common import components, stored
from clickloom.llm.shingles import mixed, set_id, shingles
from clickloom.llm.units import batches

#: A shingle is frequent when more than this many sets have it.
RARE = 32
#: Bits of the map of frequent shingles, whatever the corpus; it is what is broadcast (4 MB).
MAP_BITS = 25
#: Index entries or shingles that a bucket is meant for.
BUCKET = 1_000_000
#: Sets that are compared with one set in one place.
PART = 256
#: Members of a posting that meet in one place; longer postings are cut into blocks, which meet pair by pair.
BLOCK = 2048
#: Rows of a group of narrow rows, set names that a task remembers, and pairs that it holds before it sends them on.
MANY = 200_000
#: Entries of postings that are meant for one place when those of one component are dealt out.
ROOM = 30_000
_PAIR = np.uint64(0x8EBC6AF09C88C6E3)


def _pack(a: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(a).tobytes(), 1)


def _unpack(b: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(b), kind)


def _pack_sorted(a: np.ndarray) -> bytes:
    """Sorted values as differences, byte by byte: the high bytes are mostly zero."""
    d = np.diff(a, prepend=a.dtype.type(0))
    return _pack(d.view(np.uint8).reshape(len(d), a.dtype.itemsize).T)


def _unpack_sorted(b: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    d = np.ascontiguousarray(_unpack(b, np.uint8).reshape(size, -1).T).view(kind).ravel()
    return np.cumsum(d, dtype=kind)


def _buckets(n: int) -> int:
    """Bits of the bucket number for n entries."""
    return min(20, max(4, ceil(np.log2(max(n, 1) / BUCKET)) if n else 4))


def _cut(values: np.ndarray, bits: int) -> Iterator[tuple[int, int, int]]:
    """(bucket, from, to) of sorted values for buckets that have any; a bucket is a range of their top bits."""
    top = values >> np.uint64(64 - bits)
    starts = np.flatnonzero(np.r_[True, top[1:] != top[:-1]]) if len(top) else np.empty(0, int)
    yield from zip(top[starts].tolist(), starts, np.r_[starts[1:], len(values)], strict=True)


def _spread(key: str | None, groups: int) -> int:
    """One of the groups for narrow rows that need no group."""
    return xxhash.xxh3_64_intdigest(key or "") % groups


def parities(tokens: np.ndarray) -> bytes:
    """The parity of the number of shingles on each of 2n to 4n bits: the XOR of two is that of what one set alone has.

    So its bits are at most the size of the symmetric difference, which bounds the similarity from above.
    """
    bits = max(64, 1 << (2 * len(tokens) - 1).bit_length())
    odd = np.bincount((tokens & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


class Parities:
    """The parity bits of the members of a posting, in the order of their sizes."""

    def __init__(self, packed: list[bytes]):
        self.width = np.array([len(b) for b in packed])
        self.at: dict[int, tuple[int, np.ndarray]] = {}
        for w in np.unique(self.width).tolist():
            lo, mid, hi = np.searchsorted(self.width, [w, w + 1, 2 * w + 1])
            same = np.frombuffer(b"".join(packed[lo:mid]), np.uint64).reshape(mid - lo, -1)
            wider = np.frombuffer(bytearray().join(packed[mid:hi]), np.uint64).reshape(hi - mid, 2, w // 8)
            self.at[w] = lo, np.concatenate([same, wider[:, 0] ^ wider[:, 1]])  # folded to the same width

    def apart(self, i: int, others: np.ndarray) -> np.ndarray:
        """A lower bound of the shingles that only one has, for member i and others that are no smaller, nor twice its size."""
        lo, rows = self.at[int(self.width[i])]
        return np.bitwise_count(rows[others - lo] ^ rows[i - lo]).sum(axis=1, dtype=np.int64)


@dataclass(frozen=True)
class Scheme:
    """What a set puts into the index, for a least similarity of percent / 100."""

    percent: int

    def __post_init__(self):
        if not 50 < self.percent <= 100:
            raise ValueError("the similarity must be over 50 %")

    def least(self, n: int) -> int:
        """Least number of shingles that a similar set shares with one of n."""
        return -(-n * self.percent // 100)

    def shared_pairs(self, n: int, rare: int) -> int:
        """Least number of neighbouring frequent pairs that two similar sets share which share no rare shingle.

        One has n shingles, ``rare`` of them rare; the other has at least least(n).  They share o >= (n + m) p / (100 + p);
        every frequent shingle that only one has parts at most one of the o - 1 neighbouring pairs of shared ones.
        """
        both = n + self.least(n)
        return -(-both * (2 * self.percent - 100) // (100 + self.percent)) - 1 + rare

    def keys(self, tokens: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, bool]:
        """Index keys of a set of sorted shingles, and whether its prefix reaches into the frequent ones.

        The order of shingles is: rare ones by hash, then frequent ones by hash.  Similar sets share a shingle of
        their prefixes, n - least(n) + 1 shingles.  If they share a rare one, it is a key of both.  If not, both
        prefixes reach into the frequent shingles, and all that they share is frequent.  Then the prefix is extended
        over all frequent shingles, and combinations of two that follow each other in the order are indexed; as at
        least shared_pairs of them are common, all but shared_pairs - 1 of them, in the order of their hash, will do.
        Sets so small that none need be common index their frequent shingles singly as well.
        """
        n = len(tokens)
        prefix = n - self.least(n) + 1
        rare, often = tokens[~frequent], tokens[frequent]
        if len(rare) >= prefix:
            return rare[:prefix], False
        pairs = np.sort(mixed(often[:-1] * _PAIR + often[1:]))
        common = self.shared_pairs(n, len(rare))
        keys = [rare, pairs[: max(0, len(pairs) - max(common, 1) + 1)]]
        if any(self.shared_pairs(m, 0) < 1 for m in range(self.least(n), min(n * 100 // self.percent, 64) + 1)):
            keys.append(often)
        return np.unique(np.concatenate(keys)), True

    def enough(self, w: Column, x: Column, y: Column) -> Column:
        """Whether sets with traits x and y that share w keys can be similar.

        What two sets share beyond the end of a prefix is at most what the longer rest holds, least(n) - 1.  So of the
        (n + m) p / (100 + p) shingles that similar sets share, all others are keys of both, unless both prefixes
        reach into the frequent shingles; then one key will do.
        """
        n, m = F.shiftright(x, 1), F.shiftright(y, 1)
        shared = F.ceil((n + m) * self.percent / (100 + self.percent) - 1e-9)
        rest = F.ceil(F.greatest(n, m) * self.percent / 100 - 1e-9) - 1
        return ((x.bitwiseAND(y).bitwiseAND(1)) == 1) | (w >= shared - rest)

    def fits(self, n: np.ndarray, m: np.ndarray) -> np.ndarray:
        """Whether sets of these sizes can be similar."""
        return 100 * np.minimum(n, m) >= self.percent * np.maximum(n, m)

    def most_apart(self, n: np.ndarray, m: np.ndarray) -> np.ndarray:
        """The most shingles that only one of two similar sets of these sizes has."""
        both = n + m
        return both - 2 * -(-both * self.percent // (100 + self.percent))

    def similar(self, a: np.ndarray, b: np.ndarray) -> bool:
        shared = len(np.intersect1d(a, b, assume_unique=True))
        return 100 * shared >= self.percent * (len(a) + len(b) - shared)


def _sets(
    frames: Iterator[pd.DataFrame], chars: int = 1 << 23, empty: bool = False
) -> Iterator[list[tuple[object, int | None, np.ndarray]]]:
    """Batches of (key, set name, shingles) of the texts that have any, or of all texts."""
    for frame in frames:
        keys, texts = frame["_key"].tolist(), frame["_text"].fillna("").tolist()
        for start, end in batches(texts, chars):
            found = ((k, shingles(t)) for k, t in zip(keys[start:end], texts[start:end], strict=True))
            yield [(k, set_id(s) if len(s) else None, s) for k, s in found if empty or len(s)]


def _new(batch: list, seen: set[int]) -> list:
    """The sets of a batch that the task has not met, as far as it remembers: most copies count once in a task."""
    out = []
    if len(seen) > MANY:
        seen.clear()
    for row in batch:
        if row[1] not in seen:
            seen.add(row[1])
            out.append(row)
    return out


def profiled(rows: DataFrame, total: int, groups: int) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """(_key, node, size) of every row (its set's name and size; null and 0 without one), (node, parities), the frequent shingles.

    Every task counts the shingles of its batches and sends them on by range of hash; a bucket adds them up and gives
    its piece of a map by their top bits, of fixed size.  A rare shingle that falls on the bit of a frequent one counts
    as frequent, for every set alike, so that results do not depend on it.
    """
    bits = _buckets(total)
    low = np.uint64(32 - bits)

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        for batch in _sets(frames, 1 << 22, empty=True):
            out = []
            # Without nulls, which pandas would meet by turning the whole numbers into floats.
            known = [node or 0 for _, node, _ in batch], [len(s) for _, _, s in batch]
            row = (-1 - _spread(batch[0][0], groups), None, None, [k for k, _, _ in batch], *known)
            batch = _new([row for row in batch if len(row[2])], seen)
            out.append((*row, [node for _, node, _ in batch], [parities(s) for _, _, s in batch]))
            if batch:
                values = np.sort(np.concatenate([s for _, _, s in batch]))
                first = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
                n = np.diff(np.r_[first, len(values)]).astype(np.uint32)
                values = values[first]
                for k, lo, hi in _cut(values, bits):
                    short = (values[lo:hi] >> low).astype(np.uint32)  # what the bucket leaves open
                    out.append((k, _pack_sorted(short), _pack(n[lo:hi]), *[None] * 5))
            yield pd.DataFrame(out, columns=["bucket", "part", "n", "keys", "nodes", "sizes", "news", "parities"])

    piece = max(1, (1 << MAP_BITS) >> bits)

    def add(parts: pd.DataFrame) -> pd.DataFrame:
        bucket = parts["bucket"].iloc[0]
        if bucket < 0:
            told = pd.DataFrame({c: [x for xs in parts[f"{c}s"] for x in xs] for c in ("key", "node", "size")})
            told = told.rename(columns={"key": "_key"}).assign(bucket=bucket, marks=None)
            bits = pd.DataFrame({"node": [x for xs in parts["news"] for x in xs], "marks": [x for xs in parts["parities"] for x in xs]})
            return pd.concat([told, bits.drop_duplicates("node").assign(_key=None, size=-1, bucket=bucket)])
        short = np.concatenate([_unpack_sorted(b, np.uint32) for b in parts["part"]])
        n = np.concatenate([_unpack(b, np.uint32) for b in parts["n"]])
        order = np.argsort(short, kind="stable")
        short, n = short[order], n[order]
        starts = np.flatnonzero(np.r_[True, short[1:] != short[:-1]])
        often = short[starts][np.add.reduceat(n, starts) > RARE]
        mark = np.zeros(piece, bool)
        mark[(often.astype(np.uint64) * np.uint64(piece)) >> np.uint64(32)] = True
        empty = {"_key": [None], "node": [0], "size": [0]}
        return pd.DataFrame({"bucket": [bucket], "marks": [np.packbits(mark).tobytes()], **empty})

    kinds = "bucket int, part binary, n binary, keys array<string>, nodes array<long>, sizes array<long>"
    kinds += ", news array<long>, parities array<binary>"
    found = rows.mapInPandas(count, kinds).groupBy("bucket")
    kinds = "_key string, node long, size long, bucket int, marks binary"
    found = stored(found.applyInPandas(lambda x: add(x)[["_key", "node", "size", "bucket", "marks"]], kinds), "profile")
    out = np.zeros(1 << MAP_BITS, bool)
    for r in found.where("bucket >= 0").select("bucket", "marks").collect():
        out[r["bucket"] * piece : (r["bucket"] + 1) * piece] = np.unpackbits(np.frombuffer(r["marks"], np.uint8))[:piece]
    node = F.when(F.col("size") > 0, F.col("node")).alias("node")
    known = found.where("bucket < 0 and size >= 0").select("_key", node, "size")
    bits = found.where("bucket < 0 and size < 0").select("node", F.col("marks").alias("parities"))
    return known, bits.dropDuplicates(["node"]), np.packbits(out)


def _marked(marks: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    at = tokens >> np.uint64(64 - MAP_BITS)
    return (marks[at >> np.uint64(3)] >> (np.uint64(7) - (at & np.uint64(7))).astype(np.uint8)) & 1 == 1


def postings(rows: DataFrame, marks: np.ndarray, scheme: Scheme, total: int) -> DataFrame:
    """(run, n, nodes, traits): the sets that share a key, for every different list of two sets or more.

    n is the number of keys that have the list (in a bucket); a trait is twice a set's size, and one more if its
    prefix reaches into the frequent shingles.  Index entries go by range of key to buckets, of which there are the more the more entries there are.
    """
    bits = _buckets(total // 3)
    shared = rows.sparkSession.sparkContext.broadcast(marks.tobytes())

    def index(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        marks, seen = np.frombuffer(shared.value, np.uint8), set()
        for batch in _sets(frames, 1 << 22):
            batch = _new(batch, seen)
            if not batch:
                continue
            keys, heavy = zip(*(scheme.keys(s, _marked(marks, s)) for _, _, s in batch), strict=True)
            owner = np.repeat(np.arange(len(batch), dtype=np.uint32), [len(k) for k in keys])
            key = np.concatenate(keys)
            order = np.argsort(key, kind="stable")
            key, owner = key[order], owner[order]
            nodes = np.array([node for _, node, _ in batch], np.int64)
            sizes = np.array([2 * len(s) + h for (_, _, s), h in zip(batch, heavy, strict=True)], np.int64)
            out = []
            for k, lo, hi in _cut(key, bits):
                # 32 bits of a key beside its bucket: keys that share them make candidates, which are compared.
                short = (key[lo:hi] >> np.uint64(32 - bits)).astype(np.uint32)
                used, at = np.unique(owner[lo:hi], return_inverse=True)
                out.append((k, _pack_sorted(short), _pack(at.astype(np.uint16)), _pack(nodes[used]), _pack(sizes[used])))
            yield pd.DataFrame(out, columns=["bucket", "key", "owner", "node", "size"])

    def meet(parts: pd.DataFrame) -> pd.DataFrame:
        key, node, size = [], [], []
        for k, o, n, s in zip(parts["key"], parts["owner"], parts["node"], parts["size"], strict=True):
            at = _unpack(o, np.uint16)
            key.append(_unpack_sorted(k, np.uint32))
            node.append(_unpack(n, np.int64)[at])
            size.append(_unpack(s, np.int64)[at])
        key, node, size = (np.concatenate(x) for x in (key, node, size))
        order = np.lexsort((node, key))
        key, node, size = key[order], node[order], size[order]
        first = np.r_[True, (key[1:] != key[:-1]) | (node[1:] != node[:-1])]  # a set may come from several tasks
        key, node, size = key[first], node[first], size[first]
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        n = np.diff(np.r_[starts, len(key)])
        run = mixed(np.add.reduceat(mixed(node.view(np.uint64)), starts) + n.astype(np.uint64)).view(np.int64)
        _, one, times = np.unique(run, return_index=True, return_counts=True)
        at = [(i, t, slice(starts[i], starts[i] + n[i])) for i, t in zip(one, times, strict=True) if n[i] > 1]
        out = [(run[i], t, node[s], size[s]) for i, t, s in at]
        return pd.DataFrame(out, columns=["run", "n", "nodes", "traits"])

    kinds = "bucket int, key binary, owner binary, node binary, size binary"
    found = rows.mapInPandas(index, kinds).groupBy("bucket")
    return found.applyInPandas(meet, "run long, n long, nodes array<long>, traits array<long>")


_PAIRS = "a long, b long, x long, y long, w long"


def _pairs_frame(found: list[tuple]) -> pd.DataFrame:
    """Distinct pairs (a < b) with their traits (x, y), and the keys they share (w), from (nodes, traits, nodes, traits, n)."""
    if not found:
        return pd.DataFrame({c: np.empty(0, np.int64) for c in "abxyw"})
    a, x, b, y, w = (np.concatenate([np.broadcast_to(f[i], np.shape(f[2])) for f in found]) for i in range(5))
    turn = a > b
    frame = {"a": np.where(turn, b, a), "b": np.where(turn, a, b), "x": np.where(turn, y, x), "y": np.where(turn, x, y)}
    return pd.DataFrame(frame | {"w": w}).groupby(["a", "b"], as_index=False).agg({"x": "first", "y": "first", "w": "sum"})


def _counted(pairs: DataFrame, scheme: Scheme) -> DataFrame:
    """The pairs that share keys enough."""
    total = pairs.groupBy("a", "b").agg(F.min("x").alias("x"), F.min("y").alias("y"), F.sum("w").alias("w"))
    return total.where(scheme.enough(F.col("w"), F.col("x"), F.col("y"))).select("a", "b")


def to_pivots(runs: DataFrame, scheme: Scheme) -> DataFrame:
    """Pairs (a, b) of each posting's members with a pivot of it that they fit in size: as many as there are members.

    The pivot is the smallest node, so that postings of one group mostly share it; members that cannot be similar to
    it choose a pivot among themselves.  Keys are counted where the pivot is the same, so a pair may fall short.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = []
            for n, nodes, traits in zip(frame["n"], frame["nodes"], frame["traits"], strict=True):
                while len(nodes) > 1:
                    p = nodes.argmin()
                    fit = scheme.fits(traits >> 1, traits[p] >> 1)
                    fit[p] = False
                    if fit.any():
                        found.append((nodes[p], traits[p], nodes[fit], traits[fit], n))
                    fit[p] = True
                    nodes, traits = nodes[~fit], traits[~fit]
            yield _pairs_frame(found)

    return _counted(runs.select("n", "nodes", "traits").mapInPandas(run, _PAIRS), scheme)


def across(runs: DataFrame, reached: DataFrame, bits: DataFrame, scheme: Scheme) -> DataFrame:
    """Pairs (a, b) in the postings whose sets are not yet in one component, fit in size and share keys enough.

    Pairs whose parities differ in more bits than similar sets may differ in shingles never become rows.  Of a long
    posting any two blocks meet, each pair of blocks in its own place.  Sets that share one key mostly share many, so
    postings with the same smallest component go to the same place, as far as there is room, and a pair leaves it once.
    """
    lists = runs.groupBy("run").agg(F.sum("n").alias("n"), F.first(F.arrays_zip("nodes", "traits")).alias("m"))
    entries = lists.select("run", "n", F.explode("m").alias("m")).select("run", "n", "m.nodes", "m.traits")
    known = reached.select(F.col("node").alias("_node"), "component")
    entries = entries.join(known, F.col("nodes") == F.col("_node"), "left")
    entries = entries.select("run", "n", "nodes", "traits", F.coalesce("component", "nodes").alias("c"))
    entries = stored(entries, "entries")
    several = entries.groupBy("run").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count(F.lit(1)).alias("m"))
    several = stored(several.where("lo <> hi"), "several")
    large = several.groupBy(F.col("lo").alias("_lo")).agg(F.ceil(F.sum("m") / ROOM).alias("places")).where("places > 1")
    several = several.join(large, F.col("lo") == F.col("_lo"), "left").select(
        F.col("run").alias("_run"), "lo", F.coalesce("places", F.lit(1)).alias("places"), F.ceil(F.col("m") / BLOCK).cast("int").alias("k")
    )
    left = entries.join(several, F.col("run") == F.col("_run"))
    left = left.join(bits.withColumnRenamed("node", "_node"), F.col("nodes") == F.col("_node"))
    left = left.withColumn("block", F.pmod(F.xxhash64("nodes"), F.col("k")).cast("int"))
    meets = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda o: F.struct(F.least("block", o).alias("i"), F.greatest("block", o).alias("j")))
    left = left.withColumn("cell", F.explode(meets))
    left = left.withColumn("place", F.pmod(F.xxhash64("run", "cell.i", "cell.j"), F.col("places"))).repartition("lo", "place")
    member = F.struct("nodes", "traits", "c", "block", "parities")
    lists = left.groupBy("lo", "place", "run", "n", "cell").agg(F.collect_list(member).alias("m"))
    lists = lists.select("n", (F.col("cell.i") != F.col("cell.j")).alias("two"), *(F.col(f"m.{c}") for c in ("nodes", "traits", "c", "block", "parities")))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found, held = [], 0
        for frame in frames:
            for n, two, nodes, traits, cs, block, packed in frame.itertuples(index=False):
                order = np.argsort(traits, kind="stable")
                nodes, traits, cs, block = nodes[order], traits[order], cs[order], block[order]
                parity = Parities([packed[i] for i in order])
                sizes = traits >> 1
                ends = np.searchsorted(sizes, sizes * 100 // scheme.percent, side="right")
                for i, end in enumerate(ends.tolist()):  # partners of i are no smaller, and fit
                    other = cs[i + 1 : end] != cs[i]
                    if two:
                        other &= block[i + 1 : end] != block[i]
                    other = np.flatnonzero(other) + i + 1
                    if len(other):
                        other = other[parity.apart(i, other) <= scheme.most_apart(sizes[i], sizes[other])]
                    if len(other):
                        found.append((nodes[i], traits[i], nodes[other], traits[other], n))
                        held += len(other)
                    if held > MANY:
                        pairs = _pairs_frame(found)
                        if len(pairs) > MANY // 2:
                            yield pairs
                            found, held = [], 0
                        else:
                            found, held = [tuple(pairs[c].to_numpy() for c in "axbyw")], len(pairs)
        yield _pairs_frame(found)

    return _counted(lists.mapInPandas(run, _PAIRS), scheme)


def _key_map(keys: DataFrame) -> bytes:
    """A map of fixed size of the hashes in column h, for skipping rows early."""

    def mark(part: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(1 << (MAP_BITS - 6), bool)
        bits[part["at"].to_numpy() & ((1 << (MAP_BITS - 6)) - 1)] = True
        return pd.DataFrame({"slice": part["slice"].iloc[:1], "marks": [np.packbits(bits).tobytes()]})

    at = F.shiftrightunsigned("h", 64 - MAP_BITS)
    placed = keys.select(at.alias("at")).distinct().withColumn("slice", F.shiftright("at", MAP_BITS - 6))
    out = [bytes(1 << (MAP_BITS - 9))] * 64
    for r in placed.groupBy("slice").applyInPandas(mark, "slice long, marks binary").collect():
        out[r["slice"]] = bytes(r["marks"])
    return b"".join(out)


def _pack_set(tokens: np.ndarray) -> bytes:
    """48 bits of each shingle, as many as tell those of two sets apart."""
    return _pack_sorted(tokens >> np.uint64(16))


def set_table(rows: DataFrame, known: DataFrame, pairs: DataFrame) -> DataFrame:
    """(node, tokens) of the nodes in the pairs, made again from the text of one document of each.

    A few nodes may be there that are not wanted, and repeated rows may give a node twice; pairs do not mind.
    """
    first = known.where(F.col("node").isNotNull()).groupBy("node").agg(F.min("_key").alias("_rep"))
    wanted = pairs.select(F.col("a").alias("_w")).union(pairs.select("b")).distinct()
    first = first.join(wanted, F.col("node") == F.col("_w"))
    marks = rows.sparkSession.sparkContext.broadcast(_key_map(first.select(F.xxhash64("_rep").alias("h"))))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, seen = np.frombuffer(marks.value, np.uint8), set()

        def chosen():
            for frame in frames:
                yield frame[_marked(at, frame["h"].to_numpy().view(np.uint64))]

        for batch in _sets(chosen()):
            new = [(node, _pack_set(s)) for _, node, s in _new(batch, seen)]
            yield pd.DataFrame(new, columns=["node", "tokens"])

    return stored(rows.withColumn("h", F.xxhash64("_key")).mapInPandas(run, "node long, tokens binary"), "sets")


def verified(pairs: DataFrame, sets: DataFrame, scheme: Scheme) -> DataFrame:
    """The pairs (a, b) whose sets are similar.

    The sets of all b of an a are sent to where the set of a is; an a with many is dealt out, its set to each part.
    """
    many = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > PART)
    many = stored(many.select(F.col("a").alias("_a"), F.ceil(F.col("n") / PART).alias("parts")), "many")
    dealt = pairs.join(many, F.col("a") == F.col("_a"), "left")
    salt = F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1))).cast("int")
    dealt = stored(dealt.select("a", salt.alias("salt"), "b"), "dealt")
    ends = dealt.select("a", "salt", F.lit(True).alias("own"), F.col("a").alias("node")).distinct()
    ends = ends.union(dealt.select("a", "salt", F.lit(False), "b"))
    named = sets.withColumnRenamed("node", "_node")
    sent = ends.join(named, F.col("node") == F.col("_node")).drop("_node")
    sent = sent.repartition("a", "salt").sortWithinPartitions("a", "salt", F.desc("own"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens = np.empty(0, np.uint64)
        for frame in frames:
            out = []
            for a, own, b, packed in zip(*(frame[c].tolist() for c in ("a", "own", "node", "tokens")), strict=True):
                if own:
                    tokens = _unpack_sorted(packed, np.uint64)
                elif scheme.similar(tokens, _unpack_sorted(packed, np.uint64)):
                    out.append((a, b))
            yield pd.DataFrame(out, columns=["a", "b"])

    return sent.select("a", "own", "node", "tokens").mapInPandas(run, "a long, b long")


def similar_groups(df: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 75) -> DataFrame:
    """(key, n_shingles, component_id): every row's component under links between sets of five-word shingles.

    Two rows link when 100 * shared shingles >= percent * shingles of either.  Rows with equal sets are one node, so
    copies cost nothing.  Candidates come from the index of ``Scheme.keys`` and are compared in full.  First
    every posting's members meet a pivot; that joins nearly all that belongs together, at one comparison a member.  Then
    all pairs of a posting that are still in different components and that their parities do not tell apart are compared,
    so no link between components is missed, and only pairs that cannot change them are passed over.

    The component is the smallest key in it.  Rows without words link with nothing and are their own component, as
    are rows with a null key (null component).  Repeated keys with different texts join what each of them links with.
    An empty table gives an empty result.
    """
    scheme = Scheme(percent)
    kind = df.schema[key].dataType
    rows = df.select(F.col(key).cast("string").alias("_key"), F.col(text).alias("_text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("_text")), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("rows")).first()
    total = size["n"] // 6  # shingles, about: it only sizes the buckets
    known, bits, marks = profiled(rows, total, max(61, size["rows"] // MANY))
    runs = stored(postings(rows, marks, scheme, total), "postings")
    pairs = stored(to_pivots(runs, scheme), "pairs")
    links = stored(verified(pairs, set_table(rows, known, pairs), scheme), "similar")
    more = across(runs, components(links), bits, scheme)
    more = stored(more.join(pairs, ["a", "b"], "left_anti"), "pairs")
    links = links.union(stored(verified(more, set_table(rows, known, more), scheme), "similar"))
    return _told(known, links, key, kind)


def _told(known: DataFrame, links: DataFrame, key: str, kind) -> DataFrame:
    """Components of rows from links of nodes; a key that has several nodes joins them."""
    typed: Column = F.col("_key").cast(kind)
    nodes = known.where("node is not null and _key is not null")
    chain = nodes.groupBy("_key").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b")
    several = nodes.join(chain.select(F.col("_key").alias("_k"), "a"), F.col("_key") == F.col("_k"))
    reached = components(links.union(several.select("a", F.col("node").alias("b"))))
    reached = reached.select(F.col("node").alias("_node"), "component")
    per_node = known.groupBy("node").agg(F.min(typed).alias("least")).where("node is not null")
    per_node = per_node.join(reached, F.col("node") == F.col("_node"), "left")
    per_node = stored(per_node.select("node", "least", F.coalesce("component", "node").alias("c")), "nodes")
    least = stored(per_node.groupBy("c").agg(F.min("least").alias("component_id")), "least")
    told = per_node.join(least.withColumnRenamed("c", "_c"), F.col("c") == F.col("_c"))
    told = stored(told.select(F.col("node").alias("_node"), "component_id"), "told")
    out = known.join(told, F.col("node") == F.col("_node"), "left")
    own = F.when(F.col("_key").isNotNull(), F.coalesce("component_id", typed))
    return out.select(typed.alias(key), F.col("size").alias("n_shingles"), own.alias("component_id"))
