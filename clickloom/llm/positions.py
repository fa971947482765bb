"""Operator 11: a distributed positional inverted index, and exact and near phrases of benchmark items found in it.

The index is a table of segments.  A segment holds about ``SEGMENT`` words of neighbouring rows as a small inverted
index: a sorted dictionary of term hashes, and for each term the sorted list of its places.  A long text lies in
several segments, cut into pieces that overlap, so a segment's size does not depend on a text's, and a frequent term's
list is no longer than its segment.  Phrases are looked up in every segment: the places of a phrase's rarest term there,
less the term's offset in the phrase, are its possible beginnings, and the lists of the other terms, the next rarest
first, are intersected with them after the same adjustment.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickloom.llm.common import stored
from clickloom.llm.shingles import _BASE, _LENGTH, _POWERS, mixed

#: Words in a segment, at least (a piece more at most).
SEGMENT = 1 << 18
#: Places left free between two rows of a segment, and words that two pieces of a row share on either side: no phrase,
#: slack included, may be longer.
REACH = 64
#: Benchmark words that are looked up together, and possible beginnings that are tested together.
BLOCK = 1 << 16
TESTED = 1 << 20
_BYTES = 1 << 20

INDEX = T.StructType(
    [
        T.StructField("rows", T.ArrayType(T.LongType())),
        T.StructField("keys", T.ArrayType(T.StringType())),
        T.StructField("skipped", T.BinaryType()),  # by piece: words of the row before the piece
        T.StructField("own", T.BinaryType()),  # by piece: words counted for it; pieces overlap in the others
        T.StructField("begin", T.BinaryType()),  # by piece: its first place
        T.StructField("terms", T.BinaryType()),  # sorted hashes
        T.StructField("ends", T.BinaryType()),  # by term: the end of its list in places
        T.StructField("places", T.BinaryType()),
    ]
)
ITEMS = T.StructType(
    [
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("lengths", T.BinaryType()),
        T.StructField("words", T.BinaryType()),
    ]
)
FOUND = T.StructType(
    [
        T.StructField("_row", T.LongType()),
        T.StructField("_key", T.StringType()),
        T.StructField("n_words", T.LongType()),
        T.StructField("item", T.StringType()),
        T.StructField("exact", T.BooleanType()),
        T.StructField("start", T.LongType()),
        T.StructField("end", T.LongType()),
    ]
)


def _values() -> np.ndarray:
    """By byte: 0 outside words, else its value in lower case and one more (bytes from 0x80 belong to words)."""
    value = np.zeros(256, np.uint64)
    for low, high in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
        value[low : high + 1] = np.arange(low, high + 1) + 1
    value[0x41:0x5B] += 0x20
    return value


_VALUE = _values()


def _pieces_of_words(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, polynomial) of the runs of word bytes of a block; a run ends at every edge (where a text begins)."""
    value = _VALUE[data]
    word = value > 0
    begins = np.r_[True, ~word[:-1]]
    begins[edges] = True
    starts = np.flatnonzero(word & begins)
    ends = np.flatnonzero(word & np.r_[begins[1:] | ~word[1:], True]) + 1
    up, down = _POWERS.upto(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(value * up, out=sums[1:])
    return starts, ends - starts, (sums[ends] - sums[starts]) * down[starts]


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of every word of texts that lie end to end in ``data``, from ``offsets``, in order.

    Words are runs of 0-9, letters a-z (A-Z count as these) and code points from 0x80.  The bytes are taken block by
    block; a word that goes on in the next block is put together from its parts, so no array grows with a text.
    """
    texts, hashes = [], []
    part = None  # a word that may go on: its text, length and polynomial
    edges = np.unique(offsets[:-1])
    for at in range(0, len(data), _BYTES):
        block = data[at : at + _BYTES]
        inside = edges[np.searchsorted(edges, at) : np.searchsorted(edges, at + len(block))] - at
        start, length, poly = _pieces_of_words(block, inside)
        text = np.searchsorted(offsets, start + at, side="right") - 1
        if part is not None:
            goes_on = len(start) and start[0] == 0 and text[0] == part[0]
            if goes_on:
                poly[:1] = poly[:1] * np.uint64(pow(_BASE, int(part[1]), 1 << 64)) + np.array([part[2]])
                length[0] += part[1]
            else:
                texts.append(np.array([part[0]]))
                hashes.append(_finished(np.array([part[2]], np.uint64), np.array([part[1]])))
            part = None
        if len(start) and at + len(block) < len(data) and _VALUE[block[-1]]:
            part = text[-1], length[-1], poly[-1]
            text, length, poly = text[:-1], length[:-1], poly[:-1]
        texts.append(text)
        hashes.append(_finished(poly, length))
    if part is not None:
        texts.append(np.array([part[0]]))
        hashes.append(_finished(np.array([part[2]], np.uint64), np.array([part[1]])))
    if not texts:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    return np.concatenate(texts), np.concatenate(hashes)


def _finished(poly: np.ndarray, length: np.ndarray) -> np.ndarray:
    return mixed(poly + length.astype(np.uint64) * _LENGTH)


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a batch's texts end to end, and where each begins (null: empty)."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    if column.buffers()[2] is None or offsets[-1] == offsets[0]:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8, int(offsets[-1] - offsets[0]), int(offsets[0]))
    return data, offsets - offsets[0]


def _slices(offsets: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``size`` bytes, or one longer text."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(int(np.searchsorted(offsets, offsets[first] + size, side="right")) - 1, first + 1)
        yield first, last
        first = last


class _Segment:
    """Pieces of rows gathered until they are enough for a segment."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.rows, self.keys, self.skipped, self.own, self.begin, self.words, self.places = [], [], [], [], [], [], []
        self.n = self.at = 0

    def add(self, row: int, key: str | None, skipped: int, own: int, words: np.ndarray) -> None:
        for name, value in (("rows", row), ("keys", key), ("skipped", skipped), ("own", own), ("begin", self.at)):
            getattr(self, name).append(value)
        self.words.append(words)
        self.places.append(np.arange(self.at, self.at + len(words), dtype=np.int32))
        self.at += len(words) + REACH
        self.n += len(words)

    def taken(self) -> pa.RecordBatch:
        words, places = np.concatenate(self.words), np.concatenate(self.places)
        order = np.argsort(words, kind="stable")
        words = words[order]
        last = np.flatnonzero(np.r_[words[1:] != words[:-1], np.ones(min(len(words), 1), bool)])
        values = [
            [self.rows],
            [self.keys],
            *[[np.array(getattr(self, name), np.int64).tobytes()] for name in ("skipped", "own", "begin")],
            [words[last].tobytes()],
            [(last + 1).astype(np.int32).tobytes()],
            [places[order].tobytes()],
        ]
        self.clear()
        types = [pa.list_(pa.int64()), pa.list_(pa.string()), *[pa.binary()] * 6]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types, strict=True)], INDEX.names)


def index(df: DataFrame, key: str = "doc_id", text: str = "text", segment: int = SEGMENT) -> DataFrame:
    """The positional index of every whole text, as a stored table of segments.

    Every row has a number of its own in it, so rows with the same key, or without one, stay apart.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _Segment()
        for batch in batches:
            rows, keys = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
            data, offsets = _texts(batch.column(2))
            for first, last in _slices(offsets, 4 * _BYTES):
                low, high = offsets[first], offsets[last]
                texts, words = words_of(data[low:high], offsets[first : last + 1] - low)
                ends = np.searchsorted(texts, np.arange(last - first + 1))
                for i in range(last - first):
                    whole = words[ends[i] : ends[i + 1]]
                    for at in range(0, max(len(whole), 1), segment):
                        own = whole[at : at + segment]
                        before = max(at - REACH, 0)
                        piece = whole[before : at + segment + REACH]
                        found.add(int(rows[first + i]), keys[first + i], before, len(own), piece)
                        if found.n >= segment or len(found.rows) >= segment // 8:
                            yield found.taken()
        if found.rows:
            yield found.taken()

    numbered = df.select(
        F.monotonically_increasing_id().alias("row"), F.col(key).cast("string").alias("key"), F.col(text).alias("text")
    )
    return stored(numbered.mapInArrow(build, INDEX), "index")


def item_blocks(items: DataFrame, key: str = "item_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """The words of the items, in stored rows of about ``block`` words (or one longer item)."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, words = [], []

        def taken() -> pa.RecordBatch:
            lengths = np.array([len(w) for w in words], np.int64)
            values = [[list(names)], [lengths.tobytes()], [np.concatenate(words).tobytes()]]
            names.clear(), words.clear()
            types = [pa.list_(pa.string()), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types, strict=True)], ITEMS.names)

        for batch in batches:
            keys = batch.column(0).to_pylist()
            data, offsets = _texts(batch.column(1))
            for i, name in enumerate(keys):
                _, own = words_of(data[offsets[i] : offsets[i + 1]], np.array([0, offsets[i + 1] - offsets[i]]))
                if len(own):
                    names.append(name)
                    words.append(own)
                if sum(map(len, words)) >= block:
                    yield taken()
        if names:
            yield taken()

    named = items.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text"))
    return stored(named.mapInArrow(build, ITEMS), "items")


def _phrases(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, first word, length) of every window of ``size`` words; of a shorter item, the whole."""
    n = np.maximum(lengths - size + 1, 1)
    item = np.repeat(np.arange(len(lengths)), n)
    within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return item, (np.cumsum(lengths) - lengths)[item] + within, np.minimum(lengths, size)[item]


def _lookup(segment: dict, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each word, its number among the looked-up terms, with the lists of these as (term, place) keys and their ends."""
    terms, ends, places = (np.frombuffer(segment[c], t) for c, t in (("terms", np.uint64), ("ends", np.int32), ("places", np.int32)))
    wanted, number = np.unique(words, return_inverse=True)
    at = np.searchsorted(terms, wanted)
    there = (at < len(terms)) & (terms[np.minimum(at, len(terms) - 1)] == wanted) if len(terms) else np.zeros(len(wanted), bool)
    at = at[there]
    first, last = np.r_[0, ends][at], ends[at]
    size = np.zeros(len(wanted), np.int64)
    size[there] = last - first
    stop = np.cumsum(size)
    own = size[there]
    chosen = np.repeat(first - (np.cumsum(own) - own), own) + np.arange(own.sum())
    lists = (np.repeat(np.flatnonzero(there), own).astype(np.int64) << 32) | places[chosen]
    return number, lists, stop


def matches(segment: dict, words: np.ndarray, first: np.ndarray, length: np.ndarray, slack: int) -> Iterator[tuple]:
    """(phrase, place) of the phrases that occur in a segment, batch by batch.

    A phrase occurs at a place if each of its words has a place at most ``slack`` words from where the phrase beginning
    there has it.  With no slack, that is the exact phrase.
    """
    number, lists, stop = _lookup(segment, words)
    size = np.diff(np.r_[0, stop])
    width = int(length.max(initial=0))
    spots = np.minimum(first[:, None] + np.arange(width), len(words) - 1)
    terms = number[spots]
    counts = np.where(np.arange(width) < length[:, None], size[terms], np.iinfo(np.int64).max)
    order = np.argsort(counts, axis=1, kind="stable")  # the offsets of a phrase, the rarest term first
    least = np.take_along_axis(counts, order[:, :1], 1)[:, 0] if width else np.empty(0, np.int64)
    alive = np.flatnonzero((least > 0) & (length > 0))
    shifts = np.arange(-slack, slack + 1)
    total = np.cumsum(least[alive] * len(shifts))
    at = 0
    while at < len(alive):
        until = max(int(np.searchsorted(total, (total[at - 1] if at else 0) + TESTED, side="right")), at + 1)
        group, at = alive[at:until], until
        n, offset = least[group], order[group, 0]
        which = np.repeat(group, n)
        list_start = stop[terms[group, offset]] - n
        place = lists[np.repeat(list_start - (np.cumsum(n) - n), n) + np.arange(n.sum())] & 0xFFFFFFFF
        place = (place - np.repeat(offset, n) + shifts[:, None]).ravel()
        which = np.tile(which, len(shifts))
        for k in range(1, width):
            more = k < length[which]
            offset = order[which, k]
            key = (terms[which, offset].astype(np.int64) << 32) + place + offset
            low = np.searchsorted(lists, key - slack)
            near = lists[np.minimum(low, len(lists) - 1)]
            stays = ~more | ((low < len(lists)) & (near <= key + slack))
            which, place = which[stays], place[stays]
        yield which, place


def _merged(row: np.ndarray, item: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Spans of one row and item that meet or overlap, as one."""
    order = np.lexsort((start, item, row))
    row, item, start, end = row[order], item[order], start[order], end[order]
    if not len(row):
        return row, item, start, end
    new_group = np.r_[True, (row[1:] != row[:-1]) | (item[1:] != item[:-1])]
    group = np.cumsum(new_group) - 1
    # Ends never fall inside a group; groups are lifted above each other, so that one running maximum does for all.
    lift = group * (int(end.max()) + 1)
    reach = np.maximum.accumulate(end + lift)
    opens = np.flatnonzero(np.r_[True, new_group[1:] | (start[1:] + lift[1:] > reach[:-1])])
    closes = np.r_[opens[1:] - 1, len(row) - 1]
    return row[opens], item[opens], start[opens], reach[closes] - lift[closes]


def _searched(segment: dict, block: dict | None, size: int, slack: int) -> Iterator[pa.RecordBatch]:
    rows, keys = np.array(segment["rows"], np.int64), segment["keys"]
    skipped, own, begin = (np.frombuffer(segment[c], np.int64) for c in ("skipped", "own", "begin"))

    def batch(piece, n_words, item, exact, start, end) -> pa.RecordBatch:
        columns = [rows[piece], pa.array([keys[p] for p in piece], pa.string()), n_words, item, exact, start, end]
        types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], FOUND.names)

    if block is None:  # the rows themselves
        nothing = pa.nulls(len(rows))
        yield batch(np.arange(len(rows)), own, nothing, nothing, nothing, nothing)
        return
    words, lengths = np.frombuffer(block["words"], np.uint64), np.frombuffer(block["lengths"], np.int64)
    item, first, length = _phrases(lengths, size)
    for exact in (True, False) if slack else (True,):
        for which, place in matches(segment, words, first, length, 0 if exact else slack):
            # A near match may begin before its first word's place; spans are cut to the piece.
            piece = np.maximum(np.searchsorted(begin, place + (0 if exact else slack), side="right") - 1, 0)
            start = np.maximum(place - begin[piece], 0) + skipped[piece]
            end = place - begin[piece] + skipped[piece] + length[which]
            spans = _merged(piece, item[which], start, end)
            if len(spans[0]):
                names = pa.array([block["items"][i] for i in spans[1]], pa.string())
                yield batch(spans[0], np.zeros(len(spans[0]), np.int64), names, np.full(len(spans[0]), exact), *spans[2:])


def search(segments: DataFrame, blocks: DataFrame, size: int = 10, slack: int = 0) -> DataFrame:
    """Spans of the rows in which windows of ``size`` words of the items occur.

    Returns (_row, _key, n_words, item, exact, start, end): for each piece of a row one line without an item and with
    its words, and for each item found in a piece its spans (words from the row's first, end exclusive), with exact
    matches, and where ``slack`` is above 0, matches whose words lie up to that many words off (see ``matches``).  A
    span that crosses pieces is found in one of them whole.  Every segment meets every block of items.
    """
    if size + 2 * slack > REACH:
        raise ValueError(f"the pieces of a text overlap by {REACH} words, less than a phrase and its slack")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                values = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
                yield from _searched(values, values if "items" in values else None, size, slack)

    rows = segments.select("rows", "keys", "skipped", "own", "begin").mapInArrow(find, FOUND)
    return rows.union(segments.crossJoin(blocks).mapInArrow(find, FOUND))


def _covered(spans: Column) -> Column:
    """The places that spans cover, together."""
    step = lambda s, x: F.struct(
        (s["n"] + F.greatest(x["end"] - F.greatest(x["start"], s["to"]), F.lit(0))).alias("n"),
        F.greatest(s["to"], x["end"]).alias("to"),
    )
    none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to"))
    return F.aggregate(F.array_sort(spans), none, step, lambda s: s["n"])


def contamination(
    documents: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", size: int = 10, slack: int = 0
) -> DataFrame:
    """For every document row, how much of it the items' windows of ``size`` words cover.

    Returns (key, n_words, n_hit, n_items, items_sha256, contaminated): words; words inside an exact occurrence of a
    window; distinct ids of the items whose windows occur, and the SHA-256 of these, sorted as strings and joined by
    commas; whether any word is hit.  With ``slack``, also n_near: items with a match within it (exact ones included),
    which never decides.

    A null or empty text has no words; an item without words has no window, one with fewer than ``size`` is one window;
    items without an id hit words but are not counted.  Every row gets a result row, those with one key or without a key
    too; an empty table gives an empty result, and without items nothing is hit.  Only the named columns are read.
    Words are compared by 64-bit hashes, all of a phrase at once.
    """
    segments = index(documents, key, text)
    found = search(segments, item_blocks(items), size, slack)
    span = F.struct(F.col("start").alias("start"), F.col("end").alias("end"))
    per_row = found.groupBy("_row").agg(
        F.first("_key", ignorenulls=True).alias("_key"),
        F.sum("n_words").alias("n_words"),
        F.collect_list(F.when(F.col("exact"), span)).alias("spans"),
        F.array_sort(F.collect_set(F.when(F.col("exact"), F.col("item")))).alias("items"),
        F.size(F.collect_set("item")).cast("long").alias("n_near"),
    )
    near = ["n_near"] if slack else []
    return per_row.select(
        F.col("_key").cast(documents.schema[key].dataType).alias(key),
        "n_words",
        _covered(F.col("spans")).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
        *near,
    )
