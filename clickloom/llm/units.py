"""Texts as units that a tokenizer encodes independently, so that each distinct unit is encoded once.

A unit begins at a space that a non-space character follows (or at the text's start).  The tokenizers used here
split words before such a space and never join across it: a run of white space gives up its last space to the
word after it, or is dropped.  So the tokens of a text are the tokens of its units, one after the other.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterable
from itertools import compress, count, islice

import numpy as np

_SPACE_THEN_SPACE = re.compile(r" (?=\s|[\x1c-\x1f]|$)")
UNIT_START = re.compile(r" (?=[^\s\x1c-\x1f])")


def split_units(text: str) -> list[str]:
    """Pieces between unit starts; every piece but the first is to be read with a space before it."""
    if _SPACE_THEN_SPACE.search(text):
        return UNIT_START.split(text)
    return text.split(" ")


_SPACE_THEN_ANY = re.compile(r"[\s\x1c-\x1f](?:[\s\x1c-\x1f]|\Z)")


def split_lines(text: str) -> list[str]:
    """Units of byte-level BPE, which may also begin at a line's end, and then with it, between two other characters.

    There the word pattern takes the line's end alone.  All other pieces but the first are to be read with a space
    before them.  Texts with white space in a row or at their end are cut like others.
    """
    if "\n" not in text or _SPACE_THEN_ANY.search(text):
        return split_units(text)
    return text.replace("\n", " \n").split(" ")


class UnitCache:
    """What ``encode`` gives for each unit.  It holds at most ``size`` units, then begins anew."""

    def __init__(self, encode: Callable[[list[str]], list], size: int = 400_000):
        self.encode = encode
        self.size = size
        self.first: dict[str, object] = {}  # of units at a text's start
        self.known: dict[str, object] = {}  # of units after a space

    def add(self, split_texts: Iterable[list[str]]) -> None:
        """Encode the units that are not known yet, all in one call."""
        split_texts = list(split_texts)
        seen: set[str] = set()
        for u in split_texts:
            seen.update(u[1:])
        rest = [u for u in seen if u not in self.known]
        first = [u for u in {u[0] for u in split_texts if u} if u not in self.first]
        if len(self.known) + len(self.first) + len(rest) + len(first) > self.size and (self.known or self.first):
            self.known.clear()
            self.first.clear()
            return self.add(split_texts)
        new = [*first, *(" " + u for u in rest)]
        if new:
            values = self.encode(new)
            self.first.update(zip(first, values[: len(first)], strict=True))
            self.known.update(zip(rest, values[len(first) :], strict=True))

    def values(self, units: list[str]) -> list:
        """One value for each unit of a text that ``add`` has seen."""
        return [self.first[units[0]], *map(self.known.__getitem__, units[1:])] if units else []


class Flat:
    """Runs of values, one after the other in one array, and the length of each run."""

    def __init__(self, values: np.ndarray, counts: np.ndarray):
        self.values, self.counts = values, counts
        self.starts = np.cumsum(counts) - counts

    @classmethod
    def of(cls, parts: list[bytes], kind: str = "u1") -> Flat:
        values = np.frombuffer(b"".join(parts), kind)
        return cls(values, np.array([len(p) for p in parts], np.int64) // values.itemsize)

    def followed_by(self, other: Flat) -> Flat:
        return Flat(np.concatenate([self.values, other.values]), np.concatenate([self.counts, other.counts]))

    def take(self, rows: np.ndarray, at_once: int = 1 << 14) -> Flat:
        """The runs of these numbers; places of values, far larger than values, are held of a few runs at once."""
        counts = self.counts[rows]
        out, end = np.empty(counts.sum(), self.values.dtype), 0
        for i in range(0, len(rows), at_once):
            some = counts[i : i + at_once]
            before, first, end = np.cumsum(some) - some, end, end + int(some.sum())
            out[first:end] = self.values[np.repeat(self.starts[rows[i : i + at_once]] - before, some) + np.arange(end - first)]
        return Flat(out, counts)


class UnitTable:
    """Ids of texts, for which each distinct unit is encoded once: ``encode`` gives the byte-level BPE ids of units.

    Units are numbered as they come, and their ids lie in one array.  Beyond ``size`` units, all but half as many,
    those used last, are forgotten.
    """

    def __init__(self, encode: Callable[[list[str]], Flat], size: int = 300_000):
        self.encode, self.size, self.turn = encode, size, 0
        self.forget_all()

    def forget_all(self) -> None:
        # A unit at a text's start goes by a space and itself, as no other unit begins with a space.
        self.rows: dict[str, int] = defaultdict(count().__next__)
        self.ids = Flat(np.empty(0, np.uint32), np.empty(0, np.int64))
        self.used = np.empty(0, np.int64)  # when each unit was used last

    def __call__(self, texts: list[str]) -> Flat:
        """The ids of each text."""
        if not texts:
            return Flat(np.empty(0, np.uint32), np.empty(0, np.int64))
        units: list[str] = []
        firsts: list[int] = []
        for t in texts:
            u = split_lines(t)
            u[0] = " " + u[0]
            firsts.append(len(units))
            units += u
        known = len(self.rows)
        rows = np.fromiter(map(self.rows.__getitem__, units), np.int64, len(units))
        if len(self.rows) > known:
            self.learn([*islice(reversed(self.rows), len(self.rows) - known)][::-1])
        self.turn += 1
        self.used[rows] = self.turn
        found = self.ids.take(rows)
        self.forget()
        return Flat(found.values, np.add.reduceat(found.counts, firsts))

    def learn(self, units: list[str]) -> None:
        try:
            ids = self.encode([u[1:] if u[:1] == " " else u if u[:1] == "\n" else " " + u for u in units])
        except BaseException:
            self.forget_all()  # numbers without ids
            raise
        self.ids = self.ids.followed_by(ids)
        self.used = np.concatenate([self.used, np.zeros(len(units), np.int64)])

    def forget(self) -> None:
        if len(self.rows) <= self.size:
            return
        kept = np.zeros(len(self.rows), bool)
        kept[np.argpartition(self.used, -(self.size // 2))[len(kept) - self.size // 2 :]] = True
        self.rows = defaultdict(count(self.size // 2).__next__, zip(compress(self.rows, kept.tolist()), count()))
        self.ids = self.ids.take(np.flatnonzero(kept))
        self.used = self.used[kept]


def batches(texts: list[str], chars: int = 1 << 21) -> Iterable[tuple[int, int]]:
    """Ranges of texts with about ``chars`` characters each (one text at least)."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > chars:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)
