"""Byte-level BPE in batched numpy merge rounds, for a tokenizers file (operator 9)."""

from __future__ import annotations

import json
from collections import defaultdict
from functools import lru_cache
from itertools import chain, count

import numpy as np
import regex

from clickloom.llm.units import Flat, UnitTable

#: The word pattern of byte-level BPE vocabularies of this kind.
WORDS = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself where visible, else the next free one from 256."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in visible]
    return [chr(b if b in visible else 256 + hidden.index(b)) for b in range(256)]


class ByteBpe:
    """Encoder and decoder of one vocabulary.

    A round looks at all words at once.  The symbols of the words still in work lie in one flat array; the rank of
    every neighbouring pair is found by binary search over the sorted pair keys, each word takes its lowest rank,
    and all pairs of that rank merge, from the left where they overlap.  A merge makes only pairs of later ranks, so
    this is the order in which single merges would go.  Words without a known pair leave the arrays.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        byte_of = {c: b for b, c in enumerate(byte_letters())}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for token, i in vocab.items():
            known = all(c in byte_of for c in token)
            self.bytes_of[i] = bytes(byte_of[c] for c in token) if known else token.encode()
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.byte_ids = np.array([vocab[c] for c in byte_letters()], np.int64)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.base = size
        keys = np.array([vocab[x] * size + vocab[y] for x, y in merges], np.int64)
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]  # sorted; the rank is the place in the file
        self.made = np.array([vocab[x + y] for x, y in merges], np.int64)
        self.decimals = Flat.of([b"%d," % i for i in range(size)])
        self.spelled = Flat.of(self.bytes_of)
        found = "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True))
        self.special_split = regex.compile(f"({found})") if found else None

    def words(self, unit: str) -> list[str]:
        """Words of a unit; special strings stay whole."""
        if self.special_split is None or not self.special_split.search(unit):
            return WORDS.findall(unit)
        out: list[str] = []
        for part in self.special_split.split(unit):
            out += [part] if part in self.special else WORDS.findall(part)
        return out

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, or the number of merges where there is none."""
        want = left * self.base + right
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where(self.keys[at] == want, self.order[at], len(self.keys))

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, flat, and the number of ids of each."""
        lengths = np.array([len(w) for w in words], np.int64)
        symbols = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        owner = np.repeat(np.arange(len(words)), lengths)
        done_ids: list[np.ndarray] = []
        done_owner: list[np.ndarray] = []
        none = len(self.keys)
        while len(symbols):
            rank = np.full(len(symbols), none, np.int64)  # of the pair that begins at each symbol
            if len(symbols) > 1:
                rank[:-1] = np.where(owner[:-1] == owner[1:], self.ranks(symbols[:-1], symbols[1:]), none)
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            sizes = np.diff(np.r_[starts, len(symbols)])
            lowest = np.minimum.reduceat(rank, starts)
            at_rest = lowest == none
            if at_rest.any():
                rest = np.repeat(at_rest, sizes)
                done_ids.append(symbols[rest])
                done_owner.append(owner[rest])
                if at_rest.all():
                    break
                symbols, owner, rank = symbols[~rest], owner[~rest], rank[~rest]
                lowest, sizes = lowest[~at_rest], sizes[~at_rest]
            hit = rank == np.repeat(lowest, sizes)
            # In a chain of hits (x x x), the first, third, ... merge.
            place = np.arange(len(hit))
            before = np.maximum.accumulate(np.where(hit, -1, place))
            hit &= (place - before) % 2 == 1
            symbols = np.where(hit, self.made[np.minimum(rank, none - 1)], symbols)
            keep = np.r_[True, ~hit[:-1]]
            symbols, owner = symbols[keep], owner[keep]
        if not done_ids:
            return np.empty(0, np.int64), np.zeros(len(words), np.int64)
        ids, owner = np.concatenate(done_ids), np.concatenate(done_owner)
        order = np.argsort(owner, kind="stable")
        return ids[order], np.bincount(owner, minlength=len(words))

    def encode_units(self, units: list[str]) -> Flat:
        """Ids of each unit, from those of its distinct words."""
        split = [self.words(u) for u in units]
        number: dict[str, int] = defaultdict(count().__next__)
        rows = np.fromiter(map(number.__getitem__, chain.from_iterable(split)), np.int64)
        words = Flat(rows, np.array([len(ws) for ws in split], np.int64))
        plain = [w not in self.special for w in number]
        flat, counts = self.merge([w.encode() if p else b"" for w, p in zip(number, plain, strict=True)])
        special = [i for i, p in enumerate(plain) if not p]
        if special:
            names = list(number)
            flat = np.insert(flat, (np.cumsum(counts) - counts)[special], [self.special[names[i]] for i in special])
            counts[special] = 1
        ids = Flat(flat.astype(np.uint32), counts).take(words.values)
        ends = np.r_[0, np.cumsum(ids.counts)][np.r_[0, np.cumsum(words.counts)]]
        return Flat(ids.values, np.diff(ends))

    def decode(self, ids: list[int]) -> str:
        """The text of the ids, special ones included."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def loaded(path: str) -> tuple[ByteBpe, UnitTable]:
    """One vocabulary and table of units for each Python worker."""
    bpe = ByteBpe(path)
    return bpe, UnitTable(bpe.encode_units)
