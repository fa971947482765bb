"""Hashed word shingles of a text."""

from __future__ import annotations

import numpy as np
import xxhash

SIZE = 5
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_LENGTH = np.uint64(0xE7037ED1A0B428DB)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all bits."""
    h = (h ^ (h >> np.uint64(32))) * _ODD[3]
    h = (h ^ (h >> np.uint64(29))) * _ODD[0]
    return h ^ (h >> np.uint64(32))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0xD1342543DE82EF95
_BLOCK = 1 << 18


class _Powers:
    """Powers of the base and of its inverse, as many as the longest block so far needs."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(0, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 12, 2 * len(self.up))
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                factors = np.full(size, base, np.uint64)
                factors[0] = 1
                setattr(self, name, np.cumprod(factors, dtype=np.uint64))
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def _hashes(data: np.ndarray) -> np.ndarray:
    """A hash of every word of a block: its polynomial in the base, from running sums over all bytes at once."""
    space = np.r_[True, _SPACE[data], True]
    edges = np.flatnonzero(space[1:] != space[:-1])
    starts, ends = edges[::2], edges[1::2]
    up, down = _POWERS.upto(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up, out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _LENGTH)


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of every word, in order.  Long texts go block by block, cut at white space."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), np.uint8)
    if len(data) <= _BLOCK:
        return _hashes(data)
    breaks = np.flatnonzero(_SPACE[data])
    out, at = [], 0
    while at < len(data):
        i = np.searchsorted(breaks, at + _BLOCK)  # the first white space after a block's length
        end = int(breaks[i]) + 1 if i < len(breaks) else len(data)
        out.append(_hashes(data[at:end]))
        at = end
    return np.concatenate(out)


def shingles(text: str | None) -> np.ndarray:
    """The text's distinct shingles of five words as sorted 64-bit hashes.

    Words are runs of characters other than space, tab, line feed, vertical tab, form feed and carriage return, with
    A-Z in lower case.  Fewer than five words are one shingle; without words there is none.
    """
    w = word_hashes(text) if text else np.empty(0, np.uint64)
    n = len(w)
    if not n:
        return w
    if n < SIZE:
        return mixed((w * _ODD[:n]).sum(keepdims=True, dtype=np.uint64) + np.array([n], np.uint64) * _LENGTH)
    m = n - SIZE + 1
    h = w[:m] * _ODD[0]
    for k in range(1, SIZE):
        h += w[k : k + m] * _ODD[k]
    h = np.sort(mixed(h))
    return h[np.r_[True, h[1:] != h[:-1]]]


def set_id(tokens: np.ndarray) -> int:
    """A 64-bit name (signed) of a set of shingles."""
    return xxhash.xxh3_64_intdigest(tokens.tobytes()) - (1 << 63)
