"""Operator 2: token counts, with overlap resynchronisation for huge documents."""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickloom.llm.common import as_text
from clickloom.llm.units import UNIT_START, UnitCache, batches, split_units


def library(path: str):
    """The vocabulary's tokenizer, without truncation or padding, on one thread."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


@lru_cache(maxsize=2)
def _loaded(path: str) -> tuple:
    tokenizer = library(path)
    return tokenizer, UnitCache(lambda units: [len(e.ids) for e in tokenizer.encode_batch(units, add_special_tokens=False)])


class Window:
    """A chunk of a text, encoded with offsets when it is first asked for; offsets are places in the whole text."""

    def __init__(self, tokenizer, text: str, start: int, end: int):
        self.tokenizer, self.text, self.start, self.end = tokenizer, text, start, end

    @cached_property
    def encoded(self) -> tuple[np.ndarray, np.ndarray]:
        """Ids, and where each token begins and ends."""
        e = self.tokenizer.encode(self.text[self.start : self.end], add_special_tokens=False)
        return np.array(e.ids, np.int64), np.array(e.offsets, np.int64).reshape(-1, 2) + self.start

    def between(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """The tokens that begin in [low, high)."""
        ids, places = self.encoded
        chosen = (places[:, 0] >= low) & (places[:, 0] < high)
        return ids[chosen], places[chosen]

    def crossed(self, at: int) -> bool:
        """Whether a token lies on both sides of the space at ``at``."""
        _, places = self.encoded
        return bool(((places[:, 0] < at) & (places[:, 1] > at + 1)).any())


def spans(length: int, chunk: int, overlap: int) -> list[tuple[int, int]]:
    """Chunks of a text; each begins ``overlap`` before the end of the one before it."""
    out = [(0, min(chunk, length))]
    while out[-1][1] < length:
        start = out[-1][1] - overlap
        out.append((start, min(start + chunk, length)))
    return out


def stable_boundary(here: Window, following: Window, after: int) -> int | None:
    """The last place beyond ``after`` in both windows where they may be spliced.

    It is a space with a non-space after it, where both windows end a token and begin another, and both encode the
    unit before it and the unit after it to the same ids at the same places.  The units of a window that its edges
    may cut are no such units, unless they come out alike all the same.  No token crosses such a space, and neither
    side's tokens depend on the other side's text, so the splice gives the tokens of the whole text.
    """
    low, high = max(after + 1, following.start), min(here.end, following.end)
    places = [m.start() for m in UNIT_START.finditer(here.text, low, high)]
    for before, at, behind in reversed(list(zip(places, places[1:], places[2:], strict=False))):
        if here.crossed(at) or following.crossed(at):
            continue
        if all(np.array_equal(x, y) for x, y in zip(here.between(before, behind), following.between(before, behind), strict=True)):
            return at
    return None


def spliced(tokenizer, text: str, chunk: int, overlap: int) -> int:
    """Tokens of a text from overlapping chunks of it.

    Neighbouring chunks are spliced at their stable boundary.  Where their overlap has none, it is widened, to double
    its length each time, by encoding the later chunk from further back; once it reaches the last splice, the two
    chunks become one.  Chunks without a place to try are not encoded before, so a text without spaces is encoded once.
    """
    chunks = [Window(tokenizer, text, *span) for span in spans(len(text), chunk, overlap)]
    total, at, here = 0, 0, chunks[0]
    for i in range(1, len(chunks)):
        following, chunks[i] = chunks[i], None  # what is spliced may be let go
        width = overlap
        while (boundary := stable_boundary(here, following, at)) is None:
            width *= 2
            if here.end - width <= at:
                break
            following = Window(tokenizer, text, here.end - width, following.end)
        if boundary is None:
            here = Window(tokenizer, text, at, following.end)
        else:
            total += len(here.between(at, boundary)[0])
            at, here = boundary, following
    return total + len(here.between(at, len(text) + 1)[0])


def token_counts(
    df: DataFrame,
    path: str,
    limit: int,
    key: str = "doc_id",
    text: str = "text",
    chunk: int = 1 << 15,
    overlap: int = 256,
) -> DataFrame:
    """Tokens of each whole text as the tokenizers library gives them with the vocabulary at ``path``.

    Texts longer than ``chunk`` characters are encoded in chunks that overlap and spliced (see ``spliced``); of the
    shorter ones each distinct unit is encoded once.  In memory are a batch of texts, their units, the bounded unit
    cache and the encodings of two chunks.  Returns (key, n_bytes, n_tokens,
    over_limit), a row for each row: null and empty texts have 0 bytes and tokens, null keys and repeated rows stay,
    an empty table gives an empty result.  Special strings in a text count as the library's default has it.
    """
    schema = T.StructType([T.StructField("_key", T.StringType())])
    schema = schema.add("n_tokens", T.LongType()).add("n_bytes", T.LongType())

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer, cache = _loaded(path)
        for frame in frames:
            texts = frame["_text"].fillna("").tolist()
            counts: list[int] = []
            for start, end in batches(texts):
                some = texts[start:end]
                units = [split_units(t) if len(t) <= chunk else [] for t in some]
                cache.add(units)
                short = [sum(cache.values(u)) for u in units]
                counts += [n if len(t) <= chunk else spliced(tokenizer, t, chunk, overlap) for n, t in zip(short, some, strict=True)]
            yield pd.DataFrame({"_key": frame["_key"], "n_tokens": counts, "n_bytes": frame["n_bytes"]})

    size = F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long")
    counted = as_text(df, key, text, size.alias("n_bytes")).mapInPandas(run, schema)
    back = F.col("_key").cast(df.schema[key].dataType).alias(key)
    return counted.select(back, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
