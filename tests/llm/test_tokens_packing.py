"""Tokenisation, packing and sharding against the tokenizers library and plain Python."""

from __future__ import annotations

import hashlib
import random
import zlib
from array import array

import numpy as np
import public_tokenizers
import pytest

from clickloom.llm import bpe, packing, sharding, tokens
from clickloom.llm.numpy_bpe import loaded
from clickloom.llm.units import Flat, UnitCache, UnitTable, split_lines, split_units

BYTE, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
PARTS = [
    " ", "  ", "\n", "\t", "\r\n", "a", "the", "É", "1", "23", "'s", "'ll", "<|endoftext|>", "!?", " ", " ",
    "日本", "😀", "\x1c", "\x85", " don't", "ﬀ", "aaaaaaa", "́", "Σ",
]


def odd_texts(n: int = 1500) -> list[str]:
    rng = random.Random(7)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 50))) for _ in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    texts = [None, "", " ", "word", *odd_texts(60), "x" * 5000, " ".join(rng.choice(PARTS) for _ in range(9000))]
    rows = [(i, t, "clash", 1) for i, t in enumerate(texts)] + [(1, "again", "clash", 1), (1, "again", "clash", 1), (None, "null key", "c", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, shard string, length int")


def test_numpy_rounds_match_the_library():
    texts = odd_texts()
    want = [e.ids for e in tokens.library(BYTE).encode_batch(texts, add_special_tokens=False)]
    assert list(bpe._ids(texts, BYTE)) == want
    vocabulary, _ = loaded(BYTE)
    assert [vocabulary.decode(i) for i in want] == texts


def test_units_encoded_together_match_units_alone():
    texts, cache = odd_texts(), UnitCache(packing.UnitIds(BYTE, together=7))
    units = [split_units(t) for t in texts]
    cache.add(units)
    want = [array("I", e.ids).tobytes() for e in tokens.library(BYTE).encode_batch(texts, add_special_tokens=False)]
    assert [b"".join(cache.values(u)) for u in units] == want


def lined_texts(n: int = 800) -> list[str]:
    """Texts without white space in a row, whose lines end between other characters; some begin with a line's end."""
    rng, parts = random.Random(11), [p for p in PARTS if not p.isspace()]
    return [
        rng.choice(["", "\n"]) + "".join(rng.choice(parts).strip() + rng.choice(["", " ", "\n", "\n"]) for _ in range(rng.randint(0, 40))) + "."
        for _ in range(n)
    ]


@pytest.mark.parametrize("encode", [packing.UnitIds(BYTE, together=7).flat, loaded(BYTE)[0].encode_units])
@pytest.mark.parametrize("size", [5, 60, 100_000])
def test_tables_of_units_match_the_library(encode, size):
    texts, table = [*odd_texts(), *lined_texts(), "", "\n", " "], UnitTable(encode, size)
    want = [e.ids for e in tokens.library(BYTE).encode_batch(texts, add_special_tokens=False)]
    assert any(u[:1] == "\n" for t in texts for u in split_lines(t)[1:])
    for i in range(0, len(texts), 50):
        ids = table(texts[i : i + 50])
        got = [ids.values[low : low + n].tolist() for low, n in zip(ids.starts, ids.counts, strict=True)]
        assert got == want[i : i + 50]
        assert len(table.rows) == len(table.ids.counts) == len(table.used) <= size
    assert table([]).counts.size == 0


@pytest.mark.parametrize("owner", ["op3", "op9"])
def test_units_in_use_are_encoded_once(owner):
    """A full table lets go of the units not used for longest, not of all."""
    table = UnitTable((packing._loaded if owner == "op3" else lambda p: loaded(p)[1])(BYTE).encode, 40)
    assert type(table) is type(packing._loaded(BYTE)) is type(loaded(BYTE)[1])
    seen, encode = [], table.encode
    table.encode = lambda units: seen.extend(units) or encode(units)
    for i in range(60):
        table([f"x the often used {i}a {i}b {i}c\nlines"])
    assert all(seen.count(u) == 1 for u in ["x", " the", " often", " used", "\nlines"]) and len(seen) == 5 + 3 * 60


def test_units_without_ids_are_forgotten():
    table = UnitTable(lambda units: 1 // 0)
    with pytest.raises(ZeroDivisionError):
        table(["a b"])
    table.encode = lambda units: Flat.of([b"\1\0\0\0"] * len(units), "<u4")
    assert table(["a b", "c"]).counts.tolist() == [2, 1]


@pytest.mark.parametrize("path", [WORD, BYTE])
@pytest.mark.parametrize("chunk,overlap", [(1 << 15, 256), (40, 12), (20, 4), (9, 2), (7, 3)])
def test_spliced_chunks_count_like_whole_texts(chunk, overlap, path):
    library = tokens.library(path)
    texts = odd_texts(600) + [" ".join(odd_texts(30)), "the quick brown fox " * 200]
    for text, e in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert tokens.spliced(library, text, chunk, overlap) == len(e.ids)


def test_chunk_edges_change_tokens_and_overlaps_are_widened(monkeypatch):
    library = tokens.library(WORD)
    whole = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    rng = random.Random(1)
    text = " ".join(rng.choice(["internationalization", "antidisestablishmentarianism", "a", "of"]) for _ in range(400))
    cut = sum(whole(text[i : i + 100]) for i in range(0, len(text), 100))
    assert cut != whole(text) == tokens.spliced(library, text, 100, 10)
    starts, made = [], tokens.Window.__init__

    def record(self, tokenizer, text, start, end):
        starts.append((start, end))
        made(self, tokenizer, text, start, end)

    monkeypatch.setattr(tokens.Window, "__init__", record)
    tokens.spliced(library, text, 100, 10)
    assert set(starts) - set(tokens.spans(len(text), 100, 10))  # an overlap of ten characters is too short
    encoded = []
    plain = "x" * 3000
    monkeypatch.setattr(tokens.Window, "encoded", property(lambda w: encoded.append(w) or (np.zeros(0, int), np.zeros((0, 2), int))))
    tokens.spliced(library, plain, 100, 10)
    assert [(w.start, w.end) for w in encoded] == [(0, 3000)]  # no space: encoded once


def test_windows_that_disagree_are_not_spliced():
    library = tokens.library(WORD)
    text = "one two three four five six seven eight"
    a, b = tokens.Window(library, text, 0, 30), tokens.Window(library, text, 6, len(text))
    at = tokens.stable_boundary(a, b, 0)
    assert text[at] == " " and 6 < at < 30
    ids, places = b.encoded
    b.encoded = ids + 1, places
    assert tokens.stable_boundary(a, b, 0) is None


def test_texts_beyond_a_chunk(spark):
    rng, library = random.Random(4), tokens.library(WORD)
    texts = [" ".join(rng.choice(PARTS) for _ in range(30_000)), "word" * 12_000, "two words " * 9_000, "é" * 40_000 + " end"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["n_tokens"] for r in tokens.token_counts(df, WORD, 2048).collect()}
    assert min(map(len, texts)) > 1 << 15
    assert got == {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)}


def test_token_counts_and_round_trip(docs):
    library = {WORD: tokens.library(WORD), BYTE: tokens.library(BYTE)}
    plain = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in docs.collect())
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in tokens.token_counts(docs, WORD, 100).collect())
    n = lambda path, t: len(library[path].encode(t, add_special_tokens=False).ids)
    assert got == sorted((a, b, len(t.encode()), n(WORD, t), n(WORD, t) > 100) for a, b, t in plain)
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    rows = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.round_trip(docs, BYTE).collect())
    ids = lambda t: ",".join(map(str, library[BYTE].encode(t, add_special_tokens=False).ids))
    assert rows == sorted((a, b, n(BYTE, t), digest(ids(t)), digest(t)) for a, b, t in plain)


def test_packing_places_every_piece_once(docs):
    capacity, library = 64, tokens.library(BYTE)
    rows = packing.pack(docs, BYTE, capacity, 0, with_ids=True).collect()
    ids: dict = {}
    for r in rows:
        assert 0 < r["length"] <= capacity and r["length"] == len(r["ids"])
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        ids.setdefault(r["doc_id"], []).append((r["piece"], r["start"], list(r["ids"])))
    for r in docs.where("doc_id is not null and doc_id <> 1").collect():
        want = [*library.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        got = sorted(ids[r["doc_id"]])
        assert [i for _, _, part in got for i in part] == want
        assert [p for p, _, _ in got] == list(range(len(got))) and all(len(x[2]) == capacity for x in got[1:])
    by_sequence: dict = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by_sequence.values():
        ends = [0]
        for offset, length in sorted(places):
            assert offset == ends[-1]
            ends.append(offset + length)
        assert ends[-1] <= capacity
    assert len(by_sequence) <= -(-sum(r["length"] for r in rows) // capacity) + 2


def test_sweep_is_best_fit_decreasing():
    rng = np.random.default_rng(5)
    lengths = rng.integers(1, 101, 700)
    free: list[int] = []
    for n in sorted(lengths.tolist(), reverse=True):
        fits = [i for i, f in enumerate(free) if f >= n]
        if fits:
            free[min(fits, key=lambda i: free[i])] -= n
        else:
            free.append(100 - n)
    plan = packing.sweep({int(k): int(v) for k, v in zip(*np.unique(lengths, return_counts=True), strict=True)}, 100)
    last = plan.iloc[-1]
    assert plan["sequence"].max() + 1 <= len(free) + 1 and last["offset"] + last["length"] <= 100


def test_jump_hash_moves_rows_only_to_the_new_shard(docs, spark):
    keys = np.random.default_rng(1).integers(-(1 << 63), 1 << 63, 20_000)
    for n in (1, 2, 8, 50):
        before, after = sharding.jump(keys, n), sharding.jump(keys, n + 1)
        moved = before != after
        assert set(after[moved]) <= {n} and abs(moved.mean() - 1 / (n + 1)) < 0.02

    def one(key: int, shards: int) -> int:  # as published
        b, j = -1, 0
        key &= (1 << 64) - 1
        while j < shards:
            b = j
            key = (key * 2862933555777941757 + 1) & ((1 << 64) - 1)
            j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
        return b

    assert sharding.jump(keys[:500], 8).tolist() == [one(int(k), 8) for k in keys[:500]]
    rows = sharding.sharded(docs, 3).collect()
    assert len(rows) == docs.count()
    for s in {r["shard"] for r in rows}:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))


def test_empty_tables(docs):
    none = docs.limit(0)
    assert tokens.token_counts(none, WORD, 1).count() == bpe.round_trip(none, BYTE).count() == 0
    assert packing.pack(none, BYTE).count() == sharding.sharded(none, 8).count() == 0
