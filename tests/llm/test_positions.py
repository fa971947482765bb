import random
import re
from hashlib import sha256

import numpy as np
import pytest

from clickloom.llm import positions

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def near(w, at, phrase, slack):
    """Every word of the phrase within ``slack`` of its place, if it begins at ``at``."""
    return all(x in w[max(at + k - slack, 0) : max(at + k + slack + 1, 0)] for k, x in enumerate(phrase))


def brute(text, items, size, slack=0):
    w, hit, found, close = words(text), set(), set(), set()
    for key, item in items:
        v = words(item)
        for k in range(max(len(v) - size, 0) + 1 if v else 0):
            phrase = v[k : k + size]
            for at in range(-size, len(w)):
                if at >= 0 and w[at : at + len(phrase)] == phrase:
                    hit |= set(range(at, at + len(phrase)))
                    found.add(key)
                if slack and near(w, at, phrase, slack):
                    close.add(key)
    ids = sorted(str(k) for k in found if k is not None)
    return len(w), len(hit), len(ids), sha256(",".join(ids).encode()).hexdigest(), bool(hit), len(close | found)


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(5)
    letters = ["a", "B", "the", "é", "ß9", "x1", "日本", "un", "deux"]
    items = [(i, " ".join(r.choice(letters) for _ in range(r.choice([0, 1, 2, 4, 6, 9])))) for i in range(12)]
    items += [(3, items[5][1]), (None, "the the B"), (50, None), (51, "  ,;  "), (52, "Ünïque ünïque words-here")]
    texts = [None, "", " - ", "a" * 70, "A a\ta\na", "word " * 40, items[-1][1].upper()]
    for _ in range(60):
        text = [r.choice(letters) for _ in range(r.choice([1, 5, 20, 60]))]
        if r.random() < 0.5:
            text[r.randrange(len(text)) :] = (items[r.randrange(12)][1] + r.choice([" ", ", b-"]) + " ".join(text)).split(" ")
        texts.append(r.choice([" ", "-", "\n"]).join(text))
    return texts, items


@pytest.mark.parametrize("segment", [7, 100, positions.SEGMENT])
def test_words_in_matches_equal_brute_force(spark, corpus, segment):
    texts, items = corpus
    texts = [*texts, texts[20], " ".join(t or "" for t in texts)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    tests = spark.createDataFrame(items, "item_id long, text string")
    segments = positions.index(docs, segment=segment)
    found = positions.search(segments, positions.item_blocks(tests, block=20), size=4).collect()
    for key, text in enumerate(texts):
        rows = [r for r in found if r["_key"] == str(key)]
        places = {p for r in rows if r["item"] or r["exact"] for p in range(r["start"], r["end"])}
        ids = sorted({r["item"] for r in rows if r["item"] is not None})
        want = brute(text, items, 4)
        got = sum(r["n_words"] for r in rows), len(places), len(ids), sha256(",".join(ids).encode()).hexdigest()
        assert got == want[:4], (key, text)


def test_contamination_equals_brute_force(spark, corpus):
    texts, items = corpus
    # Extra columns with clashing names, a key twice, and rows without a key.
    rows = [(k, t, 1, "x") for k, t in enumerate(texts)] + [(8, texts[8], 1, "x"), (None, texts[9], 1, "x"), (None, texts[10], 1, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item long, start string")
    tests = spark.createDataFrame(items, "item_id long, text string")
    for size, slack in ((4, 0), (4, 1), (6, 2)):
        out = positions.contamination(docs, tests, size=size, slack=slack)
        got = sorted(tuple(r)[: 6 + (slack > 0)] for r in out.fillna(-1, "doc_id").collect())
        want = [(-1 if k is None else k, *brute(t, [i for i in items], size, slack)[: 5 + (slack > 0)]) for k, t, *_ in rows]
        assert [r[:6] for r in got] == sorted(w[:6] for w in want)
        if slack:  # an item without an id is never counted, near or not
            known = [i for i in items if i[0] is not None]
            near = sorted((-1 if k is None else k, *brute(t, known, size, slack)[:1], brute(t, known, size, slack)[5]) for k, t, *_ in rows)
            assert sorted((r[0], r[1], r[6]) for r in got) == near


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert positions.contamination(none, items).collect() == []
    one = spark.createDataFrame([(7, "a b c")], "doc_id long, text string")
    (row,) = positions.contamination(one, items.limit(0)).collect()
    assert tuple(row)[:4] == (7, 3, 0, 0) and row["contaminated"] is False
    (row,) = positions.contamination(one, items).collect()
    assert tuple(row)[:4] == (7, 3, 2, 1) and row["contaminated"] is True


def test_a_word_longer_than_a_block_is_one_word(monkeypatch):
    texts = ["ab" * 40 + " cd", "cd", "", "e" * 33, "é" * 31 + "-x"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
    whole = positions.words_of(data, offsets)
    for size in (1, 2, 3, 16, 33):
        monkeypatch.setattr(positions, "_BYTES", size)
        parts = positions.words_of(data, offsets)
        assert parts[0].tolist() == whole[0].tolist() and parts[1].tolist() == whole[1].tolist()
    assert whole[0].tolist() == [0, 0, 1, 3, 4, 4] and whole[1][1] == whole[1][2]


def test_a_phrase_longer_than_the_overlap_is_refused(spark):
    one = spark.createDataFrame([(7, "a b c")], "doc_id long, text string")
    with pytest.raises(ValueError, match="overlap"):
        positions.contamination(one, one.withColumnRenamed("doc_id", "item_id"), size=positions.REACH + 1)
