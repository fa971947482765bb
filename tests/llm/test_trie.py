import random
import re
import zlib
from collections import defaultdict
from hashlib import sha256

import numpy as np
import pytest

from clickloom.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, n int, p1 string, shard string"


def brute(rows, every=20, of=4):
    own = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    whole = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % of
        whole[c] = tuple(own.get(c - c % every, [])[:h] + ts[h:])
    members = defaultdict(list)
    for c, ts in whole.items():
        for d in range(len(ts) + 1):
            members[ts[:d]].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in sorted(members, key=len, reverse=True):
        leaves[node] += children[node] == 0
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        saved[node] += (len(members[node]) - 1) * words
        if node:
            children[node[:-1]] += 1
            leaves[node[:-1]] += leaves[node]
            saved[node[:-1]] += saved[node]
    out = []
    for node, convs in members.items():
        ends = sorted(c for c in convs if whole[c] == node)
        digest = sha256(",".join(map(str, ends)).encode()).hexdigest()
        parent = min(members[node[:-1]]) if node else None
        out.append((min(convs), len(node), parent, len(convs), children[node], leaves[node], saved[node], digest))
    return sorted(out, key=str)


def check(spark, rows, **options):
    out = trie.prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(5), **options).collect()
    assert sorted(map(tuple, out), key=str) == brute(rows)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(8)
    texts = ["hi there", "a  b\tc", "", None, "x" * 300, "yes ", "no way é"]
    out = []
    for c in [*range(0, 90), 1000, 1001, 1003, 10**12, -3]:
        for t in range(r.choice([1, 1, 2, 4, 9])):
            out.append((c, t, r.choice(["user", "assistant", None]), r.choice(texts), 1, "x", "y"))
    out += [(200 + c, t, "user", f"same {t}", 1, "x", "y") for c in range(60) for t in range(6)]  # copies
    out += [(300, t, "user", f"long {t % 3}", 1, "x", "y") for t in range(70)]
    out += [(4, None, "user", "first", 1, "x", "y"), (4, 0, "user", "tie", 1, "x", "y"), (4, 0, "a", "tie", 1, "x", "y")]
    out += [(7, 0, None, None, None, None, None), (7, 0, None, None, None, None, None), (None, 0, "user", "no id", 1, "x", "y")]
    return out


@pytest.mark.parametrize(
    "options",
    [{"crown": 1 << 18, "least": 3, "shard": 20}, {"least": 1, "shard": 5, "band": 3}],
)
def test_nodes_equal_brute_force(spark, rows, options, monkeypatch):
    monkeypatch.setattr(trie, "PIECE", 7)
    check(spark, rows, **options)


def test_few_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert trie.prefix_trie(none).collect() == []
    check(spark, [(0, 0, "user", "one", 1, "x", "y")])
    check(spark, [(25, None, None, None, 1, "x", "y")])
    assert trie.prefix_trie(spark.createDataFrame([(None, 0, "user", "no id", 1, "x", "y")], SCHEMA)).collect() == []


def test_slots_are_minimal_and_strangers_are_refused():
    r = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 1000, 50_000):
        a, b = r.integers(-(1 << 63), 1 << 63, (2, n))
        a[: n // 2] = 7  # half of the names share a word
        table = trie.PerfectHash(a, b)
        assert sorted(table.find(a, b).tolist()) == list(range(n))
        assert (table.find(b, a) == -1).all() or n < 2
    with pytest.raises(ValueError, match="distinct"):
        trie.PerfectHash(np.array([1, 1]), np.array([2, 2]))


def test_running_names_do_not_depend_on_batches():
    import pandas as pd

    r = np.random.default_rng(2)
    conv = np.sort(r.integers(0, 6, 50))
    pdf = pd.DataFrame({"conv": conv, "place": 0, "g1": r.integers(-9, 9, 50), "g2": r.integers(-9, 9, 50)})
    whole = pd.concat(trie._running(iter([pdf.copy()])))
    for cuts in ([10, 10, 11, 30], [1, 2, 3, 49]):
        parts = [pdf.iloc[a:b].copy() for a, b in zip([0, *cuts], [*cuts, 50], strict=True)]
        assert pd.concat(trie._running(iter(parts))).equals(whole)
