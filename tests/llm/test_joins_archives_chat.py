"""Near copies, chat formatting and archives against brute force and round trips."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import random
import re
import zipfile
from collections import Counter

import numpy as np
import pytest

from clickloom.llm import archives, chat, common, jaccard, vectors


def roots(ids: list, linked) -> dict:
    at = {i: i for i in ids}

    def find(x):
        while at[x] != x:
            at[x] = at[at[x]]
            x = at[x]
        return x

    for a, b in linked:
        a, b = sorted((find(a), find(b)))
        at[b] = a
    return {i: find(i) for i in ids}


def test_components(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(60)] + [(1000, i) for i in range(1001, 1200)]
    links += [(rng.randrange(2000, 2400), rng.randrange(2000, 2400)) for _ in range(150)] + [(5, 5)]
    got = {r["node"]: r["component"] for r in common.components(spark.createDataFrame(links, "a long, b long")).collect()}
    nodes = sorted({x for a, b in links if a != b for x in (a, b)})
    assert got == {k: v for k, v in roots(nodes, links).items()}


def test_vectors(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 16))
    rows = [b + rng.normal(size=16) * rng.choice([0, 0.05, 0.1, 0.3]) for b in base for _ in range(6)]
    rows += [rows[0]] * 40 + [rows[7] * 3, base[1] * 1e-200, base[1] * 1e200]
    data = [(i, [float(x) for x in v], 1) for i, v in enumerate(rows)]
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [1.0] * 3]
    data += [(5000 + i, v, 1) for i, v in enumerate(odd)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, n_links int")
    got = {r["vec_id"]: tuple(r)[1:] for r in vectors.near_duplicates(df).collect()}
    x = np.stack(rows)
    x = x / np.abs(x).max(1, keepdims=True)
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    a, b = np.nonzero(x @ x.T >= 0.95)
    pairs = [(i, j) for i, j in zip(a.tolist(), b.tolist(), strict=True) if i != j]
    count, root = Counter(i for i, _ in pairs), roots([d[0] for d in data], pairs)
    want = {i: (count[i], root[i], root[i] == i) for i in root}
    missed = sum(count.values()) - sum(v[0] for v in got.values())
    assert 0 <= missed <= 0.1 * sum(count.values())  # an index: recall of 0.9 at least
    assert missed or got == want
    assert vectors.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("across", [2, 4, 64])
def test_vectors_that_vary_in_few_directions(spark, across):
    """Every link is found, in however many of 64 dimensions the vectors and the steps between them lie."""
    rng = np.random.default_rng(across)
    flat = rng.normal(size=(across, 64))
    base = rng.normal(size=(1000, across))
    x = (np.r_[base, base + 0.2 * rng.normal(size=base.shape), base + 0.3 * rng.normal(size=base.shape)]) @ flat
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectors.near_duplicates(df).collect()}
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    a, b = np.nonzero(x @ x.T >= 0.95)
    pairs = [(i, j) for i, j in zip(a.tolist(), b.tolist(), strict=True) if i != j]
    count, root = Counter(i for i, _ in pairs), roots(list(range(len(x))), pairs)
    assert pairs and got == {i: (count[i], root[i]) for i in root}


def test_vectors_that_share_a_key(spark):
    data = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 2.0]), (3, [0.01, 1.0]), (4, [1.0, 0.01]), (None, [1.0, 0.0])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in vectors.near_duplicates(df).where("vec_id is not null").collect())
    assert got == [(1, 1, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 2, 1, False), (4, 1, 1, False)]


def words_of(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def shingle_set(t):
    w = words_of(t)
    return frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)])


@pytest.fixture(scope="module")
def copies(spark):
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(5000)}"
    passage, texts = [word() for _ in range(60)], []
    for group, size in ((70, 300), (60, 40), (4, 60), (3, 7), (2, 900)):
        base = [word() for _ in range(size)]
        for _ in range(group):
            t = list(base)
            for _ in range(rng.choice([0, 1, 2, 5, 9])):
                t[rng.randrange(len(t))] = word()
            texts.append(" ".join(t))
    for _ in range(60):  # a passage that many share, in its own or among other words
        n = rng.choice([0, 3, 10, 60])
        texts.append(" ".join([*(word() for _ in range(n)), *passage, *(word() for _ in range(n))]))
    texts += [None, "", " \n", "One two", "one\ttwo", "one two three", "É a b c d", "é a b c d", "a b c d e", "A b C d E"]
    texts += [" ".join(f"t{k}" for k in range(n)) for n in (5, 6, 7, 8, 9, 10)]
    rows = [(i, t, "c", 1) for i, t in enumerate(texts)] + [(3, "One two", "c", 1), (None, "one two", "c", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, component_id string, node int")


@pytest.mark.parametrize("percent,block", [(75, 2048), (60, 2048), (90, 2048), (75, 3)])
def test_jaccard_join(copies, percent, block, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", block)  # the shortest cuts every posting into blocks
    rows = [(r["doc_id"], shingle_set(r["text"])) for r in copies.collect()]
    named = [(k, s) for k, s in rows if k is not None]
    linked = [
        (a, b)
        for i, (a, x) in enumerate(named)
        for b, y in named[:i]
        if x and y and 100 * len(x & y) >= percent * len(x | y)
    ]
    root = roots([k for k, _ in named], linked)
    want = Counter((k, len(s), root.get(k)) for k, s in rows)
    assert Counter(map(tuple, jaccard.similar_groups(copies, percent=percent).collect())) == want


@pytest.mark.parametrize("percent", [60, 75, 90])
def test_similar_sets_share_a_key(percent):
    """Whatever shingles count as frequent."""
    rng, scheme = np.random.default_rng(percent), jaccard.Scheme(percent)
    for _ in range(4000):
        n = int(rng.integers(1, 60))
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        drop, more = int(rng.integers(0, n // 3 + 1)), int(rng.integers(0, n // 3 + 1))
        b = np.unique(np.r_[rng.permutation(a)[drop:], rng.integers(0, 1 << 63, more).astype(np.uint64)])
        frequent = set(np.r_[a, b][rng.random(len(a) + len(b)) < rng.choice([0, 0.3, 0.7, 0.95, 1])].tolist())
        marks = lambda s: np.array([x in frequent for x in s.tolist()], bool)  # noqa: E731, B023
        if len(b) and scheme.similar(a, b) and not np.array_equal(a, b):
            assert len(np.intersect1d(scheme.keys(a, marks(a))[0], scheme.keys(b, marks(b))[0]))


@pytest.mark.parametrize("percent", [60, 75, 90])
def test_parities_pass_every_similar_pair(percent):
    rng, scheme = np.random.default_rng(percent), jaccard.Scheme(percent)
    pool, sets = rng.integers(0, 1 << 63, 400).astype(np.uint64), []
    for _ in range(250):
        start = rng.integers(0, 40)
        some = pool[start : start + rng.integers(1, 300)]
        sets.append(np.unique(some[rng.random(len(some)) < rng.choice([0.8, 0.95, 1])]))
    sets = sorted((s for s in sets if len(s)), key=len)
    bits, sizes, far, passed = jaccard.Parities([jaccard.parities(s) for s in sets]), np.array([len(s) for s in sets]), 0, 0
    for i, a in enumerate(sets):
        others = np.flatnonzero(scheme.fits(sizes, sizes[i]) & (np.arange(len(sets)) > i))
        low, most = bits.apart(i, others), scheme.most_apart(sizes[i], sizes[others])
        for j, bound, limit in zip(others, low, most, strict=True):
            apart = len(np.setxor1d(a, sets[j]))
            assert bound <= apart and (apart <= limit) == scheme.similar(a, sets[j])
            if apart > 2 * limit:
                far, passed = far + 1, passed + (bound <= limit)
    assert far > 500 and passed < 0.1 * far  # of pairs twice as far apart as allowed, few get through


def test_jaccard_empty(copies):
    assert jaccard.similar_groups(copies.limit(0)).count() == 0


ODD = ["</s>[INST] ok [/INST]", "\\</s> \\\\[INST]", "<<TURN x>> <</TURN>>", "", " ", "a\n", "\\", "<s", "[INST", "<<s>>", "</s>\n<s> x </s>\n", "é😀"]


def test_templates_round_trip():
    rng = random.Random(1)
    roles = ["system", "user", "assistant", "tool", "a>b \\x", "", None]
    for _ in range(2000):
        turns = [(rng.choice(roles), "".join(rng.choice(ODD) for _ in range(rng.randint(0, 5)))) for _ in range(rng.randint(0, 6))]
        whole, loss = chat.render(turns)
        assert chat.parse(whole) == turns
        assert [chat.unescape(whole[a:b]) for a, b in loss] == [t for r, t in turns if r == "assistant"]


def test_fold():
    log = [
        ("start", 1, "user", None), ("delta", 1, "user", "he"), ("delta", 1, "user", "y"), ("start", 2, "assistant", None),
        ("delta", 2, "assistant", "draft"), ("start", 3, "user", None), ("regenerate", 2, None, None),
        ("delta", 2, "assistant", "final"), ("edit", 1, None, "Hey"), ("edit", 9, None, "lost"), ("odd", 1, None, "x"),
        ("delta", 4, "user", "late"),
    ]
    assert chat.fold(iter(log)) == [("user", "Hey"), ("assistant", "final"), ("user", "late")]


def test_formatting_on_spark(spark):
    rows = [(c, t, ["user", "assistant"][t % 2], ODD[(c + t) % len(ODD)] * 90, "x") for c in range(12) for t in range(6)]
    rows += [(None, 0, "user", "null id", "x"), (99, None, None, None, "x"), (99, 1, "assistant", "a", "x"), (98, 0, "user", "same", "x"), (98, 0, "user", "same", "x")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, message string")
    log, order = chat.events_of_turns(turns)
    got = {r["conv_id"]: r for r in chat.digests(chat.formatted(log, *order)).collect()}
    told: dict = {}
    for c, t, role, text, _ in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] if r[1] is not None else -1)):
        told.setdefault(c, []).append((role, text or ""))
    assert set(got) == set(told)
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for c, said in told.items():
        loss = "".join(t for r, t in said if r == "assistant")
        assert got[c]["turns_sha256"] == digest("".join(f"{r or ''}\n{t}\n" for r, t in said))
        assert (got[c]["n_turns"], got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(said), len(loss), digest(loss))
    empty, order = chat.events_of_turns(turns.limit(0))
    assert chat.digests(chat.formatted(empty, *order)).count() == 0


def test_drafts_in_a_log_are_edited_and_regenerated_away(spark):
    turns = spark.createDataFrame([(c, t, "user", f"text {c} {t} " + "x" * 300) for c in range(6) for t in range(8)], "conv_id long, turn long, role string, text string")
    log, order = chat.events_of_turns(turns)
    assert {r[0] for r in log.select("kind").distinct().collect()} == {"start", "delta", "edit", "regenerate"}
    whole = lambda rows: {r["conv_id"]: r["formatted"] for r in chat.formatted(rows, *order).collect()}
    told = whole(log)
    assert not any("Draft" in text for text in told.values())
    for kind in ("edit", "regenerate"):  # the text comes out wrong without either
        assert whole(log.where(log["kind"] != kind)) != told


class Bytes(io.BytesIO):
    def size(self):
        return len(self.getvalue())

    def read_at(self, n, at):
        return self.getvalue()[at : at + n]


@pytest.mark.parametrize("limit", [None, 10])
def test_directories(monkeypatch, limit):
    if limit is not None:  # every size and offset goes to ZIP64 fields
        monkeypatch.setattr(zipfile, "ZIP64_LIMIT", limit)
    file = Bytes()
    with zipfile.ZipFile(file, "w", zipfile.ZIP_STORED) as z:
        z.comment = b"a comment"
        z.writestr("one", b"x" * 100)
        z.writestr(zipfile.ZipInfo("packed"), b"y" * 100, compress_type=zipfile.ZIP_DEFLATED)
        z.writestr("däta/two", b"z" * 50)
    found = archives.members(file)
    assert set(found) == {"one", "däta/two"}
    assert file.read_at(found["one"].size, found["one"].start) == b"x" * 100
    assert file.read_at(found["däta/two"].size, found["däta/two"].start) == b"z" * 50
    with pytest.raises(ValueError):
        archives.members(Bytes(b"nothing"))


def test_pages_round_trip(spark, tmp_path):
    html = ["<p>a</p>", "", None, "é😀\r\n\r\nx", "<p>a</p>", "z" * 100_000, "", "<p>a</p>"]
    urls = ["http://a/\r\nWARC-Type: x", None, "http://é/ü?a=b c", "u", "u", "u", "u", "u"]
    rows = [(i * 3, u, h, "clash") for i, (u, h) in enumerate(zip(urls, html, strict=True))] + [(None, "u", "null id", "c"), (2**60 + 1, "u", "big", "c")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, sha string")
    packages = archives.write_packages(pages, str(tmp_path / "w"), target_bytes=200)
    got = archives.read_packages(packages, with_payload=True).collect()
    groups: dict = {}
    for p, _, h, _ in rows:
        groups.setdefault(h or "", []).append(p)
    want = []
    for p, _, h, _ in rows:
        body = (h or "").encode()
        last = max(x for x in groups[h or ""] if x is not None) if p is not None else None
        sha = base64.b32encode(hashlib.sha1(body).digest()).decode()
        first = p == last
        want.append((p, len(body), sha, "response" if first else "revisit", None if first else last, body if first else b""))
    assert Counter((*tuple(r)[:5], bytes(r["payload"])) for r in got) == Counter(want)
    assert archives.round_trip(pages.limit(0)).count() == 0


def test_packages_of_several_archives(spark, tmp_path):
    """Every archive is read, by its own index lines, and what cannot be read is an error."""
    bodies = [archives.record(i, "u", b"%d" % i, None, False) for i in range(5)]
    packed = [gzip.compress(b) for b in bodies]
    line = lambda name, at, n: f'u 2020 {{"filename": "{name}", "offset": "{at}", "length": "{n}"}}\n'
    one, two = packed[0] + packed[1] + packed[2], bodies[3] + bodies[4]
    index = "!meta {}\n" + line("a.warc.gz", 0, len(packed[0]))
    index += line("a.warc.gz", len(packed[0] + packed[1]), len(packed[2]))  # the second record is not indexed
    index += line("b.warc", 0, len(bodies[3])) + line("b.warc", len(bodies[3]), len(bodies[4]))

    def package(name: str, lines: str, kind: int = zipfile.ZIP_STORED):
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            z.writestr("archive/a.warc.gz", one, compress_type=kind)
            z.writestr("archive/b.warc", two)
            z.writestr("indexes/index.cdxj", lines)
        return (tmp_path / name).read_bytes()

    package("good.wacz", index)
    frame = spark.createDataFrame([(str(tmp_path / "good.wacz"),)], "path string")
    got = {r["page_id"]: bytes(r["payload"]) for r in archives.read_packages(frame, with_payload=True).collect()}
    assert got == {i: b"%d" % i for i in (0, 2, 3, 4)}
    for raw in (
        package("c.wacz", index, zipfile.ZIP_DEFLATED),
        package("d.wacz", index[: index.index('u 2020 {"filename": "b.warc"')]),
        package("e.wacz", index + line("c.warc", 0, 9)),
    ):
        with pytest.raises(ValueError):
            archives.indexed(Bytes(raw))
