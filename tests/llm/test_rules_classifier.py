"""Quality rules and the classifier against plain Python."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pytest

from clickloom.llm import classifier, rules

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string"


def prose(rng: random.Random, lines: int, words: int = 12) -> str:
    return "\n".join(" ".join(f"w{rng.randrange(10**6)}" for _ in range(words)) for _ in range(lines))


def plain(t: str) -> tuple:
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    twice, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if twice[w] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    marks = len(re.findall(r"[#*$%&|<>]", t))
    return len(words), sum(map(len, words)), marks, len(lines) - len(set(lines)), len(covered), failed


@pytest.fixture(scope="module")
def corpus(spark):
    """A host with a line that most documents share, copies, odd texts, and hosts that are null or hold one document."""
    rng = random.Random(2)
    shared = "Shared  BOILER plate " + " ".join(f"u{k}" for k in range(60))
    rows = []
    for i in range(120):
        text = prose(rng, 8)
        rows.append((i, f"{text}\n{shared if i % 2 else shared.lower()}" if i < 90 else text, "en", "hot", 5, "x"))
    rows.append((200, shared + "\n" + prose(rng, 1), "en", "hot", 5, "x"))  # depleted
    rows.append((201, shared + "\n" + prose(rng, 1), "en", "other", 5, "x"))  # another host's line
    copy = prose(rng, 9)
    rows += [(300 + i, copy, "en", "copies", 5, "x") for i in range(80)]
    words = ["a", "b", "c", "dd", "é", "#", "<|>"]
    rows += [(500 + i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 90))), None, None, 0, None) for i in range(40)]
    rows += [(600, None, None, None, None, None), (601, "", "en", "hot", 0, "x"), (602, " \t\n\n ", "en", "hot", 0, "x")]
    rows += [(603, "x y z " * 20_000, "en", "long", 1, "x"), (None, prose(rng, 9), "en", "one", 1, "x")]
    rows += [(604, "\x0b a\tb\x0c c \r\n a b c " + prose(rng, 6), "de", "one", 1, "x")] * 2
    return spark.createDataFrame(rows, SCHEMA)


def test_base_rules(corpus):
    got = rules.rules(corpus).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    want = Counter((r["doc_id"], plain(r["text"] or "")) for r in corpus.collect())
    assert Counter((r["doc_id"], tuple(r[n] for n in names)) for r in got) == want
    assert all(not r["kept"] for r in got if r["base_failed"])


def test_line_frequency(corpus):
    got = {r["doc_id"]: r for r in rules.rules(corpus).collect()}
    assert got[5]["removed_lines"] == 1 and got[100]["removed_lines"] == 0
    assert got[200]["removed_lines"] == 1 and not got[200]["kept"] and not got[200]["base_failed"]
    assert got[201]["removed_lines"] == 0
    assert got[300]["removed_lines"] == 0 and got[300]["kept"]  # copies are one document
    texts = {r["doc_id"]: r for r in rules.cleaned(corpus).collect()}
    assert set(texts) == {k for k, r in got.items() if r["kept"]}
    before = {r["doc_id"]: r["text"] for r in corpus.collect()}
    for k, r in texts.items():
        whole = [x for x in before[k].split("\n") if k is None or not (k < 90 and "boiler" in x.lower())]
        assert r["text"] == "\n".join(whole)
    assert texts[5]["n_chars"] == len(texts[5]["text"]) and texts[100]["n_chars"] == 5


def test_documents_that_share_their_longest_word_are_counted(spark):
    """The shared line holds the longest word of every document that has it; copies still count as one."""
    rng = random.Random(5)
    footer = "see https://example.org/" + "terms-and-conditions/" * 9
    rows = [(i, f"{prose(rng, 8)}\n{footer if i % 2 else footer.upper()}" if i < 90 else prose(rng, 8)) for i in range(120)]
    copy = prose(rng, 9)
    rows += [(300 + i, copy.upper() if i % 2 else copy.replace(" ", " \t")) for i in range(80)]
    docs = spark.createDataFrame([(k, t, "en", "hot", 5, "x") for k, t in rows], SCHEMA)
    got = {r["doc_id"]: (r["removed_lines"], r["kept"]) for r in rules.rules(docs).collect()}
    assert got == {k: (int(k < 90), True) for k, _ in rows}
    texts = {r["doc_id"]: r["text"] for r in rules.cleaned(docs).collect()}
    assert all("example.org" not in t.lower() for t in texts.values()) and len(texts) == len(rows)


def test_rules_plan_has_no_python(corpus):
    plan = rules.rules(corpus)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_classifier_separates_held_out_documents(spark):
    path = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{path}/{t}.parquet") for t in ("documents", "labels"))
    model = classifier.fit(docs, labels.where("doc_id % 2 = 0"))
    out = classifier.classified(docs, model).select("doc_id", "_kept").join(labels.where("doc_id % 2 = 1"), "doc_id")
    told = Counter((r["quality"], r["_kept"]) for r in out.collect())
    assert told[1, False] <= 0.01 * (told[1, True] + told[1, False])
    assert told[0, True] <= 0.05 * (told[0, True] + told[0, False])


def test_sites_are_shrunk(spark):
    """Site rates against the formula in plain Python."""
    rng = random.Random(4)
    rows = [(i, "A " * rng.randint(1, 9) + "b!" * rng.randint(0, 4), rng.choice(["x", "y", None]), f"h{rng.randrange(6)}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    model = classifier.Model(0.3, (0.0, -1.5, 2.0, 0.0, 0.0, 0.1))
    out = classifier.classified(docs, model).collect()
    p = {r["doc_id"]: 1 / (1 + 2.718281828459045 ** -r["_doc_logit"]) for r in out}
    _, rate, upper, lower = classifier.sites(
        classifier.classified(docs, model).selectExpr("source", "lang", "1 / (1 + exp(-_doc_logit)) as _p"), "source", "lang"
    )
    host, site = defaultdict(list), defaultdict(list)
    for i, _, lang, source in rows:
        host[source].append(p[i])
        site[source, lang].append(p[i])
    for r in out:
        h, s, own = host[r["source"]], site[r["source"], r["lang"]], p[r["doc_id"]]
        of_host = (sum(h) - own + upper * rate) / (len(h) - 1 + upper)
        want = (sum(s) - own + lower * of_host) / (len(s) - 1 + lower)
        assert abs(r["_site_rate"] - want) < 1e-9


def test_empty_and_unlabelled(corpus):
    none = corpus.limit(0)
    assert rules.rules(none).count() == rules.cleaned(none).count() == 0
    labels = corpus.sparkSession.createDataFrame([], "doc_id long, quality int")
    model = classifier.fit(corpus, labels)
    assert classifier.classified(corpus, model).where("_kept").count() == corpus.count()
    assert classifier.classified(none, model).count() == 0
