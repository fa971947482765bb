import math
import random

import numpy as np
import pytest

from clickloom.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, i int, x string, y int"


def brute(rows, components=4, steps=256):
    """(n, deviation by row, whitened by row, explained) of (key, vector) rows."""
    some = [(k, v) for k, v, *_ in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    dims = max(len(v) for _, v in some)
    x = np.array([[math.floor(float(np.float32(c)) * steps) for c in v] + [0] * (dims - len(v)) for _, v in some])
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(0)
    centred = fit - sums / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    ends = (x - sums / n) @ vectors / np.sqrt(values)
    apart = [sum((n * int(c) - int(s)) ** 2 for c, s in zip(row, sums, strict=True)) for row in x]
    return [k for k, _ in some], n, apart, ends, values / np.trace(centred.T @ centred / n)


def check(spark, rows, **options):
    out = whitening.whitened(spark.createDataFrame(rows, SCHEMA).repartition(3), **options).collect()
    keys, n, apart, ends, share = brute(rows, options.get("components", 4))
    assert len(out) == len(keys) * len(share)
    got = {}
    for r in out:
        got.setdefault((r["vec_id"], r["deviation"]), {}).setdefault(r["component"], []).append(r["whitened"])
        assert r["n"] == n and abs(r["explained"] / share[r["component"] - 1] - 1) < 1e-9 and r["identity_error"] < 1e-9
    signs = None
    for i, k in enumerate(keys):
        own = np.array([got[k, apart[i]][c + 1][0] for c in range(len(share))])
        if signs is None:
            signs = np.sign(own * ends[i])
        assert np.allclose(own, signs * ends[i], atol=1e-8)


def test_whitened_equals_numpy(spark):
    r = np.random.default_rng(3)
    scale = np.array([3, 2.2, 1.5, 1, 0.6, 0.3])
    rows = [(i, [float(c) for c in r.normal(size=6) * scale], 1, "x", 2) for i in range(40)]
    hot = rows[5][1]
    rows += [(100 + i, hot, 1, "x", 2) for i in range(60)]  # a third and more of the rows are copies
    rows += [(None, rows[7][1], 1, "x", 2), (200, None, 1, "x", 2), (201, [1.0, None, 0.0], 1, "x", 2)]
    rows += [(202, [float("nan")] * 6, 1, "x", 2), (203, [float("inf"), 0.0], None, None, None)]
    rows += [(204, [1.5, -0.25], 1, "x", 2), (3, rows[3][1], 1, "x", 2), (205, [], 1, "x", 2), (206, [-0.0] * 6, 1, "x", 2)]
    check(spark, rows)
    check(spark, rows, components=2)


def test_more_columns_and_rows_than_a_block_holds(spark, monkeypatch):
    monkeypatch.setattr(whitening, "ROWS", 4)
    monkeypatch.setattr(whitening, "COLUMNS", 3)
    r = np.random.default_rng(4)
    rows = [(i, [float(c) for c in r.normal(size=8) * np.arange(8, 0, -1)], 1, "x", 2) for i in range(31)]
    check(spark, rows, components=3)


def test_few_vectors(spark):
    frame = lambda *v: spark.createDataFrame([(k, x, 1, "x", 2) for k, x in enumerate(v)], SCHEMA)
    for empty in (frame().limit(0), frame(None, []), frame([1.0, 2.0], [1.0, 2.0])):
        out = whitening.whitened(empty)
        assert out.collect() == [] and out.columns[:2] == ["vec_id", "component"]
    out = whitening.whitened(frame([1.0, 2.0], [1.0, 3.0])).collect()  # one direction, so one component
    assert sorted((r["vec_id"], r["component"], abs(round(r["whitened"], 9))) for r in out) == [(0, 1, 1.0), (1, 1, 1.0)]


@pytest.mark.parametrize("size", [1, 10**7, 10**16])
def test_deviation_is_exact_or_null(spark, size):
    r = random.Random(size)
    x = [[r.randrange(-size, size) for _ in range(3)] for _ in range(20)]
    n, sums = 20, [sum(v[d] for v in x) for d in range(3)]
    rows = spark.createDataFrame([(v,) for v in x], "x array<long>")
    got = rows.select(whitening.deviation(n, sums, max(abs(c) for v in x for c in v)).alias("d"), "x").collect()
    for row in got:
        want = sum((n * c - s) ** 2 for c, s in zip(row["x"], sums, strict=True))
        assert row["d"] == (want if want < 1 << 63 else None)
