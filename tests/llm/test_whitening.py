import numpy as np
import pytest
from binfall.llm import whitening as wh

SCHEMA = "vec_id long, embedding array<float>, n int, component string, x int"


def brute(rows, k):
    """Everything in numpy and whole numbers: (id, component) to (deviation, whitened, explained), and the count."""
    x = [[int(np.floor(1024 * float(c))) + 100_000 for c in v] for _, v in rows]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    centred = np.array(x, float) - np.array(sums) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors.T[::-1]
    w = centred @ vectors[:k].T / np.sqrt(values[:k])
    far = [sum((n * c - s) ** 2 for c, s in zip(row, sums)) for row in x]
    return {(i, j + 1): (far[r], w[r, j], values[j] / values.sum()) for r, (i, _) in enumerate(rows) for j in range(k)}, n


def held(got, rows, k):
    want, n = brute(rows, k)
    by = {(r.vec_id, r.component): r for r in got}
    assert set(by) == set(want) and len(got) == len(want)
    for j in range(1, k + 1):
        ids = [i for i, c in want if c == j]
        a, b = np.array([by[i, j].whitened for i in ids]), np.array([want[i, j][1] for i in ids])
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-9
        assert all(by[i, j].explained == pytest.approx(want[i, j][2], rel=1e-9) for i in ids)
    assert all(by[key].deviation == want[key][0] and by[key].n == n for key in want)
    (error,) = {r.identity_error for r in got}
    assert error < 1e-9


def test_the_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    held(wh.whiten(df).collect(), [(r.vec_id, r.embedding) for r in df.collect()], 8)


def test_uneven_variances_and_odd_vectors(spark):
    rng = np.random.default_rng(2)
    x = (rng.normal(size=(400, 10)) * np.geomspace(40, 0.01, 10) @ np.linalg.qr(rng.normal(size=(10, 10)))[0]).astype(np.float32)
    good = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, [0.0] * 10), (1001, [float(v) for v in x[3]])]
    odd = [(2000, None), (2001, []), (2002, [None] + [1.0] * 9), (2003, [float("nan")] * 10), (2004, [float("inf")] + [0.0] * 9), (2005, [1.0] * 9), (2006, [1.0] * 11), (2007, [1e30] + [0.0] * 9)]
    df = spark.createDataFrame([(*r, 1, "c", 2) for r in good + odd], SCHEMA).repartition(5)
    held(wh.whiten(df).collect(), good, 8)
    held(wh.whiten(df, components=3).collect(), good, 3)


def test_pairs_in_several_passes(spark, monkeypatch):
    monkeypatch.setattr(wh, "SUMS", 7)
    rng = np.random.default_rng(5)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(60, 6)).astype(np.float32))]
    held(wh.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect(), rows, 6)


def test_no_variance_and_no_rows(spark):
    make = lambda rows: wh.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert make([]).count() == 0 and make([(1, None), (2, [])]).count() == 0
    assert make([(1, [2.0, 3.0]), (2, [2.0, 3.0])]).count() == 0
    flat = make([(1, [2.0, 3.0]), (2, [4.0, 3.0])]).collect()
    assert sorted((r.vec_id, r.component, r.n, r.deviation, abs(round(r.whitened, 9)), r.explained) for r in flat) == [(1, 1, 2, 2048**2, 1.0, 1.0), (2, 1, 2, 2048**2, 1.0, 1.0)]


def test_deviations_beyond_a_long(spark):
    rows = spark.createDataFrame([(1, [5e9, 0.0]), (2, [-5e9, 1.0]), (None, [0.0, 2.0])], "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in wh.whiten(rows, components=1).collect()}
    assert got[1].deviation is None and int(got[1].deviation_exact) == (3 * 5_000_000_000 * 1024) ** 2 + (3 * 1024) ** 2 and got[None].deviation == 9437184
    huge = spark.createDataFrame([(1, [8e12]), (2, [-8e12])] * 700, "vec_id long, embedding array<double>")
    assert {r.deviation_exact for r in wh.whiten(huge).collect()} == {None}
