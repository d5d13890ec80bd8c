import numpy as np
import pytest
from binfall.llm import multiprobe as mp
from pyspark.sql import functions as F


def brute(ids, x, asked, k):
    """{query: [(id, score)]}: the k nearest others by falling inner product, then rising id."""
    out = {}
    for i, v in zip(ids, x):
        if asked(i):
            others = sorted((-float((v * w).sum()), j) for j, w in zip(ids, x) if j != i)[:k]
            out[i] = [(j, -s) for s, j in others]
    return out


def lists(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def frame(spark, ids, x, kind="array<double>"):
    return spark.createDataFrame([(int(i), v.tolist(), 0, 1, "x") for i, v in zip(ids, x)], f"vec_id long, embedding {kind}, label int, code int, q string")


def held(got, want, x, ids, least):
    assert set(got) == set(want)
    at = {i: v for i, v in zip(ids, x)}
    for q, near in got.items():
        assert len(near) == len(want[q]) and len({i for i, _ in near}) == len(near) and q not in {i for i, _ in near}
        assert near == sorted(near, key=lambda e: (-e[1], e[0]))
        assert all(abs(s - float((at[q] * at[i]).sum())) <= 1e-12 * max(1, abs(s)) for i, s in near)
    found = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert found >= least * sum(map(len, want.values()))


def test_recall_on_the_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    local = rows.collect()
    ids, x = [r.vec_id for r in local], np.array([r.embedding for r in local], float)
    held(lists(mp.nearest(rows).collect()), brute(ids, x, lambda i: i % 20 == 0, 20), x, ids, 0.93)


@pytest.mark.parametrize("spread", [0.0, 1.0])
def test_groups_and_uneven_lengths(spark, spread):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3000, 16)) + 2 * rng.normal(size=(40, 16))[rng.integers(0, 40, 3000)]
    x *= np.exp(spread * rng.normal(size=(3000, 1)))
    x[500:1500] = x[500]  # equal vectors, of which only the least ids can be near
    x[1500:2000] = x[1500] + 1e-3 * rng.normal(size=(500, 16))
    ids = rng.permutation(3000).tolist()
    got = lists(mp.nearest(frame(spark, ids, x)).collect())
    want = brute(ids, x, lambda i: i % 20 == 0, 20)
    held(got, want, x, ids, 0.93)
    copies = set(np.array(ids)[500:1500].tolist())
    for q in want:
        if q in copies and {i for i, _ in want[q]} <= copies:
            assert [i for i, _ in got[q]] == [i for i, _ in want[q]]


def test_hot_buckets_lie_in_several_shards(spark, monkeypatch):
    monkeypatch.setattr(mp, "SHARD", 60)
    rng = np.random.default_rng(9)
    x = np.r_[rng.normal(size=(8,)) + 1e-2 * rng.normal(size=(400, 8)), rng.normal(size=(200, 8))]
    ids = list(range(600))
    held(lists(mp.nearest(frame(spark, ids, x), F.col("vec_id") % 7 == 0, k=5).collect()), brute(ids, x, lambda i: i % 7 == 0, 5), x, ids, 0.93)


def test_all_buckets_are_exact(spark, monkeypatch):
    monkeypatch.setattr(mp, "MOST", 1)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(700, 32))
    ids = list(range(700))
    got, want = lists(mp.nearest(frame(spark, ids, x), k=4).collect()), brute(ids, x, lambda i: i % 20 == 0, 4)
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}


def test_visits_go_by_rising_cost():
    rng = np.random.default_rng(4)
    h = mp.Hashing(12, 1.0, 0.8)
    q = rng.normal(size=(30, 12))
    codes = h.visits(q, 40)
    slots = h.slots(q, True)
    assert (codes[:, :, 0] == h.codes(np.floor(slots))).all()
    # one table by hand: all sets of moves by -1, 0, 1 on each function
    low, off = np.floor(slots[0, 1]), slots[0, 1] - np.floor(slots[0, 1])
    moves = np.stack(np.meshgrid(*[[-1, 0, 1]] * mp.HASHES, indexing="ij"), -1).reshape(-1, mp.HASHES)
    cost = np.where(moves < 0, off**2, np.where(moves > 0, (1 - off) ** 2, 0)).sum(1)
    first = np.argsort(cost)[:40]
    by_hand = h.codes(np.repeat(low[None, None] + moves[first][:, None], 2, 1))[:, 1]
    assert len(set(by_hand.tolist()) & set(codes[0, 1].tolist())) >= 38


def test_odd_vectors(spark):
    bad = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (None, [1.0, 2.0])]
    good = [(20, [1.0, 2.0]), (21, [2.0, 4.0]), (22, [-1.0, -2.0]), (40, [1.0, 2.0]), (40, [1.0, 2.0]), (60, [1.0, 0.0, 0.0]), (41, [1e-170, 1e-170]), (42, [0.0, 3.0]), (43, [-0.0, 3.0])]
    got = lists(mp.nearest(spark.createDataFrame(bad + good, "vec_id long, embedding array<double>"), k=3).collect())
    assert got == {20: [(21, 10.0), (42, 6.0), (43, 6.0)], 40: [(21, 10.0), (42, 6.0), (43, 6.0)]}
    huge = lists(mp.nearest(spark.createDataFrame([(0, [1e200, 1e200]), (1, [1e200, 0.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<double>")).collect())
    assert huge == {0: [(1, float("inf")), (2, 2e200)]}


def test_fewer_candidates_and_empty_tables(spark):
    make = lambda rows: mp.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    assert make([]).count() == 0
    assert make([(20, [1.0], 1)]).count() == 0
    assert [tuple(r) for r in make([(20, [1.0], 1), (3, [2.0], 1)]).collect()] == [(20, 1, 3, 2.0)]
