import numpy as np
import pytest
from binfall.llm import neighbours as nb


def vectors(n, dim=24, seed=4):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    x[20:120] = x[5] + rng.normal(size=(100, dim)) * 0.02  # a dense group
    for i in range(200, 300, 2):  # pairs around the threshold
        x[i + 1] = x[i] + rng.normal(size=dim) * np.linalg.norm(x[i]) / dim**0.5 * rng.uniform(0.2, 0.45)
    for i in range(320, 340):  # a chain
        x[i] = x[i - 1] + rng.normal(size=dim) * 0.15
    x[400:440] = x[401]  # copies
    x[450] = 3 * x[401]
    return x


def brute(ids, x, threshold=0.95):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = (u @ u.T) >= threshold
    np.fill_diagonal(links, False)
    label = np.array(ids)
    while True:
        new = np.minimum(label, np.where(links, label, np.iinfo(np.int64).max).min(1))
        if (new == label).all():
            return links.sum(1), label
        label = new


def test_links_and_components_equal_brute_force(spark):
    x = vectors(3000)
    ids = [7 * i + 3 for i in range(len(x))]
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in zip(ids, x)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in nb.near_duplicates(df).collect()}
    n, label = brute(ids, x)
    assert len(got) == len(ids)
    # a beam may miss a link of a query that is not audited, but none of a thousand
    assert all(got[i].n_links <= n[k] for k, i in enumerate(ids)) and sum(r.n_links for r in got.values()) >= 0.999 * n.sum()
    assert [i for k, i in enumerate(ids) if got[i].component_id != label[k]] == []
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def found_by(graph, u, queries, audit):
    pairs = []
    nb.links_of(graph, u, queries, 0.95, audit, lambda q, m: pairs.extend(zip(q.tolist(), m.tolist(), strict=True)))
    assert len(pairs) == len(set(pairs))
    return set(pairs)


def test_copies_planted_in_the_embeddings(spark):
    """The table has no two vectors alike; with near copies put in, all their links are found, and nothing else."""
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding").collect()
    x = np.array([r.embedding for r in rows], float)
    rng = np.random.default_rng(6)
    more = [x[i] + rng.normal(size=x.shape[1]) * np.linalg.norm(x[i]) / x.shape[1] ** 0.5 * s for i in range(0, 200, 2) for s in (0.1, 0.25, 0.33)]
    more += [x[7] + rng.normal(size=x.shape[1]) * 1e-3 for _ in range(200)]
    ids, x = [r.vec_id for r in rows] + [10**6 + k for k in range(len(more))], np.r_[x, more]
    got = {r.vec_id: r for r in nb.near_duplicates(spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>")).collect()}
    n, label = brute(ids, x)
    assert n.sum() > 40_000
    assert [(got[i].n_links, got[i].component_id) for i in ids] == list(zip(n.tolist(), label.tolist()))


def test_reduced_pairs_keep_counts_and_connections():
    rng = np.random.default_rng(3)
    links = rng.random((60, 80)) < 0.03
    links[10:40, 20:70] = True
    many = rng.integers(1, 4, 80)
    r = nb.Reduced(60, 80, many)
    for lo in range(0, 60, 7):
        q, m = np.nonzero(links[lo : lo + 7])
        r.add(q + lo, m)
    assert (r.count == links @ many).all()

    def connected(q, m):
        label = {}
        for a, b in zip((q + 1000).tolist(), m.tolist(), strict=True):
            x, y = label.get(a, {a}), label.get(b, {b})
            if x is not y:
                for v in x | y:
                    label[v] = x | y
                merged = label[a]
                for v in merged:
                    label[v] = merged
        return {k: frozenset(v) for k, v in label.items()}

    assert connected(*np.nonzero(links)) == connected(*r.pairs()) and len(r.pairs()[0]) < 60 + 80 + 300


def test_recall_of_the_graph_against_a_scan():
    x = vectors(4000)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    graph = nb.Graph(u)
    found = found_by(graph, u, u[:1000], np.arange(0, 1000, 20))
    truth = {(a, b) for a, b in zip(*np.nonzero(u[:1000] @ u.T >= 0.95))}
    assert found <= truth
    assert len(found) >= 0.99 * len(truth)


def test_a_failed_audit_widens_the_beam(monkeypatch):
    x = vectors(2000)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    graph = nb.Graph(u)
    search, widths = graph.search, []

    def blind(queries, width):
        widths.append(width)
        ids, sims = search(queries, width)
        return (ids, sims) if width >= 4 * nb.BEAM else (np.full_like(ids, -1), np.full_like(sims, -2))

    monkeypatch.setattr(graph, "search", blind)
    found = found_by(graph, u, u[:200], np.arange(0, 200, 3))
    assert max(widths) >= 4 * nb.BEAM
    assert len(found) >= 0.99 * (u[:200] @ u.T >= 0.95).sum()


def test_forest_keeps_connections():
    a, b = np.array([1, 2, 1, 5, 6, 5]), np.array([2, 3, 3, 6, 7, 7])
    assert nb.forest(a, b).tolist() == [0, 1, 3, 4]


@pytest.mark.parametrize("shards", [1, 3])
def test_odd_vectors(spark, shards):
    bad = [None, [], [0.0, 0.0], [1.0, None], [float("nan"), 1.0], [float("inf"), 1.0]]
    good = [(10, [1.0, 2.0]), (11, [2.0, 4.0]), (12, [1e-200, 2e-200]), (13, [1e200, 2e200]), (14, [-1.0, -2.0]), (15, [1.0, 2.0, 0.0]), (16, [1.0, 2.0]), (16, [1.0, 2.0]), (17, [1.0, 0.0])]
    df = spark.createDataFrame([*enumerate(bad), *good, (None, [1.0, 2.0])], "vec_id long, embedding array<double>")
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in nb.near_duplicates(df, shards=shards).collect()), key=str)
    group = {10, 11, 12, 13, 16}
    want = [(i, 4, 10, i == 10) if i in group else (i, 0, i, True) for i in [*range(6), *(i for i, _ in good)]]
    assert got == sorted([*want, (None, 0, None, None)], key=str)


def test_empty_table(spark):
    assert nb.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, n long, x int")).count() == 0
