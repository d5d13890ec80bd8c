import random
import re
import string

from binfall.llm import jaccard
from binfall.llm.components import components

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def shingle_set(text, k):
    words = [w for w in re.split(r"[ \t\n\x0b\x0c\r]+", (text or "").translate(LOWER)) if w]
    if len(words) < k:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def brute(rows, k, threshold):
    sets = [(i, shingle_set(t, k)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for p, (i, a) in enumerate(sets):
        for j, b in sets[:p]:
            if a and b and 100 * len(a & b) >= threshold * len(a | b):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return sorted((i, len(s), root(i)) for i, s in sets)


def ours(df):
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in df.collect())


def edits(words, n, rng):
    out = list(words)
    for _ in range(n):
        at = rng.randrange(len(out))
        out[at : at + rng.randrange(2)] = [f"e{rng.randrange(10**9)}"]
    return out


def cases(prose):
    rng = random.Random(3)
    docs = []
    for size in (1, 2, 3, 4, 7, 11, 12, 13, 17, 20, 21, 22, 25, 33, 60, 150, 400):
        base = prose(size)
        docs += [base, base, base[1:], base[:-1], [*base, "tail"], ["Head", *base], edits(base, 1, rng), edits(base, 1, rng)]
        docs += [edits(base, max(1, size // 60), rng) for _ in range(4)]
    common = prose(90)
    docs += [common + prose(rng.randrange(5, 60)) for _ in range(25)]
    family = prose(300)
    docs += [edits(family, rng.randrange(9), rng) for _ in range(60)]
    texts = [" ".join(d) for d in docs]
    texts += [texts[-1].upper(), None, "", " \n", texts[-2].replace(" ", "\n\t"), " ".join(prose(30_000))]
    order = list(range(len(texts)))
    rng.shuffle(order)
    return [(i, texts[o]) for i, o in enumerate(order)]


def test_against_all_pairs(spark, documents, prose):
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    rows = cases(prose)
    df = documents([(i, t, "s") for i, t in rows]).repartition(3)
    for k, threshold in ((3, 90), (5, 80)):
        assert ours(jaccard.groups(df, k=k, threshold=threshold)) == brute(rows, k, threshold)


def test_empty_table_repeated_ids_and_clashing_columns(spark, documents, prose):
    assert jaccard.groups(documents([])).count() == 0
    a, b = " ".join(prose(40)), " ".join(prose(40))
    odd = spark.createDataFrame([(5, a, 1), (5, a, 1), (5, b, 2), (7, b, 3), (None, b, 4), (9, "x", 0)], "doc_id long, text string, k1 int")
    got = sorted(((r.doc_id, r.component_id) for r in jaccard.groups(odd).collect()), key=str)
    assert got == [(5, 5), (5, 5), (5, 5), (7, 5), (9, 9), (None, None)]


def test_boundary_follows_cost():
    assert jaccard.cost_boundary(90) == 15
    assert jaccard.cost_boundary(99) == 19
    assert jaccard.cost_boundary(80) == 9


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (200, 150), (150, 200)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 140), 100), 150: 150, 200: 150}
