import hashlib
import re

from binfall.llm import substrings

SPACE = r"[ \t\n\x0b\x0c\r]+"


def brute(rows, window=50):
    words = [(i, [w for w in re.split(SPACE, t or "") if w]) for i, t in rows]
    first = {}
    for i, ws in words:
        for at in range(len(ws) - window + 1):
            key = tuple(ws[at : at + window])
            if i is not None:
                first[key] = min(first.get(key, i), i)
    out = []
    for i, ws in words:
        gone = [False] * len(ws)
        for at in range(len(ws) - window + 1):
            if i is not None and first[tuple(ws[at : at + window])] < i:
                gone[at : at + window] = [True] * window
        kept = " ".join(w for w, g in zip(ws, gone) if not g)
        out.append((i, len(ws), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def ours(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in df.collect()), key=str)


def cases(prose):
    shared, other = prose(120), prose(60)
    docs = [
        prose(300),
        prose(40) + shared + prose(30),
        prose(10) + shared[5:90] + prose(70),
        shared[20:69] + prose(80),
        shared[20:70],
        prose(60) + other + prose(3) + other + shared[60:],
        other,
        prose(49),
        ["x"] * 200,
        ["x"] * 120 + ["y"] * 80,
        ["y", "x"] * 60,
        [],
    ]
    rows = [(i, "\n ".join(" ".join(d[k : k + 17]) for k in range(0, len(d), 17))) for i, d in enumerate(docs)]
    rows += [(20, rows[1][1]), (21, rows[1][1]), (21, rows[1][1]), (22, None), (None, rows[1][1]), (23, "a b " * 60), (1, rows[5][1])]
    return rows


def test_against_every_window(spark, documents, prose):
    rows = cases(prose)
    df = documents([(i, t, "s") for i, t in rows])
    assert ours(substrings.removals(df)) == brute(rows)
    assert ours(substrings.removals(df, window=12, gram=5)) == brute(rows, 12)


def test_a_long_document(spark, documents, prose):
    long = prose(40_000)
    rows = [(0, " ".join(long[100:20_000])), (1, " ".join(long)), (2, " ".join(long[30_000:30_060]))]
    assert ours(substrings.removals(documents([(i, t, "s") for i, t in rows]))) == brute(rows)


def test_empty_and_extra_columns(spark, documents):
    assert substrings.removals(documents([])).count() == 0
    odd = spark.createDataFrame([(1, "a b", 5, "c")], "doc_id long, text string, first int, cut string")
    assert ours(substrings.removals(odd)) == brute([(1, "a b")])


def test_factors_are_copies_of_their_source(spark, documents, prose):
    rows = [r for r in cases(prose)[:-1] if r[0] is not None]
    words = {}
    for i, t in rows:
        words.setdefault(i, [w for w in re.split(SPACE, t or "") if w])
    seen = 0
    for r in substrings.removals(documents([(i, t, "s") for i, t in rows]), window=20, gram=8).collect():
        own = words[r.doc_id]
        if r.n_words != len(own):
            continue
        covered = set()
        for f in r.factors:
            there = words[f.source][f.place : f.place + f.words]
            assert f.source < r.doc_id and f.words >= 20 and own[f.first : f.first + f.words] == there
            covered |= set(range(f.first, f.first + f.words))
            seen += 1
        assert len(covered) == r.n_removed and (r.kept_text or "").split() == [w for at, w in enumerate(own) if covered and at not in covered]
    assert seen > 8


def test_pieces_from_two_places_are_two_factors(spark, documents, prose):
    """Windows that follow each other here, and stand apart in the source, are no factor of it."""
    a = prose(51)
    rows = [(1, " ".join([*prose(20), *a[:50], *prose(70), *a[1:], *prose(9)])), (2, " ".join([*prose(40), *a, *prose(30)]))]
    df = documents([(i, t, "s") for i, t in rows])
    (r,) = substrings.removals(df).where("doc_id = 2").collect()
    assert [(f.first, f.words, f.source, f.place) for f in r.factors] == [(40, 50, 1, 20), (41, 50, 1, 140)] and r.n_removed == 51
    assert ours(substrings.removals(df)) == brute(rows)


def test_greedy_parse():
    found = substrings.factors([(0, 3, 5, 10)], [(4, 5, 14), (5, 7, 0), (9, 7, 4), (10, 7, 5), (11, 7, 8)], 50, 80)
    assert found == [(0, 54, 5, 10), (5, 50, 7, 0), (9, 51, 7, 4), (11, 50, 7, 8)]
    assert substrings.factors([], [], 50, 10) == []
