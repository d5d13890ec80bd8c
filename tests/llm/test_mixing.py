import pytest
from binfall.llm import mixing
from pyspark.sql import functions as F


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """Share by weight, stop at the caps, share the excess again until nothing is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, open_, out = share * sum(sizes.values()), set(order), {}
    while open_:
        left = total - sum(out.values())
        level = left / sum(w[s] for s in open_)
        over = {s for s in open_ if level * w[s] > most * sizes[s]}
        if not over:
            out |= {s: level * w[s] for s in open_}
            break
        out |= {s: most * sizes[s] for s in over}
        open_ -= over
    return out


def corpus(prose):
    rows, i = [], 0
    for source, docs, words in (("src0", 120, 90), ("src1", 30, 40), ("src10", 8, 300), (None, 20, 50), ("é", 3, 10), ("empty", 2, 0), ("src2", 60, 20)):
        for k in range(docs):
            rows.append((i, " ".join(prose(words // 2 + k % (words + 1) if words else 0)), source))
            i += 1
    return [*rows, (i, None, "src1"), (i + 1, rows[0][1], "src0"), (i + 1, rows[0][1], "src0")]


def test_targets_epochs_and_nearness(spark, documents, prose):
    rows = corpus(prose)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = brute_targets(sizes)
    got = mixing.mix(documents(rows)).collect()
    assert len(got) == len(rows)
    taken = dict.fromkeys(sizes, 0)
    largest = dict.fromkeys(sizes, 0)
    for r in got:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source]
        assert 0 <= r.times <= 2
        taken[r.source] += r.times * r.size
        largest[r.source] = max(largest[r.source], r.size)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] + 1e-6
        complete = int(want[s] // sizes[s]) if sizes[s] else 0
        assert all(r.times >= complete for r in got if r.source == s and r.size)


def test_same_prefix_as_a_full_sort(spark, documents, prose):
    rows = corpus(prose)
    few = {(r.doc_id, r.times) for r in mixing.mix(documents(rows), buckets=1).collect()}
    assert few == {(r.doc_id, r.times) for r in mixing.mix(documents(rows)).repartition(3).collect()}


def test_quality_draws_more(spark, documents, prose):
    rows = [(i, "word word word word" if i % 2 else "## %% 12 34", "s") for i in range(2000)]
    good = F.avg(F.col("times") * (F.col("doc_id") % 2)) * 2
    poor = F.avg(F.col("times") * (1 - F.col("doc_id") % 2)) * 2
    r = mixing.mix(documents(rows), share=0.5).agg(good.alias("good"), poor.alias("poor")).first()
    assert r.good > r.poor + 0.2


def test_take_repeats_documents_and_keeps_columns(spark, documents, prose):
    df = documents(corpus(prose))
    assert mixing.take(df).columns == df.columns
    assert mixing.take(df).count() == mixing.mix(df).agg(F.sum("times")).first()[0]
    odd = spark.createDataFrame([(1, "a b", "s", 5, 1.0)], "doc_id long, text string, source string, size int, key double")
    assert mixing.take(odd).columns == odd.columns
    assert mixing.mix(documents([])).count() == 0


def test_labelled_quality_draws_more(spark, documents, prose):
    rows = [(i, "word word word word", "s" if i % 2 else "t") for i in range(2000)] + [(None, "no id", "s")]
    labels = spark.createDataFrame([(i, int(i % 4 < 2)) for i in range(0, 1600)] + [(0, None), (4, 0), (None, 1), (7, 1)], "doc_id long, quality int")
    got = mixing.mix(documents(rows), weights=(1,), share=0.3, labels=labels).collect()
    assert len(got) == len(rows)
    drawn = lambda good: sum(r.times for r in got if r.doc_id is not None and 8 <= r.doc_id < 1600 and (r.doc_id % 4 < 2) == good)
    assert drawn(True) > 2 * drawn(False) > 0
    assert sorted(map(str, mixing.take(documents(rows), weights=(1,), share=0.3, labels=labels).select("doc_id").collect())) == sorted(f"Row(doc_id={r.doc_id})" for r in got for _ in range(r.times))


def test_a_very_long_text_and_clashing_columns(spark):
    schema = "doc_id long, text string, source string, size long, key double, weight int, label string, target double, kept int, bucket int, times string, open int, cut int"
    more = (7, 0.5, 1, "l", 2.0, 1, 2, "t", 3, 4)
    rows = [(1, "word " * 300_000, "a", *more), (2, "two words", "a", *more), (3, "of the other", "b", *more), (3, "of the other", "b", *more), (None, None, None, *[None] * 10)]
    df = spark.createDataFrame(rows, schema)
    got = {(r.doc_id, r.source): r for r in mixing.mix(df).collect()}
    assert got[1, "a"].size == 300_000 and got[1, "a"].source_size == 300_002 and got[None, None].times == 0
    taken = mixing.take(df)
    assert taken.columns == df.columns and taken.where("doc_id = 3").count() == 2 * got[3, "b"].times
    assert mixing.take(df.limit(0)).columns == df.columns and mixing.mix(df.limit(0)).count() == 0
