import zlib

import numpy as np
import pytest
from binfall.llm import toxicity


def held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def corpus(prose, n=1200):
    rows, labels = [], []
    for i in range(n):
        words = prose(20 + i % 150)
        toxic = i % 9 == 0
        if toxic:
            words[i % len(words)] = "Idiot," if i % 2 else "wretched"
            words[len(words) // 2] = "clown!"
        rows.append((i, " ".join(words), "s"))
        labels.append((i, int(toxic)))
    return rows, labels


@pytest.fixture(scope="module")
def fitted(spark, documents):
    import random

    rng = random.Random(5)
    rows, labels = corpus(lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)])
    docs = documents(rows)
    return rows, dict(labels), docs, toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))


def test_held_out_accuracy(fitted):
    rows, labels, docs, model = fitted
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    out = [i for i in got if held(i)]
    assert len(out) > 100
    assert np.mean([got[i].predicted == labels[i] for i in out]) > 0.98
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())


def test_weights_are_few(fitted):
    assert 0 < len(fitted[3].index) < 20_000


def test_never_learns_from_held_out_rows(spark, fitted):
    rows, labels, docs, model = fitted
    flipped = spark.createDataFrame([(i, 1 - y if held(i) else y) for i, y in labels.items()], "doc_id long, toxic int")
    again = toxicity.fit(docs, flipped)
    assert again.intercept == model.intercept and (again.index == model.index).all() and (again.weight == model.weight).all()


def test_score_equals_a_plain_sum(fitted):
    model = fitted[3]
    text = "such an idiot clown and a w1 w2 w1 w2 wretched clown"
    import pyarrow as pa

    data = np.frombuffer(text.encode(), np.uint8)
    _, at = toxicity.features(data, np.array([0, len(data)]), model.bits)
    weights = dict(zip(model.index.tolist(), model.weight.tolist()))
    want = 1 / (1 + np.exp(-(model.intercept + sum(weights.get(int(x), 0) for x in set(at.tolist())))))
    assert toxicity.score_column(pa.array([text, None, ""]), model) == pytest.approx([want, 1 / (1 + np.exp(-model.intercept))] + [1 / (1 + np.exp(-model.intercept))])


def test_no_labels_nulls_and_empty(spark, documents):
    docs = documents(["a b", None])
    assert toxicity.fit(docs, spark.createDataFrame([(0, None)], "doc_id long, toxic int")) is None
    assert [r.predicted for r in toxicity.score(docs, None).collect()] == [0, 0]
    assert toxicity.score(documents([]), None).count() == 0


def plain_ftrl(examples, s):
    """FTRL-proximal one coordinate at a time, in dictionaries."""
    z, n = {}, {}

    def weight(i):
        zi = z.get(i, 0.0)
        l1 = 0.0 if i == "intercept" else s.l1
        if abs(zi) <= l1:
            return 0.0
        return -(zi - (l1 if zi > 0 else -l1)) / ((s.beta + n.get(i, 0.0) ** 0.5) / s.alpha + s.l2)

    for _ in range(s.epochs):
        for places, y in examples:
            p = 1 / (1 + np.exp(-min(35, max(-35, sum(map(weight, places))))))
            for i, w in [(i, weight(i)) for i in places]:
                g = p - y
                sigma = ((n.get(i, 0.0) + g * g) ** 0.5 - n.get(i, 0.0) ** 0.5) / s.alpha
                z[i] = z.get(i, 0.0) + g - sigma * w
                n[i] = n.get(i, 0.0) + g * g
    return {i: w for i in z if (w := weight(i))}


def places_of(text, bits):
    """Coordinates of a text's words, pairs of neighbours and pairs with one word between."""
    data = np.frombuffer(text.encode(), np.uint8)
    return set(toxicity.features(data, np.array([0, len(data)]), bits)[1].tolist())


def test_model_equals_plain_ftrl(spark, documents, prose):
    rows, labels = corpus(prose, 160)
    rows += [(200, " ".join(["clown!", *prose(30_000)]), "s"), (201, "", "s"), (202, None, "s")]
    labels += [(200, 1), (201, 0), (202, 1), (3, None), (4, 0), (4, 1)]
    s = toxicity.Settings(bits=14, l1=0.5, epochs=3)
    # repeated rows, and other texts of one id: the least is learnt from
    docs = documents(rows + rows[:9] + [(5, "zzz last", "s"), (None, "no id", "s")])
    got = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), s)
    order = spark.createDataFrame([(i,) for i, *_ in rows], "doc_id long").selectExpr("doc_id", "xxhash64(doc_id, 'order') AS o", "cast(doc_id as string) AS t").orderBy("o", "t").collect()
    truth, texts = {}, {i: t for i, t, _ in rows}
    for i, y in labels:
        if y is not None:
            truth[i] = max(y, truth.get(i, 0))
    examples = [(["intercept", *sorted(places_of(texts[r.doc_id] or "", s.bits))], truth[r.doc_id]) for r in order if not held(r.doc_id) and r.doc_id in truth]
    want = plain_ftrl(examples, s)
    assert got.intercept == pytest.approx(want.pop("intercept"), rel=1e-9)
    assert dict(zip(got.index.tolist(), got.weight.tolist())) == pytest.approx(want, rel=1e-6, abs=1e-9) and len(want) > 100


def test_packing():
    for places in ([], [0], [65534, 65535, 65536, 400_000, 1 << 20], list(range(0, 1 << 20, 70_001))):
        assert toxicity.unpacked(toxicity.packed(np.array(places, np.int64))).tolist() == places


def test_other_columns_and_whole_rows(spark, fitted):
    _, _, _, model = fitted
    odd = spark.createDataFrame([(1, "clown! idiot", 0.5, 7, "x"), (1, "clown! idiot", 0.5, 7, "x"), (None, None, None, None, None)], "doc_id long, text string, score double, predicted int, row string")
    scored = toxicity.score(odd, model, whole=True)
    assert [r.row for r in scored.collect()] == odd.collect() and scored.select("row.*").columns == odd.columns
    a, b, c = toxicity.score(odd, model).collect()
    assert a == b and c.doc_id is None and c.predicted == 0
