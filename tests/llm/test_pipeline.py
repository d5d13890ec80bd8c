import corpus_pipeline as cp
import pytest
from binfall.llm import bpe, jaccard, mixing, pii, toxicity
from binfall.llm.queries import ensure_checkpoint_dir, table
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(repr, df.collect()))


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The input and output of every stage, each written and read again as the pipeline's driver does."""
    ensure_checkpoint_dir(spark)
    at = tmp_path_factory.mktemp("stages")
    out = [table(spark, SF, "documents")]
    for k, (_, stage) in enumerate(cp.STAGES):
        stage(spark, out[-1], SF).write.parquet(f"{at}/{k}")
        out.append(spark.read.parquet(f"{at}/{k}"))
    return out


def test_stages_keep_the_columns_of_documents(stages):
    for df in stages[1:-1]:
        assert df.dtypes == stages[0].dtypes


def test_run_equals_the_chain_of_operators(spark, stages):
    assert rows(cp.run(spark, SF)) == rows(stages[-1])


def test_toxicity_drops_what_the_model_rejects(spark, stages):
    before, after = stages[0], stages[1]
    model = toxicity.fit(before, table(spark, SF, "labels"))
    rejected = {r.doc_id for r in toxicity.score(before, model).where("predicted = 1").collect()}
    assert {r.doc_id for r in before.collect()} - {r.doc_id for r in after.collect()} == rejected


def test_one_document_of_a_group_stays(stages):
    import random
    import re

    before, after = stages[1], stages[2]
    sets = {}
    for r in before.collect():
        words = [w for w in re.split(r"[ \t\n\x0b\x0c\r]+", (r.text or "").translate({c: c + 32 for c in range(65, 91)})) if w]
        sets[r.doc_id] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
    label = {i: i for i in sets}
    ids = sorted(sets)
    links = [(i, j) for n, i in enumerate(ids) for j in ids[:n] if sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    random.Random(0).shuffle(links)
    changed = True
    while changed:
        changed = False
        for i, j in links:
            low = min(label[i], label[j])
            if label[i] != low or label[j] != low:
                label[i] = label[j] = low
                changed = True
    assert {r.doc_id for r in after.collect()} == set(label.values())


def test_pii_mixing_and_encoding_are_the_operators(spark, stages):
    assert rows(stages[3]) == rows(pii.sanitise(stages[2]))
    taken = {(r.doc_id, r.times) for r in mixing.mix(stages[3], labels=table(spark, SF, "labels")).where("times > 0").collect()}
    assert {(r.doc_id, r.n) for r in stages[4].groupBy("doc_id").agg(F.count("*").alias("n")).collect()} == taken
    import public_tokenizers

    assert stages[5].count() == stages[4].count()
    digests = bpe.encode(stages[4], public_tokenizers.path("word_bpe_49k.json"), add=("n_tokens", "ids_sha256"))
    assert rows(stages[5].select("doc_id", "n_tokens", "ids_sha256")) == rows(digests)


def test_texts_of_one_id_are_told_apart(spark):
    ensure_checkpoint_dir(spark)
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    data = [(1, a), (2, a + " tail"), (2, b), (2, b), (3, c), (3, c + " tail"), (4, None), (4, None), (4, ""), (None, a), (None, a)]
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in data], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.doc_id, r.text) for r in cp.drop_near_copies(spark, df, SF).collect()]
    # the near copy under id 2 goes, its other text stays once; of the two texts of 3 one stays; rows without an id stay
    assert (1, a) in got and got.count((2, b)) == 1 and (2, a + " tail") not in got
    assert sum(i == 3 for i, _ in got) == 1 and got.count((None, a)) == 2 and sum(i == 4 for i, _ in got) == 1


def test_odd_documents_go_through(spark, tmp_path):
    ensure_checkpoint_dir(spark)
    schema = "doc_id long, text string, lang string, source string, n_chars long, key string, score double"
    odd = [(1, None, None, None, None, "k", 0.5), (2, "", "en", "s", 0, "k", 0.5), (3, "a b", "en", "s", 3, None, None), (3, "a b", "en", "s", 3, None, None), (4, "word " * 3000, "en", "t", 15000, "k", 1.0), (None, "no id here", "en", "t", 10, "k", 1.0)]
    for data in (odd, []):
        df = spark.createDataFrame(data, schema)
        for name, stage in cp.STAGES[:-1]:
            df = spark.createDataFrame(stage(spark, df, SF).collect(), schema)
            assert df.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"], name
        cp.STAGES[-1][1](spark, df, SF).collect()
    assert jaccard.groups(spark.createDataFrame([], schema)).count() == 0
