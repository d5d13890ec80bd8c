"""The corpus pipeline: documents go through toxicity, n-gram Jaccard join, PII, mixing and BPE encoding.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` chains them over ``documents``. All but the last keep the columns of
documents. Stages follow the operators in ``binfall.llm`` and share their defined results for nulls, ties, repeated rows and empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from binfall.llm import bpe, components, jaccard, mixing, pii, toxicity
from binfall.llm.queries import prepare, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from the labelled rows of ``docs`` that are not held out."""
    prepare(spark)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model, whole=True)
    return scored.where("predicted = 0").select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by shared five-word shingles (Jaccard 0.8) the document of least id stays; of rows with one id and text, one.
    Different texts of one id are documents of their own, and of these the one of least hash has the id's place in the order. Documents without
    words, and rows without an id, stay. Texts are not shuffled for ids that are few enough to be sent to the tasks."""
    prepare(spark)
    digest = F.xxhash64(F.coalesce("text", F.lit("")))
    repeated = docs.select("doc_id", digest.alias("h")).where("doc_id is not null").groupBy("doc_id").agg(F.min("h").alias("least"), F.count("*").alias("n"))
    repeated = repeated.where("n > 1").select("doc_id", "least").checkpoint()
    rows = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text", digest.alias("h"))
    rows = rows.join(components.sent(repeated), "doc_id", "left")
    other = F.col("least").isNotNull() & (F.col("h") != F.col("least"))
    rows = rows.withColumn("node", F.when(other, -F.abs(F.xxhash64("doc_id", "h"))).otherwise(F.col("doc_id").cast("long")))
    groups = jaccard.groups(rows.select(F.col("node").alias("doc_id"), "text"), k=5, threshold=80)
    gone = groups.where("n_shingles > 0 and doc_id <> component_id").select(F.col("doc_id").alias("node")).distinct().checkpoint()
    kept = rows.join(components.sent(gone), "node", "left_anti")
    # equal ids are rare: only their rows are told apart
    single = kept.where("least is null").select("row.*")
    return single.unionByName(kept.where("least is not null").dropDuplicates(["node"]).select("row.*"))


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return pii.sanitise(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as many times as the mix takes it; labelled quality weighs it."""
    prepare(spark)
    return mixing.take(docs, labels=table(spark, sf_dir, "labels"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    prepare(spark)
    encoded = bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"), carry=("doc_id", "lang", "source"), add=("n_tokens", "ids", "ids_sha256", "decoded_sha256"))
    return encoded.withColumn("n_tokens", F.col("n_tokens").cast("long"))


STAGES = [("toxicity", drop_toxic), ("ngram_jaccard_join", drop_near_copies), ("pii", sanitise), ("mixing", mix_sources), ("bpe", encode)]

#: Learning, signatures and tokenising have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
