"""The registered queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chroma, htmlmain, jaccard, licenses, manifest, mixing, multiprobe, neighbours, oracles, pii, substrings, toxicity, whitening


BATCH_BYTES, BATCH_BYTES_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder that the cluster names; set one only where there is none, as in tests on one machine."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or "/tmp/binfall-checkpoints")


def prepare(spark: SparkSession) -> None:
    """What all operators here need of a session: a checkpoint folder, and Arrow batches of a few MB, as a batch of long texts is held by the
    executor and its Python worker at once. A limit that the user has set stays."""
    ensure_checkpoint_dir(spark)
    if spark.conf.get(BATCH_BYTES) == BATCH_BYTES_DEFAULT:
        spark.conf.set(BATCH_BYTES, "8m")


def op1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return neighbours.near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return pii.report(table(spark, sf_dir, "documents").select("doc_id", "text"), reach=None)


def op3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    mixed = mixing.mix(table(spark, sf_dir, "documents"), labels=table(spark, sf_dir, "labels"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return licenses.scan(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return jaccard.groups(table(spark, sf_dir, "documents"), k=3, threshold=90)


def op7_chroma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No table holds media: every conversation is rendered as sound, a chord for each word, turns in order."""
    prepare(spark)
    turns = table(spark, sf_dir, "conversations").where("conv_id is not null")
    texts = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    texts = texts.select(F.col("conv_id").alias("media_id"), F.array_join(F.col("turns.text"), " ").alias("text"))
    return chroma.alike(chroma.rendered(texts, "media_id", "text"), rate=2000)


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return htmlmain.main_text(table(spark, sf_dir, "pages"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    prepare(spark)
    return bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), add=("n_tokens", "ids_sha256", "decoded_sha256"))


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return substrings.removals(table(spark, sf_dir, "documents"), details=False)


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return manifest.verified(table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_multiprobe(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return multiprobe.nearest(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_neighbours": op1_neighbours,
    "op2_pii": op2_pii,
    "op3_mix": op3_mix,
    "op4_licenses": op4_licenses,
    "op5_toxicity": op5_toxicity,
    "op6_jaccard": op6_jaccard,
    "op7_chroma": op7_chroma,
    "op8_html": op8_html,
    "op9_bpe": op9_bpe,
    "op10_substrings": op10_substrings,
    "op11_merkle": op11_merkle,
    "op12_whitening": op12_whitening,
    "op13_multiprobe": op13_multiprobe,
}

ORACLES: dict[str, str] = {"op1_neighbours": oracles.OP1, "op3_mix": oracles.OP3, "op4_licenses": oracles.OP4, "op6_jaccard": oracles.OP6, "op10_substrings": oracles.OP10, "op11_merkle": oracles.OP11}
