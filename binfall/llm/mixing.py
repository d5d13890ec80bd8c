"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document gets the exponential key ``-ln(u) / quality`` with ``u`` from a digest of its id, so documents of higher
quality tend to have smaller keys. Quality is what labels say of a document, else a column of the user, else the share of letters. A source's target in words is met by whole epochs first; what is left is a prefix of
the source in key order, cut where the words taken come nearest to the budget.
A plan of one row per source, with the key of the last document that is taken, then decides on every document. It is counted
first: up to ``PLAN_ROWS`` sources it is sent to the tasks, so that documents are not shuffled, let alone by source.

Nothing is sorted or windowed by source alone. Keys fall in ``buckets`` equal slices of the exponential distribution;
words are summed by source and bucket, and only the documents of the one bucket per source that the budget's end lies in
are put in order.

Edge cases: null or empty texts have size 0 and are taken 0 times; a very long text counts whole; a null source is a source (the last); a null id
is an id; equal keys are ordered by id and size; repeated rows are taken alike; an empty table gives an empty table; extra columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import sent

#: Longest plan, in sources, that is sent to every task; with more sources, rows meet the plan in a shuffle.
PLAN_ROWS = 100_000
#: A word, as a pattern.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def letter_quality(text: Column) -> Column:
    """Quality weight in [0.25, 1]: a quarter, and three quarters of the share of characters that are not ASCII
    digits, signs or white space."""
    kept = F.length(F.regexp_replace(text, r"[\x00-\x40\x5B-\x60\x7B-\x7F]+", ""))
    return F.coalesce(F.lit(0.25) + F.lit(0.75) * kept / F.when(F.length(text) > 0, F.length(text)), F.lit(0.25))


def labelled_quality(labels: DataFrame) -> DataFrame:
    """doc_id and the quality weight of the documents that ``labels`` (doc_id, quality 0 or 1) judge: 1 or a quarter; of several labels the
    largest counts."""
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("label"))
    return known.select("doc_id", F.when(F.col("label") > 0, 1.0).otherwise(0.25).alias("label")).checkpoint()


def sampling_key(doc_id: Column, quality: Column, seed: str) -> Column:
    """The exponential key: ``u`` is 52 bits of the digest of seed and id."""
    digest = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 13)
    return -F.log((F.conv(digest, 16, 10).cast("double") + 0.5) / F.lit(2.0**52)) / quality


def targets(sizes: DataFrame, weights: list[float], share: float, most: float) -> DataFrame:
    """Words per source: ``sizes`` has one row per source (source, source_size). Weights go round the sources in order of
    code points, null last. A target stops at ``most`` times the source's size and the excess is shared again by
    weight; the level at which that ends is found by one pass over the sources in order of cap over weight."""
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    s = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))), (place % len(weights) + 1).cast("int")))
    s = s.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    whole = Window.partitionBy()
    ordered = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, rest = ordered.rowsBetween(Window.unboundedPreceding, -1), ordered.rowsBetween(0, Window.unboundedFollowing)
    s = s.withColumn("level", (F.sum("source_size").over(whole) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
    s = s.withColumn("final", F.min(F.when(F.col("cap") / F.col("weight") > F.col("level"), F.struct(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source", "level"))).over(whole)["level"])
    return s.select("source", "source_size", F.least("cap", F.coalesce(F.col("final") * F.col("weight"), F.col("cap"))).alias("target"))


def _measured(docs: DataFrame, quality: Column | None, labels: DataFrame | None, seed: str, *kept: Column) -> DataFrame:
    weight = quality if quality is not None else letter_quality(F.col("text"))
    rows = docs.select(*kept, "doc_id", "source", word_count(F.col("text")).alias("size"), weight.alias("weight"))
    if labels is not None:
        rows = rows.join(sent(labels), "doc_id", "left").withColumn("weight", F.coalesce("label", "weight"))
    names = [c for c in rows.columns if c not in ("weight", "label")]
    return rows.select(*names, sampling_key(F.col("doc_id"), F.col("weight"), seed).alias("key"))


def _met(rows: DataFrame, plan: DataFrame, sources: int, *more: Column) -> DataFrame:
    """``rows`` as ``d`` with the row of their source in ``plan`` as ``b``, where ``more`` holds."""
    on = F.col("d.source").eqNullSafe(F.col("b.source"))
    for m in more:
        on = on & m
    return rows.alias("d").join((F.broadcast(plan) if sources <= PLAN_ROWS else plan).alias("b"), on)


def _plan(measured: DataFrame, weights: tuple[float, ...], share: float, most: float, buckets: int) -> DataFrame:
    """One row per source: source, source_size, target, epochs, and where the fractional epoch ends: all buckets before ``last``, and of ``last`` the
    documents up to ``cut`` (key, doc_id, size; null: none)."""
    d = measured.withColumn("bucket", _bucket(buckets))
    sums = d.groupBy("source", "bucket").agg(F.sum("size").alias("words")).checkpoint()
    budget = targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), list(weights), share, most)
    budget = budget.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int"))
    budget = budget.withColumn("left", F.greatest(F.col("target") - F.col("epochs") * F.col("source_size"), F.lit(0.0))).checkpoint()
    sources = budget.count()
    upto = Window.partitionBy("source").orderBy("bucket")
    ends = _met(sums.withColumn("end", F.sum("words").over(upto)), budget, sources)
    whole = F.col("end") <= F.col("left")
    ends = ends.groupBy(F.col("b.source").alias("source")).agg(F.min(F.when(~whole, F.col("bucket"))).alias("last"), F.max(F.when(whole, F.col("end"))).alias("done"))
    budget = budget.alias("b").join(ends.alias("e"), F.col("b.source").eqNullSafe(F.col("e.source")), "left")
    budget = budget.select("b.*", "last", (F.col("left") - F.coalesce("done", F.lit(0))).alias("open")).checkpoint()
    # only the documents of the bucket that the budget ends in are put in order; equal keys of equal documents stay together
    inner = _met(d, budget, sources, F.col("bucket") == F.col("last")).select("d.*", "open", "left")
    run = F.sum("size").over(Window.partitionBy("source").orderBy("key", "doc_id", "size"))
    place = F.struct("key", "doc_id", "size")
    inner = inner.withColumn("run", run).withColumn("taken", (F.col("run") - F.col("size") / 2 <= F.col("open")) & (F.col("left") > 0))
    inner = inner.groupBy("source").agg(F.max(F.when(F.col("taken"), place)).alias("cut"))
    both = budget.alias("b").join(inner.alias("i"), F.col("b.source").eqNullSafe(F.col("i.source")), "left")
    return both.select("b.source", "source_size", "target", "epochs", F.when(F.col("left") > 0, F.col("last")).alias("last"), "cut").checkpoint()


def _bucket(buckets: int) -> Column:
    return F.least(F.floor((1 - F.exp(-F.col("key"))) * buckets), F.lit(buckets - 1))


def _times(measured: DataFrame, plan: DataFrame, most: float, buckets: int) -> DataFrame:
    """``measured`` with source_size, target and times, how often the mix takes each document."""
    rows = _met(measured, plan, plan.count()).select("d.*", *(f"b.{c}" for c in plan.columns if c != "source"))
    inside = F.coalesce(F.struct("key", "doc_id", "size") <= F.col("cut"), F.lit(False))
    chosen = F.coalesce((_bucket(buckets) < F.col("last")) | ((_bucket(buckets) == F.col("last")) & inside), F.lit(False)) & (F.col("epochs") < most)
    times = F.when(F.col("size") > 0, F.col("epochs") + F.when(chosen, 1).otherwise(0)).otherwise(0).cast("int")
    return rows.withColumn("times", times).drop("epochs", "last", "cut", "key")


def mix(docs: DataFrame, *, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, quality: Column | None = None, labels: DataFrame | None = None, buckets: int = 4096, seed: str = "mix") -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target and times (how often the mix takes the document whole). Texts are read once."""
    judged = None if labels is None else labelled_quality(labels)
    measured = _measured(docs, quality, judged, seed).checkpoint()
    return _times(measured, _plan(measured, weights, share, most, buckets), most, buckets)


def take(docs: DataFrame, *, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, quality: Column | None = None, labels: DataFrame | None = None, buckets: int = 4096, seed: str = "mix") -> DataFrame:
    """The mix itself: every document as many times as it is taken, with the columns of ``docs``. Texts are read twice and, up to ``PLAN_ROWS`` sources, never shuffled."""
    judged = None if labels is None else labelled_quality(labels)
    plan = _plan(_measured(docs, quality, judged, seed).checkpoint(), weights, share, most, buckets)
    mixed = _times(_measured(docs, quality, judged, seed, F.struct(*docs.columns).alias("kept")), plan, most, buckets).where("times > 0")
    copies = mixed.select("kept", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return copies.select("kept.*")
