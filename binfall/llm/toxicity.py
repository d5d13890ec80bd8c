"""Toxicity scores by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct hashes, in ``2 ** bits`` places, of its lower-cased words, pairs of neighbours and pairs
with one word between. Learning visits a bounded sample of labelled documents (``sample`` rows, drawn by a hash of the
id) in a fixed order. Tasks turn them into coordinates, and one task, which gets these alone, learns; every coordinate has its own rate, and L1 keeps all but telling coordinates at zero, so the
weights are few and small enough to broadcast: at most ``2 ** bits`` pairs of index and weight.

Edge cases: null and empty texts have no features and get the intercept's score; a very long text counts whole; labels that are null
are not learnt from; of several labels of one document the largest counts, of several texts of one id the least is learnt from; a null id is
never learnt from, but scored; without labelled rows every score is 0; repeated rows are scored alike; an empty table gives an
empty table; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text as tx


@dataclass(frozen=True)
class Settings:
    bits: int = 20
    sample: int = 32_000
    epochs: int = 2
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 4.0
    l2: float = 0.0


@dataclass(frozen=True)
class Model:
    bits: int
    intercept: float
    index: np.ndarray
    weight: np.ndarray


def held_out(doc_id: Column) -> Column:
    """The rows that are never learnt from: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def features(data: np.ndarray, bounds: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and coordinate of every feature of a slice, repeats included."""
    w = tx.words(data, bounds, lower=True, separators=tx.SIGNS)
    rows, found = [w.row], [w.hash]
    for gap, salt in ((1, 0x9FB21C651E98DF25), (2, 0xC2B2AE3D27D4EB4F)):
        if len(w.hash) > gap:
            same = w.row[:-gap] == w.row[gap:]
            rows.append(w.row[:-gap][same])
            found.append(tx.mix(w.hash[:-gap] * np.uint64(salt) + w.hash[gap:])[same])
    return np.concatenate(rows), (np.concatenate(found) >> np.uint64(64 - bits)).astype(np.int64)


class Ftrl:
    """FTRL-proximal with a rate for each coordinate; place ``2 ** bits`` is the intercept, which L1 leaves alone."""

    def __init__(self, s: Settings):
        self.s, self.size = s, 1 << s.bits
        self.z, self.n = np.zeros(self.size + 1), np.zeros(self.size + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, s = self.z[at], self.s
        l1 = np.where(at == self.size, 0.0, s.l1)
        shrunk = np.sign(z) * np.maximum(np.abs(z) - l1, 0)
        return -shrunk / ((s.beta + np.sqrt(self.n[at])) / s.alpha + s.l2)

    def learn(self, at: np.ndarray, label: float) -> None:
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        n = self.n[at]
        grown = n + g * g
        self.z[at] += g - (np.sqrt(grown) - np.sqrt(n)) / self.s.alpha * w
        self.n[at] = grown


def fit_arrays(examples: list[tuple[bytes | pa.Buffer, float]], s: Settings) -> Model:
    """``examples``: packed coordinates and label, in the order to visit them."""
    ftrl = Ftrl(s)
    for _ in range(s.epochs):
        for at, y in examples:
            ftrl.learn(np.append(unpacked(at), ftrl.size), y)
    w = ftrl.weights(np.arange(ftrl.size + 1))
    index = np.flatnonzero(w[:-1])
    return Model(s.bits, float(w[-1]), index, w[index])


def packed(places: np.ndarray) -> bytes:
    """Ascending numbers as 16-bit differences; a difference of 65535 or more is led by as many 65535 as fit in it."""
    step = np.diff(places, prepend=0)
    full = step // 65535
    out = np.full(len(step) + int(full.sum()), 65535, "<u2")
    out[np.cumsum(full + 1) - 1] = step % 65535
    return out.tobytes()


def unpacked(data: bytes | pa.Buffer) -> np.ndarray:
    x = np.frombuffer(data, "<u2").astype(np.int64)
    return np.cumsum(x)[x < 65535]


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model | None:
    """Learn from labelled documents that are not held out; None if there are none."""
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("double").alias("y")).where(~held_out(F.col("doc_id")))
    share = settings.sample / max(1, known.count())
    drawn = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1_000_000)) < int(1_000_000 * min(1.0, share))
    rows = docs.where(~held_out(F.col("doc_id")) & drawn).select("doc_id", "text").join(known.where(drawn), "doc_id")
    rows = rows.groupBy("doc_id", "y").agg(F.min("text").alias("text")).select(F.col("doc_id").cast("string").alias("doc_id"), "text", "y", F.xxhash64("doc_id", F.lit("order")).alias("o"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[bytes] = []
            for a, b, data, bounds in tx.slices(batch.column(1)):
                row, at = features(data, bounds, settings.bits)
                order = np.argsort(row, kind="stable")
                found += [packed(np.unique(p)) for p in np.split(at[order], np.searchsorted(row[order], np.arange(1, b - a)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(found, pa.binary())], names=["doc_id", "y", "o", "places"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # views of the batches, which stay as they came
        examples = [(x.as_buffer(), y) for batch in batches for x, y in zip(batch.column(3), batch.column(1).to_pylist(), strict=True)]
        if examples:
            m = fit_arrays(examples, settings)
            yield pa.RecordBatch.from_arrays([pa.array([m.intercept]), pa.array([m.index.tolist()], pa.list_(pa.int64())), pa.array([m.weight.tolist()], pa.list_(pa.float64()))], names=["intercept", "places", "weights"])

    # the bounded sample is learnt from in one task, in one order
    examples = rows.mapInArrow(hashed, "doc_id string, y double, o long, places binary").repartition(1).sortWithinPartitions("o", "doc_id")
    found = examples.mapInArrow(run, "intercept double, places array<long>, weights array<double>").collect()
    if not found:
        return None
    return Model(settings.bits, found[0].intercept, np.array(found[0].places, np.int64), np.array(found[0].weights))


def score_column(column: pa.Array, model: Model | None) -> np.ndarray:
    if model is None:
        return np.zeros(len(column))
    dense = np.zeros(1 << model.bits)
    dense[model.index] = model.weight
    out = np.full(len(column), model.intercept)
    for a, b, data, bounds in tx.slices(column):
        row, at = features(data, bounds, model.bits)
        telling = np.flatnonzero(dense[at])
        pairs = np.unique(row[telling] * (1 << model.bits) + at[telling])
        out[a:b] += np.bincount(pairs >> model.bits, dense[pairs & ((1 << model.bits) - 1)], minlength=b - a)
    return 1 / (1 + np.exp(-np.clip(out, -35, 35)))


def score(docs: DataFrame, model: Model | None, *, threshold: float = 0.3, whole: bool = False) -> DataFrame:
    """doc_id, or with ``whole`` the struct ``row`` of all columns, then score and predicted (1 if score >= threshold)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    frame = docs.select(F.struct(*(docs.columns if whole else ["doc_id", "text"])).alias("row"))
    kept = frame.schema["row"] if whole else T.StructField("doc_id", docs.schema["doc_id"].dataType)
    schema = T.StructType([kept, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(0)
            scores = score_column(pc.struct_field(rows, "text"), shared.value)
            yield pa.RecordBatch.from_arrays([rows if whole else pc.struct_field(rows, "doc_id"), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], names=schema.names)

    return frame.mapInArrow(run, schema)
