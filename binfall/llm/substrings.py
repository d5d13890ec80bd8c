"""Removal of repeated passages by relative Lempel-Ziv factors.

A passage repeats when its ``window`` (50) consecutive words also start in a document of smaller id. Every document serves
as reference for those of larger id. Each window is indexed under its anchor, the least hash among the ``gram``-word runs in
it: equal windows have equal anchors, so a document is cut, by its content alone, in reference blocks, the stretches whose windows
share one anchor. The parse of a document looks up all its blocks:

1. A block whose anchor is found in no other document cannot be copied: its words are literals.
2. A block whose anchor always stands in one and the same block is copied whole, from the least document that has it.
3. Where blocks under one anchor differ, a factor begins or ends inside the block: its boundaries are checked window by window
   (128-bit hashes), each against the least document with that window.

References carry the place in the source, too. The parse is then greedy from left to right: a factor is begun at the first copied window and grown
word by word while the next window is a copy from the same document and the next place in it; where that ends, the next factor begins. So the words of a
factor stand in its source one after another, ``window`` words at least; the words of all factors go. Where a source has a block or window
several times, one of its places is taken. ``details`` gives the factors themselves.

Blocks are spread by hash. The references of anchors and windows are summed before their shuffle and written down, so where very many
occurrences meet one of them, Spark can split the occurrences.

Edge cases: null and empty texts have no words; a very long text is parsed like others, its words are held by one task; a null doc_id neither
removes nor loses words; documents of one id never remove each other's words; repeated rows give repeated, equal results; an empty
table gives an empty table; columns of the input other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .components import release

#: Words of an anchor run.
GRAM = 25


def least(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the (leftmost) least of every ``width`` consecutive values, by doubling."""
    at, best, done = np.arange(len(values)), values, 1
    while done < width:
        step = min(done, width - done)
        right = best[step:] < best[:-step]
        at = np.where(right, at[step:], at[:-step])
        best = np.where(right, best[step:], best[:-step])
        done += step
    return at


def blocks(w: tx.Words, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Reference blocks: row, position (among all words of the slice) of the first and last window, anchor, content."""
    n = len(w.hash)
    none = np.zeros(0, np.int64)
    if n < window:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    begin = np.arange(n - gram + 1)
    grams = tx.runs(w.hash, begin, begin + gram)
    at = least(grams, window - gram + 1)
    whole = w.row[: n - window + 1] == w.row[window - 1 :]
    start = whole.copy()
    start[1:] &= ~whole[:-1] | (at[1:] != at[:-1]) | (w.row[1 : len(at)] != w.row[: len(at) - 1])
    first = np.flatnonzero(start)
    stop = np.r_[start[1:], True] | ~np.r_[whole[1:], False]
    last = np.flatnonzero(stop & whole)
    return w.row[first], first, last, grams[at[first]], tx.runs(w.hash, first, last + window)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _batch(names: list[str], columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c) for c in columns], names=names)


def _segments(frame: DataFrame, window: int, gram: int) -> DataFrame:
    """All reference blocks: doc_id, tkey, first, last (window positions in the document), anchor, content."""
    names = ["doc_id", "tkey", "first", "last", "anchor", "content"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, _, data, bounds in tx.slices(batch.column(2)):
                w = tx.words(data, bounds)
                row, first, last, anchor, content = blocks(w, window, gram)
                base = np.searchsorted(w.row, np.arange(w.rows))[row] if len(row) else row
                take = pa.array(row + a)
                yield _batch(names, [batch.column(0).take(take), batch.column(1).take(take), (first - base).astype(np.int32), (last - base).astype(np.int32), _signed(anchor), _signed(content)])

    return frame.mapInArrow(run, "doc_id long, tkey long, first int, last int, anchor long, content long")


def _windows(frame: DataFrame, window: int) -> DataFrame:
    """Both hashes of every window of the stretches in ``look``: doc_id, tkey, at, h1, h2."""
    names = ["doc_id", "tkey", "at", "h1", "h2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            look = batch.column(3)
            for a, b, data, bounds in tx.slices(batch.column(2)):
                w = tx.words(data, bounds)
                base = np.searchsorted(w.row, np.arange(w.rows))
                part = look.slice(a, b - a)
                sizes = pa.compute.list_value_length(part).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                flat = part.flatten()
                lo, hi = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
                row = np.repeat(np.arange(b - a), sizes)
                count = hi - lo + 1
                row, lo = np.repeat(row, count), np.repeat(lo - np.r_[0, np.cumsum(count)[:-1]] if len(count) else lo, count)
                at = lo + np.arange(len(lo))
                start = at + base[row] if len(row) else at
                take = pa.array(row + a)
                yield _batch(names, [batch.column(0).take(take), batch.column(1).take(take), at.astype(np.int32), _signed(tx.runs(w.hash, start, start + window)), _signed(tx.runs(w.hash, start, start + window, second=True))])

    return frame.mapInArrow(run, "doc_id long, tkey long, at int, h1 long, h2 long")


def factors(blocks: np.ndarray, windows: np.ndarray, window: int, n: int) -> list[tuple[int, int, int, int]]:
    """The greedy parse of ``n`` words: (first word, words, source, place in the source) of every factor, from copied blocks (first and last window, source,
    place of the first) and copied windows (own place, source, its place). A factor grows while both places go on together in one source."""
    source, ahead = np.full(max(n - window + 1, 0), -1, np.int64), np.zeros(max(n - window + 1, 0), np.int64)
    copied = np.zeros(len(source), bool)
    for first, last, s, place in np.asarray(blocks, np.int64).reshape(-1, 4).tolist():
        source[first : last + 1], ahead[first : last + 1], copied[first : last + 1] = s, place - first, True
    at, s, place = np.asarray(windows, np.int64).reshape(-1, 3).T
    source[at], ahead[at], copied[at] = s, place - at, True
    begins = copied.copy()
    begins[1:] &= ~copied[:-1] | (source[1:] != source[:-1]) | (ahead[1:] != ahead[:-1])
    first = np.flatnonzero(begins)
    ends = copied.copy()
    ends[:-1] &= ~copied[1:] | begins[1:]
    last = np.flatnonzero(ends)
    return [(a, b - a + window, s, a + d) for a, b, s, d in zip(first.tolist(), last.tolist(), source[first].tolist(), ahead[first].tolist(), strict=True)]


def _kept(found: list[tuple[int, int, int, int]], n: int) -> np.ndarray:
    """Which of ``n`` words stay when the factors go."""
    edge = np.zeros(n + 1, np.int64)
    for first, words, *_ in found:
        edge[first] += 1
        edge[first + words] -= 1
    return np.cumsum(edge[:n]) == 0


def _rows_of(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """The entries of a column of lists of structs as the rows of a matrix, and where each list's begin: numbers, never an object for each."""
    flat = lists.flatten()
    entries = np.stack([flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(flat.type.num_fields)], axis=1)
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return entries, np.r_[0, np.cumsum(sizes)]


def _results(frame: DataFrame, window: int, carried: list[str], details: bool) -> DataFrame:
    """``carried`` columns, then n_words, n_removed, kept text's digest, and with ``details`` the kept text, if words went, and the factors, from
    (carried..., text, cut, hits)."""
    k = len(carried)
    schema = [f.simpleString().replace(":", " ", 1) for f in frame.select(*carried).schema.fields] + ["n_words long", "n_removed long", "kept_sha256 string"]
    names = [*carried, "n_words", "n_removed", "kept_sha256"]
    kind = pa.list_(pa.struct([("first", pa.int32()), ("words", pa.int32()), ("source", pa.int64()), ("place", pa.int32())]))
    if details:
        schema += ["kept_text string", "factors array<struct<first:int,words:int,source:long,place:int>>"]
        names += ["kept_text", "factors"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, gone, digests, texts, parses = [], [], [], [], []
            (cuts, c), (hits, h) = (_rows_of(batch.column(k + i)) for i in (1, 2))
            for at in range(len(batch)):
                raw = batch.column(k)[at].as_py()
                words = raw.split() if raw else []
                blocks, windows = cuts[c[at] : c[at + 1]], hits[h[at] : h[at + 1]]
                found = factors(blocks, windows, window, len(words)) if len(blocks) or len(windows) else []
                stay = words
                if found:
                    mask = _kept(found, len(words))
                    stay = [words[i] for i in np.flatnonzero(mask).tolist()]
                kept = b" ".join(stay)
                total.append(len(words))
                gone.append(len(words) - len(stay))
                digests.append(hashlib.sha256(kept).hexdigest())
                if details:
                    texts.append(kept if found else None)
                    parses.append([{"first": a, "words": b, "source": c, "place": d} for a, b, c, d in found])
            made = [pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(digests, pa.string())]
            if details:
                made += [pa.array(texts, pa.binary()).cast(pa.string()), pa.array(parses, kind)]
            yield _batch(names, [*batch.columns[:k], *made])

    return frame.mapInArrow(run, ", ".join(schema))


def removals(docs: DataFrame, *, window: int = 50, gram: int = GRAM, details: bool = True) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256, and with ``details`` kept_text where words were removed (else null) and the
    factors (first word, words, the least document that has them and the place of the first in it)."""
    spark = docs.sparkSession
    frame = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("tkey"), "text")
    segments = _segments(frame.where("doc_id is not null"), window, gram)
    seen = segments.groupBy("anchor").agg(F.min("doc_id").alias("source"), F.min_by("first", "doc_id").alias("place"), F.max("doc_id").alias("most"), F.min("content").alias("c1"), F.max("content").alias("c2"))
    shared = seen.where("source < most").select("anchor", "source", "place", (F.col("c1") == F.col("c2")).alias("same")).checkpoint()
    release(spark)
    touched = segments.drop("content").join(shared, "anchor").where("not same or doc_id > source")
    lists = touched.groupBy("doc_id", "tkey").agg(
        F.collect_set(F.when(F.col("same"), F.struct("first", "last", "source", "place"))).alias("cut"),
        F.collect_set(F.when(~F.col("same"), F.struct("first", "last"))).alias("look"),
    )
    lists = lists.checkpoint()
    release(spark)
    affected = frame.join(lists, ["doc_id", "tkey"]).select("doc_id", "tkey", F.col("text").cast("binary").alias("text"), "cut", "look").checkpoint()
    release(spark)
    opened = affected.where(F.size("look") > 0).select("doc_id", "tkey", F.col("text").cast("string").alias("text"), "look").dropDuplicates(["doc_id", "tkey"])
    windows = _windows(opened, window)
    first = windows.groupBy("h1", "h2").agg(F.min("doc_id").alias("source"), F.min_by("at", "doc_id").alias("place"), F.max("doc_id").alias("most")).where("source < most").drop("most").checkpoint()
    release(spark)
    hits = windows.join(first, ["h1", "h2"]).where("doc_id > source").groupBy("doc_id", "tkey").agg(F.collect_list(F.struct("at", "source", "place")).alias("hits"))
    cut = affected.drop("look").join(hits, ["doc_id", "tkey"], "left").select("doc_id", "text", "cut", "hits")
    kinds = dict(cut.dtypes)
    rest = frame.select("doc_id", "tkey", F.col("text").cast("binary").alias("text"), *(F.lit(None).cast(kinds[c]).alias(c) for c in ("cut", "hits")))
    whole = _results(rest, window, ["doc_id", "tkey"], details).join(affected.select("doc_id", "tkey").distinct(), ["doc_id", "tkey"], "left_anti")
    return _results(cut, window, ["doc_id"], details).unionByName(whole.drop("tkey"))
