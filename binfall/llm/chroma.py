"""Recordings that sound alike: chroma fingerprints, aligned by counts of offsets and by bit errors.

A recording becomes frames of twelve pitch classes (short-time spectra folded over the octaves). Sixteen rectangle filters,
evaluated on the integral image of the frames, are quantised to two bits each, Gray-coded, and packed in one 32-bit integer per
frame: the fingerprint. A landmark is a pair of codes 16 frames apart, as single codes recur in unlike recordings; of every eight consecutive pairs
the one of least hash counts. Short recordings have single codes for landmarks.

Two recordings are linked if a quarter of the distinct landmarks of the one with more of them are landmarks of the other too, and if they align:
the offsets at which landmarks agree are counted, and with each of the top offsets the codes that lie on each other are compared
bit by bit; a code is matched if some top offset leaves few bit errors, and enough of the longer recording must be matched.

Recordings with equal fingerprints are one class. Between classes, candidates share a landmark among the first three quarters of their own, in an
order common to all, the rarest first: linked recordings always do, so no link is missed. Candidates are worked off
in rounds of hubs and a last round of the pairs whose ends are still in different components (``jaccard.link_in_rounds``).

Sound is rendered, framed and compared in blocks, so memory follows the fingerprint's length, a few bytes a frame. Landmarks of one code,
as of long silence, are counted by a Fourier transform where their pairs would be many.

Edge cases: null, empty and very short recordings have no codes and are linked with nothing; silence is a recording like others;
repeated rows and rows that share an id are one node; an empty table gives an empty table; extra columns are ignored; a null id takes no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import text as tx
from .components import components
from .jaccard import link_in_rounds
from .substrings import least

def filter_bank() -> list[tuple[int, int, int, int]]:
    """Sixteen filters (kind, first pitch class, pitch classes, frames): every kind in four sizes, from spread places. Kinds: 0 whole area, 1 upper
    against lower half, 2 earlier against later half, 3 the two diagonals of quarters."""
    return [(i % 4, 5 * i % 8, 4 + i // 4, 16 - 4 * (i // 4)) for i in range(16)]


FILTERS = filter_bank()
THRESHOLDS = (-0.12, 0.0, 0.12)
SPAN = 16
#: Offsets tried, bit errors that a matched code may have, and hundredths of the longer recording that must be matched.
TOP_OFFSETS, MAX_ERRORS, COVERAGE = 4, 4, 75
#: Consecutive pairs that have a landmark, and hundredths of the landmarks of the one with more that linked recordings have in common.
LANDMARK_RUN, SHARE = 8, 25
#: Recordings of less codes have no pairs.
SHORT = SPAN + LANDMARK_RUN
#: Spectra computed together; pairs of equal landmarks held together; pairs of one code from which on they are counted by transform.
BLOCK, HITS, MANY = 4096, 1 << 22, 1 << 20


def frames(samples: np.ndarray, rate: int, size: int = 256, hop: int = 128, lowest: float = 80.0, highest: float = 4000.0, unit: float = 1.0) -> np.ndarray:
    """Pitch-class frames of a mono signal (in steps of ``unit``): power of the spectrum's bins, folded over octaves, each frame scaled to sum 1."""
    if len(samples) < size:
        return np.zeros((0, 12))
    pitch = np.fft.rfftfreq(size, 1 / rate)
    good = (pitch >= lowest) & (pitch <= highest)
    fold = np.zeros((len(pitch), 12))
    # a bin between two pitch classes counts for both
    place = 12 * np.log2(np.maximum(pitch, 1) / 261.6256) % 12
    low = np.floor(place).astype(int)
    fold[np.arange(len(pitch)), low % 12] = good * (1 - (place - low))
    fold[np.arange(len(pitch)), (low + 1) % 12] += good * (place - low)
    count = 1 + (len(samples) - size) // hop
    out = np.empty((count, 12))
    shape = np.hanning(size).astype(np.float32)
    for at in range(0, count, BLOCK):
        end = min(at + BLOCK, count)
        part = np.asarray(samples[at * hop : (end - 1) * hop + size], np.float32) * np.float32(unit)
        out[at:end] = np.abs(np.fft.rfft(np.lib.stride_tricks.sliding_window_view(part, size)[::hop] * shape, axis=1)) ** 2 @ fold
    total = out.sum(1, keepdims=True)
    return np.where(total > 1e-9, out / np.maximum(total, 1e-9), 1 / 12)


def fingerprint(chroma: np.ndarray) -> np.ndarray:
    """One packed 32-bit code per run of ``SPAN`` frames."""
    n = len(chroma) - SPAN + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    image = np.zeros((len(chroma) + 1, 13))
    image[1:, 1:] = chroma.cumsum(0).cumsum(1)
    # differences of nearby prefix sums cancel the long ones; rounding keeps equal windows equal wherever they stand
    def area(t0: int, t1: int, c0: int, c1: int) -> np.ndarray:
        a, b = image[t0 : t0 + n], image[t1 : t1 + n]
        return np.round(b[:, c1] - a[:, c1] - b[:, c0] + a[:, c0], 6)

    code = np.zeros(n, np.uint32)
    for kind, first, height, width in FILTERS:
        c0, c1, cm, tm = first, min(first + height, 12), min(first + height // 2, 11), width // 2
        if kind == 0:
            value = area(0, width, c0, c1) / width - (c1 - c0) / 12
        elif kind == 1:
            value = (area(0, width, cm, c1) - area(0, width, c0, cm)) / width
        elif kind == 2:
            value = (area(tm, width, c0, c1) - area(0, tm, c0, c1)) / width
        else:
            value = (area(0, tm, cm, c1) + area(tm, width, c0, cm) - area(0, tm, c0, cm) - area(tm, width, cm, c1)) / width
        level = np.searchsorted(THRESHOLDS, value)
        code = (code << np.uint32(2)) | np.array([0, 1, 3, 2], np.uint32)[level]
    return code


def landmarks(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places and keys of the landmarks, and which are pairs: single codes of less than ``SHORT`` codes, chosen pairs from then on, both where a recording may be
    linked with shorter ones that have single codes only. Of keys repeated in a row, every eighth counts."""
    n, single = len(codes), tx.mix(codes.astype(np.uint64))
    places, keys = [], []
    if n * COVERAGE < 100 * SHORT:
        places.append(_thinned(single, np.arange(n)))
        keys.append(single[places[-1]])
    if n >= SHORT:
        pair = tx.mix(single[:-SPAN] * np.uint64(0x9FB21C651E98DF25) + single[SPAN:])
        places.append(_thinned(pair, np.unique(least(pair, LANDMARK_RUN))))
        keys.append(pair[places[-1]])
    paired = [np.full(len(p), n >= SHORT and i == len(places) - 1) for i, p in enumerate(places)]
    return np.concatenate(places), np.concatenate(keys), np.concatenate(paired)


def distinct_landmarks(codes: np.ndarray) -> list[np.ndarray]:
    """Distinct keys of the single landmarks, and of the pairs."""
    _, keys, paired = landmarks(codes)
    return [np.unique(keys[~paired]), np.unique(keys[paired])]


def _thinned(keys: np.ndarray, at: np.ndarray) -> np.ndarray:
    fresh = np.ones(len(keys), bool)
    fresh[1:] = keys[1:] != keys[:-1]
    place = np.arange(len(keys))
    run = place - np.maximum.accumulate(np.where(fresh, place, 0)) if len(keys) else place
    return at[run[at] % LANDMARK_RUN == 0]


def offsets(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How often landmarks of ``a`` and ``b`` agree at each offset (place in a less place in b), from offset ``-len(b)`` on."""
    counts = np.zeros(len(a) + len(b) + 1, np.int64)
    (at, key, _), (other, its, _) = landmarks(a), landmarks(b)
    order = np.argsort(its, kind="stable")
    other, its = other[order], its[order]
    lo, hi = np.searchsorted(its, key, "left"), np.searchsorted(its, key, "right")
    shared, n = np.unique(key[hi > lo], return_counts=True)
    first, last = np.searchsorted(its, shared, "left"), np.searchsorted(its, shared, "right")
    many = shared[n * (last - first) > MANY]
    few = (hi > lo) & ~np.isin(key, many)
    for k in many:
        size = 1 << int(np.ceil(np.log2(len(counts))))
        x, y = np.zeros(size), np.zeros(size)
        x[at[key == k]] = 1
        y[len(b) - other[its == k]] = 1
        counts += np.rint(np.fft.irfft(np.fft.rfft(x) * np.fft.rfft(y), size)[: len(counts)]).astype(np.int64)
    at, lo, hits = at[few], lo[few], (hi - lo)[few]
    ends = np.cumsum(hits)
    start = 0
    while start < len(at):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + HITS, "right")))
        h = hits[start:stop]
        place = np.arange(h.sum()) - np.repeat(np.cumsum(h) - h, h) + np.repeat(lo[start:stop], h)
        counts += np.bincount(np.repeat(at[start:stop], h) - other[place] + len(b), minlength=len(counts))
        start = stop
    return counts


def alignment(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """Best offset (place in ``a`` less place in ``b``), matched codes of the longer one, and its length."""
    if len(a) < len(b):
        offset, matched, length = alignment(b, a)
        return -offset, matched, length
    counts = offsets(a, b)
    found = np.flatnonzero(counts)
    if not len(found):
        return 0, 0, len(a)
    top = found[np.lexsort((found, -counts[found]))][:TOP_OFFSETS] - len(b)
    matched = np.zeros(len(a), bool)
    for o in top.tolist():
        x0, x1 = max(0, o), min(len(a), len(b) + o)
        errors = np.bitwise_count(a[x0:x1] ^ b[x0 - o : x1 - o])
        matched[x0:x1] |= errors <= MAX_ERRORS
    return int(top[0]), int(matched.sum()), len(a)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    # by pairs, if both have pairs
    x, y = (distinct_landmarks(c)[min(len(a), len(b)) >= SHORT] for c in (a, b))
    if not len(x) or not len(y) or 100 * len(np.intersect1d(x, y, assume_unique=True)) < SHARE * max(len(x), len(y)):
        return False
    _, matched, length = alignment(a, b)
    return 100 * matched >= COVERAGE * length


def fingerprints(recordings: DataFrame, *, id_column: str = "media_id", column: str = "pcm", rate: int = 4000) -> DataFrame:
    """media_id, codes (array of integers) and k1, from 16-bit little-endian mono samples (binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = []
            for x in batch.column(1):
                raw = x.as_py() or b""
                codes.append(fingerprint(frames(np.frombuffer(raw[: len(raw) // 2 * 2], "<i2"), rate, unit=1 / 32768)))
            k1 = [int(tx.runs(c.astype(np.uint64), np.zeros(1, np.int64), np.array([len(c)]))[0].view(np.int64)) if len(c) else 0 for c in codes]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([c.view(np.int32) for c in codes], pa.list_(pa.int32())), pa.array(k1, pa.int64())],
                names=["media_id", "codes", "k1"],
            )

    frame = recordings.select(F.col(id_column).cast("long").alias("media_id"), F.col(column).alias("pcm"))
    return frame.mapInArrow(run, "media_id long, codes array<int>, k1 long")


def _aligned(pairs: DataFrame) -> DataFrame:
    """The linked ones among pairs (a, b, x, y) with both code arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [linked(*(np.asarray(v.values.to_numpy(zero_copy_only=False)).view(np.uint32) for v in pair)) for pair in zip(batch.column(2), batch.column(3), strict=True)]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return pairs.mapInArrow(run, "a long, b long")


def _marks(classes: DataFrame) -> DataFrame:
    """(key, d, k1, n, kind, marks): the distinct landmarks of each class, and how many it has of their kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = [np.zeros(0, np.uint64)]
            for x in batch.column(3):
                each += distinct_landmarks(np.asarray(x.values.to_numpy(zero_copy_only=False)).view(np.uint32))
            sizes = np.array([len(x) for x in each[1:]], np.int64)
            take = pa.array(np.repeat(np.arange(len(sizes)) // 2, sizes))
            kind = np.repeat(np.arange(len(sizes)) % 2, sizes)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(each).view(np.int64)), *(batch.column(i).take(take) for i in range(3)), pa.array(kind), pa.array(np.repeat(sizes, sizes))], names=["key", "d", "k1", "n", "kind", "marks"])

    return classes.select("d", "k1", "n", "codes").mapInArrow(run, "key long, d long, k1 long, n long, kind long, marks long")


def _lists(classes: DataFrame) -> DataFrame:
    """(key, d, k1, n): the rarest landmarks of each kind of each class, as many as linked recordings must share one of, without those of one class
    only."""
    entries = _marks(classes)
    members = entries.groupBy("key").agg(F.count("*").alias("members")).where("members > 1").checkpoint()
    by_class = Window.partitionBy("d", "k1", "kind")
    # those of one class only come first in its order; after them, these
    rank = F.row_number().over(by_class.orderBy("members", "key")) + F.col("marks") - F.count("*").over(by_class)
    needed = F.ceil(F.col("marks") * SHARE / 100)
    return entries.join(members, "key").withColumn("rank", rank).where(F.col("rank") <= F.col("marks") - needed + 1).select("key", "d", "k1", "n")


def alike(recordings: DataFrame, **options) -> DataFrame:
    """One row per recording: media_id, n_codes, class_id (least id of equal fingerprints) and component_id."""
    found = fingerprints(recordings, **options).checkpoint()
    n = F.size("codes").cast("long")
    classes = found.where("size(codes) > 0 and media_id is not null").groupBy("k1", n.alias("n")).agg(F.min("media_id").alias("d"), F.min_by("codes", "media_id").alias("codes"))
    lists = _lists(classes).checkpoint()
    known = found.where("size(codes) > 0").select("media_id", "k1", "codes").dropDuplicates(["media_id", "k1"])

    def verified(pairs: DataFrame) -> DataFrame:
        left = pairs.join(known.select(F.col("media_id").alias("a"), F.col("k1").alias("ak"), F.col("codes").alias("x")), ["a", "ak"])
        both = left.join(known.select(F.col("media_id").alias("b"), F.col("k1").alias("bk"), F.col("codes").alias("y")), ["b", "bk"])
        return _aligned(both.select("a", "b", "x", "y")).checkpoint()

    # a shorter recording matches its own length at each offset at most
    links = link_in_rounds(lists, COVERAGE // TOP_OFFSETS, lambda pairs: pairs, verified)
    rows = found.select("media_id", n.alias("n_codes"), "k1")
    copied = rows.where("n_codes > 0 and media_id is not null").groupBy("n_codes", "k1").agg(F.min("media_id").alias("class"), F.max("media_id").alias("most")).where("class < most").drop("most").checkpoint()
    named = rows.join(copied, ["n_codes", "k1"], "left").select("media_id", "n_codes", F.coalesce("class", "media_id").alias("class_id"))
    same = named.where("media_id <> class_id").select(F.col("media_id").alias("a"), F.col("class_id").alias("b"))
    joined = components(links.unionByName(same)).withColumnRenamed("node", "media_id")
    return named.join(joined, "media_id", "left").select("media_id", "n_codes", "class_id", F.coalesce("component", "media_id").alias("component_id"))


def render(text: str, rate: int = 2000, samples: int = 128) -> bytes:
    """A text as sound: each word is a chord of two notes that its bytes choose."""
    words = (text or "").encode().split()
    if not words:
        return b""
    data = b" ".join(words)
    w = tx.words(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    low, high = (w.hash % np.uint64(12)).astype(int), (w.hash // np.uint64(12) % np.uint64(12)).astype(int)
    parts = []
    for at in range(0, len(words), BLOCK // 2):
        x, y = low[at : at + BLOCK // 2], high[at : at + BLOCK // 2]
        t = np.arange(at * samples, (at + len(x)) * samples) / rate
        sound = np.sin(2 * np.pi * np.repeat(261.6256 * 2 ** (x / 12), samples) * t) + np.sin(2 * np.pi * np.repeat(523.2511 * 2 ** (y / 12), samples) * t)
        parts.append((sound * 16000).astype("<i2").tobytes())
    return b"".join(parts)


def rendered(texts: DataFrame, id_column: str, column: str) -> DataFrame:
    """media_id and pcm: every text of ``column`` as a recording. Recordings go on as they are made, some megabytes together."""

    def made(ids: list, sounds: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sounds, pa.binary())], names=["media_id", "pcm"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sounds, held = [], [], 0
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids.append(i)
                sounds.append(render(x.as_py()))
                held += len(sounds[-1])
                if held > HITS:
                    yield made(ids, sounds)
                    ids, sounds, held = [], [], 0
            yield made(ids, sounds)

    return texts.select(F.col(id_column).cast("long"), column).mapInArrow(run, "media_id long, pcm binary")
