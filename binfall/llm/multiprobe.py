"""Approximate nearest neighbours by inner product: p-stable hashing with multiprobe queries.

Inner products become distances by one more dimension: with M the largest length, a candidate x is (x, sqrt(M^2 - |x|^2)) / M and a query q is (q, 0) / |q|, so the
nearest is the one of largest inner product. In each of ``TABLES`` tables ``HASHES`` functions floor((a . v + b) / w) with Gaussian a give a bucket's code.
A query visits the buckets around its own in the order of their estimated success: moving across a function's nearer border costs the squared distance to it, and sets of
moves are visited by rising sum of squares. Buckets are dealt to shards, and a query goes once to each shard that holds buckets it visits. What a shard finds is
ranked by the inner product of the original vectors in double precision, and the answers of all shards and tables are merged.

Fitted on ``AUDIT`` queries, picked by hash and asked against all rows, in blocks: the width w, from the distance of the true neighbours, and the number of
buckets a query visits, the least with which the audited queries find ``RECALL`` of their neighbours. If ``MOST`` buckets a table are not
enough, queries visit all of them, which is exact. All rows are indexed, and no bucket is capped: one that holds more than ``SHARD`` rows lies in several
shards, each asked. Equal vectors are one candidate, with the ``k`` + 1 least ids, as no other can be among a query's ``k`` nearest.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components, or have no id, take no part; nor are vectors of different lengths compared;
of repeated rows of one id the least vector counts; ties go to the smaller id; queries with fewer than ``k`` candidates get all; an empty
table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import text as tx

TABLES, HASHES, AUDIT, RECALL, MOST = 2, 8, 256, 0.96, 2048
#: Rows that a shard holds about, queries that are asked together, pairs kept before the best of a batch are picked.
SHARD, BATCH, PAIRS = 25_000, 1024, 400_000
#: The width of a slot in distances of a true neighbour.
WIDTH = 1.9


def _moves(m: int, most: int) -> np.ndarray:
    """Sets of moves, as rows of 0 and 1 over the 2 m borders by rising distance, by rising expected sum of squares: of a function's two borders, which
    have ranks j and 2 m - 1 - j, a set moves across one at most."""
    j = np.arange(1, m + 1)
    near = j * (j + 1) / (4 * (m + 1) * (m + 2))
    far = 1 - j / (m + 1) + near
    expected = np.concatenate([near, far[::-1]])
    sets = [c for n in range(min(m, 6) + 1) for c in itertools.combinations(range(2 * m), n) if all(2 * m - 1 - i not in c for i in c)]
    cost = np.array([expected[list(c)].sum() for c in sets])
    pick = np.argsort(cost, kind="stable")[:most]
    out = np.zeros((len(pick), 2 * m), np.int8)
    for row, i in enumerate(pick):
        out[row, list(sets[i])] = 1
    return out


@dataclass
class Hashing:
    """The functions for vectors of one length: everything follows from the length, M and w."""

    length: int
    longest: float
    width: float
    tables: int = TABLES
    hashes: int = HASHES

    def __post_init__(self) -> None:
        rng = np.random.default_rng(20_011 + self.length)
        m = self.tables * self.hashes
        self.a = rng.normal(size=(self.length + 1, m)) / self.width
        self.b = rng.uniform(size=m)
        self.odd = tx.mix(rng.integers(0, 1 << 62, size=m).astype(np.uint64)) | np.uint64(1)

    def slots(self, x: np.ndarray, asked: bool) -> np.ndarray:
        """(rows, tables, hashes) places on the functions' lines."""
        norm = _norm(x)[:, None]
        if asked:
            v, rest = x / norm, np.zeros_like(norm)
        else:
            v, rest = x / self.longest, np.sqrt(np.maximum(0, 1 - np.nan_to_num(norm / self.longest, nan=1) ** 2))
        # row by row in a fixed order of additions, so that equal vectors have equal places
        at = np.einsum("ij,jk->ik", np.concatenate([v, rest], 1), self.a) + self.b
        return at.reshape(len(x), self.tables, self.hashes)

    def codes(self, slots: np.ndarray) -> np.ndarray:
        """(..., tables) bucket codes of whole slots; a table's codes are told apart from another's by the functions' factors."""
        odd = self.odd.reshape(self.tables, self.hashes)
        return tx.mix((slots.astype(np.int64).view(np.uint64) * odd).sum(-1, dtype=np.uint64)).view(np.int64)

    def visits(self, x: np.ndarray, most: int) -> np.ndarray:
        """(rows, tables, most) codes of the buckets that queries visit, by rising sum of squares."""
        at = self.slots(x, True)
        low = np.floor(at)
        off = at - low
        squares = np.concatenate([off**2, (1 - off) ** 2], -1)
        order = np.argsort(squares, -1, kind="stable")
        rising = np.take_along_axis(squares, order, -1)
        moves = _moves(self.hashes, 3 * most)
        cost = rising @ moves.T.astype(float)
        most = min(most, len(moves))
        sets = np.argpartition(cost, most - 1, -1)[..., :most]
        sets = np.take_along_axis(sets, np.argsort(np.take_along_axis(cost, sets, -1), -1, kind="stable"), -1)
        # what a move across each border adds to the sum that is the code, in the order of the borders
        odd = self.odd.reshape(self.tables, self.hashes)
        step = np.take_along_axis(np.broadcast_to(np.concatenate([~odd + np.uint64(1), odd], -1), squares.shape), order, -1)
        base = (low.astype(np.int64).view(np.uint64) * odd).sum(-1, dtype=np.uint64)
        out = base[..., None] + np.take_along_axis(step @ moves.T.astype(np.uint64), sets, -1)
        return tx.mix(out).view(np.int64)


def _norm(x: np.ndarray) -> np.ndarray:
    """Lengths of rows whose squares may be beyond double precision."""
    most = np.abs(x).max(1)
    return most * np.sqrt(((x / most[:, None]) ** 2).sum(1))


def _matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length as a matrix; slices heed their offsets."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of rows with rows, added in one order whatever the batch."""
    return (q * x).sum(1)


class Best:
    """The k best candidates of each query so far, by falling score, then by rising id. Pairs below a query's worst of k are not kept, but for a
    ``slack`` within which the order of additions may move a score."""

    def __init__(self, slack: np.ndarray, k: int):
        self.k, self.slack = k, slack
        self.floor = self.low = np.full(len(slack), -np.inf)
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.held = 0

    def add(self, q: np.ndarray, scores: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        """Scores of the queries q (places) and the candidates of a block (ids, and rows in the shard)."""
        a, b = np.nonzero(scores >= self.low[q][:, None])
        self.parts.append((q[a], scores[a, b], ids[b], rows[b]))
        self.held += len(a)
        if self.held > PAIRS:
            self.settle()

    def settle(self) -> tuple[np.ndarray, ...]:
        if not self.parts:
            return tuple(np.zeros(0, t) for t in (np.int64, np.float64, np.int64, np.int64))
        q, s, i, r = (np.concatenate(c) for c in zip(*self.parts, strict=True))
        # a candidate may be met in two buckets, its score with another last bit
        order = np.lexsort((i, q))
        order = order[np.r_[True, (q[order][1:] != q[order][:-1]) | (i[order][1:] != i[order][:-1])]]
        order = order[np.lexsort((i[order], -s[order], q[order]))]
        q, s, i, r = q[order], s[order], i[order], r[order]
        first = np.searchsorted(q, q)
        place = np.arange(len(q)) - first
        worst = place == self.k - 1
        self.floor[q[worst]] = s[worst]
        self.low = np.where(np.isfinite(self.floor), self.floor - self.slack, self.floor)
        # of those within the slack of the worst, a few in reserve; the exact scores decide
        keep = (place < self.k) | (s >= self.low[q]) & (place < 2 * self.k)
        q, s, i, r = q[keep], s[keep], i[keep], r[keep]
        self.parts, self.held = [(q, s, i, r)], len(q)
        return q, s, i, r


def _valid(vectors: DataFrame, id_column: str, column: str) -> DataFrame:
    """(vec_id, x, h1, h2): one row per id; the hashes stand for the vector."""
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.transform(F.col(column).cast("array<double>"), lambda e: e + 0.0).alias("x"))
    bad = F.exists("x", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & ~bad & F.exists("x", lambda e: e != 0))
    hashed = rows.select("vec_id", F.struct(F.xxhash64("x").alias("h1"), F.xxhash64("x", F.lit(1)).alias("h2"), "x").alias("v"))
    return hashed.groupBy("vec_id").agg(F.min("v").alias("v")).select("vec_id", "v.h1", "v.h2", "v.x")


def _audited(rows: DataFrame, sample: np.ndarray, k: int) -> list[np.ndarray]:
    """The vectors of the k nearest of each sampled query, by a scan of all rows: each block answers for itself, the k best are merged."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, ids = _matrix(batch.column(1)), batch.column(0).to_numpy()
            for lo in range(0, len(x), 8192):
                s = sample @ x[lo : lo + 8192].T
                top = np.argpartition(-s, min(k, s.shape[1] - 1), axis=1)[:, : k + 1]
                q = np.repeat(np.arange(len(sample)), top.shape[1])
                c = top.ravel() + lo
                yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(np.take_along_axis(s, top, 1).ravel()), pa.array(ids[c]), batch.column(1).take(pa.array(c))], names=["q", "s", "i", "x"])

    found = rows.select("vec_id", "x").mapInArrow(scan, "q long, s double, i long, x array<double>")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s"), "i"))
    near: list[list] = [[] for _ in sample]
    for r in found.withColumn("rank", rank).where(F.col("rank") <= k + 1).orderBy("q", "rank").collect():
        near[r.q].append(r.x)
    return [np.array(v) for v in near]


def _fitted(rows: DataFrame, length: int, longest: float, asked: Column, k: int) -> tuple[Hashing, int | None]:
    """The functions, and how many buckets of each table a query visits (None: all)."""
    sample = rows.where(asked).orderBy(F.xxhash64("vec_id", F.lit(7)), "vec_id").limit(AUDIT).select("x").collect()
    queries = np.array([r.x for r in sample])
    near = _audited(rows, queries, k)
    # the query itself, or a copy, comes first and needs no search
    pairs = [(i, v[1:]) for i, v in enumerate(near) if len(v) > 1]
    if not pairs:
        return Hashing(length, longest, 1.0), None
    q = queries / _norm(queries)[:, None]
    far = np.concatenate([np.sqrt(np.maximum(0, 2 - 2 * (v @ q[i]) / longest)) for i, v in pairs])
    hashing = Hashing(length, longest, max(WIDTH * float(np.quantile(far, 0.75)), 1e-9))
    first = np.full(sum(len(v) for _, v in pairs), np.iinfo(np.int64).max)
    at = 0
    for i, v in pairs:
        codes = hashing.codes(np.floor(hashing.slots(v, False)))
        met = codes[:, :, None] == hashing.visits(queries[i : i + 1], MOST)[0][None]
        first[at : at + len(v)] = np.where(met.any(2), met.argmax(2), np.iinfo(np.int64).max).min(1)
        at += len(v)
    need = int(np.ceil(RECALL * len(first))) - 1
    most = int(np.sort(first)[need])
    return hashing, None if most >= MOST else most + 1


def _indexed(nodes: DataFrame, hashing: Hashing) -> DataFrame:
    """(code, node, x): each candidate in its bucket of every table."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                some = batch.slice(lo, 4096)
                codes = hashing.codes(np.floor(hashing.slots(_matrix(some.column(1)), False)))
                for t in range(hashing.tables):
                    yield pa.RecordBatch.from_arrays([pa.array(codes[:, t]), some.column(0), some.column(1)], names=["code", "node", "x"])

    return nodes.select("node", "x").mapInArrow(place, "code long, node long, x array<double>")


def _asked(queries: DataFrame, hashing: Hashing, most: int | None, shards: int, hot: dict[int, int]) -> DataFrame:
    """(shard, q, x, codes): each query once for each shard that holds buckets it visits, with these. No codes: all of the shard's."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spread = np.array(sorted(hot), np.int64)
        for batch in batches:
            for lo in range(0, batch.num_rows, 128):
                some = batch.slice(lo, 128)
                n = some.num_rows
                if most is None:
                    row, shard = np.repeat(np.arange(n), shards), np.tile(np.arange(shards), n)
                    codes = pa.ListArray.from_arrays(pa.array(np.zeros(len(row) + 1, np.int32)), pa.array([], pa.int64()))
                else:
                    code = hashing.visits(_matrix(some.column(1)), most).reshape(n, -1)
                    row, flat = np.repeat(np.arange(n), code.shape[1]), code.ravel()
                    shard = flat % shards
                    if len(spread):
                        # a bucket in several shards is asked in each
                        many = np.ones(len(flat), np.int64)
                        inside = np.isin(flat, spread)
                        many[inside] = [hot[c] for c in flat[inside].tolist()]
                        part = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                        row, flat, shard = np.repeat(row, many), np.repeat(flat, many), (np.repeat(shard, many) + part) % shards
                    order = np.lexsort((flat, shard, row))
                    row, flat, shard = row[order], flat[order], shard[order]
                    new = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (shard[1:] != shard[:-1])])
                    codes = pa.ListArray.from_arrays(pa.array(np.r_[new, len(flat)].astype(np.int32)), pa.array(flat))
                    row, shard = row[new], shard[new]
                for at in range(0, len(row), 4096):
                    take = pa.array(row[at : at + 4096])
                    yield pa.RecordBatch.from_arrays([pa.array(shard[at : at + 4096].astype(np.int64)), some.column(0).take(take), some.column(1).take(take), codes.slice(at, 4096)], names=["shard", "node", "x", "codes"])

    return queries.select("node", "x").mapInArrow(send, "shard long, node long, x array<double>, codes array<long>")


def _answers(x: np.ndarray, ids: np.ndarray, code: np.ndarray, starts: np.ndarray, buckets: np.ndarray, q: np.ndarray, lists: pa.Array, k: int) -> tuple[np.ndarray, ...]:
    """(query's place, candidate, score) of the best k of each query in the buckets it names. Candidates stand in the order of their codes."""
    best = Best(1e-13 * _norm(q) * _norm(x).max(), k)
    size = np.diff(lists.offsets.to_numpy())
    everything = np.flatnonzero(size == 0)
    for lo in range(0, len(x) if len(everything) else 0, 1024):
        rows = np.arange(lo, min(len(x), lo + 1024))
        best.add(everything, q[everything] @ x[rows].T, ids[rows], rows)
    wanted = lists.flatten().to_numpy()
    at = np.minimum(np.searchsorted(buckets, wanted), len(buckets) - 1)
    there = buckets[at] == wanted
    who, at = np.repeat(np.arange(len(q)), size)[there], at[there]
    order = np.argsort(at, kind="stable")
    who, at = who[order], at[order]
    cuts = np.flatnonzero(np.r_[True, at[1:] != at[:-1], True]) if len(at) else np.zeros(0, np.int64)
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        bucket, some = at[a], who[a:b]
        for lo in range(starts[bucket], starts[bucket + 1], 2048):
            rows = np.arange(lo, min(starts[bucket + 1], lo + 2048))
            best.add(some, q[some] @ x[rows].T, ids[rows], rows)
    place, _, found, row = best.settle()
    score = _scores(q[place], x[row])
    order = np.lexsort((found, -score, place))
    place, found, score = place[order], found[order], score[order]
    keep = np.arange(len(place)) - np.searchsorted(place, place) < k
    return place[keep], found[keep], score[keep]


def _searched(dealt: DataFrame, k: int) -> DataFrame:
    """(q, c, score) from rows (shard, ask, code, node, x, codes) sorted by shard, candidates by code first: a shard's candidates are held, queries stream past."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, parts, index = None, [], None
        for batch in batches:
            at, ask = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cut = np.flatnonzero((at[1:] != at[:-1]) | (ask[1:] != ask[:-1])) + 1
            for lo, hi in itertools.pairwise([0, *cut.tolist(), len(at)]):
                if at[lo] != shard:
                    shard, parts, index = at[lo], [], None
                some = batch.slice(lo, hi - lo)
                if not ask[lo]:
                    parts.append((_matrix(some.column(4)), some.column(3).to_numpy(), some.column(2).to_numpy()))
                    continue
                if index is None and parts:
                    x, ids, code = (np.concatenate(c) for c in zip(*parts, strict=True))
                    first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
                    index, parts = (x, ids, code, np.r_[first, len(code)], code[first]), []
                if index is None:
                    continue
                for a in range(0, hi - lo, BATCH):
                    part = some.slice(a, BATCH)
                    place, found, score = _answers(*index, _matrix(part.column(4)), part.column(5), k)
                    yield pa.RecordBatch.from_arrays([part.column(3).take(pa.array(place)), pa.array(found), pa.array(score)], names=["q", "c", "score"])

    return dealt.mapInArrow(run, "q long, c long, score double")


def _of_length(rows: DataFrame, length: int, longest: float, total: int, asked: Column, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score) among the vectors of one length."""
    hashing, most = _fitted(rows, length, longest, asked, k)
    # equal vectors are one node, named by its least id, with as many ids as can matter
    rank = F.row_number().over(Window.partitionBy("h1", "h2").orderBy("vec_id"))
    nodes = rows.withColumn("r", rank).where(F.col("r") <= k + 1).groupBy("h1", "h2").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"), F.first("x").alias("x"))
    nodes = nodes.select(F.get("ids", F.lit(0)).alias("node"), "ids", "x").checkpoint()
    queries = rows.where(asked).groupBy("h1", "h2").agg(F.min("vec_id").alias("node"), F.first("x").alias("x")).checkpoint()
    index = _indexed(nodes, hashing)
    shards = max(6, -(-total * hashing.tables // SHARD))
    large = index.groupBy("code").agg(F.count("*").alias("n")).where(F.col("n") > SHARD).collect()  # at most one for every SHARD rows
    hot = {r.code: -(-r.n // SHARD) for r in large}
    several = rows.sparkSession.createDataFrame(sorted(hot.items()), "code long, many long")
    held = index.join(F.broadcast(several), "code", "left") if hot else index.withColumn("many", F.lit(1))
    place = F.pmod(F.pmod("code", F.lit(shards)) + F.pmod(F.xxhash64("node"), F.coalesce("many", F.lit(1))), F.lit(shards))
    held = held.select(place.cast("long").alias("shard"), F.lit(0).alias("ask"), "code", "node", "x", F.lit(None).cast("array<long>").alias("codes"))
    sent = _asked(queries, hashing, most, shards, hot).select("shard", F.lit(1).alias("ask"), F.lit(0).cast("long").alias("code"), "node", "x", "codes")
    dealt = held.unionByName(sent).repartition(shards, "shard").sortWithinPartitions("shard", "ask", "code", "node")
    found = _searched(dealt, k + 1).checkpoint()
    best = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "c"))
    merged = found.groupBy("q", "c").agg(F.max("score").alias("score")).withColumn("r", best).where(F.col("r") <= k + 1).drop("r")
    copies = nodes.where(F.size("ids") > 1).select("node", "ids")
    merged = merged.join(copies, F.col("c") == F.col("node"), "left").select("q", "score", F.explode(F.coalesce("ids", F.array("c"))).alias("vec_id"))
    listed = merged.groupBy("q").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))), 1, k + 1).alias("near"))
    # each query of a vector takes its list without itself
    listed = listed.join(queries.select("h1", "h2", F.col("node").alias("q")), "q").select("h1", "h2", "near").checkpoint()
    own = rows.where(asked).select(F.col("vec_id").alias("query_id"), "h1", "h2").join(listed, ["h1", "h2"])
    near = own.select("query_id", F.posexplode(F.slice(F.filter("near", lambda c: c["vec_id"] != F.col("query_id")), 1, k)).alias("i", "n"))
    return near.select("query_id", (F.col("i") + 1).alias("rank"), F.col("n.vec_id").alias("vec_id"), (-F.col("n.s")).alias("score"))


def nearest(vectors: DataFrame, asked: Column | None = None, *, k: int = 20, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every row that ``asked`` (on vec_id) picks, among all other rows."""
    asked = F.col("vec_id") % 20 == 0 if asked is None else asked
    rows = _valid(vectors, id_column, column).checkpoint()
    # its squares may be beyond double precision where the length is not
    most = F.array_max(F.transform("x", lambda e: F.abs(e)))
    norm = most * F.sqrt(F.aggregate(F.transform("x", lambda e: e / most), F.lit(0.0), lambda a, e: a + e * e))
    lengths = rows.groupBy(F.size("x").alias("d")).agg(F.max(norm).alias("m"), F.count("*").alias("n"), F.max(asked.cast("int")).alias("any")).collect()
    out = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for r in sorted(lengths):
        if r.any:
            out = out.unionByName(_of_length(rows.where(F.size("x") == r.d), r.d, r.m, r.n, asked, k))
    return out
