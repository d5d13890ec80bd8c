"""Embedding near-duplicates by hierarchical navigable small-world graphs, one per shard.

Vectors that are equal after scaling to length one bit by bit are one node. Nodes are dealt to shards by a hash; a shard's task
builds a layered graph over its nodes and then streams every node past it as a query: from the top layer a beam descends to the bottom
layer, and what it finds is verified by the cosine in double precision. A beam that comes back full of links is widened until it
does not. Then a recall audit: for some queries of every batch the shard is scanned whole, and while the beam missed a link of
theirs, the batch is searched again with twice the width (in the end: the whole shard).

A query's links are counted, not written down: each small step of queries is at once reduced to counts and to the first query that each node was
found by (``Reduced``). What leaves a task is a row per query with links, and a spanning forest of the links of each batch: at most
one edge per query and node, however dense the group.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor do vectors of different
lengths; repeated rows of one id are one vector (the least of its vectors); links of equal vectors count; an empty table
gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .components import components

#: Queries searched together, first beam width, queries audited per batch, nodes that a shard holds about.
BATCH, BEAM, AUDIT, SHARD_NODES = 1024, 48, 64, 100_000


class Graph:
    """A layered proximity graph over unit vectors. Every layer holds about a sixteenth of the one below. Nodes enter in batches:
    each finds its nearest among those already in and those of its batch, keeps a diverse choice, and is linked back."""

    def __init__(self, vectors: np.ndarray, degree: int = 16, beam: int = 48):
        self.vectors = np.ascontiguousarray(vectors, np.float32)
        self.degree = degree
        n = len(vectors)
        level = np.minimum(np.floor(-np.log2((tx.mix(np.arange(n, dtype=np.uint64)) >> np.uint64(11)).astype(np.float64) / 2**53 + 1e-18) / 4), 8)
        self.order = np.lexsort((np.arange(n), -level))
        self.vectors = self.vectors[self.order]
        # layer i holds the first sizes[i] nodes
        sizes = sorted({int((level >= k).sum()) for k in range(9)} - {0})
        self.sizes = [s for s in sizes if s > 4 * degree or s == n]
        self.layers: list[np.ndarray] = []
        self.filled: list[list[int]] = []
        for size in self.sizes:
            links = np.full((size, 2 * degree), -1, np.int32)
            self.layers.append(links)
            self.filled.append([0] * size)
            at = min(size, 256)
            self._insert(links, np.arange(at), None, beam)
            while at < size:
                to = min(size, at + min(at, 2048))
                fresh = np.arange(at, to)
                found, _ = self._search(self.vectors[fresh], beam, layers=len(self.layers), limit=at)
                self._insert(links, fresh, found, beam)
                at = to

    def _insert(self, links: np.ndarray, fresh: np.ndarray, found: np.ndarray | None, beam: int) -> None:
        for lo in range(0, len(fresh), 256):
            rows = fresh[lo : lo + 256]
            own = self.vectors[rows] @ self.vectors[fresh].T
            own[np.arange(len(rows)), np.arange(lo, lo + len(rows))] = -2
            k = min(beam, len(fresh) - 1)
            cand = np.zeros((len(rows), 0), np.int64) if found is None else found[lo : lo + 256].astype(np.int64)
            if k > 0:
                cand = np.concatenate([cand, fresh[np.argpartition(-own, k - 1, axis=1)[:, :k]]], axis=1)
            chosen = self._diverse(rows, cand)
            links[rows, : self.degree] = chosen
            self._link_back(links, rows, chosen)

    def _diverse(self, rows: np.ndarray, cand: np.ndarray) -> np.ndarray:
        """Up to ``degree`` candidates: the nearest first, then those nearer to the row than to any kept one, then the nearest left."""
        out = np.full((len(rows), self.degree), -1, np.int32)
        if not cand.shape[1]:
            return out
        sims = np.where(cand >= 0, np.einsum("ijk,ik->ij", self.vectors[cand], self.vectors[rows]), -3)
        top = np.argsort(-sims, axis=1)[:, : 3 * self.degree]
        cand, sims = np.take_along_axis(cand, top, 1), np.take_along_axis(sims, top, 1)
        v = self.vectors[cand]
        among = np.einsum("ijk,ilk->ijl", v, v)
        kept = np.zeros(cand.shape, bool)
        for j in range(cand.shape[1]):
            blocked = ((among[:, j, :] > sims[:, j, None]) & kept).any(1)
            kept[:, j] = ~blocked & (cand[:, j] >= 0)
        # the diverse ones take at most three quarters of the places
        rank = np.where(kept & (np.cumsum(kept, 1) <= 3 * self.degree // 4), 0, 1) + np.where(cand >= 0, 0, 2)
        pick = np.argsort(rank * cand.shape[1] + np.arange(cand.shape[1]), axis=1)[:, : self.degree]
        got = np.take_along_axis(cand, pick, 1)
        out[:, : got.shape[1]] = got
        return out

    def _link_back(self, links: np.ndarray, rows: np.ndarray, chosen: np.ndarray) -> None:
        """Put the rows on the lists of their neighbours; a full list drops its farthest entry."""
        flat = chosen.ravel()
        counts, d = self.filled[len(self.layers) - 1], self.degree
        for to, back in zip(np.repeat(rows, d)[flat >= 0].tolist(), flat[flat >= 0].tolist(), strict=True):
            c = counts[back]
            if c < d:
                links[back, d + c] = to
                counts[back] = c + 1
                continue
            half = links[back, d:]
            sims = self.vectors[half] @ self.vectors[back]
            worst = sims.argmin()
            if sims[worst] < self.vectors[to] @ self.vectors[back]:
                half[worst] = to

    def _search(self, queries: np.ndarray, width: int, layers: int | None = None, limit: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids (-1: none) and similarities of the beam at the bottom, best first. ``limit``: nodes of the bottom layer so far."""
        layers = len(self.layers) if layers is None else layers
        # while a layer is young, the one above may hold nodes that it has not: then its first nodes are the entry
        above = 0 if limit is None or layers < 2 or limit >= self.sizes[layers - 2] else layers - 1
        if above:
            beam = np.argsort(-(queries @ self.vectors[: min(limit, 256)].T), axis=1)[:, :4]
            return self._descend(queries, beam, self.layers[above], limit, width)
        entry = min(self.sizes[0], 4 * self.degree, limit if layers == 1 and limit is not None else self.sizes[0])
        sims = queries @ self.vectors[:entry].T
        k = min(4, entry)
        beam = np.argsort(-sims, axis=1)[:, :k]
        for i in range(layers):
            n = limit if i == layers - 1 and limit is not None else self.sizes[i]
            beam, sims = self._descend(queries, beam, self.layers[i], n, width if i == layers - 1 else 8)
        return beam, sims

    def _descend(self, queries: np.ndarray, beam: np.ndarray, links: np.ndarray, n: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        b = len(queries)
        width = min(width, n)
        rows = np.arange(b)[:, None]
        seen = np.zeros((b, n + 1), bool)
        ids = np.full((b, width), -1, np.int64)
        sims = np.full((b, width), -2.0, np.float32)
        k = min(beam.shape[1], width)
        ids[:, :k] = beam[:, :k]
        sims[:, :k] = np.where(ids[:, :k] >= 0, np.einsum("ijk,ik->ij", self.vectors[ids[:, :k]], queries), -2)
        seen[rows, ids[:, :k]] = True
        done = ids < 0
        active = np.arange(b)
        while len(active):
            # the best few that are still closed, of each query
            score = np.where(done[active], -9, sims[active])
            pick = np.argpartition(-score, min(3, width - 1), axis=1)[:, :4]
            some = np.take_along_axis(score, pick, 1) > -9
            go = some.any(1)
            active, pick, some = active[go], pick[go], some[go]
            if not len(active):
                break
            node = np.where(some, ids[active[:, None], pick], -1)
            done[active[:, None], pick] = True
            near = np.where(node[:, :, None] >= 0, links[node], -1).reshape(len(active), -1).astype(np.int64)
            near[near >= n] = -1
            near[seen[active[:, None], near]] = -1
            # one of equal neighbours stays
            near.sort(axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            seen[active[:, None], near] = True
            seen[:, n] = False
            got = np.where(near >= 0, np.einsum("ijk,ik->ij", self.vectors[near], queries[active], optimize=True), -2)
            all_ids = np.concatenate([ids[active], near], axis=1)
            all_sims = np.concatenate([sims[active], got], axis=1)
            all_done = np.concatenate([done[active], near < 0], axis=1)
            best = np.argpartition(-all_sims, width - 1, axis=1)[:, :width]
            ids[active] = np.take_along_axis(all_ids, best, 1)
            sims[active] = np.take_along_axis(all_sims, best, 1)
            done[active] = np.take_along_axis(all_done, best, 1)
            # the links of a query are followed to the end; else it stops when nothing new got in
            active = active[(~done[active]).any(1)]
        order = np.argsort(-sims, axis=1)
        return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)

    def search(self, queries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """As ``_search``, ids in the order of the vectors given."""
        beam, sims = self._search(np.asarray(queries, np.float32), width)
        return np.where(beam >= 0, self.order[beam], -1), sims


class Reduced:
    """Pairs (query, node) as counts per query and as few edges that connect what all pairs connect: a node's first query, and of each query one
    edge to the nodes of every other first query."""

    def __init__(self, queries: int, nodes: int, weight: np.ndarray):
        self.count, self.first, self.weight = np.zeros(queries, np.int64), np.full(nodes, -1, np.int64), weight
        self.edges: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, q: np.ndarray, m: np.ndarray) -> None:
        np.add.at(self.count, q, self.weight[m])
        fresh = self.first[m] < 0
        nodes, at = np.unique(m[fresh], return_index=True)
        self.first[nodes] = q[fresh][at]
        self.edges.append((self.first[nodes], nodes))
        q, m, first = (x[self.first[m] != q] for x in (q, m, self.first[m]))
        _, at = np.unique(q * len(self.count) + first, return_index=True)
        self.edges.append((q[at], m[at]))

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *(q for q, _ in self.edges)]), np.concatenate([none, *(m for _, m in self.edges)])


def links_of(graph: Graph, exact: np.ndarray, queries: np.ndarray, threshold: float, audit: np.ndarray, take: Callable[[np.ndarray, np.ndarray], None]) -> None:
    """Gives ``take`` the pairs (query, node) with a cosine of ``threshold`` or more, each once, a bounded number at a time. ``exact``: the
    shard's unit vectors in double precision; ``audit``: the queries whose recall is held against a scan of the shard."""
    slack = threshold - 1e-5
    n = len(exact)
    truth = queries[audit] @ exact.T >= threshold
    width, todo = min(BEAM, n), np.arange(len(queries))
    found_q: list[np.ndarray] = []
    found_n: list[np.ndarray] = []
    missed = False
    while len(todo):
        wide: list[np.ndarray] = []
        step = max(1, min(BATCH, (1 << 22) // max(width, 1), (1 << 27) // (n + 1)))
        for lo in range(0, len(todo), step):
            part = todo[lo : lo + step]
            if width >= n:  # nothing wider than the shard
                q, m = np.nonzero(queries[part] @ exact.T >= threshold)
                take(part[q], m)
                continue
            ids, sims = graph.search(queries[part], width)
            full = sims[:, -1] >= slack
            wide.append(part[full])
            q, at = np.nonzero((sims >= slack) & ~full[:, None])
            m = ids[q, at]
            good = np.einsum("ij,ij->i", queries[part[q]], exact[m]) >= threshold
            found_q.append(part[q[good]])
            found_n.append(m[good])
        wide_all = np.concatenate(wide) if wide else todo[:0]
        settled = np.setdiff1d(audit, wide_all)
        if len(settled) and width < n:
            got = np.bincount(np.concatenate([*found_q, todo[:0]]), minlength=len(queries))[settled]
            want = truth[np.searchsorted(audit, settled)].sum(1)
            missed = bool((got < want).any())
        if missed and width < n:
            found_q, found_n, todo, missed = [], [], np.arange(len(queries)), False
        else:
            todo = wide_all
        width = min(2 * width if width < 1024 else n, n)
    for q, m in zip(found_q, found_n, strict=True):
        take(q, m)


def forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Places of edges (a, b) that keep what all of them connect: at most one per node."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[p]
        return x

    keep = []
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        x, y = root(x), root(y)
        if x != y:
            parent[x] = y
            keep.append(i)
    return np.array(keep, np.int64)


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimension)


def _units(rows: DataFrame) -> DataFrame:
    """Sound vectors at length one, with a digest of their bytes: (vec_id, x, key). The largest component is scaled to one before the
    squares, which else might leave the range of a double."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sound, units, keys = [], [], []
            for v in batch.column(1):
                x = v.values.to_numpy(zero_copy_only=False)
                top = np.abs(x).max(initial=0.0) if v.values.null_count == 0 else np.nan
                sound.append(bool(0 < top < np.inf))
                if sound[-1]:
                    x = x / top
                    x = x / np.sqrt((x * x).sum()) + 0.0
                    units.append(x)
                    keys.append(hashlib.blake2b(x.tobytes(), digest_size=16).digest())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(sound, pa.bool_())), pa.array(units, pa.list_(pa.float64())), pa.array(keys, pa.binary())], names=["vec_id", "x", "key"])

    return rows.mapInArrow(run, "vec_id long, x array<double>, key binary")


def _linked(dealt: DataFrame, threshold: float) -> DataFrame:
    """Rows (a, n, b): node ``a`` has links to ``n`` vectors of the shard (b null), or an edge of the forest (n null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, ids, many, parts, graph, exact = None, [], [], [], None, None
        for batch in batches:
            shards, asks = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for lo, hi in _runs(shards, asks):
                if shards[lo] != shard:
                    shard, ids, many, parts, graph = shards[lo], [], [], [], None
                cut = batch.slice(lo, hi - lo)
                node, size = cut.column(2).to_numpy(), cut.column(3).to_numpy()
                x = _matrix(cut.column(4), len(cut.column(4)[0]))
                if not asks[lo]:
                    ids.append(node)
                    many.append(size)
                    parts.append(x)
                    continue
                if not ids:
                    continue
                if graph is None:
                    ids, many, exact = [np.concatenate(ids)], [np.concatenate(many)], np.concatenate(parts)
                    graph = Graph(exact)
                for at in range(0, len(node), 4 * BATCH):
                    yield _answers(graph, exact, ids[0], many[0], node[at : at + 4 * BATCH], x[at : at + 4 * BATCH], threshold)

    return dealt.mapInArrow(run, "a long, n long, b long")


def _runs(*columns: np.ndarray) -> list[tuple[int, int]]:
    change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
    edges = [0, *change.tolist(), len(columns[0])]
    return list(zip(edges, edges[1:], strict=False))


def _answers(graph: Graph, exact: np.ndarray, ids: np.ndarray, many: np.ndarray, node: np.ndarray, x: np.ndarray, threshold: float) -> pa.RecordBatch:
    hashed = tx.mix(node.astype(np.int64).view(np.uint64))
    audit = np.sort(np.argsort(hashed)[:AUDIT])
    links = Reduced(len(node), len(ids), many)

    def take(q: np.ndarray, m: np.ndarray) -> None:
        other = node[q] != ids[m]
        links.add(q[other], m[other])

    links_of(graph, exact, x, threshold, audit, take)
    count, (q, m) = links.count, links.pairs()
    some = np.flatnonzero(count)
    keep = forest(node[q], ids[m])
    none = pa.nulls
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.concatenate([node[some], node[q[keep]]])),
            pa.concat_arrays([pa.array(count[some]), none(len(keep), pa.int64())]),
            pa.concat_arrays([none(len(some), pa.int64()), pa.array(ids[m[keep]])]),
        ],
        names=["a", "n", "b"],
    )


def near_duplicates(vectors: DataFrame, *, threshold: float = 0.95, id_column: str = "vec_id", column: str = "embedding", shards: int | None = None) -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept."""
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("x"))
    unit = _units(rows.where("vec_id is not null and x is not null")).groupBy("vec_id").agg(F.min(F.struct("x", "key")).alias("v"))
    unit = unit.select("vec_id", "v.key", "v.x").checkpoint()
    nodes = unit.groupBy("key").agg(F.min("vec_id").alias("node"), F.count("*").alias("many"), F.first("x").alias("x")).checkpoint()
    named = unit.select("vec_id", "key").join(nodes.select("key", "node", "many"), "key").select("vec_id", "node", "many")
    total = nodes.count()
    s = shards or max(6, -(-total // SHARD_NODES))
    shard = F.pmod(F.xxhash64("node"), F.lit(s)).cast("int")
    # vectors of different lengths are compared in different shards
    held = nodes.select(shard.alias("shard"), F.lit(0).alias("ask"), "node", "many", "x")
    asked = nodes.select(F.explode(F.sequence(F.lit(0), F.lit(s - 1))).alias("shard"), F.lit(1).alias("ask"), "node", "many", "x")
    dealt = held.unionByName(asked).withColumn("length", F.size("x"))
    dealt = dealt.repartition(4 * s, "length", "shard").sortWithinPartitions("length", "shard", "ask", "node")
    dealt = dealt.select((F.col("length") * s + F.col("shard")).cast("long").alias("shard"), "ask", "node", "many", "x")
    found = _linked(dealt, threshold).checkpoint()
    links = found.where("n is not null").groupBy("a").agg(F.sum("n").alias("n"))
    edges = found.where("b is not null").select("a", "b").unionByName(named.where("vec_id <> node").select(F.col("vec_id").alias("a"), F.col("node").alias("b")))
    joined = components(edges)
    out = named.join(links, F.col("node") == F.col("a"), "left").select("vec_id", (F.coalesce("n", F.lit(0)) + F.col("many") - 1).alias("n_links"))
    out = out.join(joined, F.col("vec_id") == F.col("node"), "left").select("vec_id", "n_links", "component")
    full = rows.select("vec_id").join(out, "vec_id", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return full.withColumn("kept", F.col("vec_id") == F.col("component_id"))
