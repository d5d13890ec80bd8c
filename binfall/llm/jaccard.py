"""Near-duplicate groups by a size-aware, heavy-light set-similarity join over word shingles.

Documents with equal shingle sets are one class from the start. Between classes:

* Light: two sets of at most ``boundary`` shingles are linked only if they agree after deleting a tenth of each, so the small
  sets enumerate those subsets of fixed size (themselves, and each set less one shingle) and meet on equal subsets.
* Heavy: larger sets, and small ones that a larger one may link to, put the first tenth of their shingles, in an order common to
  all documents, on inverted lists; two linked sets share a list. First in the order is a fixed quarter of all possible
  shingles, by the number of sets that have them in the whole corpus, then the others by hash. A shingle of one set
  only needs no list, so a set that has enough of them is on none, whatever passages it shares with others.
* The boundary is where enumerating subsets starts to cost more rows than scanning lists (``cost_boundary``).

Links are found in rounds. First, classes whose sets agree in all the minima of a band (eight of 32 ranges of hash values) are tried with
hubs: one of the band, and one of the members of it that also share the next band. Then each member of a list is tried with hubs of the list. Hubs are
found by aggregation, so neither a popular band nor a popular shingle is gathered in one task, and a round makes a few pairs a member.
In the last round only members of one list whose ends are still in different components are paired, each pair under one of its
lists; pairs inside a component cannot change it. Every linked pair shares a list, so after the last round no link between components
is left out. Before sets are compared, parity signatures, which bound the difference of two sets from below, drop the
pairs that only share a passage.

Shingles that a sample of documents shows to be frequent are last in the common order and only put down by sets that need them; the sample
decides where work is spared, not which pairs are found.

Edge cases: null and empty texts have no shingles and are linked with nothing; a text with fewer words than a shingle is one shingle;
equal sets are linked; a very long text is one set, held by one task; repeated rows and rows that share an id are one node; an empty table
gives an empty table;
extra columns are ignored. A null doc_id takes no part and is its own component, null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import text as tx
from .components import BROADCAST_ROWS, components, release

#: The shingles whose hash has so many leading zero bits are put in order of their frequency.
COUNTED_BITS = 2
#: Bits of a set's signature, by the largest set that has so many.
SIGNATURE_SIZES, SIGNATURE_BITS = np.array([1200, 9000]), np.array([512, 4096, 32768])
#: What a row of an inverted list costs, with its share of verification, in rows of subsets.
LIST_COST = 8
#: Longest small set whose subsets are enumerated: at most one shingle may be missing.
LIGHT_LIMIT = 19
#: Bands of minima, and ranges of hash values in a band.
BANDS, BAND_RANGES = 4, 8
#: Sub-groups of a list or band that have hubs of their own.
HUBS = 8
#: Rounds of list hubs before the round of all open pairs.
ROUNDS = 1
#: Keys of a member, in order, in which a pair's first common list is looked up.
FIRST_KEYS = 16
#: Documents looked at for frequent shingles (about), and the share of them that makes a shingle frequent. There are at most so many
#: frequent ones as the counted shingles of a document, on average, over the share.
FREQUENT_SAMPLE, FREQUENT_SHARE = 20_000, 0.004
#: Names of sets that a task remembers, to put equal sets down once.
REMEMBERED = 500_000


def shingle_sets(data: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of the distinct shingles of a slice, by row and then hash. Case of A-Z is ignored."""
    w = tx.words(data, bounds, lower=True)
    row, found = tx.shingles(w, k)
    counts = w.counts()
    few = np.flatnonzero((counts > 0) & (counts < k))
    if len(few):
        end = np.cumsum(counts)[few]
        row = np.r_[row, few]
        found = np.r_[found, tx.runs(w.hash, end - counts[few], end)]
    order = np.lexsort((found, row))
    row, found = row[order], found[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (found[1:] != found[:-1])
    return row[new], found[new]


def _sums(row: np.ndarray, values: np.ndarray, rows: int) -> np.ndarray:
    """Sum of ``values`` modulo 2**64 by row; ``row`` ascends."""
    total = np.r_[np.uint64(0), np.cumsum(values)]
    edges = np.searchsorted(row, np.arange(rows + 1))
    return total[edges[1:]] - total[edges[:-1]]


def _salted(found: np.ndarray, salt: int) -> np.ndarray:
    return tx.mix(found ^ np.uint64(salt))


def _signatures(row: np.ndarray, found: np.ndarray, n: np.ndarray) -> pa.Array:
    """Parities for each row, more for larger sets: every shingle flips one bit, so two sets with as many bits differ in as many
    shingles as bits at least."""
    bits = SIGNATURE_BITS[np.searchsorted(SIGNATURE_SIZES, n)]
    start = np.r_[0, np.cumsum(bits)]
    spot = start[row] + (_salted(found, 0x1B873593) & (bits[row] - 1).astype(np.uint64)).astype(np.int64)
    flips = (np.bincount(spot, minlength=start[-1]) & 1).astype(np.uint8)
    return pa.ListArray.from_arrays(pa.array((start // 64).astype(np.int32)), pa.array(np.packbits(flips, bitorder="little").view(np.int64)))


def _bands(row: np.ndarray, found: np.ndarray, rows: int) -> pa.Array:
    """Hashes of the least shingle of each range of hash values, eight ranges together. ``found`` ascends in a row."""
    ranges = BANDS * BAND_RANGES
    cell = row * ranges + (found >> np.uint64(64 - ranges.bit_length() + 1)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]) if len(cell) else cell
    least = np.zeros(rows * ranges, np.uint64)
    least[cell[first]] = found[first]
    out = np.zeros((rows, BANDS), np.uint64)
    for part in least.reshape(rows, BANDS, BAND_RANGES).transpose(2, 0, 1):
        out = tx.mix(out * np.uint64(0x9FB21C651E98DF25) + part)
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * BANDS), pa.array(out.reshape(-1).view(np.int64)))


def _profiles(frame: DataFrame, k: int) -> DataFrame:
    """Per row doc_id, n, two 64-bit sums that name the set, its signature and its bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n", "k1", "k2", "sig", "bands"]
        for batch in batches:
            for a, b, data, bounds in tx.slices(batch.column(1)):
                row, found = shingle_sets(data, bounds, k)
                n = np.bincount(row, minlength=b - a)
                keys = [_sums(row, _salted(found, s), b - a).view(np.int64) for s in (0x51ED270B, 0x2545F4914F6CDD1D)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n), *map(pa.array, keys), _signatures(row, found, n), _bands(row, found, b - a)], names=names)

    return frame.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, k1 long, k2 long, sig array<long>, bands array<long>")


def cost_boundary(threshold: int) -> int:
    """The largest set size whose subsets cost no more rows than its inverted lists."""
    best = 0
    for n in range(1, LIGHT_LIMIT + 1):
        missing = n * (100 - threshold) // 100
        if missing <= 1 and 1 + n * missing <= (missing + 1) * LIST_COST:
            best = n
    return best


def _frequent(frame: DataFrame, k: int, rows: int) -> np.ndarray:
    """Counted shingles that are frequent in a sample of documents, most frequent last."""
    drawn = F.pmod(F.xxhash64("doc_id", F.lit("frequent")), F.lit(1_000_000)) < int(1_000_000 * min(1.0, FREQUENT_SAMPLE / max(1, rows)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, bounds in tx.slices(batch.column(0)):
                _, found = shingle_sets(data, bounds, k)
                key, n = np.unique(found[found >> np.uint64(64 - COUNTED_BITS) == 0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], names=["key", "n"])

    least = max(32, int(FREQUENT_SHARE * min(rows, FREQUENT_SAMPLE)))
    counts = frame.where(drawn).select("text").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return np.array([r.key for r in sorted(counts.collect(), key=lambda r: (r.n, r.key))], np.int64).view(np.uint64)


def _postings(frame: DataFrame, k: int, threshold: int, boundary: int, frequent: np.ndarray) -> DataFrame:
    """Rows (key, doc_id, k1, n, counted): subsets of small sets (counted -1), all counted shingles of larger ones that are not frequent
    (counted: how many they have), and, of a set with too few of these, the next in order (counted -1). A task puts equal sets down once."""
    reach = boundary + 1 - (boundary + 1) * (100 - threshold) // 100
    sorter = np.argsort(frequent, kind="stable")
    shared = frame.sparkSession.sparkContext.broadcast((frequent[sorter], sorter))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        often, place_of = shared.value
        for batch in batches:
            for a, b, data, bounds in tx.slices(batch.column(1)):
                row, found = shingle_sets(data, bounds, k)
                if not len(row):
                    continue
                n = np.bincount(row, minlength=b - a)
                salted = _salted(found, 0x51ED270B)
                k1 = _sums(row, salted, b - a)
                new = np.zeros(b - a, bool)
                for i, key in enumerate(k1.tolist()):
                    if n[i] and key not in seen:
                        new[i] = True
                        if len(seen) < REMEMBERED:
                            seen.add(key)
                size, first = n[row], (found >> np.uint64(64 - COUNTED_BITS)) == 0
                # the common order: counted shingles that are not frequent, frequent ones, others by hash
                at = np.searchsorted(often, found) if len(often) else np.zeros(len(found), np.int64)
                hot = first & (at < len(often)) & (often[np.minimum(at, len(often) - 1)] == found) if len(often) else np.zeros(len(found), bool)
                cold = first & ~hot
                group = np.where(cold, 0, np.where(hot, 1, 2))
                within = np.where(hot, place_of[np.minimum(at, len(often) - 1)] if len(often) else 0, 0)
                order = np.lexsort((within, group, row))
                place = np.empty(len(row), np.int64)
                place[order] = np.arange(len(row)) - np.searchsorted(row, np.arange(b - a))[row[order]]
                counted = np.bincount(row[cold], minlength=b - a)
                listed = new[row] & (size >= reach) & (cold | (place <= size * (100 - threshold) // 100))
                small = new & (n > 0) & (n <= boundary)
                cut = small[row] & (size * (100 - threshold) // 100 >= 1)
                keys = [found[listed], _salted(k1[small], 0x7A646E19), _salted(k1[row[cut]] - salted[cut], 0x7A646E19)]
                at = np.concatenate([row[listed], np.flatnonzero(small), row[cut]])
                number = np.full(len(at), -1)
                number[: listed.sum()] = np.where(cold, counted[row], -1)[listed]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), batch.column(0).take(pa.array(at + a)), pa.array(k1[at].view(np.int64)), pa.array(n[at]), pa.array(number)], names=["key", "doc_id", "k1", "n", "counted"])

    return frame.select("doc_id", "text").mapInArrow(run, "key long, doc_id long, k1 long, n long, counted long")


def _lists(postings: DataFrame, threshold: int) -> DataFrame:
    """(key, d, k1, n): what every set puts on lists, without keys of one set only. Frequent shingles are put down by sets that need them
    alone, so that no key has a large share of the rows that meet here."""
    # one shuffle by key serves the distinct step and the count
    entries = postings.repartition("key").groupBy("key", "k1", "n").agg(F.min("doc_id").alias("d"), F.max("counted").alias("counted"))
    shared = entries.withColumn("members", F.count("*").over(Window.partitionBy("key"))).where("members > 1")
    by_set = Window.partitionBy("d", "k1", F.col("counted") >= 0)
    # shingles of one set only come first in its order; after them, these
    rank = F.row_number().over(by_set.orderBy("members", "key")) + F.col("counted") - F.count("*").over(by_set)
    return shared.withColumn("rank", rank).where((F.col("counted") < 0) | (F.col("rank") <= F.floor(F.col("n") * (100 - threshold) / 100) + 1)).select("key", "d", "k1", "n")


def _sets(frame: DataFrame, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, bounds in tx.slices(batch.column(1)):
                row, found = shingle_sets(data, bounds, k)
                edges = np.searchsorted(row, np.arange(b - a + 1)).astype(np.int32)
                k1 = _sums(row, _salted(found, 0x51ED270B), b - a).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(k1), pa.ListArray.from_arrays(pa.array(edges), pa.array(found.view(np.int64)))], names=["doc_id", "k1", "items"])

    return frame.mapInArrow(run, "doc_id long, k1 long, items array<long>")


def _sizes_fit(a: Column, b: Column, threshold: int) -> Column:
    return 100 * F.least(a, b) >= threshold * F.greatest(a, b)


PAIR = ["a", "ak", "b", "bk"]


def _named(left: str, right: str) -> list[Column]:
    """A pair's ends (id and class key) in one order, from two structs (d, k1, n)."""
    p, q = F.least(left, right), F.greatest(left, right)
    return [p["d"].alias("a"), p["k1"].alias("ak"), q["d"].alias("b"), q["k1"].alias("bk")]


def _plausible(pairs: DataFrame, signatures: DataFrame, threshold: int) -> DataFrame:
    """Drop the pairs whose signatures prove that they differ in too many shingles."""

    def end(id_name: str, key: str, n: str, sig: str) -> DataFrame:
        return signatures.select(F.col("doc_id").alias(id_name), F.col("k1").alias(key), F.col("n").alias(n), F.col("sig").alias(sig))

    both = pairs.join(end("a", "ak", "n", "s"), ["a", "ak"]).join(end("b", "bk", "m", "t"), ["b", "bk"])
    return both.where(_may_reach(F.col("n"), F.col("m"), threshold)).select(*PAIR)


def _may_reach(n: Column, m: Column, threshold: int) -> Column:
    """Whether the signatures ``s`` and ``t`` leave room for the threshold; those of different lengths say nothing."""
    differ = F.aggregate(F.zip_with("s", "t", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
    return F.when(F.size("s") != F.size("t"), True).otherwise(differ * (100 + threshold) <= (n + m) * (100 - threshold))


def _verified(pairs: DataFrame, known: DataFrame, threshold: int, k: int) -> DataFrame:
    """The pairs whose sets reach the threshold, as (a, b). Only texts that a pair names are read again."""
    ends = pairs.select(F.col("a").alias("doc_id"), F.col("ak").alias("k1")).union(pairs.select("b", "bk")).distinct()
    # counted first: a short list of ids goes to the texts, a long one meets them in a shuffle
    ids = ends.select("doc_id").distinct()
    texts = known.join(F.broadcast(ids) if ends.count() <= BROADCAST_ROWS else ids, "doc_id", "left_semi")
    sets = _sets(texts.select("doc_id", "text"), k).join(ends, ["doc_id", "k1"], "left_semi").dropDuplicates(["doc_id", "k1"]).checkpoint()
    left = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("k1").alias("ak"), F.col("items").alias("x")), ["a", "ak"])
    both = left.join(sets.select(F.col("doc_id").alias("b"), F.col("k1").alias("bk"), F.col("items").alias("y")), ["b", "bk"])
    common = F.size(F.array_intersect("x", "y"))
    return both.where(100 * common >= threshold * (F.size("x") + F.size("y") - common)).select("a", "b").checkpoint()


def groups(docs: DataFrame, *, k: int = 5, threshold: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id. ``threshold`` is in hundredths, 80 to 99."""
    if not 80 <= threshold <= 99:
        raise ValueError("threshold must be from 80 to 99 hundredths")
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    profiles = _profiles(known, k).checkpoint()
    rows = profiles.select("doc_id", "n", "k1", "k2")
    known = known.where("doc_id is not null")
    with_words = profiles.where("n > 0 and doc_id is not null")
    # written down, so that the documents of a class that very many are in can be dealt out where they meet it
    classes = with_words.groupBy("n", "k1", "k2").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("most")).where("rep < most").drop("most").checkpoint()
    frequent = _frequent(known, k, profiles.count())
    lists = _lists(_postings(known, k, threshold, cost_boundary(threshold), frequent), threshold).checkpoint()
    release(docs.sparkSession)
    signatures = with_words.select("doc_id", "k1", "n", "sig").dropDuplicates(["doc_id", "k1"])
    banded = with_words.groupBy("n", "k1", "k2").agg(F.min("doc_id").alias("d"), F.first("bands").alias("bands"))
    links = link_in_rounds(lists, threshold, lambda pairs: _plausible(pairs, signatures, threshold), lambda pairs: _verified(pairs, known, threshold, k), _band_pairs(banded, threshold), signatures)
    # the representative of a class, and the documents of one class, in one component
    same = rows.join(classes, ["n", "k1", "k2"]).where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    found = components(links.unionByName(same)).withColumnRenamed("node", "doc_id")
    return rows.join(found, "doc_id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def _with_hubs(entries: DataFrame, salt: int, threshold: int) -> DataFrame:
    """Pairs of each member (key, me) with a hub of its key and with a hub of its part of the key. Members of one component are not tried."""
    part = F.pmod(F.xxhash64("me.d", "me.k1", F.lit(salt), F.lit("part")), F.lit(HUBS))
    turn = F.xxhash64("me.d", "me.k1", F.lit(salt))
    entries = entries.withColumn("part", part)
    hubs = entries.groupBy("key", "part").agg(F.min_by("me", turn).alias("other"), F.min(turn).alias("turn"))
    whole = hubs.groupBy("key").agg(F.min_by("other", "turn").alias("top"))
    met = entries.join(hubs.join(whole, "key").select("key", "part", "other", "top"), ["key", "part"])
    met = met.select("me", F.explode(F.array_distinct(F.array("other", "top"))).alias("other"))
    return met.where((F.col("me.c") != F.col("other.c")) & _sizes_fit(F.col("me.n"), F.col("other.n"), threshold))


def _band_pairs(classes: DataFrame, threshold: int) -> DataFrame:
    """Pairs of classes that share a band, or a band and the next, with the hubs of these."""
    me = F.struct("d", "k1", "n", F.col("d").alias("c")).alias("me")
    bands = [F.xxhash64(F.lit(i), F.col("bands")[i]) for i in range(BANDS)]
    twice = [F.xxhash64(F.lit(i + BANDS), F.col("bands")[i], F.col("bands")[(i + 1) % BANDS]) for i in range(BANDS)]
    return _with_hubs(classes.select(F.explode(F.array(*bands, *twice)).alias("key"), me), 0, threshold)


def link_in_rounds(lists: DataFrame, threshold: int, plausible: Callable[[DataFrame], DataFrame], verified: Callable[[DataFrame], DataFrame], ahead: DataFrame | None = None, signatures: DataFrame | None = None) -> DataFrame:
    """Links (a, b) among members of the same list (key, d, k1, n) that keep all components: the pairs (me, other) ``ahead``, rounds of hubs, then a
    round of all pairs whose ends are still in different components. ``plausible`` drops pairs (a, ak, b, bk) cheaply, ``verified``
    decides; with ``signatures`` the last round drops pairs of smaller sets before they leave their list."""
    links, tried, joined = None, None, None
    rounds = [] if ahead is None else [lambda: ahead]
    rounds += [lambda salt=salt: _with_hubs(_open(lists, joined), salt, threshold) for salt in range(1, ROUNDS + 1)]
    rounds.append(lambda: _across(_open(lists, joined), signatures, threshold))
    for number, met in enumerate(rounds):
        pairs = met().select(*_named("me", "other")).distinct()
        pairs = pairs if tried is None else pairs.join(tried, PAIR, "left_anti")
        pairs = plausible(pairs).checkpoint()
        tried = pairs if tried is None else tried.unionByName(pairs)
        found = verified(pairs)
        links = found if links is None else links.unionByName(found)
        release(lists.sparkSession)
        if number + 1 < len(rounds):
            joined = components(links)
    return links


def _across(open_: DataFrame, signatures: DataFrame | None, threshold: int) -> DataFrame:
    """Pairs (me, other) of members of one list that are in different components, of sizes and signatures that fit. A pair is made under the
    least of the lists that both have among their first ``FIRST_KEYS``, or else under any list it shares."""
    by = open_.select("key", "me", F.col("me.d").alias("d"), F.col("me.k1").alias("k1"))
    own = by.groupBy("d", "k1").agg(F.slice(F.sort_array(F.collect_set("key")), 1, FIRST_KEYS).alias("firsts"))
    if signatures is not None:
        # long signatures would weigh too much on every list; their pairs are sifted one by one later
        small = signatures.where(F.size("sig") <= SIGNATURE_BITS[0] // 64).select(F.col("doc_id").alias("d"), "k1", "sig")
        own = own.join(small, ["d", "k1"], "left")
    else:
        own = own.withColumn("sig", F.lit(None).cast("array<bigint>"))
    by = by.join(own, ["d", "k1"])
    x = by.select("key", "me", F.col("sig").alias("s"), F.col("firsts").alias("f"))
    y = by.select(F.col("key").alias("its"), F.col("me").alias("other"), F.col("sig").alias("t"), F.col("firsts").alias("g"))
    likely = F.col("s").isNull() | F.col("t").isNull() | _may_reach(F.col("me.n"), F.col("other.n"), threshold)
    once = F.coalesce(F.array_min(F.array_intersect("f", "g")) >= F.col("key"), F.lit(True))
    return x.join(y, (F.col("key") == F.col("its")) & (F.col("me.c") < F.col("other.c")) & _sizes_fit(F.col("me.n"), F.col("other.n"), threshold) & likely & once).select("me", "other")


def _open(lists: DataFrame, joined: DataFrame | None) -> DataFrame:
    """List entries (key, me) of the lists whose members are in more than one component; ``me`` has d, k1, n, c."""
    if joined is None:
        return lists.select("key", F.struct("d", "k1", "n", F.col("d").alias("c")).alias("me"))
    now = lists.join(joined.withColumnRenamed("node", "d"), "d", "left").select("key", F.struct("d", "k1", "n", F.coalesce("component", "d").alias("c")).alias("me"))
    mixed = now.groupBy("key").agg(F.min("me.c").alias("lo"), F.max("me.c").alias("hi")).where("lo < hi").select("key")
    return now.join(mixed, "key")
