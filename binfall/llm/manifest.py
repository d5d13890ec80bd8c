"""A Merkle manifest of a dataset, with parent-preimage paths: proofs and folding need no list of siblings, only what each parent was hashed from.

A leaf is the SHA-256 of a row's fields, each written as ``-`` if null, else its UTF-8 byte count, ``:`` and its value. The leaves of a group ascend by
id and form a tree: every ``fan`` consecutive nodes become the hash of their concatenation (the last run may be shorter), until one is left, the
subroot; subroots in the order of their groups form the tree of the root. For every parent the concatenated digests of its children are
stored, its *preimage*. A leaf meets its ancestors' preimages by a join; cutting its own 64 characters out of one gives the siblings at that level, and putting
another digest in their place and hashing gives the parent that follows from it.

Only hashes are shuffled, never texts. Leaves are numbered by a range sort, so a large group lies in many tasks. Trees are built some levels at a time, over
blocks of ``BLOCK`` consecutive nodes, and a block's preimages are one row: a leaf joins its block, which already holds the path above it.

Edge cases: null fields are ``-`` (a null id sorts first, a null group is a group of its own and sorts first); empty texts are ``0:``; repeated rows are leaves
each, those of one id in the order of their hashes; a lone leaf is its group's subroot, a lone subroot the root, and a row without any sibling has the
hash of nothing as proof; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Nodes of a block at most: the preimages of its levels, some 64 characters a node and level, are one row.
BLOCK = 32
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def _written(value: Column) -> Column:
    s = value.cast("string")
    return F.when(s.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf(fields: list[Column]) -> Column:
    return F.sha2(F.concat(*map(_written, fields)), 256)


def _placed(rows: DataFrame, group: str | None, order: list[str]) -> DataFrame:
    """The rows with ``tree``, a number that ascends with the group, ``pos``, their place in it from 0, and ``n``, its size. Rows are sorted by ranges of
    group and order, equal ones by a salt, so neither a large group nor equal rows meet in one task; the sorted rows are written down."""
    keys = [*([group] if group else []), *order]
    salted = rows.withColumn("salt", F.xxhash64(F.monotonically_increasing_id()))
    ranged = salted.repartitionByRange(*keys, "salt").sortWithinPartitions(*keys, "salt").drop("salt")
    at = ranged.withColumn("at", F.monotonically_increasing_id()).checkpoint()
    part = F.shiftright("at", 33)
    of = F.col(group) if group else F.lit(0)
    # a row for each group in each task
    runs = at.groupBy(part.alias("part"), of.alias("g")).agg(F.min("at").alias("first"), F.count("*").alias("many"))
    whole = Window.partitionBy("g")
    before = F.sum("many").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select("part", "g", "first", F.coalesce(before, F.lit(0)).alias("before"), F.min("first").over(whole).alias("tree"), F.sum("many").over(whole).alias("n"))
    met = at.join(runs, (part == F.col("part")) & of.eqNullSafe(F.col("g")))
    return met.select(*rows.columns, "tree", (F.col("before") + F.col("at") - F.col("first")).alias("pos"), "n")


def _runs(hashes: str, fan: int) -> Column:
    """An array's preimages: every ``fan`` consecutive digests as one text."""
    starts = F.sequence(F.lit(0), ((F.size(hashes) - 1) / fan).cast("int"))
    return F.transform(starts, lambda i: F.array_join(F.slice(hashes, i * fan + 1, F.lit(fan)), ""))


def _blocks(nodes: DataFrame, fan: int, levels: int) -> DataFrame:
    """(tree, block, n, pres, hash) of nodes (tree, pos, n, hash): the preimages of the next levels of each block of fan ** levels nodes, as an array of a
    level's parents each, and the block's node after them. A level that a tree no longer needs is null."""
    width = fan**levels
    grouped = nodes.groupBy("tree", F.expr(f"pos div {width}").alias("block")).agg(F.sort_array(F.collect_list(F.struct("pos", "hash"))).alias("c"), F.first("n").alias("n"))
    out = grouped.select("tree", "block", "n", F.col("c.hash").alias("h0"))
    for k in range(levels):
        h, pre = f"h{k}", f"p{k + 1}"
        runs = _runs(h, fan)
        more = F.col("n") > fan**k
        out = out.withColumn(pre, F.when(more, runs))
        out = out.withColumn(f"h{k + 1}", F.when(more, F.transform(pre, lambda p: F.sha2(p, 256))).otherwise(F.col(h)))
    pres = F.array(*(f"p{k + 1}" for k in range(levels)))
    return out.select("tree", "block", F.ceil(F.col("n") / width).cast("long").alias("n"), pres.alias("pres"), F.element_at(f"h{levels}", 1).alias("hash"))


def _layers(nodes: DataFrame, fan: int, levels: int) -> list[DataFrame]:
    """Blocks, blocks of blocks, and so on, until every tree is one block; each written down, and smaller than the one before by the block's width."""
    layers, most = [], nodes.agg(F.max("n")).first()[0] or 0
    while True:
        layers.append(_blocks(nodes, fan, levels).checkpoint())
        most = -(-most // fan**levels)
        if most <= 1:
            return layers
        nodes = layers[-1].select("tree", F.col("block").alias("pos"), "n", "hash")


def _met(nodes: DataFrame, blocks: DataFrame, fan: int, levels: int) -> DataFrame:
    """Nodes joined with their blocks (tree, block, pres, above): their path, the preimages from the parent up, each with the node's slot in it."""
    width = fan**levels
    own = nodes.withColumn("block", F.expr(f"pos div {width}"))
    place = F.col("pos") % width
    steps = [F.when(F.get("pres", F.lit(k)).isNotNull(), F.struct(F.get(F.get("pres", F.lit(k)), F.floor(place / fan ** (k + 1)).cast("int")).alias("pre"), (F.floor(place / fan**k) % fan).cast("int").alias("slot"))) for k in range(levels)]
    path = F.concat(F.filter(F.array(*steps), lambda s: s.isNotNull()), F.col("above"))
    return own.join(blocks, ["tree", "block"]).withColumn("path", path).drop("pres", "above", "block")


def _paths(layers: list[DataFrame], ends: DataFrame, fan: int, levels: int) -> DataFrame:
    """The blocks of the first layer with what lies above them: (tree, block, pres, above, *columns of ends). ``ends`` has a row (tree, above, ...) for
    each tree: the path above its root."""
    extra = [c for c in ends.columns if c not in ("tree", "above")]
    down = layers[-1].select("tree", "block", "pres").join(ends, "tree")
    for layer in layers[-2::-1]:
        nodes = layer.select("tree", F.col("block").alias("pos"), F.col("pres").alias("own"))
        down = _met(nodes, down, fan, levels).select("tree", F.col("pos").alias("block"), F.col("own").alias("pres"), F.col("path").alias("above"), *extra)
    return down


def siblings(path: Column) -> Column:
    """The digests beside a node on its way up, concatenated: each preimage without the node's own 64 characters."""
    return F.array_join(F.transform(path, lambda s: F.concat(F.substring(s["pre"], F.lit(1), 64 * s["slot"]), F.substr(s["pre"], 64 * s["slot"] + 65))), "")


def folded(start: Column, path: Column) -> Column:
    """The root that follows from a leaf: it takes its place in the parent's preimage, the hash of that takes its place in the next."""
    splice = lambda h, s: F.sha2(F.concat(F.substring(s["pre"], F.lit(1), 64 * s["slot"]), h, F.substr(s["pre"], 64 * s["slot"] + 65)), 256)
    return F.aggregate(path, start, splice)


def manifest(rows: DataFrame, leaves: Column, *, id_column: str = "doc_id", group: str = "lang", fan: int = 2, carry: dict[str, Column] | None = None) -> DataFrame:
    """(id, carried columns, leaf, subroot, root, path) of every row: its leaf hash, its group's and the dataset's root, and its path, an array of
    (pre, slot) from its parent to the root. Columns to carry are reckoned before the shuffle."""
    if fan < 2:
        raise ValueError(f"fan={fan}")
    carry = carry or {}
    levels = max(1, int(math.log(BLOCK, fan) + 1e-9))
    hashed = rows.select(F.col(id_column).alias("id"), F.col(group).alias("group"), leaves.alias("leaf"), *(c.alias(f"carried_{k}") for k, c in carry.items()))
    placed = _placed(hashed, "group", ["id", "leaf"])
    own = _layers(placed.select("tree", "pos", "n", F.col("leaf").alias("hash")), fan, levels)
    # every tree is one block now; its subroots, in the order of the groups, are the leaves of the last tree
    subroots = _placed(own[-1].select(F.col("tree").alias("group"), F.col("hash").alias("subroot")), None, ["group"])
    top = _layers(subroots.select("tree", "pos", "n", F.col("subroot").alias("hash")), fan, levels)
    root = top[-1].select("tree", F.array().cast("array<struct<pre:string,slot:int>>").alias("above"), F.col("hash").alias("root"))
    ends = _met(subroots.select("tree", "pos", "group", "subroot"), _paths(top, root, fan, levels), fan, levels)
    ends = ends.select(F.col("group").alias("tree"), F.col("path").alias("above"), "subroot", "root")
    found = _met(placed.drop("n", "group"), _paths(own, ends, fan, levels), fan, levels)
    return found.select(F.col("id").alias(id_column), *(F.col(f"carried_{k}").alias(k) for k in carry), "leaf", "subroot", "root", "path")


def verified(docs: DataFrame, fan: int = 2) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified. ``folded_root`` starts from the leaf of the tampered row where
    7 divides the CRC-32 of the id's decimal digits: such a row has one more in ``n_chars`` (a null stays). Only untampered rows verify, then."""
    tampered = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 7 == 0
    more = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("decimal(20,0)")
    forged = F.when(tampered, leaf([more if f == "n_chars" else F.col(f) for f in FIELDS]))
    found = manifest(docs, leaf([F.col(f) for f in FIELDS]), fan=fan, carry={"forged": forged})
    out = found.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"), folded(F.coalesce("forged", "leaf"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
