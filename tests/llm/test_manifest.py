import hashlib
import zlib

import duckdb
import pytest
from binfall.llm import manifest as mf
from binfall.llm.oracles import OP11
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id int, tree string, leaf string, root int"


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(r, n_chars):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[3], r[2], n_chars, r[1])))


def tree(hashes, fan):
    """The root, and for every leaf the runs on its way up with its place in each."""
    paths, held = [[] for _ in hashes], [[i] for i in range(len(hashes))]
    while len(hashes) > 1:
        runs = [(hashes[i : i + fan], held[i : i + fan]) for i in range(0, len(hashes), fan)]
        for run, below in runs:
            for k, some in enumerate(below):
                for i in some:
                    paths[i].append((run, k))
        hashes, held = [digest("".join(run)) for run, _ in runs], [sum(below, []) for _, below in runs]
    return hashes[0], paths


def brute(rows, fan=2):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    groups = [sorted((r for r in rows if r[2] == x), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4]))) for x in langs]
    trees = [tree([leaf(r, r[4]) for r in g], fan) for g in groups]
    root, over = tree([t[0] for t in trees], fan)
    out = []
    for group, (subroot, paths), top in zip(groups, trees, over):
        for r, path in zip(group, paths):
            tampered = r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            cur, beside = leaf(r, r[4] + tampered if r[4] is not None else None), ""
            for run, k in path + top:
                beside += "".join(run[:k] + run[k + 1 :])
                cur = digest("".join(run[:k] + [cur] + run[k + 1 :]))
            out.append((r[0], leaf(r, r[4]), subroot, root, digest(beside), cur, cur == root))
    return sorted(out, key=repr)


def made(n):
    langs = ["en", "de", None, "é", "zz", ""]
    rows = [(i, f"text {i} é", langs[min(i % 11, 5)], f"s{i % 3}", i, i, "x", "y", 1) for i in range(n)]
    odd = [(None, None, None, None, None), (5, "", "en", "", 2**63 - 1), (7, "again", "en", None, 0), (7, "again", "en", None, 0), (9, "again", "fr", "a", None), (-3, "w " * 70_000, "en", "a", -5)]
    return rows + [(*r, 1, "x", "y", 1) for r in odd]


@pytest.mark.parametrize(("n", "fan"), [(0, 2), (3, 2), (700, 2), (300, 3), (90, 64)])
def test_equals_a_tree_by_hand(spark, n, fan):
    rows = made(n)
    got = mf.verified(spark.createDataFrame(rows, SCHEMA).repartition(5), fan)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, fan)


def test_a_lone_row_and_none(spark):
    row = [(4, "a", "en", "s", 1, 1, "", "", 1)]
    (r,) = mf.verified(spark.createDataFrame(row, SCHEMA)).collect()
    assert r.leaf == r.subroot == r.root and r.proof_sha256 == digest("") and r.verified == (zlib.crc32(b"4") % 7 != 0)
    assert mf.verified(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_hot_group_is_not_one_task(spark):
    """A group, and equal rows, lie in many tasks when they are numbered."""
    rows = spark.range(0, 4000, numPartitions=8).select((F.col("id") % 2).alias("id"), F.lit("en").alias("group"), F.lit("same").alias("leaf"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        placed = mf._placed(rows, "group", ["id", "leaf"])
        parts = placed.groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(r.pos for r in placed.collect()) == list(range(4000))
    assert max(r["count"] for r in parts) < 3000 and len(parts) > 1


def test_other_fields_and_paths(spark):
    rows = spark.createDataFrame([(i, f"p{i % 2}") for i in range(40)], "k int, part string")
    found = mf.manifest(rows, mf.leaf([F.col("k")]), id_column="k", group="part", fan=4, carry={"k2": F.col("k") * 2}).collect()
    for r in found:
        cur = r.leaf
        for pre, slot in r.path:
            assert pre[64 * slot : 64 * slot + 64] == cur
            cur = digest(pre)
        assert cur == r.root and r.k2 == 2 * r.k and r.leaf == digest(f"{len(str(r.k))}:{r.k}")
    with pytest.raises(ValueError):
        mf.manifest(rows, mf.leaf([F.col("k")]), id_column="k", group="part", fan=1)


def test_the_sql_gives_the_same(spark):
    path = "/root/testdata/sf0.001/documents.parquet"
    want = duckdb.sql(OP11.replace("FROM documents", f"FROM '{path}'")).fetchall()
    assert sorted(map(tuple, mf.verified(spark.read.parquet(path)).collect())) == sorted(want)
