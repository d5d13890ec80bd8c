import random
from decimal import Decimal

import pytest
from binfall.functions import U32, U64, Config
from binfall.functions import sql as sql_functions
from binfall.operators import checked_derived, cumulate, digests, equality, first_differences, merge_packed, packed_quantiles, quantiles, record, to_packed, widen_derived, with_derived
from binfall.operators.packed import position_of
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

C = Config(7, 32)
PACKED = "k string, idx array<long>, cnt array<decimal(20,0)>"


@pytest.fixture(scope="module")
def cells(spark):
    rng = random.Random(4)
    rows = [(k, rng.getrandbits(rng.randint(1, 31))) for k, n in (("long", 900), (None, 300), ("short", 5), ("one", 1)) for _ in range(n)]
    return record(spark.createDataFrame(rows, "k string, v long"), ["k"], F.col("v"), C)


@pytest.mark.parametrize("width", [U32, U64])
def test_search_finds_the_first_place(spark, width):
    rng = random.Random(1)
    rows = []
    for n in [0, 1, 2, 3, 7, 8, 9, 15, 16, 17, 31, 32, 33, 100, 1000]:
        cum, at = [], 0
        for _ in range(n):
            at += rng.choice([0, 1, 5])
            cum.append(at)
        for t in {0, 1, 2, at // 2, at - 1, at, at + 1, *(rng.randint(0, at + 2) for _ in range(5))}:
            rows.append((cum, t, next((i for i, c in enumerate(cum) if c >= t), n)))
    df = spark.createDataFrame(rows, "cum array<long>, t long, want int")
    assert df.where(position_of(F.col("cum"), F.col("t"), width) != F.col("want")).count() == 0


def test_packed_quantiles_equal_those_of_cells_without_a_shuffle(spark, cells, tmp_path):
    to_packed(cumulate(cells, ["k"]), ["k"], C, count="cum").write.parquet(str(tmp_path / "p"))
    rows = spark.read.parquet(str(tmp_path / "p"))
    qs = [0, 0.001, 0.25, 0.5, 0.75, 0.999, 1.0, 0.5]
    got = packed_quantiles(rows, ["k"], qs, C)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan and "Python" not in plan
    as_rows = lambda df: sorted(((r.k, r.q, r.bucket.lo, r.bucket.hi, int(r.bucket["count"]), int(r.total)) for r in df.collect()), key=repr)
    assert as_rows(got) == as_rows(quantiles(cells, ["k"], qs, C))
    assert packed_quantiles(rows, ["k"], [], C).count() == 0
    none = spark.createDataFrame([("x", [], [])], "k string, idx array<long>, cum array<long>")
    assert packed_quantiles(none, ["k"], [0.5], C).count() == 0
    # double rounding lifts the rank above the total: the last bucket, or in strict mode no row
    top = spark.createDataFrame([("x", [1, 3], [5, 2**53 + 3])], "k string, idx array<long>, cum array<long>")
    assert [(r.bucket.lo, r.bucket["count"]) for r in packed_quantiles(top, ["k"], [1.0], C).collect()] == [(3, 2**53 - 2)]
    assert packed_quantiles(top, ["k"], [1.0], C, strict=True).count() == 0


def pair(spark, a, b):
    d = lambda m: [list(m), [Decimal(c) for c in m.values()]]
    make = lambda m: spark.createDataFrame([(k, *d(v)) for k, v in m.items()], PACKED)
    return make(a), make(b)


def merged(spark, a, b, **options):
    x, y = pair(spark, {"k": a}, {"k": b})
    (r,) = merge_packed(x, y, ["k"], C, **options).collect()
    return dict(zip(r.idx, map(int, r.cnt))) if "errors" not in options else r.status


H = {1: 6, 3: 12, 5: 7}


def test_sums_in_a_row(spark):
    assert merged(spark, H, {2: 5, 3: 7}) == {1: 6, 2: 5, 3: 19, 5: 7}
    assert merged(spark, H, {}) == H == merged(spark, {}, H)
    assert merged(spark, {}, {}) == {}
    assert merged(spark, H, {3: 2**64 - 1, 9: 1}, errors="status") == "Overflow"
    assert merged(spark, {1: 2**64 - 1}, {1: 1}, checked=False) == {}
    assert merged(spark, {1: 2**32 - 1}, {1: 2}, checked=False, width=U32) == {1: 1}
    with pytest.raises(PySparkException, match="Overflow"):
        merged(spark, {1: 2**32 - 1}, {1: 1}, width=U32)


def test_differences_in_a_row(spark):
    sub = lambda b, **o: merged(spark, H, b, operation="subtract", **o)
    assert sub(H) == {} and sub({1: 5, 3: 9}) == {1: 1, 3: 3, 5: 7}
    assert sub({1: 4, 3: 13, 5: 7}, errors="status") == "Underflow"
    assert sub({1: 4, 5: 7, 7: 1}, errors="status") == sub({1: 4, 2: 1, 5: 7}, errors="status") == "InvalidSubset"
    # the lowest failing index decides
    assert sub({2: 1, 3: 13}, errors="status") == "InvalidSubset" and sub({3: 13, 4: 1}, errors="status") == "Underflow"
    assert sub({1: 10}, checked=False) == {1: 2**64 - 4, 3: 12, 5: 7}
    assert sub({2: 1}, checked=False, errors="status") == "InvalidSubset"
    with pytest.raises(ValueError):
        merged(spark, H, H, operation="?")


def test_keys_of_one_side_null_keys_and_bad_arrays(spark):
    x, y = pair(spark, {"a": {1: 1}, "b": {2: 2}}, {"b": {2: 3}, "c": {4: 4}})
    null = lambda df: df.withColumn("k", F.when(F.col("k") != "b", F.col("k")))
    got = {r.k: dict(zip(r.idx, map(int, r.cnt))) for r in merge_packed(null(x), null(y), ["k"], C).collect()}
    assert got == {"a": {1: 1}, None: {2: 5}, "c": {4: 4}}
    plan = merge_packed(x, y, ["k"], C)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "Aggregate" not in plan and "Generate" not in plan
    bad = spark.createDataFrame([("k", [3, 1], [1, 1])], "k string, idx array<long>, cnt array<long>")
    assert [r.status for r in merge_packed(bad, bad, ["k"], C, validate=True, errors="status").collect()] == ["IncompatibleParameters"]
    far = spark.createDataFrame([("k", [2**31], [1])], "k string, idx array<long>, cnt array<long>")
    assert [r.status for r in merge_packed(far, bad, ["k"], C, validate=True, errors="status").collect()] == ["OutOfRange"]


def test_random_merges_equal_dictionaries(spark):
    rng = random.Random(9)
    make = lambda: {i: rng.randint(1, 9) for i in sorted(rng.sample(range(200), rng.randint(0, 120)))}
    a, b = {f"{i}": make() for i in range(20)}, {f"{i}": make() for i in range(20)}
    x, y = pair(spark, a, b)
    got = {r.k: dict(zip(r.idx, map(int, r.cnt))) for r in merge_packed(x, y, ["k"], C).collect()}
    assert got == {k: {i: a[k].get(i, 0) + b[k].get(i, 0) for i in sorted({*a[k], *b[k]})} for k in a}
    assert all(list(v) == sorted(v) for v in got.values())
    both = merge_packed(x, y, ["k"], C)
    back = {r.k: dict(zip(r.idx, map(int, r.cnt))) for r in merge_packed(both, y, ["k"], C, operation="subtract").collect()}
    assert back == a


def cumulative(spark, *rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "k int, idx array<long>, cum array<long>")


def test_derived_columns(spark):
    df = cumulative(spark, ([0, 1, 2], [2, 5, 10]), ([384], [4]), ([], []))
    got = with_derived(df, C)
    assert [(r.k, r.total, r.mean) for r in got.orderBy("k").collect()] == [(0, 10, 1.3), (1, 4, 513.5), (2, 0, None)]
    assert sorted(checked_derived(got, C).collect()) == sorted(got.collect())
    forged = got.withColumn("mean", F.when(F.col("k") == 1, 1.0).otherwise(F.col("mean"))).withColumn("total", F.when(F.col("k") == 0, F.lit(9).cast("long")).otherwise(F.col("total")))
    assert {r.k: r.status for r in checked_derived(forged, C, errors="status").collect()} == {0: "IncompatibleParameters", 1: "IncompatibleParameters", 2: None}
    with pytest.raises(PySparkException, match="IncompatibleParameters"):
        checked_derived(forged, C).collect()
    falling = with_derived(cumulative(spark, ([1, 2], [5, 3])), C)
    assert [r.status for r in checked_derived(falling, C, errors="status").collect()] == ["IncompatibleParameters"]
    wide = widen_derived(got, C)
    assert dict(wide.dtypes)["cum"] == "array<decimal(20,0)>" and [(r.k, r.mean) for r in wide.orderBy("k").collect()] == [(0, 1.3), (1, 513.5), (2, None)]


def test_the_mean_is_added_up_in_order(spark, cells):
    rows = with_derived(to_packed(cumulate(cells, ["k"]), ["k"], C, count="cum"), C).collect()
    for r in rows:
        total, before = 0.0, 0
        for i, c in zip(r.idx, r.cum):
            total += (float(C.lower(i)) + float(C.upper(i))) / 2 * float(c - before)
            before = c
        assert r.mean == total / float(r.total) and r.total == before


def test_equality_by_digests(spark, cells):
    key = ["k"]
    assert {(r.k, r.equal) for r in equality(cells.repartition(3), cells, key, C).collect()} == {(k, True) for k in ("long", None, "short", "one")}
    wide = cells.select("k", "idx", F.col("cnt").cast("decimal(20,0)").alias("cnt")).unionByName(spark.createDataFrame([("short", 3000, 0), ("nothing", 1, 0)], "k string, idx long, cnt long"))
    assert {r.equal for r in equality(cells, wide, key, C).collect()} == {True}
    assert {r.equal for r in equality(cells, cells, key, C, Config(7, 33)).collect()} == {False}
    changed = cells.withColumn("cnt", F.col("cnt") + F.when(F.col("k").isNull() & (F.col("idx") > 1000), 1).otherwise(0)).where("k is null or k <> 'one'")
    got = {r.k: r.equal for r in equality(cells, changed, key, C).collect()}
    assert got == {"long": True, None: False, "short": True, "one": False}
    first = {r.k: (r.idx, int(r.left_cnt), int(r.right_cnt)) for r in first_differences(cells, changed, key, C).collect()}
    least = cells.where("k is null and idx > 1000").orderBy("idx").first()
    only = cells.where("k = 'one'").first()
    assert first == {None: (least.idx, least.cnt, least.cnt + 1), "one": (only.idx, 1, 0)}
    assert {(r.k, r.idx) for r in first_differences(cells, cells, key, C, Config(7, 33)).collect()} == {(k, None) for k in ("long", None, "short", "one")}
    assert digests(cells, key, C).count() == 4 and equality(cells.limit(0), cells.limit(0), key, C).count() == 0
    mixed = cells.withColumns({"p": F.lit(7), "n": F.lit(32)})
    assert {r.equal for r in equality(mixed, cells, key, None, C).collect()} == {True}


def test_functions_in_sql(spark, cells):
    sql_functions.register(spark)
    for c in (Config(0, 1), Config(2, 4), Config(7, 63), Config(14, 40)):
        vs = [v for k in range(c.n) for v in (2**k - 1, 2**k, 2**k + 1) if v <= c.max_value]
        rows = [(v, c.index(v), c.lower(c.index(v)), c.upper(c.index(v))) for v in vs]
        spark.createDataFrame(rows, "v long, i long, lo long, hi long").createOrReplaceTempView("cases")
        wrong = spark.sql(f"SELECT * FROM cases WHERE bucket_checked(v, {c.p}, {c.n}) <> i OR bucket_lower(i, {c.p}) <> lo OR bucket_upper(i, {c.p}, {c.n}) <> hi")
        assert wrong.count() == 0
        assert spark.sql(f"SELECT bucket_count({c.p}, {c.n}) AS b, bucket_error({c.p}, {c.n}) AS e").first()[:] == (c.total_buckets, c.error)
    with pytest.raises(PySparkException, match="OutOfRange"):
        spark.sql("SELECT bucket_checked(8, 1, 3)").collect()
    to_packed(cumulate(cells, ["k"]), ["k"], C, count="cum").createOrReplaceTempView("kept")
    got = spark.sql("SELECT k, q.* FROM kept, LATERAL bucket_quantiles(kept.idx, kept.cum, array(0D, 0.5D, 1D), 7, 32) q").collect()
    want = quantiles(cells, ["k"], [0, 0.5, 1], C).collect()
    assert sorted(((r.k, r.q, r.lo, r.hi, r.cnt, r.total) for r in got), key=repr) == sorted(((r.k, r.q, r.bucket.lo, r.bucket.hi, r.bucket["count"], r.total) for r in want), key=repr)
    plan = spark.sql("SELECT bucket_index(v, 7) FROM cases")._jdf.queryExecution().optimizedPlan().toString()
    assert "bucket_index" not in plan.split("AS")[0]
