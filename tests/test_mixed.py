import random
from decimal import Decimal
from itertools import product

import pytest
from binfall.functions import U32, Config, RowConfig
from binfall.operators import add_mixed, align, buckets, dense_to_mixed, downsample_mixed, extremes, mean, mixed_to_dense, quantiles, record, record_mixed, same_configs, subtract_aligned, to_dense
from binfall.plans.queries import QUERIES
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

CONFIGS = [Config(0, 1), Config(0, 64), Config(2, 4), Config(7, 64), Config(14, 64), Config(8, 63), Config(20, 32), Config(26, 40)]


def values(c):
    rng = random.Random(c.p * 100 + c.n)
    near = [v for k in range(c.n + 1) for v in (2**k - 2, 2**k - 1, 2**k, 2**k + 1) if 0 <= v <= c.max_value]
    return near + [rng.getrandbits(rng.randint(1, c.n)) for _ in range(60)]


def test_columns_equal_the_fixed_configuration(spark):
    D = Decimal
    rows = [(c.p, c.n, D(v), c.index(v), D(c.lower(c.index(v))), D(c.upper(c.index(v))), c.total_buckets, c.error) for c in CONFIGS for v in values(c)]
    df = spark.createDataFrame(rows, "p int, n int, v decimal(20,0), i long, lo decimal(20,0), hi decimal(20,0), total long, error double")
    for wide in (True, False):
        c = RowConfig(wide=wide)
        at = df if wide else df.where("n < 64")
        idx = c.index_of(F.col("v"))
        wrong = at.where((idx != F.col("i")) | (c.lower_of(F.col("i")) != F.col("lo")) | (c.upper_of(F.col("i")) != F.col("hi")) | (c.total_buckets_of() != F.col("total")) | (c.error_of() != F.col("error")) | ~c.accepts(F.col("v")))
        assert wrong.count() == 0 and at.count() > 200
    assert df.where(RowConfig(wide=True).accepts(F.col("v") + F.pow(F.lit(2.0), F.col("n")).cast("decimal(20,0)"))).count() == 0


def test_parameters_that_are_no_configuration(spark):
    rows = [(7, 64), (7, 65), (4, 4), (-1, 4), (None, 3), (3, None), (31, 60), (30, 60), (26, 40)]
    named = spark.createDataFrame(rows, "p int, n int").select(RowConfig(wide=True).error_name().alias("e")).collect()
    assert [r.e for r in named] == [None, "MaxPowerTooHigh", "MaxPowerTooLow", "MaxPowerTooLow", "IncompatibleParameters", "IncompatibleParameters", "IncompatibleParameters", "IncompatibleParameters", None]
    (r,) = spark.createDataFrame([(7, 64)], "p int, n int").select(RowConfig().error_name().alias("e"), RowConfig().equals(Config(7, 64)).alias("s"), RowConfig().equals(Config(7, 63)).alias("o")).collect()
    assert (r.e, r.s, r.o) == ("MaxPowerTooHigh", True, False)
    with pytest.raises(PySparkException, match="MaxPowerTooLow"):
        record_mixed(spark.createDataFrame([(4, 4, 1)], "p int, n int, v long"), [], F.col("v")).collect()


@pytest.fixture(scope="module")
def raw(spark):
    rng = random.Random(5)
    pairs = [(5, 30), (3, 40), (6, 20)]
    rows = [(k, *rng.choice(pairs), rng.randint(0, 2**20 - 1)) for k, _ in product(["x", None, "y"], range(300))]
    return rows, spark.createDataFrame(rows, "k string, p int, n int, v long")


def counted(df):
    return sorted(((r.k, r.p, r.n, r.idx, int(r.cnt)) for r in df.collect()), key=repr)


def expected(rows, c):
    out = {}
    for k, _, _, v in rows:
        out[k, c.p, c.n, c.index(v)] = out.get((k, c.p, c.n, c.index(v)), 0) + 1
    return sorted(((*key, n) for key, n in out.items()), key=repr)


def test_aligned_rows_are_as_if_recorded_together(spark, raw):
    rows, df = raw
    cells = record_mixed(df, ["k"], F.col("v"))
    c = Config(3, 40)
    assert counted(align(cells, ["k"])) == expected(rows, c)
    assert [r.status for r in same_configs(cells, ["k"]).collect()] == ["IncompatibleParameters"] * 3
    assert [r.status for r in same_configs(align(cells, ["k"]), ["k"]).collect()] == [None] * 3
    plain = record(df, ["k"], F.col("v"), c)
    wide = align(record_mixed(df, ["k"], F.col("v").cast("decimal(20,0)"), RowConfig(wide=True)), ["k"], wide=True)
    assert counted(wide) == expected(rows, c)
    keys, got = ["k", "p", "n"], align(cells, ["k"])
    same = lambda a, b: sorted(map(repr, (r.asDict() for r in a.drop("p", "n").collect()))) == sorted(map(repr, (r.asDict() for r in b.collect())))
    assert same(quantiles(got, keys, [0, 0.3, 1], RowConfig()), quantiles(plain, ["k"], [0, 0.3, 1], c))
    assert same(buckets(got, keys, RowConfig()), buckets(plain, ["k"], c))
    assert same(extremes(got, keys, RowConfig()), extremes(plain, ["k"], c))
    assert same(mean(got, keys, RowConfig()), mean(plain, ["k"], c))


def test_add_and_subtract(spark, raw):
    rows, df = raw
    cells = record_mixed(df, ["k"], F.col("v"))
    a, b = cells.where("p = 5"), cells.where("p <> 5")
    c = Config(3, 40)
    assert counted(add_mixed(a, b, ["k"], mismatch="align")) == expected(rows, c)
    assert {(r.k, r.status) for r in add_mixed(a, b, ["k"], errors="status").collect()} == {(k, "IncompatibleParameters") for k in ("x", "y", None)}
    with pytest.raises(PySparkException, match="IncompatibleParameters"):
        add_mixed(a, b, ["k"]).collect()
    assert [x[:4] + (x[4] // 2,) for x in counted(add_mixed(a, a, ["k"]))] == counted(a)
    left = subtract_aligned(cells, b, ["k"], form="sparse")
    assert counted(left) == expected([r for r in rows if r[1] == 5], c)
    full = spark.createDataFrame([("x", 2, 4, 1, 2**32 - 1)], "k string, p tinyint, n tinyint, idx long, cnt long")
    assert [r.status for r in add_mixed(full, full, ["k"], width=U32, errors="status").collect()] == ["Overflow"]
    assert [int(r.cnt) for r in add_mixed(full, full, ["k"], width=U32, checked=False).collect()] == [2**32 - 2]
    with pytest.raises(ValueError):
        add_mixed(a, b, ["k"], mismatch="?")


def test_downsampling_by_row(spark, raw):
    rows, df = raw
    cells = record_mixed(df, ["k"], F.col("v"))
    got = counted(downsample_mixed(cells, ["k"], F.col("p") - F.when(F.col("p") == 3, 0).otherwise(2)))
    want = counted(record_mixed(df.withColumn("p", F.when(F.col("p") == 3, 3).otherwise(F.col("p") - 2)), ["k"], F.col("v")))
    assert got == want
    with pytest.raises(PySparkException, match="IncompatibleParameters"):
        downsample_mixed(cells, ["k"], F.col("p") + 1).collect()


def test_dense_arrays_of_different_lengths(spark):
    df = spark.createDataFrame([("x", 1, 3, 6), ("x", 1, 3, 1), ("y", 0, 2, 3)], "k string, p int, n int, v long")
    cells = record_mixed(df, ["k"], F.col("v"))
    dense = mixed_to_dense(cells, ["k"])
    assert {(r.k, r.p, r.n, tuple(r.counts)) for r in dense.collect()} == {("x", 1, 3, (0, 1, 0, 0, 0, 1)), ("y", 0, 2, (0, 0, 1))}
    assert counted(dense_to_mixed(dense, ["k"])) == counted(cells)
    bad = spark.createDataFrame([("x", 1, 3, [1] * 6), ("x", 1, 3, [1] * 5), ("x", 3, 3, [1]), ("x", 1, 3, None), ("y", 1, 3, [None, 2, 0, 0, 0, 0])], "k string, p int, n int, counts array<long>")
    assert len(counted(dense_to_mixed(bad, ["k"], invalid="drop"))) == 7
    with pytest.raises(PySparkException, match="IncompatibleParameters|MaxPowerTooLow"):
        dense_to_mixed(bad, ["k"]).collect()


@pytest.mark.parametrize("fixed", [True, False])
def test_null_indices_have_no_place_in_arrays(spark, fixed):
    df = spark.createDataFrame([("x", 1, 3, 6), ("x", 1, 3, 8), ("y", 1, 3, 9), (None, 1, 3, 1)], "k string, p int, n int, v long")
    c = Config(1, 3)
    if fixed:
        dense = to_dense(record(df, ["k"], F.col("v"), c, invalid="flag"), ["k"], c)
    else:
        dense = mixed_to_dense(record_mixed(df, ["k"], F.col("v"), invalid="flag"), ["k"])
    assert {(r.k, r.p, r.n, tuple(r.counts)) for r in dense.collect()} == {("x", 1, 3, (0, 0, 0, 0, 0, 1)), (None, 1, 3, (0, 1, 0, 0, 0, 0))}
    none = to_dense(record(df.where("v > 7"), [], F.col("v"), c, invalid="flag"), [], c)
    assert none.first().counts == [0] * 6


def test_the_index_is_worked_out_once(spark):
    """No filter on the index is pushed below the recording: the loop over the rows stays under the 8000 bytes that HotSpot compiles."""
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = QUERIES["mixed_dense_roundtrip"](spark, "/root/testdata/sf0.001")
        parts = df._jdf.queryExecution().debug().codegenToSeq()
        assert max(parts.apply(i)._3().maxMethodCodeSize() for i in range(parts.size())) < 8000
        assert not [x for x in df._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Filter" in x and "LOG2" in x]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def test_layouts_by_row(spark):
    from binfall.operators.footprint import layout, layouts, truncation_saving, truncation_saving_of

    configs = [Config(0, 1), Config(8, 40), Config(2, 5), Config(7, 63)]
    df = spark.createDataFrame([(i, c.p, c.n) for i, c in enumerate(configs)], "i int, p int, n int")
    got = sorted((r.i, r.grp, r.width, r.lo, r.hi, r.n_buckets) for r in layouts(df).collect())
    assert got == sorted((i, r.grp, r.width, r.lo, r.hi, r.n_buckets) for i, c in enumerate(configs) for r in layout(spark, c).collect())
    c = Config(8, 32)
    powers = spark.range(21).select("id", truncation_saving_of(F.lit(8), F.col("id")).alias("s")).collect()
    assert all(r.s == truncation_saving(c, r.id) for r in powers)
