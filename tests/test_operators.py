import random
from decimal import Decimal

import pytest
from binfall.errors import IncompatibleParameters, InvalidPercentile, InvalidQuantile
from binfall.functions import U32, Config
from binfall.operators import *  # noqa: F403
from binfall.operators import footprint
from binfall.operators.cells import validate_packed
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

C = Config(7, 62)
MAX = 2**64 - 1


def made(spark, cells, key="a"):
    return spark.createDataFrame([(key, i, Decimal(c)) for i, c in cells.items()], "k string, idx long, cnt decimal(20,0)")


def got(df):
    return {r.idx: int(r.cnt) for r in df.collect()}


def recorded(spark, values, config=C, **options):
    return record(spark.createDataFrame([(v,) for v in values], "v long"), [], F.col("v"), config, **options)


def spread(df):
    return {r.q: (r.bucket.lo, r.bucket.hi, r.bucket["count"], r.total) for r in df.collect()}


def test_recorded_quantiles(spark):
    qs = [0, 0.25, 0.5, 0.75, 0.9, 0.99, 0.999]
    found = spread(quantiles(recorded(spark, range(101)), [], qs, C))
    assert found == {q: (v, v, 1, 101) for q, v in zip(qs, [0, 25, 50, 75, 90, 99, 100])}
    assert spread(quantiles(recorded(spark, [*range(101), 1024]), [], [0.999], C))[0.999][:3] == (1024, 1031, 1)
    assert spread(quantiles(recorded(spark, [10, 4]), [], [0], C))[0][:2] == (4, 4)


def test_quantile_requests(spark):
    cells = recorded(spark, [42])
    assert len(quantiles(cells, [], [0.5, 0.5, 0.99, 0.99], C).collect()) == 2
    assert quantiles(cells, [], [], C).count() == 0
    empty = recorded(spark, [])
    assert quantiles(empty, [], [0.5], C).count() == 0
    for q in (-1.0, 1.01, float("nan"), float("inf")):
        with pytest.raises(InvalidQuantile):
            quantiles(empty, [], [q], C)
    with pytest.raises(InvalidPercentile):
        percentiles(empty, [], [101], C)
    assert len(quantiles(cells, [], [0.0, -0.0], C).collect()) == 1


def test_ranks_beyond_the_total(spark):
    big = made(spark, {1: 2**53 + 3})
    assert quantiles(big, ["k"], [1.0], C).count() == 1
    assert quantiles(big, ["k"], [1.0], C, strict=True).count() == 0


def test_forms_agree(spark):
    c = Config(4, 10)
    cells = recorded(spark, range(1, 1024), c).withColumn("k", F.lit("a"))
    qs = [0.1 * i for i in range(11)]
    want = spread(quantiles(cells, ["k"], qs, c))
    dense = dense_to_cells(to_dense(cells, ["k"], c), ["k"], "counts", c)
    packed = packed_to_cells(to_packed(cells, ["k"], c), ["k"], c)
    cumulative = cumulative_to_cells(cumulate(cells, ["k"]), ["k"])
    assert len(want) == 11
    for form in (dense, packed, cumulative):
        assert spread(quantiles(form, ["k"], qs, c)) == want


def test_invalid_values(spark):
    small = Config(1, 3)
    with pytest.raises(PySparkException):
        recorded(spark, [1, 8], small).collect()
    assert got(recorded(spark, [1, 8, -1, None], small, invalid="drop")) == {1: 1}
    assert got(recorded(spark, [1, 8, -1], small, invalid="flag")) == {1: 1, None: 2}


def test_weights_wrap(spark):
    rows = spark.createDataFrame([(1, 2**32 - 1), (1, 1), (2, 3), (2, 3)], "v long, w long")
    assert got(record(rows, [], F.col("v"), Config(2, 4), weight=F.col("w"), width=U32)) == {2: 6}


def test_addition(spark):
    a = made(spark, {1: 6, 3: 12, 5: 7})
    assert got(add(a, made(spark, {2: 5, 3: 7}), ["k"], C)) == {1: 6, 2: 5, 3: 19, 5: 7}
    with pytest.raises(PySparkException, match="Overflow"):
        add(a, made(spark, {3: MAX}), ["k"], C).collect()
    assert add(a, made(spark, {3: MAX}), ["k"], C, errors="status").first().status == "Overflow"
    assert got(add(made(spark, {1: MAX}), made(spark, {1: 1}), ["k"], C, checked=False)) == {}
    with pytest.raises(IncompatibleParameters):
        add(a, a, ["k"], C, Config(7, 32))


def test_subtraction(spark):
    a = made(spark, {1: 6, 3: 12, 5: 7})

    def status(b, **options):
        return subtract(a, made(spark, b), ["k"], C, errors="status", **options).first().status

    assert got(subtract(a, made(spark, {1: 5, 3: 9}), ["k"], C, form="sparse")) == {1: 1, 3: 3, 5: 7}
    assert got(subtract(a, a, ["k"], C, form="sparse")) == {}
    assert got(subtract(a, a, ["k"], C)) == {1: 0, 3: 0, 5: 0}
    assert status({1: 4, 3: 13, 5: 7}, form="sparse") == "Underflow"
    assert status({1: 4, 5: 7, 7: 1}, form="sparse") == status({1: 4, 2: 1, 5: 7}, form="sparse") == "InvalidSubset"
    assert status({2: 1, 3: 13}, form="sparse") == "InvalidSubset" and status({3: 13, 7: 1}, form="sparse") == "Underflow"
    assert status({2: 1}) == "Underflow" and status({1: 1}) is None
    assert got(subtract(a, made(spark, {1: 10}), ["k"], C, form="sparse", checked=False))[1] == 2**64 - 4
    with pytest.raises(PySparkException, match="InvalidSubset"):
        subtract(a, made(spark, {2: 1}), ["k"], C, form="sparse", checked=False).collect()
    assert got(subtract(made(spark, {1: 1}), made(spark, {1: MAX}), ["k"], C, checked=False)) == {1: 2}


def test_downsample_error_bound(spark):
    rng = random.Random(42)
    values = sorted(rng.randrange(1, 2**32) for _ in range(10_000))
    fine = Config(8, 32)
    cells = recorded(spark, values, fine)
    for p in range(7, 1, -1):
        coarse = Config(p, 32)
        lower = downsample(cells, [], fine, p)
        assert got(lower) == got(recorded(spark, values, coarse))
        for q, (lo, hi, *_) in spread(quantiles(lower, [], [0.2, 0.5, 0.9, 0.99, 1.0], coarse)).items():
            exact = values[max(1, -(-int(q * 10**6) * len(values) // 10**6)) - 1]
            assert lo <= exact <= hi and (hi - exact) * 100 / exact <= coarse.error
    with pytest.raises(IncompatibleParameters):
        downsample(cells, [], fine, 8)


def test_validation_of_packed_arrays(spark):
    n = Config(7, 32)
    cases = [
        ([1, 3], [1], None), ([1, 2**32 - 1], [1, 1], "OutOfRange"), ([3, 1], [1, 1], None), ([1, 1], [1, 1], None), ([1, 2], [1, 0], None), ([2**32 - 1, 1], [1, 1], "OutOfRange"),
    ]
    for idx, cnt, want in cases:
        row = spark.createDataFrame([(idx, cnt)], "idx array<long>, cnt array<long>")
        assert row.select(validate_packed(F.col("idx"), F.col("cnt"), n).alias("e")).first().e == (want or "IncompatibleParameters")
    good = spark.createDataFrame([([1, 3, 5], [5, 5, 9])], "idx array<long>, cnt array<long>")
    falls = spark.createDataFrame([([1, 3], [5, 3])], "idx array<long>, cnt array<long>")
    assert good.select(validate_packed(F.col("idx"), F.col("cnt"), n, cumulative=True).alias("e")).first().e is None
    assert falls.select(validate_packed(F.col("idx"), F.col("cnt"), n, cumulative=True).alias("e")).first().e == "IncompatibleParameters"
    with pytest.raises(PySparkException, match="Incompatible"):
        packed_to_cells(spark.createDataFrame([([3, 1], [1, 1])], "idx array<long>, cnt array<long>"), [], n).collect()


def test_dense_lengths(spark):
    c = Config(1, 3)
    rows = spark.createDataFrame([("a", [0, 1, 0, 2, 0, 0]), ("b", [1, 2]), ("c", None)], "k string, counts array<long>")
    assert [(r.k, r.idx, r.cnt) for r in dense_to_cells(rows, ["k"], "counts", c, invalid="drop").collect()] == [("a", 1, 1), ("a", 3, 2)]
    with pytest.raises(PySparkException, match="Incompatible"):
        dense_to_cells(rows, ["k"], "counts", c).collect()
    assert dense_buckets(made(spark, {1: 5}), ["k"], c).count() == 6
    with pytest.raises(IncompatibleParameters):
        dense_buckets(made(spark, {1: 5}), ["k"], Config(26, 64))


def test_cumulative(spark):
    cells = made(spark, {1: 6, 3: 12, 5: 7})
    assert [(r.idx, int(r.cum), int(r.total)) for r in cumulate(cells, ["k"]).orderBy("idx").collect()] == [(1, 6, 25), (3, 18, 25), (5, 25, 25)]
    ranged = with_quantile_ranges(made(spark, {1: 10, 3: 30, 5: 60}), ["k"], C)
    assert [(r.lower_q, r.upper_q) for r in ranged.orderBy("idx").collect()] == [(0, 0.1), (0.1, 0.4), (0.4, 1)]
    assert bucket_quantile_range(made(spark, {1: 10, 3: 30, 5: 60}), ["k"], 3, C).count() == 0


def test_mean(spark):
    assert mean(made(spark, {0: 2, 1: 3, 2: 5}), ["k"], C).first().mean == pytest.approx(1.3)
    assert mean(made(spark, {384: 4}), ["k"], C).first().mean == 513.5
    assert mean(recorded(spark, []), [], C).first().mean is None
    assert totals(recorded(spark, []), []).first().total == 0


def test_null_keys_and_large_counts(spark):
    rows = spark.createDataFrame([(None, 1, 6), (None, 3, 12), ("b", 2, 5)], "k string, idx long, cnt long")
    c = Config(1, 3)
    assert {r.k: r.counts for r in to_dense(rows, ["k"], c).collect()} == {None: [0, 6, 0, 12, 0, 0], "b": [0, 0, 5, 0, 0, 0]}
    assert {(r.k, r.idx, int(r.cnt)) for r in subtract(rows, rows, ["k"], c).collect()} == {(None, 1, 0), (None, 3, 0), ("b", 2, 0)}
    assert [r.k for r in is_empty(rows.where("k is null"), rows, ["k"]).collect()] == ["b"]
    assert to_dense(recorded(spark, [], c), [], c).first().counts == [0] * 6
    assert mean(made(spark, {384: MAX}), ["k"], C).first().mean == 513.5
    assert mean(made(spark, {0: 10**18, 2: 10**18}), ["k"], C).first().mean == 1.0


def test_mean_of_counts_beyond_a_counter(spark):
    """Weights that add up to more than 64 bits hold: no bucket is wrapped, and the mean is that of the whole sums."""
    rows = spark.range(4000).select(F.when(F.col("id") % 4 == 0, 5_000_000).otherwise(7).alias("v"))
    weight = F.lit(str(10**16)).cast("decimal(20,0)")
    heavy = record(rows, [], F.col("v"), C, weight=weight, width=None)
    assert got(heavy) == {7: 3000 * 10**16, C.index(5_000_000): 1000 * 10**16}
    assert mean(heavy, [], C).first().mean == mean(record(rows, [], F.col("v"), C), [], C).first().mean
    assert got(record(rows, [], F.col("v"), C, weight=weight))[7] == 3000 * 10**16 % 2**64
    longest = [(0, Decimal(10**30 - 1)), (1, Decimal(2**96)), (4, Decimal(10**30 - 1)), (6, Decimal(3))]
    wide = spark.createDataFrame(longest, "idx long, cnt decimal(30,0)")
    assert mean(wide, [], C).first().mean == pytest.approx(sum(i * int(n) for i, n in longest) / sum(int(n) for _, n in longest), rel=1e-15)


def test_overwriting_and_levels(spark):
    a = made(spark, {1: 6, 3: 12, 5: 7})
    assert got(overwrite(a, made(spark, {1: 0, 3: 4, 7: 9}), ["k"], C)) == {3: 4, 5: 7, 7: 9}
    with pytest.raises(PySparkException, match="OutOfRange"):
        overwrite(a, made(spark, {10**6: 1}), ["k"], C).collect()
    both = spark.createDataFrame([("a", None, 1, 2), ("a", "x", 1, 3), (None, "x", 1, 4)], "f string, s string, idx long, cnt long")
    found = sorted(((r.level, r.f, r.s, r.cnt) for r in rolled_up(both, ["f", "s"]).collect()), key=str)
    assert found == sorted([(0, None, None, 9), (1, "a", None, 5), (1, None, None, 4), (2, "a", None, 2), (2, "a", "x", 3), (2, None, "x", 4)], key=str)


def test_extremes_and_emptiness(spark):
    r = extremes(recorded(spark, [42]), [], C).first()
    assert r.min_bucket == r.max_bucket and (r.min_bucket.lo, r.total) == (42, 1)
    assert extremes(recorded(spark, []), [], C).count() == 0
    owners = spark.createDataFrame([("a",), ("b",)], "k string")
    assert [r.k for r in is_empty(made(spark, {1: 1}), owners, ["k"]).collect()] == ["b"]


def test_widths(spark):
    with pytest.raises(PySparkException, match="Overflow"):
        narrow(made(spark, {1: 2**32}), ["k"]).collect()
    each_fits = made(spark, {0: 3 * 10**9, 1: 2 * 10**9})
    assert narrow(each_fits, ["k"], errors="status").first().status is None
    assert narrow_total(each_fits, ["k"], errors="status").first().status == "Overflow"
    with pytest.raises(PySparkException, match="Overflow"):
        narrow_total(each_fits, ["k"]).collect()
    assert [r.cum for r in narrow_total(made(spark, {1: 100, 3: 200}), ["k"]).orderBy("idx").collect()] == [100, 300]


def test_footprint(spark):
    r = spark.createDataFrame([([0, 1, 0, 2, 0, 0],)], "c array<long>").select(*footprint.sizes(F.col("c"), F.lit(6))).first()
    assert (r.nnz, r.dense_bytes, r.sparse_bytes, r.cumulative_bytes) == (2, 96, 104, 120)
    assert footprint.truncation_saving(Config(8, 32), 10) == 768
    assert [x.s for x in spark.createDataFrame([(10,), (2048,), (3 * 2**20,)], "b long").select(footprint.human(F.col("b")).alias("s")).collect()] == ["      10  B", "    2.00 KiB", "    3.00 MiB"]
    assert spark.range(1).select(footprint.shortened(F.lit("abcdef"), 4).alias("s")).first().s == "abcd"


def test_plan_pushes_filters_and_counts_before_the_shuffle(spark):
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").where("l_quantity > 10")
    plan = record(lines, ["l_returnflag"], F.round(F.col("l_extendedprice") * 100).cast("long"), C)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,10.0)" in plan and "partial_count" in plan and "Python" not in plan
