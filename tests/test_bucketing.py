import random

import pytest
from binfall.errors import IncompatibleParameters, MaxPowerTooHigh, MaxPowerTooLow, OutOfRange
from binfall.functions import Config
from pyspark.sql import functions as F


def test_bucket_counts():
    assert [Config(p, n).total_buckets for p, n in ((2, 64), (7, 64), (14, 64), (2, 4), (7, 32), (8, 32), (10, 64))] == [252, 7424, 835584, 12, 3328, 6400, 56320]


def test_invalid_configurations():
    with pytest.raises(MaxPowerTooHigh):
        Config(2, 65)
    for p, n in ((3, 3), (4, 3), (0, 0), (-1, 3)):
        with pytest.raises(MaxPowerTooLow):
            Config(p, n)
    with pytest.raises(IncompatibleParameters):
        Config(30, 64)


def test_known_indices_and_bounds():
    c = Config(7, 64)
    index = {0: 0, 1: 1, 256: 256, 257: 256, 258: 257, 512: 384, 515: 384, 516: 385, 1024: 512, 1031: 512, 1032: 513, 2**64 - 2: 7423, 2**64 - 1: 7423}
    assert {v: c.index(v) for v in index} == index
    assert [c.lower(i) for i in (0, 1, 256, 384, 512, 7423)] == [0, 1, 256, 512, 1024, 18374686479671623680]
    assert [c.upper(i) for i in (0, 1, 256, 384, 512, 7423)] == [0, 1, 257, 515, 1031, 2**64 - 1]
    assert [Config(9, 64).index(v) for v in (1, 1023, 1024, 2048, 2052)] == [1, 1023, 1024, 1536, 1537]
    with pytest.raises(OutOfRange):
        Config(2, 4).index(16)


def test_error():
    assert Config(7, 64).error == 0.78125 and Config(3, 4).error == 0 and Config(0, 8).error == 100


def edges(n):
    return sorted({v for k in range(n + 1) for v in range(2**k - 3, 2**k + 4) if 0 <= v < 2**n})


@pytest.mark.parametrize(("p", "n"), [(0, 1), (0, 62), (1, 3), (2, 63), (7, 62), (14, 62)])
def test_columns_equal_the_model(spark, p, n):
    c = Config(p, n)
    values = edges(n) + [random.Random(1).randrange(2**n) for _ in range(500)]
    rows = spark.createDataFrame([(v,) for v in values], "v long").select("v", c.index_of(F.col("v")).alias("i"))
    rows = rows.select("v", "i", c.lower_of(F.col("i")).alias("lo"), c.upper_of(F.col("i")).alias("hi")).collect()
    for r in rows:
        assert r.i == c.index(r.v) and (r.lo, r.hi) == (c.lower(r.i), c.upper(r.i)) and r.lo <= r.v <= r.hi


@pytest.mark.parametrize("p", [0, 7, 20])
def test_the_whole_unsigned_range(spark, p):
    from decimal import Decimal

    c = Config(p, 64)
    rows = spark.createDataFrame([(Decimal(v),) for v in edges(64)], "v decimal(20,0)").select("v", c.index_of(F.col("v")).alias("i"))
    for r in rows.select("v", "i", c.lower_of(F.col("i")).alias("lo"), c.upper_of(F.col("i")).alias("hi")).collect():
        assert r.i == c.index(int(r.v)) and (r.lo, r.hi) == (c.lower(r.i), c.upper(r.i))


def test_downsampling_commutes_with_recording():
    fine = Config(7, 40)
    for p in range(7):
        coarse = fine.downsampled(p)
        assert all(coarse.index(fine.lower(fine.index(v))) == coarse.index(v) for v in edges(40))
    with pytest.raises(IncompatibleParameters):
        fine.downsampled(7)
