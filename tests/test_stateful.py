import time

import pytest
from binfall.functions import U32, U64, Config
from binfall.operators import record
from binfall.streaming import running_cells, snapshot, use_rocksdb, windowed_counts, window_snapshot
from pyspark.sql import functions as F

C = Config(2, 10)
SCHEMA = "k string, event string, tag long, v long, w decimal(20,0)"


@pytest.fixture
def home(spark, tmp_path):
    use_rocksdb(spark)
    yield tmp_path
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def put(spark, home, rows):
    spark.createDataFrame([(*r, *[None] * (5 - len(r))) for r in rows], SCHEMA).coalesce(1).write.mode("append").parquet(str(home / "in"))


def values(key, numbers):
    from decimal import Decimal

    return [(key, "record", None, v, Decimal(1)) for v in numbers]


def stream(spark, home, **options):
    return spark.readStream.schema(SCHEMA).options(**options).parquet(str(home / "in"))


def cells(spark, home, **more):
    return running_cells(stream(spark, home), ["k"], F.col("v"), C, event=F.col("event"), tag=F.col("tag"), **more)


def run(spark, home, df, name="cp"):
    """What is given out by a query that goes through everything new and ends."""
    before = spark.read.parquet(str(home / "out" / name)).count() if (home / "out" / name).exists() else 0
    q = df.writeStream.format("parquet").option("checkpointLocation", str(home / name)).trigger(availableNow=True).start(str(home / "out" / name))
    q.awaitTermination(120)
    rows = spark.read.parquet(str(home / "out" / name)).collect()
    assert len(rows) >= before
    return {(r.event, r.tag, r.k, r.idx): int(r.cnt) for r in rows}


def want(numbers):
    out = {}
    for v in numbers:
        out[C.index(v)] = out.get(C.index(v), 0) + 1
    return out


def only(got, event, tag, key):
    return {i: c for (e, t, k, i), c in got.items() if (e, t, k) == (event, tag, key)}


def test_loads_and_drains_over_restarts(spark, home):
    a, b, c = list(range(100)), [5, 5, 700, 1023], [1, 99]
    put(spark, home, values("x", a) + values(None, b) + [("x", "load", 1), (None, "load", 1), ("empty", "load", 1)])
    got = run(spark, home, cells(spark, home, parts=3))
    assert only(got, "load", 1, "x") == want(a) and only(got, "load", 1, None) == want(b) and not only(got, "load", 1, "empty")
    # begun again: counts go on, and a drain resets
    put(spark, home, values("x", b + [1024, -1, None]) + [("x", "load", 2), ("x", "drain", 2), (None, "load", 2)])
    got = run(spark, home, cells(spark, home, parts=3))
    assert only(got, "load", 2, "x") == only(got, "drain", 2, "x") == want(a + b) and only(got, "load", 2, None) == want(b)
    # of three values two are beyond the range and one is null: no counter changes
    assert sum(n for (e, *_), n in got.items() if e == "out_of_range") == 2
    put(spark, home, values("x", c) + [("x", "load", 3), (None, "drain", 3)])
    got = run(spark, home, cells(spark, home, parts=3))
    assert only(got, "load", 3, "x") == want(c) and only(got, "drain", 3, None) == want(b)
    # the state holds what was not drained, now and at earlier batches
    state = lambda **o: {(r.k, r.idx): int(r.cnt) for r in snapshot(spark, str(home / "cp"), ["k"], **o).collect()}
    assert state() == {("x", i): n for i, n in want(c).items()}
    assert state(batch=0) == {("x", i): n for i, n in want(a).items()} | {(None, i): n for i, n in want(b).items()}


def test_widths_weights_and_widening(spark, home):
    from decimal import Decimal

    heavy = [("x", "record", None, 7, Decimal(2**32 - 1)), ("x", "record", None, 9, Decimal(2**31)), ("x", "load", 1)]
    put(spark, home, heavy)
    got = run(spark, home, cells(spark, home, weight=F.col("w"), width=U32), "narrow")
    assert only(got, "load", 1, "x") == {7: 2**32 - 1, C.index(9): 2**31}
    # the narrow query's counters are where a wide one begins, and go on past 32 bits
    old = snapshot(spark, str(home / "narrow"), ["k"])
    wide = lambda first: running_cells(spark.readStream.schema(SCHEMA).parquet(str(home / "in2")), ["k"], F.col("v"), C, weight=F.col("w"), width=U64, event=F.col("event"), tag=F.col("tag"), initial=first)
    spark.createDataFrame([("x", "record", None, 7, Decimal(5)), ("y", "record", None, 9, Decimal(2**64 - 1)), ("y", "record", None, 9, Decimal(3)), ("x", "load", 2, None, None), ("y", "load", 2, None, None)], SCHEMA).write.parquet(str(home / "in2"))
    got = run(spark, home, wide(old), "wide")
    assert only(got, "load", 2, "x") == {7: 2**32 + 4, C.index(9): 2**31} and only(got, "load", 2, "y") == {C.index(9): 2}
    # 32 bits wrap; a counter that comes to nothing goes
    put(spark, home, [("x", "record", None, 7, Decimal(1)), ("x", "record", None, 9, Decimal(5)), ("x", "load", 2)])
    got = run(spark, home, cells(spark, home, weight=F.col("w"), width=U32), "narrow")
    assert only(got, "load", 2, "x") == {C.index(9): 2**31 + 5}


def test_timers_drain_by_themselves(spark, home):
    put(spark, home, values("x", [1, 2, 3]))
    df = cells(spark, home, every=500)
    q = df.writeStream.format("memory").queryName("timed").option("checkpointLocation", str(home / "t")).trigger(processingTime="200 milliseconds").start()
    try:
        # (a query with such timers never has nothing to do, so one cannot wait for that)
        end = time.monotonic() + 90
        while spark.table("timed").count() < 3 and time.monotonic() < end:
            time.sleep(0.5)
        rows = spark.table("timed").where("k = 'x'").collect()
    finally:
        q.stop()
    assert {(r.event, r.idx, int(r.cnt)) for r in rows} == {("drain", i, 1) for i in (1, 2, 3)} and len({r.tag for r in rows}) == 1


def test_a_snapshot_in_mid_stream(spark, home):
    """While a query runs, its state is the batch over what it has committed."""
    put(spark, home, values("x", range(50)))
    q = cells(spark, home).writeStream.format("noop").option("checkpointLocation", str(home / "mid")).trigger(processingTime="100 milliseconds").start()
    try:
        q.processAllAvailable()
        for more in (range(900, 950), range(30)):
            put(spark, home, values("x", more) + values("z", more))
            q.processAllAvailable()
            assert q.isActive
            seen = snapshot(spark, str(home / "mid"), ["k"])
            batch = record(spark.read.parquet(str(home / "in")), ["k"], F.col("v"), C)
            assert sorted((r.k, r.idx, int(r.cnt)) for r in seen.collect()) == sorted(map(tuple, batch.collect()))
    finally:
        q.stop()


def test_the_windows_that_a_query_holds(spark, home):
    rows = [("x", f"2024-01-0{d} {h:02}:00:00", v) for d in (1, 2, 3) for h in (1, 13) for v in (1, 5, 5, 99)]
    df = spark.createDataFrame(rows, "k string, ts string, v long").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    df.write.parquet(str(home / "w"))
    source = spark.readStream.schema(df.schema).parquet(str(home / "w"))
    q = windowed_counts(source, ["k"], "ts", F.col("v"), C, delay="30 days").writeStream.format("memory").queryName("held").outputMode("complete").option("checkpointLocation", str(home / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    seen = window_snapshot(spark, str(home / "c"), ["k"])
    assert sorted(seen.collect()) == sorted(windowed_counts(df, ["k"], "ts", F.col("v"), C).collect()) and seen.count() == 9


def test_arguments(spark, home):
    put(spark, home, values("x", [1]))
    for bad in ({"timed": "?"}, {"parts": 0}):
        with pytest.raises(ValueError):
            cells(spark, home, **bad)
