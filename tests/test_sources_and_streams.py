import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from binfall.errors import IncompatibleParameters
from binfall.functions import U32, Config
from binfall.operators import dense_to_cells, record, to_dense, to_packed
from binfall.operators.footprint import report, sizes
from binfall.sources import form_schema, from_json, read_recordings, recorded_columns, to_json, write_recordings
from binfall.streaming import deltas, drain_batches, session_cells, session_counts, windowed_counts
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

C = Config(1, 3)


def test_recordings_written_by_others(spark, tmp_path):
    meta = {"metric_type": "distribution", "grouping_power": "1", "max_value_power": "3"}
    lists = pa.list_(pa.uint64())
    schema = pa.schema([pa.field("a", lists, metadata=meta), pa.field("b", lists, metadata={"metric_type": "distribution"}), pa.field("c", pa.int64()), pa.field("d", lists, metadata={**meta, "grouping_power": "9"})])
    good = [0, 1, 0, 2**64 - 1, 0, 0]
    table = pa.table([[good, None, [1, 2], [0, None, 1, 0, 0, 0, 5]], [good] * 4, [1] * 4, [good] * 4], schema=schema)
    pq.write_table(table, tmp_path / "r.parquet")
    got = read_recordings(spark, str(tmp_path / "r.parquet"))
    assert [(r.column, r.p, r.n, [int(x) for x in r.counts]) for r in got.collect()] == [("a", 1, 3, good), ("a", 1, 3, [0, 1, 0, 0, 0, 5])]
    stats = report(got.select("column", *sizes(F.col("counts"), F.lit(6))), ["column"]).collect()
    assert {r.column: (r.samples, r.min_nnz, r.max_nnz) for r in stats} == {"a": (2, 2, 2), None: (2, 2, 2)}
    # files of one folder may differ in columns and parameters; lists of other types are passed over
    nested = tmp_path / "more" / "deep er"
    nested.mkdir(parents=True)
    pq.write_table(table.select(["a", "c"]), tmp_path / "more" / "1.parquet")
    other = pa.schema([pa.field("a", lists, metadata={**meta, "max_value_power": "4"}), pa.field("e", lists, metadata=meta), pa.field("f", pa.list_(pa.int32()), metadata=meta)])
    pq.write_table(pa.table([[[1] * 8], [good], [[1] * 6]], schema=other), nested / "2.parquet")
    assert recorded_columns(spark, str(tmp_path / "more")) == {"a": [C, Config(1, 4)], "e": [C]}
    many = read_recordings(spark, str(tmp_path / "more"))
    assert sorted((r.column, r.n, len(r.counts)) for r in many.collect()) == [("a", 3, 6), ("a", 3, 6), ("a", 4, 8), ("e", 3, 6)]
    plan = many._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BatchScan") == 1 and "Join" not in plan and "Exchange" not in plan
    pq.write_table(table.select(["c"]), tmp_path / "none.parquet")
    with pytest.raises(IncompatibleParameters):
        read_recordings(spark, str(tmp_path / "none.parquet"))


def recording(n, seed, p=1, names=("a",)):
    meta = {"metric_type": "distribution", "grouping_power": str(p), "max_value_power": "3"}
    size = Config(p, 3).total_buckets
    return pa.table([[[(seed + i + j) % 5 for j in range(size)] for i in range(n)] for _ in names], schema=pa.schema([pa.field(c, pa.list_(pa.uint64()), metadata=meta) for c in names]))


def tasks_of(spark, df, run):
    """Tasks and jobs that an action took."""
    tracker, group = spark.sparkContext.statusTracker(), f"g{id(df)}"
    spark.sparkContext.setJobGroup(group, "")
    try:
        out = run(df)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    jobs = tracker.getJobIdsForGroup(group)
    return out, sum(tracker.getStageInfo(s).numTasks for j in jobs for s in tracker.getJobInfo(j).stageIds if tracker.getStageInfo(s))


def test_many_small_files_are_few_tasks(spark, tmp_path):
    for i in range(2000):
        pq.write_table(recording(1, i, p=i % 2, names=("a", "b") if i % 3 else ("c",)), tmp_path / f"{i:05}.parquet")
    (tmp_path / "_SUCCESS").touch()
    df = read_recordings(spark, str(tmp_path))
    got, tasks = tasks_of(spark, df, lambda d: d.select("column", "p", "n", "file", F.size("counts").alias("s")).collect())
    assert len(got) == 2 * 1333 + 667 and tasks == 1
    assert {(r.column, r.p, r.n, r.s) for r in got} == {(c, p, 3, Config(p, 3).total_buckets) for c in "abc" for p in (0, 1)}
    assert len({r.file for r in got}) == 2000
    many = read_recordings(spark, str(tmp_path), groupBytes="200000")
    assert tasks_of(spark, many, lambda d: d.count())[0] == len(got)


def test_files_and_columns_that_are_not_asked_for_stay_closed(spark, tmp_path):
    for i in range(6):
        pq.write_table(recording(4, i, p=i % 2, names=("a", "b")), tmp_path / f"{i}.parquet")
    df = read_recordings(spark, str(tmp_path))
    # one query's filters do not stay for the next
    assert [df.count(), df.where("column = 'a'").count(), df.count(), df.where("column = 'b' and p = 1").count()] == [48, 24, 48, 12]
    (tmp_path / "9.parquet").write_bytes(b"no parquet")
    assert read_recordings(spark, str(tmp_path), pathGlobFilter="[0-5].parquet", columns=["b"]).select("column", "p").distinct().count() == 2
    with pytest.raises(PySparkException):
        read_recordings(spark, str(tmp_path)).collect()
    assert read_recordings(spark, str(tmp_path), pathGlobFilter="[01].parquet", kind="distribution").count() == 16
    with pytest.raises(IncompatibleParameters):
        read_recordings(spark, str(tmp_path), kind="counter", pathGlobFilter="[01].parquet")


def test_a_large_file_is_dealt_out_in_ranges(spark, tmp_path):
    pq.write_table(recording(400, 0), tmp_path / "r.parquet", row_group_size=10)
    size = (tmp_path / "r.parquet").stat().st_size
    whole = read_recordings(spark, str(tmp_path)).collect()
    parts = read_recordings(spark, str(tmp_path), groupBytes=str(size // 7))
    assert sorted(parts.collect()) == sorted(whole) and len(whole) == 400
    assert parts.select(F.spark_partition_id().alias("i")).distinct().count() > 2


def test_stores_that_only_spark_opens(spark, tmp_path, monkeypatch):
    from binfall.sources import recordings

    pq.write_table(recording(5, 1, names=("a", "b")), tmp_path / "r.parquet")
    straight = read_recordings(spark, str(tmp_path)).drop("file").collect()
    monkeypatch.setattr(recordings, "OPENED", set())
    assert sorted(read_recordings(spark, str(tmp_path)).drop("file").collect()) == sorted(straight)
    assert recorded_columns(spark, str(tmp_path)) == {"a": [C], "b": [C]}
    assert read_recordings(spark, str(tmp_path), columns=["a"]).count() == 5


def cells_of(spark, values):
    return record(spark.createDataFrame([("x", v) for v in values], "k string, v long"), ["k"], F.col("v"), C)


def test_round_trips(spark, tmp_path):
    cells = cells_of(spark, [1, 1, 6])
    dense = to_dense(cells, ["k"], C)
    write_recordings(dense.select("k", F.col("counts").alias("h")), str(tmp_path / "own"), {"h": C})
    back = dense_to_cells(read_recordings(spark, str(tmp_path / "own")), ["column"], "counts", C)
    assert {(r.idx, int(r.cnt)) for r in back.collect()} == {(r.idx, r.cnt) for r in cells.collect()}
    packed = to_packed(cells, ["k"], C)
    schema = packed.drop("k").schema
    assert from_json(to_json(packed, ["k"]), ["k"], schema).collect() == packed.collect()
    assert [(r.idx, [int(c) for c in r.cnt]) for r in from_json(to_json(packed, ["k"]), ["k"], form_schema()).collect()] == [(r.idx, r.cnt) for r in packed.collect()]
    assert [[int(c) for c in r.counts] for r in from_json(to_json(dense, ["k"]), ["k"], form_schema("dense")).collect()] == [r.counts for r in dense.collect()]


def test_deltas_of_snapshots_with_gaps(spark):
    rows = [("x", 1, 0, 5), ("x", 2, 0, 5), ("x", 2, 1, 3), ("x", 3, 0, 9), ("x", 4, 1, 4)]
    got = deltas(spark.createDataFrame(rows, "k string, t int, idx long, cnt long"), ["k"], "t")
    assert sorted((r.t, r.idx, r.cnt) for r in got.collect()) == [(1, 0, 5), (2, 1, 3), (3, 0, 4), (4, 1, 1)]


def test_counters_that_fall(spark):
    rows = spark.createDataFrame([("x", 1, 0, 5), ("x", 2, 0, 3), ("x", 2, 1, 3), (None, 1, 0, 1)], "k string, t int, idx long, cnt long")
    with pytest.raises(PySparkException, match="Underflow"):
        deltas(rows, ["k"], "t").collect()
    assert sorted(((r.k, r.t, r.status) for r in deltas(rows, ["k"], "t", errors="status").collect()), key=str) == sorted([("x", 1, None), ("x", 2, "Underflow"), (None, 1, None)], key=str)
    wrapped = {(r.k, r.t, r.idx): int(r.cnt) for r in deltas(rows, ["k"], "t", checked=False).collect()}
    assert wrapped == {("x", 1, 0): 5, ("x", 2, 0): 2**64 - 2, ("x", 2, 1): 3, (None, 1, 0): 1}


def source(spark, tmp_path, rows):
    df = spark.createDataFrame(rows, "k string, ts string, v long").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), df


ROWS = [("x", f"2024-01-0{d} {h:02}:00:00", v) for d in (1, 2, 3) for h in (1, 13) for v in (1, 5, 5, 99)]


def test_stream_of_windows_equals_the_batch(spark, tmp_path):
    stream, batch = source(spark, tmp_path, ROWS)
    q = windowed_counts(stream, ["k"], "ts", F.col("v"), C, delay="30 days").writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = windowed_counts(batch, ["k"], "ts", F.col("v"), C)
    assert sorted(spark.table("windows").collect()) == sorted(want.collect()) and want.count() == 6


def test_drained_batches_lose_and_repeat_nothing(spark, tmp_path):
    stream, batch = source(spark, tmp_path, ROWS)
    got = []
    q = drain_batches(stream, ["k"], F.col("v"), C, lambda df, n: got.append([(r.idx, r.cnt) for r in df.collect()]), checkpointLocation=str(tmp_path / "cp"))
    q.awaitTermination(120)
    total = {}
    for part in got:
        for i, c in part:
            total[i] = total.get(i, 0) + c
    assert len(got) > 1 and total == {C.index(1): 6, C.index(5): 12}


def test_sessions(spark):
    rows = [("x", f"2024-01-01 00:{m:02}:00", 1 + m % 2) for m in (0, 10, 20, 55, 56)]
    df = spark.createDataFrame(rows, "k string, ts string, v long")
    got = session_counts(df, ["k"], "ts", F.col("v"), C).orderBy("start").collect()
    assert [r.counts for r in got] == [{1: 3}, {2: 1, 1: 1}]
    got = session_counts(df, ["k"], "ts", F.col("v"), C, weight=F.col("v") * 10).orderBy("start").collect()
    assert [r.counts for r in got] == [{1: 30}, {2: 20, 1: 10}]


def test_weights_and_width_of_a_drained_stream(spark, tmp_path):
    stream, _ = source(spark, tmp_path, ROWS)
    total = {}

    def sink(df, n):
        for r in df.collect():
            total[r.idx] = total.get(r.idx, 0) + r.cnt

    q = drain_batches(stream, ["k"], F.col("v"), C, sink, weight=F.col("v") * 2**31, width=U32, checkpointLocation=str(tmp_path / "cp"))
    q.awaitTermination(120)
    # per batch, sums wrap at 32 bits; those that wrap to nothing go
    assert set(total) <= {C.index(1), C.index(5)} and all(c % 2**31 == 0 for c in total.values())


def test_sessions_in_two_steps_equal_session_windows(spark):
    rng = random.Random(3)
    rows, at = [], 0
    for _ in range(400):
        at += rng.choice([1, 5, 59, 60, 61, 600, 601, 1200, 3601])
        rows.append((rng.choice(["x", None]), at, rng.choice([1, 2, 6, 9])))
    rows += [("late", 10**9, 1), ("late", 10**9 + 600, 1), ("late", 10**9 + 1201, 1), (None, None, 1)]
    df = spark.createDataFrame(rows, "k string, s long, v long").select("k", F.timestamp_seconds("s").alias("ts"), "v")
    got = session_cells(df, ["k"], "ts", F.col("v"), C, gap="10 minutes")
    plain = df.where("v < 8").groupBy("k", F.session_window("ts", "10 minutes").alias("t"), C.index_of(F.col("v")).alias("idx")).count()
    want = df.where("v < 8").groupBy("k", F.session_window("ts", "10 minutes").alias("t")).agg(F.collect_list("v").alias("all"))
    want = want.select("k", "t.start", "t.end", F.explode("all").alias("v")).groupBy("k", "start", "end", C.index_of(F.col("v")).alias("idx")).count()
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, map(tuple, want.collect()))) and plain.count() > 0
    assert got.where("k = 'late'").agg(F.sum("cnt")).first()[0] == 3
    maps = session_counts(df, ["k"], "ts", F.col("v"), C, gap="10 minutes")
    assert sorted(map(repr, maps.select("k", "start", "end", F.explode("counts").alias("idx", "cnt")).collect())) == sorted(map(repr, got.collect()))


def test_session_weights_of_64_bits(spark, tmp_path):
    rows = spark.createDataFrame([("x", f"2024-01-01 00:0{i}:00", 1) for i in range(2)], "k string, ts string, v long")
    heavy = F.lit(2**62).cast("decimal(20,0)")
    assert [{k: int(v) for k, v in r.counts.items()} for r in session_counts(rows, ["k"], "ts", F.col("v"), C, weight=heavy).collect()] == [{1: 2**63}]
    assert [{k: int(v) for k, v in r.counts.items()} for r in session_counts(rows, ["k"], "ts", F.col("v"), C, weight=heavy + 5, width=U32).collect()] == [{1: 10}]
    later = spark.createDataFrame([("x", "2024-01-02 00:00:00", 2)], "k string, ts string, v long")
    both = rows.unionByName(later).withColumn("ts", F.col("ts").cast("timestamp"))
    both.coalesce(1).write.parquet(str(tmp_path / "one"))
    stream = spark.readStream.schema(both.schema).parquet(str(tmp_path / "one"))
    q = session_counts(stream, ["k"], "ts", F.col("v"), C, weight=heavy).writeStream.format("memory").queryName("heavy").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [{k: int(v) for k, v in r.counts.items()} for r in spark.table("heavy").collect()] == [{1: 2**63}]


def test_a_hot_session_is_counted_before_it_is_shuffled(spark):
    rows = spark.range(300_000, numPartitions=8).select(F.lit("x").alias("k"), F.timestamp_seconds(F.col("id") % 3000).alias("ts"), (F.col("id") % 7).alias("v"))
    got = session_cells(rows, ["k"], "ts", F.col("v"), C, gap="30 minutes")
    assert sum(r.cnt for r in got.collect()) == 300_000 and got.select("start", "end").distinct().count() == 1
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "partial_count" in plan


def test_values_beyond_the_range_in_streams(spark, tmp_path):
    stream, batch = source(spark, tmp_path, ROWS)
    flagged = windowed_counts(batch, ["k"], "ts", F.col("v"), C, invalid="flag")
    assert sorted((r.idx is None, r.cnt) for r in flagged.where("idx is null").collect()) == [(True, 2)] * 3
    q = windowed_counts(stream, ["k"], "ts", F.col("v"), C, delay="30 days", invalid="flag").writeStream.format("memory").queryName("flagged").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(repr, spark.table("flagged").collect())) == sorted(map(repr, flagged.collect()))
    with pytest.raises(PySparkException, match="OutOfRange"):
        windowed_counts(batch, ["k"], "ts", F.col("v"), C, invalid="raise").collect()
    with pytest.raises(ValueError):
        windowed_counts(batch, ["k"], "ts", F.col("v"), C, invalid="?")
