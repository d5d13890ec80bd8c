"""Continuous recording. The functions take batch or streaming DataFrames alike.

``windowed_counts`` with tumbling windows is snapshot-and-reset by event time: a window's counts are given out once, after the watermark has passed
its end, and its state goes. ``drain_batches`` does the same by micro-batch. The running snapshot that keeps counting is a plain ``record`` in
complete output mode, or ``running_cells``; what was recorded between two stored snapshots is their difference, ``deltas``.

Values beyond the range, by ``invalid``: ``"drop"`` leaves them out, ``"flag"`` counts them under a null idx, ``"raise"`` fails the query.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.bucketing import Config
from ..functions.width import U64, CounterWidth
from ..operators.algebra import settled
from ..operators.cells import record


def _timed(df: DataFrame, ts: str, delay: str) -> DataFrame:
    """``ts`` as a timestamp with time zone, which watermarks need."""
    timed = df.withColumn(ts, F.col(ts).cast("timestamp"))
    return timed.withWatermark(ts, delay) if df.isStreaming else timed


def _values(df: DataFrame, keys: list[str], ts: str, value: Column, weight: Column | None, delay: str) -> DataFrame:
    return _timed(df.select(*keys, ts, value.alias("v"), (F.lit(1) if weight is None else weight).alias("w")), ts, delay)


def _counted(weighted: bool, width: CounterWidth) -> Column:
    """Rows, or their weights, added up as counters of a width do: sums wrap. Plain counts of 64 bits are longs."""
    if not weighted:
        return F.count("*") if width is U64 else width.wrapped(F.count("*"))
    return width.wrapped(F.sum(F.col("w").cast("decimal(20,0)")))


def _indexed(rows: DataFrame, config: Config, invalid: str) -> DataFrame:
    """Rows of values that are not null, with their bucket as ``idx``."""
    if invalid not in ("raise", "drop", "flag"):
        raise ValueError(f"invalid={invalid!r}")
    good = config.accepts(F.col("v"))
    if invalid == "drop":
        return rows.where(good).withColumn("idx", config.index_of(F.col("v")))
    other = F.raise_error(F.lit("OutOfRange")).cast("long") if invalid == "raise" else F.lit(None).cast("long")
    return rows.where("v is not null").withColumn("idx", F.when(good, config.index_of(F.col("v"))).otherwise(other))


def windowed_counts(
    df: DataFrame, keys: list[str], ts: str, value: Column, config: Config, *, weight: Column | None = None, width: CounterWidth = U64, every: str = "1 day", slide: str | None = None, delay: str = "10 minutes", invalid: str = "drop"
) -> DataFrame:
    """(keys..., start, end, idx, cnt) per tumbling, or with ``slide`` sliding, window of event time. Rows later than the watermark are left out, values
    beyond the range go by ``invalid``. Counters wrap at ``width``."""
    rows = _indexed(_values(df, keys, ts, value, weight, delay), config, invalid)
    w = F.window(ts, every, slide) if slide else F.window(ts, every)
    counted = rows.groupBy(*keys, w.alias("t"), "idx").agg(_counted(weight is not None, width).alias("cnt")).withColumnRenamed("t", "w")
    return counted.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "idx", "cnt")


def session_cells(df: DataFrame, keys: list[str], ts: str, value: Column, config: Config, *, weight: Column | None = None, width: CounterWidth = U64, gap: str = "30 minutes", invalid: str = "drop") -> DataFrame:
    """(keys..., start, end, idx, cnt) per session of a batch DataFrame: a session ends where ``gap`` passes without a row. Counters wrap at ``width``.

    Time is cut into slots as long as the gap, so the rows of one slot belong together, and are counted by slot and bucket with partial sums before anything
    is shuffled. Sessions are then merged from the slots, of which a key has no more than its time holds gaps, and the counts of a session's slots added."""
    rows = _indexed(_values(df, keys, ts, value, weight, "0 seconds"), config, invalid)
    length = F.expr(f"unix_micros(timestamp_micros(0) + INTERVAL '{gap}')")
    at = F.unix_micros(ts)
    placed = rows.where(F.col(ts).isNotNull()).select(*keys, "idx", "w", at.alias("_at"), F.floor(at / length).cast("long").alias("_slot"))
    total = F.count("*") if weight is None else F.sum(F.col("w").cast("decimal(20,0)"))
    counted = placed.groupBy(*keys, "_slot", "idx").agg(total.alias("c"), F.min("_at").alias("_a"), F.max("_at").alias("_z"))
    slots = counted.groupBy(*keys, "_slot").agg(F.min("_a").alias("_a"), F.max("_z").alias("_z"))
    order = Window.partitionBy(*keys).orderBy("_slot")
    fresh = F.coalesce((F.col("_a") - F.lag("_z").over(order) > length).cast("int"), F.lit(1))
    merged = slots.withColumn("_fresh", fresh).withColumn("_session", F.sum("_fresh").over(order))
    whole = Window.partitionBy(*keys, "_session")
    ends = merged.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_slot").alias("_s"), F.min("_a").over(whole).alias("_start"), (F.max("_z").over(whole) + length).alias("_end"))
    same = F.col("_slot") == F.col("_s")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    sums = counted.join(ends, same).groupBy(*keys, F.timestamp_micros("_start").alias("start"), F.timestamp_micros("_end").alias("end"), "idx").agg(F.sum("c").alias("c"))
    cnt = F.col("c") if weight is None and width is U64 else width.wrapped(F.col("c"))
    return sums.select(*keys, "start", "end", "idx", cnt.alias("cnt"))


def session_counts(df: DataFrame, keys: list[str], ts: str, value: Column, config: Config, *, weight: Column | None = None, width: CounterWidth = U64, gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """(keys..., start, end, counts) per session: a map from index to count, or sum of weights modulo the width. Batch DataFrames are counted by
    ``session_cells``. Of a stream, which can be aggregated by sessions only once, a session's values (8 bytes, or 16 with a weight) are one row of its state
    until the session ends; they are sorted once and cut where the index changes."""
    if not df.isStreaming:
        cells = session_cells(df, keys, ts, value, config, weight=weight, width=width, gap=gap)
        return cells.groupBy(*keys, "start", "end").agg(F.map_from_entries(F.collect_list(F.struct("idx", "cnt"))).alias("counts"))
    rows = _indexed(_values(df, keys, ts, value, weight, delay), config, "drop")
    entry = F.struct(F.col("idx").alias("i"), F.col("w").cast("decimal(20,0)").alias("w"))
    listed = rows.groupBy(*keys, F.session_window(ts, gap).alias("t")).agg(F.sort_array(F.collect_list(entry)).alias("e"))
    first = F.filter(F.transform("e", lambda x, j: F.when((j == 0) | (F.get("e", j - 1)["i"] != x["i"]), j)), lambda j: j.isNotNull())
    listed = listed.select(*keys, "t", "e", first.alias("f"))

    def run(j: Column, at: Column) -> Column:
        size = F.coalesce(F.get("f", at + 1), F.size("e")) - j
        if weight is None and width is U64:
            return F.struct(F.get("e", j)["i"], size.cast("long"))
        add = lambda a, x: (a + x["w"]).cast("decimal(38,0)")
        return F.struct(F.get("e", j)["i"], width.wrapped(F.aggregate(F.slice("e", j + 1, size), F.lit(0).cast("decimal(38,0)"), add)))

    return listed.select(*keys, F.col("t.start").alias("start"), F.col("t.end").alias("end"), F.map_from_entries(F.transform("f", run)).alias("counts"))


def drain_batches(stream: DataFrame, keys: list[str], value: Column, config: Config, sink: Callable[[DataFrame, int], None], *, weight: Column | None = None, width: CounterWidth = U64, invalid: str = "drop", **options: str) -> StreamingQuery:
    """Give the counts of each micro-batch to ``sink`` and start again from nothing: no value is lost or given out twice. A batch that
    is repeated after a failure comes with the same number. Counters wrap at ``width``; values beyond the range go by ``invalid``."""

    def drain(batch: DataFrame, number: int) -> None:
        ones = F.lit(1) if weight is None and width is not U64 else weight
        sink(record(batch, keys, value, config, weight=ones, width=width, invalid=invalid), number)

    writer = stream.writeStream.foreachBatch(drain).trigger(availableNow=True)
    for k, v in options.items():
        writer = writer.option(k, v)
    return writer.start()


def deltas(snapshots: DataFrame, keys: list[str], at: str, *, checked: bool = True, width: CounterWidth = U64, errors: str = "raise") -> DataFrame:
    """(keys..., at, idx, cnt) recorded since the snapshot before, from snapshots (keys..., at, idx, cnt) of running counts. A bucket that is missing in
    a snapshot counts as it did before. A counter that falls, as after a reset, is an Underflow: it fails the query, or with
    ``errors="status"`` names the first such bucket's error by (keys..., at, status); unchecked differences wrap at the width."""
    before = F.lag("cnt").over(Window.partitionBy(*keys, "idx").orderBy(at))
    grown = F.col("cnt").cast("decimal(38,0)") - F.coalesce(before, F.lit(0)).cast("decimal(38,0)")
    rows = snapshots.select(*keys, at, "idx", grown.alias("d"))
    if not checked:
        return rows.select(*keys, at, "idx", width.wrapped(F.col("d")).alias("cnt")).where("cnt <> 0")
    error = F.when(F.col("d") < 0, F.lit("Underflow"))
    out = settled(rows, [*keys, at], F.col("d"), error, dict(snapshots.dtypes)["cnt"], errors)
    return out if errors == "status" else out.where("cnt <> 0")
