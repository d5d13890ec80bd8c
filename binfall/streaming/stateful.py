"""A recorder that keeps running: counters live in a streaming query's state, and are given out on request, or when a timer ends, without or with being reset.

Every row is a ``record`` of one value, or asks for a ``load`` (the counters, which go on counting) or a ``drain`` (the counters, which begin again at nothing).
Counters are a map state, bucket by bucket, in RocksDB; a batch changes only the buckets that it meets. Counts, resets and what was given out are committed with
the batch, so a query that starts again from its checkpoint neither loses nor repeats one. ``snapshot`` reads the state of a running query from
beside it, as of its last batch or an earlier one.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.bucketing import Config
from ..functions.width import U64, CounterWidth

STATE, PROVIDER = "cells", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PART = "_part"
RECORD, LOAD, DRAIN, OUT_OF_RANGE = "record", "load", "drain", "out_of_range"


def use_rocksdb(spark: SparkSession) -> None:
    """Queries started from now on keep their state in RocksDB, which this kind of state needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


class CellsProcessor(StatefulProcessor):
    """Counters of one distribution, or of the part of its buckets that falls to one state key."""

    def __init__(self, keys: list[str], bits: int, every: int | None, timed: str):
        self.keys, self.modulus, self.every, self.timed = keys, 1 << bits, every, timed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.cells = handle.getMapState(STATE, "idx long", "cnt decimal(20,0)")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        for idx, cnt in zip(initialState["idx"], initialState["cnt"], strict=True):
            self._add(int(idx), int(cnt))

    def _add(self, idx: int, more: int) -> None:
        held = self.cells.getValue((idx,)) if self.cells.containsKey((idx,)) else None
        total = ((int(held[0]) if held else 0) + more) % self.modulus
        if total:
            self.cells.updateValue((idx,), (Decimal(total),))
        elif held:
            self.cells.removeKey((idx,))

    def _rows(self, key, event: str, tag: int | None, cells: list[tuple[int | None, int]]) -> pd.DataFrame:
        n = len(cells)
        fixed = {k: [v] * n for k, v in zip(self.keys, key, strict=False)}
        return pd.DataFrame({**fixed, "event": [event] * n, "tag": pd.array([tag] * n, "Int64"), "idx": pd.array([i for i, _ in cells], "Int64"), "cnt": [Decimal(c) for _, c in cells]})

    def _given(self, key, event: str, tag: int | None) -> Iterator[pd.DataFrame]:
        held = sorted((int(k[0]), int(v[0])) for k, v in self.cells.iterator())
        if event == DRAIN:
            self.cells.clear()
        if held:
            yield self._rows(key, event, tag, held)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        sums: dict[int, int] = {}
        beyond, asked = 0, []
        for part in rows:
            values = part[part["event"] == RECORD]
            beyond += int(values["idx"].isna().sum())
            for idx, high, low in values.dropna(subset="idx").groupby("idx")[["high", "low"]].sum().itertuples():
                sums[int(idx)] = sums.get(int(idx), 0) + (int(high) << 32) + int(low)
            others = part[part["event"] != RECORD]
            asked += [(e, None if pd.isna(t) else int(t)) for e, t in zip(others["event"], others["tag"], strict=True)]
        for idx, more in sums.items():
            self._add(idx, more)
        if self.every is not None and not any(True for _ in self.handle.listTimers()):
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.every)
        if beyond:
            yield self._rows(key, OUT_OF_RANGE, None, [(None, beyond)])
        # loads before drains, each once for every tag
        for event, tag in sorted(set(asked), key=lambda x: (x[0] == DRAIN, x[1] is not None, x[1] or 0)):
            yield from self._given(key, event, tag)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.every)
        yield from self._given(key, self.timed, at)

    def close(self) -> None:
        pass


def running_cells(
    stream: DataFrame,
    keys: list[str],
    value: Column,
    config: Config,
    *,
    weight: Column | None = None,
    width: CounterWidth = U64,
    event: Column | None = None,
    tag: Column | None = None,
    every: int | None = None,
    timed: str = DRAIN,
    initial: DataFrame | None = None,
    parts: int = 1,
) -> DataFrame:
    """(keys..., event, tag, idx, cnt), to be written in append mode, of a stream whose rows record ``value`` or, as ``event`` says, ask: load, drain.

    An answer holds what its batch has recorded and before, a row per bucket, with the request's ``tag``; a distribution without counts has no rows. Values beyond
    the range change no counter: their number is given out at once as an ``out_of_range`` row of their key. Null values are left out. Sums wrap at the width. With
    ``every`` (milliseconds) each key's counters are also given out when that time has passed, as ``timed`` says, tagged with the time. ``initial`` (keys..., idx, cnt)
    is what a new query's counters begin with, for instance another query's ``snapshot``. ``parts`` deals a distribution's buckets to so many states, so that a
    hot key is many tasks; answers of the parts do not overlap. Needs ``use_rocksdb``.
    """
    if timed not in (LOAD, DRAIN) or parts < 1:
        raise ValueError(f"timed={timed!r}, parts={parts}")
    kind = F.lit(RECORD) if event is None else event
    rows = stream.select(*keys, kind.alias("event"), (F.lit(None) if tag is None else tag).cast("long").alias("tag"), value.alias("v"), (F.lit(1) if weight is None else weight).cast("decimal(20,0)").alias("w"))
    rows = rows.where((F.col("event") != RECORD) | F.col("v").isNotNull())
    index = F.when((F.col("event") == RECORD) & config.accepts(F.col("v")), config.index_of(F.col("v")))
    half = F.lit(1 << 32).cast("decimal(20,0)")
    low = F.pmod(F.col("w"), half)
    weighed = [((F.col("w") - low) / half).cast("long").alias("high"), low.cast("long").alias("low")]
    placed = rows.select(*keys, "event", "tag", index.alias("idx"), *weighed)
    of = lambda idx: F.pmod(F.xxhash64(idx), F.lit(parts)).cast("int")
    own = F.when(F.col("event") == RECORD, F.array(of("idx"))).otherwise(F.sequence(F.lit(0), F.lit(parts - 1)))
    dealt = placed.withColumn(PART, F.explode(own))
    state = None
    if initial is not None:
        state = initial.select(*keys, "idx", F.col("cnt").cast("decimal(20,0)").alias("cnt"), of("idx").alias(PART)).groupBy(*keys, PART)
    kinds = dict(stream.dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "event string", "tag long", "idx long", "cnt decimal(20,0)"])
    processor = CellsProcessor(keys, width.value, every, timed)
    return dealt.groupBy(*keys, PART).transformWithStateInPandas(processor, schema, "Append", "None" if every is None else "ProcessingTime", state)


def snapshot(spark: SparkSession, checkpoint: str, keys: list[str], *, batch: int | None = None) -> DataFrame:
    """(keys..., idx, cnt): the counters in the state of a query of ``running_cells``, running or not, as they were after its last committed batch, or after
    ``batch``. The state is read from the query's checkpoint, so recording goes on meanwhile."""
    reader = spark.read.format("statestore").option("stateVarName", STATE)
    state = (reader if batch is None else reader.option("batchId", batch)).load(checkpoint)
    return state.select(*(F.col(f"key.`{k}`") for k in keys), F.col("user_map_key.idx").alias("idx"), F.col("user_map_value.cnt").alias("cnt"))


def window_snapshot(spark: SparkSession, checkpoint: str, keys: list[str], *, batch: int | None = None) -> DataFrame:
    """(keys..., start, end, idx, cnt): the windows that a query of ``windowed_counts`` still holds, that is those that the watermark has not passed (in
    complete mode, all)."""
    reader = spark.read.format("statestore")
    state = (reader if batch is None else reader.option("batchId", batch)).load(checkpoint)
    names = state.schema["key"].dataType.names
    window, index = names[len(keys)], names[len(keys) + 1]
    value = state.schema["value"].dataType.names[0]
    columns = [F.col(f"key.`{n}`").alias(k) for n, k in zip(names, keys, strict=False)]
    return state.select(*columns, F.col(f"key.`{window}`.start").alias("start"), F.col(f"key.`{window}`.end").alias("end"), F.col(f"key.`{index}`").alias("idx"), F.col(f"value.`{value}`").alias("cnt"))
