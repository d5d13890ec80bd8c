"""Times the headline queries: one cold run each, then three warm ones of which the median counts. Prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from binfall.functions import Config
from binfall.operators import downsample, quantiles, record, subtract, to_dense
from binfall.plans.queries import QUERIES

HEADLINE = ["record_counts", "record_weighted", "quantiles_by_flag", "merge_checked", "subtract_checked", "downsample", "mean_midpoint", "iter_with_quantiles", "rollup_quantiles", "dense_roundtrip", "drain_windows", "footprint_rollup"]


def larger(spark: SparkSession) -> dict[str, DataFrame]:
    """The same work on 20 million generated values under a hundred keys, a third of them under one; not part of the total."""
    config = Config(7, 62)
    key = F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 100)
    rows = spark.range(20_000_000).select(key.alias("k"), F.pmod(F.xxhash64("id"), F.lit(10**9)).alias("v"))
    cells = record(rows, ["k"], F.col("v"), config)
    half = record(rows.where("v % 2 = 0"), ["k"], F.col("v"), config)
    return {
        "record_20m": cells,
        "quantiles_20m": quantiles(cells, ["k"], [0.5, 0.99], config),
        "downsample_20m": downsample(cells, ["k"], config, 4),
        "subtract_20m": subtract(cells, half, ["k"], config),
        "dense_20m": to_dense(cells, ["k"], config),
    }


def timed(run) -> float:
    runs = []
    for _ in range(4):
        start = time.perf_counter()
        run().write.format("noop").mode("overwrite").save()
        runs.append(time.perf_counter() - start)
    return round(statistics.median(runs[1:]), 4)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {name: timed(lambda: QUERIES[name](spark, sf_dir)) for name in HEADLINE}
    more = {name: timed(lambda: larger(spark)[name]) for name in larger(spark)}
    spark.stop()
    print(json.dumps({"metric": "headline queries, median of 3 warm runs, total", "value": round(sum(took.values()), 4), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")), "cpus": int(cpus), "larger": more}))


if __name__ == "__main__":
    main()
