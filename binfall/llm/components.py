"""Connected components by alternating large-star and small-star contraction, all in shuffles.

Each round is two aggregations and two joins over the edges; rounds grow with the logarithm of the number of nodes. The
edges of every round are checkpointed, so a lost executor costs one round at most. The edges of one node meet its least neighbour in one task.
"""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files that nothing needs after a checkpoint: it does so when the driver's garbage collectors find them
    unused, which else may be long after an iterative job has filled the disks."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Most rows of ids (some 8 bytes each) that are broadcast.
BROADCAST_ROWS = 500_000


def sent(ids: DataFrame) -> DataFrame:
    """Rows of ids (written down, as they are counted) to join with others: a short list goes to the others, a long one meets them in a shuffle."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids


def _large_star(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small_star(e: DataFrame) -> DataFrame:
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    moved = e.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``component``, the least node reachable from it, for every node with an edge other than to itself."""
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct().checkpoint()
    state = None
    while True:
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
        if now == state or not now.n:
            break
        state = now
        e = _small_star(_large_star(e)).distinct().checkpoint()
        release(edges.sparkSession)
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
