"""Whether two sets of distributions are equal, by digests: one aggregation a side, and a join of one row a distribution.

A digest does not depend on the order of cells: it is the sum of two independent 64-bit hashes of each (p, n, idx, cnt), beside the number of buckets and the
total. Counters are hashed as numbers, so a width does not matter; buckets that count nothing do not either.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bucketing import Config

PARTS = ["nnz", "total", "h1", "h2"]


def _parameters(config: Config | None) -> list[Column]:
    return [F.col("p").cast("int"), F.col("n").cast("int")] if config is None else [F.lit(config.p), F.lit(config.n)]


def digests(cells: DataFrame, keys: list[str], config: Config | None = None) -> DataFrame:
    """(keys..., nnz, total, h1, h2). Without ``config`` the cells bring their parameters as p and n."""
    count = F.col("cnt").cast("decimal(20,0)")
    hashed = lambda seed: F.sum(F.xxhash64(F.lit(seed), *_parameters(config), F.col("idx").cast("long"), count).cast("decimal(20,0)"))
    some = cells.where("cnt <> 0")
    return some.groupBy(*keys).agg(F.count("*").alias("nnz"), F.sum(count).alias("total"), hashed(1).alias("h1"), hashed(2).alias("h2"))


def _same(keys: list[str]) -> Column:
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"a.`{k}`").eqNullSafe(F.col(f"b.`{k}`"))
    return on


def equality(a: DataFrame, b: DataFrame, keys: list[str], config: Config | None = None, other: Config | None = None) -> DataFrame:
    """(keys..., equal) of every distribution of either side; one that the other side lacks is equal to it only if it counts nothing, and such have no
    rows. Distributions of different parameters are not equal."""
    other = config if other is None else other
    x, y = digests(a, keys, config).alias("a"), digests(b, keys, other).alias("b")
    met = x.join(y, _same(keys), "full") if keys else x.crossJoin(y)
    key = lambda k: F.when(F.col("a.nnz").isNotNull(), F.col(f"a.`{k}`")).otherwise(F.col(f"b.`{k}`")).alias(k)
    equal = F.lit(True)
    for c in PARTS:
        equal = equal & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    return met.select(*map(key, keys), equal.alias("equal")) if keys else met.select(equal.alias("equal"))


def first_differences(a: DataFrame, b: DataFrame, keys: list[str], config: Config | None = None, other: Config | None = None) -> DataFrame:
    """(keys..., idx, left_cnt, right_cnt): of every distribution that is not equal, the first bucket whose counters differ (0 where a side has none); a null idx
    where all counters agree and the parameters do not. Only cells of unequal distributions are compared."""
    unequal = equality(a, b, keys, config, other).where("not equal").alias("u")
    none, count = F.lit(0).cast("decimal(20,0)"), F.col("cnt").cast("decimal(20,0)")
    mine = lambda cells, x, y: cells.where("cnt <> 0").select(*keys, F.col("idx").cast("long").alias("idx"), x.alias("left_cnt"), y.alias("right_cnt"))
    both = mine(a, count, none).unionByName(mine(b, none, count))
    sums = both.groupBy(*keys, "idx").agg(F.sum("left_cnt").cast("decimal(20,0)").alias("left_cnt"), F.sum("right_cnt").cast("decimal(20,0)").alias("right_cnt"))
    differ = F.col("left_cnt") != F.col("right_cnt")
    first = sums.groupBy(*keys).agg(F.min(F.when(differ, F.struct("idx", "left_cnt", "right_cnt"))).alias("d")).alias("f")
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"u.`{k}`").eqNullSafe(F.col(f"f.`{k}`"))
    return unequal.join(first, on, "left").select(*(F.col(f"u.`{k}`").alias(k) for k in keys), "d.idx", "d.left_cnt", "d.right_cnt")
