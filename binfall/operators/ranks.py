"""Quantiles, means, ranges and iteration over cells.

A distribution has at most ``total_buckets`` cells, so the running sums go over bounded groups, after counting. Requested quantiles are literals: a
cell picks those that fall in it, without a join.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from ..errors import InvalidPercentile, InvalidQuantile
from ..functions.bucketing import Config


def checked_quantiles(values: list[float]) -> list[float]:
    """Sorted and distinct; anything outside 0 to 1 is refused. Negative zero is zero."""
    for q in values:
        if math.isnan(q) or not 0 <= q <= 1:
            raise InvalidQuantile(q)
    return sorted({float(q) + 0.0 for q in values})


def _sums(keys: list[str]) -> tuple[Column, Column]:
    part = Window.partitionBy(*keys)
    running = part.orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    return F.sum("cnt").over(running), F.sum("cnt").over(part)


def cumulate(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., idx, cnt, cum, total): running sums in order of the index, zero cells left out."""
    running, total = _sums(keys)
    return cells.where("cnt <> 0").select(*keys, "idx", "cnt", running.alias("cum"), total.alias("total"))


def individual_counts(cumulative: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., idx, cnt) of rows (keys..., idx, cum): differences of neighbours."""
    before = F.lag("cum").over(Window.partitionBy(*keys).orderBy("idx"))
    return cumulative.select(*keys, "idx", (F.col("cum") - F.coalesce(before, F.lit(0))).alias("cnt"))


def cumulative_to_cells(cumulative: DataFrame, keys: list[str]) -> DataFrame:
    return individual_counts(cumulative, keys).where("cnt <> 0")


def quantiles(cells: DataFrame, keys: list[str], values: list[float], config: Config, *, strict: bool = False) -> DataFrame:
    """(keys..., q, bucket, total): the bucket of the value of rank max(1, ceil(q * total)), the product in double precision. Empty distributions give
    no rows. Ranks that rounding lifts above the total take the last bucket; with ``strict`` they give no row."""
    qs = checked_quantiles(values)
    rows = cumulate(cells, keys)
    if not qs:
        return rows.select(*keys, F.lit(None).cast("double").alias("q"), config.bucket_of(F.col("idx"), F.col("cnt")).alias("bucket"), "total").where(F.lit(False))
    rank = lambda q: F.greatest(F.ceil(q * F.col("total").cast("double")), F.lit(1)).cast("decimal(38,0)")
    target = rank if strict else lambda q: F.least(rank(q), F.col("total").cast("decimal(38,0)"))
    inside = F.filter(F.array(*map(F.lit, qs)), lambda q: (target(q) > F.col("cum") - F.col("cnt")) & (target(q) <= F.col("cum")))
    picked = rows.select(*keys, "idx", "cnt", "total", F.explode(inside).alias("q"))
    return picked.select(*keys, "q", config.bucket_of(F.col("idx"), F.col("cnt")).alias("bucket"), "total")


def percentiles(cells: DataFrame, keys: list[str], values: list[float], config: Config) -> DataFrame:
    """As ``quantiles``, for numbers from 0 to 100: (keys..., percentile, bucket)."""
    for x in values:
        if math.isnan(x) or not 0 <= x <= 100:
            raise InvalidPercentile(x)
    back = {float(x) / 100 + 0.0: float(x) for x in values}
    names = F.create_map(*(F.lit(v) for pair in back.items() for v in pair)) if back else F.lit(None)
    found = quantiles(cells, keys, list(back), config)
    return found.select(*keys, F.element_at(names, F.col("q")).alias("percentile"), "bucket")


def _grouped(df: DataFrame, keys: list[str]):
    return df.groupBy(*keys) if keys else df.groupBy()


def extremes(cells: DataFrame, keys: list[str], config: Config) -> DataFrame:
    """(keys..., total, min_bucket, max_bucket): the first and last bucket that count something."""
    some = cells.where("cnt <> 0")
    cell = F.struct("idx", "cnt")
    r = _grouped(some, keys).agg(F.sum("cnt").alias("total"), F.min(cell).alias("a"), F.max(cell).alias("z")).where("total is not null")
    return r.select(*keys, "total", config.bucket_of(F.col("a.idx"), F.col("a.cnt")).alias("min_bucket"), config.bucket_of(F.col("z.idx"), F.col("z.cnt")).alias("max_bucket"))


def totals(cells: DataFrame, keys: list[str]) -> DataFrame:
    return _grouped(cells, keys).agg(F.coalesce(F.sum("cnt"), F.lit(0)).alias("total"))


def mean(cells: DataFrame, keys: list[str], config: Config) -> DataFrame:
    """(keys..., mean): count-weighted mean of bucket midpoints, null if nothing is counted. Sums are exact, of the counters' pieces of 32 bits
    apart, and divided once, as doubles. Counters are of 64 bits, or decimals of up to 30 digits."""
    ends = config.lower_of(F.col("idx")).cast("decimal(20,0)") + config.upper_of(F.col("idx")).cast("decimal(20,0)")
    given = cells.schema["cnt"].dataType
    long = isinstance(given, DecimalType) and given.precision > 20
    kind = "decimal(30,0)" if long else "decimal(20,0)"
    half, cnt = F.lit(1 << 32).cast("decimal(10,0)"), F.col("cnt").cast(kind)
    pieces, rest = [], cnt
    for _ in range(3 if long else 1):
        low = F.pmod(rest, half).cast("decimal(10,0)")
        pieces.append(low)
        rest = ((rest - low) / half).cast(kind)
    pieces.append(rest.cast("decimal(10,0)"))
    part = lambda x: F.sum((ends * x).cast("decimal(38,0)")).cast("double")
    total = part(pieces.pop())
    while pieces:
        total = total * float(1 << 32) + part(pieces.pop())
    sums = _grouped(cells, keys).agg(total.alias("_sum"), F.sum(cnt).alias("_count"))
    return sums.select(*keys, F.when(F.col("_count") > 0, F.col("_sum") / 2 / F.col("_count").cast("double")).alias("mean"))


def buckets(cells: DataFrame, keys: list[str], config: Config) -> DataFrame:
    """(keys..., idx, cnt, lo, hi): the iteration over non-zero buckets."""
    return cells.where("cnt <> 0").select(*keys, "idx", "cnt", config.lower_of(F.col("idx")).alias("lo"), config.upper_of(F.col("idx")).alias("hi"))


def with_quantile_ranges(cells: DataFrame, keys: list[str], config: Config) -> DataFrame:
    """(keys..., idx, cnt, lo, hi, lower_q, upper_q): what share of the total lies below each bucket, and below its end."""
    c = cumulate(cells, keys)
    total = F.col("total").cast("double")
    lower, upper = (F.col("cum") - F.col("cnt")).cast("double") / total, F.col("cum").cast("double") / total
    return c.select(*keys, "idx", "cnt", config.lower_of(F.col("idx")).alias("lo"), config.upper_of(F.col("idx")).alias("hi"), lower.alias("lower_q"), upper.alias("upper_q"))


def bucket_quantile_range(cells: DataFrame, keys: list[str], position: int, config: Config) -> DataFrame:
    """The range of the non-zero bucket at ``position`` (from 0); no row for a distribution with fewer buckets."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("idx")) - 1
    ranged = with_quantile_ranges(cells, keys, config).withColumn("position", place)
    return ranged.where(F.col("position") == position).select(*keys, "position", "lower_q", "upper_q")
