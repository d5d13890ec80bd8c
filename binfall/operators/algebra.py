"""Merging, subtracting and downsampling cells.

Checked forms tell trouble in one of two ways: ``errors="raise"`` fails the query, ``errors="status"`` gives one row per distribution, (keys..., status),
with the error of its lowest failing index or null. Both sides are summed before they meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bucketing import Config, same_config
from ..functions.width import U64, CounterWidth


def exact_sum(column: str, kind: str) -> Column:
    """Sum of counters as a decimal that cannot overflow. Longs are added as longs, their high and low 32 bits apart, and only the sums are made decimals."""
    c = F.col(column)
    if kind != "bigint":
        return F.sum(c.cast("decimal(20,0)"))
    high, low = F.sum(F.shiftright(c, 32)), F.sum(c.bitwiseAND(F.lit((1 << 32) - 1)))
    return (high.cast("decimal(19,0)") * F.lit(1 << 32).cast("decimal(10,0)") + low.cast("decimal(19,0)")).cast("decimal(30,0)")


def _counter(*sides: DataFrame) -> str:
    """The type in which the sides' counters are added up."""
    return "bigint" if all(dict(d.dtypes)["cnt"] == "bigint" for d in sides) else "decimal(20,0)"


def settled(rows: DataFrame, keys: list[str], value: Column, error: Column, kind: str, errors: str) -> DataFrame:
    """``value`` of the rows as counters, or by ``errors`` what ``error`` says of them."""
    if errors == "status":
        found = rows.select(*keys, "idx", error.alias("error"))
        first = F.min(F.when(F.col("error").isNotNull(), F.struct("idx", "error")))
        return (found.groupBy(*keys) if keys else found).agg(first["error"].alias("status"))
    checked = F.when(error.isNull(), value).otherwise(F.raise_error(error).cast("decimal(38,0)"))
    return rows.select(*keys, "idx", checked.cast(kind).alias("cnt"))


def add(a: DataFrame, b: DataFrame, keys: list[str], config: Config, other: Config | None = None, *, checked: bool = True, width: CounterWidth = U64, errors: str = "raise") -> DataFrame:
    """Sum of two sets of distributions. Unchecked sums wrap at the width; cells that wrap to zero go."""
    same_config(config, other or config)
    both = a.select(*keys, "idx", "cnt").unionByName(b.select(*keys, "idx", "cnt")).groupBy(*keys, "idx").agg(exact_sum("cnt", _counter(a, b)).alias("s"))
    if not checked:
        return both.select(*keys, "idx", width.wrapped(F.col("s")).alias("cnt")).where("cnt <> 0")
    error = F.when(~width.fits(F.col("s")), F.lit("Overflow"))
    return settled(both, keys, F.col("s"), error, width.column_type, errors)


def subtract(a: DataFrame, b: DataFrame, keys: list[str], config: Config, other: Config | None = None, *, form: str = "dense", checked: bool = True, width: CounterWidth = U64, errors: str = "raise") -> DataFrame:
    """Difference of two sets of distributions. In the sparse form the right side's buckets must be among the left side's, wrapping or not, and zero
    results go; in the dense form they stay and a missing bucket is a zero."""
    same_config(config, other or config)
    if form not in ("dense", "sparse"):
        raise ValueError(f"form={form!r}")
    # both sides in one aggregation: one shuffle, and null keys meet as others do
    kind = _counter(a, b)
    wide, none = F.col("cnt").cast(kind), F.lit(None).cast(kind)
    sides = a.select(*keys, "idx", wide.alias("x"), none.alias("y")).unionByName(b.select(*keys, "idx", none.alias("x"), wide.alias("y")))
    both = sides.groupBy(*keys, "idx").agg(exact_sum("x", kind).alias("x"), exact_sum("y", kind).alias("y"))
    left, right = F.coalesce("x", F.lit(0)), F.coalesce("y", F.lit(0))
    value = left.cast("decimal(38,0)") - right.cast("decimal(38,0)")
    alone = F.col("x").isNull() & F.col("y").isNotNull() if form == "sparse" else F.lit(False)
    error = F.when(alone, F.lit("InvalidSubset"))
    if checked:
        error = error.when(value < 0, F.lit("Underflow"))
    else:
        value = width.wrapped(value)
    out = settled(both, keys, value, error, width.column_type, errors)
    return out.where("cnt <> 0") if form == "sparse" and errors != "status" else out


def rolled_up(cells: DataFrame, keys: list[str]) -> DataFrame:
    """The distributions merged over the last keys, one after the other: (keys..., level, idx, cnt) with ``level`` keys kept and nulls for the
    others. Merging cells is exact, so all levels come from the counted cells, in one aggregation."""
    kinds = dict(cells.dtypes)
    levels = [F.struct(*((F.col(k) if i < level else F.lit(None).cast(kinds[k])).alias(k) for i, k in enumerate(keys)), F.lit(level).alias("level")) for level in range(len(keys), -1, -1)]
    spread = cells.select("idx", "cnt", F.explode(F.array(*levels)).alias("at")).select("at.*", "idx", "cnt")
    return spread.groupBy(*keys, "level", "idx").agg(F.sum("cnt").alias("cnt"))


def downsample(cells: DataFrame, keys: list[str], config: Config, p: int, *, width: CounterWidth = U64) -> DataFrame:
    """The distributions at a lower grouping power, as if their values had been recorded at it. Sums wrap at the width."""
    coarse = config.downsampled(p)
    rows = cells.select(*keys, coarse.index_of(config.lower_of(F.col("idx"))).alias("idx"), "cnt")
    if dict(cells.dtypes)["cnt"] == "bigint" and width is U64:
        # longs that were counted row by row cannot pass 64 bits
        return rows.groupBy(*keys, "idx").agg(F.sum("cnt").alias("cnt")).where("cnt <> 0")
    return rows.groupBy(*keys, "idx").agg(width.wrapped(F.sum(F.col("cnt").cast("decimal(20,0)"))).alias("cnt")).where("cnt <> 0")
