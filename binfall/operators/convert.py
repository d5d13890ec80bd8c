"""Between counter widths. Narrowing has a check by bucket, or for cumulative forms one of the total only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.width import U32, U64, CounterWidth


def widen(cells: DataFrame, keys: list[str], to: CounterWidth = U64) -> DataFrame:
    return cells.select(*keys, "idx", F.col("cnt").cast(to.column_type).alias("cnt"))


def narrow(cells: DataFrame, keys: list[str], to: CounterWidth = U32, *, errors: str = "raise") -> DataFrame:
    """Cells in a narrower width, each checked; or with ``errors="status"`` (keys..., status)."""
    fits = to.fits(F.col("cnt"))
    if errors == "status":
        return (cells.groupBy(*keys) if keys else cells.groupBy()).agg(F.max(F.when(~fits, F.lit("Overflow"))).alias("status"))
    checked = F.when(fits, F.col("cnt")).otherwise(F.raise_error(F.lit("Overflow")).cast(dict(cells.dtypes)["cnt"]))
    return cells.select(*keys, "idx", checked.cast(to.column_type).alias("cnt"))


def narrow_total(cells: DataFrame, keys: list[str], to: CounterWidth = U32, *, errors: str = "raise") -> DataFrame:
    """The cumulative form in a narrower width, (keys..., idx, cum): only the total is checked, as no running sum is above it."""
    sums = cells.where("cnt <> 0").select(*keys, "idx", F.col("cnt").cast("decimal(20,0)").alias("cnt"))
    if errors == "status":
        total = sums.groupBy(*keys).agg(F.sum("cnt").alias("t")) if keys else sums.agg(F.sum("cnt").alias("t"))
        return total.select(*keys, F.when(~to.fits(F.col("t")), F.lit("Overflow")).alias("status"))
    part = Window.partitionBy(*keys)
    cum = F.sum("cnt").over(part.orderBy("idx").rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("cnt").over(part)
    rows = sums.select(*keys, "idx", cum.alias("cum"), total.alias("t"))
    checked = F.when(to.fits(F.col("t")), F.col("cum")).otherwise(F.raise_error(F.lit("Overflow")).cast("decimal(30,0)"))
    return rows.select(*keys, "idx", checked.cast(to.column_type).alias("cum"))
