"""Distributions whose parameters differ from row to row: recorded, aligned, merged and subtracted by the columns ``p`` and ``n``.

Mixed cells are rows (keys..., p, n, idx, cnt). At one grouping power an index does not depend on ``n``, so distributions are aligned to their least
grouping power and their greatest power of the largest value; what they hold then is what recording at these would have given. The other operators
take mixed cells too, with ``p`` and ``n`` among the keys and a ``RowConfig``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bucketing import Config
from ..functions.rowconfig import RowConfig
from ..functions.width import U64, CounterWidth
from .algebra import settled, subtract
from .cells import collected, filled, record

PARAMETERS = ["p", "n"]


def _checked(config: RowConfig) -> list[Column]:
    """The parameters, where they are no configuration an error that names it."""
    error = config.error_name()
    return [F.when(error.isNull(), F.col(c)).otherwise(F.raise_error(error).cast("int")).cast("tinyint").alias(a) for c, a in ((config.p, "p"), (config.n, "n"))]


def record_mixed(df: DataFrame, keys: list[str], value: Column, config: RowConfig = RowConfig(), *, weight: Column | None = None, width: CounterWidth | None = U64, invalid: str = "raise") -> DataFrame:
    """(keys..., p, n, idx, cnt): values counted by the parameters of their own row. Parameters that are no configuration fail the query, values beyond
    a row's range as ``invalid`` says."""
    w = [] if weight is None else [weight.alias("w")]
    rows = df.select(*keys, *_checked(config), value.alias("value"), *w)
    return record(rows, [*keys, *PARAMETERS], F.col("value"), RowConfig(wide=config.wide), weight=None if weight is None else F.col("w"), width=width, invalid=invalid)


def dense_to_mixed(df: DataFrame, keys: list[str], counts: str = "counts", config: RowConfig = RowConfig(), *, invalid: str = "raise") -> DataFrame:
    """Mixed cells of dense arrays, each as long as its own parameters say; else the query fails, or with ``invalid="drop"`` the row is left
    out. Null arrays are left out, null elements count nothing."""
    fits = config.error_name().isNull() & (F.size(counts) == config.total_buckets_of())
    rows = df.where(F.col(counts).isNotNull())
    if invalid == "drop":
        rows, array = rows.where(fits), F.col(counts)
    else:
        wrong = F.raise_error(F.coalesce(config.error_name(), F.lit("IncompatibleParameters"))).cast(df.schema[counts].dataType)
        array = F.when(fits, F.col(counts)).otherwise(wrong)
    rows = rows.select(*keys, F.col(config.p).cast("tinyint").alias("p"), F.col(config.n).cast("tinyint").alias("n"), F.posexplode(array).alias("idx", "cnt"))
    return rows.where("cnt <> 0").select(*keys, *PARAMETERS, F.col("idx").cast("long"), "cnt")


def mixed_to_dense(cells: DataFrame, keys: list[str], config: RowConfig = RowConfig()) -> DataFrame:
    """(keys..., p, n, counts): an array of all counters of each distribution, as long as its own parameters say."""
    rows = collected(cells, [*keys, *PARAMETERS])
    return rows.select(*keys, *PARAMETERS, filled("c", dict(cells.dtypes)["cnt"], config.total_buckets_of()).alias("counts"))


def downsample_mixed(cells: DataFrame, keys: list[str], p: Column, *, wide: bool = False, width: CounterWidth = U64) -> DataFrame:
    """Every distribution at the grouping power that ``p`` gives for it. One that is not below its own, unless equal, fails the query."""
    own = RowConfig(wide=wide)
    coarse = F.when(p <= F.col("p"), p.cast("tinyint")).otherwise(F.raise_error(F.lit("IncompatibleParameters")).cast("tinyint"))
    rows = cells.select(*keys, *PARAMETERS, own.lower_of(F.col("idx")).alias("v"), "idx", "cnt", coarse.alias("to"))
    target = RowConfig("to", "n", wide)
    index = F.when(F.col("to") == F.col("p"), F.col("idx")).otherwise(target.index_of(F.col("v")))
    placed = rows.select(*keys, F.col("to").alias("p"), "n", index.alias("idx"), "cnt")
    return _summed(placed, [*keys, *PARAMETERS, "idx"], width).where("cnt <> 0")


def _summed(cells: DataFrame, by: list[str], width: CounterWidth) -> DataFrame:
    """Counters added up: longs as longs, others modulo the width."""
    if dict(cells.dtypes)["cnt"] == "bigint" and width is U64:
        return cells.groupBy(*by).agg(F.sum("cnt").alias("cnt"))
    return cells.groupBy(*by).agg(width.wrapped(F.sum(F.col("cnt").cast("decimal(20,0)"))).alias("cnt"))


def _coarsest(cells: DataFrame, keys: list[str], wide: bool, *others: str) -> DataFrame:
    """The cells with each distribution's least p and greatest n, and the indices that they have there; not added up."""
    whole = Window.partitionBy(*keys)
    met = cells.withColumns({"least": F.min("p").over(whole), "most": F.max("n").over(whole)})
    index = F.when(F.col("least") == F.col("p"), F.col("idx")).otherwise(RowConfig("least", "most", wide).index_of(RowConfig(wide=wide).lower_of(F.col("idx"))))
    return met.select(*keys, F.col("least").alias("p"), F.col("most").alias("n"), index.alias("idx"), *others)


def align(cells: DataFrame, keys: list[str], *, wide: bool = False, width: CounterWidth = U64) -> DataFrame:
    """(keys..., p, n, idx, cnt) with one pair of parameters for each ``keys``, the least p and the greatest n that it has, and everything it holds merged.
    Counters of equal parameters are added before the distribution's parameters are compared, so a key never has more rows in one task
    than its configurations have buckets."""
    by = [*keys, *PARAMETERS, "idx"]
    counted = _summed(cells.select(*by, "cnt"), by, width)
    return _summed(_coarsest(counted, keys, wide, "cnt"), by, width).where("cnt <> 0")


def same_configs(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., status): IncompatibleParameters where a distribution has more than one pair of parameters, else null."""
    pairs = F.struct("p", "n")
    return cells.groupBy(*keys).agg(F.when(F.min(pairs) != F.max(pairs), "IncompatibleParameters").alias("status"))


def add_mixed(a: DataFrame, b: DataFrame, keys: list[str], *, wide: bool = False, checked: bool = True, width: CounterWidth = U64, mismatch: str = "raise", errors: str = "raise") -> DataFrame:
    """Sum of two sets of mixed cells, (keys..., p, n, idx, cnt). Where the two sides' parameters differ: ``mismatch="raise"`` fails the query, ``"align"``
    brings both to the coarser. With ``errors="status"``: (keys..., status), the first error of each distribution."""
    both = a.select(*keys, *PARAMETERS, "idx", "cnt").unionByName(b.select(*keys, *PARAMETERS, "idx", "cnt"))
    if mismatch not in ("raise", "align"):
        raise ValueError(f"mismatch={mismatch!r}")
    by = [*keys, *PARAMETERS, "idx"]
    sums = both.groupBy(*by).agg(F.sum(F.col("cnt").cast("decimal(20,0)")).alias("s"))
    if mismatch == "align":
        sums = _coarsest(sums, keys, wide, "s").groupBy(*by).agg(F.sum("s").cast("decimal(38,0)").alias("s"))
        other = F.lit(None).cast("string")
    else:
        pair, whole = F.struct("p", "n"), Window.partitionBy(*keys)
        sums = sums.withColumn("two", F.min(pair).over(whole) != F.max(pair).over(whole))
        other = F.when(F.col("two"), "IncompatibleParameters")
    error = F.coalesce(other, F.when(~width.fits(F.col("s")), "Overflow")) if checked else other
    value = F.col("s") if checked else width.wrapped(F.col("s"))
    if errors == "status":
        return settled(sums, keys, value, error, width.column_type, errors)
    out = settled(sums, [*keys, *PARAMETERS], value, error, width.column_type, errors)
    return out if checked else out.where("cnt <> 0")


def subtract_aligned(a: DataFrame, b: DataFrame, keys: list[str], *, wide: bool = False, form: str = "dense", checked: bool = True, width: CounterWidth = U64) -> DataFrame:
    """Difference of two sets of mixed cells at the parameters that each distribution's two sides have in common, as ``subtract`` has it."""
    side = lambda cells, s: cells.select(*keys, *PARAMETERS, "idx", "cnt", F.lit(s).alias("side"))
    counted = _summed(side(a, 0).unionByName(side(b, 1)), [*keys, "side", *PARAMETERS, "idx"], width)
    placed = _coarsest(counted, keys, wide, "cnt", "side")
    # the sides now have equal parameters, so any configuration stands for both
    stands = Config(0, 1)
    return subtract(placed.where("side = 0"), placed.where("side = 1"), [*keys, *PARAMETERS], stands, form=form, checked=checked, width=width)
