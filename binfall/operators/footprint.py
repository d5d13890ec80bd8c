"""How much room the forms take: per distribution, per column, rolled up; and layout tables of a configuration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bucketing import Config
from ..functions.rowconfig import RowConfig

# Bytes of the fixed part of each form, of a counter, and of an index.
DENSE_STRUCT, SPARSE_STRUCT, CUMULATIVE_STRUCT = 48, 80, 96
COUNTER, INDEX = 8, 4


def sizes(counts: Column, buckets: Column) -> list[Column]:
    """nnz and the bytes of the dense, sparse and cumulative form of an array of counters with ``buckets`` places."""
    nnz = F.size(F.filter(counts, lambda c: c != 0)).cast("long")
    return [
        nnz.alias("nnz"),
        (F.lit(DENSE_STRUCT) + buckets * COUNTER).cast("long").alias("dense_bytes"),
        (F.lit(SPARSE_STRUCT) + nnz * (COUNTER + INDEX)).cast("long").alias("sparse_bytes"),
        (F.lit(CUMULATIVE_STRUCT) + nnz * (COUNTER + INDEX)).cast("long").alias("cumulative_bytes"),
    ]


def sizes_of_cells(cells: DataFrame, keys: list[str], config: Config) -> DataFrame:
    """(keys..., nnz, dense_bytes, sparse_bytes, cumulative_bytes), one row per distribution."""
    per = cells.where("cnt <> 0").groupBy(*keys).agg(F.count("*").alias("nnz"))
    return per.select(
        *keys,
        "nnz",
        F.lit(DENSE_STRUCT + COUNTER * config.total_buckets).cast("long").alias("dense_bytes"),
        (F.lit(SPARSE_STRUCT) + F.col("nnz") * (COUNTER + INDEX)).cast("long").alias("sparse_bytes"),
        (F.lit(CUMULATIVE_STRUCT) + F.col("nnz") * (COUNTER + INDEX)).cast("long").alias("cumulative_bytes"),
    )


def report(sized: DataFrame, levels: list[str]) -> DataFrame:
    """Statistics of ``sizes`` rows rolled up over ``levels``: samples, sums, extremes, means, the saving of each form in percent of dense and its
    ratio to dense. Nulls in ``levels`` stand for all. Where the rows have the parameters p and n, these and ``buckets`` follow where all rows
    agree on them, else null."""
    same = lambda c: F.when(F.min(c) == F.max(c), F.min(c)).alias(c)
    forms = ("dense", "sparse", "cumulative")
    given = [same(c) for c in ("p", "n") if c in sized.columns]
    s = sized.rollup(*levels).agg(
        F.count("*").alias("samples"),
        F.min("nnz").alias("min_nnz"),
        F.max("nnz").alias("max_nnz"),
        F.avg("nnz").alias("mean_nnz"),
        *(F.sum(f"{f}_bytes").alias(f"{f}_bytes") for f in forms),
        *(g(f"{f}_bytes").alias(f"{name}_{f}_bytes") for f in forms for name, g in (("min", F.min), ("max", F.max), ("mean", F.avg))),
        *given,
    )
    if len(given) == 2:
        s = s.withColumn("buckets", ((F.col("n") - F.col("p") + 1) * F.pow(F.lit(2.0), F.col("p"))).cast("long"))
    ratio = lambda f: (F.col(f"{f}_bytes") / F.greatest(F.col("dense_bytes"), F.lit(1))).alias(f"{f}_ratio")
    saving = lambda f: (100 * (1 - F.col(f"{f}_bytes") / F.greatest(F.col("dense_bytes"), F.lit(1)))).alias(f"{f}_saving")
    return s.select("*", saving("sparse"), saving("cumulative"), ratio("sparse"), ratio("cumulative"))


def layout(spark: SparkSession, config: Config) -> DataFrame:
    """(grp, width, lo, hi, n_buckets): the linear part and every octave above it."""
    linear, step = 2 * (1 << config.p), 1 << config.p
    g = F.col("id")
    start = F.when(g == 0, F.lit(0)).otherwise(linear + (g - 1) * step)
    end = linear - 1 + g * step
    return spark.range(config.n - config.p).select(
        g.alias("grp"),
        F.call_function("shiftleft", F.lit(1).cast("long"), g.cast("int")).alias("width"),
        config.lower_of(start).alias("lo"),
        config.upper_of(end).alias("hi"),
        (end - start + 1).cast("long").alias("n_buckets"),
    )


def layouts(configs: DataFrame, config: RowConfig = RowConfig()) -> DataFrame:
    """The rows of ``configs``, which bring p and n, each with the rows of its ``layout``."""
    step, g = F.call_function("shiftleft", F.lit(1).cast("long"), F.col(config.p).cast("int")), F.col("grp")
    rows = configs.withColumn("grp", F.explode(F.sequence(F.lit(0), F.col(config.n).cast("int") - F.col(config.p).cast("int") - 1))).withColumn("grp", F.col("grp").cast("long"))
    start, end = F.when(g == 0, F.lit(0).cast("long")).otherwise((g + 1) * step), (g + 2) * step - 1
    width = F.call_function("shiftleft", F.lit(1).cast("long"), g.cast("int"))
    return rows.select("*", width.alias("width"), config.lower_of(start).alias("lo"), config.upper_of(end).alias("hi"), (end - start + 1).alias("n_buckets"))


def truncation_saving_of(p: Column, lower_power: Column) -> Column:
    """``truncation_saving`` in columns."""
    one = F.lit(1).cast("long")
    return F.when(lower_power <= p + 1, F.call_function("shiftleft", one, lower_power.cast("int"))).otherwise(F.call_function("shiftleft", (lower_power - p + 1).cast("long"), p.cast("int")))


def bytes_of(config: Config, counter: int = COUNTER) -> int:
    return config.total_buckets * counter


def truncation_saving(config: Config, lower_power: int) -> int:
    """Buckets that a distribution spares that starts at 2 ** lower_power."""
    return 1 << lower_power if lower_power <= config.p + 1 else (lower_power - config.p + 1) << config.p


def truncated(cells: DataFrame, config: Config, lower_power: int) -> DataFrame:
    """The cells from the bucket of 2 ** lower_power on; the filter is on the index, so stored cells sorted by it are skipped in files."""
    return cells.where(F.col("idx") >= config.index(1 << lower_power))


def human(size: Column) -> Column:
    """Bytes as text with a binary unit, in columns: eight places, two decimals from 1 KiB on, whole bytes below."""
    kib, mib = F.lit(1024.0), F.lit(1024.0 * 1024.0)
    return F.when(size >= mib, F.format_string("%8.2f MiB", size / mib)).when(size >= kib, F.format_string("%8.2f KiB", size / kib)).otherwise(F.format_string("%8.0f  B", size.cast("double")))


def shortened(name: Column, width: int) -> Column:
    """The first ``width`` characters."""
    return F.substring(name, 1, width)
