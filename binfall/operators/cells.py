"""Recording, and the forms of a distribution.

The working form is *cells*: a row (keys..., idx, cnt) for every bucket that counts something, at most one per keys and index. Dense
arrays and packed arrays are views of it. Keys name one distribution each; there may be none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import IncompatibleParameters
from ..functions.bucketing import ARRAY_LIMIT, Config
from ..functions.width import U64, CounterWidth


def record(df: DataFrame, keys: list[str], value: Column, config: Config, *, weight: Column | None = None, width: CounterWidth | None = U64, invalid: str = "raise") -> DataFrame:
    """Count values by bucket. Without ``weight`` every row counts one and ``cnt`` is a long; weights add up modulo the width, with ``width=None``
    to sums of up to 30 digits, beyond what a counter holds; a longer sum fails the query.

    Values beyond the range: ``invalid="raise"`` fails the query, ``"drop"`` leaves them out, ``"flag"`` puts them in rows with a null
    idx. Null values are left out. Sums are built before the shuffle, so a hot key moves at most one row per bucket and task.
    """
    if invalid not in ("raise", "drop", "flag"):
        raise ValueError(f"invalid={invalid!r}")
    rows = df.select(*keys, value.alias("v"), *([weight.alias("w")] if weight is not None else [])).where("v is not null")
    good = config.accepts(F.col("v"))
    if invalid == "drop":
        rows = rows.where(good)
        index = config.index_of(F.col("v"))
    else:
        other = F.raise_error(F.lit("OutOfRange")).cast("long") if invalid == "raise" else F.lit(None).cast("long")
        index = F.when(good, config.index_of(F.col("v"))).otherwise(other)
    rows = rows.withColumn("idx", index)
    if weight is None:
        return rows.groupBy(*keys, "idx").agg(F.count("*").alias("cnt"))
    total = F.sum(F.col("w").cast("decimal(20,0)"))
    total = total if width is None else width.wrapped(total)
    return rows.groupBy(*keys, "idx").agg(total.alias("cnt")).where("cnt <> 0")


def dense_buckets(cells: DataFrame, keys: list[str], config: Config) -> DataFrame:
    """All buckets of every distribution, zeros included: (keys..., idx, cnt)."""
    return to_dense(cells, keys, config).select(*keys, F.posexplode("counts").alias("idx", "cnt")).withColumn("idx", F.col("idx").cast("long"))


def filled(c: str, kind: str, total: Column) -> Column:
    """The counters of an array ``c`` of (idx, cnt), ascending, with zeros in the gaps, ``total`` in all."""
    zero = F.lit(0).cast(kind)
    end = F.coalesce(F.get(c, F.size(c) - 1)["idx"], F.lit(-1)).cast("int")

    def upto(x: Column, i: Column) -> Column:
        before = F.coalesce(F.get(c, i - 1)["idx"], F.lit(-1))
        return F.concat(F.array_repeat(zero, (x["idx"] - before - 1).cast("int")), F.array(x["cnt"]))

    return F.flatten(F.concat(F.transform(c, upto), F.array(F.array_repeat(zero, total.cast("int") - 1 - end))))


def collected(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., c): each distribution's cells as an array of (idx, cnt), ascending; null indices are left out, and distributions that have no others. They are
    left out of the list and not by a filter, which Spark would push below the recording: there it works out every row's index again, from all that
    the index is made of, in a method too long to be compiled."""
    rows = cells.groupBy(*keys).agg(F.sort_array(F.collect_list(F.when(F.col("idx").isNotNull(), F.struct("idx", "cnt")))).alias("c"))
    return rows.where(F.size("c") > 0) if keys else rows


def to_dense(cells: DataFrame, keys: list[str], config: Config) -> DataFrame:
    """One array of all counters per distribution, with its parameters: (keys..., p, n, counts). At most ``total_buckets`` values each. The
    gaps between a distribution's cells are filled in place; without keys, no cells are one distribution of zeros."""
    if config.total_buckets >= ARRAY_LIMIT:
        raise IncompatibleParameters("too many buckets for a dense form")
    rows = collected(cells, keys)
    counts = filled("c", dict(cells.dtypes)["cnt"], F.lit(config.total_buckets))
    return rows.select(*keys, F.lit(config.p).cast("tinyint").alias("p"), F.lit(config.n).cast("tinyint").alias("n"), counts.alias("counts"))


def overwrite(cells: DataFrame, changes: DataFrame, keys: list[str], config: Config) -> DataFrame:
    """The cells with the counters of ``changes`` (keys..., idx, cnt) put in their places: a zero or null empties a bucket, of several
    changes of one counter the largest counts. An index beyond the range fails the query. Types are those of ``cells``."""
    inside = F.col("idx").between(0, config.total_buckets - 1)
    index = F.when(inside, F.col("idx")).otherwise(F.raise_error(F.lit("OutOfRange")).cast("long"))
    new = changes.select(*keys, index.alias("idx"), F.coalesce("cnt", F.lit(0)).cast(dict(cells.dtypes)["cnt"]).alias("cnt"), F.lit(1).alias("turn"))
    both = cells.select(*keys, "idx", "cnt", F.lit(0).alias("turn")).unionByName(new)
    return both.groupBy(*keys, "idx").agg(F.max(F.struct("turn", "cnt"))["cnt"].alias("cnt")).where("cnt <> 0")


def dense_to_cells(df: DataFrame, keys: list[str], counts: str, config: Config, *, invalid: str = "raise") -> DataFrame:
    """Cells of dense arrays. An array of another length fails the query, or with ``invalid="drop"`` is left out; null arrays are left out,
    null elements count nothing."""
    fits = F.size(counts) == config.total_buckets
    rows = df.where(F.col(counts).isNotNull())
    if invalid == "drop":
        rows, array = rows.where(fits), F.col(counts)
    else:
        array = F.when(fits, F.col(counts)).otherwise(F.raise_error(F.lit("IncompatibleParameters")).cast(df.schema[counts].dataType))
    return rows.select(*keys, F.posexplode(array).alias("idx", "cnt")).where("cnt <> 0").select(*keys, F.col("idx").cast("long"), "cnt")


def to_packed(cells: DataFrame, keys: list[str], config: Config, count: str = "cnt") -> DataFrame:
    """Two parallel arrays per distribution, ascending by index: (keys..., p, n, idx, <count>)."""
    rows = cells.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("idx", count))).alias("c"))
    return rows.select(*keys, F.lit(config.p).cast("tinyint").alias("p"), F.lit(config.n).cast("tinyint").alias("n"), F.col("c.idx").alias("idx"), F.col(f"c.{count}").alias(count))


def validate_packed(idx: Column, cnt: Column, config: Config, *, cumulative: bool = False) -> Column:
    """Name of the first error of two parallel arrays, or null: lengths, then by place range and order of the indices, then zero
    counters and, for cumulative ones, falling counters."""
    bad = F.lit("IncompatibleParameters")

    def at(x: Column, i: Column) -> Column:
        return F.when((x < 0) | (x >= config.total_buckets), F.lit("OutOfRange")).when((i > 0) & (x <= F.get(idx, i - 1)), bad)

    placed = F.get(F.filter(F.transform(idx, at), lambda e: e.isNotNull()), F.lit(0))
    falls = F.exists(F.transform(cnt, lambda c, i: (i > 0) & (c < F.get(cnt, i - 1))), lambda b: b) if cumulative else F.lit(False)
    return F.when(F.size(idx) != F.size(cnt), bad).when(placed.isNotNull(), placed).when(F.exists(cnt, lambda c: c == 0) | falls, bad)


def packed_to_cells(df: DataFrame, keys: list[str], config: Config, *, idx: str = "idx", count: str = "cnt", validate: bool = True, cumulative: bool = False) -> DataFrame:
    """Cells of packed arrays, cumulative ones as (keys..., idx, cum). ``validate=False`` trusts the arrays."""
    pairs = F.arrays_zip(F.col(idx).alias("idx"), F.col(count).alias("cnt"))
    if validate:
        error = validate_packed(F.col(idx), F.col(count), config, cumulative=cumulative)
        pairs = F.when(error.isNull(), pairs).otherwise(F.raise_error(error).cast("array<struct<idx:bigint,cnt:bigint>>"))
    rows = df.select(*keys, F.explode(pairs).alias("c"))
    return rows.select(*keys, F.col("c.idx").cast("long").alias("idx"), F.col("c.cnt").alias("cum" if cumulative else "cnt"))


def non_zero(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Number of buckets that count something: (keys..., nnz)."""
    return cells.where("cnt <> 0").groupBy(*keys).agg(F.count("*").alias("nnz"))


def is_empty(cells: DataFrame, owners: DataFrame, keys: list[str]) -> DataFrame:
    """The distributions of ``owners`` that count nothing. A null key is a key."""
    return owners.select(*keys).subtract(cells.where("cnt <> 0").select(*keys))
