"""Work within a row: distributions that are stored packed, one row each, are searched, merged, subtracted and summed up where they lie.

A packed row has two parallel arrays, ``idx`` ascending and ``cnt``, or ``cum`` with running sums. Nothing here explodes them, and but for the join that brings two
rows together nothing is shuffled, so stored distributions are asked in one narrow pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bucketing import Config, same_config
from ..functions.rowconfig import RowConfig
from ..functions.width import U64, CounterWidth
from .cells import validate_packed
from .ranks import checked_quantiles

# Fixed value: bytes up to which a prefix array is searched from its start.
LINEAR_BYTES = 64


def position_of(cum: Column, target: Column, width: CounterWidth = U64) -> Column:
    """Place (from 0) of the first prefix sum that reaches ``target``; the array's length if none does. Short arrays are searched from the start, longer ones by
    halving: as many steps as the length has bits."""
    linear = LINEAR_BYTES * 8 // width.value
    n = F.size(cum)
    first = F.coalesce(F.array_position(F.transform(cum, lambda c: c >= target), F.lit(True)).cast("int"), F.lit(0))
    scanned = F.when(first > 0, first - 1).otherwise(n)
    # one step for every bit, and one for the last place
    steps = F.sequence(F.lit(1), F.length(F.bin(n)).cast("int") + 1)
    start = F.struct(F.lit(0).alias("lo"), n.alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        mid = F.shiftright(s["lo"] + s["hi"], 1)
        low = F.get(cum, mid) < target
        open_ = s["lo"] < s["hi"]
        return F.struct(F.when(open_ & low, mid + 1).otherwise(s["lo"]).cast("int").alias("lo"), F.when(open_ & ~low, mid).otherwise(s["hi"]).cast("int").alias("hi"))

    return F.when(n <= linear, scanned).otherwise(F.aggregate(steps, start, halve, lambda s: s["lo"]))


def packed_quantiles(df: DataFrame, keys: list[str], values: list[float], config: Config | RowConfig, *, width: CounterWidth = U64, strict: bool = False) -> DataFrame:
    """(keys..., q, bucket, total) of cumulative packed rows (keys..., idx, cum), as ``quantiles`` gives: each quantile is a search within the row. Empty
    distributions give no rows; ranks that rounding lifts above the total take the last bucket, with ``strict`` they give no row."""
    qs = checked_quantiles(values)
    names = [c for c in (config.p, config.n) if c not in keys] if isinstance(config, RowConfig) else []
    rows = df.where(F.size("idx") > 0).select(*keys, *names, "idx", "cum", F.element_at("cum", -1).alias("total"))
    rank = F.greatest(F.ceil(F.col("q") * F.col("total").cast("double")), F.lit(1)).cast("decimal(38,0)")
    asked = rows.withColumn("q", F.explode(F.array(*map(F.lit, qs)).cast("array<double>")))
    placed = asked.withColumn("at", position_of(F.col("cum"), rank, width))
    inside = F.col("at") < F.size("cum")
    placed = placed.where(inside) if strict else placed.withColumn("at", F.when(inside, F.col("at")).otherwise(F.size("cum") - 1))
    below = F.when(F.col("at") > 0, F.get("cum", F.col("at") - 1)).otherwise(F.lit(0))
    cell = placed.select(*keys, *names, "q", F.get("idx", F.col("at")).alias("i"), (F.get("cum", F.col("at")) - below).alias("c"), "total")
    return cell.select(*keys, "q", config.bucket_of(F.col("i"), F.col("c")).alias("bucket"), "total")


def _merged(ai: Column, ac: Column, bi: Column, bc: Column) -> Column:
    """The two sides' counters in the order of their indices: (i, x, y), x or y null where a side has no such bucket. Either side has an index once at
    most, so equal ones are neighbours once both are sorted together."""
    wide, none = "decimal(38,0)", F.lit(None).cast("decimal(38,0)")
    left = F.zip_with(ai, ac, lambda i, c: F.struct(i.cast("long").alias("i"), c.cast(wide).alias("x"), none.alias("y")))
    right = F.zip_with(bi, bc, lambda i, c: F.struct(i.cast("long").alias("i"), none.alias("x"), c.cast(wide).alias("y")))
    return F.array_sort(F.concat(left, right))


def _paired(m: Column) -> Column:
    """Neighbours with one index made one. (In sorted order the right side's entry, whose x is null, comes first.)"""

    def pair(e: Column, k: Column) -> Column:
        before, after = F.get(m, k - 1), F.get(m, k + 1)
        twin = F.coalesce(after["i"] == e["i"], F.lit(False))
        gone = (k > 0) & F.coalesce(before["i"] == e["i"], F.lit(False))
        one = F.struct(e["i"].alias("i"), F.coalesce(e["x"], F.when(twin, after["x"])).alias("x"), F.coalesce(e["y"], F.when(twin, after["y"])).alias("y"))
        return F.when(~gone, one)

    return F.filter(F.transform(m, pair), lambda e: e.isNotNull())


def merge_packed(a: DataFrame, b: DataFrame, keys: list[str], config: Config, other: Config | None = None, *, operation: str = "add", checked: bool = True, width: CounterWidth = U64, errors: str = "raise", validate: bool = False) -> DataFrame:
    """(keys..., p, n, idx, cnt) of two sets of sparse packed rows, at most one of a key each: their sum, or with ``operation="subtract"`` what the left
    side has more. A key of one side alone is merged with an empty distribution; null keys meet.

    The first failing index decides a row's error: Overflow; InvalidSubset, where the right side has a bucket that the left has not, wrapping or not; Underflow.
    ``errors="raise"`` fails the query, ``"status"`` gives (keys..., status). Zero counters go. ``validate`` checks both sides' arrays first.
    """
    same_config(config, other or config)
    if operation not in ("add", "subtract"):
        raise ValueError(f"operation={operation!r}")
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"a.`{k}`").eqNullSafe(F.col(f"b.`{k}`"))
    side = lambda d, i, c: d.select(*keys, F.col("idx").alias(i), F.col("cnt").alias(c), F.lit(1).alias("has"))
    left, right = side(a, "ai", "ac").alias("a"), side(b, "bi", "bc").alias("b")
    met = left.join(right, on, "full") if keys else left.crossJoin(right)
    key = lambda k: F.when(F.col("a.has").isNotNull(), F.col(f"a.`{k}`")).otherwise(F.col(f"b.`{k}`")).alias(k)
    given = lambda c, kind: F.coalesce(F.col(c).cast(kind), F.array().cast(kind)).alias(c)
    rows = met.select(*map(key, keys), *(given(c, "array<bigint>" if c[1] == "i" else "array<decimal(38,0)>") for c in ("ai", "ac", "bi", "bc")))
    wrong = F.coalesce(validate_packed(F.col("ai"), F.col("ac"), config), validate_packed(F.col("bi"), F.col("bc"), config)) if validate else F.lit(None).cast("string")
    rows = rows.select(*keys, wrong.alias("wrong"), _merged(F.col("ai"), F.col("ac"), F.col("bi"), F.col("bc")).alias("m")).select(*keys, "wrong", _paired(F.col("m")).alias("m"))
    zero = F.lit(0).cast("decimal(38,0)")
    if operation == "add":
        value = lambda e: (F.coalesce(e["x"], zero) + F.coalesce(e["y"], zero)).cast("decimal(38,0)")
        error = lambda e: F.when(F.lit(checked) & ~width.fits(value(e)), "Overflow")
    else:
        value = lambda e: (F.coalesce(e["x"], zero) - F.coalesce(e["y"], zero)).cast("decimal(38,0)")
        error = lambda e: F.when(e["x"].isNull(), "InvalidSubset").when(F.lit(checked) & (value(e) < 0), "Underflow")
    status = F.coalesce("wrong", F.get(F.filter(F.transform("m", error), lambda x: x.isNotNull()), F.lit(0)))
    if errors == "status":
        return rows.select(*keys, status.alias("status"))
    kept = lambda e: F.struct(e["i"].alias("i"), (value(e).cast(width.column_type) if checked else width.wrapped(value(e))).alias("c"))
    good = F.when(status.isNull(), F.col("m")).otherwise(F.raise_error(status).cast(rows.schema["m"].dataType))
    out = rows.select(*keys, F.filter(F.transform(good, kept), lambda e: e["c"] != 0).alias("m"))
    return out.select(*keys, F.lit(config.p).cast("tinyint").alias("p"), F.lit(config.n).cast("tinyint").alias("n"), F.col("m.i").alias("idx"), F.col("m.c").alias("cnt"))


def _midpoint_mean(idx: Column, cum: Column, config: Config) -> Column:
    """Mean of midpoints, added up in double precision in the order of the buckets, divided once."""

    def add(s: Column, at: Column) -> Column:
        i, c = F.get(idx, at), F.get(cum, at)
        own = c - F.when(at > 0, F.get(cum, at - 1)).otherwise(F.lit(0))
        middle = (config.lower_of(i).cast("double") + config.upper_of(i).cast("double")) / 2
        return s + middle * own.cast("double")

    places = F.when(F.size(idx) > 0, F.sequence(F.lit(0), F.size(idx) - 1))
    return F.aggregate(places, F.lit(0.0), add) / F.element_at(cum, -1).cast("double")


def with_derived(packed: DataFrame, config: Config | RowConfig) -> DataFrame:
    """Cumulative packed rows with what is derived from their arrays, to be stored with them: ``total`` (0 if empty) and ``mean`` (null if empty). Whatever
    constructor the arrays come from, the mean is added up in the order of the buckets, so equal arrays have equal means to the last bit."""
    total = F.coalesce(F.element_at("cum", -1), F.lit(0)).cast(packed.schema["cum"].dataType.elementType)
    empty = F.size("cum") == 0
    return packed.withColumns({"total": F.when(empty, F.lit(0)).otherwise(total).cast(packed.schema["cum"].dataType.elementType), "mean": F.when(~empty, _midpoint_mean(F.col("idx"), F.col("cum"), config))})


def checked_derived(stored: DataFrame, config: Config, *, errors: str = "raise") -> DataFrame:
    """Stored cumulative rows whose arrays are valid and whose ``total`` and ``mean`` follow from them; others fail the query, or with ``errors="status"`` all rows
    come with a ``status``: what is wrong with the arrays, or IncompatibleParameters where a stored value does not follow from them."""
    fresh = with_derived(stored.withColumnsRenamed({"total": "_total", "mean": "_mean"}), config)
    other = ~F.col("_total").eqNullSafe(F.col("total")) | ~F.col("_mean").eqNullSafe(F.col("mean"))
    status = F.coalesce(validate_packed(F.col("idx"), F.col("cum"), config, cumulative=True), F.when(other, "IncompatibleParameters"))
    if errors == "status":
        return fresh.withColumn("status", status).select(*stored.columns, "status")
    return fresh.withColumn("total", F.when(status.isNull(), F.col("total")).otherwise(F.raise_error(status).cast(fresh.schema["total"].dataType))).select(*stored.columns)


def widen_derived(stored: DataFrame, config: Config, to: CounterWidth = U64) -> DataFrame:
    """Stored cumulative rows in a wider counter: checked again, derived again."""
    plain = checked_derived(stored, config).drop("total", "mean")
    return with_derived(plain.withColumn("cum", F.col("cum").cast(f"array<{to.column_type}>")), config).select(*stored.columns)
