"""The registered queries over the operators, and SQL that computes each of them another way.

Values are money in cents. The SQL ranks and groups raw values where it can, rather than repeat the running sums.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import sql as sql_functions
from ..functions.bucketing import Config
from ..functions.rowconfig import RowConfig, same_parameters
from ..functions.width import U32
from ..operators import algebra, cells, compare, convert, footprint, mixed, packed
from ..operators import ranks as qt
from ..sources import from_json, read_recordings, to_json, write_recordings
from ..streaming import recorder, stateful

WIDE, FINE, SMALL, COARSE = Config(7, 64), Config(8, 63), Config(2, 26), Config(4, 63)
MONEY = Config(7, 62)
QS = [0.0, 0.25, 0.5, 0.75, 0.9, 0.99, 0.999, 1.0]
DAY = "1996-01-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(column: str) -> Column:
    return F.round(F.col(column) * 100).cast("long")


def _index(v: str, p: int) -> str:
    w = f"(CAST(floor(log2(greatest({v}, 1))) AS INTEGER) - {p})"
    return f"(CASE WHEN {v} < {1 << (p + 1)} THEN {v} ELSE CAST({w} AS BIGINT) * {1 << p} + ({v} >> greatest({w}, 0)) END)"


def _lower(j: str, p: int) -> str:
    return f"(CASE WHEN ({j} >> {p}) < 1 THEN {j} ELSE (({j} & {(1 << p) - 1}) + {1 << p}) * CAST(pow(2, ({j} >> {p}) - 1) AS BIGINT) END)"


def _upper(j: str, p: int) -> str:
    return f"({_lower(f'({j} + 1)', p)} - 1)"


CENTS = "CAST(round({} * 100) AS BIGINT)"
PRICE, TOTAL, VALUE = CENTS.format("l_extendedprice"), CENTS.format("o_totalprice"), CENTS.format("value")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def prices(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_returnflag", *extra, cents("l_extendedprice").alias("v"))


def price_cells(spark: SparkSession, sf_dir: str, config: Config = MONEY) -> DataFrame:
    return cells.record(prices(spark, sf_dir), ["l_returnflag"], F.col("v"), config)


def order_cells(spark: SparkSession, sf_dir: str, config: Config = MONEY) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("k"), cents("o_totalprice").alias("v"))
    return cells.record(orders, ["k"], F.col("v"), config)


PRICE_COUNTS = f"SELECT l_returnflag, {_index(PRICE, 7)} AS idx, count(*) AS cnt FROM lineitem GROUP BY 1, 2"
ORDER_COUNTS = f"SELECT o_orderpriority AS k, {_index(TOTAL, 7)} AS idx, count(*) AS cnt FROM orders GROUP BY 1, 2"


# --- bucketing -----------------------------------------------------------------------------------------------------------


@query(f"SELECT l_orderkey, l_linenumber, {_index(PRICE, 7)} AS idx FROM lineitem")
def bucket_index(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", WIDE.index_of(cents("l_extendedprice").cast("decimal(20,0)")).alias("idx"))


@query(f"SELECT DISTINCT idx, {_lower('idx', 7)} AS lo, {_upper('idx', 7)} AS hi FROM (SELECT {_index(PRICE, 7)} AS idx FROM lineitem)")
def bucket_bounds(spark, sf_dir):
    rows = prices(spark, sf_dir).select(MONEY.index_of(F.col("v")).alias("idx")).distinct()
    return rows.select("idx", MONEY.lower_of(F.col("idx")).alias("lo"), MONEY.upper_of(F.col("idx")).alias("hi"))


#: Of every flag, the least power of two above all its prices.
_FITTED = f"SELECT l_returnflag, CAST(floor(log2(max({PRICE}))) AS INTEGER) + 1 AS n, min({PRICE}) AS least FROM lineitem GROUP BY 1"


def fitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("v")
    return prices(spark, sf_dir).groupBy("l_returnflag").agg((F.floor(F.log2(F.max(v))).cast("int") + 1).alias("n"), F.min(v).alias("least"))


@query(
    f"SELECT l_returnflag, 8 AS p, n, g AS grp, CAST(pow(2, g) AS BIGINT) AS width, CASE WHEN g = 0 THEN 0 ELSE CAST(pow(2, g + 8) AS BIGINT) END AS lo, "
    f"CAST(pow(2, g + 9) AS BIGINT) - 1 AS hi, CASE WHEN g = 0 THEN 512 ELSE 256 END AS n_buckets FROM ({_FITTED}) JOIN generate_series(0, 63) t(g) ON g < n - 8"
)
def config_layout(spark, sf_dir):
    """The octaves of the configurations that fit the prices of each flag."""
    return footprint.layouts(fitted(spark, sf_dir).select("l_returnflag", F.lit(8).alias("p"), "n"))


@query(
    f"SELECT l_returnflag, CAST(p AS INTEGER) AS p, n, CAST((n - p + 1) * pow(2, p) AS BIGINT) AS total_buckets, CASE WHEN p = n - 1 THEN 0.0 ELSE 100.0 / pow(2, p) END AS error, "
    f"CAST((n - p + 1) * pow(2, p) * 8 AS BIGINT) AS dense_bytes FROM ({_FITTED}) JOIN generate_series(0, 63) t(p) ON p < n"
)
def config_sizes(spark, sf_dir):
    """Buckets, error and bytes of every grouping power that fits the prices of each flag."""
    c = RowConfig()
    rows = fitted(spark, sf_dir).select("l_returnflag", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("p"))
    total = c.total_buckets_of()
    return rows.select("l_returnflag", "p", "n", total.alias("total_buckets"), c.error_of().alias("error"), (total * footprint.COUNTER).alias("dense_bytes"))


# --- recording and forms -------------------------------------------------------------------------------------------------


@query(PRICE_COUNTS)
def record_counts(spark, sf_dir):
    return price_cells(spark, sf_dir)


@query(f"SELECT l_returnflag, {_index(PRICE, 7)} AS idx, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS cnt FROM lineitem GROUP BY 1, 2")
def record_weighted(spark, sf_dir):
    rows = prices(spark, sf_dir, "l_quantity")
    return cells.record(rows, ["l_returnflag"], F.col("v"), MONEY, weight=F.col("l_quantity").cast("long")).withColumn("cnt", F.col("cnt").cast("long"))


@query(f"SELECT c_mktsegment, CASE WHEN v < 0 THEN -1 ELSE {_index('v', 7)} END AS idx, count(*) AS cnt FROM (SELECT c_mktsegment, {CENTS.format('c_acctbal')} AS v FROM customer) GROUP BY 1, 2")
def out_of_range_split(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_mktsegment", cents("c_acctbal").alias("v"))
    flagged = cells.record(rows, ["c_mktsegment"], F.col("v"), MONEY, invalid="flag")
    return flagged.withColumn("idx", F.coalesce("idx", F.lit(-1).cast("long")))


@query(
    f"SELECT k, i AS idx, coalesce(cnt, 0) AS cnt FROM (SELECT DISTINCT o_orderpriority AS k FROM orders) CROSS JOIN generate_series(0, {SMALL.total_buckets - 1}) t(i) "
    f"LEFT JOIN (SELECT o_orderpriority AS k, {_index(TOTAL, 2)} AS idx, count(*) AS cnt FROM orders GROUP BY 1, 2) c USING (k) WHERE c.idx = i "
    f"UNION ALL SELECT k, i, 0 FROM (SELECT DISTINCT o_orderpriority AS k FROM orders) CROSS JOIN generate_series(0, {SMALL.total_buckets - 1}) t(i) "
    f"WHERE (k, i) NOT IN (SELECT o_orderpriority, {_index(TOTAL, 2)} FROM orders)"
)
def dense_iter(spark, sf_dir):
    return cells.dense_buckets(order_cells(spark, sf_dir, SMALL), ["k"], SMALL)


@query(f"SELECT k, idx, cnt, {_lower('idx', 7)} AS lo, {_upper('idx', 7)} AS hi FROM ({ORDER_COUNTS})")
def sparse_iter(spark, sf_dir):
    return qt.buckets(order_cells(spark, sf_dir), ["k"], MONEY)


@query(f"SELECT o_orderpriority AS k, {_index(TOTAL, 2)} AS idx, count(*) AS cnt FROM orders GROUP BY 1, 2")
def dense_roundtrip(spark, sf_dir):
    return cells.dense_to_cells(cells.to_dense(order_cells(spark, sf_dir, SMALL), ["k"], SMALL), ["k"], "counts", SMALL)


@query(ORDER_COUNTS)
def packed_roundtrip(spark, sf_dir):
    return cells.packed_to_cells(cells.to_packed(order_cells(spark, sf_dir), ["k"], MONEY), ["k"], MONEY)


@query(f"SELECT k, count(*) AS nnz FROM ({ORDER_COUNTS}) GROUP BY 1")
def non_zero_buckets(spark, sf_dir):
    return cells.non_zero(order_cells(spark, sf_dir), ["k"])


_LARGE = MONEY.index(44_000)


@query(f"SELECT DISTINCT event_type, user_id FROM events EXCEPT SELECT event_type, user_id FROM events WHERE {_index(VALUE, 7)} >= {_LARGE}")
def empty_distributions(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_type", "user_id", cents("value").alias("v"))
    counted = cells.record(rows, ["event_type", "user_id"], F.col("v"), MONEY)
    return cells.is_empty(counted.where(F.col("idx") >= _LARGE), counted, ["event_type", "user_id"])


_CHANGED = f"SELECT *, idx % 3 AS r FROM ({ORDER_COUNTS})"


@query(f"SELECT k, CASE WHEN r = 2 THEN idx + 4000 ELSE idx END AS idx, CASE WHEN r = 0 THEN cnt ELSE 7 END AS cnt FROM ({_CHANGED}) WHERE r <> 1 UNION ALL SELECT k, idx, cnt FROM ({_CHANGED}) WHERE r = 2")
def overwrite_counters(spark, sf_dir):
    """Of the counters, a third stay, a third are emptied, and to the rest others are set that counted nothing."""
    counted = order_cells(spark, sf_dir)
    r = F.col("idx") % 3
    changes = counted.where(r != 0).select("k", F.when(r == 2, F.col("idx") + 4_000).otherwise(F.col("idx")).alias("idx"), F.when(r == 2, 7).otherwise(0).alias("cnt"))
    return cells.overwrite(counted, changes, ["k"], MONEY)


# --- null keys -------------------------------------------------------------------------------------------------------------

NULLED = "CASE WHEN l_returnflag <> 'N' THEN l_returnflag END"


def nulled(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.when(F.col("l_returnflag") != "N", F.col("l_returnflag"))
    return table(spark, sf_dir, "lineitem").select(key.alias("k"), "l_shipdate", cents("l_extendedprice").alias("v"))


@query(
    f"SELECT d.k, i AS idx, CAST(coalesce(cnt, 0) AS BIGINT) AS cnt FROM (SELECT DISTINCT {NULLED} AS k FROM lineitem) d CROSS JOIN generate_series(0, {SMALL.total_buckets - 1}) t(i) "
    f"LEFT JOIN (SELECT {NULLED} AS k, {_index(PRICE, 2)} AS idx, count(*) AS cnt FROM lineitem GROUP BY 1, 2) c ON c.idx = i AND c.k IS NOT DISTINCT FROM d.k"
)
def null_keys_dense(spark, sf_dir):
    return cells.dense_buckets(cells.record(nulled(spark, sf_dir), ["k"], F.col("v"), SMALL), ["k"], SMALL)


@query(f"SELECT {NULLED} AS k, {_index(PRICE, 7)} AS idx, count(*) FILTER (WHERE l_shipdate >= TIMESTAMP '{DAY}') AS cnt FROM lineitem GROUP BY 1, 2")
def null_keys_subtract(spark, sf_dir):
    rows = nulled(spark, sf_dir)
    early = rows.where(F.col("l_shipdate") < F.lit(DAY).cast("timestamp_ntz"))
    return _plain(algebra.subtract(*(cells.record(x, ["k"], F.col("v"), MONEY) for x in (rows, early)), ["k"], MONEY))


@query(f"SELECT DISTINCT {NULLED} AS k FROM lineitem EXCEPT SELECT {NULLED} FROM lineitem WHERE l_returnflag = 'N' OR {_index(PRICE, 7)} < 0")
def null_keys_empty(spark, sf_dir):
    counted = cells.record(nulled(spark, sf_dir), ["k"], F.col("v"), MONEY)
    return cells.is_empty(counted.where("k is null"), counted, ["k"])


# --- algebra ---------------------------------------------------------------------------------------------------------------


def halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = prices(spark, sf_dir, "l_shipdate")
    early = F.col("l_shipdate") < F.lit(DAY).cast("timestamp_ntz")
    return tuple(cells.record(rows.where(side), ["l_returnflag"], F.col("v"), MONEY) for side in (early, ~early))


def _plain(df: DataFrame) -> DataFrame:
    return df.withColumn("cnt", df["cnt"].cast("long"))


@query(f"SELECT l_returnflag, {_index(PRICE, 4)} AS idx, count(*) AS cnt FROM lineitem GROUP BY 1, 2")
def downsample(spark, sf_dir):
    return algebra.downsample(price_cells(spark, sf_dir, FINE), ["l_returnflag"], FINE, COARSE.p)


@query(PRICE_COUNTS)
def merge_checked(spark, sf_dir):
    return _plain(algebra.add(*halves(spark, sf_dir), ["l_returnflag"], MONEY))


@query(PRICE_COUNTS)
def merge_wrapping(spark, sf_dir):
    return _plain(algebra.add(*halves(spark, sf_dir), ["l_returnflag"], MONEY, checked=False))


def _rest(form: str) -> str:
    where = "" if form == "dense" else "WHERE s > 0"
    return f"SELECT l_returnflag, idx, s AS cnt FROM (SELECT l_returnflag, {_index(PRICE, 7)} AS idx, CAST(count(*) FILTER (WHERE l_shipdate >= TIMESTAMP '{DAY}') AS BIGINT) AS s FROM lineitem GROUP BY 1, 2) {where}"


@query(_rest("dense"))
def subtract_checked(spark, sf_dir):
    early, _ = halves(spark, sf_dir)
    return _plain(algebra.subtract(price_cells(spark, sf_dir), early, ["l_returnflag"], MONEY))


@query(_rest("sparse"))
def subtract_sparse(spark, sf_dir):
    early, _ = halves(spark, sf_dir)
    return _plain(algebra.subtract(price_cells(spark, sf_dir), early, ["l_returnflag"], MONEY, form="sparse"))


@query(
    f"SELECT l_returnflag, idx, CASE WHEN d < 0 THEN CAST(d AS HUGEINT) + 4294967296 ELSE d END::BIGINT AS cnt FROM (SELECT l_returnflag, {_index(PRICE, 7)} AS idx, "
    f"sum(CASE WHEN l_shipdate < TIMESTAMP '{DAY}' THEN 1 ELSE -1 END) AS d FROM lineitem GROUP BY 1, 2)"
)
def subtract_wrapping(spark, sf_dir):
    early, late = halves(spark, sf_dir)
    return _plain(algebra.subtract(early, late, ["l_returnflag"], MONEY, checked=False, width=U32))


@query(
    f"SELECT l_returnflag, CASE WHEN min(CASE WHEN a = 0 THEN idx END) IS NULL AND min(CASE WHEN b > a THEN idx END) IS NULL THEN NULL "
    f"WHEN coalesce(min(CASE WHEN a = 0 THEN idx END), 1e18) <= coalesce(min(CASE WHEN b > a THEN idx END), 1e18) THEN 'InvalidSubset' ELSE 'Underflow' END AS status "
    f"FROM (SELECT l_returnflag, {_index(PRICE, 7)} AS idx, count(*) FILTER (WHERE l_shipdate < TIMESTAMP '{DAY}') AS a, count(*) AS b FROM lineitem GROUP BY 1, 2) GROUP BY 1"
)
def subtract_not_subset(spark, sf_dir):
    early, _ = halves(spark, sf_dir)
    return algebra.subtract(early, price_cells(spark, sf_dir), ["l_returnflag"], MONEY, form="sparse", errors="status")


# --- quantiles -------------------------------------------------------------------------------------------------------------


def _ranked(source: str, key: str, value: str, p: int, qs: list[float]) -> str:
    listed = ", ".join(f"({q!r}::DOUBLE)" for q in qs)
    return (
        f"SELECT {key}, q, {_lower('idx', p)} AS lo, {_upper('idx', p)} AS hi, total FROM (SELECT {key}, q, n AS total, {_index('v', p)} AS idx FROM "
        f"(SELECT {key}, {value} AS v, row_number() OVER (PARTITION BY {key} ORDER BY {value}) AS r, count(*) OVER (PARTITION BY {key}) AS n FROM {source}) "
        f"JOIN (VALUES {listed}) t(q) ON r = greatest(1, CAST(ceil(q * CAST(n AS DOUBLE)) AS BIGINT)))"
    )


def _spread(found: DataFrame, *keys: str) -> DataFrame:
    return found.select(*keys, "q", F.col("bucket.lo").alias("lo"), F.col("bucket.hi").alias("hi"), F.col("total").cast("long").alias("total"))


@query(_ranked("lineitem", "l_returnflag", PRICE, 7, QS))
def quantiles_by_flag(spark, sf_dir):
    return _spread(qt.quantiles(price_cells(spark, sf_dir), ["l_returnflag"], QS, MONEY), "l_returnflag")


@query(_ranked("orders", "1 AS one", TOTAL, 7, [0.5]).replace("PARTITION BY 1 AS one", "PARTITION BY 1").replace("SELECT 1 AS one, q, CASE", "SELECT q, CASE").replace("SELECT 1 AS one, q, (", "SELECT q, (").replace("SELECT 1 AS one, q, n", "SELECT q, n"))
def quantile_single(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(cents("o_totalprice").alias("v"))
    return _spread(qt.quantiles(cells.record(rows, [], F.col("v"), MONEY), [], [0.5], MONEY))


@query(_ranked("lineitem", "l_returnflag", PRICE, 7, [0.0, 1.0]))
def quantile_extremes(spark, sf_dir):
    return _spread(qt.quantiles(price_cells(spark, sf_dir), ["l_returnflag"], [1.0, 0.0, -0.0, 1.0], MONEY), "l_returnflag")


@query(_ranked("lineitem", "l_returnflag", PRICE, 7, [0.5, 0.99]).replace("SELECT l_returnflag, q, CASE", "SELECT l_returnflag, q, CASE"))
def quantiles_from_cumulative(spark, sf_dir):
    cum = qt.cumulate(price_cells(spark, sf_dir), ["l_returnflag"]).select("l_returnflag", "idx", "cum")
    return _spread(qt.quantiles(qt.cumulative_to_cells(cum, ["l_returnflag"]), ["l_returnflag"], [0.5, 0.99], MONEY), "l_returnflag")


@query(f"SELECT l_returnflag, q * 100 AS percentile, lo, hi FROM ({_ranked('lineitem', 'l_returnflag', PRICE, 7, [0.25, 0.5, 0.75])})")
def percentiles_by_flag(spark, sf_dir):
    found = qt.percentiles(price_cells(spark, sf_dir), ["l_returnflag"], [25, 50, 75], MONEY)
    return found.select("l_returnflag", "percentile", F.col("bucket.lo").alias("lo"), F.col("bucket.hi").alias("hi"))


@query(
    f"SELECT l_returnflag, CAST(sum(cnt) AS BIGINT) AS total, {_lower('min(idx)', 7)} AS min_lo, {_upper('max(idx)', 7)} AS max_hi, arg_min(cnt, idx) AS min_count, arg_max(cnt, idx) AS max_count FROM ({PRICE_COUNTS}) GROUP BY 1"
)
def quantile_min_max_total(spark, sf_dir):
    r = qt.extremes(price_cells(spark, sf_dir), ["l_returnflag"], MONEY)
    return r.select("l_returnflag", "total", F.col("min_bucket.lo").alias("min_lo"), F.col("max_bucket.hi").alias("max_hi"), F.col("min_bucket.count").alias("min_count"), F.col("max_bucket.count").alias("max_count"))


_RUNNING = f"SELECT k, idx, cnt, CAST(sum(cnt) OVER (PARTITION BY k ORDER BY idx) AS BIGINT) AS cum, CAST(sum(cnt) OVER (PARTITION BY k) AS BIGINT) AS total FROM ({ORDER_COUNTS})"


@query(_RUNNING)
def cumulative_counts(spark, sf_dir):
    return qt.cumulate(order_cells(spark, sf_dir), ["k"])


@query(ORDER_COUNTS)
def cumulative_individual(spark, sf_dir):
    return qt.individual_counts(qt.cumulate(order_cells(spark, sf_dir), ["k"]), ["k"])


@query(ORDER_COUNTS.replace("count(*) AS cnt", "count(*) AS cnt"))
def cumulative_packed_roundtrip(spark, sf_dir):
    cum = qt.cumulate(order_cells(spark, sf_dir), ["k"])
    packed = cells.to_packed(cum, ["k"], MONEY, count="cum")
    return qt.cumulative_to_cells(cells.packed_to_cells(packed, ["k"], MONEY, count="cum", cumulative=True), ["k"])


@query(f"SELECT k, idx, cnt, round((cum - cnt) / total::DOUBLE, 9) AS lower_q, round(cum / total::DOUBLE, 9) AS upper_q FROM ({_RUNNING})")
def iter_with_quantiles(spark, sf_dir):
    r = qt.with_quantile_ranges(order_cells(spark, sf_dir), ["k"], MONEY)
    return r.select("k", "idx", "cnt", F.round("lower_q", 9).alias("lower_q"), F.round("upper_q", 9).alias("upper_q"))


@query(f"SELECT k, 3 AS position, round((cum - cnt) / total::DOUBLE, 9) AS lower_q, round(cum / total::DOUBLE, 9) AS upper_q FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY idx) AS r FROM ({_RUNNING})) WHERE r = 4")
def bucket_quantile_range(spark, sf_dir):
    r = qt.bucket_quantile_range(order_cells(spark, sf_dir), ["k"], 3, MONEY)
    return r.select("k", "position", F.round("lower_q", 9).alias("lower_q"), F.round("upper_q", 9).alias("upper_q"))


@query(f"SELECT event_type, round(CAST(sum((lo + hi) * cnt) AS DOUBLE) / 2 / CAST(sum(cnt) AS DOUBLE), 6) AS mean FROM (SELECT event_type, cnt, {_lower('idx', 7)} AS lo, {_upper('idx', 7)} AS hi FROM (SELECT event_type, {_index(VALUE, 7)} AS idx, count(*) AS cnt FROM events GROUP BY 1, 2)) GROUP BY 1")
def mean_midpoint(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_type", cents("value").alias("v"))
    m = qt.mean(cells.record(rows, ["event_type"], F.col("v"), MONEY), ["event_type"], MONEY)
    return m.select("event_type", F.round("mean", 6).alias("mean"))


@query(f"SELECT l_returnflag, max(CASE WHEN (hi - lo) * 100.0 / greatest(lo, 1) > {100 / 2**7} THEN 1 ELSE 0 END) AS beyond FROM (SELECT l_returnflag, {_lower('idx', 7)} AS lo, {_upper('idx', 7)} AS hi FROM ({PRICE_COUNTS})) GROUP BY 1")
def rel_error_check(spark, sf_dir):
    b = qt.buckets(price_cells(spark, sf_dir), ["l_returnflag"], MONEY)
    beyond = (F.col("hi") - F.col("lo")) * 100.0 / F.greatest("lo", F.lit(1)) > MONEY.error
    return b.groupBy("l_returnflag").agg(F.max(beyond.cast("int")).alias("beyond"))


@query(_ranked("documents", "lang", "n_chars", 7, [0.5, 0.9, 0.99]))
def doc_length_quantiles(spark, sf_dir):
    c = cells.record(table(spark, sf_dir, "documents").select("lang", "n_chars"), ["lang"], F.col("n_chars"), MONEY)
    return _spread(qt.quantiles(c, ["lang"], [0.5, 0.9, 0.99], MONEY), "lang")


_LEVELS = f"SELECT l_returnflag AS f, l_linestatus AS s, {PRICE} AS v FROM lineitem UNION ALL SELECT l_returnflag, NULL, {PRICE} FROM lineitem UNION ALL SELECT NULL, NULL, {PRICE} FROM lineitem"


@query(
    f"SELECT f, s, q, {_lower('idx', 7)} AS lo, {_upper('idx', 7)} AS hi, total FROM (SELECT f, s, q, n AS total, {_index('v', 7)} AS idx FROM (SELECT f, s, v, row_number() OVER (PARTITION BY f, s ORDER BY v) AS r, "
    f"count(*) OVER (PARTITION BY f, s) AS n FROM ({_LEVELS})) JOIN (VALUES (0.5::DOUBLE), (0.99::DOUBLE)) t(q) ON r = greatest(1, CAST(ceil(q * CAST(n AS DOUBLE)) AS BIGINT)))"
)
def rollup_quantiles(spark, sf_dir):
    rows = prices(spark, sf_dir, "l_linestatus")
    base = cells.record(rows, ["l_returnflag", "l_linestatus"], F.col("v"), MONEY)
    levels = algebra.rolled_up(base, ["l_returnflag", "l_linestatus"]).withColumnsRenamed({"l_returnflag": "f", "l_linestatus": "s"})
    return _spread(qt.quantiles(levels, ["f", "s", "level"], [0.5, 0.99], MONEY), "f", "s")


@query(f"SELECT l_returnflag, round(CAST(sum(CAST(lo + hi AS HUGEINT) * cnt) AS DOUBLE) / 2 / CAST(sum(cnt) AS DOUBLE), 3) AS mean FROM (SELECT l_returnflag, {_lower('idx', 7)} AS lo, {_upper('idx', 7)} AS hi, CAST(cnt AS HUGEINT) * 10000000000000000 AS cnt FROM ({PRICE_COUNTS})) GROUP BY 1")
def mean_large_counts(spark, sf_dir):
    weight = F.lit("10000000000000000").cast("decimal(20,0)")
    heavy = cells.record(prices(spark, sf_dir), ["l_returnflag"], F.col("v"), MONEY, weight=weight, width=None)
    return qt.mean(heavy, ["l_returnflag"], MONEY).select("l_returnflag", F.round("mean", 3).alias("mean"))


# --- widths ----------------------------------------------------------------------------------------------------------------


def heavy_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = prices(spark, sf_dir, "l_quantity")
    return cells.record(rows, ["l_returnflag"], F.col("v"), MONEY, weight=F.col("l_quantity").cast("long") * 1_000_000)


_HEAVY = f"SELECT l_returnflag, {_index(PRICE, 7)} AS idx, sum(CAST(l_quantity AS BIGINT) * 1000000) AS s FROM lineitem GROUP BY 1, 2"


@query(f"SELECT l_returnflag, CASE WHEN max(s) > 4294967295 THEN 'Overflow' END AS status FROM ({_HEAVY}) GROUP BY 1")
def narrow_u32_status(spark, sf_dir):
    return convert.narrow(heavy_cells(spark, sf_dir), ["l_returnflag"], errors="status")


@query(f"SELECT l_returnflag, CASE WHEN sum(s) > 4294967295 THEN 'Overflow' END AS status FROM ({_HEAVY}) GROUP BY 1")
def narrow_total_status(spark, sf_dir):
    return convert.narrow_total(heavy_cells(spark, sf_dir), ["l_returnflag"], errors="status")


@query(f"SELECT k, idx, cum FROM ({_RUNNING})")
def narrow_cumulative(spark, sf_dir):
    return convert.narrow_total(order_cells(spark, sf_dir), ["k"])


@query(ORDER_COUNTS)
def widen_narrow_roundtrip(spark, sf_dir):
    return _plain(convert.widen(convert.narrow(order_cells(spark, sf_dir), ["k"]), ["k"]))


# --- snapshots and windows ---------------------------------------------------------------------------------------------------


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_type", "ts", cents("value").alias("v"))


@query(f"SELECT event_type, date_trunc('day', ts) AS day, {_index(VALUE, 4)} AS idx, count(*) AS cnt FROM events GROUP BY 1, 2, 3")
def snapshot_delta(spark, sf_dir):
    daily = events(spark, sf_dir).select("event_type", F.date_trunc("day", F.col("ts")).cast("timestamp_ntz").alias("day"), COARSE.index_of(F.col("v")).alias("idx"))
    counted = daily.groupBy("event_type", "day", "idx").agg(F.count("*").alias("cnt"))
    running = F.sum("cnt").over(Window.partitionBy("event_type", "idx").orderBy("day"))
    return recorder.deltas(counted.select("event_type", "day", "idx", running.alias("cnt")), ["event_type"], "day")


@query(f"SELECT event_type, date_trunc('day', ts) AS start, date_trunc('day', ts) + INTERVAL 1 DAY AS \"end\", {_index(VALUE, 4)} AS idx, count(*) AS cnt FROM events GROUP BY 1, 2, 3, 4")
def drain_windows(spark, sf_dir):
    w = recorder.windowed_counts(events(spark, sf_dir), ["event_type"], "ts", F.col("v"), COARSE)
    return w.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


@query(
    f"SELECT event_type, s AS start, s + INTERVAL 2 HOUR AS \"end\", {_index(VALUE, 4)} AS idx, count(*) AS cnt FROM "
    f"(SELECT *, date_trunc('hour', ts) AS s FROM events UNION ALL SELECT *, date_trunc('hour', ts) - INTERVAL 1 HOUR FROM events) GROUP BY 1, 2, 3, 4"
)
def sliding_windows(spark, sf_dir):
    w = recorder.windowed_counts(events(spark, sf_dir), ["event_type"], "ts", F.col("v"), COARSE, every="2 hours", slide="1 hour")
    return w.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


_FALLS = f"SELECT event_type, day, idx, cnt % 3 AS cnt FROM (SELECT event_type, date_trunc('day', ts) AS day, {_index(VALUE, 4)} AS idx, count(*) AS cnt FROM events GROUP BY 1, 2, 3)"
_GROWN = f"SELECT *, cnt - coalesce(lag(cnt) OVER (PARTITION BY event_type, idx ORDER BY day), 0) AS d FROM ({_FALLS})"


def falling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots of counters that were set back now and then."""
    daily = events(spark, sf_dir).select("event_type", F.date_trunc("day", F.col("ts")).cast("timestamp_ntz").alias("day"), COARSE.index_of(F.col("v")).alias("idx"))
    return daily.groupBy("event_type", "day", "idx").agg((F.count("*") % 3).alias("cnt"))


@query(f"SELECT event_type, day, idx, CAST(CASE WHEN d < 0 THEN d + 4294967296 ELSE d END AS BIGINT) AS cnt FROM ({_GROWN}) WHERE d <> 0")
def delta_wrapping(spark, sf_dir):
    return recorder.deltas(falling(spark, sf_dir), ["event_type"], "day", checked=False, width=U32)


@query(f"SELECT event_type, day, CASE WHEN min(d) < 0 THEN 'Underflow' END AS status FROM ({_GROWN}) GROUP BY 1, 2")
def delta_status(spark, sf_dir):
    return recorder.deltas(falling(spark, sf_dir), ["event_type"], "day", errors="status")


@query(f"SELECT * FROM (SELECT event_type, date_trunc('day', ts) AS start, date_trunc('day', ts) + INTERVAL 1 DAY AS \"end\", {_index(VALUE, 4)} AS idx, CAST(sum(CAST(user_id AS HUGEINT) * 100000000) % 4294967296 AS BIGINT) AS cnt FROM events GROUP BY 1, 2, 3, 4) WHERE cnt <> 0")
def drain_weighted_u32(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_type", "ts", "user_id", cents("value").alias("v"))
    w = recorder.windowed_counts(rows, ["event_type"], "ts", F.col("v"), COARSE, weight=F.col("user_id") * 100_000_000, width=U32)
    return w.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")}).where("cnt <> 0")


@query(
    f"SELECT user_id, CAST(min(ts) OVER (PARTITION BY user_id, s) AS TIMESTAMP) AS start, idx, cnt FROM (SELECT user_id, s, min(t) AS ts, idx, count(*) AS cnt FROM (SELECT *, min(ts) OVER (PARTITION BY user_id, s) AS t, {_index('v', 4)} AS idx FROM "
    f"(SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT user_id, ts, {VALUE} AS v, "
    f"CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events))) GROUP BY 1, 2, 4)"
)
def session_cells(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "ts", cents("value").alias("v"))
    found = recorder.session_counts(rows, ["user_id"], "ts", F.col("v"), COARSE, gap="6 hours")
    return found.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.explode("counts").alias("idx", "cnt"))


_SESSIONS = f"SELECT event_type, s, {_index('v', 4)} AS idx, user_id, min(ts) OVER (PARTITION BY event_type, s) AS a, max(ts) OVER (PARTITION BY event_type, s) AS z FROM (SELECT *, sum(fresh) OVER (PARTITION BY event_type ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT event_type, ts, user_id, {VALUE} AS v, CASE WHEN ts <= lag(ts) OVER (PARTITION BY event_type ORDER BY ts) + INTERVAL 40 MINUTE THEN 0 ELSE 1 END AS fresh FROM events))"


@query(f"SELECT event_type, a AS start, z + INTERVAL 40 MINUTE AS \"end\", idx, CAST(sum(CAST(user_id AS HUGEINT) * 4611686018427387904) % 18446744073709551616 AS VARCHAR) AS cnt FROM ({_SESSIONS}) GROUP BY 1, 2, 3, 4")
def session_weights(spark, sf_dir):
    """Sessions of few keys, so long ones, with weights that wrap at 64 bits."""
    rows = table(spark, sf_dir, "events").select("event_type", "ts", "user_id", cents("value").alias("v"))
    weight = F.col("user_id").cast("decimal(10,0)") * F.lit(1 << 62).cast("decimal(20,0)")
    found = recorder.session_cells(rows, ["event_type"], "ts", F.col("v"), COARSE, weight=F.pmod(weight, F.lit(str(1 << 64)).cast("decimal(30,0)")), gap="40 minutes")
    return found.select("event_type", *(F.col(c).cast("timestamp_ntz").alias(c) for c in ("start", "end")), "idx", F.col("cnt").cast("string").alias("cnt"))


@query(f"SELECT event_type, date_trunc('day', ts) AS start, date_trunc('day', ts) + INTERVAL 1 DAY AS \"end\", CASE WHEN {VALUE} < 16384 THEN {_index(VALUE, 4)} ELSE -1 END AS idx, count(*) AS cnt FROM events GROUP BY 1, 2, 3, 4")
def windows_out_of_range(spark, sf_dir):
    """Windows that also say how many values were beyond the range."""
    w = recorder.windowed_counts(events(spark, sf_dir), ["event_type"], "ts", F.col("v"), Config(4, 14), invalid="flag")
    return w.select("event_type", *(F.col(c).cast("timestamp_ntz").alias(c) for c in ("start", "end")), F.coalesce("idx", F.lit(-1).cast("long")).alias("idx"), "cnt")


# --- footprint ---------------------------------------------------------------------------------------------------------------

_SIZES = f"SELECT k, count(*) AS nnz, {footprint.DENSE_STRUCT + 8 * MONEY.total_buckets} AS dense_bytes, {footprint.SPARSE_STRUCT} + 12 * count(*) AS sparse_bytes, {footprint.CUMULATIVE_STRUCT} + 12 * count(*) AS cumulative_bytes FROM ({ORDER_COUNTS}) GROUP BY 1"


@query(_SIZES)
def footprint_stats(spark, sf_dir):
    return footprint.sizes_of_cells(order_cells(spark, sf_dir), ["k"], MONEY)


@query(
    f"SELECT k, count(*) AS samples, min(nnz) AS min_nnz, max(nnz) AS max_nnz, round(avg(nnz), 6) AS mean_nnz, CAST(sum(dense_bytes) AS BIGINT) AS dense_bytes, CAST(sum(sparse_bytes) AS BIGINT) AS sparse_bytes, "
    f"CAST(sum(cumulative_bytes) AS BIGINT) AS cumulative_bytes, "
    + "".join(f"min({f}_bytes) AS min_{f}_bytes, max({f}_bytes) AS max_{f}_bytes, round(avg({f}_bytes), 6) AS mean_{f}_bytes, " for f in ("dense", "sparse", "cumulative"))
    + f"CAST({MONEY.p} AS TINYINT) AS p, CAST({MONEY.n} AS TINYINT) AS n, CAST({MONEY.total_buckets} AS BIGINT) AS buckets, round(100 * (1 - sum(sparse_bytes) / sum(dense_bytes)::DOUBLE), 6) AS sparse_saving, round(100 * (1 - sum(cumulative_bytes) / sum(dense_bytes)::DOUBLE), 6) AS cumulative_saving, "
    f"round(sum(sparse_bytes) / sum(dense_bytes)::DOUBLE, 6) AS sparse_ratio, round(sum(cumulative_bytes) / sum(dense_bytes)::DOUBLE, 6) AS cumulative_ratio "
    f"FROM ({_SIZES}) GROUP BY ROLLUP (k)"
)
def footprint_rollup(spark, sf_dir):
    sized = footprint.sizes_of_cells(order_cells(spark, sf_dir), ["k"], MONEY)
    r = footprint.report(sized.withColumns({"p": F.lit(MONEY.p).cast("tinyint"), "n": F.lit(MONEY.n).cast("tinyint")}), ["k"])
    return r.withColumns({c: F.round(c, 6) for c in r.columns if c.startswith("mean_") or c.endswith(("_saving", "_ratio"))})


@query(f"SELECT l_returnflag, CAST(floor(log2(least)) AS INTEGER) AS lower_power, CASE WHEN floor(log2(least)) <= 9 THEN CAST(pow(2, floor(log2(least))) AS BIGINT) ELSE CAST((floor(log2(least)) - 7) * 256 AS BIGINT) END AS spared FROM ({_FITTED})")
def truncation_saving(spark, sf_dir):
    """What the distribution of each flag spares that starts at the power of two below its least price."""
    power = F.floor(F.log2("least")).cast("int")
    return fitted(spark, sf_dir).select("l_returnflag", power.alias("lower_power"), footprint.truncation_saving_of(F.lit(8), power).alias("spared"))


@query(f"SELECT k, idx, cnt FROM ({ORDER_COUNTS}) WHERE idx >= {MONEY.index(1 << 24)}")
def truncated_cells(spark, sf_dir):
    return footprint.truncated(order_cells(spark, sf_dir), MONEY, 24)


# --- parameters by row -------------------------------------------------------------------------------------------------------

#: Of each remainder of the line number by three, the parameters its prices are recorded at.
MIXED = {0: (8, 40), 1: (5, 50), 2: (7, 62)}
_OF = "CASE l_linenumber % 3 " + " ".join(f"WHEN {r} THEN {{{r}}}" for r in MIXED) + " END"


def _by_row(f) -> str:
    return _OF.format(*(f(p, n) for p, n in MIXED.values()))


_P, _N = _by_row(lambda p, n: f"CAST({p} AS TINYINT)"), _by_row(lambda p, n: f"CAST({n} AS TINYINT)")
_ROW_INDEX = _by_row(lambda p, n: _index(PRICE, p))


def mixed_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.col("l_linenumber") % 3
    pick = lambda i: F.element_at(F.create_map(*(F.lit(x) for k, v in MIXED.items() for x in (k, v[i]))), r)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", pick(0).alias("p"), pick(1).alias("n"), cents("l_extendedprice").alias("v"))


def mixed_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed.record_mixed(mixed_prices(spark, sf_dir), ["l_returnflag"], F.col("v"))


@query(f"SELECT l_orderkey, l_linenumber, p, idx, {_OF.format(*(_lower('idx', p) for p, _ in MIXED.values()))} AS lo, {_OF.format(*(_upper('idx', p) for p, _ in MIXED.values()))} AS hi FROM (SELECT l_orderkey, l_linenumber, {_P} AS p, {_ROW_INDEX} AS idx FROM lineitem)")
def mixed_bounds(spark, sf_dir):
    c = RowConfig()
    rows = mixed_prices(spark, sf_dir).withColumn("idx", c.index_of(F.col("v")))
    return rows.select("l_orderkey", "l_linenumber", F.col("p").cast("tinyint"), "idx", c.lower_of(F.col("idx")).alias("lo"), c.upper_of(F.col("idx")).alias("hi"))


_PAIR = "SELECT DISTINCT CAST(l_linenumber * 5 AS INTEGER) AS p, CAST(l_quantity AS INTEGER) + 16 AS n FROM lineitem"


@query(
    f"SELECT p, n, status, CASE WHEN status IS NULL THEN CAST((n - p + 1) * pow(2, p) AS BIGINT) END AS buckets, CASE WHEN status IS NULL THEN CASE WHEN p = n - 1 THEN 0 ELSE 100 / pow(2, p) END END AS error, n = p + 1 AS finest "
    f"FROM (SELECT *, CASE WHEN n > 64 THEN 'MaxPowerTooHigh' WHEN p >= n THEN 'MaxPowerTooLow' WHEN (n - p + 1) * pow(2, p) >= 4294967296 THEN 'IncompatibleParameters' END AS status FROM ({_PAIR}))"
)
def mixed_parameters(spark, sf_dir):
    """Which pairs of parameters that rows bring are configurations, and which of them are equal to the finest of their p."""
    c = RowConfig(wide=True)
    pairs = table(spark, sf_dir, "lineitem").select((F.col("l_linenumber") * 5).alias("p"), (F.col("l_quantity").cast("int") + 16).alias("n")).distinct()
    status = c.error_name()
    good = lambda x: F.when(status.isNull(), x)
    return pairs.select("p", "n", status.alias("status"), good(c.total_buckets_of()).alias("buckets"), good(c.error_of()).alias("error"), same_parameters(F.col("p"), F.col("n"), F.col("p"), F.col("p") + 1).alias("finest"))


@query(f"SELECT l_returnflag, {_P} AS p, {_N} AS n, {_ROW_INDEX} AS idx, count(*) AS cnt FROM lineitem GROUP BY 1, 2, 3, 4")
def mixed_record(spark, sf_dir):
    return mixed_cells(spark, sf_dir)


@query(f"SELECT l_returnflag, CAST(5 AS TINYINT) AS p, CAST(62 AS TINYINT) AS n, {_index(PRICE, 5)} AS idx, count(*) AS cnt FROM lineitem GROUP BY 1, 4")
def mixed_aligned(spark, sf_dir):
    return mixed.align(mixed_cells(spark, sf_dir), ["l_returnflag"])


@query(_ranked("lineitem", "l_returnflag", PRICE, 5, QS))
def mixed_quantiles(spark, sf_dir):
    """Recorded at three pairs of parameters, aligned and merged: the quantiles are those of recording at the common one."""
    found = qt.quantiles(mixed.align(mixed_cells(spark, sf_dir), ["l_returnflag"]), ["l_returnflag", "p", "n"], QS, RowConfig())
    return _spread(found, "l_returnflag")


@query(f"SELECT l_returnflag, {_P} AS p, {_N} AS n, {_OF.format(*(_index(PRICE, p - 2) for p, _ in MIXED.values()))} AS idx, count(*) AS cnt FROM lineitem GROUP BY 1, 2, 3, 4".replace(_P, f"CAST({_P} - 2 AS TINYINT)"))
def mixed_downsample(spark, sf_dir):
    return mixed.downsample_mixed(mixed_cells(spark, sf_dir), ["l_returnflag"], F.col("p") - 2)


@query(f"SELECT l_returnflag, CASE WHEN count(DISTINCT {_P}) > 1 THEN 'IncompatibleParameters' END AS status FROM lineitem GROUP BY 1")
def mixed_merge_status(spark, sf_dir):
    counted = mixed_cells(spark, sf_dir)
    return mixed.add_mixed(counted.where("p = 8"), counted.where("p <> 8"), ["l_returnflag"], errors="status")


@query(f"SELECT l_returnflag, CAST(5 AS TINYINT) AS p, CAST(62 AS TINYINT) AS n, {_index(PRICE, 5)} AS idx, count(*) AS cnt FROM lineitem GROUP BY 1, 4")
def mixed_merge_aligned(spark, sf_dir):
    counted = mixed_cells(spark, sf_dir)
    return _plain(mixed.add_mixed(counted.where("p = 8"), counted.where("p <> 8"), ["l_returnflag"], mismatch="align"))


@query(f"SELECT l_returnflag, CAST(5 AS TINYINT) AS p, CAST(62 AS TINYINT) AS n, {_index(PRICE, 5)} AS idx, count(*) FILTER (WHERE l_linenumber % 3 <> 0) AS cnt FROM lineitem GROUP BY 1, 4")
def mixed_subtract(spark, sf_dir):
    counted = mixed_cells(spark, sf_dir)
    return _plain(mixed.subtract_aligned(counted, counted.where("p = 8"), ["l_returnflag"]))


@query(f"SELECT l_returnflag, {_by_row(lambda p, n: f'CAST({p - 4} AS TINYINT)')} AS p, CAST(26 AS TINYINT) AS n, {_by_row(lambda p, n: _index(PRICE, p - 4))} AS idx, count(*) AS cnt FROM lineitem GROUP BY 1, 2, 4")
def mixed_dense_roundtrip(spark, sf_dir):
    rows = mixed_prices(spark, sf_dir).select("l_returnflag", (F.col("p") - 4).alias("p"), F.lit(26).alias("n"), "v")
    dense = mixed.mixed_to_dense(mixed.record_mixed(rows, ["l_returnflag"], F.col("v")), ["l_returnflag"])
    return mixed.dense_to_mixed(dense, ["l_returnflag"])


# --- recordings in files -----------------------------------------------------------------------------------------------------


def scratch(spark: SparkSession) -> str:
    """A new folder in the one that the cluster's driver and executors share; on one machine, where none is named, a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{named or tempfile.mkdtemp(prefix='spark-', dir='/tmp')}/{uuid.uuid4().hex}"


_RECORDED = ", ".join(f"('{c}', {p}, {n}, '{k}')" for c, p, n, k in (("price", 2, 26, "1-URGENT"), ("price", 2, 26, "2-HIGH"), ("price", 3, 27, "3-MEDIUM"), ("price", 3, 27, "5-LOW"), ("day", 2, 26, "3-MEDIUM"), ("day", 2, 26, "5-LOW")))


@query(
    f"SELECT \"column\", CAST(p AS TINYINT) AS p, CAST(n AS TINYINT) AS n, CASE WHEN \"column\" = 'day' THEN {_index('d', 2)} WHEN p = 2 THEN {_index('v', 2)} ELSE {_index('v', 3)} END AS idx, count(*) AS cnt "
    f"FROM (SELECT o_orderpriority AS k, {TOTAL} AS v, CAST(dayofyear(o_orderdate) AS BIGINT) AS d FROM orders) JOIN (VALUES {_RECORDED}) r(\"column\", p, n, k) USING (k) GROUP BY 1, 2, 3, 4"
)
def recorded_files(spark, sf_dir):
    """Recordings written to two folders with other parameters and columns, read back in one pass, and merged by column and parameters."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("k"), cents("o_totalprice").alias("v"), F.dayofyear("o_orderdate").cast("long").alias("d"))
    out, finer = scratch(spark), Config(3, 27)

    def dense(part: DataFrame, value: str, config: Config) -> DataFrame:
        return cells.to_dense(cells.record(part, ["k"], F.col(value), config), ["k"], config).select("k", F.col("counts").alias(value))

    early, late = rows.where("k in ('1-URGENT', '2-HIGH')"), rows.where("k in ('3-MEDIUM', '5-LOW')")
    write_recordings(dense(early, "v", SMALL).withColumnRenamed("v", "price"), f"{out}/early", {"price": SMALL})
    both = dense(late, "v", finer).join(dense(late, "d", SMALL), "k").withColumnsRenamed({"v": "price", "d": "day"})
    write_recordings(both, f"{out}/late", {"price": finer, "day": SMALL})
    found = mixed.dense_to_mixed(read_recordings(spark, out, kind="distribution"), ["column"])
    return found.groupBy("column", "p", "n", "idx").agg(F.sum("cnt").cast("long").alias("cnt"))


# --- recorders that keep running -----------------------------------------------------------------------------------------------

HALF = "2024-01-16"
_STAGES = f"SELECT event_type, CASE WHEN ts < TIMESTAMP '{HALF}' THEN 1 ELSE 2 END AS stage, {VALUE} AS v, user_id FROM events"


def staged(spark: SparkSession, sf_dir: str, home: str, make: Callable[[DataFrame], DataFrame], *stages: int) -> DataFrame:
    """What a streaming query of ``make`` gives out over the events of each stage, followed by a request for a load of every type with the stage's number.
    The query ends after every stage and starts again from its checkpoint."""
    rows = table(spark, sf_dir, "events").select("event_type", F.when(F.col("ts") < F.lit(HALF).cast("timestamp_ntz"), 1).otherwise(2).alias("stage"), F.lit("record").alias("event"), cents("value").alias("v"), "user_id")
    asked = rows.select("event_type", "stage").distinct().select("event_type", "stage", F.lit("load").alias("event"), F.lit(None).cast("long").alias("v"), F.lit(None).cast("long").alias("user_id"))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    stateful.use_rocksdb(spark)
    try:
        for stage in stages:
            rows.where(F.col("stage") == stage).unionByName(asked.where(F.col("stage") == stage)).write.mode("append").parquet(f"{home}/in")
            source = spark.readStream.schema(rows.schema).parquet(f"{home}/in")
            run = make(source).writeStream.format("parquet").option("checkpointLocation", f"{home}/state").trigger(availableNow=True).start(f"{home}/out")
            run.awaitTermination()
    finally:
        if before is not None:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return spark.read.parquet(f"{home}/out")


def running(source: DataFrame, **more) -> DataFrame:
    return stateful.running_cells(source, ["event_type"], F.col("v"), COARSE, event=F.col("event"), tag=F.col("stage"), **more)


@query(f"SELECT event_type, CAST(t AS BIGINT) AS stage, {_index('v', 4)} AS idx, CAST(count(*) AS BIGINT) AS cnt FROM ({_STAGES}) JOIN (VALUES (1), (2)) x(t) ON stage <= t GROUP BY 1, 2, 3")
def running_loads(spark, sf_dir):
    """Two loads of a recorder that goes on counting, with a restart between them."""
    out = staged(spark, sf_dir, scratch(spark), lambda s: running(s, parts=4), 1, 2)
    return out.select("event_type", F.col("tag").alias("stage"), "idx", F.col("cnt").cast("long").alias("cnt"))


@query(f"SELECT event_type, {_index('v', 4)} AS idx, CAST(count(*) FILTER (WHERE stage = 1) AS BIGINT) AS before, CAST(count(*) AS BIGINT) AS cnt FROM ({_STAGES}) GROUP BY 1, 2")
def running_snapshot(spark, sf_dir):
    """The counters in a recorder's state, after its last batch and as they were after its first."""
    home = scratch(spark)
    staged(spark, sf_dir, home, running, 1, 2)
    now, first = (stateful.snapshot(spark, f"{home}/state", ["event_type"], batch=b) for b in (None, 0))
    both = now.withColumn("before", F.lit(0)).unionByName(first.withColumn("before", F.col("cnt")).withColumn("cnt", F.lit(0)))
    return both.groupBy("event_type", "idx").agg(*(F.sum(c).cast("long").alias(c) for c in ("before", "cnt")))


@query(
    f"SELECT event_type, {_index('v', 4)} AS idx, CAST(coalesce(sum(CAST(user_id AS HUGEINT) * 100000000) FILTER (WHERE stage = 1), 0) % 4294967296 + coalesce(sum(CAST(user_id AS HUGEINT) * 100000000) FILTER (WHERE stage = 2), 0) AS BIGINT) AS cnt "
    f"FROM ({_STAGES}) GROUP BY 1, 2 HAVING cnt <> 0"
)
def running_widened(spark, sf_dir):
    """A recorder of 32 bits, which wraps, hands its counters to one of 64 bits, which goes on with them."""
    home, weight = scratch(spark), F.col("user_id") * 100_000_000
    staged(spark, sf_dir, f"{home}/narrow", lambda s: running(s, weight=weight, width=U32), 1)
    start = stateful.snapshot(spark, f"{home}/narrow/state", ["event_type"])
    staged(spark, sf_dir, f"{home}/wide", lambda s: running(s, weight=weight, initial=start), 2)
    return stateful.snapshot(spark, f"{home}/wide/state", ["event_type"]).withColumn("cnt", F.col("cnt").cast("long"))


# --- packed rows, digests, SQL functions ---------------------------------------------------------------------------------------


def stored(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Written down in the shared folder and read again, as distributions that are kept are."""
    path = scratch(spark)
    df.write.parquet(path)
    return spark.read.parquet(path)


def packed_orders(spark: SparkSession, sf_dir: str, count: str = "cnt") -> DataFrame:
    counted = order_cells(spark, sf_dir)
    return cells.to_packed(qt.cumulate(counted, ["k"]) if count == "cum" else counted, ["k"], MONEY, count=count)


@query(_ranked("(SELECT o_orderpriority AS k, o_totalprice FROM orders)", "k", TOTAL, 7, QS))
def quantiles_packed(spark, sf_dir):
    """Quantiles of stored rows of running sums, each found by a search within the row."""
    return _spread(packed.packed_quantiles(stored(spark, packed_orders(spark, sf_dir, "cum")), ["k"], QS, MONEY), "k")


def packed_prices(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stored packed rows of all prices, the early and the late ones; the late ones of one flag are not there at all."""
    early, late = halves(spark, sf_dir)
    parts = (price_cells(spark, sf_dir), early, late.where("l_returnflag <> 'R'"))
    return tuple(stored(spark, cells.to_packed(x, ["l_returnflag"], MONEY)) for x in parts)


@query(f"SELECT l_returnflag, {_index(PRICE, 7)} AS idx, count(*) AS cnt FROM lineitem WHERE l_returnflag <> 'R' OR l_shipdate < TIMESTAMP '{DAY}' GROUP BY 1, 2")
def packed_add(spark, sf_dir):
    _, early, late = packed_prices(spark, sf_dir)
    return _plain(cells.packed_to_cells(packed.merge_packed(early, late, ["l_returnflag"], MONEY, validate=True), ["l_returnflag"], MONEY))


@query(_rest("sparse"))
def packed_subtract(spark, sf_dir):
    everything, early, _ = packed_prices(spark, sf_dir)
    return _plain(cells.packed_to_cells(packed.merge_packed(everything, early, ["l_returnflag"], MONEY, operation="subtract"), ["l_returnflag"], MONEY))


@query(ORACLES["subtract_not_subset"])
def packed_subtract_status(spark, sf_dir):
    everything, early, _ = packed_prices(spark, sf_dir)
    return packed.merge_packed(early, everything, ["l_returnflag"], MONEY, operation="subtract", errors="status")


@query(f"SELECT k, round(CAST(sum((lo + hi) * cnt) AS DOUBLE) / 2 / CAST(sum(cnt) AS DOUBLE), 6) AS mean, CAST(sum(cnt) AS BIGINT) AS total, 1 AS means FROM (SELECT k, cnt, {_lower('idx', 7)} AS lo, {_upper('idx', 7)} AS hi FROM ({ORDER_COUNTS})) GROUP BY 1")
def cumulative_means(spark, sf_dir):
    """The running-sum form of cells, of dense arrays, of JSON texts and of 32-bit counters that are widened: stored with its mean, it is one mean to the last bit."""
    counted = order_cells(spark, sf_dir)
    form = lambda c: packed.with_derived(cells.to_packed(qt.cumulate(c, ["k"]), ["k"], MONEY, count="cum"), MONEY)
    sparse = stored(spark, form(counted))
    dense = form(cells.dense_to_cells(cells.to_dense(counted, ["k"], MONEY), ["k"], "counts", MONEY))
    texts = packed.checked_derived(from_json(to_json(sparse, ["k"]), ["k"], sparse.drop("k").schema).select(*sparse.columns), MONEY)
    narrow = packed.with_derived(cells.to_packed(convert.narrow_total(counted, ["k"]), ["k"], MONEY, count="cum"), MONEY)
    wide = packed.widen_derived(narrow, MONEY)
    forms = [x.select("k", "mean", F.col("total").cast("long").alias("total")) for x in (sparse, dense, texts, wide)]
    every = forms[0].unionByName(forms[1]).unionByName(forms[2]).unionByName(forms[3])
    return every.groupBy("k").agg(F.round(F.first("mean"), 6).alias("mean"), F.first("total").alias("total"), F.countDistinct("mean").cast("int").alias("means"))


@query(
    f"SELECT l_returnflag, count(*) FILTER (WHERE l_shipdate >= TIMESTAMP '{DAY}') = 0 AS same_as_early, true AS same_as_sum, min(idx) FILTER (WHERE late > 0) AS first_idx, arg_min(early, idx) FILTER (WHERE late > 0) AS right_cnt "
    f"FROM (SELECT *, count(*) FILTER (WHERE l_shipdate >= TIMESTAMP '{DAY}') OVER (PARTITION BY l_returnflag, idx) AS late, count(*) FILTER (WHERE l_shipdate < TIMESTAMP '{DAY}') OVER (PARTITION BY l_returnflag, idx) AS early FROM (SELECT l_returnflag, l_shipdate, {_index(PRICE, 7)} AS idx FROM lineitem)) GROUP BY 1"
)
def equal_distributions(spark, sf_dir):
    """All prices against the sum of two halves, and against one half, with the first bucket that differs."""
    everything, (early, late), key = price_cells(spark, sf_dir), halves(spark, sf_dir), ["l_returnflag"]
    summed = compare.equality(everything, algebra.add(early, late, key, MONEY), key, MONEY).withColumnRenamed("equal", "same_as_sum")
    part = compare.equality(everything, early, key, MONEY).withColumnRenamed("equal", "same_as_early")
    first = compare.first_differences(everything, early, key, MONEY).select("l_returnflag", F.col("idx").alias("first_idx"), F.col("right_cnt").cast("long").alias("right_cnt"))
    return summed.join(part, key).join(first, key, "left")


@query(f"SELECT l_returnflag, q, lo, hi, cnt, total FROM ({_ranked('lineitem', 'l_returnflag', PRICE, 7, [0.0, 0.5, 0.99])}) JOIN (SELECT l_returnflag, {_lower('idx', 7)} AS lo, cnt FROM ({PRICE_COUNTS})) USING (l_returnflag, lo)")
def quantiles_in_sql(spark, sf_dir):
    """From the table to the quantiles in SQL alone, by the session's functions."""
    sql_functions.register(spark)
    name = f"lines_{uuid.uuid4().hex}"
    table(spark, sf_dir, "lineitem").createOrReplaceTempView(name)
    return spark.sql(f"""
        WITH counted AS (SELECT l_returnflag, bucket_checked(CAST(round(l_extendedprice * 100) AS BIGINT), 7, 62) AS idx, count(*) AS cnt FROM {name} GROUP BY 1, 2),
        running AS (SELECT l_returnflag, idx, sum(cnt) OVER (PARTITION BY l_returnflag ORDER BY idx) AS cum FROM counted),
        stored AS (SELECT l_returnflag, sort_array(collect_list(struct(idx, cum))) AS c FROM running GROUP BY 1)
        SELECT l_returnflag, q.q, q.lo, q.hi, q.cnt, q.total FROM (SELECT l_returnflag, c.idx AS idx, c.cum AS cum FROM stored) s, LATERAL bucket_quantiles(s.idx, s.cum, array(0D, 0.5D, 0.99D), 7, 62) q
    """)
