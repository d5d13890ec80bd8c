"""The bucketing functions for SQL: temporary functions of a session, made of built-in expressions, which Spark inlines into the query's plan.

    register(spark)
    SELECT bucket_lower(bucket_index(v, 7), 7), bucket_upper(bucket_index(v, 7), 7, 62), count(*) FROM t GROUP BY ALL
    SELECT k, q.* FROM stored, LATERAL bucket_quantiles(idx, cum, array(0.5D, 0.99D), p, n) q

Values are longs, so ``n`` is at most 63; one beyond 2 ** n - 1, or below 0, fails the query with OutOfRange.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

_LOWER = "CASE WHEN shiftrightunsigned(i, p) < 1 THEN i ELSE shiftleft((i & (shiftleft(1L, p) - 1)) | shiftleft(1L, p), CAST(shiftrightunsigned(i, p) AS INT) - 1) END"

FUNCTIONS = {
    "bucket_count(p INT, n INT) RETURNS BIGINT": "shiftleft(CAST(n - p + 1 AS BIGINT), p)",
    "bucket_error(p INT, n INT) RETURNS DOUBLE": "CASE WHEN p = n - 1 THEN 0D ELSE 100D / shiftleft(1L, p) END",
    "bucket_max(n INT) RETURNS BIGINT": "shiftrightunsigned(-1L, 64 - n)",
    "bucket_index(v BIGINT, p INT) RETURNS BIGINT": "CASE WHEN v < shiftleft(2L, p) THEN v ELSE shiftleft(CAST(floor(log2(v)) AS BIGINT) - p, p) + shiftrightunsigned(v, CAST(floor(log2(v)) AS INT) - p) END",
    "bucket_checked(v BIGINT, p INT, n INT) RETURNS BIGINT": "CASE WHEN v >= 0 AND v <= bucket_max(n) THEN bucket_index(v, p) WHEN v IS NOT NULL THEN CAST(raise_error('OutOfRange') AS BIGINT) END",
    "bucket_lower(i BIGINT, p INT) RETURNS BIGINT": _LOWER,
    "bucket_upper(i BIGINT, p INT, n INT) RETURNS BIGINT": "CASE WHEN i = bucket_count(p, n) - 1 THEN bucket_max(n) ELSE bucket_lower(i + 1, p) - 1 END",
}

# the rank is the product in double precision, at least 1 and at most the total; its bucket is the first whose running sum reaches it
QUANTILES = """
CREATE OR REPLACE TEMPORARY FUNCTION bucket_quantiles(idx ARRAY<BIGINT>, cum ARRAY<BIGINT>, qs ARRAY<DOUBLE>, p INT, n INT)
RETURNS TABLE (q DOUBLE, lo BIGINT, hi BIGINT, cnt BIGINT, total BIGINT)
RETURN SELECT q, bucket_lower(i, bucket_quantiles.p), bucket_upper(i, bucket_quantiles.p, bucket_quantiles.n), c - b, total
  FROM (SELECT q, total, element_at(bucket_quantiles.idx, at) AS i, element_at(bucket_quantiles.cum, at) AS c, CASE WHEN at > 1 THEN element_at(bucket_quantiles.cum, at - 1) ELSE 0L END AS b
    FROM (SELECT q, total, CAST(array_position(transform(bucket_quantiles.cum, s -> s >= target), true) AS INT) AS at
      FROM (SELECT q, element_at(bucket_quantiles.cum, -1) AS total, least(element_at(bucket_quantiles.cum, -1), greatest(1L, CAST(ceil(q * CAST(element_at(bucket_quantiles.cum, -1) AS DOUBLE)) AS BIGINT))) AS target
        FROM explode(bucket_quantiles.qs) AS t(q) WHERE size(bucket_quantiles.cum) > 0)))
"""


def register(spark: SparkSession) -> None:
    """Create the functions in the session; ones of the same names are replaced."""
    for head, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    spark.sql(QUANTILES)
