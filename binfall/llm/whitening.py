"""Whitening of embeddings by upper-triangle column aggregates.

Every entry is put on a grid, x = floor(1024 * c) + 100000, so counts, sums and deviations are exact integers. The covariance of the fit list, which is all vectors
that take part, is one aggregation: a generated SQL expression for every pair of dimensions i <= j sums (x_i - mean_i) * (x_j - mean_j). Spark adds these
up task by task; what comes back is one row of d * (d + 1) / 2 numbers, whatever the number of vectors. The driver puts the matrix together, and
LAPACK decomposes it. The vectors are then projected by generated expressions, and the covariance of what comes out is reckoned the same way.

Edge cases: vectors that are null, empty or hold null or non-finite entries are dropped, as are those with an entry of 2**43 or more in size, whose place on
the grid double precision no longer tells apart, and those of another length than the most frequent one (of equally frequent, the longest): a covariance
has one number of dimensions. Components without variance (an eigenvalue below ``FLAT`` of the largest) cannot be scaled to variance one and are left
out; if all vectors are equal, nothing is left. Repeated rows count each. A deviation beyond a long is null (``deviation_exact`` has it, up to 38 digits).
A null id is an id. Tables without such vectors give no rows; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Share of the largest eigenvalue below which a component is taken to have no variance.
FLAT = 1e-12
#: Sums that one aggregation of the covariance holds at most: wider matrices take several passes, as a row of sums has to fit generated code.
SUMS = 4096


def grid(vectors: DataFrame, *, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(vec_id, x array<long>) of the vectors that take part, of any length."""
    rows = vectors.select(F.col(id_column).alias("vec_id"), F.col(column).cast("array<double>").alias("c"))
    bad = F.exists("c", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) >= float(1 << 43)))
    whole = rows.where(F.col("c").isNotNull() & (F.size("c") > 0) & ~bad)
    return whole.select("vec_id", F.transform("c", lambda e: F.floor(e * 1024.0).cast("long") + 100_000).alias("x"))


def _length(x: DataFrame) -> int | None:
    first = x.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return first.d if first else None


def _columns(rows: DataFrame, names: list[str]) -> tuple[int, list, np.ndarray]:
    """Number of rows, sums of the columns, and their covariance (divisor n), centred before multiplying: sums first, then a sum of products for
    every pair of the upper triangle."""
    n, *sums = rows.agg(F.count("*"), *(F.sum(c) for c in names)).first()
    mean = {c: s / n for c, s in zip(names, sums, strict=True)} if n else {}
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    v = np.zeros((len(names), len(names)))
    for lo in range(0, len(pairs) if n else 0, SUMS):
        some = pairs[lo : lo + SUMS]
        used = sorted({k for pair in some for k in pair})
        centred = rows.selectExpr(*(f"`{names[k]}` - {mean[names[k]]!r}D AS c{k}" for k in used))
        found = centred.selectExpr(*(f"sum(c{i} * c{j}) AS s{i}_{j}" for i, j in some)).first()
        for (i, j), s in zip(some, found, strict=True):
            v[i, j] = v[j, i] = s / n
    return n, sums, v


@dataclass
class Whitening:
    """What the fit list gives: its size, sums and covariance, and the components by falling eigenvalue, a row of ``vectors`` each."""

    n: int
    sums: list[int]
    covariance: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @property
    def explained(self) -> np.ndarray:
        return self.values / np.trace(self.covariance)

    def projected(self, x: Column, k: int) -> Column:
        """The vector's place on component k (from 0), in standard deviations."""
        terms = [f"(x[{i}] - {s / self.n!r}D) * {w!r}D" for i, (s, w) in enumerate(zip(self.sums, (self.vectors[k] / np.sqrt(self.values[k])).tolist(), strict=True))]
        return F.expr(" + ".join(terms))

    def deviation(self) -> Column:
        """Sum over dimensions of (n * x - S) ** 2, exact; null if one of the squares, or the sum, has more than 38 digits."""
        sums = F.array(*(F.lit(str(s)).cast("decimal(38,0)") for s in self.sums))
        far = F.zip_with("x", sums, lambda x, s: ((x.cast("decimal(19,0)") * F.lit(self.n).cast("decimal(19,0)")).cast("decimal(38,0)") - s).try_cast("decimal(19,0)"))
        square = lambda a, e: F.try_add(a, (e * e).cast("decimal(38,0)")).cast("decimal(38,0)")
        return F.aggregate(far, F.lit(0).cast("decimal(38,0)"), square)


def fit(x: DataFrame, d: int) -> Whitening:
    """The whitening of (x array<long>) rows of length d. Of the two signs of a component, the one that makes its largest entry positive."""
    names = [f"x{i}" for i in range(d)]
    n, sums, v = _columns(x.select(*(F.get("x", F.lit(i)).alias(c) for i, c in enumerate(names))), names)
    values, vectors = np.linalg.eigh(v)
    order = np.argsort(-values, kind="stable")
    values, vectors = values[order], vectors.T[order]
    large = np.abs(vectors).argmax(axis=1)
    vectors = vectors * np.sign(vectors[np.arange(d), large])[:, None]
    live = (values > FLAT * max(values[0], 0)) & (values > 0)
    return Whitening(n, [int(s) for s in sums], v, values[live], vectors[live])


def whiten(vectors: DataFrame, *, components: int = 8, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error, deviation_exact): a row for each vector that takes part and each of the first
    components. ``identity_error`` is how far the covariance of all whitened values is from the identity at most."""
    x = grid(vectors, id_column=id_column, column=column).checkpoint()
    d = _length(x)
    empty = "vec_id {}, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_exact decimal(38,0)"
    none = vectors.sparkSession.createDataFrame([], empty.format(dict(vectors.dtypes)[id_column]))
    if d is None:
        return none
    x = x.where(F.size("x") == d)
    model = fit(x, d)
    k = min(components, len(model.values))
    if not k:
        return none
    names = [f"w{i}" for i in range(k)]
    placed = x.select("vec_id", model.deviation().alias("exact"), *(model.projected(F.col("x"), i).alias(c) for i, c in enumerate(names))).checkpoint()
    _, _, v = _columns(placed.select(*names), names)
    error = float(np.abs(v - np.eye(k)).max())
    share = F.array(*map(F.lit, model.explained[:k].tolist()))
    out = placed.select("vec_id", "exact", F.posexplode(F.array(*names)).alias("i", "whitened"))
    return out.select(
        "vec_id",
        (F.col("i") + 1).alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        F.expr("try_cast(exact AS long)").alias("deviation"),
        "whitened",
        F.get(share, F.col("i")).alias("explained"),
        F.lit(error).alias("identity_error"),
        F.col("exact").alias("deviation_exact"),
    )
