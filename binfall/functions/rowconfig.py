"""Bucketing whose parameters are columns: every row has its own grouping power and power of the largest value.

``RowConfig`` has the column methods of ``Config`` and takes its place wherever the rows have the two columns and these are among the keys:
``quantiles(cells, ["k", "p", "n"], [0.5], RowConfig())``. All of it is built-in expressions; shifts go by columns.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .bucketing import INDEX_LIMIT, Config, _decimal

_shl = lambda x, by: F.call_function("shiftleft", x, by)
_shr = lambda x, by: F.call_function("shiftrightunsigned", x, by)


def same_parameters(p: Column, n: Column, other_p: Column, other_n: Column) -> Column:
    """Whether two rows have equal parameters; rows without any are alike too."""
    return p.eqNullSafe(other_p) & n.eqNullSafe(other_n)


@dataclass(frozen=True)
class RowConfig:
    """``p`` and ``n`` name the columns. ``wide``: values may be as large as 64 bits allow, and are decimals; else n is at most 63 and they are longs."""

    p: str = "p"
    n: str = "n"
    wide: bool = False

    @property
    def _p(self) -> Column:
        return F.col(self.p).cast("int")

    @property
    def _n(self) -> Column:
        return F.col(self.n).cast("int")

    def error_name(self) -> Column:
        """Name of the error that building this configuration gives, or null."""
        many = F.when(self._p >= 31, True).otherwise(self.total_buckets_of() >= INDEX_LIMIT)
        none = self._p.isNull() | self._n.isNull()
        return F.when(none, "IncompatibleParameters").when(self._n > (64 if self.wide else 63), "MaxPowerTooHigh").when((self._p < 0) | (self._p >= self._n), "MaxPowerTooLow").when(many, "IncompatibleParameters")

    def total_buckets_of(self) -> Column:
        return _shl((self._n - self._p + 1).cast("long"), self._p)

    def error_of(self) -> Column:
        """Largest relative error of a bucket in percent."""
        return F.when(self._p == self._n - 1, 0.0).otherwise(100.0 / _shl(F.lit(1).cast("long"), self._p))

    def _max_bits(self) -> Column:
        return _shr(F.lit(-1).cast("long"), 64 - self._n)

    def max_of(self) -> Column:
        return self._unsigned(self._max_bits())

    def accepts(self, value: Column) -> Column:
        return (value >= 0) & (value <= self.max_of())

    def _unsigned(self, bits: Column) -> Column:
        if not self.wide:
            return bits
        d = bits.cast("decimal(20,0)")
        return F.when(bits < 0, d + _decimal(1 << 64)).otherwise(d).cast("decimal(20,0)")

    def index_of(self, value: Column) -> Column:
        """Bucket index of an accepted value."""
        if self.wide:
            v = F.when(value >= _decimal(1 << 63), (value.cast("decimal(20,0)") - _decimal(1 << 64)).cast("long")).otherwise(value.cast("long"))
            top = F.when(v < 0, F.lit(63)).otherwise(F.floor(F.log2(v)).cast("int"))
        else:
            v = value.cast("long")
            top = F.floor(F.log2(v)).cast("int")
        w = top - self._p
        return F.when((v >= 0) & (v < _shl(F.lit(2).cast("long"), self._p)), v).otherwise(_shl(w.cast("long"), self._p) + _shr(v, w))

    def _lower_bits(self, index: Column) -> Column:
        g = _shr(index, self._p).cast("int")
        step = _shl(F.lit(1).cast("long"), self._p)
        return F.when(g < 1, index).otherwise(_shl(index.bitwiseAND(step - 1).bitwiseOR(step), g - 1))

    def lower_of(self, index: Column) -> Column:
        return self._unsigned(self._lower_bits(index.cast("long")))

    def upper_of(self, index: Column) -> Column:
        j = index.cast("long")
        inner = self._unsigned(self._lower_bits(j + 1)) - 1
        return F.when(j == self.total_buckets_of() - 1, self.max_of()).otherwise(inner).cast("decimal(20,0)" if self.wide else "long")

    def range_of(self, index: Column) -> Column:
        return F.struct(self.lower_of(index).alias("lo"), self.upper_of(index).alias("hi"))

    def bucket_of(self, index: Column, count: Column) -> Column:
        return F.struct(count.alias("count"), self.lower_of(index).alias("lo"), self.upper_of(index).alias("hi"))

    def equals(self, other: Config) -> Column:
        return same_parameters(self._p, self._n, F.lit(other.p), F.lit(other.n))
