"""The bucketing configuration and its column expressions.

``Config(p, n)`` covers values below ``2 ** n``. Values below ``2 ** (p + 1)`` have buckets of width one; every octave above is cut in
``2 ** p`` equal buckets. All derived numbers are literals in the expressions, which are built-in functions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import IncompatibleParameters, MaxPowerTooHigh, MaxPowerTooLow, OutOfRange

#: Bucket counts from here on do not fit the index type; dense arrays end earlier, at what a JVM array holds.
INDEX_LIMIT, ARRAY_LIMIT = 1 << 32, 1 << 31


def _decimal(value: int) -> Column:
    return F.lit(str(value)).cast("decimal(20,0)")


@dataclass(frozen=True)
class Config:
    """``p``: grouping power, ``n``: power of the largest value."""

    p: int
    n: int

    def __post_init__(self) -> None:
        if self.n > 64:
            raise MaxPowerTooHigh(f"max value power {self.n} is above 64")
        if self.p < 0 or self.p >= self.n:
            raise MaxPowerTooLow(f"max value power {self.n} is not above grouping power {self.p}")
        if self.total_buckets >= INDEX_LIMIT:
            raise IncompatibleParameters(f"{self.total_buckets} buckets are too many")

    @property
    def linear(self) -> int:
        """Values below this have buckets of their own."""
        return 2 << self.p

    @property
    def max_value(self) -> int:
        return (1 << self.n) - 1

    @property
    def total_buckets(self) -> int:
        return (self.n - self.p + 1) << self.p

    @property
    def error(self) -> float:
        """Largest relative error of a bucket in percent; 0 if every bucket has width one."""
        return 0.0 if self.p == self.n - 1 else 100.0 / (1 << self.p)

    @property
    def wide(self) -> bool:
        """Whether values do not fit a signed long: they are decimals then."""
        return self.n > 63

    def index(self, value: int) -> int:
        if not 0 <= value <= self.max_value:
            raise OutOfRange(value)
        if value < self.linear:
            return value
        w = value.bit_length() - 1 - self.p
        return (w << self.p) + (value >> w)

    def lower(self, index: int) -> int:
        if not 0 <= index < self.total_buckets:
            raise OutOfRange(index)
        g, r = divmod(index, 1 << self.p)
        return r if g < 1 else ((1 << self.p) + r) << (g - 1)

    def upper(self, index: int) -> int:
        return self.max_value if index == self.total_buckets - 1 else self.lower(index + 1) - 1

    # columns ---------------------------------------------------------------------------------------------------------

    def accepts(self, value: Column) -> Column:
        return (value >= 0) & (value <= (_decimal(self.max_value) if self.wide else F.lit(self.max_value)))

    def index_of(self, value: Column) -> Column:
        """Bucket index of an accepted value: a long, or with ``n`` = 64 a decimal."""
        if not self.wide:
            v = value.cast("long")
            w = F.floor(F.log2(v)).cast("int") - self.p
            return F.when(v < self.linear, v).otherwise(w.cast("long") * (1 << self.p) + F.call_function("shiftrightunsigned", v, w))
        # the 64 bits of the value, as a signed long; a logarithm that is rounded up to the next octave gives the same index
        v = F.when(value >= _decimal(1 << 63), (value.cast("decimal(20,0)") - _decimal(1 << 64)).cast("long")).otherwise(value.cast("long"))
        w = F.when(v < 0, F.lit(63)).otherwise(F.floor(F.log2(v)).cast("int")) - self.p
        return F.when((v >= 0) & (v < self.linear), v).otherwise(w.cast("long") * (1 << self.p) + F.call_function("shiftrightunsigned", v, w))

    def _unsigned(self, bits: Column) -> Column:
        if not self.wide:
            return bits
        d = bits.cast("decimal(20,0)")
        return F.when(bits < 0, d + _decimal(1 << 64)).otherwise(d).cast("decimal(20,0)")

    def _lower_bits(self, index: Column) -> Column:
        g = F.shiftright(index, self.p).cast("int")
        r = index.bitwiseAND(F.lit((1 << self.p) - 1))
        return F.when(g < 1, index).otherwise(F.call_function("shiftleft", r.bitwiseOR(F.lit(1 << self.p)), g - 1))

    def lower_of(self, index: Column) -> Column:
        return self._unsigned(self._lower_bits(index.cast("long")))

    def upper_of(self, index: Column) -> Column:
        j = index.cast("long")
        top = F.lit(self.max_value) if not self.wide else _decimal(self.max_value)
        return F.when(j == self.total_buckets - 1, top).otherwise(self._unsigned(self._lower_bits(j + 1)) - 1).cast("decimal(20,0)" if self.wide else "long")

    def range_of(self, index: Column) -> Column:
        return F.struct(self.lower_of(index).alias("lo"), self.upper_of(index).alias("hi"))

    def bucket_of(self, index: Column, count: Column) -> Column:
        return F.struct(count.alias("count"), self.lower_of(index).alias("lo"), self.upper_of(index).alias("hi"))

    def downsampled(self, p: int) -> Config:
        if p >= self.p:
            raise IncompatibleParameters(f"grouping power {p} is not below {self.p}")
        return Config(p, self.n)


def same_config(a: Config, b: Config) -> None:
    if a != b:
        raise IncompatibleParameters(f"{a} and {b}")
