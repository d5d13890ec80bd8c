"""Counter widths: what a counter holds at most, and how sums that pass it are told or wrapped."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import Column
from pyspark.sql import functions as F


class CounterWidth(Enum):
    U32 = 32
    U64 = 64

    @property
    def maximum(self) -> int:
        return (1 << self.value) - 1

    @property
    def column_type(self) -> str:
        """Counters of 64 bits are decimals, as a signed long holds half their range only."""
        return "bigint" if self is CounterWidth.U32 else "decimal(20,0)"

    def fits(self, value: Column) -> Column:
        return value.cast("decimal(38,0)").between(F.lit(0).cast("decimal(38,0)"), F.lit(str(self.maximum)).cast("decimal(38,0)"))

    def wrapped(self, value: Column) -> Column:
        """Value modulo 2 ** bits."""
        return F.pmod(value.cast("decimal(38,0)"), F.lit(str(1 << self.value)).cast("decimal(38,0)")).cast(self.column_type)


U32, U64 = CounterWidth.U32, CounterWidth.U64
