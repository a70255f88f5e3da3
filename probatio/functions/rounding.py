"""Decimal rounding of doubles by their exact binary value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SCALE = 2 ** 56


def round_tenth(value: Column) -> Column:
    """One decimal, half to even, for values from 0 to 100.

    ``round`` and ``bround`` look at the shortest decimal text of a double: 10.45 is
    stored slightly below 10.45 and must become 10.4, but both see a tie.  Scaling
    by a power of two is exact, so the comparison with the tie is done on integers.
    """
    scaled = (value * F.lit(float(_SCALE))).cast("bigint").cast("decimal(20,0)")
    tenths = (scaled * F.lit(10).cast("decimal(2,0)")).cast("decimal(24,0)")
    unit = F.lit(_SCALE).cast("decimal(18,0)")
    rest = (tenths % unit).cast("decimal(18,0)")
    whole = ((tenths - rest) / unit).cast("bigint")
    half = F.lit(_SCALE // 2).cast("decimal(18,0)")
    up = (rest > half) | ((rest == half) & (whole % 2 == 1))
    return (whole + F.when(up, 1).otherwise(0)) / F.lit(10.0)
