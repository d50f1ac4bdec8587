"""Number formatting that agrees with Python's ``format`` to the last digit."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def one_decimal(value: Column) -> Column:
    """``f"{value:.1f}"`` for doubles in 0..100.

    ``format_string`` rounds the shortest decimal text half up, Python rounds the
    exact binary value half to even, and they differ on ties such as 87.25.  Scaling
    by a power of two is exact, so the rounding is done on integers.
    """

    def tenths(bits: int) -> Column:
        scaled = (value * F.lit(float(2**bits))).cast("bigint") * 10
        whole = F.shiftright(scaled, bits)
        rest = scaled - F.shiftleft(whole, bits)
        half = F.lit(2 ** (bits - 1)).cast("bigint")
        up = (rest > half) | ((rest == half) & (whole % 2 == 1))
        return whole + up.cast("bigint")

    # 53 bits hold every double from 1 to 100 whole, 57 those from 0.05 to 1
    rounded = F.when(value < 1, tenths(57)).otherwise(tenths(53))
    return F.concat(
        F.floor(rounded / 10).cast("string"), F.lit("."), (rounded % 10).cast("string")
    )


def kilobytes(size_bytes: Column) -> Column:
    """``f"{size_bytes / 1024:.1f}"``, for any size, ties to even."""
    tenths = size_bytes.cast("bigint") * 10
    whole, rest = F.shiftright(tenths, 10), tenths.bitwiseAND(F.lit(1023).cast("bigint"))
    up = (rest > 512) | ((rest == 512) & (whole % 2 == 1))
    rounded = whole + up.cast("bigint")
    return F.concat(F.floor(rounded / 10).cast("string"), F.lit("."), (rounded % 10).cast("string"))


def grouped(value: Column) -> Column:
    """``f"{value:,}"`` for whole numbers."""
    return F.format_number(value.cast("bigint"), 0)
