"""Rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column) -> Column:
    """Nearest whole number as BIGINT, halves towards plus infinity.

    SQL ``round`` works on the decimal text of a double and differs from this on values
    that are not exact in binary, so it is not used.
    """
    return F.floor(x + F.lit(0.5))


def share(part: Column, whole: Column, scale: float, divisor: float) -> Column:
    """``part / whole`` scaled, rounded half up and scaled back; NULL for an empty whole."""
    ratio = part.cast("double") / F.nullif(whole, F.lit(0)).cast("double")
    return half_up(ratio * F.lit(float(scale))) / F.lit(float(divisor))
