"""Exact rounding of ratios of whole numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def whole(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("long")


def half_up(num: Column, den: Column) -> Column:
    """num/den as a whole number, halves up; null where den is 0. For num >= 0."""
    return quotient(2 * num + den, F.nullif(2 * den, F.lit(0).cast("long")))


def quotient(a: Column, b: Column) -> Column:
    """Whole-number division, exact for longs."""
    return F.call_function("div", a, b)


def ratio(num: Column, den: Column, places: int = 4) -> Column:
    """num/den as a double with ``places`` decimals, halves up, computed in whole numbers."""
    scale = 10**places
    return half_up(scale * whole(num), whole(den)) / F.lit(float(scale))
