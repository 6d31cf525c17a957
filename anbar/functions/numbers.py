"""Rounding and clipping with half-even results."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_even(c: Column, places: int = 0) -> Column:
    """Round half to even in binary (``F.round`` is half-up on decimal text)."""
    if places == 0:
        return F.rint(c)
    scale = float(10**places)
    return F.rint(c * F.lit(scale)) / F.lit(scale)


def floor_at_zero(c: Column) -> Column:
    return F.greatest(c, F.lit(0.0))


def is_integral(c: Column) -> Column:
    return c % F.lit(1) == F.lit(0)


def int_div(a: Column, b: Column | int) -> Column:
    """Integer division, BIGINT."""
    return F.call_function("div", a, F.lit(b) if isinstance(b, int) else b)
