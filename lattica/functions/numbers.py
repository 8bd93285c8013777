"""Scalar rules of float data: NaN is a value, not null, and division never fails."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INFINITY = float("inf")
NAN = float("nan")


def finite(c: Column) -> Column:
    """Neither null, NaN nor infinite."""
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(INFINITY))


def only_finite(c: Column) -> Column:
    """The value, null where it is not finite, so that aggregates skip it."""
    return F.when(finite(c), c)


def divided(a: Column, b: Column) -> Column:
    """IEEE division: x/0 is infinite with the sign of x, 0/0 is NaN."""
    a, b = a.cast("double"), b.cast("double")
    by_zero = F.when(F.isnan(a) | (a == 0), F.lit(NAN)).when(a > 0, F.lit(INFINITY)).otherwise(F.lit(-INFINITY))
    return F.when(b == 0, by_zero).otherwise(a / F.when(b == 0, F.lit(1.0)).otherwise(b))


def least_nan(a: Column, b: Column) -> Column:
    """The smaller one; NaN if either is."""
    return F.when(F.isnan(a) | F.isnan(b), F.lit(NAN)).otherwise(F.least(a, b))


def greatest_nan(a: Column, b: Column) -> Column:
    return F.when(F.isnan(a) | F.isnan(b), F.lit(NAN)).otherwise(F.greatest(a, b))


def clamped(c: Column, lo: float, hi: float) -> Column:
    """Into [lo, hi]; NaN passes through."""
    c = c.cast("double")
    return F.when(F.isnan(c), c).otherwise(F.least(F.greatest(c, F.lit(float(lo))), F.lit(float(hi))))


def or_nan(c: Column) -> Column:
    return F.coalesce(c, F.lit(NAN))


def norm3(x: Column, y: Column, z: Column) -> Column:
    return F.sqrt(x * x + y * y + z * z)
