"""Numeric column expressions shared by the scoring operators."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

EPSILON = 1e-9


def as_timestamp(as_of) -> Column:
    """Accept a Column, a datetime or a timestamp text."""
    return as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp")


def age_in_days(moment: Column, as_of) -> Column:
    """Whole calendar days between ``moment`` and ``as_of``."""
    return F.datediff(as_timestamp(as_of), moment)


def decay(moment: Column, as_of) -> Column:
    """Close to 10 when new, 5.5 at ten days, falling to 1 with age."""
    return F.lit(10.0) - F.lit(9.0) / (F.lit(1.0) + F.exp(F.lit(10) - age_in_days(moment, as_of)))


def guarded_ratio(numerator: Column, a: Column, b: Column | None = None, eps: float = EPSILON) -> Column:
    """``numerator`` over the smaller of ``a`` and ``b``, never dividing by less than ``eps``."""
    base = a if b is None else F.least(a, b)
    return numerator / F.greatest(base, F.lit(eps))


def scale_0_100(count: Column, largest: Column) -> Column:
    """Share of the largest count in whole percent, cut off."""
    return F.floor(count * F.lit(100.0) / largest).cast("int")


def half_up(value: Column) -> Column:
    """Nearest whole number, halves going up."""
    return F.floor(value + F.lit(0.5))
