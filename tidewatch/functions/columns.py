"""Small column helpers shared by the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(num: Column, den: Column) -> Column:
    """num / den, null where den is zero or null (ANSI mode would raise)."""
    return num / F.when(den != 0, den)


def rate_or_zero(num: Column, den: Column) -> Column:
    """num / den with 0 for an empty denominator, as the metrics use it."""
    return F.coalesce(num.cast("double") / F.when(den != 0, den), F.lit(0.0))


def holds(cond: Column) -> Column:
    """A condition that is false, not null, when an input is missing."""
    return F.coalesce(cond, F.lit(False))


def within(value: Column, center: Column, tol: float) -> Column:
    return F.abs(value - center) <= F.abs(center) * F.lit(float(tol))


def half_even(x: Column) -> Column:
    return F.rint(x)


def all_of(conds: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conds)


def fixed3(x: Column) -> Column:
    """Three decimals, rounded from the exact binary value (format_string rounds the short decimal
    text instead and differs on ties)."""
    return F.call_function("format_number", x.cast("double"), F.lit("0.000"))


def joined(parts: list[Column], sep: str) -> Column:
    """Join the non-null parts in order."""
    return F.array_join(F.array_compact(F.array(*parts)), sep)
