"""Numeric conventions that the operators share: rounding, parsing, ratios."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INFINITY = float("inf")


def half_up(x: Column, digits: int = 0) -> Column:
    """Rounds halves towards plus infinity: -2.5 becomes -2."""
    scale = float(10**digits)
    return F.floor(x * scale + 0.5) / scale


def finite(x: Column) -> Column:
    """False for null, NaN and the infinities."""
    return F.coalesce(~F.isnan(x) & (F.abs(x) < INFINITY), F.lit(False))


def between(x: Column, low: Column | float, high: Column | float) -> Column:
    """Inclusive on both ends; false, never null, for null and NaN."""
    return F.coalesce((x >= low) & (x <= high) & ~F.isnan(x), F.lit(False))


def percent_change(old: Column, new: Column) -> Column:
    """Null without a base; the caller decides on infinity."""
    return F.when(old != 0, (new - old) / old * 100)


def percent_or_infinite(old: Column, new: Column) -> Column:
    """Against a base that may be zero: infinite for growth from nothing, else 0."""
    return F.when(old > 0, (new - old) / old * 100).when(new > 0, F.lit(INFINITY)).otherwise(F.lit(0.0))


def integer_prefix(s: Column) -> Column:
    """The leading integer of a string ("12x" gives 12), null without one."""
    return F.regexp_extract(s, r"^\s*([-+]?\d+)", 1).try_cast("bigint")


def number_prefix(s: Column) -> Column:
    """The leading decimal number of a string, null without one."""
    return F.regexp_extract(s, r"^\s*([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)", 1).try_cast("double")
