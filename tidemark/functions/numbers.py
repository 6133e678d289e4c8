"""Numeric column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def clean_number(text: Column) -> Column:
    """Number at the start of a scraped text, or null.

    Group commas, currency and percent signs and hard spaces go; a trailing unit is
    dropped. The text is checked before the cast, because a cast alone would accept
    `NaN` and `12d`.
    """
    bare = F.trim(F.regexp_replace(text, "[,₹$% ]", ""))
    first = F.regexp_extract(bare, r"^(\S*)", 1)
    return F.when(first.rlike(_NUMBER), first.try_cast("double"))


def in_band(value: Column, band: tuple[float, float]) -> Column:
    return value.between(F.lit(band[0]), F.lit(band[1]))


def change_pct(current: Column, previous: Column) -> Column:
    """Percent change, null where there is no usable base."""
    return (F.try_divide(current, previous) - 1.0) * 100.0


def signed(value: Column, digits: int) -> Column:
    """`+1.20` style text."""
    return F.format_string(f"%+.{digits}f", value)


def grouped(value: Column, digits: int) -> Column:
    """`1,234.50` style text."""
    return F.format_number(value, digits)


def round_levels(value: Column, step: float, count: int = 3) -> Column:
    """Positive round numbers around a value, as an ascending array."""
    base = F.bround(value / F.lit(float(step)), 0) * F.lit(float(step))
    offsets = F.array(*[F.lit(float(k) * step) for k in range(-count, count + 1)])
    return F.filter(F.transform(offsets, lambda o: base + o), lambda v: v > 0)
