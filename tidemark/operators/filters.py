"""Row filters: plausibility bands, relevance, schedules, windows of the day."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.dates import in_daily_window, local_day, minute_of_day, on_days
from tidemark.functions.numbers import in_band
from tidemark.functions.text import any_term


def plausible(df: DataFrame, value: str, band: tuple[float, float]) -> DataFrame:
    return df.filter(in_band(F.col(value), band))


def plausible_by_series(df: DataFrame, bands: DataFrame) -> DataFrame:
    """Keep values inside the band of their series; series without a band pass.

    `bands` (series, lo, hi) is configuration built by `rules.small_table`.
    """
    joined = df.join(bands, "series", "left")
    ok = F.col("lo").isNull() | F.col("value").between(F.col("lo"), F.col("hi"))
    return joined.filter(ok).drop("lo", "hi")


def relevant_any(df: DataFrame, text: Column, terms: Sequence[str]) -> DataFrame:
    return df.filter(any_term(text, terms))


def relevant_both(df: DataFrame, text: Column, first: Sequence[str], second: Sequence[str]) -> DataFrame:
    return df.filter(any_term(text, first) & any_term(text, second))


def scheme_filter(
    df: DataFrame, name: str, include: Sequence[str], exclude: Sequence[str], require: Sequence[str]
) -> DataFrame:
    text = F.col(name)
    return df.filter(any_term(text, include) & ~any_term(text, exclude) & any_term(text, require))


def exact_symbol(df: DataFrame, column: str, symbol: str) -> DataFrame:
    return df.filter(F.upper(column) == symbol.upper())


def allowed(df: DataFrame, column: str, names: Sequence[str]) -> DataFrame:
    return df.filter(F.col(column).isin(*names))


def active_hours(df: DataFrame, ts: str, tz: str, start: int, end: int) -> DataFrame:
    return df.filter(in_daily_window(minute_of_day(F.col(ts), tz), start, end))


def on_schedule(df: DataFrame, ts: str, tz: str, days: Sequence[int]) -> DataFrame:
    return df.filter(on_days(local_day(F.col(ts), tz), days))
