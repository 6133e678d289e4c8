"""Date column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The date layouts that the source files use, in order of preference.
FILE_DATE_FORMATS = ("dd-MMM-yyyy", "dd-MMM-yy", "MM/dd/yyyy", "yyyy-MM-dd", "dd/MM/yyyy")
SEEN_FORMATS = ("yyyyMMdd'T'HHmmss'Z'", "yyyyMMddHHmmss", "yyyy-MM-dd'T'HH:mm:ss'Z'")
MONTHS = (
    "january", "february", "march", "april", "may", "june",
    "july", "august", "september", "october", "november", "december",
)


def first_date(text: Column, formats: Sequence[str] = FILE_DATE_FORMATS) -> Column:
    """First layout that reads. Two-digit years are 1969 to 2068."""
    days = []
    for layout in formats:
        day = F.to_date(F.try_to_timestamp(text, F.lit(layout)))
        if "yyyy" not in layout:
            day = F.when(F.year(day) >= 2069, F.add_months(day, -1200)).otherwise(day)
        days.append(day)
    return F.coalesce(*days)


def first_timestamp(text: Column, formats: Sequence[str] = SEEN_FORMATS) -> Column:
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats])


def month_number(name: Column) -> Column:
    """1-12 from an English month name or its first three letters, any case."""
    short = F.substring(F.lower(name), 1, 3)
    place = F.instr(F.lit("".join(m[:3] for m in MONTHS)), short)
    return F.when((F.length(short) == 3) & (place % 3 == 1), ((place + 2) / 3).cast("int"))


def safe_date(year: Column, month: Column, day: Column) -> Column:
    """Null instead of an error for the 31st of February."""
    parts = [c.cast("string") for c in (year, month, day)]
    whole = F.concat(parts[0], F.lit("-"), parts[1], F.lit("-"), parts[2])
    return whole.try_cast("date")


def expiry_date(text: Column) -> Column:
    """Contract expiry such as `05DEC2026`, `05-Dec-2026`, `05 Dec 2026`, `2026-12-05`."""
    pattern = r"^(\d{1,2})([- ]?)([A-Za-z]{3})\2(\d{4})$"
    trimmed = F.trim(text)
    day = F.regexp_extract(trimmed, pattern, 1).try_cast("int")
    month = month_number(F.regexp_extract(trimmed, pattern, 3))
    year = F.regexp_extract(trimmed, pattern, 4).try_cast("int")
    return F.coalesce(
        safe_date(year, month, day),
        F.when(trimmed.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), trimmed.try_cast("date")),
    )


def local_time(ts: Column, tz: str) -> Column:
    return F.from_utc_timestamp(ts, tz)


def local_day(ts: Column, tz: str) -> Column:
    return F.to_date(local_time(ts, tz))


def local_day_number(tick: Column, tz: str) -> Column:
    """Local day of an epoch second, as days since 1970."""
    return F.unix_date(local_day(F.timestamp_seconds(tick), tz))


def minute_of_day(ts: Column, tz: str) -> Column:
    local = local_time(ts, tz)
    return F.hour(local) * 60 + F.minute(local)


def in_daily_window(minute: Column, start: int, end: int) -> Column:
    """Half-open window of minutes; an end before the start wraps past midnight."""
    if start <= end:
        return (minute >= start) & (minute < end)
    return (minute >= start) | (minute < end)


def on_days(day: Column, days: Sequence[int]) -> Column:
    """Monday is 0."""
    return F.weekday(day).isin(*days)


def tick_of(ts: Column, minutes: int) -> Column:
    """Start of the polling tick that a time falls in, as epoch seconds."""
    width = minutes * 60
    return F.floor(F.unix_seconds(ts) / width) * width


def hours_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(3.6e9)


def shift_hours(ts: Column, hours: Column) -> Column:
    return F.timestamp_micros(
        F.unix_micros(ts) + F.round(hours * F.lit(3.6e9)).cast("bigint")
    )


def duration_hours(text: Column) -> Column:
    """`4h`, `90m`, `2`, `1.5h` as hours; null where unreadable."""
    # Fixed value: the grammar of durations.
    pattern = r"^(\d+(?:\.\d+)?)(h|hr|hrs|hour|hours|m|min|mins|minute|minutes)?$"
    bare = F.regexp_replace(F.lower(F.trim(text)), " ", "")
    amount = F.regexp_extract(bare, pattern, 1).try_cast("double")
    minutes = F.regexp_extract(bare, pattern, 2).startswith("m")
    return F.when(minutes, amount / 60.0).otherwise(amount)


def age_text(hours: Column) -> Column:
    return (
        F.when(hours < 1, F.format_string("%dm", F.floor(hours * 60)))
        .when(hours < 48, F.format_string("%.0fh", hours))
        .otherwise(F.format_string("%.0fd", hours / 24))
    )
