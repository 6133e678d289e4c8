"""Figures derived from several series at one instant, as rows of source `derived`."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import money
from tidemark.functions.dates import local_day
from tidemark.rules import (
    CROSS_CHECK_PCT,
    FUTURES_BAND,
    PREMIUM_LIMIT_PCT,
    SEASON_LEAD_DAYS,
    TaxStack,
)


def derive_columns(aligned: DataFrame, tax: TaxStack) -> DataFrame:
    """Add every derived figure to rows of aligned legs.

    Legs: spot, future, silver, fx, quote, and the session changes spot_change and
    fx_change. A missing or zero spot falls back to the future.
    """
    gold = F.coalesce(F.when(F.col("spot") != 0, F.col("spot")), F.when(F.col("future") != 0, F.col("future")))
    usable = lambda name: F.when(F.col(name) != 0, F.col(name))
    out = aligned.withColumn("gold", gold)
    both = (F.col("gold").isNotNull()) & usable("fx").isNotNull()
    ex_tax = F.when(both, money.ex_tax_cost(F.col("gold"), F.col("fx"), tax))
    inr = money.compounded_pct(F.col("spot_change"), F.col("fx_change"))
    premium = money.premium_pct(usable("quote"), ex_tax)
    cross = money.divergence_pct(F.col("spot"), F.col("future"))
    return out.withColumns(
        {
            "ratio": F.round(F.try_divide(F.col("gold"), F.col("silver")), 3),
            "landed": F.when(both, F.round(money.landed_cost(F.col("gold"), F.col("fx"), tax), 2)),
            "ex_tax": F.round(ex_tax, 2),
            "premium": F.round(premium, 3),
            "premium_wide": F.abs(premium) > PREMIUM_LIMIT_PCT,
            "cross": F.round(cross, 4),
            "cross_wide": cross > CROSS_CHECK_PCT,
            "cross_note": cross_note(F.col("spot"), F.col("future")),
            "inr_change": F.round(inr, 3),
            "diverging": F.when(inr.isNotNull(), money.directions_differ(F.col("spot_change"), inr)),
        }
    )


def cross_note(spot: Column, future: Column) -> Column:
    """What the cross check of two legs has to say: too far apart, or only one of them there."""
    gap = money.divergence_pct(spot, future)
    there = lambda leg: F.coalesce(leg != 0, F.lit(False))
    apart = F.format_string(
        f"DIVERGENCE: spot %.2f and future %.2f differ by %.2f%%, allowed are {CROSS_CHECK_PCT}%%: the price is uncertain",
        spot, future, gap,
    )
    return (
        F.when(there(spot) & there(future) & (gap > CROSS_CHECK_PCT), apart)
        .when(there(spot) & ~there(future), F.lit("only the spot resolved: no cross-check"))
        .when(there(future) & ~there(spot), F.lit("only the future resolved: no cross-check"))
    )


# Names and units of the derived series.
DERIVED_SERIES = (
    ("ratio", "gold_silver_ratio", "ratio"),
    ("landed", "gold_inr_per_10g", "INR/10g"),
    ("ex_tax", "gold_inr_per_10g_ex_gst", "INR/10g"),
    ("premium", "india_physical_premium_pct", "%"),
    ("diverging", "usd_inr_direction_divergence", "boolean"),
)


def derived_readings(aligned: DataFrame, tax: TaxStack) -> DataFrame:
    """The derived figures as readings, null ones left out, with notes where one is due."""
    wide = derive_columns(aligned, tax)
    note = {
        "premium": F.when(F.col("premium_wide"), F.lit("gap too wide: check the tax stack")),
        "diverging": F.when(F.col("diverging"), F.lit("directions differ")),
    }
    rows = [
        F.struct(
            F.lit(series).alias("series"),
            F.col(column).cast("double").alias("value"),
            F.lit(unit).alias("unit"),
            note.get(column, F.lit(None).cast("string")).alias("note"),
        )
        for column, series, unit in DERIVED_SERIES
    ]
    return (
        wide.select("ts", F.inline(F.array(*rows)))
        .filter("value IS NOT NULL")
        .select("ts", "series", "value", "unit", F.lit("derived").alias("source"), "note")
    )


def implied_odds(legs: DataFrame) -> DataFrame:
    """Implied rate, distance in basis points and clamped share of one move.

    Columns in: price, effective. Prices outside the plausible band are dropped.
    """
    rate = money.implied_rate(F.col("price"))
    return legs.filter(F.col("price").between(*map(F.lit, FUTURES_BAND))).withColumns(
        {
            "implied_rate": F.round(rate, 4),
            # Adding zero turns a negative zero into a plain one.
            "expected_cut_bp": F.round((F.col("effective") - rate) * 100.0, 1) + 0.0,
            "cut_probability": F.round(money.cut_probability(F.col("effective"), rate), 1) + 0.0,
        }
    )


def season_flags(days: DataFrame, seasons: DataFrame, lead_days: int = SEASON_LEAD_DAYS) -> DataFrame:
    """Seasons that are near or active on each day.

    Each season is spread over the days on which it is flagged, so the join is an
    equality on the day, not a range. `seasons` is configuration.
    """
    flagged = seasons.select(
        "name",
        "start",
        "end",
        "point",
        F.explode(F.sequence(F.date_sub("start", lead_days), F.when(F.col("point"), F.col("start")).otherwise(F.col("end")))).alias("day"),
    )
    ahead = F.date_diff("start", "day")
    state = F.when(~F.col("point") & (ahead <= 0), F.lit("active")).otherwise(F.lit("ahead"))
    return days.join(flagged, "day").select(
        "day", "name", state.alias("state"), F.when(state == "ahead", ahead).alias("days_ahead")
    )


def season_notes(days: DataFrame, seasons: DataFrame, lead_days: int = SEASON_LEAD_DAYS) -> DataFrame:
    """(day, note): one line for each day on which a season is near or active, nearest start first."""
    named = seasons.select("name", "start", "end")
    flags = season_flags(days.select("day").distinct(), seasons.drop_duplicates(["name"]), lead_days).join(named, "name")
    date_of = lambda c: F.col(c).cast("string")
    text = F.when(F.col("state") == "active", F.concat("name", F.lit(" is active (to "), date_of("end"), F.lit(")"))).otherwise(
        F.concat("name", F.lit(" in "), F.col("days_ahead").cast("string"), F.lit("d ("), date_of("start"), F.lit(")"))
    )
    lines = F.sort_array(F.collect_set(F.struct("start", text.alias("text"))))
    return flags.groupBy("day").agg(F.concat(F.lit("seasonal demand: "), F.array_join(lines["text"], "; ")).alias("note"))


def derived_notes(wide: DataFrame, seasons: DataFrame, tz: str) -> DataFrame:
    """Notes (ts, source, note) of rows of derived figures: the cross check, a wide premium,
    directions that differ, and the seasons of the local day."""
    notes = {
        "cross": F.col("cross_note"),
        "premium": F.when(F.col("premium_wide"), F.lit("gap too wide: check the tax stack")),
        "directions": F.when(F.col("diverging"), F.lit("directions differ")),
    }
    each = [F.struct(F.lit(source).alias("source"), note.alias("note")) for source, note in notes.items()]
    told = wide.select("ts", F.inline(F.array(*each))).filter("note IS NOT NULL")
    dated = wide.select("ts", local_day(F.col("ts"), tz).alias("day"))
    return told.unionByName(
        dated.join(season_notes(dated, seasons), "day").select("ts", F.lit("season").alias("source"), "note")
    )


def calendar_horizon(events: DataFrame, today: date, horizon_days: int = 7) -> DataFrame:
    """Distinct events from today to the horizon with the days until them, nearest first."""
    near = F.col("day").between(F.lit(today), F.date_add(F.lit(today), horizon_days))
    return (
        events.filter(near)
        .select("day", "name", "source")
        .distinct()
        .withColumn("days_away", F.date_diff("day", F.lit(today)))
        .orderBy("days_away", "name", "source")
    )


def landed_columns(spot: Column, fx: Column, tax: TaxStack) -> dict[str, Column]:
    return {
        "landed": F.round(money.landed_cost(spot, fx, tax), 2),
        "ex_tax": F.round(money.ex_tax_cost(spot, fx, tax), 2),
    }
