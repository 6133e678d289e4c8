"""Facts for a brief and the two price reports, as rows of text with an order."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.dates import age_text, hours_between
from tidemark.functions.numbers import grouped, round_levels, signed
from tidemark.operators.headlines import capped

LAST_PLACE = 1_000_000  # of series that have no place in the presentation order


def reading_line(label: Column, value: Column, unit: Column, source: Column, suffix: Column, tail: Column | None = None) -> Column:
    """`- label: 1,234.50 unit (session +1.20%), source: name`; no decimals from 1e7 on."""
    shown = F.when(F.abs(value) < 1e7, grouped(value, 2)).otherwise(grouped(value, 0))
    return F.concat(
        F.lit("- "), label, F.lit(": "), shown, F.lit(" "), unit, F.coalesce(suffix, F.lit("")),
        F.lit(", source: "), source, F.lit("") if tail is None else tail,
    )


# How the figures beside a reading are shown.
CHANGES = {
    "change_pct": " (session %+.2f%%)",
    "change_bp": " (%+.1fbp vs prior print)",
    "delta": " (delta %+.2ft)",
    "week_change": " (week %+,.0f)",
}
REMARKS = {"observed": " [observation date %s]", "caveat": " [caveat: %s]"}


def shown_fields(shapes: dict[str, str], present: list[str]) -> Column:
    """The fields of a row that are present and not null, each in its shape."""
    parts = [F.when(F.col(n).isNotNull(), F.format_string(shape, n)) for n, shape in shapes.items() if n in present]
    return F.concat_ws("", *parts)


def reading_facts(latest: DataFrame, changes: DataFrame, order: DataFrame) -> DataFrame:
    """Latest readings in presentation order; series without a place follow by name.

    `changes` has a row for each series with any of the fields of `CHANGES` and `REMARKS`.
    """
    rows = latest.join(order, "series", "left").join(changes, "series", "left")
    return rows.select(
        F.lit("readings").alias("section"),
        F.coalesce("place", F.lit(LAST_PLACE)).alias("ord"),
        F.col("series").alias("key"),
        reading_line(
            F.coalesce("label", "series"),
            F.col("value"),
            F.col("unit"),
            F.col("source"),
            shown_fields(CHANGES, changes.columns),
            shown_fields(REMARKS, changes.columns),
        ).alias("text"),
    )


def headline_facts(marked: DataFrame, new_cap: int = 25, known_cap: int = 10) -> DataFrame:
    """New headlines with their links and known ones without, each list under a line with the
    count of all of them; a list without rows has no line, but for the new ones."""
    counts = marked.agg(F.count_if("is_new").alias("n_new"), F.count_if(~F.col("is_new")).alias("n_known"))
    n = lambda c: F.col(c).cast("string")
    new_line = F.concat(F.lit("new since the last run: "), F.when(F.col("n_new") == 0, "none").otherwise(n("n_new")))
    known_line = F.when(F.col("n_known") > 0, F.concat(F.lit("seen in an earlier run: "), n("n_known")))
    heads = counts.select(
        F.inline(
            F.array(
                F.struct(F.lit("headlines_new").alias("section"), new_line.alias("text")),
                F.struct(F.lit("headlines_known").alias("section"), known_line.alias("text")),
            )
        )
    ).filter("text IS NOT NULL")
    link = F.when(F.col("is_new"), F.concat(F.lit(" ("), F.col("url"), F.lit(")"))).otherwise(F.lit(""))
    rows = capped(marked, new_cap, known_cap).select(
        F.when(F.col("is_new"), F.lit("headlines_new")).otherwise(F.lit("headlines_known")).alias("section"),
        F.col("rank").alias("ord"),
        F.col("id").cast("string").alias("key"),
        F.concat(F.lit("- ["), "domain", F.lit("] "), "title", link).alias("text"),
    )
    return rows.unionByName(heads.select("section", F.lit(0).alias("ord"), F.lit("").alias("key"), "text"))


def brief_facts(
    readings: DataFrame,
    trends: DataFrame,
    headlines: DataFrame,
    gaps: DataFrame,
    previous: DataFrame,
    calendar: DataFrame,
    notes: DataFrame,
    now: datetime,
) -> DataFrame:
    """Rows (section, ord, key, text) of every section that has something to say.

    Within a section rows sort by (ord, key). `readings` come from `reading_facts`, `headlines`
    from `headline_facts`, `calendar` from `calendar_horizon`; `notes` has (source, note) of the
    run, `previous` each subscriber's last brief, which is quoted with its age. No section is
    numbered by a window over all of its rows, so a long list of gaps never meets in one task.
    """
    unranked = F.lit(0).alias("ord")
    trend_rows = trends.select(
        F.lit("trend").alias("section"),
        unranked,
        F.col("series").alias("key"),
        F.concat(
            F.lit("- "), "series", F.lit(": "), "rendered", F.lit(" -> "),
            signed(F.col("direction_pct"), 2), F.lit("% over the window"),
        ).alias("text"),
    )
    gap_rows = gaps.select(
        F.lit("gaps").alias("section"),
        unranked,
        F.col("source").alias("key"),
        F.concat(F.lit("- "), "source", F.lit(": "), "detail").alias("text"),
    )
    note_rows = notes.select(
        F.lit("notes").alias("section"),
        unranked,
        F.col("source").alias("key"),
        F.concat(F.lit("- "), "source", F.lit(": "), "note").alias("text"),
    )
    day = F.col("day").cast("string")
    dates = calendar.select(
        F.lit("calendar").alias("section"),
        F.col("days_away").alias("ord"),
        F.concat_ws(" ", day, "name", "source").alias("key"),
        F.concat(
            F.lit("- "), "name", F.lit(": "), day, F.lit(" (in "), F.col("days_away").cast("string"),
            F.lit("d), source: "), "source",
        ).alias("text"),
    )
    said = F.trim(F.coalesce("text", F.lit("")))
    prior = previous.select(
        F.lit("previous").alias("section"),
        unranked,
        F.col("subscriber").cast("string").alias("key"),
        F.when(said == "", F.lit("- none on record"))
        .otherwise(F.concat(F.lit("- "), "mode", F.lit(", "), age_text(hours_between(F.lit(now), F.col("ts"))), F.lit(" ago: "), said))
        .alias("text"),
    )
    out = readings
    for part in (trend_rows, headlines, gap_rows, note_rows, dates, prior):
        out = out.unionByName(part)
    return out


def levels_report(latest: DataFrame, extremes: DataFrame, distances: DataFrame, hits: DataFrame, step: float) -> DataFrame:
    """Current price, ranges, round numbers and own levels with their distance.

    An own level carries its note and its origin. `hits` (subscriber, level) marks levels that
    have fired and not re-armed; a level that watches both sides counts as hit on either.
    """
    nothing = {"note": F.lit(""), "origin": F.lit(""), "hit": F.lit(False)}
    price = latest.select(
        F.lit(None).cast("bigint").alias("subscriber"),
        F.lit("price").alias("section"),
        F.col("series").alias("key"),
        F.col("value").alias("low"),
        F.col("value").alias("high"),
    )
    ranges = extremes.select(
        F.lit(None).cast("bigint").alias("subscriber"),
        F.lit("range").alias("section"),
        F.concat("series", F.lit(" "), F.col("days").cast("string"), F.lit("d")).alias("key"),
        "low",
        "high",
    )
    rounds = latest.select(
        F.lit(None).cast("bigint").alias("subscriber"),
        F.lit("round").alias("section"),
        F.col("series").alias("key"),
        F.explode(round_levels(F.col("value"), step)).alias("low"),
    ).select("subscriber", "section", "key", "low", F.col("low").alias("high"))
    hit = hits.select("subscriber", F.col("level").alias("value"), F.lit(True).alias("hit")).distinct()
    own = distances.join(hit, ["subscriber", "value"], "left").select(
        "subscriber",
        F.lit("own").alias("section"),
        F.col("direction").alias("key"),
        F.col("value").alias("low"),
        F.round("distance_pct", 4).alias("high"),
        F.coalesce("note", F.lit("")).alias("note"),
        "origin",
        F.coalesce("hit", F.lit(False)).alias("hit"),
    )
    return price.unionByName(ranges).unionByName(rounds).withColumns(nothing).unionByName(own)


#: Leg, its column, the column of its session change.
NOW_LEGS = (
    ("gold", "gold", "spot_change"),
    ("landed", "landed", None),
    ("ex_tax", "ex_tax", None),
    ("fx", "fx", "fx_change"),
    ("ratio", "ratio", None),
)


def now_report(wide: DataFrame, legs: Sequence[tuple[str, str, str | None]] = NOW_LEGS) -> DataFrame:
    """(ts, ord, leg, value, change_pct, note): prices and derived legs at the newest instant.

    `wide` comes from `derive_columns`. Changes are those of the session; legs without a value
    are left out. Legs that lie too far apart are noted at the first one.
    """
    newest = wide.orderBy(F.desc("ts")).limit(1)
    nothing = F.lit(None).cast("double")
    apart = F.when(F.col("cross_wide"), F.col("cross_note"))
    rows = [
        F.struct(
            F.lit(n).alias("ord"),
            F.lit(leg).alias("leg"),
            F.col(value).cast("double").alias("value"),
            (F.round(F.col(change), 4) if change else nothing).alias("change_pct"),
            (apart if n == 1 else F.lit(None).cast("string")).alias("note"),
        )
        for n, (leg, value, change) in enumerate(legs, 1)
    ]
    return newest.select("ts", F.inline(F.array(*rows))).filter("value <> 0")
