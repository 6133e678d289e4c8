"""Trigger evaluation: rolling-window moves, source co-occurrence, severity.

Everything here is pure: it returns candidates and commits nothing.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.dates import tick_of
from tidemark.functions.text import keyword_hits
from tidemark.operators.asof import rolling_baseline, window_baseline
from tidemark.operators.filters import allowed
from tidemark.rules import ConflictRule

# Digits to which a move of each kind is kept in the candidate.
_DIGITS = {"pct": 3, "bp": 2, "pp": 2, "abs": 3}


def move_of(kind: Column, current: Column, base: Column) -> Column:
    return (
        F.when(kind == "pct", (F.try_divide(current, base) - 1.0) * 100.0)
        .when(kind == "bp", (current - base) * 100.0)
        .otherwise(current - base)
    )


def _rounded(kind: Column, move: Column) -> Column:
    out = F.lit(None).cast("double")
    for name, digits in _DIGITS.items():
        out = F.when(kind == name, F.round(move, digits)).otherwise(out)
    return out


def move_candidates(readings: DataFrame, rules: DataFrame, busy: DataFrame | None = None) -> DataFrame:
    """Readings that moved at least the threshold of a rule for their series.

    The rule fires on the unrounded move; severity, in multiples of the threshold,
    comes from the rounded one. A rule without a usable baseline yields nothing and
    leaves the other rules alone.
    """
    per_series = (
        rules.filter("enabled")
        .groupBy("series")
        .agg(F.collect_list(F.struct("trigger", "kind", "window_hours", "threshold")).alias("_rules"))
    )
    watched = readings.select("series", "ts", "id", "value").join(per_series, "series")
    return _moved(rolling_baseline(watched, "_rules", busy))


def fresh_moves(readings: DataFrame, rules: DataFrame, since: datetime) -> DataFrame:
    """`move_candidates` of the readings from `since` on; earlier ones are only looked back to."""
    wanted = rules.filter("enabled").select("series", "trigger", "kind", "window_hours", "threshold")
    known = readings.filter(F.col("value").isNotNull()).join(wanted.select("series").distinct(), "series", "left_semi")
    new = known.filter(F.col("ts") >= F.lit(since)).select("series", "ts", "id", "value").join(wanted, "series")
    return _moved(window_baseline(new, known.select("series", "ts", "id", "value")))


def _moved(based: DataFrame) -> DataFrame:
    based = based.withColumn("_base", F.col("baseline.value"))
    moved = based.withColumn("_move", move_of(F.col("kind"), F.col("value"), F.col("_base")))
    return (
        moved.filter(F.abs("_move") >= F.col("threshold"))
        .withColumn("move", _rounded(F.col("kind"), F.col("_move")))
        .select(
            "trigger",
            "series",
            "kind",
            "ts",
            "id",
            F.col("value").alias("current"),
            F.col("_base").alias("baseline"),
            F.col("baseline.ts").alias("baseline_ts"),
            "move",
            "threshold",
            (F.abs("move") / F.col("threshold")).alias("severity"),
        )
    )


def covering_ticks(ts: Column, window_hours: float, tick_minutes: int) -> Column:
    """Ticks whose trailing window, lower bound included, holds the time."""
    width = tick_minutes * 60
    seconds = F.unix_micros(ts) / F.lit(1e6)
    first = F.ceil(seconds / width) * width
    last = F.floor((seconds + window_hours * 3600) / width) * width
    return F.when(first <= last, F.sequence(first.cast("bigint"), last.cast("bigint"), F.lit(width).cast("bigint")))


def conflict_pairs(
    articles: DataFrame,
    text: Column,
    keywords: Sequence[str],
    domains: Sequence[str],
    rule: ConflictRule,
    tick_minutes: int,
) -> DataFrame:
    """(tick, article, keyword hits) of allowed domains; one row per covered tick."""
    ticks = covering_ticks(F.col("first_seen"), rule.window_hours, tick_minutes)
    return (
        allowed(articles, "domain", domains)
        .withColumn("hits", keyword_hits(text, keywords))
        .select(
            "domain",
            "title",
            "first_seen",
            "id",
            "hits",
            # No hits, no ticks: a filter would work the hits out a second time.
            F.explode(F.when(F.size("hits") > 0, ticks)).alias("tick"),
        )
    )


def conflict_events(pairs: DataFrame, rule: ConflictRule) -> DataFrame:
    """Ticks at which enough independent domains and keywords meet.

    A domain counts once however much it publishes. Pairs collapse to distinct
    (tick, domain, keyword) on the map side, so a busy domain or tick shrinks to the
    configured lists before anything is gathered.
    """
    distinct = pairs.select("tick", "domain", F.explode("hits").alias("keyword")).distinct()
    met = (
        distinct.groupBy("tick")
        .agg(
            F.sort_array(F.collect_set("domain")).alias("domains"),
            F.sort_array(F.collect_set("keyword")).alias("keywords"),
        )
        .filter(
            (F.size("domains") >= rule.min_sources) & (F.size("keywords") >= rule.min_keywords)
        )
    )
    newest = Window.partitionBy("tick").orderBy(F.desc("first_seen"), "id")
    titles = (
        pairs.withColumn("_rank", F.row_number().over(newest))
        .filter(F.col("_rank") <= rule.max_titles)
        .groupBy("tick")
        .agg(F.sort_array(F.collect_list(F.struct("_rank", "domain", "title"))).alias("_titles"))
    )
    line = lambda t: F.concat(F.lit("["), t["domain"], F.lit("] "), t["title"])
    return met.join(titles, "tick").select(
        F.timestamp_seconds("tick").alias("ts"),
        F.size("domains").alias("domain_count"),
        F.size("keywords").alias("keyword_count"),
        F.array_join("domains", ", ").alias("domains"),
        F.array_join("keywords", ", ").alias("keywords"),
        F.array_join(F.transform("_titles", line), "\n").alias("titles"),
        (F.size("domains") / F.lit(float(rule.min_sources))).alias("severity"),
    )


def severity_rank(candidates: DataFrame, tick_minutes: int) -> DataFrame:
    """Triggers of each subscriber and tick, most severe first.

    One row per (subscriber, tick, trigger) with its worst candidate and how many
    there were: counting and the maximum combine on the map side.
    """
    worst = F.max_by("id", F.struct(F.col("severity"), -F.col("id")))
    grouped = (
        candidates.withColumn("tick", tick_of(F.col("ts"), tick_minutes))
        .groupBy("subscriber", "tick", "trigger")
        .agg(F.max("severity").alias("severity"), worst.alias("id"), F.count("*").alias("candidates"))
    )
    order = Window.partitionBy("subscriber", "tick").orderBy(F.desc("severity"), "id")
    return grouped.select(
        "subscriber",
        F.timestamp_seconds("tick").alias("tick"),
        "trigger",
        "severity",
        "id",
        "candidates",
        F.row_number().over(order).alias("rank"),
    )
