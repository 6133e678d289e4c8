"""Windowed aggregates over streams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.triggers import conflict_pairs
from tidemark.rules import ConflictRule


def daily_stream(readings: DataFrame, offset_minutes: int, lateness: str) -> DataFrame:
    """Last reading of each local day, for a zone at a fixed offset from UTC.

    A day is emitted once the watermark has passed its end. The lateness is the
    largest delay that still counts.
    """
    start = (1440 - offset_minutes) % 1440
    day = F.window("ts", "1 day", "1 day", f"{start} minutes")
    return (
        readings.filter(F.col("value").isNotNull())
        .withWatermark("ts", lateness)
        .groupBy("series", day.alias("w"))
        .agg(F.max_by("value", F.struct("ts", "id")).alias("value"))
        .select("series", F.to_date(F.col("w.start") + F.expr(f"INTERVAL '{offset_minutes}' MINUTE")).alias("day"), "value")
    )


def conflict_stream(
    articles: DataFrame,
    text: Column,
    keywords: Sequence[str],
    domains: Sequence[str],
    rule: ConflictRule,
    tick_minutes: int,
    lateness_minutes: int,
) -> DataFrame:
    """Ticks at which independent sources and keywords meet, as they close.

    The ticks of an article come from the same helper as in the batch job. They run
    ahead of its time by up to the window, so the watermark waits that much longer.
    The state per tick is two sets bounded by the configured lists.
    """
    wait = f"{round(rule.window_hours * 60) + lateness_minutes} minutes"
    pairs = conflict_pairs(articles, text, keywords, domains, rule, tick_minutes)
    return (
        pairs.select(F.timestamp_seconds("tick").alias("ts"), "domain", F.explode("hits").alias("keyword"))
        .withWatermark("ts", wait)
        .groupBy("ts")
        .agg(
            F.sort_array(F.collect_set("domain")).alias("domains"),
            F.sort_array(F.collect_set("keyword")).alias("keywords"),
        )
        .filter((F.size("domains") >= rule.min_sources) & (F.size("keywords") >= rule.min_keywords))
        .select(
            "ts",
            F.size("domains").alias("domain_count"),
            F.size("keywords").alias("keyword_count"),
            F.array_join("domains", ", ").alias("domains"),
            F.array_join("keywords", ", ").alias("keywords"),
        )
    )
