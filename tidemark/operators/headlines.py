"""Headline jobs: first-seen dedupe, novelty, upsert, tagging, signals, top-k."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import any_term, keyword_hits


def dedupe_first(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """First row of each key. A minimum combines on the map side; a window would not."""
    row = F.struct(*[F.col(c) for c in df.columns])
    first = F.min_by(row, F.struct(*[F.col(c) for c in order]))
    return df.groupBy(F.col(key).alias("_key")).agg(first.alias("r")).select("r.*")


def unseen(batch: DataFrame, known: DataFrame, key: str) -> DataFrame:
    return batch.join(known.select(key).distinct(), key, "left_anti")


def mark_new(batch: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Add `is_new`: the key was not stored before this batch."""
    seen = known.select(key).distinct().withColumn("_seen", F.lit(True))
    return batch.join(seen, key, "left").withColumn("is_new", F.col("_seen").isNull()).drop("_seen")


def upsert(stored: DataFrame, batch: DataFrame, key: str = "url") -> DataFrame:
    """Stored rows merged with a batch.

    First seen, domain, source and publication time stay as first stored; title,
    summary and keywords are overwritten. `pos` orders the batch; a key that comes
    twice in it counts as one. `is_new` marks keys that were not stored.
    """
    fixed, moving = ["domain", "source", "published_at", "first_seen"], ["title", "summary", "keywords"]
    cols = [key, *fixed, *moving]
    both = stored.select(*cols, F.lit(0).alias("_gen"), F.lit(0).cast("bigint").alias("_pos")).unionByName(
        batch.select(*cols, F.lit(1).alias("_gen"), F.col("pos").cast("bigint").alias("_pos"))
    )
    when = F.struct("_gen", "_pos")
    merged = both.groupBy(key).agg(
        F.min_by(F.struct(*fixed), when).alias("f"),
        F.max_by(F.struct(*moving), when).alias("m"),
        (F.min("_gen") == 1).alias("is_new"),
    )
    return merged.select(key, "f.*", "m.*", "is_new")


def tagged(df: DataFrame, text: Column, keywords: Sequence[str]) -> DataFrame:
    return df.withColumn("keywords", keyword_hits(text, keywords))


def keyword_counts(df: DataFrame, text: Column, keywords: Sequence[str], by: Sequence[str]) -> DataFrame:
    return (
        df.select(*by, F.explode(keyword_hits(text, keywords)).alias("keyword"))
        .groupBy(*by, "keyword")
        .agg(F.count("*").alias("n"))
    )


def term_signals(
    df: DataFrame, text: Column, mention: Sequence[str], issuance: Sequence[str], pause: Sequence[str], by: str
) -> DataFrame:
    """What the mentions of a group say: issuance, pause, both, unclear or none."""
    said = any_term(text, mention)
    has = lambda cond: F.coalesce(F.bool_or(cond), F.lit(False))
    flags = df.groupBy(by).agg(
        F.count_if(said).alias("mentions"),
        has(said & any_term(text, issuance)).alias("_open"),
        has(said & any_term(text, pause)).alias("_shut"),
    )
    signal = (
        F.when(F.col("mentions") == 0, F.lit("none"))
        .when(F.col("_open") & F.col("_shut"), F.lit("both"))
        .when(F.col("_open"), F.lit("issuance"))
        .when(F.col("_shut"), F.lit("pause"))
        .otherwise(F.lit("unclear"))
    )
    return flags.select(by, "mentions", signal.alias("signal"))


def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column | str], k: int) -> DataFrame:
    """First k rows per group with their rank; the limit runs before the shuffle too."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def flagged(df: DataFrame, text: Column, terms: Sequence[str], group: Sequence[str], order: Sequence[str], k: int = 4) -> DataFrame:
    return top_per_group(df.filter(any_term(text, terms)), group, order, k)


def capped(
    df: DataFrame, new_cap: int = 25, known_cap: int = 10, by: Sequence[str] = (), order: str = "id"
) -> DataFrame:
    """New headlines up to one cap, known ones up to another, in feed order."""
    ranked = top_per_group(df, [*by, "is_new"], [order], max(new_cap, known_cap))
    return ranked.filter(F.col("rank") <= F.when(F.col("is_new"), new_cap).otherwise(known_cap))


def recent(df: DataFrame, now: datetime, hours: float, ts: str = "first_seen", tie: str = "id") -> DataFrame:
    """Rows since `now - hours`, newest first."""
    cutoff = F.lit(now) - F.expr(f"INTERVAL '{round(hours * 3600)}' SECOND")
    return df.filter(F.col(ts) >= cutoff).orderBy(F.desc(ts), tie)
