"""Freshness and completeness of sources, quiet spells and earlier briefs."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.dates import hours_between, shift_hours
from tidemark.functions.numbers import change_pct
from tidemark.operators.asof import as_of
from tidemark.rules import CHANGE_FLOOR_PCT, MIN_SOURCES_WITH_DATA


def asof_age(readings: DataFrame, limits: DataFrame, today: date) -> DataFrame:
    """Sources whose newest observation is older than the limit of their series.

    A negative limit means the age is always stated. `limits` is configuration.
    """
    newest = (
        readings.filter(F.col("value").isNotNull())
        .groupBy("series", "source")
        .agg(F.to_date(F.max("ts")).alias("observed"))
    )
    age = F.date_diff(F.lit(today), "observed")
    return (
        newest.join(limits, "series")
        .filter((age > F.col("limit_days")) | (F.col("limit_days") < 0))
        .select("series", "source", "observed", age.alias("age_days"))
    )


def has_data(ok: Column, n_readings: Column, n_headlines: Column) -> Column:
    """Ran and produced a number or a headline; a healthy `nothing found` has no data."""
    return ok & ((n_readings > 0) | (n_headlines > 0))


def source_health(runs: DataFrame, min_with_data: int = MIN_SOURCES_WITH_DATA) -> DataFrame:
    """Counts and name lists per run; degraded when too few sources carry data.

    Rows collapse to one per (run, source) first, so a list holds source names, which
    the registry bounds.
    """
    one = (
        runs.groupBy("run_id", "source")
        .agg(
            F.bool_and("ok").alias("ok"),
            F.sum("n_readings").alias("n_readings"),
            F.sum("n_headlines").alias("n_headlines"),
        )
        .withColumn("data", has_data(F.col("ok"), F.col("n_readings"), F.col("n_headlines")))
    )

    def names(cond: Column) -> Column:
        return F.array_join(F.sort_array(F.collect_list(F.when(cond, F.col("source")))), ", ")

    empty = F.col("ok") & ~F.col("data")
    return one.groupBy("run_id").agg(
        F.count("*").alias("sources"),
        F.count_if("ok").alias("ok_count"),
        F.count_if("data").alias("data_count"),
        names(~F.col("ok")).alias("failed"),
        names(empty).alias("empty"),
        names(F.col("data")).alias("with_data"),
        (F.count_if("data") < min_with_data).alias("degraded"),
    )


def staleness(
    readings: DataFrame, categories: DataFrame, budgets: DataFrame, now: datetime
) -> DataFrame:
    """Sources whose newest reading is past the budget of their category.

    `categories` (source, category) names each source; `budgets` (category,
    budget_hours) is configuration. Late readings are reported here, never dropped.
    """
    newest = (
        readings.filter(F.col("value").isNotNull()).groupBy("source").agg(F.max("ts").alias("newest"))
    )
    return (
        newest.join(categories, "source")
        .join(budgets, "category")
        .withColumn("age_hours", hours_between(F.lit(now), F.col("newest")))
        .filter(F.col("age_hours") > F.col("budget_hours"))
        .select("source", "category", "newest", "age_hours", "budget_hours")
    )


def data_gaps(runs: DataFrame, stale: DataFrame, run_id: str) -> DataFrame:
    """Failed sources of a run, and sources past their budget."""
    failed = runs.filter((F.col("run_id") == run_id) & ~F.col("ok")).select(
        F.lit("failed").alias("kind"), "source", F.coalesce("error", F.lit("unavailable")).alias("detail")
    )
    old = stale.select(
        F.lit("stale").alias("kind"),
        "source",
        F.format_string(
            "last value %.1f hours ago, allowed are %.0f", "age_hours", "budget_hours"
        ).alias("detail"),
    )
    return failed.unionByName(old)


def notes_of(runs: DataFrame, notes: DataFrame) -> DataFrame:
    """Notes of a run's sources with a line for each source that was unavailable."""
    down = runs.filter(~F.col("ok")).select(
        "run_id",
        "source",
        F.concat(F.lit("no data: "), F.coalesce("error", F.lit("stale"))).alias("note"),
    )
    return notes.select("run_id", "source", "note").unionByName(down)


def quiet_since(
    runs: DataFrame, briefs: DataFrame, readings: DataFrame, names: list[str], floor_pct: float = CHANGE_FLOOR_PCT
) -> DataFrame:
    """Whether no watched series moved since the last morning brief.

    Each run (run_id, ts) looks back to that brief, at least one hour. A missing brief,
    value or baseline means not quiet.
    """
    morning = briefs.filter("mode = 'morning'").select("ts", F.unix_micros("ts").alias("tie"))
    based = as_of(runs.select("run_id", "ts"), morning, [], "ts", "ts", ["ts"], "tie", "brief")
    hours = F.greatest(F.lit(1.0), hours_between(F.col("ts"), F.col("brief.ts")))
    # Two probes per run and series, at the run and at the window's start, in one walk.
    # Without a brief the window is unknown; an hour keeps the probe in the walk.
    known = F.col("brief").isNotNull()
    look = lambda role, back: F.struct(F.lit(role).alias("role"), back.alias("back"))
    probes = based.select(
        "run_id",
        "ts",
        known.alias("known"),
        F.inline(F.array(look("now", F.lit(0.0)), look("base", F.coalesce(hours, F.lit(1.0))))),
    ).withColumn("series", F.explode(F.array(*[F.lit(n) for n in names])))
    watched = readings.filter(F.col("series").isin(*names) & F.col("value").isNotNull())
    found = as_of(
        probes.withColumn("at", shift_hours(F.col("ts"), -F.col("back"))),
        watched, ["series"], "at", "ts", ["value"], "id", "hit", "oldest",
    )
    pick = lambda role, value: F.max(F.when(F.col("role") == role, value))
    pairs = found.groupBy("run_id", "ts", "series", "known").agg(
        pick("now", F.col("hit.value")).alias("now"),
        pick("base", F.coalesce("hit.value", "oldest.value")).alias("base"),
    )
    still = F.col("known") & (F.abs(change_pct(F.col("now"), F.col("base"))) < floor_pct)
    return pairs.groupBy("run_id", "ts").agg(F.bool_and(F.coalesce(still, F.lit(False))).alias("quiet"))


def previous_brief(briefs: DataFrame) -> DataFrame:
    """Latest earlier brief of each subscriber that is not an alert."""
    just_before = F.timestamp_micros(F.unix_micros("ts") - 1)
    data = briefs.filter("mode <> 'alert'").withColumn("tie", F.unix_micros("ts"))
    probes = briefs.withColumn("_before", just_before)
    found = as_of(probes, data, ["subscriber"], "_before", "ts", ["mode", "ts"], "tie", "p")
    return found.select(
        *briefs.columns, F.col("p.mode").alias("previous_mode"), F.col("p.ts").alias("previous_ts")
    )


def last_brief(briefs: DataFrame, mode: str | None = None) -> DataFrame:
    """Newest brief of each subscriber, of one mode if given, else of any but alerts; at equal times the last by text."""
    kept = briefs.filter(F.col("mode") == mode) if mode else briefs.filter("mode <> 'alert'")
    last = F.max_by(F.struct("ts", "mode", "text"), F.struct("ts", "text", "mode"))
    return kept.groupBy("subscriber").agg(last.alias("b")).select("subscriber", "b.*")
