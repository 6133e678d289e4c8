"""One scan for every trigger, and what happens to its candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.dates import local_day
from tidemark.functions.numbers import grouped, signed
from tidemark.operators.gate import alert_gate
from tidemark.operators.levels import LEVEL_SEVERITY, LEVEL_TRIGGER
from tidemark.rules import ConflictRule, Gate


def trigger_scan(moves: DataFrame, conflicts: DataFrame, crossings: DataFrame, rule: ConflictRule) -> DataFrame:
    """Candidates of all triggers in one shape.

    A trigger whose data is missing yields nothing. This is one plan, so a branch that
    fails fails all; `plans.watch` runs each rule as a job of its own.
    """
    unit = (
        F.when(F.col("kind") == "pct", F.lit("%"))
        .when(F.col("kind") == "bp", F.lit("bp"))
        .when(F.col("kind") == "pp", F.lit("pp"))
        .otherwise(F.lit(""))
    )
    moved = moves.select(
        "trigger",
        "series",
        "ts",
        "severity",
        F.concat(
            "series", F.lit(" "), signed(F.col("move"), 3), unit, F.lit(" from "),
            grouped(F.col("baseline"), 2), F.lit(" to "), grouped(F.col("current"), 2),
        ).alias("summary"),
    )
    met = conflicts.select(
        F.lit(rule.trigger).alias("trigger"),
        F.lit("news").alias("series"),
        "ts",
        "severity",
        F.concat(
            F.col("domain_count").cast("string"), F.lit(" sources: "), "domains", F.lit("; keywords: "), "keywords"
        ).alias("summary"),
    )
    crossed = crossings.select(
        F.lit(LEVEL_TRIGGER).alias("trigger"),
        "series",
        "ts",
        F.lit(LEVEL_SEVERITY).alias("severity"),
        F.concat(
            F.lit("crossed "), "direction", F.lit(" "), grouped(F.col("level"), 2),
            F.lit(": now "), grouped(F.col("price"), 2),
        ).alias("summary"),
    )
    return moved.unionByName(met).unionByName(crossed)


def watch(
    found: DataFrame,
    subscriptions: DataFrame,
    gate: Gate,
    mutes: DataFrame | None = None,
    prior: DataFrame | None = None,
) -> DataFrame:
    """Candidates handed to the subscribers of their trigger, each judged by the gate.

    `found` has trigger, ts, severity and an id; `subscriptions` has (subscriber,
    trigger). Appending the fired rows to the alert log is the caller's step.
    """
    offered = found.join(subscriptions.select("subscriber", "trigger").distinct(), "trigger")
    return alert_gate(offered.select("id", "subscriber", "trigger", "ts", "severity"), gate, mutes, prior)


def run_decision(runs: DataFrame, health: DataFrame, quiet: DataFrame, schedule: DataFrame, tz: str) -> DataFrame:
    """What each run (run_id, mode, ts) comes to: off, not a configured day, a degraded notice, a
    skip as nothing moved, or a brief.

    `schedule` has a row for each mode: enabled, days (names as `mon`), only_if_changed. A mode
    without a row is off. A run without health is degraded.
    """
    planned = runs.select("run_id", "mode", "ts").join(schedule, "mode", "left")
    known = planned.join(health.select("run_id", "data_count", "degraded"), "run_id", "left")
    judged = known.join(quiet.select("run_id", "mode", "quiet"), ["run_id", "mode"], "left")
    weekday = F.lower(F.date_format(local_day(F.col("ts"), tz), "E"))
    still = F.coalesce("quiet", F.lit(False))
    return judged.select(
        "run_id",
        "mode",
        F.coalesce("data_count", F.lit(0)).alias("data_count"),
        still.alias("quiet"),
        F.when(~F.coalesce("enabled", F.lit(False)), F.lit("off"))
        .when(~F.array_contains("days", weekday), F.lit("not_scheduled"))
        .when(F.coalesce("degraded", F.lit(True)), F.lit("degraded"))
        .when(F.col("only_if_changed") & still, F.lit("skip"))
        .otherwise(F.lit("brief"))
        .alias("decision"),
    )
