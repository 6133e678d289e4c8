"""The alert gate: which candidates reach a subscriber, and why the others do not.

Order of the checks: alerts off, muted, quiet hours, then by severity the trigger's
cooldown and the day's budget. Only fired alerts consume cooldown and budget.

Within one tick and trigger only the worst candidates can fire (one, or up to the
daily budget where a trigger has no cooldown), so candidates are ranked down to those
first, with the limit applied before the shuffle. What is walked for one subscriber is
then bounded by ticks x triggers, not by how many candidates a hot subscriber has. The
walk returns only what fired, at most the budget per day. Every other candidate gets
its reason from equality joins on (subscriber, tick, trigger).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.dates import in_daily_window, local_day, minute_of_day, tick_of
from tidemark.operators.walk import Watched, walk
from tidemark.rules import Gate

KEY = ["subscriber", "tick", "trigger"]


def cooldown_column(gate: Gate) -> Column:
    """Seconds of cooldown of the `trigger` column: its own, else the common one."""
    out = F.lit(round(gate.cooldown_hours * 3600))
    for name in gate.cooldowns:
        out = F.when(F.col("trigger") == name, F.lit(gate.cooldown_seconds(name))).otherwise(out)
    return out.cast("bigint")


def muted_ticks(mutes: DataFrame, tick_minutes: int) -> DataFrame:
    """Distinct (subscriber, tick) inside a mute: from <= tick < until."""
    width = tick_minutes * 60
    first = F.ceil(F.unix_micros("from_ts") / F.lit(1e6 * width)) * width
    last = (F.ceil(F.unix_micros("until_ts") / F.lit(1e6 * width)) - 1) * width
    ticks = F.when(
        first <= last, F.sequence(first.cast("bigint"), last.cast("bigint"), F.lit(width).cast("bigint"))
    )
    return mutes.select("subscriber", F.explode(ticks).alias("tick")).distinct()


def _contenders(candidates: DataFrame, gate: Gate) -> DataFrame:
    """The candidates that could fire at their tick.

    One per (subscriber, tick, trigger); where some trigger has no cooldown, up to a
    day's budget of that trigger. The rank limit is applied before the shuffle.
    """
    order = Window.partitionBy(*KEY).orderBy(F.desc("severity"), "id")
    cools = [gate.cooldown_hours, *gate.cooldowns.values()]
    limit = 1 if min(cools) > 0 else max(1, gate.max_per_day)
    return (
        candidates.select(*KEY, "id", "severity", "cooldown")
        .withColumn("_rank", F.row_number().over(order))
        .filter(F.col("_rank") <= limit)
        .filter((F.col("cooldown") == 0) | (F.col("_rank") == 1))
        .drop("_rank")
    )


def _prepared(candidates: DataFrame, gate: Gate) -> DataFrame:
    quiet = in_daily_window(
        minute_of_day(F.timestamp_seconds("tick"), gate.tz), gate.quiet_from, gate.quiet_to
    )
    return (
        candidates.withColumn("tick", tick_of(F.col("ts"), gate.tick_minutes))
        .withColumn("cooldown", cooldown_column(gate))
        .withColumn("_quiet", quiet)
    )


def walked(
    candidates: DataFrame,
    gate: Gate,
    mutes: DataFrame | None = None,
    prior: DataFrame | None = None,
    level_runs: Watched | None = None,
    prior_hits: DataFrame | None = None,
    told: bool = True,
) -> DataFrame:
    """What the walk says: `fired` rows, levels that are `held` back with the reason (if `told`), and
    levels left `hit` with the mask of their sides, which the next run takes as `prior_hits`.

    `level_runs` comes from `levels.level_runs` with the same gate.
    """
    contenders = _contenders(_prepared(candidates, gate).filter(~F.col("_quiet")), gate)
    if level_runs is not None:
        level_runs = level_runs._replace(holders=level_runs.holders.withColumn("cooldown", cooldown_column(gate)))
    return walk(contenders, gate.tz, gate.max_per_day, gate.tick_minutes, prior, mutes, prior_hits, level_runs, told)


def gated_fires(candidates: DataFrame, gate: Gate, *args: DataFrame | Watched | None, **more: DataFrame | Watched | None) -> DataFrame:
    """The fired rows alone, arguments as for `walked`."""
    fired = walked(candidates, gate, *args, **more, told=False).filter("what = 'fired'")
    return fired.select("subscriber", "tick", "trigger", "id", "series", "level", "direction")


def alert_gate(
    candidates: DataFrame,
    gate: Gate,
    mutes: DataFrame | None = None,
    prior: DataFrame | None = None,
    level_runs: Watched | None = None,
    prior_hits: DataFrame | None = None,
) -> DataFrame:
    """Add `tick`, `outcome` (fired, disabled, muted, quiet, cooldown, budget).

    Candidates: subscriber, trigger, ts, severity, id. `prior` holds earlier fires
    (subscriber, tick, trigger). Nothing is written: committing the fired rows is
    the caller's step, so a dry run is the same call. The walk runs once; a fired row
    carries the end of its cooldown, and both marks of a tick come from it.
    """
    if not gate.enabled:
        tick = F.timestamp_seconds(tick_of(F.col("ts"), gate.tick_minutes))
        return candidates.withColumn("tick", tick).withColumn("outcome", F.lit("disabled"))
    rows = _prepared(candidates, gate)
    fires = walked(candidates, gate, mutes, prior, level_runs, prior_hits, told=False).filter("what = 'fired'")
    own = F.when(F.col("level").isNull(), F.col("id"))
    marked = fires.select(*KEY, own.alias("id"), "cooled", F.lit(True).alias("now"))
    if prior is not None:
        earlier = prior.select(*KEY).withColumn("cooled", F.col("tick") + cooldown_column(gate))
        marked = marked.unionByName(earlier.withColumn("now", F.lit(False)), allowMissingColumns=True)
    width = F.lit(gate.tick_minutes * 60).cast("bigint")
    after = F.when(
        F.col("tick") + width < F.col("cooled"), F.sequence(F.col("tick") + width, F.col("cooled") - 1, width)
    ).otherwise(F.array().cast("array<bigint>"))
    spans = F.concat(
        F.when(F.col("now") & F.col("id").isNotNull(), F.array(F.struct("tick", "id"))).otherwise(
            F.array().cast("array<struct<tick:bigint,id:bigint>>")
        ),
        F.transform(after, lambda t: F.struct(t.alias("tick"), F.lit(None).cast("bigint").alias("id"))),
    )
    marks = (
        marked.select("subscriber", "trigger", F.explode(spans).alias("m"))
        .select("subscriber", "trigger", "m.tick", "m.id")
        .groupBy(*KEY)
        .agg(F.collect_list("id").alias("_ids"), F.count_if(F.col("id").isNull()).alias("_cooling"))
    )
    judged = rows.join(marks, KEY, "left")
    if mutes is not None:
        muted = muted_ticks(mutes, gate.tick_minutes).withColumn("_muted", F.lit(True))
        judged = judged.join(muted, ["subscriber", "tick"], "left")
    else:
        judged = judged.withColumn("_muted", F.lit(None).cast("boolean"))
    fired_here = F.coalesce(F.size("_ids"), F.lit(0)) > 0
    outcome = (
        F.when(F.col("_muted"), F.lit("muted"))
        .when(F.col("_quiet"), F.lit("quiet"))
        .when(F.coalesce(F.array_contains("_ids", F.col("id")), F.lit(False)), F.lit("fired"))
        .when(fired_here & (F.col("cooldown") > 0), F.lit("cooldown"))
        .when(F.coalesce("_cooling", F.lit(0)) > 0, F.lit("cooldown"))
        .otherwise(F.lit("budget"))
    )
    return judged.select(
        *candidates.columns, F.timestamp_seconds("tick").alias("tick"), outcome.alias("outcome")
    )


def cooldown_only(candidates: DataFrame, gate: Gate) -> DataFrame:
    """The gate with nothing but cooldowns: no mute, quiet hours or daily budget."""
    free = Gate(
        tz=gate.tz,
        tick_minutes=gate.tick_minutes,
        max_per_day=2_147_483_647,
        cooldown_hours=gate.cooldown_hours,
        quiet_from=0,
        quiet_to=0,
        cooldowns=gate.cooldowns,
    )
    return alert_gate(candidates, free)


def alerts_per_day(fired: DataFrame, tz: str) -> DataFrame:
    return fired.groupBy("subscriber", local_day(F.col("ts"), tz).alias("day")).agg(
        F.count("*").alias("alerts")
    )
