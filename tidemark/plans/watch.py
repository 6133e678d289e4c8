"""One watch run: look for triggers in what is new, judge them, log what fired.

A home folder holds the tables: `readings` and `headlines` (filled by the sinks),
`candidates` and `walked` by run, `alert_log` by local day and run, `level_hits` by run.
Every rule is a job of its own, so a rule that fails is an outcome row and the others go
on. State comes from the tables alone: fires of earlier runs, by the days that matter,
and the levels that the run before left hit. A run that is repeated replaces what it wrote.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidemark import rules as fixed
from tidemark.functions.dates import local_day
from tidemark.operators.gate import walked
from tidemark.operators.levels import level_runs
from tidemark.operators.series import tick_series
from tidemark.operators.triggers import conflict_events, conflict_pairs, fresh_moves
from tidemark.rules import ConflictRule, Gate, MoveRule, move_rule_table
from tidemark.sources.sinks import exists, headlines, prune

#: A rule gets (session, home, from, to) and returns trigger, ts, severity, id.
Rule = Callable[[SparkSession, str, datetime, datetime], DataFrame]
CANDIDATE = "trigger string, ts timestamp, severity double, id bigint"
RUNS = "run int, rule string, ok boolean, error string, candidates bigint"


def expire(spark: SparkSession, home: str, now: datetime, days: int = fixed.RETENTION_DAYS) -> None:
    """Drop readings older than the retention."""
    prune(spark, f"{home}/readings", now - timedelta(days=days))


def _epoch(at: datetime) -> int:
    return int(at.replace(tzinfo=at.tzinfo or UTC).timestamp())


def move_watch(rule: MoveRule, place: int = 0, places: int = 1) -> Rule:
    """Moves of new readings; ids are those of the readings times `places`, plus the rule's place."""

    def run(spark: SparkSession, home: str, since: datetime, until: datetime) -> DataFrame:
        stored = spark.read.parquet(f"{home}/readings").filter(F.col("ts") < F.lit(until))
        found = fresh_moves(stored, move_rule_table(spark, (rule,)), since)
        return found.withColumn("id", F.col("id") * places + place)

    return run


def conflict_watch(rule: ConflictRule, keywords: tuple[str, ...], domains: tuple[str, ...], tick_minutes: int) -> Rule:
    """Meetings of independent sources at the ticks of the run; ids are the ticks.

    Reads the headlines that can cover a tick of the run, and no older ones.
    """

    def run(spark: SparkSession, home: str, since: datetime, until: datetime) -> DataFrame:
        if not exists(spark, f"{home}/headlines"):
            raise FileNotFoundError(f"no headlines table in {home}")
        reach = since - timedelta(hours=rule.window_hours)
        news = headlines(spark, f"{home}/headlines", reach).filter(F.col("first_seen") < F.lit(until))
        news = news.withColumn("id", F.xxhash64("url"))
        pairs = conflict_pairs(news, F.col("title"), keywords, domains, rule, tick_minutes)
        new = F.col("tick").between(_epoch(since), _epoch(until) - 1)
        met = conflict_events(pairs.filter(new), rule)
        return met.select(F.lit(rule.trigger).alias("trigger"), "ts", "severity", F.unix_seconds("ts").alias("id"))

    return run


def standard_rules() -> dict[str, Rule]:
    """The default moves, each with its own job, and the default co-occurrence rule."""
    moves = [r for r in fixed.DEFAULT_MOVE_RULES if r.enabled]
    out = {r.trigger: move_watch(r, i, len(moves) + 1) for i, r in enumerate(moves)}
    conflict = ConflictRule()
    out[conflict.trigger] = conflict_watch(
        conflict, fixed.CONFLICT_KEYWORDS, fixed.INDEPENDENT_DOMAINS, fixed.DEFAULT_GATE.tick_minutes
    )
    return out


def _find(spark: SparkSession, home: str, run: int, since: datetime, until: datetime, jobs: dict[str, Rule]) -> list[tuple]:
    """Write the candidates of every rule; what goes wrong stays with its rule."""
    outcomes = []
    for name, job in jobs.items():
        seen, error, n = Observation(), None, 0
        try:
            found = job(spark, home, since, until).select("trigger", F.col("ts").cast("timestamp"), "severity", "id")
            fresh = found.filter((F.col("ts") >= F.lit(since)) & (F.col("ts") < F.lit(until)))
            counted = fresh.observe(seen, F.count(F.lit(1)).alias("n"))
            counted.write.mode("overwrite").parquet(f"{home}/candidates/run={run}/rule={name}")
            n = int(seen.get["n"])
        except Exception as exc:  # noqa: BLE001 - any failure becomes that rule's outcome
            error = f"{type(exc).__name__}: {exc}"
        outcomes.append((run, name, error is None, error, n))
    return outcomes


def watch_run(
    spark: SparkSession,
    home: str,
    run: int,
    since: datetime,
    until: datetime,
    jobs: dict[str, Rule],
    gate: Gate,
    subscriptions: DataFrame,
    mutes: DataFrame | None = None,
    levels: DataFrame | None = None,
) -> DataFrame:
    """Judge what came from `since` to `until` and return the outcome of each rule.

    Runs are numbered from 0 and follow each other without gaps, cut at ticks.
    `subscriptions` (subscriber, trigger) says who gets what; `levels` as for `level_runs`.
    """
    outcomes = _find(spark, home, run, since, until, jobs)
    offered = spark.createDataFrame([], f"subscriber bigint, {CANDIDATE}")
    done = [name for _, name, ok, _, _ in outcomes if ok]
    if done:
        found = spark.read.schema(CANDIDATE).parquet(*[f"{home}/candidates/run={run}/rule={n}" for n in done])
        offered = found.join(subscriptions.select("subscriber", "trigger").distinct(), "trigger")
    reach = max([gate.cooldown_hours, *gate.cooldowns.values()]) * 3600 + 86_400
    prior, hits, runs = None, None, None
    if exists(spark, f"{home}/alert_log"):
        first = F.to_date(F.timestamp_seconds(F.lit(_epoch(since) - int(reach) - 86_400)))
        prior = spark.read.parquet(f"{home}/alert_log").filter((F.col("day") >= first) & (F.col("run") < run))
        prior = prior.select("subscriber", "tick", "trigger")
    if run and exists(spark, f"{home}/level_hits/run={run - 1}"):
        hits = spark.read.parquet(f"{home}/level_hits/run={run - 1}")
    if levels is not None:
        stored = spark.read.parquet(f"{home}/readings").filter((F.col("ts") >= F.lit(since)) & (F.col("ts") < F.lit(until)))
        runs = level_runs(tick_series(stored, gate.tick_minutes), levels, gate)
    path = f"{home}/walked/run={run}"
    walked(offered, gate, mutes, prior, runs, hits).write.mode("overwrite").parquet(path)
    told = spark.read.parquet(path)
    fired = told.filter("what = 'fired'").drop("what", "mask", "reason", "cooled")
    day = local_day(F.timestamp_seconds("tick"), gate.tz)
    (
        fired.withColumns({"day": day, "run": F.lit(run)})
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("day", "run")
        .parquet(f"{home}/alert_log")
    )
    told.filter("what = 'hit'").select("subscriber", "series", "level", "mask").write.mode("overwrite").parquet(
        f"{home}/level_hits/run={run}"
    )
    return spark.createDataFrame(outcomes, RUNS)
