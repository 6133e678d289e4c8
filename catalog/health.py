"""Freshness, completeness and run decisions. A run is a day, a source is an event
type with a quarter of the users; spikes stand for failures."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import query
from catalog.tables import NOW, READINGS_SQL, TZ, readings, table
from tidemark.operators.health import (
    data_gaps,
    notes_of,
    previous_brief,
    quiet_since,
    source_health,
    staleness,
)
from tidemark.plans.scan import run_decision
from tidemark.rules import small_table

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
)
MIN_DATA = 14
BUDGETS = [("click", "price", 6.0), ("view", "fx", 12.0), ("signup", "macro", 48.0), ("purchase", "news", 4.0)]
RUNS_SQL = """runs AS (SELECT strftime(ts, '%Y-%m-%d') AS run_id, event_type || '-' || (user_id % 4) AS source,
  max(value) <= 200 AS ok, CASE WHEN max(value) > 200 THEN 'spike' END AS error,
  count(*) FILTER (value >= 100) AS n_readings, 0 AS n_headlines, count(*) FILTER (value < 1) AS n_notes
  FROM events GROUP BY 1, 2)"""
HEALTH_SQL = f"""{RUNS_SQL}, o AS (SELECT *, ok AND n_readings > 0 AS data FROM runs),
hl AS (SELECT run_id, count(*) AS sources, count(*) FILTER (ok) AS ok_count, count(*) FILTER (data) AS data_count,
  coalesce(string_agg(source, ', ' ORDER BY source) FILTER (NOT ok), '') AS failed,
  coalesce(string_agg(source, ', ' ORDER BY source) FILTER (ok AND NOT data), '') AS empty,
  coalesce(string_agg(source, ', ' ORDER BY source) FILTER (data), '') AS with_data,
  count(*) FILTER (data) < {MIN_DATA} AS degraded FROM o GROUP BY 1)"""
STALE_SQL = """st AS (SELECT source, category, newest, budget_hours,
    date_diff('microsecond', newest, TIMESTAMP '2024-01-31 00:00:00') / 3.6e9::DOUBLE AS age_hours
  FROM (SELECT event_type || '-' || user_id AS source, event_type, max(ts) AS newest FROM events GROUP BY 1, 2)
  JOIN (VALUES ('click', 'price', 6.0::DOUBLE), ('view', 'fx', 12.0), ('signup', 'macro', 48.0), ('purchase', 'news', 4.0))
    b(event_type, category, budget_hours) USING (event_type))"""


def runs(spark, folder):
    return (
        table(spark, folder, "events")
        .groupBy(
            F.date_format("ts", "yyyy-MM-dd").alias("run_id"),
            F.concat_ws("-", "event_type", (F.col("user_id") % 4).cast("string")).alias("source"),
        )
        .agg(
            (F.max("value") <= 200).alias("ok"),
            F.when(F.max("value") > 200, F.lit("spike")).alias("error"),
            F.count_if(F.col("value") >= 100).alias("n_readings"),
            F.lit(0).cast("bigint").alias("n_headlines"),
            F.count_if(F.col("value") < 1).alias("n_notes"),
        )
    )


def stale(spark, folder):
    """Every user of an event type is a source in the category of that type."""
    r = table(spark, folder, "events").select(
        F.concat_ws("-", "event_type", "user_id").alias("source"),
        F.col("event_type").alias("kind"),
        F.col("ts").cast("timestamp").alias("ts"),
        "value",
    )
    kinds = small_table(spark, [(k, c) for k, c, _ in BUDGETS], "kind string, category string")
    categories = r.select("source", "kind").distinct().join(kinds, "kind").drop("kind")
    budgets = small_table(spark, [(c, h) for _, c, h in BUDGETS], "category string, budget_hours double")
    return staleness(r, categories, budgets, NOW)


@query("source_health", f"WITH {HEALTH_SQL} SELECT * FROM hl")
def _health(spark, folder):
    return source_health(runs(spark, folder), MIN_DATA)


@query("staleness", f"WITH {STALE_SQL} SELECT source, category, newest, round(age_hours, 4) AS age_hours, budget_hours FROM st WHERE age_hours > budget_hours")
def _stale(spark, folder):
    return stale(spark, folder).withColumn("age_hours", F.round("age_hours", 4))


RUN = "2024-01-20"


@query(
    "data_gaps",
    f"""WITH {RUNS_SQL}, {STALE_SQL}
    SELECT 'failed' AS kind, source, error AS detail FROM runs WHERE run_id = '{RUN}' AND NOT ok
    UNION ALL SELECT 'stale', source, format('last value {{:.1f}} hours ago, allowed are {{:.0f}}',
      age_hours, budget_hours) FROM st WHERE age_hours > budget_hours""",
)
def _gaps(spark, folder):
    return data_gaps(runs(spark, folder), stale(spark, folder), RUN)


@query(
    "run_notes",
    f"""WITH {RUNS_SQL} SELECT run_id, source, n_notes || ' tiny values' AS note FROM runs WHERE n_notes > 0
    UNION ALL SELECT run_id, source, 'no data: spike' FROM runs WHERE NOT ok""",
)
def _notes(spark, folder):
    r = runs(spark, folder)
    notes = r.filter("n_notes > 0").select("run_id", "source", F.concat(F.col("n_notes").cast("string"), F.lit(" tiny values")).alias("note"))
    return notes_of(r, notes)


def morning_briefs(spark, folder):
    """07:30 local on every day with an event, but not on every fourth one."""
    days = table(spark, folder, "events").select(F.to_date("ts").alias("day")).distinct()
    at = F.timestamp_seconds(F.unix_seconds(F.col("day").cast("timestamp")) + 2 * 3600)
    return days.filter(F.dayofmonth("day") % 4 != 0).select(F.lit("morning").alias("mode"), at.alias("ts"))


def evening_runs(spark, folder):
    days = table(spark, folder, "events").select(F.to_date("ts").alias("day")).distinct()
    at = F.timestamp_seconds(F.unix_seconds(F.col("day").cast("timestamp")) + 13 * 3600)
    return days.select(F.date_format("day", "yyyy-MM-dd").alias("run_id"), at.alias("ts"))


QUIET_SQL = f"""{READINGS_SQL},
dy AS (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events),
br AS (SELECT day + INTERVAL 2 HOUR AS bts FROM dy WHERE extract(day FROM day) % 4 <> 0),
ev AS (SELECT strftime(day, '%Y-%m-%d') AS run_id, day + INTERVAL 13 HOUR AS ts FROM dy),
e2 AS (SELECT ev.*, bts FROM ev ASOF LEFT JOIN br ON ev.ts >= br.bts),
e3 AS (SELECT run_id, ts, bts, CASE WHEN bts > ts - INTERVAL 1 HOUR THEN ts - INTERVAL 1 HOUR
    ELSE coalesce(bts, ts - INTERVAL 1 HOUR) END AS cutoff, series FROM e2, (VALUES ('click'), ('view'), ('purchase')) s(series)),
e4 AS (SELECT e3.*, r.value AS cur FROM e3 ASOF LEFT JOIN r ON e3.series = r.series AND e3.ts >= r.ts),
fr AS (SELECT series, arg_min(value, ts) AS value FROM r GROUP BY 1),
e5 AS (SELECT e4.*, coalesce(r.value, fr.value) AS base FROM e4 ASOF LEFT JOIN r ON e4.series = r.series AND e4.cutoff >= r.ts
  LEFT JOIN fr ON fr.series = e4.series),
qs AS (SELECT run_id, ts, bool_and(coalesce(bts IS NOT NULL AND abs((cur / nullif(base, 0) - 1) * 100) < 70, false)) AS quiet
  FROM e5 GROUP BY 1, 2)"""


@query("quiet_since", f"WITH {QUIET_SQL} SELECT run_id, ts, quiet FROM qs")
def _quiet(spark, folder):
    return quiet_since(
        evening_runs(spark, folder), morning_briefs(spark, folder), readings(spark, folder),
        ["click", "view", "purchase"], 70.0,
    )


SCHEDULE = [
    ("morning", True, ["mon", "tue", "wed", "thu", "fri"], False),
    ("evening", True, ["mon", "tue", "wed", "thu", "fri", "sat", "sun"], True),
    ("weekly", True, ["sun"], False),
    ("noon", False, ["mon"], False),
]


def planned_runs(spark, folder):
    """The four modes of each day with an event; the evening ones are those of `evening_runs`."""
    hours = {"morning": 2, "evening": 13, "weekly": 4, "noon": 7}
    days = table(spark, folder, "events").select(F.to_date("ts").alias("day")).distinct()
    modes = [F.struct(F.lit(m).alias("mode"), F.lit(h * 3600).alias("s")) for m, h in hours.items()]
    return days.select("day", F.inline(F.array(*modes))).select(
        F.date_format("day", "yyyy-MM-dd").alias("run_id"),
        "mode",
        F.timestamp_seconds(F.unix_seconds(F.col("day").cast("timestamp")) + F.col("s")).alias("ts"),
    )


@query(
    "run_decision",
    f"""WITH {HEALTH_SQL}, {QUIET_SQL},
    sc(mode, h, enabled, days, changed) AS (VALUES ('morning', 2, true, ['Mon', 'Tue', 'Wed', 'Thu', 'Fri'], false),
      ('evening', 13, true, ['Mon', 'Tue', 'Wed', 'Thu', 'Fri', 'Sat', 'Sun'], true), ('weekly', 4, true, ['Sun'], false),
      ('noon', 7, false, ['Mon'], false)),
    pr AS (SELECT strftime(day, '%Y-%m-%d') AS run_id, sc.*, day + to_hours(h) AS ts FROM dy, sc),
    pq AS (SELECT pr.*, data_count, degraded, coalesce(quiet, false) AND mode = 'evening' AS q
      FROM pr LEFT JOIN hl USING (run_id) LEFT JOIN qs USING (run_id))
    SELECT run_id, mode, coalesce(data_count, 0) AS data_count, q AS quiet, CASE WHEN NOT enabled THEN 'off'
      WHEN NOT list_contains(days, strftime(ts + INTERVAL 330 MINUTE, '%a')) THEN 'not_scheduled'
      WHEN coalesce(degraded, true) THEN 'degraded' WHEN changed AND q THEN 'skip' ELSE 'brief' END AS decision FROM pq""",
)
def _decision(spark, folder):
    quiet = quiet_since(
        evening_runs(spark, folder), morning_briefs(spark, folder), readings(spark, folder),
        ["click", "view", "purchase"], 70.0,
    ).withColumn("mode", F.lit("evening"))
    schedule = small_table(spark, SCHEDULE, "mode string, enabled boolean, days array<string>, only_if_changed boolean")
    return run_decision(planned_runs(spark, folder), source_health(runs(spark, folder), MIN_DATA), quiet, schedule, TZ)


def briefs(spark, folder):
    """Turns as briefs: user ones are morning, assistant ones evening, system ones alerts."""
    mode = F.when(F.col("role") == "user", "morning").when(F.col("role") == "assistant", "evening").otherwise("alert")
    at = F.timestamp_seconds(F.lit(1_704_067_200) + F.col("conv_id") * 3600 + F.col("turn") * 60)
    return table(spark, folder, "conversations").select(
        (F.col("conv_id") % 20).alias("subscriber"), mode.alias("mode"), at.alias("ts"), "text"
    )


BRIEFS_SQL = """b AS (SELECT conv_id % 20 AS subscriber, CASE role WHEN 'user' THEN 'morning'
  WHEN 'assistant' THEN 'evening' ELSE 'alert' END AS mode,
  TIMESTAMP '2024-01-01' + to_hours(CAST(conv_id AS INTEGER)) + to_minutes(CAST(turn AS INTEGER)) AS ts, text FROM conversations)"""


@query(
    "previous_brief",
    f"""WITH {BRIEFS_SQL} SELECT x.subscriber, x.mode, x.ts, y.mode AS previous_mode, y.ts AS previous_ts
    FROM b x ASOF LEFT JOIN (SELECT * FROM b WHERE mode <> 'alert') y ON x.subscriber = y.subscriber AND x.ts > y.ts""",
)
def _previous(spark, folder):
    return previous_brief(briefs(spark, folder).drop("text"))


@query("table_counts", " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in TABLES))
def _counts(spark, folder):
    out = None
    for name in TABLES:
        part = table(spark, folder, name).agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "unify_sources",
    """SELECT event_id AS id, event_type AS series, ts, value, 'pt' AS unit, NULL::VARCHAR AS note FROM events
    UNION ALL SELECT o_orderkey, 'order_' || o_orderstatus, o_orderdate, o_totalprice, NULL, o_orderpriority FROM orders""",
)
def _unify(spark, folder):
    e = readings(spark, folder).select("id", "series", "ts", "value", "unit")
    o = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.concat(F.lit("order_"), "o_orderstatus").alias("series"),
        F.col("o_orderdate").cast("timestamp").alias("ts"),
        F.col("o_totalprice").alias("value"),
        F.col("o_orderpriority").alias("note"),
    )
    return e.unionByName(o, allowMissingColumns=True)
