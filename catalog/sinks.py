"""Sink queries: write to a fresh table in the shared folder and read it back."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import functions as F

from catalog import alerts
from catalog.base import query
from catalog.tables import READINGS_SQL, PAGES_SQL, pages, readings
from tidemark.operators.headlines import tagged, upsert
from tidemark.plans.watch import move_watch, watch_run
from tidemark.rules import small_table
from tidemark.session import shared_folder
from tidemark.sources import sinks, versions


def _fresh(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query(
    "sink_append",
    f"WITH {READINGS_SQL} SELECT id, series, ts, value, CAST(ts AS DATE) AS event_date FROM r WHERE value >= 5",
)
def _append(spark, folder):
    path = _fresh(spark, "readings")
    r = readings(spark, folder).select("id", "series", "ts", F.when(F.col("value") >= 5, F.col("value")).alias("value"))
    sinks.append_readings(r.filter("id % 2 = 0"), path)
    sinks.append_readings(r.filter("id % 2 = 1"), path)
    return spark.read.parquet(path)


def _headlines(spark, folder):
    p = pages(spark, folder).select(
        F.col("site").alias("url"),
        "domain",
        F.concat(F.lit("feed"), (F.col("id") % 3).cast("string")).alias("source"),
        F.col("first_seen").alias("published_at"),
        "first_seen",
        "title",
        F.concat(F.lit("about "), "title").alias("summary"),
        F.col("id").alias("pos"),
        (F.col("id") % 3).alias("part"),
    )
    return tagged(p, F.col("title"), ("the", "and", "les", "und", "que"))


UPSERT_SQL = f"""WITH {PAGES_SQL}, b AS (SELECT site AS url, domain, 'feed' || (id % 3) AS source, first_seen AS published_at,
        first_seen, title, 'about ' || title AS summary, id % 3 AS gen, id,
        list_filter([{", ".join(f"CASE WHEN regexp_matches(lower(title), '(^|[^\\p{{L}}\\p{{N}}_]){k}($|[^\\p{{L}}\\p{{N}}_])') THEN '{k}' END" for k in ("the", "and", "les", "und", "que"))}],
          lambda x : x IS NOT NULL) AS kw FROM h)
    SELECT url, arg_min(domain, (gen, id)) AS domain, arg_min(source, (gen, id)) AS source,
      arg_min(published_at, (gen, id)) AS published_at, arg_min(first_seen, (gen, id)) AS first_seen,
      arg_max(title, (gen, id)) AS title, arg_max(summary, (gen, id)) AS summary,
      array_to_string(arg_max(kw, (gen, id)), ',') AS keywords FROM b GROUP BY 1"""


@query("headline_upsert", UPSERT_SQL)
def _upsert(spark, folder):
    path = _fresh(spark, "headlines")
    h = _headlines(spark, folder)
    for part in range(3):
        sinks.upsert_headlines(spark, path, h.filter(F.col("part") == part).drop("part"))
    return sinks.headlines(spark, path).withColumn("keywords", F.array_join("keywords", ","))


@query("headline_compacted", UPSERT_SQL)
def _compacted(spark, folder):
    """The same batches with compactions after the first and the second, and a repeated one."""
    path = _fresh(spark, "headlines")
    h = _headlines(spark, folder)
    for part in range(3):
        batch = h.filter(F.col("part") == part).drop("part")
        sinks.upsert_headlines(spark, path, batch, version=part)
        if part < 2:
            sinks.compact_headlines(spark, path, bucket_rows=50)
            versions.vacuum(spark, path)
        sinks.upsert_headlines(spark, path, batch, version=part)
    return sinks.headlines(spark, path).withColumn("keywords", F.array_join("keywords", ","))


@query(
    "headlines_since",
    f"""WITH {PAGES_SQL} SELECT site AS url, arg_min(first_seen, (id % 3, id)) AS first_seen FROM h GROUP BY 1
    HAVING arg_min(first_seen, (id % 3, id)) >= TIMESTAMP '2024-01-01 06:00:00'""",
)
def _since(spark, folder):
    """Urls first stored from a day on, though batches come out of order."""
    path = _fresh(spark, "headlines")
    h = _headlines(spark, folder)
    for part in range(3):
        sinks.upsert_headlines(spark, path, h.filter(F.col("part") == part).drop("part"))
    sinks.compact_headlines(spark, path)
    return sinks.headlines(spark, path, datetime(2024, 1, 1, 6)).select("url", "first_seen")


@query(
    "upsert_new",
    f"""WITH {PAGES_SQL} SELECT DISTINCT site AS url FROM h n WHERE id % 3 > 0
    AND NOT EXISTS (SELECT 1 FROM h o WHERE o.id % 3 = 0 AND o.site = n.site)""",
)
def _upsert_new(spark, folder):
    h = _headlines(spark, folder)
    merged = upsert(h.filter("part = 0"), h.filter("part > 0"))
    return merged.filter("is_new").select("url")


LATEST = "user_id bigint, ts timestamp, event_type string, value double"


@query(
    "latest_by_key",
    """SELECT user_id, max(ts) AS ts, arg_max(event_type, ts) AS event_type, arg_max(value, ts) AS value
    FROM events GROUP BY 1""",
)
def _latest_by_key(spark, folder):
    path = _fresh(spark, "latest")
    r = readings(spark, folder).select(
        F.substring("source", 2, 20).cast("bigint").alias("user_id"), "ts", F.col("series").alias("event_type"), "value", "id"
    )
    for part in range(2):
        sinks.replace_latest(spark, path, r.filter(F.col("id") % 2 == part).drop("id"), "user_id", "ts")
        if part == 0:
            sinks.compact_latest(spark, path, LATEST, "user_id", "ts")
    return sinks.latest(spark, path, LATEST, "user_id", "ts")


CUTOFF = datetime(2024, 1, 10, 9, 30)
LAST_OF_DAY = datetime(2024, 1, 8, 23, 59, 59, 999999)


@query(
    "retention_prune",
    f"WITH {READINGS_SQL} SELECT id, series, ts, value, CAST(ts AS DATE) AS event_date FROM r WHERE ts >= TIMESTAMP '2024-01-10 09:30:00'",
)
def _prune(spark, folder):
    path = _fresh(spark, "readings")
    sinks.append_readings(readings(spark, folder).select("id", "series", "ts", "value"), path)
    sinks.prune(spark, path, LAST_OF_DAY)  # past the last row of its own date
    sinks.prune(spark, path, CUTOFF)
    return spark.read.parquet(path)


SPLIT, START, END = datetime(2024, 1, 15, 10), datetime(2024, 1, 1), datetime(2024, 3, 1)


@query(
    "watch_run",
    alerts.gate_sql(3, True, alerts.WATCH_SQL, alerts.MOVE_TRIGGERS)
    + """SELECT p.id, p.subscriber, p.trigger, p.tick FROM p JOIN walk w ON w.id = p.id AND w.subscriber = p.subscriber
      WHERE w.o = 'fired'""",
)
def _watch_run(spark, folder):
    """Two runs over successive halves of the events give what one run over all gives."""
    home = _fresh(spark, "watch")
    r = readings(spark, folder).select("id", "series", "ts", "value")
    rules = [x for x in alerts.RULES if x.enabled]
    jobs = {x.trigger: move_watch(x, alerts.MOVE_TRIGGERS.index(x.trigger), 8) for x in rules}
    who = small_table(spark, alerts.SUBSCRIPTIONS, "subscriber bigint, trigger string")
    for run, (a, b) in enumerate([(START, SPLIT), (SPLIT, END)]):
        sinks.append_readings(r.filter((F.col("ts") >= F.lit(a)) & (F.col("ts") < F.lit(b))), f"{home}/readings")
        watch_run(spark, home, run, a, b, jobs, alerts.WATCH_GATE, who, alerts.mutes(spark))
    log = spark.read.parquet(f"{home}/alert_log")
    return log.select("id", "subscriber", "trigger", F.timestamp_seconds("tick").alias("tick"))
