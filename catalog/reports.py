"""Composite queries: the full trigger scan, brief facts and the two price reports."""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import functions as F

from catalog import alerts, derive, health
from catalog.base import query
from catalog.tables import DAILY_SQL, NOW, PAGES_SQL, READINGS_SQL, TZ, articles, pages, readings, table
from tidemark.operators import headlines
from tidemark.operators.health import data_gaps, last_brief
from tidemark.operators.levels import level_crossings, level_distance, level_union, levels_hit
from tidemark.operators.series import (
    basis_point_change,
    daily_series,
    extremes,
    flow_delta,
    latest_reading,
    net_position,
    session_change,
    since,
    tick_series,
    trend,
)
from tidemark.operators.triggers import conflict_events, conflict_pairs, move_candidates
from tidemark.plans.brief import brief_facts, headline_facts, levels_report, now_report, reading_facts
from tidemark.plans.derived import calendar_horizon, derive_columns
from tidemark.plans.scan import trigger_scan
from tidemark.rules import move_rule_table, small_table


CROSSINGS_SQL = alerts.REGISTRY_SQL["level_crossings"]
SCAN_SQL = f"""WITH RECURSIVE mv AS ({alerts.MOVES_SQL} SELECT * FROM c),
cf AS ({alerts.CONFLICT_SQL} SELECT tick, dc, domains, keywords FROM m JOIN z USING (tick) WHERE dc >= 3 AND kc >= 2),
cr AS ({CROSSINGS_SQL})
SELECT trigger, series, ts, round(abs(move) / threshold, 6) AS severity, series || ' ' || format('{{:+.3f}}', move)
  || CASE trigger WHEN 'click_move' THEN '%' WHEN 'signup_move' THEN 'bp' WHEN 'purchase_move' THEN 'pp' ELSE '' END
  || ' from ' || format('{{:,.2f}}', baseline) || ' to ' || format('{{:,.2f}}', current) AS summary FROM mv
UNION ALL SELECT 'conflict_escalation', 'news', tick, round(dc / 3, 6),
  dc || ' sources: ' || domains || '; keywords: ' || keywords FROM cf
UNION ALL SELECT 'inr_price_levels', series, ts, 10.0, 'crossed ' || direction || ' ' || format('{{:,.2f}}', level)
  || ': now ' || format('{{:,.2f}}', price) FROM cr"""


@query("trigger_scan", SCAN_SQL)
def _scan(spark, folder):
    r = readings(spark, folder)
    moves = move_candidates(r, move_rule_table(spark, alerts.RULES))
    pairs = conflict_pairs(
        articles(spark, folder), F.col("text"), alerts.KEYWORDS, alerts.DOMAINS, alerts.CONFLICT, 30
    )
    ticks = tick_series(r.filter(F.col("series").isin("click", "view")), 30)
    crossings = level_crossings(ticks, alerts.top_levels(spark, folder))
    out = trigger_scan(
        moves, conflict_events(pairs, alerts.CONFLICT), crossings, alerts.CONFLICT
    )
    return out.withColumn("severity", F.round("severity", 6))


ORDER = [("view", 1, "Views"), ("click", 2, "Clicks"), ("purchase", 3, "Purchases")]


@query(
    "brief_facts",
    f"""WITH {READINGS_SQL}, {DAILY_SQL}, {PAGES_SQL}, {health.RUNS_SQL}, {health.STALE_SQL}, {health.BRIEFS_SQL},
    lt AS (SELECT series, arg_max(value, ts) AS value, arg_max(source, ts) AS source FROM r GROUP BY 1),
    ch AS (SELECT series, day, (value / nullif(lag(value) OVER (PARTITION BY series ORDER BY day), 0) - 1) * 100 AS c FROM d),
    lc AS (SELECT series, arg_max(c, day) AS c FROM ch GROUP BY 1),
    lg AS (SELECT series, day, value, lag(value) OVER (PARTITION BY series ORDER BY day) AS p FROM d),
    bp AS (SELECT series, arg_max(round((value - p) * 100, 2), day) FILTER (p IS NOT NULL) AS bp FROM lg WHERE series = 'signup' GROUP BY 1),
    dl AS (SELECT series, arg_max(round(value - p, 2), day) FILTER (p IS NOT NULL) AS delta FROM lg WHERE series = 'error' GROUP BY 1),
    wl AS (SELECT series, day, value - lag(value) OVER (PARTITION BY series ORDER BY day) AS w FROM d
      WHERE series = 'purchase' AND isodow(day) = 1),
    wc AS (SELECT series, arg_max(w, day) FILTER (w IS NOT NULL) AS w, max(day) AS observed FROM wl GROUP BY 1),
    o(series, place, label) AS (VALUES ('view', 1, 'Views'), ('click', 2, 'Clicks'), ('purchase', 3, 'Purchases')),
    rd AS (SELECT 'readings' AS section, coalesce(place, 1000000) AS ord, series AS key,
      '- ' || coalesce(label, series) || ': ' || format('{{:,.2f}}', value) || ' pt' ||
      coalesce(format(' (session {{:+.2f}}%)', c), '') || coalesce(format(' ({{:+.1f}}bp vs prior print)', bp), '') ||
      coalesce(format(' (delta {{:+.2f}}t)', delta), '') || coalesce(' (week ' || CASE WHEN w >= 0 THEN '+' ELSE '' END || format('{{:,.0f}})', w), '') || ', source: ' || source ||
      coalesce(' [observation date ' || observed || ']', '') || CASE series WHEN 'purchase' THEN ' [caveat: weekly]' ELSE '' END AS text
      FROM lt LEFT JOIN o USING (series) LEFT JOIN lc USING (series) LEFT JOIN bp USING (series) LEFT JOIN dl USING (series)
      LEFT JOIN wc USING (series)),
    tb AS (SELECT series, round((arg_max(value, day) / arg_min(value, day) - 1) * 100, 2) AS dir,
      string_agg(strftime(day, '%m-%d') || ' ' || format('{{:,.2f}}', value), ' | ' ORDER BY day) AS rendered
      FROM d WHERE ts >= TIMESTAMP '2024-01-24' GROUP BY 1 HAVING count(*) >= 2),
    mk AS (SELECT id, domain, title, url, NOT EXISTS (SELECT 1 FROM h o WHERE o.id % 2 = 0 AND o.site = n.site) AS is_new
      FROM h n WHERE id % 2 = 1),
    tk AS (SELECT *, row_number() OVER (PARTITION BY is_new ORDER BY id) AS rank FROM mk
      QUALIFY rank <= CASE WHEN is_new THEN 25 ELSE 10 END),
    gp AS (SELECT 'failed' AS kind, source, error AS detail FROM runs WHERE run_id = '2024-01-20' AND NOT ok
      UNION ALL SELECT 'stale', source, format('last value {{:.1f}} hours ago, allowed are {{:.0f}}',
      age_hours, budget_hours) FROM st WHERE age_hours > budget_hours),
    lb AS (SELECT *, date_diff('microsecond', ts, TIMESTAMP '2024-01-31') / 3.6e9::DOUBLE AS age FROM b WHERE mode <> 'alert'
      QUALIFY row_number() OVER (PARTITION BY subscriber ORDER BY ts DESC, text DESC NULLS LAST, mode DESC) = 1),
    hc AS (SELECT count(*) FILTER (is_new) AS n, count(*) FILTER (NOT is_new) AS k FROM mk),
    cal AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day, o_orderpriority AS name, o_orderstatus AS source FROM orders
      WHERE o_orderdate BETWEEN DATE '1998-03-01' AND DATE '1998-03-08'),
    nt AS (SELECT source, n_notes || ' tiny values' AS note FROM runs WHERE n_notes > 0 AND run_id = '2024-01-20'
      UNION ALL SELECT source, 'no data: spike' FROM runs WHERE NOT ok AND run_id = '2024-01-20')
    SELECT section, CAST(ord AS INTEGER) AS ord, key, text FROM (SELECT * FROM rd
    UNION ALL SELECT 'trend', 0, series, '- ' || series || ': ' || rendered || ' -> '
      || format('{{:+.2f}}', dir) || '% over the window' FROM tb
    UNION ALL SELECT CASE WHEN is_new THEN 'headlines_new' ELSE 'headlines_known' END,
      rank, CAST(id AS VARCHAR), '- [' || domain || '] ' || title || CASE WHEN is_new THEN ' (' || url || ')' ELSE '' END FROM tk
    UNION ALL SELECT 'headlines_new', 0, '', 'new since the last run: ' || CASE n WHEN 0 THEN 'none' ELSE CAST(n AS VARCHAR) END FROM hc
    UNION ALL SELECT 'headlines_known', 0, '', 'seen in an earlier run: ' || k FROM hc WHERE k > 0
    UNION ALL SELECT 'notes', 0, source, '- ' || source || ': ' || note FROM nt
    UNION ALL SELECT 'calendar', CAST(day - DATE '1998-03-01' AS INTEGER), concat_ws(' ', day, name, source),
      '- ' || name || ': ' || day || ' (in ' || CAST(day - DATE '1998-03-01' AS INTEGER) || 'd), source: ' || source FROM cal
    UNION ALL SELECT 'gaps', 0, source, '- ' || source || ': ' || detail FROM gp
    UNION ALL SELECT 'previous', 0, CAST(subscriber AS VARCHAR), CASE WHEN trim(coalesce(text, '')) = '' THEN '- none on record'
      ELSE '- ' || mode || ', ' || CASE WHEN age < 1 THEN CAST(floor(age * 60) AS INTEGER) || 'm' WHEN age < 48 THEN format('{{:.0f}}h', age)
        ELSE format('{{:.0f}}d', age / 24) END || ' ago: ' || trim(text) END FROM lb)""",
)
def _facts(spark, folder):
    r = readings(spark, folder)
    daily = daily_series(r, TZ)
    newest = lambda df, c: df.filter(F.col(c).isNotNull()).groupBy("series").agg(F.max_by(c, "day").alias(c))
    # Mondays stand for weekly reports.
    weekly = daily.filter((F.col("series") == "purchase") & (F.dayofweek("day") == 2))
    reports = net_position(weekly.select("series", "day", F.col("value").alias("long"), F.lit(0.0).alias("short")))
    observed = reports.groupBy("series").agg(F.max("day").cast("string").alias("observed"), F.lit("weekly").alias("caveat"))
    changes = session_change(daily).groupBy("series").agg(F.max_by("change_pct", "day").alias("change_pct"))
    more = (
        newest(basis_point_change(daily.filter("series = 'signup'")), "change_bp"),
        newest(flow_delta(daily.filter("series = 'error'")), "delta"),
        newest(reports, "week_change"),
        observed,
    )
    # One aggregate puts the fields of a series together, in place of a join for each.
    changes = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), more, changes)
    changes = changes.groupBy("series").agg(*[F.max(c).alias(c) for c in changes.columns if c != "series"])
    order = small_table(spark, ORDER, "series string, place int, label string")
    latest = latest_reading(r).withColumn("unit", F.lit("pt"))
    p = pages(spark, folder).select("id", "site", "domain", "title", "url")
    marked = headlines.mark_new(p.filter("id % 2 = 1"), p.filter("id % 2 = 0"), "site")
    trends = trend(since(daily, NOW, 7)).withColumn("direction_pct", F.round("direction_pct", 2))
    gaps = data_gaps(health.runs(spark, folder), health.stale(spark, folder), "2024-01-20")
    events = table(spark, folder, "orders").select(
        F.to_date("o_orderdate").alias("day"), F.col("o_orderpriority").alias("name"), F.col("o_orderstatus").alias("source")
    )
    notes = health._notes(spark, folder).filter("run_id = '2024-01-20'").select("source", "note")
    return brief_facts(
        reading_facts(latest, changes, order),
        trends,
        headline_facts(marked),
        gaps,
        last_brief(health.briefs(spark, folder)),
        calendar_horizon(events, date(1998, 3, 1)),
        notes,
        NOW,
    )


@query(
    "levels_report",
    f"""WITH RECURSIVE {READINGS_SQL}, {DAILY_SQL},
    lt AS (SELECT series, arg_max(value, ts) AS value FROM r GROUP BY 1),
    un AS ({alerts.REGISTRY_SQL["level_union"]}),
    wk AS ({alerts.level_walk_sql("SELECT 'click' AS series, value AS level, direction FROM un")} SELECT * FROM w),
    hit AS (SELECT level, direction FROM wk QUALIFY row_number() OVER (PARTITION BY level, direction ORDER BY n DESC) = 1
      AND (a OR b))
    SELECT NULL::BIGINT AS subscriber, 'price' AS section, series AS key, value AS low, value AS high, '' AS note, '' AS origin, false AS hit FROM lt
    UNION ALL SELECT NULL, 'range', series || ' ' || n.n || 'd', min(value), max(value), '', '', false
      FROM d, (VALUES (7), (30)) n(n) WHERE d.ts >= TIMESTAMP '2024-01-31 00:00:00' - to_days(n.n)
      GROUP BY series, n.n HAVING count(*) >= 2
    UNION ALL SELECT NULL, 'round', series, v, v, '', '', false FROM (SELECT series, round_even(value / 50.0, 0) * 50.0 + k * 50.0::DOUBLE AS v
      FROM lt, range(-3, 4) t(k)) WHERE v > 0
    UNION ALL SELECT un.subscriber, 'own', un.direction, un.value,
      round((un.value / (SELECT value FROM lt WHERE series = 'click') - 1) * 100, 4),
      coalesce(un.note, ''), un.origin, hit.level IS NOT NULL
      FROM un LEFT JOIN hit ON hit.direction = un.direction AND hit.level = un.value""",
)
def _levels_report(spark, folder):
    r = readings(spark, folder)
    latest = latest_reading(r)
    configured = small_table(spark, alerts.WATCHED, alerts.LEVEL_COLS)
    levels = level_union(configured, alerts._user_levels(spark, folder)).withColumn("series", F.lit("click"))
    ticks = tick_series(r.filter("series = 'click'"), 30)
    hits = levels_hit(ticks, levels)
    return levels_report(latest, extremes(daily_series(r, TZ), NOW), level_distance(levels, latest), hits, 50)


@query(
    "now_report",
    derive.ALIGNED_SQL
    + """, nw AS (SELECT * FROM x ORDER BY ts DESC LIMIT 1)
    SELECT * FROM (SELECT ts, 1 AS ord, 'gold' AS leg, gold AS value, round(spot_change, 4) AS change_pct,
      CASE WHEN cross_wide THEN cross_note END AS note FROM nw
    UNION ALL SELECT ts, 2, 'landed', landed, NULL, NULL FROM nw UNION ALL SELECT ts, 3, 'ex_tax', ex_tax, NULL, NULL FROM nw
    UNION ALL SELECT ts, 4, 'fx', fx, round(fx_change, 4), NULL FROM nw
    UNION ALL SELECT ts, 5, 'ratio', ratio, NULL, NULL FROM nw) WHERE value <> 0""",
)
def _now(spark, folder):
    return now_report(derive_columns(derive.aligned(spark, folder), derive.TAX))


@query(
    "recent_alerts",
    alerts.gate_sql(3, True)
    + """SELECT p.id, p.subscriber, p.trigger, p.tick FROM p JOIN walk w ON w.id = p.id
    WHERE w.o = 'fired' AND p.tick >= TIMESTAMP '2024-01-30 00:00:00'""",
)
def _recent_alerts(spark, folder):
    out = alerts.alert_gate(alerts.candidates(spark, folder), alerts.GATE, alerts.mutes(spark))
    fired = out.filter("outcome = 'fired'").select("id", "subscriber", "trigger", "tick")
    return headlines.recent(fired, NOW, 24, "tick")
