"""Trigger and gate queries. Subscribers are users; candidates are large values."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from catalog.base import REGISTRY, query
from catalog.tables import ARTICLES_SQL, READINGS_SQL, TZ, articles, readings, table
from tidemark.functions.money import cached_call_usd
from tidemark.operators import control, filters, ledger
from tidemark.operators.gate import alert_gate, alerts_per_day, cooldown_only, gated_fires
from tidemark.operators.levels import level_crossings, level_distance, level_runs, level_union
from tidemark.operators.series import latest_reading, tick_series
from tidemark.operators.triggers import conflict_events, conflict_pairs, move_candidates, severity_rank
from tidemark.plans.scan import watch
from tidemark.rules import ConflictRule, Gate, MoveRule, Prices, move_rule_table, small_table

RULES = (
    MoveRule("click_move", "click", "pct", 4, 150.0),
    MoveRule("view_move", "view", "abs", 24, 120.0),
    MoveRule("signup_move", "signup", "bp", 24, 15000.0),
    MoveRule("purchase_move", "purchase", "pp", 24, 140.0),
    MoveRule("error_move", "error", "abs", 4, 10.0, enabled=False),
)
GATE = Gate(cooldowns={"click": 6, "view": 6, "purchase": 12, "error": 12})
CONFLICT = ConflictRule()
KEYWORDS = ("strike", "the", "les", "und", "que", "not", "avec", "nicht", "of the")
DOMAINS = tuple(f"src{i}" for i in range(10))

MOVES_SQL = f"""WITH {READINGS_SQL},
u(trigger, series, kind, w, threshold, digits) AS (VALUES
  ('click_move', 'click', 'pct', 4, 150.0::DOUBLE, 3), ('view_move', 'view', 'abs', 24, 120.0, 3),
  ('signup_move', 'signup', 'bp', 24, 15000.0, 2), ('purchase_move', 'purchase', 'pp', 24, 140.0, 2)),
p AS (SELECT u.*, r.id, r.ts, r.value, r.ts - to_hours(w) AS cutoff FROM r JOIN u USING (series)),
b AS (SELECT p.*, coalesce(x.value, f.value) AS base, coalesce(x.ts, f.ts) AS baseline_ts
  FROM p ASOF LEFT JOIN r x ON p.series = x.series AND p.cutoff >= x.ts
  LEFT JOIN (SELECT series, min(ts) AS ts, arg_min(value, ts) AS value FROM r GROUP BY 1) f
    ON f.series = p.series),
m AS (SELECT *, CASE kind WHEN 'pct' THEN (value / nullif(base, 0) - 1) * 100
  WHEN 'bp' THEN (value - base) * 100 ELSE value - base END AS raw FROM b),
c AS (SELECT trigger, series, kind, ts, id, value AS current, base AS baseline, baseline_ts,
  CASE digits WHEN 3 THEN round(raw, 3) ELSE round(raw, 2) END AS move, threshold FROM m
  WHERE abs(raw) >= threshold)
"""
CANDIDATES_SQL = """WITH RECURSIVE c AS (
  SELECT event_id AS id, user_id AS subscriber, event_type AS trigger, ts, value / 60 AS severity,
    time_bucket(INTERVAL 30 MINUTE, ts) AS tick,
    CASE event_type WHEN 'click' THEN 360 WHEN 'view' THEN 360 WHEN 'purchase' THEN 720
      WHEN 'error' THEN 720 ELSE 360 END AS cool FROM events WHERE value >= 60)"""


def candidates(spark, folder):
    return (
        table(spark, folder, "events")
        .filter("value >= 60")
        .select(
            F.col("event_id").alias("id"),
            F.col("user_id").alias("subscriber"),
            F.col("event_type").alias("trigger"),
            F.col("ts").cast("timestamp").alias("ts"),
            (F.col("value") / 60).alias("severity"),
        )
    )


def mutes(spark):
    rows = [
        (u, datetime(2024, 1, 3 + u, 5, 10), datetime(2024, 1, 4 + u, 5, 0)) for u in range(12)
    ]
    return small_table(spark, rows, "subscriber bigint, from_ts timestamp, until_ts timestamp")


MUTES_SQL = """(SELECT u AS subscriber, TIMESTAMP '2024-01-03 05:10:00' + to_days(CAST(u AS INTEGER)) AS a,
  TIMESTAMP '2024-01-04 05:00:00' + to_days(CAST(u AS INTEGER)) AS b FROM range(12) t(u))"""


EVENT_TRIGGERS = ("click", "view", "purchase", "error", "signup")


def gate_sql(budget: int, filtered: bool, source: str = CANDIDATES_SQL, names: tuple[str, ...] = EVENT_TRIGGERS) -> str:
    """The gate as a recursive walk over each subscriber's candidates."""
    last = "CASE i.trigger " + " ".join(f"WHEN '{n}' THEN s.l_{n}" for n in names) + " END"
    upd = ", ".join(
        f"CASE WHEN o = 'fired' AND trigger = '{n}' THEN tick ELSE l_{n} END AS l_{n}" for n in names
    )
    keep = ", ".join(f"s.l_{n}" for n in names)
    nulls = ", ".join(f"NULL::TIMESTAMP AS l_{n}" for n in names)
    pre = (
        f"""CASE WHEN EXISTS (SELECT 1 FROM {MUTES_SQL} m WHERE m.subscriber = c.subscriber
          AND m.a <= c.tick AND c.tick < m.b) THEN 'muted'
        WHEN extract(hour FROM c.tick + INTERVAL 330 MINUTE) BETWEEN 2 AND 5 THEN 'quiet' END"""
        if filtered
        else "NULL::VARCHAR"
    )
    return f"""{source},
    p AS (SELECT *, {pre} AS pre FROM c),
    q AS (SELECT *, CAST(tick + INTERVAL 330 MINUTE AS DATE) AS day, row_number() OVER
      (PARTITION BY subscriber ORDER BY tick, severity DESC, id) AS n FROM p WHERE pre IS NULL),
    walk AS (
      SELECT subscriber, 0::BIGINT AS n, NULL::BIGINT AS id, NULL::VARCHAR AS o, NULL::DATE AS day,
        0 AS sent, {nulls} FROM (SELECT DISTINCT subscriber FROM q)
      UNION ALL
      SELECT subscriber, n, id, o, day, CASE WHEN o = 'fired' THEN sent + 1 ELSE sent END, {upd}
      FROM (SELECT i.subscriber, i.n, i.id, i.day, i.tick, i.trigger, {keep},
          CASE WHEN s.day = i.day THEN s.sent ELSE 0 END AS sent,
          CASE WHEN i.tick - ({last}) < to_minutes(i.cool) THEN 'cooldown'
            WHEN (CASE WHEN s.day = i.day THEN s.sent ELSE 0 END) >= {budget} THEN 'budget'
            ELSE 'fired' END AS o
        FROM walk s JOIN q i ON i.subscriber = s.subscriber AND i.n = s.n + 1))
    """


@query("trigger_moves", MOVES_SQL + "SELECT *, round(abs(move) / threshold, 6) AS severity FROM c")
def _moves(spark, folder):
    out = move_candidates(readings(spark, folder), move_rule_table(spark, RULES))
    return out.withColumn("severity", F.round("severity", 6))


@query(
    "alert_gate",
    gate_sql(3, True)
    + """SELECT p.id, p.subscriber, p.trigger, p.ts, round(p.severity, 6) AS severity, p.tick,
      coalesce(p.pre, w.o) AS outcome FROM p LEFT JOIN walk w ON w.id = p.id""",
)
def _gate(spark, folder):
    out = alert_gate(candidates(spark, folder), GATE, mutes(spark))
    return out.withColumn("severity", F.round("severity", 6))


MOVE_TRIGGERS = tuple(r.trigger for r in RULES)
SUBSCRIPTIONS = [(s, t) for s in range(6) for i, t in enumerate(MOVE_TRIGGERS) if s == 0 or (s + i) % 3 == 0]
WATCH_GATE = Gate(cooldowns={"click_move": 2, "view_move": 12})
WATCH_SQL = f"""WITH RECURSIVE mv AS ({MOVES_SQL} SELECT * FROM c),
c AS (SELECT id * 8 + CASE trigger {" ".join(f"WHEN '{t}' THEN {i}" for i, t in enumerate(MOVE_TRIGGERS))} END AS id,
  subscriber::BIGINT AS subscriber, trigger, ts, abs(move) / threshold AS severity,
  time_bucket(INTERVAL 30 MINUTE, ts) AS tick,
  CASE trigger WHEN 'click_move' THEN 120 WHEN 'view_move' THEN 720 ELSE 360 END AS cool
  FROM mv JOIN (VALUES {", ".join(f"({s}, '{t}')" for s, t in SUBSCRIPTIONS)}) sb(subscriber, trigger) USING (trigger))"""


@query(
    "watch",
    gate_sql(3, True, WATCH_SQL, MOVE_TRIGGERS)
    + """SELECT p.id, p.subscriber, p.trigger, p.ts, round(p.severity, 6) AS severity, p.tick,
      coalesce(p.pre, w.o) AS outcome FROM p LEFT JOIN walk w ON w.id = p.id AND w.subscriber = p.subscriber""",
)
def _watch(spark, folder):
    moves = move_candidates(readings(spark, folder), move_rule_table(spark, RULES))
    place = F.array_position(F.array(*[F.lit(t) for t in MOVE_TRIGGERS]), F.col("trigger")) - 1
    subscriptions = small_table(spark, SUBSCRIPTIONS, "subscriber bigint, trigger string")
    out = watch(moves.withColumn("id", F.col("id") * 8 + place), subscriptions, WATCH_GATE, mutes(spark))
    return out.withColumn("severity", F.round("severity", 6))


@query(
    "cooldown_only",
    gate_sql(1_000_000, False) + "SELECT p.id, p.tick, w.o AS outcome FROM p JOIN walk w ON w.id = p.id",
)
def _cooldown(spark, folder):
    return cooldown_only(candidates(spark, folder), GATE).select("id", "tick", "outcome")


@query(
    "alerts_per_day",
    gate_sql(3, True)
    + """SELECT p.subscriber, CAST(p.ts + INTERVAL 330 MINUTE AS DATE) AS day, count(*) AS alerts
    FROM p JOIN walk w ON w.id = p.id WHERE w.o = 'fired' GROUP BY 1, 2""",
)
def _per_day(spark, folder):
    fired = alert_gate(candidates(spark, folder), GATE, mutes(spark)).filter("outcome = 'fired'")
    return alerts_per_day(fired, TZ)


@query(
    "mute_filter",
    f"""{CANDIDATES_SQL} SELECT id, subscriber, tick FROM c WHERE EXISTS
    (SELECT 1 FROM {MUTES_SQL} m WHERE m.subscriber = c.subscriber AND m.a <= c.tick AND c.tick < m.b)""",
)
def _muted(spark, folder):
    out = alert_gate(candidates(spark, folder), GATE, mutes(spark))
    return out.filter("outcome = 'muted'").select("id", "subscriber", "tick")


@query(
    "severity_rank",
    f"""{CANDIDATES_SQL}, g AS (SELECT subscriber, tick, trigger, max(severity) AS severity,
      arg_max(id, (severity, -id)) AS id, count(*) AS candidates FROM c GROUP BY 1, 2, 3)
    SELECT subscriber, tick, trigger, round(severity, 6) AS severity, id, candidates,
      CAST(row_number() OVER (PARTITION BY subscriber, tick ORDER BY severity DESC, id) AS INTEGER) AS rank
    FROM g""",
)
def _severity(spark, folder):
    return severity_rank(candidates(spark, folder), 30).withColumn("severity", F.round("severity", 6))


@query(
    "active_hours",
    f"""WITH {READINGS_SQL} SELECT id FROM r
    WHERE extract(hour FROM ts + INTERVAL 330 MINUTE) >= 6 OR extract(hour FROM ts + INTERVAL 330 MINUTE) < 2""",
)
def _active(spark, folder):
    return filters.active_hours(readings(spark, folder), "ts", TZ, 360, 120).select("id")


@query(
    "schedule_days",
    f"""WITH {READINGS_SQL} SELECT id FROM r
    WHERE isodow(ts + INTERVAL 330 MINUTE) - 1 IN (0, 1, 2, 3, 4)""",
)
def _schedule(spark, folder):
    return filters.on_schedule(readings(spark, folder), "ts", TZ, (0, 1, 2, 3, 4)).select("id")


EDGE = r"[^\p{L}\p{N}_]"
HITS_SQL = "list_filter([" + ", ".join(
    f"CASE WHEN regexp_matches(lower(text), '{k if ' ' in k else f'(^|{EDGE}){k}($|{EDGE})'}') THEN '{k}' END"
    for k in KEYWORDS
) + "], lambda x : x IS NOT NULL)"
CONFLICT_SQL = f"""WITH {ARTICLES_SQL},
k AS (SELECT domain, title, first_seen, id, {HITS_SQL} AS hits FROM a
  WHERE domain IN ({", ".join(f"'{d}'" for d in DOMAINS)})),
t AS (SELECT k.*, tick FROM k, (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', (SELECT
  max(first_seen) FROM a) + INTERVAL 3 HOUR, INTERVAL 30 MINUTE)) AS tick) g
  WHERE len(hits) > 0 AND first_seen <= tick AND first_seen >= tick - INTERVAL 2 HOUR),
m AS (SELECT tick, count(DISTINCT domain) AS dc, count(DISTINCT kw) AS kc,
    string_agg(DISTINCT domain, ', ' ORDER BY domain) AS domains,
    string_agg(DISTINCT kw, ', ' ORDER BY kw) AS keywords
  FROM (SELECT tick, domain, unnest(hits) AS kw FROM t) GROUP BY 1),
z AS (SELECT tick, string_agg('[' || domain || '] ' || title, chr(10) ORDER BY n) AS titles
  FROM (SELECT *, row_number() OVER (PARTITION BY tick ORDER BY first_seen DESC, id) AS n FROM t)
  WHERE n <= 8 GROUP BY 1)
"""


@query(
    "conflict_window",
    CONFLICT_SQL
    + """SELECT tick AS ts, CAST(dc AS INTEGER) AS domain_count, CAST(kc AS INTEGER) AS keyword_count,
    domains, keywords, titles, round(dc / 3, 6) AS severity FROM m JOIN z USING (tick)
    WHERE dc >= 3 AND kc >= 2""",
)
def _conflict(spark, folder):
    pairs = conflict_pairs(articles(spark, folder), F.col("text"), KEYWORDS, DOMAINS, CONFLICT, 30)
    return conflict_events(pairs, CONFLICT).withColumn("severity", F.round("severity", 6))


# --- Levels -----------------------------------------------------------------

WATCHED = [
    (1, 60.0, "above", "trim"), (1, 40.0, "below", ""), (2, 50.0, "either", "mid"),
    (3, 100.0, "either", ""), (4, 25.0, "below", "add"), (5, 150.0, "above", ""),
]
LEVEL_COLS = "subscriber bigint, value double, direction string, note string"
CONFIGURED_SQL = "VALUES " + ", ".join(f"({s}::BIGINT, {v}::DOUBLE, '{d}', '{n}')" for s, v, d, n in WATCHED)


def level_walk_sql(levels: str) -> str:
    """Recursive walk of each distinct (series, level, direction) of a query of levels."""
    return f"""WITH RECURSIVE lv AS (SELECT DISTINCT series, level, direction FROM ({levels})),
    t AS (SELECT event_type AS series, time_bucket(INTERVAL 30 MINUTE, ts) AS tick, arg_max(value, ts) AS p
      FROM events WHERE event_type IN ('click', 'view') GROUP BY 1, 2),
    q AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY tick) AS n FROM t),
    w AS (
      SELECT series, level, direction, 0::BIGINT AS n, NULL::TIMESTAMP AS tick, NULL::DOUBLE AS p,
        false AS a, false AS b, 0 AS side FROM lv
      UNION ALL
      SELECT series, level, direction, n, tick, p,
        CASE WHEN down_clear THEN false ELSE a1 OR fa END, CASE WHEN down_clear THEN false ELSE b1 OR fb END,
        CASE WHEN fa THEN 1 WHEN fb THEN 2 ELSE 0 END
      FROM (SELECT *, NOT fa AND wd AND p <= level AND NOT b1 AS fb,
          NOT fa AND wd AND p > level AND b1 AND p > level * 1.005 AS down_clear
        FROM (SELECT *, CASE WHEN up_clear THEN false ELSE a0 END AS a1,
            CASE WHEN up_clear THEN false ELSE b0 END AS b1
          FROM (SELECT w.series, w.level, w.direction, q.n, q.tick, q.p, w.a AS a0, w.b AS b0,
              w.direction IN ('below', 'either') AS wd,
              w.direction IN ('above', 'either') AND q.p >= w.level AND NOT w.a AS fa,
              w.direction IN ('above', 'either') AND q.p < w.level * 0.995 AND w.a AS up_clear
            FROM w JOIN q ON q.series = w.series AND q.n = w.n + 1))))
    """


# Configured levels and the largest value of each user, on two series.
TOPS_SQL = f"""SELECT subscriber, value AS level, direction, series FROM (
    SELECT subscriber, value, direction FROM ({CONFIGURED_SQL}) c(subscriber, value, direction, note)
    UNION ALL SELECT user_id, round(max(value), 0), 'either' FROM events GROUP BY 1), (VALUES ('click'), ('view')) s(series)"""


def top_levels(spark, folder):
    tops = table(spark, folder, "events").groupBy(F.col("user_id").alias("subscriber")).agg(F.round(F.max("value"), 0).alias("value"))
    own = tops.select("subscriber", "value", F.lit("either").alias("direction"))
    both = small_table(spark, WATCHED, LEVEL_COLS).drop("note").unionByName(own)
    return both.withColumn("series", F.explode(F.array(F.lit("click"), F.lit("view"))))


@query(
    "level_crossings",
    level_walk_sql(TOPS_SQL)
    + f"""SELECT o.subscriber, w.series, w.level, w.tick AS ts, w.p AS price,
      CASE side WHEN 1 THEN 'above' ELSE 'below' END AS direction
      FROM w JOIN ({TOPS_SQL}) o ON o.series = w.series AND o.level = w.level AND o.direction = w.direction WHERE side > 0""",
)
def _crossings(spark, folder):
    ticks = tick_series(readings(spark, folder).filter(F.col("series").isin("click", "view")), 30)
    return level_crossings(ticks, top_levels(spark, folder))


def _user_levels(spark, folder):
    """Two levels per user, one of them shared with a configured value for some."""
    users = table(spark, folder, "events").groupBy(F.col("user_id").alias("subscriber")).agg(
        F.max("value").alias("top")
    )
    return users.select(
        "subscriber",
        F.explode(F.array(F.lit(50.0), F.round("top", 0))).alias("value"),
        F.lit("either").alias("direction"),
        F.lit("added").alias("note"),
    ).distinct()


@query(
    "level_union",
    f"""WITH c(subscriber, value, direction, note) AS ({CONFIGURED_SQL}),
    x AS (SELECT DISTINCT subscriber, unnest([50.0::DOUBLE, round(top, 0)]) AS value, 'either' AS direction,
      'added' AS note FROM (SELECT user_id AS subscriber, max(value) AS top FROM events GROUP BY 1))
    SELECT subscriber, value, direction, note, 'config' AS origin FROM c
    UNION ALL SELECT subscriber, value, direction, note, 'added' FROM x
    WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.subscriber = x.subscriber AND c.value = x.value)""",
)
def _level_union(spark, folder):
    return level_union(small_table(spark, WATCHED, LEVEL_COLS), _user_levels(spark, folder))


@query(
    "level_distance",
    """WITH x AS (SELECT DISTINCT subscriber, unnest([50.0::DOUBLE, round(top, 0)]) AS value
      FROM (SELECT user_id AS subscriber, max(value) AS top FROM events GROUP BY 1))
    SELECT subscriber, value, round((value / (SELECT arg_max(value, ts) FROM events
      WHERE event_type = 'click') - 1) * 100, 4) AS distance_pct FROM x""",
)
def _distance(spark, folder):
    levels = _user_levels(spark, folder).withColumn("series", F.lit("click"))
    out = level_distance(levels, latest_reading(readings(spark, folder)))
    return out.select("subscriber", "value", F.round("distance_pct", 4).alias("distance_pct"))


@query("gated_levels")
def _gated_levels(spark, folder):
    """Level and move alerts through one gate; checked by brute force in the tests."""
    ticks = tick_series(readings(spark, folder).filter("series = 'click'"), 30)
    levels = level_union(small_table(spark, WATCHED, LEVEL_COLS), _user_levels(spark, folder))
    watched = level_runs(ticks, levels.withColumn("series", F.lit("click")), GATE)
    fires = gated_fires(candidates(spark, folder), GATE, mutes(spark), level_runs=watched)
    return fires.withColumn("tick", F.timestamp_seconds("tick"))


# --- Control events ---------------------------------------------------------


def commands(spark, folder):
    """Each event becomes a command of its user."""
    price = F.format_number(20_000 + F.floor("value") * 100, 0)
    text = (
        F.when(F.col("event_type") == "signup", F.concat(F.lit("/set "), price, F.lit(" above - trim")))
        .when(F.col("event_type") == "purchase", F.concat(F.lit("/set "), price))
        .when(F.col("event_type") == "view", F.concat(F.lit("/unset "), price))
        .when(F.col("event_type") == "error", F.concat(F.lit("/mute "), F.floor("value").cast("string"), F.lit("h")))
        .otherwise(F.when(F.col("value") < 20, F.lit("/unmute")).otherwise(F.lit("/mute soon")))
    )
    return table(spark, folder, "events").select(
        F.col("user_id").alias("subscriber"),
        F.col("event_id").alias("seq"),
        F.col("ts").cast("timestamp").alias("ts"),
        text.alias("text"),
    )


def _known(spark, folder):
    return table(spark, folder, "events").filter("value > 150").select(F.col("user_id").alias("subscriber"))


COMMANDS_SQL = """e AS (SELECT user_id AS subscriber, event_id AS seq, ts, event_type, value,
  20000 + floor(value) * 100 AS level FROM events
  WHERE user_id IN (SELECT user_id FROM events WHERE value > 150)),
l AS (SELECT s.subscriber, s.level AS value, arg_min(CASE event_type WHEN 'signup' THEN 'above'
    ELSE 'either' END, s.seq) AS direction, arg_min(CASE event_type WHEN 'signup' THEN 'trim' ELSE '' END,
    s.seq) AS note, min(s.ts) AS since
  FROM e s WHERE event_type IN ('signup', 'purchase') AND level <= 1000000 AND NOT EXISTS (SELECT 1 FROM e u WHERE
    u.event_type = 'view' AND u.subscriber = s.subscriber AND u.level = s.level AND u.seq > s.seq)
  GROUP BY 1, 2),
m AS (SELECT subscriber, arg_max(event_type, seq) AS k, arg_max(ts, seq) AS ts,
    arg_max(least(floor(value), 24), seq) AS hours
  FROM e WHERE (event_type = 'error' AND floor(value) > 0) OR (event_type = 'click' AND value < 20) GROUP BY 1)"""


@query(
    "control_events",
    f"""WITH {COMMANDS_SQL}
    SELECT subscriber, 'level' AS kind, value, direction, note, since, NULL::TIMESTAMP AS until FROM l
    UNION ALL SELECT subscriber, 'mute', NULL, NULL, NULL, ts, ts + to_hours(CAST(hours AS INTEGER))
    FROM m WHERE k = 'error'""",
)
def _control(spark, folder):
    parsed = control.parse(commands(spark, folder), _known(spark, folder))
    levels = control.current_levels(parsed).select(
        "subscriber", F.lit("level").alias("kind"), "value", "direction", "note", F.col("added").alias("since")
    )
    muted = control.current_mutes(parsed).select(
        "subscriber", F.lit("mute").alias("kind"), F.col("from_ts").alias("since"), F.col("until_ts").alias("until")
    )
    return levels.unionByName(muted, allowMissingColumns=True)


# --- Spend ------------------------------------------------------------------

PRICES = Prices(daily_cap_micro=150_000, per_run_cap_micro=32_500)
CALLS_SQL = """u AS (SELECT conv_id, turn, length(text) AS input_chars,
    lead(CASE WHEN role = 'assistant' THEN length(text) END) OVER (PARTITION BY conv_id ORDER BY turn) AS oc, role
  FROM conversations),
k AS (SELECT conv_id * 1000 + turn AS call_id, DATE '2024-01-01' + CAST(conv_id % 30 AS INTEGER) AS day,
    CAST(floor(input_chars / 3.5) AS BIGINT) AS input_tokens,
    CAST(floor(coalesce(oc, 0) / 3.5) AS BIGINT) AS output_tokens FROM u WHERE role = 'user'),
p AS (SELECT *, input_tokens * 3 + 2000 * 15 AS projected, input_tokens * 3 + output_tokens * 15 AS cost FROM k)"""


def calls(spark, folder):
    """A user turn is a call; the assistant turn right after it is its output."""
    c = table(spark, folder, "conversations")
    after = c.filter("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.length("text").alias("output_chars")
    )
    return (
        c.filter("role = 'user'")
        .join(after, ["conv_id", "turn"], "left")
        .select(
            (F.col("conv_id") * 1000 + F.col("turn")).alias("call_id"),
            F.date_add(F.lit("2024-01-01").cast("date"), (F.col("conv_id") % 30).cast("int")).alias("day"),
            F.length("text").alias("input_chars"),
            F.coalesce("output_chars", F.lit(0)).alias("output_chars"),
        )
    )


@query(
    "call_costs",
    f"""WITH {CALLS_SQL} SELECT call_id, day, input_tokens, output_tokens, projected, cost,
    round((cost * 20 + input_tokens * 6 + output_tokens * 75) / 20, 0) / 1000000 AS cached_usd FROM p""",
)
def _costs(spark, folder):
    out = ledger.priced_calls(calls(spark, folder), PRICES)
    usd = cached_call_usd(*[F.col(c) for c in ("input_tokens", "output_tokens", "input_tokens", "output_tokens")], PRICES)
    return out.withColumn("cached_usd", usd).drop("input_chars", "output_chars")


@query(
    "spend_ledger",
    f"WITH {CALLS_SQL} SELECT day, CAST(sum(cost) AS BIGINT) AS cost_micro, count(*) AS calls FROM p GROUP BY 1",
)
def _ledger(spark, folder):
    priced = ledger.priced_calls(calls(spark, folder), PRICES)
    first, second = priced.filter("call_id % 2 = 0"), priced.filter("call_id % 2 = 1")
    return ledger.merge_ledger(ledger.spend_ledger(first), ledger.spend_ledger(second))


@query(
    "spend_guard",
    f"""WITH RECURSIVE {CALLS_SQL},
    pr AS (SELECT day, sum(cost) AS spent FROM p WHERE call_id % 5 = 0 GROUP BY 1),
    q AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY call_id) AS n FROM p WHERE call_id % 5 > 0),
    w AS (SELECT DISTINCT q.day, 0::BIGINT AS n, NULL::BIGINT AS call_id, coalesce(pr.spent, 0)::BIGINT AS spent,
        ''::VARCHAR AS outcome FROM q LEFT JOIN pr USING (day)
      UNION ALL
      SELECT q.day, q.n, q.call_id, CASE WHEN q.projected <= 32500 AND w.spent + q.projected <= 150000
          THEN w.spent + q.cost ELSE w.spent END,
        CASE WHEN q.projected > 32500 THEN 'per_run' WHEN w.spent + q.projected > 150000 THEN 'daily'
          ELSE 'allowed' END
      FROM w JOIN q ON q.day = w.day AND q.n = w.n + 1)
    SELECT call_id, day, outcome FROM w WHERE n > 0 UNION ALL SELECT call_id, day, 'booked' FROM p WHERE call_id % 5 = 0""",
)
def _guard(spark, folder):
    """Every fifth call is on the books already, the others are judged after it."""
    priced = ledger.priced_calls(calls(spark, folder), PRICES)
    booked = priced.filter("call_id % 5 = 0")
    out = ledger.spend_guard(priced.filter("call_id % 5 > 0"), PRICES, prior=ledger.spend_ledger(booked))
    return out.select("call_id", "day", "outcome").unionByName(booked.select("call_id", "day", F.lit("booked").alias("outcome")))


REGISTRY_SQL = {name: REGISTRY[name].sql for name in ("level_crossings", "level_union")}
