"""Derived figures. Event types stand for the legs: click spot, view fx, signup
silver, purchase quote, error future."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from catalog.base import query
from catalog.tables import READINGS_SQL, TZ, readings, table
from tidemark.functions import money
from tidemark.functions.numbers import round_levels
from tidemark.operators.series import align, daily_series, latest_reading, session_change
from tidemark.plans.derived import (
    calendar_horizon,
    derive_columns,
    derived_notes,
    derived_readings,
    implied_odds,
    landed_columns,
    season_flags,
)
from tidemark.rules import TROY_OUNCE_GRAMS, TaxStack, small_table

TAX = TaxStack()
LEGS = {"click": "spot", "view": "fx", "signup": "silver", "purchase": "quote", "error": "future"}


def aligned(spark, folder):
    """Legs at each tick, with the last closed day's session changes of spot and fx."""
    r = readings(spark, folder)
    legs = align(r, list(LEGS), 30)
    legs = legs.select("ts", *[F.col(k).alias(v) for k, v in LEGS.items()])
    changes = session_change(daily_series(r, TZ)).select("series", "day", "change_pct")
    by_day = changes.groupBy("day").agg(
        F.max(F.when(F.col("series") == "click", F.col("change_pct"))).alias("spot_change"),
        F.max(F.when(F.col("series") == "view", F.col("change_pct"))).alias("fx_change"),
    )
    yesterday = F.date_sub(F.to_date(F.from_utc_timestamp("ts", TZ)), 1)
    return legs.withColumn("day", yesterday).join(by_day, "day", "left").drop("day")


ALIGNED_SQL = f"""WITH {READINGS_SQL},
t AS (SELECT time_bucket(INTERVAL 30 MINUTE, ts) AS ts, {", ".join(
    f"arg_max(value, ts) FILTER (series = '{k}') AS {v}" for k, v in LEGS.items())} FROM r GROUP BY 1),
f AS (SELECT ts, {", ".join(f"last_value({v} IGNORE NULLS) OVER w AS {v}" for v in LEGS.values())}
  FROM t WINDOW w AS (ORDER BY ts ROWS UNBOUNDED PRECEDING)),
dd AS (SELECT series, CAST(ts + INTERVAL 330 MINUTE AS DATE) AS day, arg_max(value, ts) AS value FROM r GROUP BY 1, 2),
cc AS (SELECT series, day, (value / nullif(lag(value) OVER (PARTITION BY series ORDER BY day), 0) - 1) * 100 AS c FROM dd),
cw AS (SELECT day, max(c) FILTER (series = 'click') AS spot_change, max(c) FILTER (series = 'view') AS fx_change FROM cc GROUP BY 1),
a0 AS (SELECT f.*, cw.spot_change, cw.fx_change FROM f LEFT JOIN cw
  ON cw.day = CAST(f.ts + INTERVAL 330 MINUTE AS DATE) - 1),
a AS (SELECT *, coalesce(nullif(spot, 0), nullif(future, 0)) AS gold,
  ((1 + spot_change / 100) * (1 + fx_change / 100) - 1) * 100 AS inr FROM a0),
b AS (SELECT *, gold * fx / 31.1034768 * 10.0 * 1.11 AS ex0 FROM a),
x AS (SELECT ts, spot, fx, silver, quote, future, gold, spot_change, fx_change, round(gold / silver, 3) AS ratio,
  round(gold * fx / 31.1034768 * 10.0 * {TAX.landed!r}::DOUBLE, 2) AS landed, round(ex0, 2) AS ex_tax,
  round((quote / ex0 - 1) * 100, 3) AS premium, abs((quote / ex0 - 1) * 100) > 4 AS premium_wide,
  round(abs(future / spot - 1) * 100, 4) AS "cross", abs(future / spot - 1) * 100 > 0.3 AS cross_wide,
  CASE WHEN spot <> 0 AND future <> 0 AND abs(future / spot - 1) * 100 > 0.3
      THEN format('DIVERGENCE: spot {{:.2f}} and future {{:.2f}} differ by {{:.2f}}%, allowed are 0.3%: the price is uncertain', spot, future, abs(future / spot - 1) * 100)
    WHEN spot <> 0 AND NOT coalesce(future <> 0, false) THEN 'only the spot resolved: no cross-check'
    WHEN future <> 0 AND NOT coalesce(spot <> 0, false) THEN 'only the future resolved: no cross-check' END AS cross_note,
  round(inr, 3) AS inr_change, (spot_change > 0) <> (inr > 0) AS diverging FROM b)
"""


@query("series_ratio", ALIGNED_SQL + "SELECT ts, ratio FROM x")
def _ratio(spark, folder):
    return derive_columns(aligned(spark, folder), TAX).select("ts", "ratio")


@query("cross_check", ALIGNED_SQL + 'SELECT ts, spot, future, "cross", cross_wide, cross_note FROM x')
def _cross(spark, folder):
    return derive_columns(aligned(spark, folder), TAX).select("ts", "spot", "future", "cross", "cross_wide", "cross_note")


@query("premium_gap", ALIGNED_SQL + "SELECT ts, quote, ex_tax, premium, premium_wide FROM x")
def _premium(spark, folder):
    return derive_columns(aligned(spark, folder), TAX).select("ts", "quote", "ex_tax", "premium", "premium_wide")


@query("direction_divergence", ALIGNED_SQL + "SELECT ts, inr_change, diverging FROM x")
def _direction(spark, folder):
    return derive_columns(aligned(spark, folder), TAX).select("ts", "inr_change", "diverging")


@query(
    "derived_metrics",
    ALIGNED_SQL
    + """SELECT * FROM (
    SELECT ts, 'gold_silver_ratio' AS series, ratio AS value, 'ratio' AS unit, 'derived' AS source, NULL::VARCHAR AS note FROM x
    UNION ALL SELECT ts, 'gold_inr_per_10g', landed, 'INR/10g', 'derived', NULL FROM x
    UNION ALL SELECT ts, 'gold_inr_per_10g_ex_gst', ex_tax, 'INR/10g', 'derived', NULL FROM x
    UNION ALL SELECT ts, 'india_physical_premium_pct', premium, '%', 'derived',
      CASE WHEN premium_wide THEN 'gap too wide: check the tax stack' END FROM x
    UNION ALL SELECT ts, 'usd_inr_direction_divergence', CAST(diverging AS INTEGER)::DOUBLE, 'boolean', 'derived',
      CASE WHEN diverging THEN 'directions differ' END FROM x) WHERE value IS NOT NULL""",
)
def _derived(spark, folder):
    return derived_readings(aligned(spark, folder), TAX)


FESTIVALS = [
    ("harvest", date(2024, 1, 14), date(2024, 1, 14), True),
    ("wedding", date(2024, 1, 20), date(2024, 2, 10), False),
    ("spring", date(2024, 2, 14), date(2024, 2, 14), True),
]


@query(
    "derived_notes",
    ALIGNED_SQL
    + """, s(name, a, b, point) AS (VALUES ('harvest', DATE '2024-01-14', DATE '2024-01-14', true),
      ('wedding', DATE '2024-01-20', DATE '2024-02-10', false), ('spring', DATE '2024-02-14', DATE '2024-02-14', true)),
    ld AS (SELECT ts, CAST(ts + INTERVAL 330 MINUTE AS DATE) AS day FROM x),
    sn AS (SELECT ts, 'seasonal demand: ' || string_agg(CASE WHEN NOT point AND day >= a THEN name || ' is active (to ' || b || ')'
      ELSE name || ' in ' || (a - day) || 'd (' || a || ')' END, '; ' ORDER BY a) AS note
      FROM ld JOIN s ON day BETWEEN a - 21 AND CASE WHEN point THEN a ELSE b END GROUP BY ts)
    SELECT ts, 'cross' AS source, cross_note AS note FROM x WHERE cross_note IS NOT NULL
    UNION ALL SELECT ts, 'premium', 'gap too wide: check the tax stack' FROM x WHERE premium_wide
    UNION ALL SELECT ts, 'directions', 'directions differ' FROM x WHERE diverging
    UNION ALL SELECT ts, 'season', note FROM sn""",
)
def _derived_notes(spark, folder):
    seasons = small_table(spark, FESTIVALS, "name string, start date, end date, point boolean")
    return derived_notes(derive_columns(aligned(spark, folder), TAX), seasons, TZ)


@query(
    "landed_cost",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice,
    round(l_extendedprice * l_quantity / {TROY_OUNCE_GRAMS} * 10.0 * {TAX.landed!r}::DOUBLE, 2) AS landed,
    round(l_extendedprice * l_quantity / {TROY_OUNCE_GRAMS} * 10.0 * {TAX.ex_gst!r}::DOUBLE, 2) AS ex_tax,
    l_extendedprice * (1 - l_discount) * (1.0::DOUBLE + 0.06::DOUBLE + 0.05::DOUBLE) * (1.0 + l_tax) AS stacked
    FROM lineitem""",
)
def _landed(spark, folder):
    li = table(spark, folder, "lineitem")
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    stacked = money.stacked_cost(net, F.lit(0.06), F.lit(0.05), F.col("l_tax"))
    cols = landed_columns(F.col("l_extendedprice"), F.col("l_quantity"), TAX)
    return li.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_extendedprice",
        *[c.alias(n) for n, c in cols.items()],
        stacked.alias("stacked"),
    )


@query(
    "implied_odds",
    """WITH p AS (SELECT p_partkey AS id, 85 + p_retailprice % 20 AS price, p_size / 10 AS effective FROM part)
    SELECT id, price, effective, round(100 - price, 4) AS implied_rate,
      round((effective - (100.0 - price)) * 100.0, 1) + 0.0 AS expected_cut_bp,
      round(greatest(0.0, least(100.0, (effective - (100.0 - price)) * 100.0 / 25.0 * 100.0)), 1) + 0.0 AS cut_probability
    FROM p WHERE price BETWEEN 90 AND 100.5""",
)
def _odds(spark, folder):
    legs = table(spark, folder, "part").select(
        F.col("p_partkey").alias("id"),
        (85 + F.col("p_retailprice") % 20).alias("price"),
        (F.col("p_size") / 10).alias("effective"),
    )
    return implied_odds(legs)


@query(
    "season_flags",
    """WITH s(name, a, b, point) AS (VALUES ('spring', DATE '1996-04-28', DATE '1996-04-28', true),
      ('autumn', DATE '1997-11-09', DATE '1997-11-09', true), ('wedding', DATE '1998-10-15', DATE '1999-03-15', false)),
    d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders)
    SELECT day, name, CASE WHEN NOT point AND day >= a THEN 'active' ELSE 'ahead' END AS state,
      CASE WHEN point OR day < a THEN CAST(a - day AS INTEGER) END AS days_ahead
    FROM d JOIN s ON day BETWEEN a - 21 AND CASE WHEN point THEN a ELSE b END""",
)
def _seasons(spark, folder):
    days = table(spark, folder, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    rows = [
        ("spring", date(1996, 4, 28), date(1996, 4, 28), True),
        ("autumn", date(1997, 11, 9), date(1997, 11, 9), True),
        ("wedding", date(1998, 10, 15), date(1999, 3, 15), False),
    ]
    seasons = small_table(spark, rows, "name string, start date, end date, point boolean")
    return season_flags(days, seasons)


@query(
    "calendar_horizon",
    """SELECT DISTINCT CAST(o_orderdate AS DATE) AS day, o_orderpriority AS name, o_orderstatus AS source,
      CAST(CAST(o_orderdate AS DATE) - DATE '1998-03-01' AS INTEGER) AS days_away
    FROM orders WHERE o_orderdate BETWEEN DATE '1998-03-01' AND DATE '1998-03-08'""",
)
def _calendar(spark, folder):
    events = table(spark, folder, "orders").select(
        F.to_date("o_orderdate").alias("day"),
        F.col("o_orderpriority").alias("name"),
        F.col("o_orderstatus").alias("source"),
    )
    return calendar_horizon(events, date(1998, 3, 1))


@query(
    "round_levels",
    f"""WITH {READINGS_SQL}, l AS (SELECT series, source, arg_max(value, ts) AS current FROM r GROUP BY 1, 2),
    b AS (SELECT *, round_even(current / 50.0, 0) * 50.0 AS base FROM l)
    SELECT series, source, current, base + k * 50.0::DOUBLE AS level FROM b, range(-3, 4) t(k) WHERE base + k * 50.0 > 0""",
)
def _round_levels(spark, folder):
    latest = latest_reading(readings(spark, folder), ("series", "source"))
    return latest.select(
        "series", "source", F.col("value").alias("current"), F.explode(round_levels(F.col("value"), 50)).alias("level")
    )


@query(
    "json_extra",
    """WITH x AS (SELECT event_id AS id, CASE WHEN event_id % 10 = 0 THEN substr(props, 1, 4) ELSE props END AS extra FROM events)
    SELECT id, CASE WHEN json_valid(extra) THEN CAST(extra ->> '$.k' AS BIGINT) END AS k FROM x""",
)
def _json(spark, folder):
    # Every tenth row is cut short to stand for broken JSON.
    extra = F.when(F.col("event_id") % 10 == 0, F.substring("props", 1, 4)).otherwise(F.col("props"))
    return table(spark, folder, "events").select(
        F.col("event_id").alias("id"), F.get_json_object(extra, "$.k").try_cast("bigint").alias("k")
    )
