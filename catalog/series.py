"""Time-series queries."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.base import query
from catalog.tables import DAILY_SQL, NOW, READINGS_SQL, TZ, readings, table
from tidemark.functions.dates import expiry_date
from tidemark.operators import filters
from tidemark.operators.asof import rolling_baseline
from tidemark.operators.health import asof_age
from tidemark.operators.series import (
    align,
    basis_point_change,
    daily_series,
    exact_median,
    extremes,
    flow_delta,
    front_month,
    latest_reading,
    net_position,
    priority_value,
    session_change,
    since,
    trailing,
    trend,
)
from tidemark.rules import small_table

WITH_DAILY = f"WITH {READINGS_SQL}, {DAILY_SQL}"


def _daily(spark: SparkSession, folder: str, since: datetime | None = None) -> DataFrame:
    return daily_series(readings(spark, folder, since), TZ)


@query(
    "window_baseline",
    f"""WITH {READINGS_SQL}
    SELECT p.id, p.series, p.ts, p.value, coalesce(b.id, f.id) AS base_id,
      coalesce(b.ts, f.ts) AS base_ts, coalesce(b.value, f.value) AS base_value
    FROM r p ASOF LEFT JOIN r b ON p.series = b.series AND p.ts - INTERVAL 4 HOUR >= b.ts
    LEFT JOIN (SELECT series, arg_min(id, ts) AS id, min(ts) AS ts, arg_min(value, ts) AS value
               FROM r GROUP BY 1) f ON f.series = p.series""",
)
def _window_baseline(spark, folder):
    four_hours = F.array(F.struct(F.lit(4.0).alias("window_hours")))
    r = readings(spark, folder).select("id", "series", "ts", "value", four_hours.alias("windows"))
    return rolling_baseline(r, "windows").select(
        "id",
        "series",
        "ts",
        "value",
        F.col("baseline.id").alias("base_id"),
        F.col("baseline.ts").alias("base_ts"),
        F.col("baseline.value").alias("base_value"),
    )


@query(
    "latest_reading",
    f"""WITH {READINGS_SQL}
    SELECT series, max(ts) AS ts, arg_max(value, ts) AS value, arg_max(source, ts) AS source,
      arg_max(id, ts) AS id FROM r GROUP BY 1""",
)
def _latest(spark, folder):
    return latest_reading(readings(spark, folder))


@query(
    "history",
    f"""WITH {READINGS_SQL}
    SELECT id, series, ts, value FROM r WHERE ts >= TIMESTAMP '2024-01-24 00:00:00'""",
)
def _history(spark, folder):
    return trailing(readings(spark, folder, NOW - timedelta(days=7)), NOW, 7).select("id", "series", "ts", "value")


@query("daily_series", f"{WITH_DAILY} SELECT series, day, value FROM d")
def _daily_query(spark, folder):
    return _daily(spark, folder).select("series", "day", "value")


@query(
    "change_pct",
    f"""{WITH_DAILY}
    SELECT series, day, value, lag(value) OVER w AS previous,
      round((value / nullif(lag(value) OVER w, 0) - 1) * 100, 4) AS change_pct
    FROM d WINDOW w AS (PARTITION BY series ORDER BY day)""",
)
def _change_pct(spark, folder):
    return session_change(_daily(spark, folder)).withColumn("change_pct", F.round("change_pct", 4))


@query(
    "change_bp",
    f"""{WITH_DAILY}
    SELECT series, day, value, lag(day) OVER w AS previous_day,
      round((value - lag(value) OVER w) * 100, 2) AS change_bp
    FROM (SELECT * FROM d WHERE extract(day FROM day) % 5 <> 0)
    WINDOW w AS (PARTITION BY series ORDER BY day)""",
)
def _change_bp(spark, folder):
    # Every fifth day stands for a placeholder print without a value.
    daily = _daily(spark, folder).withColumn(
        "value", F.when(F.dayofmonth("day") % 5 != 0, F.col("value"))
    )
    return basis_point_change(daily)


@query(
    "flow_delta",
    f"""{WITH_DAILY}
    SELECT series, day, value, round(value - lag(value, 1) OVER w, 2) AS delta,
      round(value - lag(value, 5) OVER w, 2) AS delta_5,
      CAST(day - lag(day, 1) OVER w AS INTEGER) AS days_between
    FROM d WINDOW w AS (PARTITION BY series ORDER BY day)""",
)
def _flow_delta(spark, folder):
    return flow_delta(_daily(spark, folder))


@query(
    "net_position",
    """WITH p AS (
      SELECT l_linestatus AS series, CAST(date_trunc('week', l_shipdate) AS DATE) AS day,
        coalesce(sum(l_quantity) FILTER (l_returnflag = 'A'), 0) AS long,
        coalesce(sum(l_quantity) FILTER (l_returnflag = 'R'), 0) AS short
      FROM lineitem GROUP BY 1, 2),
    n AS (SELECT series, day, long - short AS net FROM p),
    w8 AS (SELECT series, day, net, net - lag(net) OVER w AS week_change,
        list(net) OVER (PARTITION BY series ORDER BY day ROWS 7 PRECEDING) AS l
      FROM n WINDOW w AS (PARTITION BY series ORDER BY day))
    SELECT series, day, net, week_change, CAST(len(l) AS INTEGER) AS window_reports,
      CASE WHEN len(l) >= 4 THEN round(100.0 *
        len(list_filter(l, lambda x : x < net)) / (len(l) - 1), 1) END AS percentile_in_window
    FROM w8""",
)
def _net_position(spark, folder):
    li = table(spark, folder, "lineitem")
    side = lambda flag: F.coalesce(F.sum(F.when(F.col("l_returnflag") == flag, F.col("l_quantity"))), F.lit(0.0))
    weekly = li.groupBy(
        F.col("l_linestatus").alias("series"),
        F.to_date(F.date_trunc("week", "l_shipdate")).alias("day"),
    ).agg(side("A").alias("long"), side("R").alias("short"))
    return net_position(weekly)


@query(
    "price_extremes",
    f"""{WITH_DAILY}
    SELECT series, CAST(n.n AS INTEGER) AS days, min(value) AS low, max(value) AS high, count(*) AS n
    FROM d, (VALUES (7), (30)) n(n)
    WHERE d.ts >= TIMESTAMP '2024-01-31 00:00:00' - to_days(n.n)
    GROUP BY series, n.n HAVING count(*) >= 2""",
)
def _price_extremes(spark, folder):
    return extremes(_daily(spark, folder, NOW - timedelta(days=30)), NOW)


@query(
    "trend_block",
    f"""{WITH_DAILY}
    SELECT series, count(*) AS days,
      round((arg_max(value, day) / arg_min(value, day) - 1) * 100, 2) AS direction_pct,
      string_agg(strftime(day, '%m-%d') || ' ' || format('{{:,.2f}}', value), ' | ' ORDER BY day) AS rendered
    FROM d WHERE ts >= TIMESTAMP '2024-01-24 00:00:00' GROUP BY 1 HAVING count(*) >= 2""",
)
def _trend_block(spark, folder):
    out = trend(since(_daily(spark, folder, NOW - timedelta(days=7)), NOW, 7))
    return out.withColumn("direction_pct", F.round("direction_pct", 2))


@query(
    "align_series",
    f"""WITH {READINGS_SQL},
    t AS (SELECT to_timestamp(floor(epoch(ts) / 1800) * 1800)::TIMESTAMP AS ts,
        arg_max(value, ts) FILTER (series = 'click') AS click,
        arg_max(value, ts) FILTER (series = 'view') AS "view",
        arg_max(value, ts) FILTER (series = 'signup') AS signup
      FROM r WHERE series IN ('click', 'view', 'signup') GROUP BY 1)
    SELECT ts, last_value(click IGNORE NULLS) OVER w AS click,
      last_value("view" IGNORE NULLS) OVER w AS "view",
      last_value(signup IGNORE NULLS) OVER w AS signup
    FROM t WINDOW w AS (ORDER BY ts ROWS UNBOUNDED PRECEDING)""",
)
def _align(spark, folder):
    return align(readings(spark, folder), ["click", "view", "signup"], 30)


@query(
    "nav_median",
    """WITH s AS (SELECT p_partkey, p_name, p_retailprice AS nav,
        DATE '2024-01-01' + p_size AS day FROM part
      WHERE regexp_matches(lower(p_name), 'ring|widget|bolt')
        AND NOT regexp_matches(lower(p_name), 'small|old')
        AND regexp_matches(lower(p_name), 'red|hot|blue')
        AND p_retailprice BETWEEN 5 AND 2000)
    SELECT count(*) AS n, min(nav) AS min_value, max(nav) AS max_value,
      round(median(nav), 4) AS median_value,
      (SELECT string_agg(p_name || '=' || format('{:.2f}', nav), '; ' ORDER BY p_partkey)
       FROM (SELECT * FROM s ORDER BY p_partkey LIMIT 6)) AS sample,
      (SELECT string_agg(strftime(day, '%Y-%m-%d'), ', ' ORDER BY day)
       FROM (SELECT DISTINCT day FROM s ORDER BY day LIMIT 3)) AS dates
    FROM s""",
)
def _nav_median(spark, folder):
    part = table(spark, folder, "part").select(
        F.col("p_partkey").alias("id"),
        F.col("p_name").alias("scheme"),
        F.col("p_retailprice").alias("nav"),
        F.date_add(F.lit("2024-01-01").cast("date"), F.col("p_size")).alias("day"),
    )
    kept = filters.scheme_filter(
        part, "scheme", ("ring", "widget", "bolt"), ("small", "old"), ("red", "hot", "blue")
    )
    kept = filters.plausible(kept, "nav", (5.0, 2000.0))
    first = (
        kept.orderBy("id")
        .limit(6)
        .agg(
            F.array_join(
                F.transform(
                    F.sort_array(F.collect_list(F.struct("id", "scheme", "nav"))),
                    lambda x: F.format_string("%s=%.2f", x["scheme"], x["nav"]),
                ),
                "; ",
            )
        )
    )
    dates = (
        kept.select("day")
        .distinct()
        .orderBy("day")
        .limit(3)
        .agg(F.array_join(F.sort_array(F.collect_list(F.col("day").cast("string"))), ", "))
    )
    return exact_median(kept, "nav").select(
        "n",
        "min_value",
        "max_value",
        F.round("median_value", 4).alias("median_value"),
        first.scalar().alias("sample"),
        dates.scalar().alias("dates"),
    )


@query(
    "priority_value",
    """WITH r AS (SELECT strftime(ts, '%Y-%m-%d') AS run_id, event_type AS series,
        'u' || user_id AS source, CAST(user_id % 7 AS INTEGER) AS source_priority,
        CASE WHEN value >= 5 THEN value END AS value, event_id AS id FROM events)
    SELECT run_id, series, value, source, source_priority FROM r WHERE value IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY run_id, series ORDER BY source_priority, id) = 1""",
)
def _priority_value(spark, folder):
    r = table(spark, folder, "events").select(
        F.date_format("ts", "yyyy-MM-dd").alias("run_id"),
        F.col("event_type").alias("series"),
        F.concat(F.lit("u"), "user_id").alias("source"),
        (F.col("user_id") % 7).cast("int").alias("source_priority"),
        F.when(F.col("value") >= 5, F.col("value")).alias("value"),
        F.col("event_id").alias("id"),
    )
    return priority_value(r)


@query(
    "front_month",
    """WITH c AS (SELECT l_partkey AS symbol, l_orderkey * 8 + l_linenumber AS id,
        l_extendedprice AS price,
        CASE WHEN l_linenumber = 7 THEN 'spot'
          ELSE upper(strftime(l_shipdate, '%d%b%Y')) END AS expiry_text,
        CASE WHEN l_linenumber = 7 THEN NULL ELSE CAST(l_shipdate AS DATE) END AS expiry
      FROM lineitem WHERE l_linestatus = 'O')
    SELECT symbol, expiry_text, price FROM c QUALIFY row_number() OVER (PARTITION BY symbol
      ORDER BY coalesce(expiry, DATE '9999-12-31'), expiry_text, id, price) = 1""",
)
def _front_month(spark, folder):
    li = filters.exact_symbol(table(spark, folder, "lineitem"), "l_linestatus", "O")
    text = F.when(F.col("l_linenumber") == 7, F.lit("spot")).otherwise(
        F.upper(F.date_format("l_shipdate", "ddMMMyyyy"))
    )
    contracts = li.select(
        F.col("l_partkey").alias("symbol"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"),
        F.col("l_extendedprice").alias("price"),
        text.alias("expiry_text"),
    ).withColumn("expiry", expiry_date(F.col("expiry_text")))
    return front_month(contracts)


@query(
    "asof_age",
    """WITH s AS (SELECT event_type AS series, 'u' || user_id AS source,
        CAST(max(ts) AS DATE) AS observed FROM events GROUP BY 1, 2),
    l(series, limit_days) AS (VALUES ('click', 1), ('view', 3), ('error', -1))
    SELECT series, source, observed, CAST(DATE '2024-01-31' - observed AS INTEGER) AS age_days
    FROM s JOIN l USING (series)
    WHERE DATE '2024-01-31' - observed > limit_days OR limit_days < 0""",
)
def _asof_age(spark, folder):
    limits = small_table(
        spark, [("click", 1), ("view", 3), ("error", -1)], "series string, limit_days int"
    )
    return asof_age(readings(spark, folder), limits, NOW.date())
