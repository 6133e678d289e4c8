"""Time-series jobs. Windows by series run only over local-day or report grains,
where a series has one row per day however many readings it holds."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.dates import local_day, tick_of
from tidemark.functions.numbers import change_pct, grouped
from tidemark.operators.asof import carry_forward


def latest_reading(readings: DataFrame, keys: tuple[str, ...] = ("series",)) -> DataFrame:
    return (
        readings.filter(F.col("value").isNotNull())
        .groupBy(*keys)
        .agg(
            F.max_by(
                F.struct(*[c for c in ("ts", "value", "source", "id") if c not in keys]),
                F.struct("ts", "id"),
            ).alias("r")
        )
        .select(*keys, "r.*")
    )


def trailing(readings: DataFrame, now: datetime, days: float) -> DataFrame:
    """Readings of the last `days`, oldest first per series. No row limit."""
    since = now - timedelta(days=days)
    kept = readings.filter(F.col("ts") >= F.lit(since))
    if "event_date" in readings.columns:  # prunes partitions of a stored table
        kept = kept.filter(F.col("event_date") >= F.lit(since.date()))
    return kept.orderBy("series", "ts", "id")


def daily_series(readings: DataFrame, tz: str, keys: tuple[str, ...] = ("series",)) -> DataFrame:
    """Last reading of each local day, with its time."""
    return (
        readings.filter(F.col("value").isNotNull())
        .groupBy(*keys, local_day(F.col("ts"), tz).alias("day"))
        .agg(F.max_by("value", F.struct("ts", "id")).alias("value"), F.max("ts").alias("ts"))
    )


def since(daily: DataFrame, now: datetime, days: float) -> DataFrame:
    """Daily rows whose last reading lies in the trailing `days`."""
    return daily.filter(F.col("ts") >= F.lit(now) - F.expr(f"INTERVAL '{round(days * 86400)}' SECOND"))


def tick_series(readings: DataFrame, minutes: int) -> DataFrame:
    """Last reading of each polling tick."""
    return (
        readings.filter(F.col("value").isNotNull())
        .groupBy("series", tick_of(F.col("ts"), minutes).alias("tick"))
        .agg(F.max_by("value", F.struct("ts", "id")).alias("value"))
    )


def _by_day(keys: tuple[str, ...] = ("series",)) -> Window:
    return Window.partitionBy(*keys).orderBy("day")


def session_change(daily: DataFrame) -> DataFrame:
    """Change against the previous local day; null without a usable base."""
    prev = F.lag("value").over(_by_day())
    return daily.select(
        "series", "day", "value", prev.alias("previous"), change_pct(F.col("value"), prev).alias("change_pct")
    )


def basis_point_change(daily: DataFrame) -> DataFrame:
    """Change in basis points against the previous print that has a value."""
    prints = daily.filter(F.col("value").isNotNull())
    prev, prev_day = F.lag("value").over(_by_day()), F.lag("day").over(_by_day())
    return prints.select(
        "series",
        "day",
        "value",
        prev_day.alias("previous_day"),
        F.round((F.col("value") - prev) * 100, 2).alias("change_bp"),
    )


def flow_delta(daily: DataFrame) -> DataFrame:
    """Change since the last session and over five sessions."""
    w = _by_day()
    return daily.select(
        "series",
        "day",
        "value",
        F.round(F.col("value") - F.lag("value", 1).over(w), 2).alias("delta"),
        F.round(F.col("value") - F.lag("value", 5).over(w), 2).alias("delta_5"),
        F.date_diff("day", F.lag("day", 1).over(w)).alias("days_between"),
    )


def net_position(reports: DataFrame) -> DataFrame:
    """Net of weekly long and short, week change, and rank among the last 8 reports.

    Columns in: series, day, long, short. The percentile needs four reports and
    scales the newest net from 0 (lowest) to 100 (highest).
    """
    w = _by_day()
    eight = w.rowsBetween(-7, Window.currentRow)
    net = reports.withColumn("net", F.col("long") - F.col("short")).withColumn(
        "_last8", F.collect_list("net").over(eight)
    )
    below = F.size(F.filter("_last8", lambda x: x < F.col("net")))
    return net.select(
        "series",
        "day",
        "net",
        (F.col("net") - F.lag("net").over(w)).alias("week_change"),
        F.size("_last8").alias("window_reports"),
        F.when(
            F.size("_last8") >= 4, F.round(100.0 * below / (F.size("_last8") - 1), 1)
        ).alias("percentile_in_window"),
    )


def extremes(daily: DataFrame, now: datetime, spans: tuple[int, ...] = (7, 30)) -> DataFrame:
    """Lowest and highest daily value in each trailing span with two days or more."""
    aggs = []
    for n in spans:
        recent = F.col("ts") >= F.lit(now) - F.expr(f"INTERVAL '{n}' DAY")
        value = F.when(recent, F.col("value"))
        aggs.append(
            F.struct(
                F.lit(n).alias("days"),
                F.min(value).alias("low"),
                F.max(value).alias("high"),
                F.count(value).alias("n"),
            )
        )
    wide = daily.groupBy("series").agg(F.array(*aggs).alias("spans"))
    return wide.select("series", F.inline("spans")).filter(F.col("n") >= 2)


def trend(daily: DataFrame) -> DataFrame:
    """Rendered history and percent direction, for series with two days or more."""
    point = F.concat_ws(" ", F.date_format("day", "MM-dd"), grouped(F.col("value"), 2))
    points = F.sort_array(F.collect_list(F.struct("day", point.alias("text"))))
    first, last = F.min_by("value", "day"), F.max_by("value", "day")
    return (
        daily.groupBy("series")
        .agg(
            F.count("*").alias("days"),
            change_pct(last, first).alias("direction_pct"),
            F.array_join(F.transform(points, lambda p: p["text"]), " | ").alias("rendered"),
        )
        .filter(F.col("days") >= 2)
    )


def align(readings: DataFrame, names: list[str], minutes: int) -> DataFrame:
    """One row per tick with the latest value of every named series up to it."""
    ticks = tick_series(readings.filter(F.col("series").isin(*names)), minutes)
    wide = ticks.groupBy("tick").agg(
        *[F.max(F.when(F.col("series") == n, F.col("value"))).alias(f"_{n}") for n in names]
    )
    stamped = wide.withColumn("ts", F.timestamp_seconds("tick"))
    # Ticks bound the rows of a day.
    return carry_forward(stamped, [], "ts", ["tick"], {n: f"_{n}" for n in names}).select("ts", *names)


def priority_value(readings: DataFrame) -> DataFrame:
    """First non-null value of a series in source order, per run.

    Columns in: run_id, series, source_priority, value, id.
    """
    return (
        readings.filter(F.col("value").isNotNull())
        .groupBy("run_id", "series")
        .agg(
            F.min_by(
                F.struct("value", "source", "source_priority"), F.struct("source_priority", "id")
            ).alias("r")
        )
        .select("run_id", "series", "r.*")
    )


def front_month(contracts: DataFrame) -> DataFrame:
    """Contract with the nearest readable expiry per symbol; unreadable ones sort last.

    Columns in: symbol, expiry (date or null), expiry_text, price, id.
    """
    order = F.struct(F.coalesce("expiry", F.lit("9999-12-31").cast("date")), "expiry_text", "id", "price")
    return (
        contracts.groupBy("symbol")
        .agg(F.min_by(F.struct("expiry_text", "price"), order).alias("r"))
        .select("symbol", "r.*")
    )


def exact_median(df: DataFrame, value: str, keys: tuple[str, ...] = (), bins: float = 1.0) -> DataFrame:
    """Exact median with min, max and count, without gathering a group in one task.

    Equal values are counted first, then counted again by bin of width `bins`. Only
    the bins that hold the middle ranks are opened. The value band bounds the number
    of bins, its precision the number of values in one.
    """
    keys = list(keys)
    base = df.select(*(keys or [F.lit(0).alias("_all")]), F.col(value).alias("_v"))
    keys = keys or ["_all"]
    counts = base.groupBy(*keys, "_v").agg(F.count("*").alias("_n"))
    per_bin = counts.groupBy(*keys, F.floor(F.col("_v") / F.lit(bins)).alias("_bin")).agg(
        F.sum("_n").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")
    )
    w = Window.partitionBy(*keys)
    up_to = w.orderBy("_bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = per_bin.select(
        *keys,
        "_bin",
        F.sum("_n").over(w).alias("n"),
        F.min("_lo").over(w).alias("min_value"),
        F.max("_hi").over(w).alias("max_value"),
        (F.sum("_n").over(up_to) - F.col("_n")).alias("_before"),
        F.sum("_n").over(up_to).alias("_after"),
    )
    low_rank, high_rank = F.floor((F.col("n") + 1) / 2), F.floor((F.col("n") + 2) / 2)
    middle = ranked.filter(
        ((F.col("_before") < low_rank) & (F.col("_after") >= low_rank))
        | ((F.col("_before") < high_rank) & (F.col("_after") >= high_rank))
    )
    opened = counts.withColumn("_bin", F.floor(F.col("_v") / F.lit(bins))).join(
        middle, [*keys, "_bin"]
    )
    inside = Window.partitionBy(*keys, "_bin").orderBy("_v").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    at = opened.withColumn("_to", F.col("_before") + F.sum("_n").over(inside)).withColumn(
        "_from", F.col("_to") - F.col("_n")
    )
    pick = lambda rank: F.max(F.when((F.col("_from") < rank) & (F.col("_to") >= rank), F.col("_v")))
    out = at.groupBy(*keys, "n", "min_value", "max_value").agg(
        ((pick(low_rank) + pick(high_rank)) / 2).alias("median_value")
    )
    return out.drop("_all")
