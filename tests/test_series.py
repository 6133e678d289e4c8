"""As-of, medians and series jobs against plain Python, with buckets cut very fine."""

from __future__ import annotations

import random
import statistics
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators.asof import busy_days, cut_in_buckets, rolling_baseline, window_baseline
from tidemark.operators.series import daily_series, exact_median, extremes, latest_reading, net_position
from tidemark.operators.triggers import move_candidates
from tidemark.rules import MoveRule, move_rule_table

T0 = datetime(2026, 8, 17, 6, 0)


def readings(spark, rows):
    return spark.createDataFrame(
        [(i, s, t, v, "src") for i, (s, t, v) in enumerate(rows)],
        "id bigint, series string, ts timestamp, value double, source string",
    )


@pytest.mark.parametrize("bucket_rows", [1, 10, 50, None])
def test_window_baseline_brute_force(spark, bucket_rows):
    rng = random.Random(7)
    # One series holds most rows and several share an instant.
    rows = [("hot", T0 + timedelta(seconds=rng.randrange(4000)), float(i)) for i in range(300)]
    rows += [("cold", T0 + timedelta(seconds=rng.randrange(40_000)), float(i)) for i in range(20)]
    rows += [("cold", T0, None)]
    df = readings(spark, rows)
    probes = df.withColumn("window_hours", F.lit(0.25))
    busy = None if bucket_rows is None else busy_days(df, ["series"], "ts", bucket_rows)
    out = window_baseline(probes, df, busy).collect()
    assert len(out) == len(rows)
    same = df.withColumn("windows", F.array(F.struct(F.lit(0.25).alias("window_hours"), F.lit("x").alias("tag"))))
    by_scan = {r["id"]: r["baseline"] for r in rolling_baseline(same, "windows", busy).collect()}
    assert by_scan == {r["id"]: r["baseline"] for r in out if r["value"] is not None}
    data = [(s, t, i, v) for i, (s, t, v) in enumerate(rows) if v is not None]
    for r in out:
        s, t, _v = rows[r["id"]]
        mine = sorted(x for x in data if x[0] == s)
        before = [x for x in mine if x[1] <= t - timedelta(minutes=15)]
        want = before[-1] if before else mine[0]
        assert r["baseline"]["id"] == want[2]


def test_baseline_examples(spark):
    def base(rows, now):
        df = readings(spark, [("s", now - timedelta(hours=h), v) for h, v in rows])
        probe = spark.createDataFrame([("s", now, 4.0)], "series string, ts timestamp, window_hours double")
        return window_baseline(probe, df).first()["baseline"]

    assert base([(6, 100.0), (2, 110.0)], T0)["value"] == 100.0
    assert base([(3, 105.0), (1, 110.0)], T0)["value"] == 105.0
    assert base([(4, 90.0), (1, 110.0)], T0)["value"] == 90.0  # the bound itself counts


def test_a_spike_cuts_its_own_day_and_series_alone(spark):
    calm = [(s, T0 + timedelta(hours=h), 1.0) for s in ("a", "b") for h in range(0, 24 * 10, 6)]
    spike = [("a", T0 + timedelta(days=3, seconds=3.6 * i), 1.0) for i in range(1000)]

    def buckets(rows, bucket_rows=100):
        df = readings(spark, rows)
        cut = cut_in_buckets(df, ["series"], "ts", busy_days(df, ["series"], "ts", bucket_rows))
        found = cut.groupBy("series", "_bucket").count().collect()
        return {s: {r["_bucket"]: r["count"] for r in found if r["series"] == s} for s in ("a", "b")}

    before, after = buckets(calm), buckets(calm + spike)
    assert after["b"] == before["b"] and len(before["b"]) == 11
    # All other days of the series stay whole; those of the spike hold no more rows than asked for.
    day = 86_400_000_000
    hot = {b // day for b, n in after["a"].items() if before["a"].get(b) != n}
    assert len(hot) == 1 and set(before["a"]) - set(after["a"]) <= {d * day for d in hot}
    assert max(after["a"].values()) <= 102 and len(after["a"]) <= len(before["a"]) + 15
    assert busy_days(readings(spark, calm), ["series"], "ts").isEmpty()


def test_daily_series_uses_local_days(spark):
    # 02:00, 14:00 and 22:00 local of one day, the first one before UTC midnight.
    utc = [datetime(2026, 8, 16, 20, 30), datetime(2026, 8, 17, 8, 30), datetime(2026, 8, 17, 16, 30)]
    df = readings(spark, [("s", t, v) for t, v in zip(utc, (100.0, 105.0, 103.0), strict=True)])
    got = daily_series(df, "Asia/Kolkata").collect()
    assert [(r["day"].isoformat(), r["value"]) for r in got] == [("2026-08-17", 103.0)]


def test_extremes_need_two_days(spark):
    df = readings(spark, [("s", T0 - timedelta(days=20), 5.0), ("s", T0 - timedelta(days=1), 7.0), ("s", T0, 9.0)])
    got = {r["days"]: (r["low"], r["high"]) for r in extremes(daily_series(df, "UTC"), T0).collect()}
    assert got == {7: (7.0, 9.0), 30: (5.0, 9.0)}
    single = readings(spark, [("s", T0, 9.0)])
    assert extremes(daily_series(single, "UTC"), T0).count() == 0


@pytest.mark.parametrize("n", [1, 2, 7, 50, 51])
def test_exact_median(spark, n):
    rng = random.Random(n)
    values = [round(rng.choice([rng.uniform(5, 9), rng.uniform(100, 2000), 50.0]), 2) for _ in range(n)]
    got = exact_median(spark.createDataFrame([(v,) for v in values], "v double"), "v").first()
    assert got["median_value"] == statistics.median(values)
    assert (got["n"], got["min_value"], got["max_value"]) == (n, min(values), max(values))


def test_net_position_example(spark):
    longs = [170100, 176900, 185400, 198220, 215430]
    shorts = [64800, 61200, 57330, 52110, 48210]
    days = [f"2026-07-{d}" for d in (14, 21, 28)] + ["2026-08-04", "2026-08-11"]
    df = spark.createDataFrame(
        list(zip(days, longs, shorts, strict=True)), "d string, long bigint, short bigint"
    ).select(F.lit("g").alias("series"), F.to_date("d").alias("day"), "long", "short")
    last = net_position(df).orderBy(F.desc("day")).first()
    assert (last["net"], last["week_change"], last["percentile_in_window"]) == (167220, 21110, 100.0)
    third = net_position(df).orderBy("day").collect()[2]
    assert third["percentile_in_window"] is None


@pytest.mark.parametrize(
    ("kind", "base", "now", "threshold", "fires"),
    [
        ("pct", 3000.0, 3000 * 1.017, 1.2, True), ("pct", 3000.0, 3000 * 1.009, 1.2, False),
        ("bp", 1.900, 1.800, 8.0, True), ("bp", 1.900, 1.85, 8.0, False),
        ("abs", 80.0, 82.0, 2.0, True), ("pp", 40.0, 49.9, 10.0, False), ("pct", 0.0, 5.0, 1.2, False),
    ],
)
def test_move_rules(spark, kind, base, now, threshold, fires):
    df = readings(spark, [("s", T0 - timedelta(hours=30), base), ("s", T0, now)])
    rules = move_rule_table(spark, (MoveRule("t", "s", kind, 24, threshold), MoveRule("off", "s", kind, 24, 0.0, False)))
    got = [r for r in move_candidates(df, rules).collect() if r["ts"] == T0]
    assert bool(got) is fires
    if fires:
        assert got[0]["severity"] == pytest.approx(abs(got[0]["move"]) / threshold)


def test_latest_ignores_nulls(spark):
    df = readings(spark, [("s", T0, 1.0), ("s", T0 + timedelta(hours=1), None)])
    assert latest_reading(df).first()["value"] == 1.0
