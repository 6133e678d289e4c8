"""The watch job: successive runs, failing rules, levels, retention."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.plans.watch import conflict_watch, expire, move_watch, standard_rules, watch_run
from tidemark.rules import DEFAULT_MOVE_RULES, ConflictRule, Gate, MoveRule, budget_table, limit_table, order_table, season_table
from tidemark.sources import sinks

T0 = datetime(2027, 2, 1)
COLS = "id bigint, series string, ts timestamp, value double"


def prices(n=240):
    return [(i, "p", T0 + timedelta(minutes=30 * i), 100.0 + (7 * i % 13) - 6) for i in range(n)]


def feed(spark, home, rows):
    sinks.append_readings(spark.createDataFrame(rows, COLS), f"{home}/readings")


def run_all(spark, home, rows, cuts, gate, levels=None):
    jobs = {"m": move_watch(MoveRule("m", "p", "pct", 4, 6.0))}
    who = spark.createDataFrame([(1, "m"), (2, "m")], "subscriber bigint, trigger string")
    edges = [T0, *cuts, T0 + timedelta(days=30)]
    for run, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        feed(spark, home, [r for r in rows if a <= r[2] < b])
        watch_run(spark, home, run, a, b, jobs, gate, who, levels=levels)
    cols = ("subscriber", "tick", "trigger", "id", "series", "level", "direction")
    return sorted((tuple(r[c] for c in cols) for r in spark.read.parquet(f"{home}/alert_log").collect()), key=str)


@pytest.mark.parametrize("with_levels", [False, True])
def test_successive_runs_give_what_one_gives(spark, tmp_path, with_levels):
    gate = Gate(cooldowns={"m": 5.0, "inr_price_levels": 3.0})
    levels = spark.createDataFrame(
        [(1, "p", 101.0, "either", "config"), (2, "p", 104.0, "above", "added"), (3, "p", 95.0, "below", "added")],
        "subscriber bigint, series string, value double, direction string, origin string",
    ) if with_levels else None
    one = run_all(spark, str(tmp_path / "one"), prices(), [], gate, levels)
    three = run_all(spark, str(tmp_path / "three"), prices(), [T0 + timedelta(hours=31), T0 + timedelta(hours=70, minutes=30)], gate, levels)
    assert one == three and len(one) > 10
    assert with_levels == any(r[5] is not None for r in one)


def test_a_failing_rule_leaves_the_others(spark, tmp_path):
    home = str(tmp_path)
    feed(spark, home, prices())

    def late(spark, home, since, until):
        out = move_watch(MoveRule("late", "p", "pct", 4, 6.0))(spark, home, since, until)
        return out.withColumn("severity", F.raise_error(F.lit("bad row")).cast("double"))

    jobs = {"late": late, "none": conflict_watch(ConflictRule(), ("a",), ("d",), 30), "m": move_watch(MoveRule("m", "p", "pct", 4, 6.0))}
    who = spark.createDataFrame([(1, "m"), (1, "late")], "subscriber bigint, trigger string")
    out = {r["rule"]: r for r in watch_run(spark, home, 0, T0, T0 + timedelta(days=9), jobs, Gate(), who).collect()}
    assert out["m"]["ok"] and out["m"]["candidates"] > 0
    assert not out["late"]["ok"] and "bad row" in out["late"]["error"]
    assert not out["none"]["ok"] and "headlines" in out["none"]["error"]
    fired = {r["trigger"] for r in spark.read.parquet(f"{home}/alert_log").collect()}
    assert fired == {"m"}


def test_a_repeated_run_changes_nothing(spark, tmp_path):
    home = str(tmp_path)
    first = run_all(spark, home, prices(100), [], Gate())
    jobs = {"m": move_watch(MoveRule("m", "p", "pct", 4, 6.0))}
    who = spark.createDataFrame([(1, "m"), (2, "m")], "subscriber bigint, trigger string")
    watch_run(spark, home, 0, T0, T0 + timedelta(days=30), jobs, Gate(), who)
    cols = ("subscriber", "tick", "trigger", "id", "series", "level", "direction")
    assert sorted((tuple(r[c] for c in cols) for r in spark.read.parquet(f"{home}/alert_log").collect()), key=str) == first


def test_conflict_rule_over_stored_headlines(spark, tmp_path):
    cols = "url string, domain string, source string, published_at timestamp, first_seen timestamp, title string, summary string, keywords array<string>, pos bigint"
    at = T0 + timedelta(hours=5)
    rows = [(f"u{i}", f"d{i}.com", "s", at, at, t, "", [], i) for i, t in enumerate(["embargo", "embargo and blockade", "blockade now"])]
    sinks.upsert_headlines(spark, f"{tmp_path}/headlines", spark.createDataFrame(rows, cols))
    rule = conflict_watch(ConflictRule(), ("embargo", "blockade"), ("d0.com", "d1.com", "d2.com"), 30)
    got = rule(spark, str(tmp_path), T0, T0 + timedelta(hours=6)).collect()
    assert {r["ts"].hour * 60 + r["ts"].minute for r in got} == {300, 330}
    assert {r["severity"] for r in got} == {1.0}


def test_standard_configuration(spark):
    assert set(standard_rules()) == {r.trigger for r in DEFAULT_MOVE_RULES if r.enabled} | {"conflict_escalation"}
    assert budget_table(spark).count() == 7 and limit_table(spark).count() == 3
    assert order_table(spark).orderBy("place").first()["series"] == "real_yield_10y" and season_table(spark).count() == 4


def test_retention(spark, tmp_path):
    feed(spark, str(tmp_path), [(1, "p", T0 - timedelta(days=500), 1.0), (2, "p", T0, 1.0)])
    expire(spark, str(tmp_path), T0 + timedelta(hours=1))
    assert [r["id"] for r in spark.read.parquet(f"{tmp_path}/readings").collect()] == [2]
