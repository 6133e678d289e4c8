"""Spend guard and control events against plain walks; health rules."""

from __future__ import annotations

import random
from collections import defaultdict
from datetime import date, datetime, timedelta

import pytest

from tidemark.operators import control, ledger
from tidemark.operators.headlines import mark_new
from tidemark.operators.health import source_health
from tidemark.rules import Prices

T0 = datetime(2026, 8, 17)


@pytest.mark.parametrize("seed", [1, 2])
def test_spend_guard_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(1200):
        day = date(2026, 8, 1) if rng.random() < 0.6 else date(2026, 8, rng.randrange(2, 6))
        est = rng.choice([30_000, 31_000, 60_000, 90_000, 140_000, 260_000])
        rows.append((i, day, est, rng.randrange(1, est)))
    prices = Prices(daily_cap_micro=1_500_000)
    spent, want = defaultdict(int), {}
    for i, day, est, cost in rows:
        if est > prices.per_run_cap_micro:
            want[i] = "per_run"
        elif spent[day] + est > prices.daily_cap_micro:
            want[i] = "daily"
        else:
            want[i] = "allowed"
            spent[day] += cost
    df = spark.createDataFrame(rows, "call_id bigint, day date, projected bigint, cost bigint")
    got = {r["call_id"]: r["outcome"] for r in ledger.spend_guard(df, prices, rows_per_part=50).collect()}
    assert got == want and set(want.values()) == {"per_run", "daily", "allowed"}


def test_spend_guard_starts_from_what_is_booked(spark):
    day = date(2026, 8, 1)
    prices = Prices(daily_cap_micro=100)
    calls = [(i, day, 30, 25) for i in range(5)] + [(9, date(2026, 8, 2), 30, 25)]
    df = spark.createDataFrame(calls, "call_id bigint, day date, projected bigint, cost bigint")
    prior = spark.createDataFrame([(day, 20), (day, 15)], "day date, cost_micro bigint")
    got = {r["call_id"]: r["outcome"] for r in ledger.spend_guard(df, prices, prior=prior).collect()}
    assert got == {0: "allowed", 1: "allowed", 2: "daily", 3: "daily", 4: "daily", 9: "allowed"}


def test_calls_without_cost_gather_nowhere(spark):
    calls = [(i, date(2026, 8, 1), 0 if i % 100 else 40, 0 if i % 100 else 40) for i in range(5000)]
    df = spark.createDataFrame(calls, "call_id bigint, day date, projected bigint, cost bigint")
    out = ledger.spend_guard(df, Prices(daily_cap_micro=100))
    assert out.groupBy("outcome").count().orderBy("outcome").collect() == [("allowed", 4952), ("daily", 48)]
    assert "collect_list" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_control_events(spark):
    said = [
        (1, "/set 1,18,000 above - trim"), (1, "/set 118000 below"), (1, "/unset - 118000"), (1, "/set 118000 under later"),
        (1, "/set 5"), (1, "/mute 90m"), (1, "/mute soon"), (2, "/mute 99h"), (2, "/set 90000"), (3, "/mute 4h"), (3, "/unmute"),
        (9, "/set 90000"), (2, "hello"),
    ]
    events = spark.createDataFrame(
        [(s, i, T0 + timedelta(minutes=i), t) for i, (s, t) in enumerate(said)], "subscriber bigint, seq bigint, ts timestamp, text string"
    )
    known = spark.createDataFrame([(1,), (2,), (3,)], "subscriber bigint")
    parsed = control.parse(events, known)
    levels = {(r["subscriber"], r["value"]): (r["direction"], r["note"]) for r in control.current_levels(parsed).collect()}
    assert levels == {(1, 118_000.0): ("below", "later"), (2, 90_000.0): ("either", "")}
    mutes = {r["subscriber"]: r["until_ts"] - r["from_ts"] for r in control.current_mutes(parsed).collect()}
    assert mutes == {1: timedelta(minutes=90), 2: timedelta(hours=24)}


def test_notes_alone_are_degraded(spark):
    cols = "run_id string, source string, ok boolean, error string, n_readings bigint, n_headlines bigint, n_notes bigint"
    rows = [("r", f"s{i}", True, None, 0, 0, 1) for i in range(12)] + [("q", f"s{i}", i > 0, None, 1, 0, 0) for i in range(7)]
    got = {r["run_id"]: r for r in source_health(spark.createDataFrame(rows, cols), 6).collect()}
    assert got["r"]["degraded"] and got["r"]["ok_count"] == 12 and got["r"]["data_count"] == 0
    assert not got["q"]["degraded"] and got["q"]["failed"] == "s0"


def test_same_url_twice_in_a_batch_is_new_both_times(spark):
    batch = spark.createDataFrame([("u",), ("u",), ("k",)], "url string")
    known = spark.createDataFrame([("k",)], "url string")
    assert sorted((r["url"], r["is_new"]) for r in mark_new(batch, known, "url").collect()) == [("k", False), ("u", True), ("u", True)]
