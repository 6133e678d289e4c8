"""The gate and the levels against a plain walk of the same rules."""

from __future__ import annotations

import random
from collections import Counter, defaultdict
from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from tidemark.operators.gate import alert_gate, gated_fires, walked
from tidemark.operators.levels import level_crossings, level_runs, level_union, levels_hit, price_edges
from tidemark.rules import Gate

T0 = datetime(2026, 8, 17, 0, 0, tzinfo=UTC)
TZ = ZoneInfo("Asia/Kolkata")
COLS = "id bigint, subscriber bigint, trigger string, ts timestamp, severity double"


def tick_of(ts, minutes=30):
    s = int(ts.timestamp())
    return s - s % (minutes * 60)


def local(tick):
    return datetime.fromtimestamp(tick, TZ)


def walk(cands, gate, mutes=(), prior=(), levels=(), prices=()):
    """Plain walk: {id: outcome} of candidates and the fired level events."""
    outcome, shots = {}, []
    last, sent = defaultdict(dict), defaultdict(int)
    for sub, tick, trigger in prior:
        last[sub][trigger] = max(tick, last[sub].get(trigger, 0))
        sent[sub, local(tick).date()] += 1
    hits = defaultdict(set)
    events = defaultdict(list)
    for c in cands:
        events[tick_of(c[3])].append(c)
    ticks = sorted(set(events) | ({t for t, _ in prices} if levels else set()))
    price = dict(prices)
    for tick in ticks:
        subs = {c[1] for c in events[tick]} | ({lv[0] for lv in levels} if tick in price else set())
        for sub in sorted(subs):
            todo = [(-c[4], c[0], c[2], None) for c in events[tick] if c[1] == sub]
            if tick in price:
                for n, (owner, value, direction) in enumerate(levels):
                    if owner != sub:
                        continue
                    p, h, margin, fired = price[tick], hits[sub, value], value * 0.005, None
                    for side, crossed, gone in (
                        ("above", p >= value, p < value - margin), ("below", p <= value, p > value + margin),
                    ):
                        if direction not in (side, "either"):
                            continue
                        if not crossed:
                            if side in h and gone:
                                h.clear()
                            continue
                        if side in h:
                            continue
                        fired = side
                        break
                    if fired:
                        todo.append((-10.0, 10**9 + n, "inr_price_levels", (value, fired)))
            m = local(tick).hour * 60 + local(tick).minute
            muted = any(s == sub and a <= tick < b for s, a, b in mutes)
            for _sev, ident, trigger, level in sorted(todo, key=lambda x: (x[0], x[1])):
                cool = gate.cooldown_seconds(trigger)
                before = last[sub].get(trigger)
                day = (sub, local(tick).date())
                if muted:
                    result = "muted"
                elif gate.quiet_from <= m < gate.quiet_to:
                    result = "quiet"
                elif before is not None and tick - before < cool:
                    result = "cooldown"
                elif sent[day] >= gate.max_per_day:
                    result = "budget"
                else:
                    result = "fired"
                    last[sub][trigger] = tick
                    sent[day] += 1
                    if level:
                        hits[sub, level[0]].add(level[1])
                        shots.append((sub, tick, *level))
                if level is None:
                    outcome[ident] = result
    return outcome, shots


def make(n, subs, seed, days=3):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        sub = 0 if rng.random() < 0.5 else rng.randrange(subs)  # subscriber 0 is hot
        ts = T0 + timedelta(seconds=rng.randrange(days * 86_400))
        out.append((i, sub, rng.choice("abcd"), ts, rng.choice([1.0, 1.5, round(rng.uniform(1, 20), 2)])))
    return out


def run(spark, cands, gate, mutes=(), prior=()):
    df = spark.createDataFrame(cands, COLS)
    m = (
        spark.createDataFrame(
            [(s, datetime.fromtimestamp(a, UTC), datetime.fromtimestamp(b, UTC)) for s, a, b in mutes],
            "subscriber bigint, from_ts timestamp, until_ts timestamp",
        )
        if mutes
        else None
    )
    p = spark.createDataFrame(prior, "subscriber bigint, tick bigint, trigger string") if prior else None
    return {r["id"]: r["outcome"] for r in alert_gate(df, gate, m, p).collect()}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_gate_brute_force(spark, seed):
    cands = make(1500, 6, seed)
    gate = Gate(cooldowns={"a": 1.0, "b": 12.0})
    base = int(T0.timestamp())
    mutes = [(0, base + 40_000, base + 50_001), (2, base + 100, base + 90_000)]
    prior = [(0, base - 1800, "b"), (1, base - 7200, "a"), (0, base - 3600, "c")]
    want, _ = walk(cands, gate, mutes, prior)
    assert run(spark, cands, gate, mutes, prior) == want
    assert set(want.values()) == {"fired", "muted", "quiet", "cooldown", "budget"}


def test_trigger_without_cooldown(spark):
    cands = make(400, 3, 9)
    gate = Gate(max_per_day=5, cooldowns={"a": 0.0, "b": 0.25})
    want, _ = walk(cands, gate)
    assert run(spark, cands, gate) == want


def test_invariants(spark):
    cands = make(2000, 4, 5)
    gate = Gate(cooldown_hours=6)
    got = run(spark, cands, gate)
    fired = defaultdict(list)
    for i, sub, trigger, ts, _s in cands:
        if got[i] == "fired":
            fired[sub].append((tick_of(ts), trigger))
    for rows in fired.values():
        per_day, per_trigger = defaultdict(int), defaultdict(list)
        for tick, trigger in rows:
            per_day[local(tick).date()] += 1
            per_trigger[trigger].append(tick)
        assert max(per_day.values()) <= 3
        for ticks in per_trigger.values():
            ticks.sort()
            assert all(b - a >= 6 * 3600 for a, b in zip(ticks, ticks[1:], strict=False))


def test_budget_goes_to_the_most_severe(spark):
    noon = T0 + timedelta(hours=6)
    cands = [(1, 1, "a", noon, 1.17), (2, 1, "b", noon, 5.0)]
    assert run(spark, cands, Gate(max_per_day=1)) == {1: "budget", 2: "fired"}


def test_budget_resets_at_local_midnight(spark):
    # 18:30 UTC is midnight in the zone.
    cands = [(1, 1, "a", T0 + timedelta(hours=18), 2.0), (2, 1, "b", T0 + timedelta(hours=18, minutes=30), 2.0)]
    assert run(spark, cands, Gate(max_per_day=1)) == {1: "fired", 2: "fired"}


def test_disabled_and_dry_run_write_nothing(spark):
    assert run(spark, [(1, 1, "a", T0, 2.0)], Gate(enabled=False)) == {1: "disabled"}


def test_zero_budget(spark):
    assert run(spark, [(1, 1, "a", T0 + timedelta(hours=6), 2.0)], Gate(max_per_day=0)) == {1: "budget"}


LEVELS = "subscriber bigint, value double, direction string, note string, origin string"


def price_ticks(spark, prices, series="p"):
    return spark.createDataFrame([(series, t, p) for t, p in prices], "series string, tick bigint, value double")


@pytest.mark.parametrize("direction", ["above", "below", "either"])
def test_level_crossings_brute_force(spark, direction):
    rng = random.Random(11)
    base, price, prices = int(T0.timestamp()), 100.0, []
    for i in range(300):
        price = max(98.0, min(102.0, price + rng.choice([-1, -0.3, 0, 0.3, 1])))
        prices.append((base + i * 1800, round(price, 1)))
    free = Gate(max_per_day=10**6, cooldown_hours=0, quiet_from=0, quiet_to=0, cooldowns={})
    _, want = walk([], free, levels=[(1, 100.0, direction)], prices=prices)
    levels = spark.createDataFrame([(1, 100.0, direction, "", "config")], LEVELS).withColumn("series", F.lit("p"))
    got = level_crossings(price_ticks(spark, prices), levels).collect()
    assert sorted((r["subscriber"], int(r["ts"].replace(tzinfo=UTC).timestamp()), r["level"], r["direction"]) for r in got) == sorted(want)
    assert len(want) > 5


def test_a_price_far_from_all_others_moves_no_bucket(spark):
    rng = random.Random(4)
    base, values = int(T0.timestamp()), [round(90 + i * 0.2, 1) for i in range(100)]
    prices = [(base + i * 1800, round(rng.uniform(90, 110), 1)) for i in range(200)]
    prices[77] = (prices[77][0], 1e9)
    free = Gate(max_per_day=10**6, cooldown_hours=0, quiet_from=0, quiet_to=0, cooldowns={})
    _, want = walk([], free, levels=[(1, v, "either") for v in [*values, 1e9]], prices=prices)
    levels = spark.createDataFrame([(1, v, "either", "", "config") for v in [*values, 1e9]], LEVELS).withColumn("series", F.lit("p"))
    got = level_crossings(price_ticks(spark, prices), levels).collect()
    assert sorted((r["subscriber"], int(r["ts"].replace(tzinfo=UTC).timestamp()), r["level"], r["direction"]) for r in got) == sorted(want)
    edges = price_edges(levels.select("series", F.col("value").alias("level"))).first()["edges"]
    held = Counter(sum(e <= v for e in edges) for v in values)
    assert max(held.values()) <= 3  # of 101 levels over 64 buckets


def test_level_example(spark):
    base = int(T0.timestamp())
    levels = spark.createDataFrame([(1, 100_000.0, "above", "", "config")], LEVELS).withColumn("series", F.lit("p"))

    def fired(*prices):
        ticks = price_ticks(spark, [(base + i * 1800, float(p)) for i, p in enumerate(prices)])
        return level_crossings(ticks, levels).count(), levels_hit(ticks, levels).count()

    assert fired(101_000, 102_000) == (1, 1)
    assert fired(101_000, 99_750, 100_500) == (1, 1)
    assert fired(101_000, 99_400) == (1, 0)
    assert fired(101_000, 99_400, 100_500) == (2, 1)


@pytest.mark.parametrize("seed", [21, 22])
def test_gated_levels_brute_force(spark, seed):
    rng = random.Random(seed)
    cands = make(300, 4, seed)
    base, prices = int(T0.timestamp()), []
    for i in range(144):
        prices.append((base + i * 1800, rng.choice([95.0, 99.4, 99.8, 100.0, 100.2, 100.8, 105.0])))
    levels = [(0, 100.0, "either"), (0, 103.0, "above"), (1, 100.0, "below"), (2, 97.0, "either")]
    gate = Gate(max_per_day=4, cooldown_hours=2, cooldowns={"inr_price_levels": 3.0})
    mutes = [(1, base + 20_000, base + 60_000)]
    want, shots = walk(cands, gate, mutes, levels=sorted(levels, key=lambda x: x[1]), prices=prices)
    lv = spark.createDataFrame([(s, v, d, "", "config") for s, v, d in levels], LEVELS).withColumn("series", F.lit("p"))
    watched = level_runs(price_ticks(spark, prices), lv, gate)
    df = spark.createDataFrame(cands, COLS)
    m = spark.createDataFrame(
        [(s, datetime.fromtimestamp(a, UTC), datetime.fromtimestamp(b, UTC)) for s, a, b in mutes],
        "subscriber bigint, from_ts timestamp, until_ts timestamp",
    )
    fires = gated_fires(df, gate, m, level_runs=watched).filter("level IS NOT NULL").collect()
    assert sorted((r["subscriber"], r["tick"], r["level"], r["direction"]) for r in fires) == sorted(shots)
    got = {r["id"]: r["outcome"] for r in alert_gate(df, gate, m, level_runs=watched).collect()}
    assert got == want
    assert shots


@pytest.mark.parametrize("seed", [31, 32])
def test_subscribers_share_the_runs_of_a_level(spark, seed):
    rng = random.Random(seed)
    subs, base, price, prices = 40, int(T0.timestamp()), 100.0, []
    cands = make(600, subs, seed, days=6)
    for i in range(288):
        price = max(95.0, min(105.0, price + rng.choice([-2, -0.4, 0, 0, 0.4, 2])))
        if rng.random() < 0.9:
            prices.append((base + i * 1800, round(price, 1)))
    levels = [(s, v, d) for s in range(subs) for v, d in ((100.0, "either"), (rng.choice([98.0, 101.0, 103.6]), rng.choice(["above", "below", "either"])))]
    levels += [(s, 97.0, d) for s in (3, 9) for d in ("above", "below")]
    gate = Gate(max_per_day=3, cooldown_hours=2, cooldowns={"inr_price_levels": 2.5})
    mutes = [(s, base + 7_000 * s, base + 7_000 * s + 50_000) for s in (1, 3, 20)]
    want, shots = walk(cands, gate, mutes, levels=sorted(levels, key=lambda x: x[1]), prices=prices)
    made = lambda some: spark.createDataFrame([(s, v, d, "", "config") for s, v, d in some], LEVELS).withColumn("series", F.lit("p"))
    watched = level_runs(price_ticks(spark, prices), made(levels), gate)
    m = spark.createDataFrame(
        [(s, datetime.fromtimestamp(a, UTC), datetime.fromtimestamp(b, UTC)) for s, a, b in mutes],
        "subscriber bigint, from_ts timestamp, until_ts timestamp",
    )
    df = spark.createDataFrame(cands, COLS)
    got = {}
    for told in (True, False):
        out = walked(df, gate, m, level_runs=watched, told=told).collect()
        fired = [r for r in out if r["what"] == "fired"]
        assert sorted((r["subscriber"], r["tick"], r["level"], r["direction"]) for r in fired if r["level"]) == sorted(shots)
        assert {r["id"] for r in fired if not r["level"]} == {k for k, v in want.items() if v == "fired"}
        got[told] = sorted((r["subscriber"], r["level"], r["mask"]) for r in out if r["what"] == "hit")
    assert got[True] == got[False]
    assert len(shots) > 100
    # What goes into the walk does not grow as subscribers times runs.
    one = level_runs(price_ticks(spark, prices), made({(1, v, d) for _, v, d in levels}), gate)
    assert watched.days.count() == one.days.count()
    assert watched.holders.count() == len(levels)


def test_two_series_with_equal_levels_keep_apart(spark):
    base = int(T0.timestamp())
    ticks = price_ticks(spark, [(base, 110.0), (base + 1800, 110.0)], "a").unionByName(
        price_ticks(spark, [(base, 110.0), (base + 1800, 90.0)], "b")
    )
    levels = spark.createDataFrame([(1, 100.0, "above", "", "config", s) for s in "ab"], LEVELS + ", series string")
    got = sorted((r["series"], r["level"], r["direction"]) for r in level_crossings(ticks, levels).collect())
    assert got == [("a", 100.0, "above"), ("b", 100.0, "above")]
    assert [r["series"] for r in levels_hit(ticks, levels).collect()] == ["a"]
    gate = Gate(cooldown_hours=0, quiet_from=0, quiet_to=0)
    out = walked(spark.createDataFrame([], COLS), gate, level_runs=level_runs(ticks, levels, gate)).collect()
    assert sorted(r["series"] for r in out if r["what"] == "fired") == ["a", "b"]
    assert [(r["series"], r["mask"]) for r in out if r["what"] == "hit"] == [("a", 1)]


def test_stored_hits_and_held_levels(spark):
    base = int(T0.timestamp()) + 6 * 3600
    ticks = price_ticks(spark, [(base + i * 1800, 101.0) for i in range(10)])
    levels = spark.createDataFrame([(1, 100.0, "above", "", "config"), (1, 99.0, "above", "", "config")], LEVELS).withColumn("series", F.lit("p"))
    gate, none = Gate(max_per_day=1), spark.createDataFrame([], COLS)
    hits = spark.createDataFrame([(1, "p", 99.0, 1), (7, "p", 5.0, 2)], "subscriber bigint, series string, level double, mask int")
    out = walked(none, gate, level_runs=level_runs(ticks, levels, gate), prior_hits=hits).collect()
    assert [r["level"] for r in out if r["what"] == "fired"] == [100.0]
    assert sorted((r["subscriber"], r["level"], r["mask"]) for r in out if r["what"] == "hit") == [(1, 99.0, 1), (1, 100.0, 1), (7, 5.0, 2)]
    out = walked(none, gate, level_runs=level_runs(ticks, levels, gate)).collect()
    assert [(r["level"], r["reason"]) for r in out if r["what"] == "held"] == [(100.0, "cooldown")]
    assert [r["level"] for r in out if r["what"] == "fired"] == [99.0]


@pytest.mark.parametrize("shape", ["crossings", "gated"])
def test_levels_are_joined_by_equality(spark, shape):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        ticks = price_ticks(spark, [(i * 1800, float(90 + i % 20)) for i in range(40)])
        levels = spark.createDataFrame([(s, 95.0 + s % 7, "either", "", "config") for s in range(60)], LEVELS).withColumn("series", F.lit("p"))
        df = level_crossings(ticks, levels) if shape == "crossings" else alert_gate(spark.createDataFrame([], COLS), Gate(), level_runs=level_runs(ticks, levels, Gate()))
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    assert plan.count("MapInArrow") == 1


def test_level_union_prefers_config(spark):
    conf = spark.createDataFrame([(1, 100.0, "above", "x")], "subscriber bigint, value double, direction string, note string")
    added = spark.createDataFrame(
        [(1, 100.0, "below", "y"), (1, 90.0, "either", "")], "subscriber bigint, value double, direction string, note string"
    )
    got = {r["value"]: (r["direction"], r["origin"]) for r in level_union(conf, added).collect()}
    assert got == {100.0: ("above", "config"), 90.0: ("either", "added")}


def test_walker_travels_without_the_package(tmp_path):
    import os
    import subprocess
    import sys

    from pyspark import cloudpickle

    from tidemark.operators.walk import _walker

    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    code = "import sys; from pyspark import cloudpickle; assert list(cloudpickle.loads(sys.stdin.buffer.read())(iter([]))) == []"
    done = subprocess.run([sys.executable, "-c", code], input=cloudpickle.dumps(_walker(3, 1800)), cwd=tmp_path, env=env, check=False, capture_output=True)
    assert done.returncode == 0, done.stderr.decode()
