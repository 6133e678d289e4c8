"""The keyed gate gives what the batch gate gives, in any order of rows and over a restart."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import control
from tidemark.operators.gate import alert_gate, walked
from tidemark.operators.levels import LEVEL_TRIGGER, level_runs
from tidemark.operators.series import tick_series
from tidemark.rules import Gate
from tidemark.streaming.keyed import ROWS, candidate_rows, control_rows, gate_stream, keyed_state, level_rows, price_rows

T0 = datetime(2026, 8, 17)
GATE = Gate(max_per_day=4, cooldown_hours=2.0, cooldowns={"a": 1.0, "free": 0.0, LEVEL_TRIGGER: 0.5})
FIRED = ["subscriber", "tick", "trigger", "id", "series", "level", "direction"]


@pytest.fixture(autouse=True)
def rocks(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    keyed_state(spark)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    if before is None:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    else:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def tables(spark, seed=4):
    rng = random.Random(seed)
    at = lambda: T0 + timedelta(seconds=rng.randrange(2 * 86_400))
    candidates = spark.createDataFrame(
        [(i, rng.randrange(3), rng.choice(["a", "b", "free"]), at(), float(rng.randrange(1, 14))) for i in range(150)],
        "id bigint, subscriber bigint, trigger string, ts timestamp, severity double",
    )
    price, readings = 100.0, []
    for i in range(150):
        price += rng.uniform(-1.5, 1.5)
        readings.append((i, "gold", T0 + timedelta(minutes=19 * i + rng.randrange(19)), price))
    levels = [(s, "gold", v, d, o) for s, v, d, o in [(0, 99.0, "either", "config"), (0, 101.0, "above", "added"), (1, 98.5, "below", "added"), (5, 100.0, "either", "config")]]
    return (
        candidates,
        spark.createDataFrame(readings, "id bigint, series string, ts timestamp, value double"),
        spark.createDataFrame(levels, "subscriber bigint, series string, value double, direction string, origin string"),
    )


def write_shuffled(rows, path, parts, seed, late_minutes=360):
    """Files of rows that arrive up to some hours after their time; the last holds a far one, which closes all ticks."""
    spark = rows.sparkSession
    got = [tuple(r) for r in rows.select("*").collect()]
    rng = random.Random(seed)
    ts = rows.columns.index("ts")
    got.sort(key=lambda r: r[ts] + timedelta(minutes=rng.uniform(0, late_minutes)))
    size = -(-len(got) // parts)
    for i in range(parts):
        spark.createDataFrame(got[i * size : (i + 1) * size], ROWS).coalesce(1).write.parquet(f"{path}/{i:03d}")


def close(spark, path, name):
    far = T0 + timedelta(days=9)
    heartbeat = spark.createDataFrame([(10**9, far, "gold", 1.0, 1)], "subscriber bigint, ts timestamp, series string, value double, id bigint")
    price_rows(heartbeat.drop("subscriber"), heartbeat.select("subscriber", "series"), GATE).coalesce(1).write.parquet(f"{path}/{name}")


def run(spark, path, out, gate=GATE, lateness="7 hours"):
    source = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(path)
    query = (
        gate_stream(gate, lateness, source).writeStream.format("parquet").option("checkpointLocation", f"{out}/cp")
        .option("path", f"{out}/judged").outputMode("append").trigger(availableNow=True).start()
    )
    query.awaitTermination(240)
    if query.exception():
        raise query.exception()
    return query


def test_shuffled_stream_with_levels_and_a_restart_equals_batch(spark, tmp_path):
    candidates, readings, levels = tables(spark)
    watching = levels.select("subscriber", "series")
    mute = spark.createDataFrame([(1, T0 + timedelta(hours=20), T0 + timedelta(hours=26))], "subscriber bigint, from_ts timestamp, until_ts timestamp")
    said = mute.select("subscriber", F.col("from_ts").alias("ts"), F.lit("mute").alias("verb"), F.lit(6.0).alias("hours"), F.lit(1).alias("seq"))
    said = said.withColumns({"value": F.lit(None).cast("double"), "direction": F.lit(None).cast("string")})
    rows = (
        candidate_rows(candidates, GATE)
        .unionByName(price_rows(readings, watching, GATE))
        .unionByName(level_rows(levels, F.lit(T0), GATE))
        .unionByName(control_rows(said, "gold", GATE))
    )
    write_shuffled(rows, f"{tmp_path}/all", 6, 1)
    # Half of the files, then a restart from the checkpoint with the rest.
    for i in range(6):
        if i == 3:
            run(spark, f"{tmp_path}/in", f"{tmp_path}/out")
        spark.read.schema(ROWS).parquet(f"{tmp_path}/all/{i:03d}").coalesce(1).write.parquet(f"{tmp_path}/in/{i:03d}")
    close(spark, f"{tmp_path}/in", "zzz")
    run(spark, f"{tmp_path}/in", f"{tmp_path}/out")
    judged = spark.read.parquet(f"{tmp_path}/out/judged")
    runs = level_runs(tick_series(readings, GATE.tick_minutes), levels, GATE)
    got = sorted(map(tuple, judged.filter("outcome = 'fired'").select(*FIRED).fillna("", ["series", "direction"]).fillna(-1.0, ["level"]).collect()))
    fired = walked(candidates, GATE, mute, None, runs).filter("what = 'fired'")
    want = sorted(map(tuple, fired.select(*FIRED).fillna("", ["series", "direction"]).fillna(-1.0, ["level"]).collect()))
    assert got == want
    assert {r[2] for r in want} == {"a", "b", "free", LEVEL_TRIGGER}
    # The reasons of the contenders that did not fire.
    outcome = {r["id"]: r["outcome"] for r in alert_gate(candidates, GATE, mute, None, runs).collect()}
    told = {r["id"]: r["outcome"] for r in judged.filter("series IS NULL").collect()}
    assert {k: outcome[k] for k in told} == told
    assert {"fired", "quiet", "cooldown", "muted", "budget"} == set(told.values())


def test_commands_act_from_the_next_tick(spark, tmp_path):
    said = [
        (7, 1, T0 + timedelta(minutes=10), "/set 50000 above mine"),
        (7, 2, T0 + timedelta(hours=2, minutes=1), "/unset 50000"),
        (7, 3, T0 + timedelta(hours=4, minutes=1), "/set 50000 below"),
        (7, 4, T0 + timedelta(hours=4, minutes=1), "/set 50000 below"),
    ]
    commands = control.parse(
        spark.createDataFrame(said, "subscriber bigint, seq bigint, ts timestamp, text string"),
        spark.createDataFrame([(7,)], "subscriber bigint"),
    )
    # Over the level all the time up to hour 5, then under it.
    prices = [(i, "gold", T0 + timedelta(minutes=30 * i), 51_000.0 if i < 10 else 49_000.0) for i in range(14)]
    readings = spark.createDataFrame(prices, "id bigint, series string, ts timestamp, value double")
    gate = Gate(quiet_from=0, quiet_to=0, cooldown_hours=0.0)
    watching = spark.createDataFrame([(7, "gold")], "subscriber bigint, series string")
    rows = control_rows(commands, "gold", gate).unionByName(price_rows(readings, watching, gate))
    write_shuffled(rows, f"{tmp_path}/in", 3, 2, 120)
    close(spark, f"{tmp_path}/in", "zzz")
    run(spark, f"{tmp_path}/in", f"{tmp_path}/out", gate, "3 hours")
    got = [(r["tick"], r["direction"]) for r in spark.read.parquet(f"{tmp_path}/out/judged").orderBy("tick").collect()]
    base = int((T0 - datetime(1970, 1, 1)).total_seconds())
    assert got == [(base + 1800, "above"), (base + 5 * 3600, "below")]


def test_state_runs_out(spark, tmp_path):
    candidates, readings, levels = tables(spark)
    write_shuffled(candidate_rows(candidates, GATE), f"{tmp_path}/in", 2, 3)
    close(spark, f"{tmp_path}/in", "zzz")
    query = run(spark, f"{tmp_path}/in", f"{tmp_path}/out")
    left = query.lastProgress["stateOperators"][0]["numRowsTotal"]
    fires = spark.read.parquet(f"{tmp_path}/out/judged").count()
    # Of the three subscribers nothing is left; one price and its timer wait of the far row.
    assert fires > 0 and left <= 4
