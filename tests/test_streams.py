"""Streams give what the batch jobs give, with the input cut into several batches."""

from __future__ import annotations

import random
from datetime import UTC, datetime, timedelta

from pyspark.sql import functions as F

from tidemark.operators.gate import alert_gate
from tidemark.operators.series import daily_series
from tidemark.operators.triggers import conflict_events, conflict_pairs
from tidemark.rules import ConflictRule, Gate
from tidemark.streaming.gates import flush, gate_batches
from tidemark.streaming.windows import conflict_stream, daily_stream

T0 = datetime(2026, 8, 17)


def write_slices(df, path, ts, slices, hours):
    """One file per slice of whole hours, in time order."""
    for i in range(slices):
        lo, hi = T0 + timedelta(hours=i * hours), T0 + timedelta(hours=(i + 1) * hours)
        df.filter((F.col(ts) >= F.lit(lo)) & (F.col(ts) < F.lit(hi))).coalesce(1).write.mode("append").parquet(f"{path}/{i:03d}")


def stream(spark, df, path):
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(path)


def drain(query):
    query.awaitTermination(120)
    if query.exception():
        raise query.exception()


def readings(spark, n, seed=3):
    rng = random.Random(seed)
    rows = [(i, rng.choice("ab"), T0 + timedelta(seconds=rng.randrange(4 * 86_400)), float(i)) for i in range(n)]
    return spark.createDataFrame(rows, "id bigint, series string, ts timestamp, value double")


def test_daily_stream_equals_batch(spark, tmp_path):
    df = readings(spark, 400)
    write_slices(df, f"{tmp_path}/in", "ts", 4, 24)
    src = stream(spark, df, f"{tmp_path}/in")
    q = (
        daily_stream(src, 330, "2 hours").writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/cp")
        .option("path", f"{tmp_path}/out").outputMode("append").trigger(availableNow=True).start()
    )
    drain(q)
    got = {(r["series"], r["day"]): r["value"] for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = {(r["series"], r["day"]): r["value"] for r in daily_series(df, "Asia/Kolkata").collect()}
    assert got and all(want[k] == v for k, v in got.items())
    last = max(d for _s, d in want)
    assert {k for k in want if k[1] < last} == set(got)  # the last day stays open


def test_conflict_stream_equals_batch(spark, tmp_path):
    rng = random.Random(5)
    rows = [
        (i, rng.choice(["x.com", "y.com", "z.com", "w.com", "other.com"]), T0 + timedelta(minutes=rng.randrange(1440)),
         rng.choice(["missile", "missile strike", "calm", "sanctions", "calm day"]))
        for i in range(300)
    ]
    df = spark.createDataFrame(rows, "id bigint, domain string, first_seen timestamp, title string")
    rule = ConflictRule()
    args = (F.col("title"), ("strike", "missile", "sanctions"), ("x.com", "y.com", "z.com", "w.com"), rule, 30)
    write_slices(df, f"{tmp_path}/in", "first_seen", 6, 4)
    q = (
        conflict_stream(stream(spark, df, f"{tmp_path}/in"), *args, lateness_minutes=30).writeStream.format("parquet")
        .option("checkpointLocation", f"{tmp_path}/cp").option("path", f"{tmp_path}/out").outputMode("append")
        .trigger(availableNow=True).start()
    )
    drain(q)
    cols = ["ts", "domain_count", "keyword_count", "domains", "keywords"]
    got = {tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").select(*cols).collect()}
    want = {tuple(r) for r in conflict_events(conflict_pairs(df, *args), rule).select(*cols).collect()}
    assert got and got <= want
    closed = max(r[0] for r in want) - timedelta(hours=5)
    assert {r for r in want if r[0] < closed} <= got


def candidates(spark, n):
    rng = random.Random(8)
    rows = [(i, rng.randrange(4), rng.choice("abc"), T0 + timedelta(seconds=rng.randrange(2 * 86_400)), float(rng.randrange(1, 9))) for i in range(n)]
    return spark.createDataFrame(rows, "id bigint, subscriber bigint, trigger string, ts timestamp, severity double")


def run_gate(spark, df, path, gate, out):
    q = (
        stream(spark, df, path).writeStream.foreachBatch(gate_batches(gate, out))
        .option("checkpointLocation", f"{out}/cp").trigger(availableNow=True).start()
    )
    drain(q)


def test_gate_stream_equals_batch_and_resumes(spark, tmp_path):
    df, gate = candidates(spark, 500), Gate(cooldowns={"a": 2.0})
    want = {r["id"]: r["outcome"] for r in alert_gate(df, gate).collect()}
    first = df.filter(F.col("ts") < F.lit(T0 + timedelta(hours=24)))
    write_slices(first, f"{tmp_path}/in", "ts", 2, 12)
    run_gate(spark, df, f"{tmp_path}/in", gate, f"{tmp_path}/out")
    # A restart from the same checkpoint sees only what came since.
    for i in (2, 3):
        lo, hi = T0 + timedelta(hours=i * 12), T0 + timedelta(hours=(i + 1) * 12)
        df.filter((F.col("ts") >= F.lit(lo)) & (F.col("ts") < F.lit(hi))).coalesce(1).write.parquet(f"{tmp_path}/in/{i:03d}")
    run_gate(spark, df, f"{tmp_path}/in", gate, f"{tmp_path}/out")
    rows = spark.read.parquet(f"{tmp_path}/out/decisions").collect()
    assert len(rows) == len(want)
    assert {r["id"]: r["outcome"] for r in rows} == want
    assert set(want.values()) == {"fired", "quiet", "cooldown", "budget"}


def test_gate_batch_replay_changes_nothing(spark, tmp_path):
    df, judge = candidates(spark, 200), gate_batches(Gate(), f"{tmp_path}/out")
    halves = [df.filter(F.col("ts") < F.lit(T0 + timedelta(days=1))), df.filter(F.col("ts") >= F.lit(T0 + timedelta(days=1)))]
    for i in (0, 1):
        judge(halves[i], i)
    once = sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out/fires").collect())
    for i in (0, 1):
        judge(halves[i], i)
    assert sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out/fires").collect()) == once


def test_rows_in_any_order_are_judged_in_whole_ticks(spark, tmp_path):
    df, gate, out = candidates(spark, 400), Gate(cooldowns={"a": 2.0}), f"{tmp_path}/out"
    want = {r["id"]: r["outcome"] for r in alert_gate(df, gate).collect()}
    judge = gate_batches(gate, out, lateness_minutes=240)
    # Rows arrive up to four hours after their time.
    arrival = F.col("ts") + F.expr("make_interval(0, 0, 0, 0, 0, pmod(id * 37, 240), 0)")
    step = F.floor((F.unix_seconds(arrival) - F.lit(int(T0.replace(tzinfo=UTC).timestamp()))) / (6 * 3600))
    timed = df.withColumn("step", step).persist()
    last = timed.agg(F.max("step")).first()[0]
    for i in range(last + 1):
        judge(timed.filter(F.col("step") == i).drop("step"), i)
    flush(spark, gate, out, df.schema.simpleString()[7:-1], last + 1)
    timed.unpersist()
    rows = spark.read.parquet(f"{out}/decisions").collect()
    assert len(rows) == len(want) and {r["id"]: r["outcome"] for r in rows} == want
    assert spark.read.parquet(f"{out}/late").count() == 0


def test_late_rows_are_kept_aside(spark, tmp_path):
    df, out = candidates(spark, 50), f"{tmp_path}/out"
    judge = gate_batches(Gate(), out, lateness_minutes=0)
    judge(df.filter(F.col("ts") >= F.lit(T0 + timedelta(days=1))), 0)
    judge(df.filter(F.col("ts") < F.lit(T0 + timedelta(days=1))), 1)
    flush(spark, Gate(), out, df.schema.simpleString()[7:-1], 2)
    late = {r["id"] for r in spark.read.parquet(f"{out}/late").collect()}
    judged = {r["id"] for r in spark.read.parquet(f"{out}/decisions").collect()}
    assert late == {r["id"] for r in df.filter(F.col("ts") < F.lit(T0 + timedelta(days=1))).collect()}
    assert late | judged == set(range(50)) and not late & judged
