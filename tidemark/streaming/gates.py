"""The alert gate over micro-batches.

Each batch writes its decisions and its fires under its own batch number, overwriting
what an earlier attempt of that batch left, so a replay changes nothing. The state a
batch needs is the fires of earlier batches, read back from the ledger.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.dates import tick_of
from tidemark.operators.gate import alert_gate
from tidemark.rules import Gate
from tidemark.schema import FIRES
from tidemark.sources.sinks import exists


def prior_fires(spark: SparkSession, ledger: str, batch_id: int, since_day: Column) -> DataFrame:
    """Fires of earlier batches from a day on; the ledger is partitioned by UTC day, so older ones are not read."""
    fires = spark.read.schema(FIRES + ", day date, batch bigint").parquet(ledger)
    return fires.filter((F.col("day") >= since_day) & (F.col("batch") < batch_id))


def gate_batches(
    gate: Gate, out: str, mutes: DataFrame | None = None, lateness_minutes: float | None = None
) -> Callable[[DataFrame, int], None]:
    """A `foreachBatch` function.

    Without `lateness_minutes`, batches must hold whole ticks in time order. With it, rows
    may come in any order: a tick is judged once the newest time seen, less the lateness,
    has passed its end; until then its rows wait in `pending`. Rows of ticks that were
    judged already go to `late`; they are kept there, not dropped. `flush` judges what waits.
    """
    reach = int(max([gate.cooldown_hours, *gate.cooldowns.values()]) * 3600 + 86_400)
    ledger, decisions = f"{out}/fires", f"{out}/decisions"

    def judge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        spark.createDataFrame([], FIRES).write.mode("ignore").parquet(f"{ledger}/day=1970-01-01/batch=-1")
        batch = batch if lateness_minutes is None else _due(batch, batch_id, gate, out, lateness_minutes)
        batch.persist()
        try:
            first = batch.agg(F.min(F.unix_seconds("ts")).alias("t")).scalar()
            prior = prior_fires(spark, ledger, batch_id, F.to_date(F.timestamp_seconds(first - F.lit(reach + 86_400))))
            prior = prior.filter(F.col("tick") >= first - F.lit(reach))
            judged = alert_gate(batch, gate, mutes, prior.drop("batch", "day"))
            judged.write.mode("overwrite").parquet(f"{decisions}/batch={batch_id}")
            done = spark.read.parquet(f"{decisions}/batch={batch_id}").filter("outcome = 'fired'")
            fires = done.select("subscriber", F.unix_seconds("tick").alias("tick"), "trigger", "id")
            (
                fires.withColumns({"day": F.to_date(F.timestamp_seconds("tick")), "batch": F.lit(batch_id)})
                .write.mode("overwrite")
                .option("partitionOverwriteMode", "dynamic")
                .partitionBy("day", "batch")
                .parquet(ledger)
            )
        finally:
            batch.unpersist()

    return judge


MARK = "judged_to bigint, newest bigint"


def _mark(spark: SparkSession, out: str, batch_id: int) -> tuple[int, int]:
    """(end of the ticks judged, newest time seen) after the batches before this one."""
    if not exists(spark, f"{out}/marks"):
        return -(2**40), -(2**40)
    seen = spark.read.schema(MARK + ", batch bigint").parquet(f"{out}/marks").filter(F.col("batch") < batch_id)
    row = seen.agg(F.max("judged_to"), F.max("newest")).first()
    return (row[0], row[1]) if row[0] is not None else (-(2**40), -(2**40))


def _due(batch: DataFrame, batch_id: int, gate: Gate, out: str, lateness_minutes: float, flush: bool = False) -> DataFrame:
    """Rows of the ticks that are complete; the others are written to `pending` or `late`."""
    spark = batch.sparkSession
    judged_to, newest_before = _mark(spark, out, batch_id)
    rows = batch
    if exists(spark, f"{out}/pending/batch={batch_id - 1}"):
        rows = rows.unionByName(spark.read.schema(batch.schema).parquet(f"{out}/pending/batch={batch_id - 1}"))
    tick, width = tick_of(F.col("ts"), gate.tick_minutes), gate.tick_minutes * 60
    newest = max(batch.agg(F.max(F.unix_seconds("ts"))).first()[0] or newest_before, newest_before)
    passed = newest - int(lateness_minutes * 60)
    until = max(judged_to, newest // width * width + width if flush else passed // width * width)
    rows.filter(tick < judged_to).write.mode("overwrite").parquet(f"{out}/late/batch={batch_id}")
    rows.filter(tick >= until).write.mode("overwrite").parquet(f"{out}/pending/batch={batch_id}")
    mark = spark.createDataFrame([(until, newest)], MARK)
    mark.write.mode("overwrite").parquet(f"{out}/marks/batch={batch_id}")
    return rows.filter((tick >= judged_to) & (tick < until))


def flush(spark: SparkSession, gate: Gate, out: str, schema: str, batch_id: int, mutes: DataFrame | None = None) -> None:
    """Judge what still waits, as a batch of its own after the last one."""
    rest = _due(spark.createDataFrame([], schema), batch_id, gate, out, 0.0, flush=True)
    gate_batches(gate, out, mutes)(rest, batch_id)
