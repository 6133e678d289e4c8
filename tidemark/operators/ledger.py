"""Call costs, the daily spend ledger and the spend guard, in whole micro-dollars."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.money import call_micro, token_estimate
from tidemark.rules import Prices

# Ship the walker with its task, so that executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def priced_calls(calls: DataFrame, prices: Prices) -> DataFrame:
    """Add the projected and the actual cost of each call.

    The projection assumes the full output allowance, so that the guard stops a call
    that could break a cap. Columns in: call_id, day, input_chars, output_chars.
    """
    tokens_in, tokens_out = token_estimate(F.col("input_chars")), token_estimate(F.col("output_chars"))
    return calls.select(
        "*",
        tokens_in.alias("input_tokens"),
        tokens_out.alias("output_tokens"),
        call_micro(tokens_in, F.lit(prices.max_output_tokens).cast("bigint"), prices).alias("projected"),
        call_micro(tokens_in, tokens_out, prices).alias("cost"),
    )


def spend_ledger(calls: DataFrame) -> DataFrame:
    return calls.groupBy("day").agg(F.sum("cost").alias("cost_micro"), F.count("*").alias("calls"))


def merge_ledger(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Accumulate: cost and calls of a day add up."""
    return (
        stored.unionByName(fresh)
        .groupBy("day")
        .agg(F.sum("cost_micro").alias("cost_micro"), F.sum("calls").alias("calls"))
    )


def _guard(cap: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Ids of allowed calls, from rows sorted by day and call; an amount on the books comes first."""
        today, spent = None, 0
        for batch in batches:
            allowed = []
            for day, call_id, projected, cost in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if day != today:
                    today, spent = day, 0
                if call_id is None:
                    spent += cost
                elif spent + projected <= cap:
                    spent += cost
                    allowed.append(call_id)
            yield pa.RecordBatch.from_arrays([pa.array(allowed, pa.int64())], names=["call_id"])

    return run


def spend_guard(
    calls: DataFrame, prices: Prices, rows_per_part: int = 1_000_000, prior: DataFrame | None = None
) -> DataFrame:
    """Add `outcome`: allowed, per_run or daily. Refused calls add nothing.

    `prior` (day, cost_micro) is what earlier runs have spent on each day.

    Walking a whole day in one task is avoided by an exact cut. What is left of the
    cap only shrinks, so once a call of some projected cost is refused, every later
    one of that cost is too: the allowed calls of one projection are its first ones.
    A call can therefore be allowed only if the actual costs of the earlier calls of
    the same projection leave room for it. That is checked inside slices of about
    `rows_per_part` rows first, so that no task sees a hot day whole. The survivors are
    streamed in order past one running total, so even calls that cost nothing gather nowhere.
    """
    fits = calls.filter(F.col("projected") <= prices.per_run_cap_micro)
    room = F.lit(prices.daily_cap_micro) - F.col("projected")

    def cut(df: DataFrame, *keys: str) -> DataFrame:
        before = Window.partitionBy(*keys).orderBy("call_id").rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumn("_spent", F.coalesce(F.sum("cost").over(before), F.lit(0))).filter(
            F.col("_spent") <= room
        )

    largest = fits.groupBy("day", "projected").agg(F.count("*").alias("n")).agg(F.max("n"))
    parts = F.ceil(F.coalesce(largest.scalar(), F.lit(1)) / F.lit(rows_per_part))
    sliced = fits.select("day", "call_id", "projected", "cost").withColumn(
        "_part", F.pmod(F.xxhash64("call_id"), parts)
    )
    survivors = cut(cut(sliced, "day", "projected", "_part").drop("_spent"), "day", "projected")
    queue = survivors.select("day", "call_id", "projected", "cost")
    if prior is not None:
        spent = prior.groupBy("day").agg(F.sum("cost_micro").alias("cost"))
        queue = queue.unionByName(spent, allowMissingColumns=True)
    ordered = queue.repartition("day").sortWithinPartitions("day", F.asc_nulls_first("call_id"))
    allowed = ordered.mapInArrow(_guard(prices.daily_cap_micro), "call_id bigint").withColumn("_ok", F.lit(True))
    return calls.join(allowed, "call_id", "left").select(
        *calls.columns,
        F.when(F.col("_ok"), F.lit("allowed"))
        .when(F.col("projected") > prices.per_run_cap_micro, F.lit("per_run"))
        .otherwise(F.lit("daily"))
        .alias("outcome"),
    )
