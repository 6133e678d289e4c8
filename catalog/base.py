"""Registry of named queries."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import tune

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    run: Run
    sql: str | None


REGISTRY: dict[str, Entry] = {}


def query(name: str, sql: str | None = None) -> Callable[[Run], Run]:
    def add(fn: Run) -> Run:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return _plain_times(fn(tune(spark), folder))

        REGISTRY[name] = Entry(run, sql)
        return fn

    return add


def _plain_times(df: DataFrame) -> DataFrame:
    """UTC instants leave as zone-free timestamps, the type the input tables use."""
    return df.select(
        *[
            F.col(f.name).cast("timestamp_ntz").alias(f.name)
            if isinstance(f.dataType, T.TimestampType)
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )
