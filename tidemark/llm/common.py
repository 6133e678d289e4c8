"""What the operators share: written tables, word counts, the tables of a folder."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import shared_folder

#: Fixed value: a word is a maximal run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


#: Rows in a batch between Spark and Python. Texts are longer than the rows its default is meant for:
#: its buffers, on both sides outside the heap, would take hundreds of megabytes.
BATCH_ROWS = 250


def small_batches(spark: SparkSession) -> None:
    """Bound what a Python worker holds at a time; set before a job with Python runs."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that driver and executors share."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def table(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it back.

    This cuts the lineage: a later loss of an executor never reruns what came before.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of keys that may be broadcast: some tens of megabytes.
SMALL_ROWS = 1_000_000


def small(keys: DataFrame) -> DataFrame:
    """A written table of keys, with a broadcast hint if it has few rows.

    The texts it is joined with then stay where they are. Beyond that the join shuffles.
    """
    return F.broadcast(keys) if keys.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS else keys


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """Rows that no model may learn from: crc32 of the id as text, modulo `parts`."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(parts)) == part, F.lit(False))
