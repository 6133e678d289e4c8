"""Tables as parquet: append, merge and prune.

Headlines and latest rows are kept as versions (`versions.py`): a batch writes its own keys.
The ledger is small and merged by month: a merge reads and rewrites only the partitions that
its batch touches. Writes go through Spark's committer, so a lost executor costs a task
retry and nothing else.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.ledger import merge_ledger
from tidemark.schema import HEADLINES, SPEND
from tidemark.sources import versions


def _fs(spark: SparkSession, path: str):  # noqa: ANN202 - a Hadoop FileSystem and Path
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return bool(fs.exists(p))


def append_readings(readings: DataFrame, path: str, ts: str = "ts") -> None:
    """Append readings that have a value, partitioned by UTC date.

    The rebalance hint groups rows by date, splits a date that is too large for one
    task and joins small ones, so files stay of even size.
    """
    dated = readings.filter(F.col("value").isNotNull()).withColumn("event_date", F.to_date(ts))
    dated.hint("rebalance", "event_date").write.mode("append").partitionBy("event_date").parquet(path)


def merge_into(
    spark: SparkSession,
    path: str,
    batch: DataFrame,
    part: str,
    merge: Callable[[DataFrame, DataFrame], DataFrame],
    stored_schema: str,
) -> None:
    """Merge a batch into a table, partition by partition.

    `batch` carries the partition column. Only its distinct partitions are read, by
    dynamic pruning, and only those are replaced.
    """
    if exists(spark, path):
        touched = batch.select(part).distinct()
        stored = spark.read.parquet(path).join(touched, part, "left_semi")
    else:
        stored = spark.createDataFrame([], f"{stored_schema}, {part} {dict(batch.dtypes)[part]}")
    (
        merge(stored, batch)
        .hint("rebalance", part)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(part)
        .parquet(path)
    )


FIXED = ["domain", "source", "published_at", "first_seen"]
MOVING = ["title", "summary", "keywords"]


def _first_and_last(rows: DataFrame, order: str) -> DataFrame:
    """One row a url: what is fixed from its first row, what moves from its last."""
    first, last = F.min_by(F.struct(*FIXED), order), F.max_by(F.struct(*MOVING), order)
    return rows.groupBy("url").agg(first.alias("f"), last.alias("m")).select("url", "f.*", "m.*")


def upsert_headlines(spark: SparkSession, path: str, batch: DataFrame, version: int | None = None) -> int:
    """Keep what was first stored, overwrite title, summary and keywords.

    Writes one row for each url of the batch as a version of the table; `pos` orders the batch.
    """
    return versions.append(_first_and_last(batch, "pos"), path, version)


def _resolved(rows: DataFrame) -> DataFrame:
    return _first_and_last(rows, versions.VERSION)


def headlines(spark: SparkSession, path: str, since: datetime | None = None) -> DataFrame:
    """The stored headlines; those first seen at `since` or later, if given.

    Then only urls with a version from that time on are put together. A url that came again
    but was stored earlier is among them, and is left out by its first version.
    """
    if since is None:
        return _resolved(versions.stored(spark, path, HEADLINES, "url"))
    late = F.col("first_seen") >= F.lit(since)
    urls = versions.stored(spark, path, HEADLINES, "url").filter(late).select("url")
    return _resolved(versions.stored(spark, path, HEADLINES, "url", urls)).filter(late)


def new_headlines(spark: SparkSession, path: str, batch: DataFrame) -> DataFrame:
    """Urls of a batch that are not stored yet."""
    known = versions.stored(spark, path, HEADLINES, "url", batch.select("url"))
    return batch.select("url").distinct().join(known.select("url"), "url", "left_anti")


def compact_headlines(spark: SparkSession, path: str, bucket_rows: int = versions.BUCKET_ROWS) -> None:
    versions.compact(spark, path, HEADLINES, "url", _resolved, "first_seen", bucket_rows)


def add_spend(spark: SparkSession, path: str, fresh: DataFrame) -> None:
    """Add a batch ledger (day, cost_micro, calls) to the stored one, by month."""
    month = F.date_format("day", "yyyyMM").cast("int")

    def merge(stored: DataFrame, batch: DataFrame) -> DataFrame:
        cols = ["day", "cost_micro", "calls"]
        return merge_ledger(stored.select(*cols), batch.select(*cols)).withColumn("month", month)

    merge_into(spark, path, fresh.withColumn("month", month), "month", merge, SPEND)


def replace_latest(spark: SparkSession, path: str, batch: DataFrame, key: str, ts: str, version: int | None = None) -> int:
    """One row per key, the newest by `ts`; at equal times the later batch. Writes the batch's keys as a version."""
    return versions.append(latest_by_key(batch, key, ts), path, version)


def _newest(key: str, ts: str) -> versions.Resolve:
    return lambda rows: latest_by_key(rows, key, ts, versions.VERSION).drop(versions.VERSION)


def latest(spark: SparkSession, path: str, schema: str, key: str, ts: str, keys: DataFrame | None = None) -> DataFrame:
    """The newest stored row of each key, or of each of `keys`."""
    return _newest(key, ts)(versions.stored(spark, path, schema, key, keys))


def compact_latest(spark: SparkSession, path: str, schema: str, key: str, ts: str, bucket_rows: int = versions.BUCKET_ROWS) -> None:
    versions.compact(spark, path, schema, key, _newest(key, ts), None, bucket_rows)


def latest_by_key(df: DataFrame, key: str, ts: str, tie: str | None = None) -> DataFrame:
    order = F.struct(ts, tie) if tie else F.col(ts)
    row = F.max_by(F.struct(*[F.col(c) for c in df.columns]), order)
    return df.groupBy(F.col(key).alias("_key")).agg(row.alias("r")).select("r.*")


def prune(spark: SparkSession, path: str, cutoff: datetime, ts: str = "ts") -> None:
    """Delete rows older than the cutoff from a table partitioned by `event_date`.

    Whole dates before the cutoff's date go by their folders, without reading a row.
    Only the cutoff's own date is rewritten; equality with the cutoff stays.
    """
    edge = cutoff.date()
    table = spark.read.parquet(path)
    if cutoff > datetime(edge.year, edge.month, edge.day):
        day = table.filter(F.col("event_date") == F.lit(edge))
        kept = day.filter(F.col(ts) >= F.lit(cutoff))
        if kept.isEmpty():  # nothing would be written, so nothing replaced: the whole date goes
            edge += timedelta(days=1)
        else:
            (
                kept.write.mode("overwrite")
                .option("partitionOverwriteMode", "dynamic")
                .partitionBy("event_date")
                .parquet(path)
            )
    fs, root = _fs(spark, path)
    for status in fs.listStatus(root):
        name = status.getPath().getName()
        if name.startswith("event_date=") and date.fromisoformat(name.split("=", 1)[1]) < edge:
            fs.delete(status.getPath(), True)


def expired(df: DataFrame, cutoff: datetime, ts: str = "ts") -> DataFrame:
    """Rows that a prune at the cutoff removes."""
    return df.filter(F.col(ts) < F.lit(cutoff))
