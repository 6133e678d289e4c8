"""Tables kept as versions: a batch writes its own rows, readers put the versions together.

Under the folder of a table, ``version=12`` holds what batch 12 brought, one row for each of its
keys, and ``compact=12-32`` one row for each key of all versions up to 12, in 32 hash buckets. A
folder counts once its `_SUCCESS` marker is there, which Spark writes last. So a batch costs as
many written rows as it has keys, at any size of the table, and a failed or repeated batch
leaves nothing half done: the same version number replaces the same folder.

Compaction is a job of its own. It takes as many buckets as the table's rows call for, so that a
bucket stays of a size for one task while the table grows, and it is due once what the versions
hold is a quarter of the compacted rows, or once there are many of them; written rows thus stay
within a small multiple of the rows that came in. Readers that began before go on with the old
folders until `vacuum` deletes them.

One writer at a time. Version numbers follow each other, but may have gaps.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = "_version"
BUCKET_ROWS = 1_000_000
DUE_SHARE, DUE_VERSIONS = 0.25, 48
SMALL_BUCKETS = 10_000

#: Takes all rows of some keys, with their `_version`, and gives one row for each key.
Resolve = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class State:
    """What readers of a table see: the newest compaction and the versions after it."""

    compacted: int = -1
    buckets: int = 0
    versions: tuple[int, ...] = ()

    @property
    def newest(self) -> int:
        return self.versions[-1] if self.versions else self.compacted


def _folder(spark: SparkSession, path: str):  # noqa: ANN202 - a Hadoop FileSystem and Path
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _complete(spark: SparkSession, path: str) -> list[str]:
    """Names of the complete folders of a table."""
    fs, root = _folder(spark, path)
    if not fs.exists(root):
        return []
    folders = [s.getPath() for s in fs.listStatus(root) if s.isDirectory()]
    path_of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return [p.getName() for p in folders if fs.exists(path_of(p, "_SUCCESS"))]


def state(spark: SparkSession, path: str) -> State:
    names = _complete(spark, path)
    made = [tuple(map(int, n.removeprefix("compact=").split("-"))) for n in names if n.startswith("compact=")]
    compacted, buckets = max(made, default=(-1, 0))
    after = sorted(int(n.removeprefix("version=")) for n in names if n.startswith("version="))
    return State(compacted, buckets, tuple(v for v in after if v > compacted))


def append(batch: DataFrame, path: str, version: int | None = None) -> int:
    """Write a batch, one row a key, as a version; the next one if no number is given.

    A number makes a repeated batch harmless: it replaces its own folder, and is left out if
    a compaction has taken it in already.
    """
    now = state(batch.sparkSession, path)
    version = now.newest + 1 if version is None else version
    if version > now.compacted:
        batch.write.mode("overwrite").parquet(f"{path}/version={version}")
    return version


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def stored(spark: SparkSession, path: str, schema: str, key: str, keys: DataFrame | None = None, now: State | None = None) -> DataFrame:
    """All rows of the live versions with `_version`; only those of `keys`, if given.

    Of the compacted rows only the buckets in which the keys fall are opened.
    """
    now = state(spark, path) if now is None else now
    parts = []
    if now.buckets:
        old = spark.read.schema(f"{schema}, bucket int").parquet(f"{path}/compact={now.compacted}-{now.buckets}")
        if keys is not None:
            hit = keys.select(_bucket(key, now.buckets).alias("bucket")).distinct()
            if now.buckets <= SMALL_BUCKETS:  # few numbers, which prune folders before the read
                old = old.filter(F.col("bucket").isin([r["bucket"] for r in hit.collect() if r["bucket"] is not None]))
            else:
                old = old.join(hit, "bucket", "left_semi")
        parts.append(old.drop("bucket").withColumn(VERSION, F.lit(now.compacted)))
    if now.versions:
        new = spark.read.schema(schema).parquet(*[f"{path}/version={v}" for v in now.versions])
        # From the path of the file, not input_file_name(), which would keep filters from the scan.
        number = F.regexp_extract("_metadata.file_path", r"/version=(\d+)/", 1).cast("int")
        parts.append(new.select(*new.columns, number.alias(VERSION)))
    if not parts:
        return spark.createDataFrame([], f"{schema}, {VERSION} int")
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return rows if keys is None else rows.join(keys.select(key).distinct(), key, "left_semi")


def due(spark: SparkSession, path: str) -> bool:
    """Whether a compaction pays; counts come from the footers of the files."""
    now = state(spark, path)
    if len(now.versions) >= DUE_VERSIONS or not now.versions:
        return bool(now.versions)
    fresh = spark.read.parquet(*[f"{path}/version={v}" for v in now.versions]).count()
    old = spark.read.parquet(f"{path}/compact={now.compacted}-{now.buckets}").count() if now.buckets else 0
    return fresh > DUE_SHARE * old


def compact(spark: SparkSession, path: str, schema: str, key: str, resolve: Resolve, sort: str | None = None, bucket_rows: int = BUCKET_ROWS) -> State:
    """Put all live versions together into one row a key.

    Rows of a bucket are sorted by `sort`, so that a filter on it skips row groups.
    """
    now = state(spark, path)
    if not now.versions:
        return now
    rows = stored(spark, path, schema, key, now=now)
    buckets = max(1, ceil(rows.count() / bucket_rows))
    whole = resolve(rows).withColumn("bucket", _bucket(key, buckets)).repartition("bucket")
    whole = whole.sortWithinPartitions("bucket", *([sort] if sort else []))
    whole.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/compact={now.newest}-{buckets}")
    return state(spark, path)


def vacuum(spark: SparkSession, path: str) -> int:
    """Delete the folders that the newest compaction stands for; returns how many."""
    now, (fs, root), gone = state(spark, path), _folder(spark, path), 0
    for status in fs.listStatus(root):
        kind, _, number = status.getPath().getName().partition("=")
        last = int(number.split("-")[0]) if kind in ("version", "compact") else None
        if last is not None and (last < now.compacted or (kind == "version" and last == now.compacted)):
            gone += fs.delete(status.getPath(), True)
    return gone
