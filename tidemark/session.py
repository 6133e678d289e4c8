"""Session settings the library relies on."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def tune(spark: SparkSession) -> SparkSession:
    """Set the run-time options the jobs need; safe to call on any session.

    Times are UTC instants throughout, so the session zone is pinned. Adaptive
    execution coalesces small shuffles and splits skewed join partitions.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    return spark


def local_session(name: str = "tidemark", cores: str = "8") -> SparkSession:
    """A local session for tests and for bench.py."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


_local_folder: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """Folder that every executor can reach, for checkpoints and written tables.

    A cluster names it in ``spark.checkpoint.dir``. Only in local mode, where it is
    unset, does a fresh folder of this machine stand in for it.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _local_folder:
        _local_folder[context.applicationId] = tempfile.mkdtemp(prefix="tidemark-")
    return _local_folder[context.applicationId]
