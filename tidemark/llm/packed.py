"""Hashes dealt to buckets in packed rows, so that one row moves thousands of them.

A packed row holds the entries of one bucket from one group of texts: owners (text keys),
how many entries each owner has, and the entries' hashes. Owners come in the order of the
texts. Buckets are as many as the session's shuffle partitions, one to each partition.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def n_buckets(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of each hash, from its upper half."""
    return (((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.uint16 if buckets <= 1 << 16 else np.int64)


def by_bucket(rows: DataFrame, buckets: int) -> DataFrame:
    """Each bucket in a partition of its own."""
    return rows.repartitionById(buckets, "bucket")


def cut(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, places of its entries in their old order)."""
    order = np.argsort(bucket, kind="stable")
    edges = np.flatnonzero(np.diff(bucket[order])) + 1
    for part in np.split(order, edges):
        if len(part):
            yield int(bucket[part[0]]), part


def runs(owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct owners in order, entries of each) of entries grouped by owner."""
    first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(owner) else np.zeros(0, np.int64)
    return owner[first], np.diff(np.append(first, len(owner))).astype(np.int32)


def whole(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    """All rows of a partition; packed rows of one bucket, bounded by the number of buckets."""
    held = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(held) if held else None


def column(rows: pa.Table, name: str, kind: type) -> np.ndarray:
    """The arrays of a binary column one after the other."""
    return np.frombuffer(b"".join(x for x in rows.column(name).to_pylist() if x), dtype=kind)


def repeated(h: np.ndarray) -> np.ndarray:
    """Which entries have a hash that another entry has too."""
    order = np.argsort(h)
    same = h[order][1:] == h[order][:-1]
    out = np.zeros(len(h), dtype=bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


REPLY = "bucket int, owners binary, others binary, counts binary, answers binary"
_REPLY = pa.schema([("bucket", pa.int32())] + [(n, pa.binary()) for n in ("owners", "others", "counts", "answers")])


def replies(k1: np.ndarray, k2: np.ndarray, answer: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Answers for texts (k1, k2), packed by the bucket of the text: one row for each bucket.

    Entries of one text come one after the other.
    """
    out = []
    for b, i in cut(np.mod(k1, buckets)):
        first = np.flatnonzero(np.concatenate([[True], (k1[i][1:] != k1[i][:-1]) | (k2[i][1:] != k2[i][:-1])]))
        counts = np.diff(np.append(first, len(i))).astype(np.int32)
        out.append({"bucket": b, "owners": k1[i][first].tobytes(), "others": k2[i][first].tobytes(), "counts": counts.tobytes(), "answers": answer[i].tobytes()})
    return pa.RecordBatch.from_pylist(out, schema=_REPLY)


def beside(texts: DataFrame, answers: DataFrame, buckets: int) -> DataFrame:
    """Texts (with k1) and the packed answers for them in the same partitions, answers first."""
    both = answers.withColumn("kind", F.lit(0)).unionByName(
        texts.withColumn("bucket", F.pmod("k1", F.lit(buckets)).cast("int")).withColumn("kind", F.lit(1)), allowMissingColumns=True
    )
    return both.repartitionById(buckets, "bucket").sortWithinPartitions("kind")


class Answers:
    """The answers of a partition, collected from the rows that come before its texts."""

    def __init__(self, kind: type) -> None:
        self.kind, self.rows, self.ready = kind, [], None

    def take(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        """Keep the answers of a batch and return its texts."""
        kind = batch.column(batch.schema.get_field_index("kind")).to_numpy()
        n = int((kind == 0).sum())
        if n:
            self.rows.append(batch.slice(0, n).select(["owners", "others", "counts", "answers"]))
        return batch.slice(n)

    def of(self, k1: int, k2: int) -> np.ndarray:
        if self.ready is None:
            names = ["owners", "others", "counts", "answers"]
            rows = pa.Table.from_batches(self.rows) if self.rows else pa.table({n: pa.array([], pa.binary()) for n in names})
            counts = column(rows, "counts", np.int32)
            a, b = (np.repeat(column(rows, n, np.int64), counts) for n in ("owners", "others"))
            order = np.argsort(a, kind="stable")
            self.ready = a[order], b[order], column(rows, "answers", self.kind)[order]
            self.rows = []
        a, b, answer = self.ready
        low, high = np.searchsorted(a, [k1, k1 + 1]) if k1 < np.iinfo(np.int64).max else (np.searchsorted(a, k1), len(a))
        return answer[low:high][b[low:high] == k2]
