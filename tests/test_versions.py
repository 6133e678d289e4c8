"""Versioned tables: what a batch writes, compaction, repeated and broken batches, reads of a few keys."""

from __future__ import annotations

import os
from datetime import datetime, timedelta

import pytest

from tidemark.sources import sinks, versions

HEADLINE = "url string, domain string, source string, published_at timestamp, first_seen timestamp, title string, summary string, keywords array<string>, pos bigint"
VALUE = "key string, ts timestamp, value double"
T = datetime(2027, 3, 1)


def headlines(spark, batch, urls, pos=0):
    at = T + timedelta(days=batch)
    rows = [(f"u{u}", f"d{batch}", "s", at, at, f"title {batch} {p}", "", [f"k{batch}"], p) for p, u in enumerate(urls, pos)]
    return spark.createDataFrame(rows, HEADLINE)


def as_rows(df):
    return {r["url"]: (r["domain"], r["first_seen"], r["title"], r["keywords"]) for r in df.collect()}


def written(spark, path, version):
    return spark.read.parquet(f"{path}/version={version}").count()


BATCHES = [range(600), [*range(0, 300, 2), 1, 1, 1], range(500, 900), [5], range(700, 701)]


def plain(batches):
    rows = {}
    for n, urls in enumerate(batches):
        for p, u in enumerate(urls):
            at = T + timedelta(days=n)
            first = rows.get(f"u{u}", (f"d{n}", at))
            rows[f"u{u}"] = (first[0], first[1], f"title {n} {p}", [f"k{n}"])
    return rows


@pytest.mark.parametrize("compact_after", [(), (0,), (1, 3), (0, 1, 2, 3, 4)])
def test_compaction_changes_no_row(spark, tmp_path, compact_after):
    path = f"{tmp_path}/h"
    for n, urls in enumerate(BATCHES):
        assert sinks.upsert_headlines(spark, path, headlines(spark, n, urls)) == n
        assert written(spark, path, n) == len(set(urls))  # a batch writes its own keys, whatever is stored
        if n in compact_after:
            sinks.compact_headlines(spark, path, bucket_rows=100)
            assert versions.state(spark, path).versions == ()
    assert as_rows(sinks.headlines(spark, path)) == plain(BATCHES)
    for days in range(len(BATCHES) + 1):
        since = T + timedelta(days=days)
        assert as_rows(sinks.headlines(spark, path, since)) == {u: r for u, r in plain(BATCHES).items() if r[1] >= since}
    batch = headlines(spark, 9, [3, 3, 899, 900, 5000])
    assert {r["url"] for r in sinks.new_headlines(spark, path, batch).collect()} == {"u900", "u5000"}


def test_buckets_follow_the_rows(spark, tmp_path):
    path = f"{tmp_path}/h"
    sizes = []
    for n in range(3):
        sinks.upsert_headlines(spark, path, headlines(spark, n, range(n * 400, n * 400 + 400)))
        sinks.compact_headlines(spark, path, bucket_rows=100)
        sizes.append(versions.state(spark, path).buckets)
    assert sizes == [4, 8, 12]
    assert versions.vacuum(spark, path) == 5  # three versions and two compactions
    assert len(as_rows(sinks.headlines(spark, path))) == 1200


def test_repeated_and_broken_batches(spark, tmp_path):
    path = f"{tmp_path}/h"
    for n in (0, 1, 1):
        sinks.upsert_headlines(spark, path, headlines(spark, n, [1, 2]), version=n)
    assert versions.state(spark, path) == versions.State(-1, 0, (0, 1))
    sinks.compact_headlines(spark, path)
    sinks.upsert_headlines(spark, path, headlines(spark, 1, [1, 2]), version=1)  # taken in already
    assert versions.state(spark, path) == versions.State(1, 1, ())
    sinks.upsert_headlines(spark, path, headlines(spark, 2, [3]), version=2)
    os.remove(f"{path}/version=2/_SUCCESS")  # a batch that died
    assert set(as_rows(sinks.headlines(spark, path))) == {"u1", "u2"}
    assert sinks.upsert_headlines(spark, path, headlines(spark, 2, [4])) == 2
    assert set(as_rows(sinks.headlines(spark, path))) == {"u1", "u2", "u4"}


def test_an_old_reader_goes_on_until_the_vacuum(spark, tmp_path):
    path = f"{tmp_path}/h"
    sinks.upsert_headlines(spark, path, headlines(spark, 0, [1]))
    reader = sinks.headlines(spark, path)
    sinks.compact_headlines(spark, path)
    assert reader.count() == 1 and sinks.headlines(spark, path).count() == 1


def test_when_a_compaction_is_due(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/h"
    assert not versions.due(spark, path)
    sinks.upsert_headlines(spark, path, headlines(spark, 0, range(100)))
    assert versions.due(spark, path)
    sinks.compact_headlines(spark, path)
    sinks.upsert_headlines(spark, path, headlines(spark, 1, range(20)))
    assert not versions.due(spark, path)
    sinks.upsert_headlines(spark, path, headlines(spark, 2, range(10)))
    assert versions.due(spark, path)
    monkeypatch.setattr(versions, "DUE_SHARE", 9.0)
    assert not versions.due(spark, path)
    monkeypatch.setattr(versions, "DUE_VERSIONS", 2)
    assert versions.due(spark, path)


def test_a_read_of_few_keys_opens_few_buckets(spark, tmp_path):
    path = f"{tmp_path}/v"
    rows = [(f"k{i}", T, float(i)) for i in range(2000)]
    sinks.replace_latest(spark, path, spark.createDataFrame(rows, VALUE), "key", "ts")
    sinks.compact_latest(spark, path, VALUE, "key", "ts", bucket_rows=50)
    sinks.replace_latest(spark, path, spark.createDataFrame([("k7", T, -1.0), ("k8", T - timedelta(1), -1.0)], VALUE), "key", "ts")
    few = spark.createDataFrame([("k7",), ("k8",), ("none",)], "key string")
    df = sinks.latest(spark, path, VALUE, "key", "ts", few)
    assert {r["key"]: r["value"] for r in df.collect()} == {"k7": -1.0, "k8": 8.0}  # at equal times the later batch wins
    now = versions.state(spark, path)
    part = versions.stored(spark, path, VALUE, "key", few, versions.State(now.compacted, now.buckets))
    assert now.buckets == 40 and "PartitionFilters: [bucket" in part._jdf.queryExecution().explainString(part.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert sinks.latest(spark, path, VALUE, "key", "ts").count() == 2000


def test_no_batches_no_rows(spark, tmp_path):
    assert sinks.headlines(spark, f"{tmp_path}/none").collect() == []
    sinks.compact_headlines(spark, f"{tmp_path}/none")
    path = f"{tmp_path}/h"
    sinks.upsert_headlines(spark, path, headlines(spark, 0, []))
    sinks.compact_headlines(spark, path)
    assert sinks.headlines(spark, path).collect() == []
