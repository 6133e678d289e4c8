"""Line spread, mixing and WARC: against SQL on the driver's tables and on odd rows."""

from __future__ import annotations

import collections
import os

import pytest

from catalog.base import Entry
from check import compare, oracle
from tests.llm.data import empty, odd_docs, with_extras
from tidemark.llm import linespread, mixing, warc
from tidemark.llm.catalog import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables absent")
@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, name):
    assert compare(spark, oracle(FOLDER), Entry(QUERIES[name], SQL[name]), FOLDER)[0] == "equal"


def test_lines_on_many_sites_go_but_for_one(spark):
    rows = [(i, f"own {i}\nshared line\n\nnear {i % 9}\n shared line ", "en", f"s{i % 12}", 1) for i in range(60)]
    rows += [(None, "shared line", "en", "s1", 1), (None, None, "en", None, 1), (500, "shared line\nlast", "en", None, 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    out = {r["doc_id"]: r for r in linespread.drop_boilerplate(with_extras(df)).filter("doc_id is not null").collect()}
    assert out[0]["text"] == rows[0][1] and out[0]["n_removed"] == 0
    assert out[5]["text"] == "own 5\n\nnear 5" and out[5]["n_removed"] == 2 and out[5]["n_lines"] == 5
    assert out[500]["text"] == "last"
    assert sorted(str(r["text"]) for r in linespread.drop_boilerplate(df).filter("doc_id is null").collect()) == ["", "None"]


@pytest.mark.parametrize("sites", [8, 9, 10, 11, 12, 30])
def test_spread_is_exact_near_the_threshold(spark, sites):
    rows = [(i, "line", "en", f"s{i % sites}", 1) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    removed = linespread.drop_boilerplate(df).groupBy().sum("n_removed").first()[0]
    assert removed == (199 if sites >= linespread.MIN_SITES else 0)


def test_lines_of_odd_rows_and_none(spark):
    df, rows = odd_docs(spark)
    assert linespread.drop_boilerplate(df).count() == len(rows)
    assert linespread.drop_boilerplate(empty(spark)).collect() == []


def water_fill(sizes, epochs=3):
    """Shares by sharing the excess again until none is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, free, left = {}, set(order), float(sum(sizes.values()))
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * left / total > epochs * sizes[s]}
        if not over:
            return target | {s: weight[s] * left / total for s in free}
        for s in over:
            target[s] = float(epochs * sizes[s])
            left -= target[s]
        free -= over
    return target


def test_mix_reaches_targets_and_repeats(spark):
    df, rows = odd_docs(spark)
    out = mixing.mix(with_extras(df)).collect()
    assert len(out) == len(rows)
    sizes, taken, target = collections.Counter(), collections.Counter(), {}
    for r in out:
        assert 0 <= r["taken"] <= mixing.EPOCHS * r["size"]
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    want = water_fill(sizes)
    for s in sizes:
        assert target[s] == pytest.approx(want[s])
        assert abs(taken[s] - target[s]) <= 1
    again = mixing.mix(df.repartition(3)).collect()
    assert sorted(out, key=str) == sorted(again, key=str)


def test_mix_clamps_and_empty(spark):
    rows = [(i, "x " * n, None, s, 0) for i, (s, n) in enumerate([("a", 500), ("b", 10), ("c", 20), (None, 5)])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = {r["source"]: (r["target"], r["taken"]) for r in mixing.mix(df).collect()}
    assert got["b"] == (30.0, 30) and got["c"] == (60.0, 60) and got[None] == (15.0, 15) and got["a"] == (430.0, 430)
    assert mixing.mix(empty(spark)).collect() == []
    blank = spark.createDataFrame([(1, None, None, "a", 0), (1, "", None, "a", 0)], df.schema)
    assert [(r["taken"], r["target"]) for r in mixing.mix(blank).collect()] == [(0, 0.0)] * 2


PAGES = "page_id bigint, url string, html string, extra string"


def test_archives_round_trip(spark, tmp_path):
    tricky = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1\r\n\r\n"
    html = [tricky, "", None, "é" * 700, "é" * 700, "z" * 999, "z" * 999, "é" * 700, "y" * 50_000]
    rows = [(i, f"http://x/{i}" if i % 2 else None, h, "e") for i, h in enumerate(html)] + [(None, "http://n\r\n/", "é" * 700, "e")]
    df = spark.createDataFrame(rows, PAGES)
    got = {r["page_id"]: r for r in warc.archived_pages(df).collect()}
    assert len(got) == len(rows)
    kinds = {k: (r["record_type"], r["refers_to"]) for k, r in got.items()}
    assert {k for k, v in kinds.items() if v == ("revisit", 7)} == {3, 4, None}
    assert got[4]["payload_bytes"] == 1400 and got[4]["payload_digest"] == got[7]["payload_digest"]
    folder = str(tmp_path / "w")
    warc.write_archives(df, folder)
    nested = warc.captures(warc.read_records(spark, folder)).collect()
    bodies = {r["metadata"]["fields"].get("page-id"): r["response"]["payload"] for r in nested if r["response"]["type"] == "response"}
    assert bodies["0"] == bytearray(tricky.encode()) and bodies["8"] == bytearray(b"y" * 50_000)
    assert all(r["request"] is not None for r in nested)
    assert all(r["response"]["payload_digest"] == r["response"]["told_digest"] for r in nested)
    # What a revisit names is the record id of the response that keeps the payload.
    ids = {r["response"]["record_id"]: r["metadata"]["fields"].get("page-id") for r in nested}
    assert {ids[r["response"]["refers_to"]] for r in nested if r["response"]["type"] == "revisit"} == {"7"}


RECORD = {"target_uri": None, "refers_to": None, "digest": None, "http_length": None, "payload": None, "fields": None}


def test_captures_of_odd_records(spark):
    """Two metadata records, none at all, a stray request, a revisit of something elsewhere."""
    rows = [
        RECORD | {"record_id": "a", "type": "response", "concurrent_to": None, "payload": bytearray(b"x"), "digest": "d"},
        RECORD | {"record_id": "m1", "type": "metadata", "concurrent_to": "a", "fields": {"k": "1"}},
        RECORD | {"record_id": "m2", "type": "metadata", "concurrent_to": "a", "fields": {"k": "2"}},
        RECORD | {"record_id": "q", "type": "request", "concurrent_to": "nowhere"},
        RECORD | {"record_id": "i", "type": "warcinfo", "concurrent_to": None},
        RECORD | {"record_id": "b", "type": "revisit", "concurrent_to": None, "refers_to": "a", "digest": "d", "http_length": 9},
        RECORD | {"record_id": "c", "type": "revisit", "concurrent_to": None, "refers_to": "gone", "digest": "d"},
    ]
    records = spark.createDataFrame([tuple(r[f.strip().split()[0]] for f in warc.RECORD.split(", ")) for r in rows], warc.RECORD)
    met = warc.captures(records)
    got = {r["capture_id"]: r for r in met.collect()}
    assert set(got) == {"a", "b", "c"} and got["a"]["metadata"]["fields"] == {"k": "2"}
    assert got["a"]["request"] is None and got["b"]["metadata"] is None and got["b"]["response"]["payload"] is None
    assert got["a"]["response"]["payload_bytes"] == 1 and got["b"]["response"]["payload_bytes"] == 9
    thin = met.select("capture_id", "response.refers_to", "response.type")
    assert {r["capture_id"]: r["kind"] for r in warc.resolve(thin, "type", "kind").collect()} == {"a": None, "b": "response", "c": None}


def test_archives_of_repeated_rows_and_none(spark):
    rows = [(1, "u", "q" * 2000, "e")] * 3 + [(0, "u", "q" * 2000, "e")]
    got = sorted((r["page_id"], r["record_type"]) for r in warc.archived_pages(spark.createDataFrame(rows, PAGES)).collect())
    assert got == [(0, "revisit"), (1, "response"), (1, "response"), (1, "response")]
    assert warc.archived_pages(spark.createDataFrame([], PAGES)).collect() == []
