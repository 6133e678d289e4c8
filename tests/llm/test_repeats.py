"""Byte and word repeats against counting every window."""

from __future__ import annotations

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.data import empty, odd_docs, with_extras
from tidemark.llm import blocks, chars, columns, common


def brute_words(rows, width=35):
    seen, split = collections.Counter(), []
    for row in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", row[1] or "")
        split.append(w)
        seen.update(tuple(w[i : i + width]) for i in range(len(w) - width + 1))
    out = []
    for row, w in zip(rows, split, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i : i + width])] > 1:
                gone[i : i + width] = [True] * width
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((row[0], len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def brute_bytes(rows, width=400):
    seen, raw = collections.Counter(), []
    for row in rows:
        b = (row[1] or "").encode()
        raw.append(b)
        seen.update(b[i : i + width] for i in range(len(b) - width + 1))
    out = []
    for row, b in zip(rows, raw, strict=True):
        gone = bytearray(len(b))
        for i in range(len(b) - width + 1):
            if seen[b[i : i + width]] > 1:
                gone[i : i + width] = b"\1" * width
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((row[0], len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


CASES = [
    (blocks, brute_words, ["doc_id", "n_words", "n_removed", "kept_sha256"]),
    (columns, brute_bytes, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]),
]


@pytest.mark.parametrize("module,brute,names", CASES)
def test_repeats_match_counting_all_windows(spark, module, brute, names):
    df, rows = odd_docs(spark)
    got = sorted((tuple(r[n] for n in names) for r in module.remove_repeats(with_extras(df)).collect()), key=str)
    assert got == brute(rows)


@pytest.mark.parametrize("module,brute,names", CASES)
def test_repeats_of_no_rows(spark, module, brute, names):
    assert module.remove_repeats(empty(spark)).collect() == []


@pytest.mark.parametrize("module,brute,names", CASES)
def test_groups_of_texts_without_repeats(spark, module, brute, names):
    rng = random.Random(11)
    rows = [(i, " ".join(f"u{rng.randrange(10**9)}" for _ in range(120)), "en", "s", 1) for i in range(12)]
    rows += [(20, rows[0][1], "en", "s", 1), (21, "a b " + rows[1][1][:900], "en", "s", 1)]
    df = spark.createDataFrame(rows, empty(spark).schema).repartition(9)
    got = sorted((tuple(r[n] for n in names) for r in module.remove_repeats(df).collect()), key=str)
    assert got == brute(rows)


def test_pieces_of_a_long_text_join_up(spark, monkeypatch):
    monkeypatch.setattr(columns, "PIECE", 3000)
    rng = random.Random(8)
    text = "".join(rng.choice("abcdefgh ") for _ in range(14_000))
    whole = text[2500:3600] + " " + text
    rows = [(1, text, "en", "s", 1), (2, whole, "en", "s", 1)]
    parts = [x.tobytes() for x in np.concatenate([columns.segments([text.encode()])[1]]).reshape(-1, 1)]
    assert len(parts) == len(set(parts))
    h, content = {}, {}
    for t, at, anchor, more, a, c in zip(*columns.segments([r[1].encode() for r in rows]), strict=True):
        h.setdefault(int(a), set()).add((int(t), int(at) + int(anchor)))
        content[(int(t), int(at))] = (int(more), int(c))
    covered = collections.Counter()
    for (t, at), (more, _) in content.items():
        covered.update((t, at + i) for i in range(more + 1))
    assert set(covered.values()) == {1}
    assert len(covered) == sum(len(r[1]) - columns.LENGTH + 1 for r in rows)


def test_column_sort_against_comparing_all():
    rng = random.Random(2)
    strings, start, group = [], [], []
    for g in range(6):
        core = "".join(rng.choice("ab") for _ in range(900))
        for _ in range(5):
            s = rng.randrange(0, columns.REACH + 1)
            text = list(core[s : s + columns.LENGTH + rng.randrange(0, columns.REACH + 1 - s)])
            if rng.random() < 0.7:
                text[rng.randrange(len(text))] = "c"
            strings.append("".join(text).encode())
            start.append(s)
            group.append(g)
    start, group = np.array(start), np.array(group)
    size = np.array([len(s) for s in strings])
    windows = size - columns.LENGTH + 1
    found = columns.repeated_windows(np.frombuffer(b"".join(strings), np.uint8), np.cumsum(size) - size, start, start + size, group, windows)
    for i, s in enumerate(strings):
        for k in range(columns.REACH + 1):
            want = False
            if k < windows[i]:
                col = start[i] + k
                for j, t in enumerate(strings):
                    at = col - start[j]
                    if j != i and group[j] == group[i] and 0 <= at < windows[j]:
                        want |= t[at : at + columns.LENGTH] == s[k : k + columns.LENGTH]
            assert found[i, k] == want


def test_rolling_hash_of_blocks():
    words = chars.ByteWords([(" ".join(f"v{i % 7}" for i in range(100))).encode()]).hash
    h = blocks.rolling(words, blocks.WINDOW)
    assert h[0] == h[7] and h[0] != h[1] and h[3] == h[3 + 7 * 8]


def test_an_anchor_in_a_third_of_the_rows_is_in_no_single_sort(spark, monkeypatch):
    monkeypatch.setattr(columns, "CHUNK", 6000)
    sort = columns.repeated_windows

    def bounded(data, *rest):
        assert len(data) <= 5 * 6000
        return sort(data, *rest)

    monkeypatch.setattr(columns, "repeated_windows", bounded)
    rng = random.Random(21)
    noise = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    passage, long_passage, rows = noise(200), noise(700), []
    for i in range(270):
        middle = (passage, long_passage, noise(150))[0 if i % 3 == 0 else 1 if i % 9 == 1 else 2]
        rows.append((i, noise(400) + middle + noise(400), "en", "s", 1))
    rows += [(300 + i, noise(9) + rows[3 * i][1][150 + 7 * i : 650 + 7 * i] + noise(300), "en", "s", 1) for i in range(20)]
    df = spark.createDataFrame(rows, empty(spark).schema).repartition(4)
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    got = sorted((tuple(r[n] for n in names) for r in columns.remove_repeats(df).collect()), key=str)
    assert got == brute_bytes(rows)


def test_an_anchor_once_in_each_group_of_texts_is_in_no_single_sort(spark, monkeypatch):
    monkeypatch.setattr(columns, "CHUNK", 6000)
    monkeypatch.setattr(common, "BATCH_ROWS", 1)
    sort = columns.repeated_windows

    def bounded(data, *rest):
        assert len(data) <= 5 * 6000
        return sort(data, *rest)

    monkeypatch.setattr(columns, "repeated_windows", bounded)
    rng = random.Random(22)
    noise = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    passage = noise(300)
    rows = [(i, noise(400) + passage + noise(400), "en", "s", 1) for i in range(200)]
    rows += [(300 + i, noise(9) + rows[3 * i][1][150 + 7 * i : 750 + 7 * i] + noise(300), "en", "s", 1) for i in range(20)]
    df = spark.createDataFrame(rows, empty(spark).schema).repartition(4)
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    got = sorted((tuple(r[n] for n in names) for r in columns.remove_repeats(df).collect()), key=str)
    assert got == brute_bytes(rows)


def test_copies_of_a_frequent_text_meet_in_no_single_task(spark, monkeypatch):
    monkeypatch.setattr(columns, "OFTEN", 20, raising=False)
    written, write = {}, columns.table
    monkeypatch.setattr(columns, "table", lambda df, name: written.setdefault(name, write(df, name)))
    rng = random.Random(23)
    noise = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    often, short = noise(900), noise(300)
    rows = [(i, often if i % 4 else short if i % 8 else noise(700), "en", "s", 1) for i in range(480)]
    rows += [(500, noise(50) + often[100:650] + noise(60), "en", "s", 1), (501, short + noise(200), "en", "s", 1), (None, often, "en", "s", 1), rows[1], rows[1]]
    df = spark.createDataFrame(rows, empty(spark).schema).repartition(8)
    confs = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k) for k in confs}
    try:
        for k, v in confs.items():
            spark.conf.set(k, v)
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        got = sorted((tuple(r[n] for n in names) for r in columns.remove_repeats(df).collect()), key=str)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert got == brute_bytes(rows)
    assert max(r["count"] for r in written["state"].groupBy(F.input_file_name()).count().collect()) < 120
    assert written["dealt"].filter("local").count() == 0
