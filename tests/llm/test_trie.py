"""The prefix trie against a plain trie; subtree sums on trees of every shape."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest

from tidemark.llm import prefixtrie

TURNS = "conv_id bigint, turn bigint, role string, text string"


def plain_trie(convs):
    """{conv_id: [(role, text)]} -> the rows of `trie`."""
    nodes = {}
    for c, turns in sorted(convs.items()):
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    rows = set()
    for key, members in nodes.items():
        under = [k for k in nodes if k[: len(key)] == key]
        inner = {k[:-1] for k in under if k}
        ends = ",".join(str(c) for c in members if len(convs[c]) == len(key))
        rows.add((
            members[0], len(key), nodes[key[:-1]][0] if key else None, len(members),
            sum(len(k) == len(key) + 1 for k in under), sum(k not in inner for k in under),
            sum((len(nodes[k]) - 1) * len(k[-1][1]) for k in under if k), hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return rows


def plain_rebuild(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [t[2:] for t in sorted(x)] for c, x in convs.items()}
    out = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = convs.get(c - c % 100, [])[:h] + turns[h:]
    return convs, out


def rows_of(df):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return {tuple(r[n] for n in names) for r in df.collect()}


def some_turns():
    """Shared heads, copies, a long conversation, ties, nulls, gaps, an absent donor."""
    rng = random.Random(11)
    rows = []
    for c in [*range(40), 100, 101, 102, 230, 231, 305, 399]:
        head = [("user", f"hello {c % 3}"), ("bot", "é" * (c % 4))]
        own = [(rng.choice(["user", None]), rng.choice(["x", "yy", None, f"own {c}"])) for _ in range(rng.randrange(7))]
        rows += [(c, t, *turn) for t, turn in enumerate((head + own)[: rng.randrange(1, 9)])]
    rows += [(7000, t, "user", f"turn {t}") for t in range(90)] + [(7001, t, "user", f"turn {t}") for t in range(70)]
    rows += [(50, None, "user", "null turn"), (50, 1, "b", "tie"), (50, 1, "a", "tie"), (50, 1, "a", "tie"), (None, 1, "user", "lost")]
    rows += [(c, 0, "user", "hello 0") for c in range(500, 560)]
    return rows


@pytest.fixture
def many_slices(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_trie_matches_a_plain_one(spark, many_slices):
    rows = some_turns()
    df = spark.createDataFrame(rows, TURNS).repartition(5).selectExpr("*", "'x' AS depth", "1 AS slice", "2 AS size", "3 AS k1", "4 AS h")
    convs, rebuilt = plain_rebuild(rows)
    got = rows_of(prefixtrie.shared_heads(df))
    assert got == plain_trie(rebuilt)
    _, slices = prefixtrie.number(df)
    assert slices.filter("conv_id = 7000").count() > 1
    assert rows_of(prefixtrie.trie(*prefixtrie.whole(df))) == plain_trie(convs)


def test_no_turns_no_nodes(spark):
    assert prefixtrie.shared_heads(spark.createDataFrame([], TURNS)).collect() == []
    assert prefixtrie.shared_heads(spark.createDataFrame([(None, 1, "user", "x")], TURNS)).collect() == []


def test_rebuilt_conversations_without_turns_end_at_the_root(spark):
    none = next(c for c in range(150, 200) if zlib.crc32(str(c).encode()) % 6 > 1)
    rows = [(none, 0, "user", "one")]
    assert rows_of(prefixtrie.shared_heads(spark.createDataFrame(rows, TURNS))) == plain_trie({none: []})


@pytest.mark.parametrize("shape", ["path", "star", "random", "caterpillar", "forest"])
def test_subtree_sums(spark, shape):
    rng = random.Random(5)
    up = {
        "path": [None, *range(150)],
        "star": [None] + [0] * 150,
        "random": [None] + [rng.randrange(i) for i in range(1, 200)],
        "caterpillar": [None] + [i - 1 if i % 2 else max(0, i - 2) for i in range(1, 120)],
        "forest": [None if i % 40 == 0 else rng.randrange(i - i % 40, i) for i in range(160)],
    }[shape]
    rows = [(i, 0, p, 0, 1, i * i) for i, p in enumerate(up)]
    want = [[r[4], r[5]] for r in rows]
    for i in range(len(up) - 1, 0, -1):
        if up[i] is not None:
            want[up[i]] = [a + b for a, b in zip(want[up[i]], want[i], strict=True)]
    got = prefixtrie.subtree_sums(spark.createDataFrame(rows, "v bigint, d bigint, pv bigint, pd bigint, n_leaves bigint, saved bigint"))
    assert sorted((r["v"], r["n_leaves"], r["saved"]) for r in got.collect()) == [(i, *w) for i, w in enumerate(want)]


def test_ids_are_packed_in_order(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(prefixtrie, "PACK", 3)
    keys = [1] * 7 + [2] + [3] * 4
    batches = [pa.RecordBatch.from_pydict({"k1": keys[a:b], "k2": keys[a:b], "conv_id": list(range(a, b))}) for a, b in ((0, 2), (2, 9), (9, 12))]
    packed = [r for b in prefixtrie._pack(iter(batches)) for r in b.to_pylist()]
    assert all(len(r["ids"].split(",")) <= 3 for r in packed) and [r["first"] for r in packed if r["k1"] == 1] == [0, 3, 6]
    table = pa.RecordBatch.from_pylist([{k: r[k] for k in ("k1", "k2", "ids")} for r in packed])
    got = {r["k1"]: r["ends_sha256"] for b in prefixtrie._hash(iter([table])) for r in b.to_pylist()}
    assert got == {k: hashlib.sha256(",".join(str(i) for i, x in enumerate(keys) if x == k).encode()).hexdigest() for k in (1, 2, 3)}
