"""Near-duplicate texts and vectors against comparing all pairs; components; the pipeline."""

from __future__ import annotations

import os
import random
import re

import numpy as np
import pytest

import corpus_pipeline
from tests.llm.data import DOCS, empty, odd_docs, with_extras
from tidemark.llm import flatgraph, langid, linespread, mixing, oddsketch
from tidemark.llm.common import read, table
from tidemark.llm.components import components


def roots(nodes, links):
    up = {n: n for n in nodes}

    def find(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("shape", ["path", "star", "mixed"])
def test_components(spark, shape):
    rng = random.Random(3)
    links = {
        "path": [(i, i + 1) for i in range(200)],
        "star": [(77, i) for i in range(200) if i != 77],
        "mixed": [(rng.randrange(300), rng.randrange(300)) for _ in range(150)],
    }[shape]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    want = roots({n for e in links for n in e}, links)
    assert all(got.get(n, n) == want[n] for n in want)


def shingles(text, width=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def brute(rows, width=4):
    sets = {i: shingles(t, width) for i, t in rows}
    ids = sorted(sets)
    links = [
        (a, b) for n, a in enumerate(ids) for b in ids[n + 1 :]
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    ]
    root = roots(ids, links)
    return {(i, len(sets[i]), root[i], root[i] == i) for i in ids}


def near_rows(seed=9):
    """Chains, stars and crowds of near copies, edits of every strength."""
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(2000)]
    texts = []
    for size in (40, 120, 300):
        for _ in range(4):
            base = [rng.choice(vocab) for _ in range(size)]
            texts.append(" ".join(base))
            for edits in (1, 2, 3, 4, 6, 10):
                for _ in range(3):
                    w = base[:]
                    for _ in range(max(1, edits * size // 120)):
                        w[rng.randrange(size)] = rng.choice(vocab)
                    texts.append(" ".join(w))
            w = base[:]
            for _ in range(8):  # a chain: each one like the last
                w = w[:]
                w[rng.randrange(size)] = rng.choice(vocab)
                texts.append(" ".join(w).upper())
    texts += ["a b c", "A B C", "a  b\tc", "one", "", " ", None, "ÄB c d e", "äb c d e"]
    order = list(range(len(texts)))
    rng.shuffle(order)
    return [(i, texts[k]) for i, k in enumerate(order)]


@pytest.mark.parametrize("block", [2048, 16])
def test_near_duplicates_match_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(oddsketch, "BLOCK", block)
    rows = near_rows()
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS).repartition(4)
    got = oddsketch.near_duplicates(with_extras(df)).collect()
    assert {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got} == brute(rows)


def test_a_crowd_of_near_copies_is_one_component(spark):
    rng = random.Random(1)
    base = [f"b{i}" for i in range(100)]
    rows = []
    for i in range(400):
        w = base[:]
        w[rng.randrange(100)] = f"x{i}"
        rows.append((i, " ".join(w), "en", "s", 1))
    out = oddsketch.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    assert {r["component_id"] for r in out} == {0}


def test_near_duplicates_of_odd_rows_and_none(spark):
    df, rows = odd_docs(spark)
    out = oddsketch.near_duplicates(df).collect()
    assert len(out) == len(rows)
    assert {r["component_id"] for r in out if r["doc_id"] is None} == {0}
    assert oddsketch.near_duplicates(empty(spark)).collect() == []


def test_sketches_estimate_high_similarities():
    rng = np.random.default_rng(4)
    limit = oddsketch._most_bits()
    for share in (0.8, 0.85, 0.9, 0.95):
        n = 2000
        both = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        own = round(n * (1 - share) / (2 * share))
        a, b = (np.sort(np.concatenate([both, rng.integers(0, 1 << 63, own, dtype=np.uint64)])) for _ in "ab")
        sketch = oddsketch.signatures(np.concatenate([a, b]), np.array([len(a), len(b)]))[2]
        bits = int(np.bitwise_count(sketch[0] ^ sketch[1]).sum())
        assert bits <= limit
        k, m = oddsketch.BANDS * oddsketch.ROWS, oddsketch.SKETCH_BITS
        assert 1 + m / (4 * k) * np.log(1 - 2 * bits / m) == pytest.approx(share, abs=0.13)


def test_near_duplicates_on_five_words(spark):
    rng = random.Random(17)
    texts = []
    for edits in (2, 3):  # of 112 words, three edits leave 97 of 121 shingles of four words and 93 of 123 of five
        base = [f"v{edits}x{i}" for i in range(112)]
        w = base[:]
        for at in (20, 55, 90)[:edits]:
            w[at] = f"e{edits}x{at}"
        texts += [" ".join(base), " ".join(w)]
    rng.shuffle(texts)
    rows = near_rows() + [(1000 + i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS).repartition(4)
    four = brute(rows)
    want = brute(rows, 5)
    assert {r[0] for r in want if r[3]} > {r[0] for r in four if r[3]}
    got = oddsketch.near_duplicates(df, 5).collect()
    assert {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got} == want


VECTORS = "vec_id bigint, embedding array<float>, label int, kept string"


def vectors(seed=2, width=12):
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(20):
        centre = rng.normal(size=width)
        rows += [centre + rng.normal(0, s, width) for s in (0.02, 0.05, 0.1, 0.2) for _ in range(c % 7 + 1)]
    rows += [rng.normal(size=width) for _ in range(100)]
    rows += [rows[3], rows[3], rows[5] * 7, rows[5] * 1e-30]
    order = rng.permutation(len(rows))
    return [(i, np.float32(rows[k]).tolist(), 0, "x") for i, k in enumerate(order)]


def brute_vectors(rows):
    full = [(i, np.array(v, float)) for i, v, *_ in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    ids = [i for i, _ in full]
    links = []
    for n, (a, x) in enumerate(full):
        for b, y in full[n + 1 :]:
            if len(x) == len(y) and (x / np.abs(x).max() @ (y / np.abs(y).max())) >= 0.95 * np.linalg.norm(x / np.abs(x).max()) * np.linalg.norm(y / np.abs(y).max()):
                links.append((a, b))
    root = roots([r[0] for r in rows], links)
    count = dict.fromkeys(root, 0)
    for a, b in links:
        count[a] += 1
        count[b] += 1
    assert ids
    return {(i, count[i], root[i], root[i] == i) for i in root}


@pytest.mark.parametrize("most", [4000, 60])
def test_near_vectors_match_all_pairs(spark, monkeypatch, most):
    monkeypatch.setattr(flatgraph, "MOST", most)
    monkeypatch.setattr(flatgraph, "SHARD", most // 3)
    rows = vectors()
    n = len(rows)
    rows += [(n, None, 0, "x"), (n + 1, [], 0, "x"), (n + 2, [0.0] * 12, 0, "x"), (n + 3, [1.0, None], 0, "x"), (n + 4, [float("nan")] * 12, 0, "x"),
             (n + 5, [float("inf")] * 12, 0, "x"), (n + 6, rows[0][1][:5], 0, "x"), (n + 7, rows[0][1][:5], 1, "x")]
    df = spark.createDataFrame(rows, VECTORS).repartition(3)
    out = flatgraph.near_vectors(df)
    got = {(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in out.collect()}
    want = brute_vectors(rows)
    if most == 4000:
        assert got == want
    else:  # many small shards: a search, audited
        true = sum(w[1] for w in want)
        assert len(got) == len(want) and 0.9 * true <= sum(g[1] for g in got) <= true


def test_audit_counts_what_is_missed(spark):
    rows = [(i, [1.0, i / 1000, 0.0], 0, "x") for i in range(40)]
    df = spark.createDataFrame(rows, VECTORS)
    full = spark.createDataFrame([(i, 39) for i in range(40)], "vec_id bigint, n_links bigint")
    assert flatgraph.audit(df, full) == 1.0
    assert flatgraph.audit(df, full.selectExpr("vec_id", "cast(13 as bigint) as n_links")) == pytest.approx(1 / 3)


def crowd(n, width=12, spread=0.05, seed=6):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=width) + rng.normal(0, spread, (n, width))
    return [(i, v, 0, "x") for i, v in enumerate(np.float32(x).tolist())]


def bounded(make, most):
    def outer(threshold, width):
        run = make(threshold, width)

        def watched(rows):
            import tracemalloc

            tracemalloc.start()
            out, peak = run(rows), tracemalloc.get_traced_memory()[1]
            tracemalloc.stop()
            assert peak < most, f"{peak >> 20} MB"
            return out

        return watched

    return outer


def test_a_crowd_of_vectors_is_searched_in_bounded_memory(spark, monkeypatch):
    n = 1500
    monkeypatch.setattr(flatgraph, "_search", bounded(flatgraph._search, 64 << 20))
    out = flatgraph.near_vectors(spark.createDataFrame(crowd(n), VECTORS)).collect()
    assert {(r["n_links"], r["component_id"]) for r in out} == {(n - 1, 0)} and len(out) == n


def test_a_crowd_over_many_shards_is_not_written_in_pairs(spark, monkeypatch):
    n, written = 1200, {}
    monkeypatch.setattr(flatgraph, "MOST", 150)
    monkeypatch.setattr(flatgraph, "SHARD", 50)
    monkeypatch.setattr(flatgraph, "GUESTS", 100, raising=False)

    def counted(df, name):
        out = table(df, name)
        written[name] = max(written.get(name, 0), out.count())
        return out

    monkeypatch.setattr(flatgraph, "table", counted)
    out = flatgraph.near_vectors(spark.createDataFrame(crowd(n), VECTORS)).collect()
    assert len(out) == n and {r["component_id"] for r in out} == {0}
    assert sum(r["n_links"] for r in out) >= 0.999 * n * (n - 1)
    assert max(written.values()) < n * n / 20, written


def test_vectors_that_differ_by_a_factor_are_one_class(spark, monkeypatch):
    monkeypatch.setattr(flatgraph, "MOST", 60)
    written = {}

    def counted(df, name):
        out = table(df, name)
        written[name] = max(written.get(name, 0), out.count())
        return out

    monkeypatch.setattr(flatgraph, "table", counted)
    rows = [(i, [0.0, (i + 1) / 7, 0.0], 0, "x") for i in range(200)] + [(300 + i, [-(2.0**i), 0.0, 2.0**i], 0, "x") for i in range(20)]
    rows += [(400, [0.0, -1.0, 0.0], 0, "x"), (401, [0.0, 1.0], 0, "x"), (402, [1.0, 0.0], 0, "x")]
    out = flatgraph.near_vectors(spark.createDataFrame(rows, VECTORS)).collect()
    want = {i: (199, 0) for i in range(200)} | {300 + i: (19, 300) for i in range(20)} | {i: (0, i) for i in (400, 401, 402)}
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in out} == want
    assert written["vectors"] == 5


def test_repeated_vectors_and_none(spark):
    rows = [(1, [1.0, 0.0], 0, "x")] * 3 + [(2, [1.0, 0.01], 0, "x"), (None, [0.0, 1.0], 0, "x")]
    out = flatgraph.near_vectors(spark.createDataFrame(rows, VECTORS)).collect()
    assert sorted((r["vec_id"] or 0, r["n_links"]) for r in out) == [(0, 0), (1, 3), (1, 3), (1, 3), (2, 3)]
    assert flatgraph.near_vectors(spark.createDataFrame([], VECTORS)).collect() == []


FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables absent")
def test_pipeline_matches_a_plain_version(spark):
    """Stages 2 and 5 have SQL of their own; here the decisions of all five are made again in plain code."""
    docs = read(spark, FOLDER, "documents")
    rows = {r["doc_id"]: r.asDict() for r in docs.collect()}
    model = langid.train(docs)
    ids = sorted(rows)
    langs, scores, _, _ = langid.label_texts(model, [rows[i]["text"] for i in ids])
    left = {i: rows[i] for i, lang, s in zip(ids, langs, scores, strict=True) if lang != "und" and s >= corpus_pipeline.LEAST_SCORE}
    sites, keeper = {}, {}
    for i, r in left.items():
        for line in {x.strip(" ") for x in r["text"].split("\n")} - {""}:
            sites.setdefault(line, set()).add(r["source"])
            keeper[line] = min(keeper.get(line, i), i)
    texts = {}
    for i, r in left.items():
        drop = {x for x, s in sites.items() if len(s) >= linespread.MIN_SITES and keeper[x] != i}
        texts[i] = "\n".join(x for x in r["text"].split("\n") if x.strip(" ") not in drop)
    texts = {i: t for i, t in texts.items() if t.strip(" ")}
    kept = {i for i, _, _, k in brute(list(texts.items()), corpus_pipeline.SHINGLE) if k}
    assert corpus_pipeline.SHINGLE == 5
    plain = lambda t: " ".join(re.findall(r"[^\W\d_]+", t.lower()))
    items = [plain(r["text"]) for r in read(spark, FOLDER, "benchmark").collect()]
    clean = {i for i in kept if not any(f" {q} " in f" {plain(texts[i])} " for q in items)}
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, FOLDER).collect()}
    assert set(out) == clean
    for i, r in out.items():
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", texts[i]))
        assert r["taken"] <= mixing.EPOCHS * r["size"]


def test_stages_stand_odd_rows(spark, tmp_path):
    df, _ = odd_docs(spark)
    spark.createDataFrame([(1, "w1 w2 w3"), (None, None)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for docs in (with_extras(df), empty(spark)):
        names = docs.columns
        for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
            docs = stage(spark, docs, str(tmp_path))
            assert n == 4 or docs.columns == names
        rows = docs.collect()
        assert len({r["doc_id"] for r in rows}) == len(rows)
