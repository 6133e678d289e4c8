"""Ranked search with bit slices against scoring every document."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tests.llm.data import DOCS, empty, odd_docs, with_extras
from tidemark.llm import bitslices

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items):
    """[(doc_id, text)], [(item_id, text)] -> rows of `search`."""
    counts = [(i, Counter(terms_of(t))) for i, t in docs]
    counts = [(i, c, sum(c.values())) for i, c in counts if c]
    n, words, df = len(counts), sum(s for _, _, s in counts), Counter(t for _, c, _ in counts for t in c)
    asked = {}
    for i, t in items:
        if i is not None:
            asked.setdefault(i, set()).update(terms_of(t))
    out = []
    for i, terms in asked.items():
        scored = []
        for d, c, size in counts:
            m = 10 + (90 * size * n) // words
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if t in c)
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out += [(i, r + 1, d, -s) for r, (s, _, _, d) in enumerate(sorted(scored)[:10])]
    return sorted(out, key=str)


def rows(df):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()), key=str)


def corpus(seed=2, n=700):
    rng = random.Random(seed)
    vocab = [f"t{i}" for i in range(400)]
    say = lambda k: " ".join(rng.choice(vocab[: rng.choice([20, 400])]) for _ in range(k))
    docs = [(i, say(rng.choice([3, 30, 30, 200]))) for i in range(n)]
    docs += [(n + i, docs[5][1]) for i in range(60)] + [(2000, say(20_000)), (2001, "É1 é1 ABC-abc " * 30), (2002, "x" * 5000)]
    items = [(i, say(rng.randrange(1, 40))) for i in range(30)] + [(40, docs[5][1]), (41, "é1 abc"), (42, None), (43, "nowhere"), (None, "t1"), (1, "t7 t7"), (44, "")]
    return docs, items


@pytest.mark.parametrize("small", [False, True])
def test_search_matches_scoring_all(spark, monkeypatch, small):
    docs, items = corpus()
    if small:  # many small blocks, dense signatures, terms sent on early, several shards of items
        for name, value in {"BLOCK_BITS": 1 << 12, "BITS_PER_KEY": 1, "HELD_TERMS": 50, "FIRST": 3, "SHARD_TERMS": 100}.items():
            monkeypatch.setattr(bitslices, name, value)
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in docs], DOCS).repartition(3)
    asked = spark.createDataFrame(items, "item_id bigint, text string").selectExpr("*", "'x' AS term", "1 AS n", "2 AS doc_id")
    assert rows(bitslices.search(with_extras(df), asked)) == plain(docs, items)


def test_odd_rows_and_none(spark):
    df, docs = odd_docs(spark)
    items = [(1, "w1 w2 w3 abc def rep"), (2, docs[0][1])]
    asked = spark.createDataFrame(items, "item_id bigint, text string")
    assert rows(bitslices.search(df, asked)) == plain([d[:2] for d in docs], items)
    assert bitslices.search(empty(spark), asked).collect() == [] and bitslices.search(df, asked.limit(0)).collect() == []


def test_signatures_never_miss_a_term():
    blocks = bitslices.Blocks()
    texts = [f"a{i % 7} " * (i % 20 + 1) + " ".join(f"b{j}" for j in range(i)) for i in range(40)]
    made = [b for i, t in enumerate(texts) for b in blocks.add(i, i, t)] + [b for b in blocks.rest() if "rows" in b]
    assert sorted(i for b in made for i in b["ids"]) == list(range(40))
    for b in made:
        bits = np.unpackbits(np.frombuffer(b["bits"], np.uint8).reshape(b["rows"], -1), axis=1)
        for col, i in enumerate(b["ids"]):
            terms, counts = bitslices.term_counts(texts[i])
            for k, step in enumerate(bitslices.STEPS):
                at = bitslices._places(bitslices._key(terms[counts >= step], k), b["rows"])
                assert bits[at, col].all()


def test_long_texts_are_cut_between_terms(monkeypatch):
    monkeypatch.setattr(bitslices, "SLAB", 64)
    text = " ".join(f"w{i % 50}" for i in range(500)) + " " + "y" * 300 + " end"
    terms, counts = bitslices.term_counts(text)
    assert len(terms) == 52 and counts.sum() == 502
