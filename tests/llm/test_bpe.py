"""Word BPE against the tokenizers library, on every code point and on words of every kind."""

from __future__ import annotations

import hashlib
import os
import random

import numpy as np
import pytest

from tests.llm.data import DOCS, empty, odd_docs, with_extras
from tidemark.llm import bpe

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.load(PATH))


def ids_of(library, texts):
    return [np.array(x.ids, "<u4").tobytes() for x in library.encode_batch(texts, add_special_tokens=False)]


def random_texts(seed, n):
    rng = random.Random(seed)
    some = ["a", "b", "e", "t", "h", "s", "'", "'ll", "the", "ing", "é", "Σ", "σας", "İ", " ", "\n", "\x1c", "<|endoftext|>", "<|startoftext|>", "<|", "12", "!!", "日本", "🙂", "́", "x" * 50, "haha", "oooo", "Ᲊ", "՘"]
    return ["".join(rng.choice(some) for _ in range(rng.randrange(60))) for _ in range(n)]


def test_all_code_points(encoder, library):
    texts = [f"a{chr(c)}b {chr(c)}1" for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    assert encoder.encode(texts) == ids_of(library, texts)


@pytest.mark.parametrize("alone", [bpe.ALONE, 20, 0])
def test_random_texts(encoder, library, monkeypatch, alone):
    monkeypatch.setattr(bpe, "ALONE", alone)
    encoder.held.clear()
    texts = random_texts(alone, 600)
    assert encoder.encode(texts) == ids_of(library, texts)


def test_a_long_word_and_a_long_text_in_pieces(encoder, library, monkeypatch):
    rng = random.Random(3)
    texts = ["".join(rng.choice("aeioulnrst") for _ in range(30_000)), " ".join(random_texts(2, 800))]
    want = ids_of(library, texts)
    assert encoder.encode(texts) == want
    monkeypatch.setattr(bpe, "PIECE", 500)
    monkeypatch.setattr(bpe, "CACHE", 300)
    assert encoder.encode(texts) == want and len(encoder.held) <= 300


def test_each_prefix_has_one_last_token(encoder):
    """Of the entries that end a prefix exactly one goes with what is before it."""
    v = encoder.v
    for word in (b"antidisestablishment", b"aaaaaaaa", b"hahahahaha", "übergrößen".encode()):
        last, state, matched = [-1], np.zeros(1, np.int64), np.zeros(1, np.int64)
        for i, c in enumerate(word):
            state, matched = encoder._walk(state, matched, np.array([c]))
            at, fit = int(state[0]), []
            if v.token[at] < 0 or matched[0] != v.length[at]:
                at = int(v.above[at])
            while at:
                begin = i + 1 - int(v.length[at])
                if begin == 0 or bpe._apart(v, np.array([last[begin]]), np.array([v.token[at]]))[0]:
                    fit.append(int(v.token[at]))
                at = int(v.above[at])
            assert len(fit) == 1
            last += fit


def test_another_kind_of_file_is_refused(tmp_path):
    import json

    with open(PATH, encoding="utf-8") as f:
        spec = json.load(f)
    spec["normalizer"]["normalizers"] = spec["normalizer"]["normalizers"][:1]
    (tmp_path / "t.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError, match="kind"):
        bpe.load(str(tmp_path / "t.json"))


def want_rows(library, rows):
    ids = ids_of(library, [t or "" for _, t in rows])
    decoded = [library.decode(np.frombuffer(x, "<u4").tolist(), skip_special_tokens=False) for x in ids]
    return sorted((str(i), len(x) // 4, hashlib.sha256(x).hexdigest(), hashlib.sha256(d.encode()).hexdigest()) for (i, _), x, d in zip(rows, ids, decoded, strict=True))


def got_rows(df):
    return sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in df.collect())


def test_query_on_odd_rows_and_none(spark, library):
    df, rows = odd_docs(spark)
    extra = [(2000 + i, t, "en", "s", 1) for i, t in enumerate(random_texts(8, 300))]
    df = with_extras(df.unionByName(spark.createDataFrame(extra, DOCS)))
    assert got_rows(bpe.digests(df, PATH)) == want_rows(library, [r[:2] for r in rows + extra])
    assert bpe.digests(empty(spark), PATH).collect() == []


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="driver tables absent")
def test_query_on_all_documents(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert got_rows(bpe.digests(docs, PATH)) == want_rows(library, [(r["doc_id"], r["text"]) for r in docs.collect()])
