"""Benchmark decontamination: passages query a BM25 index of test items by block-max bounds.

The index holds test items, cut into parts of at most `PART` words; the last part of a longer
item holds its last `PART` words, so each word is in a part. A term's impact on a
part is its BM25 weight over the part's score against itself, so 1 means that a passage
holds all terms of the part and one threshold fits parts of any length. Postings are
grouped in blocks of `BLOCK` parts with the largest impact of each term in each block.

Every passage (windows of `PASSAGE` words, so close that each run of `PART` words lies
whole in one) is a query. As in WAND, a passage whose terms cannot reach the threshold by
their largest impacts is skipped; of the others, a block is opened only if the block
maxima reach it, and only the postings of open blocks are added up. Bounds are never below
a score, so all parts above the threshold are retrieved. A part is verified if the passage
also holds enough of the word pairs of its question (all sentences but the last) and of
its answer (the last sentence).

The index is collected and broadcast. Its size is worked out from the parts; more than
`SHARD_BYTES` of index is handled in shards of parts, one pass over the documents for each.
Document frequencies and the mean length are those of all parts, so shards change no score.

Nulls: null texts hold no passage, null items are skipped. A null doc_id is carried along.
Repeated rows give one result for each (doc_id, item_id). Texts without letters match
nothing; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.chars import Words, groups, mix
from tidemark.llm.common import small, small_batches, table

cloudpickle.register_pickle_by_value(sys.modules[__name__])

PART = 60
PASSAGE, STRIDE = 96, 36
BLOCK = 16
K1, B = 1.2, 0.75
THRESHOLD = 0.5
QUESTION, ANSWER = 0.6, 0.5
SHARD_BYTES = 64 << 20  # of index, of which each Python worker holds one
COMMON = 4  # a term in more than a block out of so many has its block maxima in a dense row
WORD_BYTES, PART_BYTES = 24 + 24 + 8 * COMMON + 40, 500  # most that a word and a part take in an index
GATHER = 1 << 20  # postings or block maxima added up at a time
OVERLAP = 8000  # characters that further pieces of a very long text repeat
FOUND = "doc_id bigint, item_id bigint, score double, question_overlap double, answer_overlap double, first_word bigint"


@dataclass
class Index:
    items: np.ndarray  # item of each part
    vocab: np.ndarray  # sorted word hashes
    offset: np.ndarray  # postings of term t: offset[t] to offset[t + 1]
    part: np.ndarray
    impact: np.ndarray
    most: np.ndarray  # (terms + 1,) largest impact; the last row is for words outside the index
    blocks: int
    block_offset: np.ndarray  # block maxima of term t: block_offset[t] to block_offset[t + 1]; none if it has a dense row
    block: np.ndarray
    block_most: np.ndarray
    row: np.ndarray  # (terms + 1,) dense row of each term; the first one is zero
    dense: np.ndarray  # (dense rows, blocks)
    pairs: list[tuple[np.ndarray, np.ndarray]]  # word pair hashes of question and answer


def _pairs(h: np.ndarray) -> np.ndarray:
    """Hashes of neighbouring words; a lone word stands for itself."""
    if len(h) < 2:
        return np.unique(h)
    return np.unique(mix(h[:-1] * np.uint64(31) + h[1:]))


def _starts(n: int) -> list[int]:
    """First words of the parts of an item; the last part overlaps the one before it."""
    return sorted({*range(0, n - PART + 1, PART), max(0, n - PART)})


def cut_item(text: str) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(word hashes, question pairs, answer pairs) of the parts of an item."""
    sentences = [s for s in re.split(r"(?<=[.!?])\s+|\n+", text) if Words([s.lower()]).counts[0]]
    hashes = [Words([s.lower()]).hash for s in sentences]
    if not hashes:
        return []
    words, out = np.concatenate(hashes), []
    for at in _starts(len(words)):
        piece = words[at : at + PART]
        split = len(words) - len(hashes[-1]) - at if len(hashes) > 1 else 0
        if not 0 < split < len(piece):  # one sentence, or a part that ends before the last
            split = max(1, len(piece) * 2 // 3)
        out.append((piece, _pairs(piece[:split]), _pairs(piece[split:])))
    return out


def build(items: list[tuple[int, str]]) -> Index:
    """The index of all parts of the items."""
    parts = [(item, *p) for item, text in sorted(items) for p in cut_item(text)]
    if not parts:
        return index([], np.zeros(0, np.uint64), np.zeros(0, np.int64), 0, 1.0)
    vocab, df = np.unique(np.concatenate([np.unique(p[1]) for p in parts]), return_counts=True)
    return index(parts, vocab, df, len(parts), sum(len(p[1]) for p in parts) / len(parts))


def index(parts: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]], vocab: np.ndarray, df: np.ndarray, total: int, mean: float) -> Index:
    """The index of some parts. vocab: their sorted words; df: how many of all `total` parts have each; mean: words of a part."""
    n = len(parts)
    if not n:
        none = np.zeros(0)
        offset = np.zeros(1, int)
        return Index(none, none.astype(np.uint64), offset, none, none, np.zeros(1), 0, offset, none, none, offset, np.zeros((1, 0)), [])
    owner = np.repeat(np.arange(n), [len(p[1]) for p in parts])
    term = np.searchsorted(vocab, np.concatenate([p[1] for p in parts]))
    key, tf = np.unique(term * np.int64(n) + owner, return_counts=True)
    term, part = key // n, key % n
    size = np.bincount(owner, minlength=n)
    idf = np.log(1 + (total - df + 0.5) / (df + 0.5))
    weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[part] / mean))
    impact = weight / np.bincount(part, weights=weight, minlength=n)[part]
    most = np.zeros(len(vocab) + 1)
    np.maximum.at(most, term, impact)
    blocks = -(-n // BLOCK)
    at = term * np.int64(blocks) + part // BLOCK  # sorted, as term and part are
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    block_most, of, block = np.maximum.reduceat(impact, first), term[first], at[first] % blocks
    held = np.bincount(of, minlength=len(vocab))
    common = held * COMMON > blocks
    row = np.zeros(len(vocab) + 1, dtype=np.int64)
    row[:-1][common] = np.arange(1, common.sum() + 1)
    dense = np.zeros((int(common.sum()) + 1, blocks))
    dense[row[of[common[of]]], block[common[of]]] = block_most[common[of]]
    rare = ~common[of]
    return Index(
        np.array([p[0] for p in parts]), vocab, _ends(np.bincount(term, minlength=len(vocab))), part, impact, most, blocks,
        _ends(np.where(common, 0, held)), block[rare], block_most[rare], row, dense, [(p[2], p[3]) for p in parts],
    )


def _ends(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts)])


def _slices(cost: np.ndarray, most: int) -> Iterator[slice]:
    """Slices of rows that cost no more than `GATHER` together, with `most` rows at most; one row if it costs more."""
    at, total = 0, _ends(cost)
    while at < len(cost):
        end = min(at + most, max(at + 1, int(np.searchsorted(total, total[at] + GATHER, "right")) - 1))
        yield slice(at, end)
        at = end


def _gather(offset: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, entry) of the entries of all terms of each row; the last term has none."""
    r, c = np.nonzero(terms < len(offset) - 1)
    term = terms[r, c]
    size = offset[term + 1] - offset[term]
    at = np.repeat(offset[term] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    return np.repeat(r, size), at


def search(ix: Index, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, part, score) of all pairs at or above the threshold.

    terms: (queries, width) term numbers, each row sorted, repeats and strangers replaced
    by len(vocab).
    """
    slack = THRESHOLD - 1e-9
    alive = np.flatnonzero(ix.most[terms].sum(1) >= slack)
    found = []
    entries = np.append(np.diff(ix.block_offset), 0)
    postings = np.append(np.diff(ix.offset), 0)
    for s in _slices(entries[terms[alive]].sum(1), max(1, GATHER // max(1, ix.blocks))):
        mine = terms[alive[s]]
        bound = np.zeros((len(mine), ix.blocks))
        rows = ix.row[mine]
        for col in np.flatnonzero(rows.any(0)):
            bound += ix.dense[rows[:, col]]
        r, at = _gather(ix.block_offset, mine)
        bound += np.bincount(r * ix.blocks + ix.block[at], weights=ix.block_most[at], minlength=bound.size).reshape(bound.shape)
        opened = bound >= slack
        some = np.flatnonzero(opened.any(1))
        for t in _slices(postings[mine[some]].sum(1), len(some)):
            r, at = _gather(ix.offset, mine[some[t]])
            part, w = ix.part[at], ix.impact[at]
            keep = opened[some[t]][r, part // BLOCK]
            key, back = np.unique(r[keep] * np.int64(len(ix.items)) + part[keep], return_inverse=True)
            score = np.bincount(back, weights=w[keep], minlength=len(key))
            good = score >= slack
            key = key[good]
            found.append((alive[s][some[t]][key // len(ix.items)], key % len(ix.items), np.minimum(score[good], 1.0)))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _passages(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(piece, first word, words) of the passages of pieces with so many words."""
    steps = np.where(counts > 0, np.maximum(1, -(-(counts - PASSAGE) // STRIDE) + 1), 0)
    piece = np.repeat(np.arange(len(counts)), steps)
    rank = np.arange(int(steps.sum())) - np.repeat(np.cumsum(steps) - steps, steps)
    at = np.minimum(rank * STRIDE, np.maximum(counts[piece] - PASSAGE, 0))
    return piece, (np.cumsum(counts) - counts)[piece] + at, np.minimum(PASSAGE, counts[piece] - at)


def matches(ix: Index, texts: list[str | None]) -> list[tuple[int, int, float, float, float, int]]:
    """(row, item, score, question overlap, answer overlap, first word of the passage)."""
    out = []
    if not len(ix.vocab):
        return out
    for group in groups(texts, OVERLAP):
        words = Words([p for _, p in group])
        piece, first, size = _passages(words.counts)
        if not len(piece):
            continue
        at = np.minimum(np.searchsorted(ix.vocab, words.hash), len(ix.vocab) - 1)
        term = np.where(ix.vocab[at] == words.hash, at, len(ix.vocab))
        col = np.arange(PASSAGE)
        base = np.cumsum(words.counts) - words.counts
        for a in range(0, len(piece), 4096):
            s = slice(a, a + 4096)
            rows = term[np.minimum(first[s, None] + col, len(term) - 1)]
            rows[col[None] >= size[s, None]] = len(ix.vocab)
            rows.sort(axis=1)
            rows[:, 1:][rows[:, 1:] == rows[:, :-1]] = len(ix.vocab)
            for q, part, score in zip(*search(ix, rows), strict=True):
                w = a + q
                have = _pairs(words.hash[first[w] : first[w] + size[w]])
                if size[w] > 1:
                    have = np.union1d(have, words.hash[first[w] : first[w] + size[w]])
                question, answer = (float(np.isin(p, have).mean()) if len(p) else 1.0 for p in ix.pairs[part])
                if question >= QUESTION and answer >= ANSWER:
                    out.append((group[piece[w]][0], int(ix.items[part]), float(score), question, answer, int(first[w] - base[piece[w]])))
    return out


PARTS = "item_id bigint, rank int, words binary, terms array<bigint>, question binary, answer binary"


def _cut_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """item_id, text -> parts, with their distinct words as terms."""
    names = ["item_id", "rank", "words", "terms", "question", "answer"]
    kinds = [pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.binary(), pa.binary()]
    for batch in batches:
        for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            cut = cut_item(text)
            for a in range(0, len(cut), 1000):
                rows = [(item, a + k, w.tobytes(), np.unique(w).view(np.int64), q.tobytes(), x.tobytes()) for k, (w, q, x) in enumerate(cut[a : a + 1000])]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def _shard(parts: DataFrame, df: DataFrame, total: int, mean: float) -> Index:
    """The index of some parts, with the document frequencies of all."""
    known = df.join(parts.select(F.explode("terms").alias("word")).distinct(), "word").toArrow()
    vocab, n = known.column("word").to_numpy().view(np.uint64), known.column("n").to_numpy()
    order = np.argsort(vocab)
    rows = parts.select("item_id", "rank", "words", "question", "answer").toArrow().sort_by([("item_id", "ascending"), ("rank", "ascending")])
    hashes = ([np.frombuffer(x, np.uint64) for x in rows.column(c).to_pylist()] for c in ("words", "question", "answer"))
    return index(list(zip(rows.column("item_id").to_pylist(), *hashes, strict=True)), vocab[order], n[order], total, mean)


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per (doc_id, item_id): the best passage's score and overlaps.

    Only documents that hold a verified passage of an item have rows.
    """
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    items = benchmark.filter(F.col("text").isNotNull() & F.col("item_id").isNotNull())
    parts = table(items.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(_cut_items, PARTS), "parts")
    total, words = parts.agg(F.count("*"), F.sum(F.octet_length("words") / 8)).first()
    df = table(parts.select(F.explode("terms").alias("word")).groupBy("word").agg(F.count("*").alias("n")), "words")
    shards = max(1, math.ceil(((words or 0) * WORD_BYTES + total * PART_BYTES) / SHARD_BYTES))
    found = None
    for k in range(shards):
        mine = parts.filter(F.pmod(F.xxhash64("item_id", "rank"), F.lit(shards)) == k)
        index_ = spark.sparkContext.broadcast(vars(_shard(mine, df, total, (words or 0) / max(1, total))))

        def run(batches: Iterator[pa.RecordBatch], index=index_) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            own = Index(**index.value)
            for batch in batches:
                ids = batch.column(0)
                hits = matches(own, batch.column(1).to_pylist())
                cols = list(zip(*hits, strict=True)) if hits else [[] for _ in range(6)]
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.int64()), *(pa.array(c, pa.float64()) for c in cols[2:5]), pa.array(cols[5], pa.int64())],
                    names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap", "first_word"],
                )

        part = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, FOUND)
        found = part if found is None else found.unionByName(part)
    best = F.max(F.struct("score", "question_overlap", "answer_overlap", (-F.col("first_word")).alias("first_word")))
    return (
        found.groupBy("doc_id", "item_id")
        .agg(best.alias("b"), F.count("*").alias("n_passages"))
        .select("doc_id", "item_id", "b.score", "b.question_overlap", "b.answer_overlap", (-F.col("b.first_word")).alias("first_word"), "n_passages")
    )


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """`docs` without the rows that hold a passage of the benchmark."""
    bad = small(table(leaks(docs, benchmark).select(F.col("doc_id").alias("_leak")).distinct(), "leaks"))
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["_leak"]), "left_anti")
