"""Word-level language labels in code-switched text by a linear-chain CRF.

Words are runs of letters. The score of a label for a word adds up learned weights of its
character pairs and triples, its prefixes and suffixes of one to three letters (n-grams
that touch a word boundary), the word itself, and whether it stands in the lexicon that
was learned for a language; learned transitions tie neighbouring words. Forward-backward
over the whole text gives each word's probabilities; their mean is the document's, its
largest entry is lang_pred and score. Documents in two languages keep a lower score.

Training: at most about `TRAIN_ROWS` labelled rows for each language, chosen by a hash of
the id outside the held-out fold, one window of words at a hashed place of each. Sequences
join one to three windows, so changes of language are seen and transitions learned. The
model (weights of fixed size) is fitted in numpy on the driver and broadcast.

The forward-backward recursion is exact for any length: texts are cut into chunks whose
transfer matrices are multiplied in parallel, then messages pass along the chunks of a
document, then inside all chunks at once.

Nulls and texts without a letter give `und` with score 0. Null labels are not learned
from. Without labelled rows every text is `und`. Repeated rows give repeated results; extra
columns are ignored.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.chars import Words, groups
from tidemark.llm.common import WORD, held_out, small_batches

cloudpickle.register_pickle_by_value(sys.modules[__name__])

TRAIN_ROWS = 500  # labelled rows per language
WINDOW = 24  # words of a training window
SEQUENCES = 1600
STEPS = 60
FOLDS, FOLD = 4, 2
UNKNOWN = "und"
BITS = 17
CHUNK = 32
LEXICON = 150  # words per language at most


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # (2**BITS, K)
    lexicon: np.ndarray  # sorted word hashes
    lexicon_of: np.ndarray  # language of each
    lexicon_weights: np.ndarray  # (K, K)
    transition: np.ndarray  # (K, K)
    start: np.ndarray  # (K,)


def _lexicon_hit(m: Model, whole: np.ndarray) -> np.ndarray:
    """Language in whose lexicon each word stands, or -1."""
    if not len(m.lexicon):
        return np.full(len(whole), -1)
    at = np.minimum(np.searchsorted(m.lexicon, whole), len(m.lexicon) - 1)
    return np.where(m.lexicon[at] == whole, m.lexicon_of[at], -1)


def emissions(m: Model, words: Words) -> np.ndarray:
    """(words, K) scores of a group's words; each distinct word is scored once."""
    k = len(m.langs)
    if not len(words.hash):
        return np.zeros((0, k), dtype=np.float32)
    first, back = words.distinct()
    feats, of = words.features(first, BITS)
    score = np.stack([np.bincount(of, weights=m.weights[feats, j], minlength=len(first)) for j in range(k)], 1)
    hit = _lexicon_hit(m, words.hash[first])
    score[hit >= 0] += m.lexicon_weights[hit[hit >= 0]]
    return score.astype(np.float32)[back]


def posterior_sums(m: Model, score: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """(documents, K) sums of word marginals; `score` holds the words of all documents."""
    k = len(m.langs)
    docs = len(lengths)
    out = np.zeros((docs, k))
    if not len(score):
        return out
    em = np.exp(np.maximum(score - score.max(1, keepdims=True), -40)).astype(np.float64)
    move = np.exp(m.transition - m.transition.max()).astype(np.float64)
    begin = np.exp(m.start - m.start.max()).astype(np.float64)
    chunks = -(-lengths // CHUNK)
    n = int(chunks.sum())
    doc = np.repeat(np.arange(docs), chunks)
    rank = np.arange(n) - np.repeat(np.cumsum(chunks) - chunks, chunks)
    first = np.repeat(np.cumsum(lengths) - lengths, chunks) + rank * CHUNK
    size = np.minimum(CHUNK, np.repeat(lengths, chunks) - rank * CHUNK)
    step = np.arange(CHUNK)
    real = step < size[:, None]
    e = em[np.minimum(first[:, None] + step, len(em) - 1)]  # (n, CHUNK, K)
    head = rank == 0
    # Transfer matrix of each chunk; a document's first word takes the start scores.
    mat = np.where(head[:, None, None], begin[None, None, :], move[None]) * e[:, 0][:, None, :]
    for t in range(1, CHUNK):
        on = np.flatnonzero(real[:, t])
        if not len(on):
            break
        nxt = (mat[on].reshape(-1, k) @ move).reshape(-1, k, k) * e[on, t][:, None, :]
        mat[on] = nxt / nxt.max(axis=(1, 2), keepdims=True)
    # Messages into and out of each chunk, along the chunks of all documents at once.
    into, back = np.full((n, k), 1.0 / k), np.full((n, k), 1.0)
    base = np.cumsum(chunks) - chunks
    order = np.argsort(-chunks, kind="stable")
    most = int(chunks.max())
    longer = np.searchsorted(-chunks[order], -np.arange(1, most + 1), side="right")  # documents with more than r chunks
    for r in range(most - 1):
        at = base[order[: longer[r + 1]]] + r
        v = np.matmul(into[at][:, None, :], mat[at])[:, 0]
        into[at + 1] = v / v.sum(1, keepdims=True)
    for r in range(most - 1, 0, -1):
        at = base[order[: longer[r]]] + r
        v = np.matmul(mat[at], back[at][:, :, None])[:, :, 0]
        back[at - 1] = v / v.sum(1, keepdims=True)
    forward = np.zeros((n, CHUNK, k))
    f = into
    for t in range(CHUNK):
        f = f @ move if t else np.where(head[:, None], begin[None], f @ move)
        f = f * e[:, t]
        f = f / np.maximum(f.sum(1, keepdims=True), 1e-300)
        forward[:, t] = f
    g, sums = back, np.zeros((n, k))
    for t in range(CHUNK - 1, -1, -1):
        on = real[:, t]
        p = forward[:, t] * g
        p = p / np.maximum(p.sum(1, keepdims=True), 1e-300)
        sums[on] += p[on]
        nxt = (g * e[:, t]) @ move.T
        g = np.where(on[:, None], nxt / np.maximum(nxt.sum(1, keepdims=True), 1e-300), g)
    for j in range(k):
        out[:, j] = np.bincount(doc, weights=sums[:, j], minlength=docs)
    return out


def fit(rows: list[tuple[str, str]], seed: int = 7) -> Model:
    """Fit on (lang, window of text) pairs."""
    langs = sorted({lang for lang, _ in rows})
    k = len(langs)
    m = Model(langs, np.zeros((1 << BITS, k), np.float32), np.zeros(0, np.uint64), np.zeros(0, np.int64),
              np.zeros((k, k), np.float32), np.zeros((k, k)), np.zeros(k))
    if not k:
        return m
    rng = np.random.default_rng(seed)
    seen = [[] for _ in langs]
    parts = []
    for lang, text in sorted(rows):
        words = Words([text.lower()])
        whole = words.hash
        if len(whole):
            feats, of = words.features(np.arange(len(whole)), BITS)
            parts.append((langs.index(lang), feats, of, whole))
            seen[langs.index(lang)].append(whole)
    if not parts:
        return m
    # Lexicons: frequent words that stand nine times in ten in one language.
    words, back = np.unique(np.concatenate([p[3] for p in parts]), return_inverse=True)
    counts = np.zeros((len(words), k))
    np.add.at(counts, (back, np.repeat([p[0] for p in parts], [len(p[3]) for p in parts])), 1)
    rate = counts / np.maximum(counts.sum(0), 1)
    best = rate.argmax(1)
    clear = (counts.max(1) >= 3) & (rate.max(1) >= 0.9 * rate.sum(1))
    chosen = np.concatenate(
        [x[np.argsort(-counts[x, j], kind="stable")[:LEXICON]] for j in range(k) for x in [np.flatnonzero(clear & (best == j))]]
    ).astype(np.int64)
    chosen.sort()
    m.lexicon, m.lexicon_of = words[chosen], best[chosen]

    # Sequences of one to three windows, padded to the longest.
    by = [[i for i, p in enumerate(parts) if p[0] == j] for j in range(k)]
    have = [j for j in range(k) if by[j]]
    take = [[int(rng.choice(by[rng.choice(have)])) for _ in range(int(rng.choice([1, 2, 3], p=[0.6, 0.2, 0.2])))] for _ in range(SEQUENCES)]
    label, feats, of, hits, where = [], [], [], [], []
    width = max(sum(len(parts[i][3]) for i in seq) for seq in take)
    word = 0
    for s, seq in enumerate(take):
        t = 0
        for i in seq:
            lang, f, o, whole = parts[i]
            feats.append(f)
            of.append(o + word)
            hits.append(_lexicon_hit(m, whole))
            label += [lang] * len(whole)
            where.append(s * width + t + np.arange(len(whole)))
            word, t = word + len(whole), t + len(whole)
    feats, of, hits, where = map(np.concatenate, (feats, of, hits, where))
    label = np.array(label)
    used, feats = np.unique(feats, return_inverse=True)
    y = np.full(SEQUENCES * width, -1)
    y[where] = label
    y = y.reshape(SEQUENCES, width)
    real = y >= 0
    pair_from, pair_to = y[:, :-1][real[:, 1:]], y[:, 1:][real[:, 1:]]
    true_move = np.zeros((k, k))
    np.add.at(true_move, (pair_from, pair_to), 1)
    true_start = np.bincount(y[:, 0][real[:, 0]], minlength=k).astype(float)
    theta = [np.zeros((len(used), k)), np.zeros((k, k)), np.zeros((k, k)), np.zeros(k)]
    first, second = [np.zeros_like(x) for x in theta], [np.zeros_like(x) for x in theta]
    onehot = np.eye(k)
    for it in range(1, STEPS + 1):
        w, lex, move, start = theta
        score = np.stack([np.bincount(of, weights=w[feats, j], minlength=word) for j in range(k)], 1)
        score[hits >= 0] += lex[hits[hits >= 0]]
        grid = np.zeros((SEQUENCES * width, k))
        grid[where] = score
        e = np.exp(np.maximum(grid - grid.max(1, keepdims=True), -40)).reshape(SEQUENCES, width, k)
        a = np.exp(move)
        f = np.zeros((SEQUENCES, width, k))
        v = np.exp(start)[None] * e[:, 0]
        f[:, 0] = v / v.sum(1, keepdims=True)
        for t in range(1, width):
            v = (f[:, t - 1] @ a) * e[:, t]
            f[:, t] = np.where(real[:, t : t + 1], v / v.sum(1, keepdims=True), f[:, t - 1])
        g = np.ones((SEQUENCES, k))
        post = np.zeros_like(f)
        want = np.zeros((k, k))
        for t in range(width - 1, -1, -1):
            p = f[:, t] * g
            post[:, t] = p / p.sum(1, keepdims=True)
            if t:
                on = real[:, t]
                right = e[:, t] * g
                joint = f[:, t - 1][:, :, None] * a[None] * right[:, None, :]
                joint = joint / joint.sum(axis=(1, 2), keepdims=True)
                want += joint[on].sum(0)
                nxt = right @ a.T
                g = np.where(on[:, None], nxt / nxt.sum(1, keepdims=True), g)
        diff = post.reshape(-1, k)[where] - onehot[label]
        grads = [
            np.stack([np.bincount(feats, weights=diff[of, j], minlength=len(used)) for j in range(k)], 1),
            np.stack([np.bincount(hits[hits >= 0], weights=diff[hits >= 0, j], minlength=k)[:k] for j in range(k)], 1),
            want - true_move,
            post[:, 0][real[:, 0]].sum(0) - true_start,
        ]
        for i, (x, grad) in enumerate(zip(theta, grads, strict=True)):
            grad = grad / word + 1e-5 * x
            first[i] = 0.9 * first[i] + 0.1 * grad
            second[i] = 0.99 * second[i] + 0.01 * grad * grad
            x -= 0.1 * (first[i] / (1 - 0.9**it)) / (np.sqrt(second[i] / (1 - 0.99**it)) + 1e-8)
    m.weights[used] = theta[0]
    m.lexicon_weights, m.transition, m.start = theta[1].astype(np.float32), theta[2], theta[3]
    return m


def train(docs: DataFrame, rows_per_lang: int = TRAIN_ROWS) -> Model:
    """Fit on a bounded sample of labelled rows outside the held-out fold."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"), FOLDS, FOLD))
    counts = known.groupBy("lang").count().collect()  # one row per language
    share = F.lit(0.0)
    for r in counts:
        share = F.when(F.col("lang") == r["lang"], min(1.0, rows_per_lang / r["count"])).otherwise(share)
    draw = F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    words = F.regexp_extract_all("text", F.lit(f"({WORD})"))
    begin = F.pmod(F.xxhash64(F.lit(13), "doc_id"), F.greatest(F.size("w") - WINDOW, F.lit(0)) + 1).cast("int") + 1
    sample = known.filter(draw < share).select("doc_id", "lang", words.alias("w"))
    got = sample.select("lang", F.array_join(F.slice("w", begin, WINDOW), " ").alias("t")).collect()
    return fit([(r["lang"], r["t"]) for r in got])


def label_texts(m: Model, texts: list[str | None]) -> tuple[list[str], list[float], list[int], list[float]]:
    """(lang_pred, score, words, score of the second language) of each text."""
    if not m.langs:
        return [UNKNOWN] * len(texts), [0.0] * len(texts), [0] * len(texts), [0.0] * len(texts)
    langs, scores, sizes, second = [], [], [], []

    def flush(rows: list[int], ems: list[np.ndarray]) -> None:
        found, lengths = np.unique(rows, return_counts=True)
        lengths = np.bincount(np.searchsorted(found, rows), weights=[len(x) for x in ems]).astype(np.int64)
        for n, row in zip(lengths, posterior_sums(m, np.concatenate(ems), lengths), strict=True):
            if not n:
                langs.append(UNKNOWN), scores.append(0.0), second.append(0.0)
            else:
                share = np.sort(row / n)
                langs.append(m.langs[int(row.argmax())]), scores.append(float(min(1.0, share[-1])))
                second.append(float(share[-2]) if len(share) > 1 else 0.0)
            sizes.append(int(n))

    rows, ems = [], []  # a text of several pieces stays together
    for group in groups(texts):
        if rows and group[0][0] != rows[-1]:
            flush(rows, ems)
            rows, ems = [], []
        words = Words([piece for _, piece in group])
        ems += np.split(emissions(m, words), np.cumsum(words.counts)[:-1])
        rows += [row for row, _ in group]
    if rows:
        flush(rows, ems)
    return langs, scores, sizes, second


def predict(docs: DataFrame, model: Model, prefix: str = "") -> DataFrame:
    """`docs` (text and any others) with lang_pred, score, n_letter_words, second_score, named after `prefix`."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))
    added = [prefix + n for n in ("lang_pred", "score", "n_letter_words", "second_score")]
    schema = T.StructType(list(docs.schema.fields))
    for name, kind in zip(added, (T.StringType(), T.DoubleType(), T.LongType(), T.DoubleType()), strict=True):
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(**shared.value)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            langs, scores, sizes, second = label_texts(m, texts)
            arrays = [*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64()),
                      pa.array(sizes, pa.int64()), pa.array(second, pa.float64())]
            names = [*batch.schema.names, *added]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return docs.mapInArrow(run, schema)


def label_documents(docs: DataFrame) -> DataFrame:
    """The contract of op1: doc_id, held_out, lang_pred, score."""
    model = train(docs)
    out = predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out(F.col("doc_id"), FOLDS, FOLD).alias("held_out"), "lang_pred", "score", "n_letter_words")
