"""Toxicity of texts: bidirectional GRU with attention pooling over overlapping windows.

A word's input is the mean embedding of its character features beside the sum of embeddings
of the word itself and of its stems (its first three to six letters), so that an inflected
form never seen is known by its stem (hashed tables, all learned). Windows of `WINDOW` words start every half
window, so each word is read in two contexts; every window of every text is scored, and a
text's score is that of its worst window, put on a scale by a logistic fit on labelled
texts that the network did not learn from. Forward and backward passes, attention and
their gradients are numpy; the weights have a fixed size and are broadcast.

Training: at most about `TRAIN_ROWS` labelled rows of each class outside the held-out
fold, of up to `TRAIN_WORDS` words, chosen by a hash of the id. Labels belong to texts, so
a toxic text teaches by its worst window (at first: the window with the word whose parts
are the most surprising in clean texts) and a clean text by all of its windows.

Nulls and texts without letters score 0. Without labels of both classes every text scores
0. Repeated rows give repeated results; extra columns are ignored.
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

from tidemark.llm.chars import Words, groups, slot
from tidemark.llm.common import held_out, n_words, small_batches

cloudpickle.register_pickle_by_value(sys.modules[__name__])

TRAIN_ROWS = 1500  # of each class
TRAIN_WORDS = 1000
FOLDS, FOLD = 3, 1
THRESHOLD = 0.7
WINDOW, STRIDE = 24, 12
HIDDEN, WORD_DIM, CHAR_DIM = 8, 8, 8
WORD_BITS, CHAR_BITS = 17, 13
STEMS = (3, 4, 5, 6)  # letters
ROUNDS, STEPS = 6, 100  # gradient steps, after every STEPS the worst windows are chosen anew
BATCH = 240
RATE = 0.01
WRONG = 0.05  # share of false labels the scale reckons with
DECAY = 0.5  # of the embeddings a step, times RATE
BLOCK = 4096  # windows scored at a time


@dataclass
class Net:
    """p: parameters by name; scale, shift: logistic scale of a text's score."""

    p: dict[str, np.ndarray]
    scale: float = 1.0
    shift: float = 0.0


def new_net(rng: np.random.Generator) -> Net:
    d = WORD_DIM + CHAR_DIM
    # The last row of the words stays zero: a stem that a word is too short for.
    p = {"words": np.zeros(((1 << WORD_BITS) + 1, WORD_DIM)), "chars": rng.normal(0, 0.3, (1 << CHAR_BITS, CHAR_DIM))}
    for side in "fb":
        p[f"x{side}"] = rng.normal(0, d**-0.5, (d, 3 * HIDDEN))
        p[f"h{side}"] = rng.normal(0, HIDDEN**-0.5, (HIDDEN, 3 * HIDDEN))
        p[f"c{side}"] = np.zeros(3 * HIDDEN)
    p["query"] = rng.normal(0, 0.3, 2 * HIDDEN)
    p["out"] = rng.normal(0, 0.3, 2 * HIDDEN)
    p["bias"] = np.full(1, -1.0)
    return Net({k: v.astype(np.float32) for k, v in p.items()})


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def windows(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(piece, first word, words) of all windows of pieces with so many words."""
    steps = np.where(counts > 0, np.maximum(1, -(-(counts - WINDOW) // STRIDE) + 1), 0)
    piece = np.repeat(np.arange(len(counts)), steps)
    rank = np.arange(int(steps.sum())) - np.repeat(np.cumsum(steps) - steps, steps)
    base = np.cumsum(counts) - counts
    # The last window ends with the text, so that it is full where the text is long enough.
    at = np.minimum(rank * STRIDE, np.maximum(counts[piece] - WINDOW, 0))
    return piece, base[piece] + at, np.minimum(WINDOW, counts[piece] - at)


def units(words: Words, chosen: np.ndarray) -> np.ndarray:
    """(1 + stems, chosen) rows of the word table: the word itself and its stems."""
    start, size = words.start[chosen], words.end[chosen] - words.start[chosen]
    out = [slot(words.hash[chosen] + np.uint64(17), WORD_BITS)]
    key = np.full(len(chosen), 29, dtype=np.uint64)
    for at in range(max(STEMS)):
        key = key * np.uint64(1_000_003) + words.code[np.minimum(start + at, len(words.code) - 1)]
        if at + 1 in STEMS:
            out.append(np.where(size > at, slot(key, WORD_BITS), 1 << WORD_BITS))
    return np.stack(out).astype(np.int64)


def word_inputs(p: dict[str, np.ndarray], words: Words, chosen: np.ndarray) -> tuple[np.ndarray, tuple]:
    """(chosen, dims) input of each chosen word, and what its gradient needs."""
    feats, of = words.features(chosen, CHAR_BITS)
    own = units(words, chosen)
    n = np.maximum(np.bincount(of, minlength=len(chosen)), 1).astype(np.float32)
    table = p["chars"]
    mean = np.stack([np.bincount(of, weights=table[feats, j], minlength=len(chosen)) for j in range(CHAR_DIM)], 1) / n[:, None]
    return np.concatenate([p["words"][own].sum(0), mean.astype(np.float32)], 1), (feats, of, own, n)


def _gru(x: np.ndarray, wh: np.ndarray, real: np.ndarray, order: range, keep: bool) -> tuple[np.ndarray, list]:
    """States of one direction. x: (steps, n, 3H) input part of update, reset and candidate."""
    n = x.shape[1]
    h = np.zeros((n, HIDDEN), np.float32)
    states, tape = np.zeros((x.shape[0], n, HIDDEN), np.float32), []
    for t in order:
        zr = _sigmoid(x[t, :, : 2 * HIDDEN] + h @ wh[:, : 2 * HIDDEN])
        z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
        cand = np.tanh(x[t, :, 2 * HIDDEN :] + (r * h) @ wh[:, 2 * HIDDEN :])
        nxt = h + z * (cand - h)
        nxt = np.where(real[t][:, None], nxt, h)
        if keep:
            tape.append((t, h, z, r, cand))
        states[t] = h = nxt
    return states, tape


def _gru_back(grad: np.ndarray, wh: np.ndarray, real: np.ndarray, tape: list) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the input part and of wh, from gradients of the states."""
    dx, dwh = np.zeros((*grad.shape[:2], 3 * HIDDEN), np.float32), np.zeros_like(wh)
    carry = np.zeros(grad.shape[1:], np.float32)
    for t, h, z, r, cand in reversed(tape):
        g = grad[t] + carry
        on = real[t][:, None]
        dc = g * z * (1 - cand * cand) * on
        drh = dc @ wh[:, 2 * HIDDEN :].T
        dz = g * (cand - h) * z * (1 - z) * on
        dr = drh * h * r * (1 - r)
        dzr = np.concatenate([dz, dr], 1)
        dx[t] = np.concatenate([dzr, dc], 1)
        dwh[:, : 2 * HIDDEN] += h.T @ dzr
        dwh[:, 2 * HIDDEN :] += (r * h).T @ dc
        carry = np.where(on, g * (1 - z) + drh * r + dzr @ wh[:, : 2 * HIDDEN].T, g)
    return dx, dwh


def forward(p: dict[str, np.ndarray], proj: dict[str, np.ndarray], ids: np.ndarray, size: np.ndarray, keep: bool = False):  # noqa: ANN201
    """Logits of windows. proj: input part of each distinct word; ids: (n, WINDOW) words."""
    real = (np.arange(WINDOW)[None] < size[:, None]).T  # (steps, n)
    turn = np.ascontiguousarray(ids.T)
    sf, tf = _gru(proj["f"][turn], p["hf"], real, range(WINDOW), keep)
    sb, tb = _gru(proj["b"][turn], p["hb"], real, range(WINDOW - 1, -1, -1), keep)
    states = np.concatenate([sf, sb], 2)
    a = np.where(real, states @ p["query"], -1e9)
    a = np.exp(a - a.max(0))
    a = a / a.sum(0)
    pooled = np.einsum("tn,tnh->nh", a, states)
    logit = pooled @ p["out"] + p["bias"]
    return logit, (real, turn, states, a, pooled, tf, tb)


def project(p: dict[str, np.ndarray], x: np.ndarray) -> dict[str, np.ndarray]:
    return {side: (x @ p[f"x{side}"] + p[f"c{side}"]).astype(np.float32) for side in "fb"}


def gradients(p: dict[str, np.ndarray], x: np.ndarray, parts: tuple, ids: np.ndarray, size: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients of the mean cross entropy of a batch of windows."""
    logit, (real, turn, states, a, pooled, tf, tb) = forward(p, project(p, x), ids, size, keep=True)
    d = ((_sigmoid(logit) - y) / len(y)).astype(np.float32)
    grads = {"out": pooled.T @ d, "bias": d.sum(keepdims=True)}
    dpool = d[:, None] * p["out"]
    da = np.einsum("nh,tnh->tn", dpool, states)
    da = a * (da - (a * da).sum(0))
    grads["query"] = np.einsum("tn,tnh->h", da, states)
    dstate = a[:, :, None] * dpool[None] + da[:, :, None] * p["query"]
    dx = np.zeros_like(x)
    for side, tape, part in (("f", tf, slice(0, HIDDEN)), ("b", tb, slice(HIDDEN, None))):
        dpre, grads[f"h{side}"] = _gru_back(np.ascontiguousarray(dstate[:, :, part]), p[f"h{side}"], real, tape)
        flat, where = dpre.reshape(-1, 3 * HIDDEN), turn.ravel()
        per_word = np.stack([np.bincount(where, weights=flat[:, j], minlength=len(x)) for j in range(3 * HIDDEN)], 1)
        grads[f"x{side}"] = x.T @ per_word
        grads[f"c{side}"] = per_word.sum(0)
        dx = dx + per_word @ p[f"x{side}"].T
    feats, of, own, n = parts
    each = own.ravel()
    grads["words"] = np.stack(
        [np.bincount(each, weights=np.tile(dx[:, j], len(own)), minlength=len(p["words"])) for j in range(WORD_DIM)], 1
    )
    dmean = dx[:, WORD_DIM:] / n[:, None]
    grads["chars"] = np.stack([np.bincount(feats, weights=dmean[of, j], minlength=1 << CHAR_BITS) for j in range(CHAR_DIM)], 1)
    return grads


def _window_ids(back: np.ndarray, first: np.ndarray) -> np.ndarray:
    return back[np.minimum(first[:, None] + np.arange(WINDOW), len(back) - 1)]


def window_logits(net: Net, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(piece, logit) of every window of a group."""
    piece, first, size = windows(words.counts)
    if not len(piece):
        return piece, np.zeros(0)
    chosen, back = words.distinct()
    proj = project(net.p, word_inputs(net.p, words, chosen)[0])
    out = np.empty(len(piece), np.float32)
    for at in range(0, len(piece), BLOCK):
        s = slice(at, at + BLOCK)
        out[s] = forward(net.p, proj, _window_ids(back, first[s]), size[s])[0]
    return piece, out


def score_texts(net: Net, texts: list[str | None]) -> list[float]:
    worst = np.full(len(texts), -np.inf)
    for group in groups(texts):
        words = Words([piece for _, piece in group])
        piece, logit = window_logits(net, words)
        np.maximum.at(worst, np.array([row for row, _ in group])[piece], logit)
    return [0.0 if w == -np.inf else float(_sigmoid(np.float64(net.scale * w + net.shift))) for w in worst]


def fit(rows: list[tuple[str, int]], seed: int = 5) -> Net | None:
    """Fit on (text, toxic) pairs; None without both classes."""
    rows = sorted(rows)
    rng = np.random.default_rng(seed)
    rows = [rows[i] for i in rng.permutation(len(rows))]
    y = np.array([int(t) for _, t in rows])
    if len(set(y.tolist())) < 2:
        return None
    net = new_net(rng)
    words = Words([t.lower() for t, _ in rows])
    piece, first, size = windows(words.counts)
    chosen, back = words.distinct()
    # (text, distinct word) pairs.
    text_of = np.repeat(np.arange(len(rows)), words.counts)
    pairs = np.unique(text_of * np.int64(len(chosen)) + back)
    holder, hit = pairs // len(chosen), pairs % len(chosen)
    ids = _window_ids(back, first)
    own = np.arange(WINDOW)[None] < size[:, None]
    # Words and stems in three texts or more have an embedding of their own; its first entry starts
    # at how surprising its share of toxic texts is. Rarer ones are known by their parts only.
    table = len(net.p["words"])
    in_all, in_toxic = np.zeros(table), np.zeros(table)
    for kind in units(words, chosen):
        held = np.unique(holder * np.int64(table) + kind[hit])
        in_all += np.bincount(held % table, minlength=table)
        in_toxic += np.bincount(held % table, weights=y[held // table], minlength=table)
    expected = np.maximum(in_all * y.mean(), 1e-9)
    surprise = np.clip((in_toxic - expected) / np.sqrt(expected) / 4, -1, 2)
    fresh = np.flatnonzero(in_all[:-1] >= 3)
    net.p["words"][fresh] = rng.normal(0, 0.1, (len(fresh), WORD_DIM))
    net.p["words"][fresh, 0] = surprise[fresh]
    telling = net.p["words"][units(words, chosen), 0].sum(0)
    rank = np.where(own, telling[ids], -np.inf).max(1)
    # One text in five only sets the scale.
    learn = np.arange(len(rows)) % 5 > 0
    # Of the word table only rows that the training texts know move.
    rows_of = {k: fresh if k == "words" else slice(None) for k in net.p}
    first_moment = {k: np.zeros(v[rows_of[k]].shape) for k, v in net.p.items()}
    second_moment = {k: np.zeros(v[rows_of[k]].shape) for k, v in net.p.items()}
    neg = np.flatnonzero((y[piece] == 0) & learn[piece])
    for step in range(1, ROUNDS * STEPS + 1):
        if step % STEPS == 1:
            if step > STEPS:  # the network itself names the worst windows now
                rank = window_logits(net, words)[1]
            order = np.lexsort((-rank, piece))
            top = order[np.unique(piece[order], return_index=True)[1]]
            top = top[learn[piece[top]]]
            pos, hard = top[y[piece[top]] == 1], top[y[piece[top]] == 0]
        # A third of a batch is toxic, a third the worst windows of clean texts.
        w = np.concatenate([rng.choice(x, BATCH // 3) for x in (pos, hard, neg)])
        used, local = np.unique(ids[w], return_inverse=True)
        x, parts = word_inputs(net.p, words, chosen[used])
        grads = gradients(net.p, x, parts, local.reshape(len(w), WINDOW), size[w], (y[piece[w]] == 1).astype(np.float32))
        for k, g in grads.items():
            g = g[rows_of[k]]
            first_moment[k] = 0.9 * first_moment[k] + 0.1 * g
            second_moment[k] = 0.99 * second_moment[k] + 0.01 * g * g
            up = RATE * (first_moment[k] / (1 - 0.9**step)) / (np.sqrt(second_moment[k] / (1 - 0.99**step)) + 1e-7)
            shrink = 1 - DECAY * RATE if k in ("words", "chars") else 1.0
            net.p[k][rows_of[k]] = net.p[k][rows_of[k]] * np.float32(shrink) - up.astype(np.float32)
    kept = np.flatnonzero(~learn) if len({*y[~learn].tolist()}) == 2 else np.arange(len(rows))
    worst = np.full(len(rows), -np.inf)
    np.maximum.at(worst, *window_logits(net, words))
    kept = kept[np.isfinite(worst[kept])]
    a, b = 1.0, 0.0
    w, t = worst[kept], y[kept]
    # Logistic fit in which a share WRONG of the labels of either class is false, with a weak pull to the plain scale.
    for _ in range(4000):
        q = _sigmoid(a * w + b)
        told = WRONG + (1 - 2 * WRONG) * q
        g = (told - t) / (told * (1 - told)) * (1 - 2 * WRONG) * q * (1 - q)
        a -= 0.05 * (np.mean(g * w) + 0.002 * (a - 1))
        b -= 0.05 * (np.mean(g) + 0.001 * b)
    net.scale, net.shift = float(a), float(b)
    return net


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Net | None:
    marked = labels.filter(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"), FOLDS, FOLD)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in marked.groupBy("toxic").count().collect()}  # one row per class
    draw = F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    share = F.when(F.col("toxic") == 1, min(1.0, 2.0 * rows / max(1, counts.get(1, 0)))).otherwise(min(1.0, 2.0 * rows / max(1, counts.get(0, 0))))
    drawn = marked.filter(draw < share)  # about 2 * rows of each class, so small enough to broadcast
    short = docs.select("doc_id", "text").filter(n_words(F.col("text")).between(1, TRAIN_WORDS))
    got = [(r["text"], int(r["toxic"] == 1)) for r in short.join(F.broadcast(drawn), "doc_id").select("text", "toxic").collect()]
    got.sort()
    for_class = [[x for x in got if x[1] == k] for k in (0, 1)]
    rng = np.random.default_rng(1)
    return fit([x[i] for x in for_class for i in sorted(rng.permutation(len(x))[:rows].tolist())])


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract of op3: doc_id, held_out, score, predicted."""
    small_batches(docs.sparkSession)
    net = train(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(vars(net) if net else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Net(**shared.value) if shared.value else None
        for batch in batches:
            texts = batch.column(1).to_pylist()
            scores = score_texts(own, texts) if own else [0.0] * len(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
    return out.select("doc_id", held_out(F.col("doc_id"), FOLDS, FOLD).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
