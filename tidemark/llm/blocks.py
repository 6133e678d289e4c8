"""Exact repeats of word runs by fixed-block anchors.

Any window of 35 words holds a whole block of 18 words that starts at a multiple of 18 in
its text. These non-overlapping reference blocks are indexed by hash, and every rolling
window of 18 words of every text probes the index; a block that is met again anchors a
possible repeat. Around the anchors, hits are extended to all windows of 35 words that
hold one; windows whose whole word sequence starts anywhere else too are the repeats, and
their union is the maximal repeated runs. No pairs of places are made: a block or window
of a million documents costs one entry for each group of texts, not a million squared.

Words are told apart by 64-bit hashes; a probe carries 30 bits within its bucket, which
only widens the candidates; a window is judged by 63 bits within its bucket.

Texts that occur more than once are repeated as a whole: one row of each stands for them,
the others do not move. Answers go back packed by the bucket of their texts.
Nulls, empty texts and texts of fewer than 35 words lose nothing. A null doc_id is carried
along. Repeated rows are copies of each other. Empty tables give no rows; extra columns
are ignored.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.chars import ByteWords, byte_groups, mix
from tidemark.llm.common import small, small_batches, table
from tidemark.llm.packed import REPLY, Answers, beside, bucket_of, by_bucket, column, cut, n_buckets, repeated, replies, runs, whole

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WINDOW = 35
ANCHOR = (WINDOW + 1) // 2
GROUP = 1 << 20  # bytes of text handled at a time
_BASE = 0x100000001B3
PACKED = "bucket int, owners binary, others binary, counts binary, hashes binary, places binary, local boolean"
_PACKED = pa.schema(
    [("bucket", pa.int32())] + [(n, pa.binary()) for n in ("owners", "others", "counts", "hashes", "places")] + [("local", pa.bool_())]
)


def rolling(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of the `width` words from each place on, by doubling; the end is padded."""
    out, done, part, size, base = None, 0, h, 1, _BASE
    while True:
        if width & size:  # append the `size` words that start after those done
            piece = np.append(part[done:], np.zeros(min(done, len(h)), np.uint64))[: len(h)]
            out = piece if out is None else out * np.uint64(base) + piece
            done += size
        if done == width:
            return mix(out)
        part = part * np.uint64(base) + np.append(part[size:], np.zeros(min(size, len(h)), np.uint64))[: len(h)]
        size, base = 2 * size, base * base & 0xFFFFFFFFFFFFFFFF


def _starts(counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place in all words, place in the text) of each run of `width` words, of texts long enough for a window."""
    n = np.where(counts >= WINDOW, counts - width + 1, 0)
    text = np.repeat(np.arange(len(counts)), n)
    own = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    return text, (np.cumsum(counts) - counts)[text] + own, own


def _emit(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=_PACKED)


def _probes(buckets: int):  # noqa: ANN202 - a function over batches
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """k1, k2, text -> packed probes, the lowest bit set where a reference block starts,
        the next where the block is known to be met again; and anchors found in the group."""
        for batch in batches:
            k1, k2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for row, texts in byte_groups(batch.column(2).to_pylist(), GROUP):
                words = ByteWords(texts)
                text, at, own = _starts(words.counts, ANCHOR)
                if not len(text):
                    continue
                h = rolling(words.hash, ANCHOR)[at]
                block = own % ANCHOR == 0
                order = np.argsort(h, kind="stable")
                first = np.flatnonzero(np.concatenate([[True], h[order][1:] != h[order][:-1]]))
                group = np.empty(len(h), np.int64)
                group[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(h))))
                met = (np.bincount(group) > 1) & (np.bincount(group, weights=block) > 0)
                anchor = met[group]
                # Anchors of the group are known here; one entry tells the rest of the table.
                told = np.zeros(len(h), dtype=bool)
                told[order[first]] = True
                out = []
                entry = (h & np.uint64(0x3FFFFFFF)).astype(np.uint32) << np.uint32(2)
                entry |= block.astype(np.uint32) | (anchor.astype(np.uint32) << np.uint32(1))
                entry[anchor] |= np.uint32(1)
                keep = np.flatnonzero(~anchor | told)
                for b, part in cut(bucket_of(h[keep], buckets)):
                    i = keep[part]
                    mine = i[~anchor[i]]
                    owners, counts = runs(text[mine])
                    shared = entry[i[anchor[i]]]
                    out.append({"bucket": b, "owners": k1[row + owners].tobytes(), "others": k2[row + owners].tobytes(), "counts": counts.tobytes(),
                                "hashes": entry[mine].tobytes(), "places": shared.tobytes(), "local": False})
                mine = np.flatnonzero(anchor)
                k = row + text[mine]
                told = replies(k1[k], k2[k], _code(h[mine], buckets), buckets)
                out += [{"bucket": r["bucket"], "owners": r["owners"], "others": r["others"], "counts": r["counts"], "hashes": r["answers"], "local": True}
                        for r in told.to_pylist()]
                for a in range(0, len(out), 500):
                    yield _emit(out[a : a + 500])

    return run


def _code(h: np.ndarray, buckets: int) -> np.ndarray:
    """What names an anchor in answers: its bucket and its 30 bits."""
    return (bucket_of(h, buckets).astype(np.uint64) << np.uint64(30)) | (h & np.uint64(0x3FFFFFFF))


def _anchors(buckets: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Packed probes of a bucket -> packed answers: blocks that are met at another place."""
        rows = whole(batches)
        if rows is None:
            return
        local = rows.filter(rows.column("local"))
        for b in local.select(["bucket", "owners", "others", "counts", "hashes"]).to_batches():
            yield pa.RecordBatch.from_arrays(b.columns, names=["bucket", "owners", "others", "counts", "answers"])
        rows = rows.filter(pc.invert(rows.column("local")))
        if not rows.num_rows:
            return
        bucket, counts = np.uint64(rows.column("bucket")[0].as_py()), column(rows, "counts", np.int32)
        o1, o2 = (np.repeat(column(rows, n, np.int64), counts) for n in ("owners", "others"))
        own, shared = column(rows, "hashes", np.uint32), column(rows, "places", np.uint32)
        entry = np.concatenate([own, shared])
        order = np.argsort(entry >> np.uint32(2), kind="stable")
        value = entry[order]
        first = np.flatnonzero(np.concatenate([[True], (value[1:] >> np.uint32(2)) != (value[:-1] >> np.uint32(2))]))
        size = np.diff(np.append(first, len(value)))
        either = np.bitwise_or.reduceat(value, first)
        met = ((size > 1) | (either & np.uint32(2) > 0)) & (either & np.uint32(1) > 0)
        hit = order[np.repeat(met, size)]
        hit = np.sort(hit[hit < len(own)])
        code = (bucket << np.uint64(30)) | (own[hit] >> np.uint32(2)).astype(np.uint64)
        yield replies(o1[hit], o2[hit], code, buckets)

    return run


STATE = "doc_id bigint, k1 bigint, k2 bigint, n_words bigint, state int, copies bigint, kept_sha256 string, text string, starts binary"


def _extend(buckets: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts with the anchors found in them -> the windows that may repeat, as bits.

        state 0: nothing repeats; 1: a copy, all of it goes; 2: to be judged by windows.
        """
        anchors = Answers(np.uint64)
        for batch in batches:
            part = anchors.take(batch).select(["doc_id", "k1", "k2", "text", "copies"])
            k1, k2, copies = (part.column(i).to_numpy() for i in (1, 2, 4))
            raw = part.column(3).to_pylist()
            for row, texts in byte_groups(raw, GROUP):
                words = ByteWords(texts)
                _, at, _ = _starts(words.counts, ANCHOR)
                code = np.zeros(len(words.hash), np.uint64)
                code[at] = _code(rolling(words.hash, ANCHOR)[at], buckets) if len(at) else 0
                base = np.cumsum(words.counts) - words.counts
                n, state, sha, starts = [], [], [], []
                for i, data in enumerate(texts):
                    k, size = row + i, int(words.counts[i])
                    n.append(size)
                    bits = None
                    if copies[k] > 1 and size >= WINDOW:
                        state.append(1)
                        bits = np.ones(size - WINDOW + 1, dtype=bool)  # this row speaks for all copies
                    elif size >= WINDOW and len(told := anchors.of(int(k1[k]), int(k2[k]))):
                        hit = np.isin(code[base[i] : base[i] + size - ANCHOR + 1], told)
                        # A window may repeat if one of its rolling blocks is an anchor.
                        total = np.concatenate([[0], np.cumsum(hit)])
                        bits = (total[WINDOW - ANCHOR + 1 :] - total[: size - WINDOW + 1]) > 0
                        bits = bits if bits.any() else None
                        state.append(2 if bits is not None else 0)
                    else:
                        state.append(0)
                    sha.append(hashlib.sha256(b" ".join(data.split()) if state[-1] == 0 else b"").hexdigest())
                    starts.append(None if bits is None else np.packbits(bits).tobytes())
                own = part.slice(row, len(texts))
                yield pa.RecordBatch.from_arrays(
                    [own.column(0), own.column(1), own.column(2), pa.array(n, pa.int64()), pa.array(state, pa.int32()), own.column(4), pa.array(sha),
                     pa.array([t if b is not None else None for t, b in zip(raw[row : row + len(texts)], starts, strict=True)], pa.string()),
                     pa.array(starts, pa.binary())],
                    names=["doc_id", "k1", "k2", "n_words", "state", "copies", "kept_sha256", "text", "starts"],
                )

    return run


def _bits(raw: list[bytes], counts: np.ndarray) -> np.ndarray:
    """Which words of all texts start a window that may repeat."""
    out = np.zeros(int(counts.sum()), dtype=bool)
    at = 0
    for x, n in zip(raw, counts, strict=True):
        size = int(n) - WINDOW + 1
        out[at : at + size] = np.unpackbits(np.frombuffer(x, np.uint8), count=size)
        at += int(n)
    return out


def _windows(buckets: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """k1, k2, text, starts, copies -> packed windows; the lowest bit set where known to repeat."""
        for batch in batches:
            k1, k2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            starts, copies = batch.column(3).to_pylist(), batch.column(4).to_numpy()
            for row, texts in byte_groups(batch.column(2).to_pylist(), GROUP):
                words = ByteWords(texts)
                at = np.flatnonzero(_bits(starts[row : row + len(texts)], words.counts))
                text = np.repeat(np.arange(len(texts)), words.counts)[at]
                place = (at - (np.cumsum(words.counts) - words.counts)[text]).astype(np.uint32)
                h = rolling(words.hash, WINDOW)[at]
                entry = (h & ~np.uint64(1)) | (copies[row + text] > 1).astype(np.uint64)
                out = []
                for b, i in cut(bucket_of(h, buckets)):
                    owners, counts = runs(text[i])
                    out.append({"bucket": b, "owners": k1[row + owners].tobytes(), "others": k2[row + owners].tobytes(),
                                "counts": counts.tobytes(), "hashes": entry[i].tobytes(), "places": place[i].tobytes()})
                for a in range(0, len(out), 200):
                    yield _emit(out[a : a + 200])

    return run


def _judge(buckets: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Packed windows of a bucket -> packed places of windows that start anywhere else too."""
        rows = whole(batches)
        if rows is None:
            return
        counts, h = column(rows, "counts", np.int32), column(rows, "hashes", np.uint64)
        o1, o2 = (np.repeat(column(rows, n, np.int64), counts) for n in ("owners", "others"))
        hit = repeated(h >> np.uint64(1)) | (h & np.uint64(1) > 0)
        yield replies(o1[hit], o2[hit], column(rows, "places", np.uint32)[hit], buckets)

    return run


def _left(words: list[bytes], gone: np.ndarray) -> tuple[int, str]:
    """(words removed, hash of the others)."""
    left = np.flatnonzero(~gone)
    return len(words) - len(left), hashlib.sha256(b" ".join([words[i] for i in left])).hexdigest()


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with the places of their repeated windows -> what is left of each text."""
    places = Answers(np.uint32)
    for batch in batches:
        part = places.take(batch).select(["doc_id", "k1", "k2", "text"])
        out = []
        for k1, k2, text in zip(*(part.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
            words = text.encode("utf-8", "surrogatepass").split()
            edge = np.zeros(len(words) + 1, dtype=np.int64)
            at = np.unique(places.of(k1, k2)).astype(np.int64)
            edge[at] += 1
            np.subtract.at(edge, at + WINDOW, 1)
            out.append((len(words), *_left(words, np.cumsum(edge[:-1]) > 0)))
        yield _result(part.column(0), out)


def _copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Further copies of a text: all of it goes if it is long enough."""
    for batch in batches:
        out = []
        for text in batch.column(1).to_pylist():
            words = text.encode("utf-8", "surrogatepass").split()
            out.append((len(words), *_left(words, np.full(len(words), len(words) >= WINDOW))))
        yield _result(batch.column(0), out)


RESULT = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string"


def _result(ids: pa.Array, rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
    n, removed, sha = zip(*rows, strict=True) if rows else ([], [], [])
    return pa.RecordBatch.from_arrays(
        [ids, pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"]
    )


def remove_repeats(docs: DataFrame) -> DataFrame:
    """The contract of op8: doc_id, n_words, n_removed, kept_sha256."""
    small_batches(docs.sparkSession)
    buckets = n_buckets(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(3), text).alias("k2"), text.alias("text")
    )
    copies = keyed.groupBy(F.col("k1").alias("c1"), F.col("k2").alias("c2")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("lead"))
    copies = small(table(copies.filter("copies > 1"), "copies"))
    known = keyed.join(copies, (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2")), "left")
    first = F.col("c1").isNull() | F.col("lead").eqNullSafe(F.col("doc_id"))
    one = known.filter(first).select("doc_id", "k1", "k2", "text", F.coalesce("copies", F.lit(1)).alias("copies"))
    more = known.filter(~first).select("doc_id", "text").mapInArrow(_copies, RESULT)

    probes = one.select("k1", "k2", "text").mapInArrow(_probes(buckets), PACKED)
    anchors = table(by_bucket(probes, buckets).mapInArrow(_anchors(buckets), REPLY), "anchors")
    state = table(beside(one, anchors, buckets).mapInArrow(_extend(buckets), STATE), "state")
    speak = state.filter(F.col("starts").isNotNull())
    windows = speak.select("k1", "k2", "text", "starts", "copies").mapInArrow(_windows(buckets), PACKED)
    places = by_bucket(windows, buckets).mapInArrow(_judge(buckets), REPLY)
    parts = state.filter("state = 2").select("doc_id", "k1", "k2", "text")
    cut_texts = beside(parts, places, buckets).mapInArrow(_remove, RESULT)
    gone = F.when(F.col("state") == 1, F.col("n_words")).otherwise(F.lit(0)).cast("long")
    rest = state.filter("state < 2").select("doc_id", "n_words", gone.alias("n_removed"), "kept_sha256")
    return rest.unionByName(cut_texts).unionByName(more)
