"""Ranked lexical search with bit-sliced Bloom signatures.

The index is made of blocks of documents of like length. A block is a bit matrix: rows are
the positions of Bloom signatures, columns are documents. A document's signature holds, for
each of its terms, a key for each step of `STEPS` that the term's count reaches. The rows of a
key, taken together by AND, are a bitmap of documents that includes all that reach the step.

A search adds up, step by step, the weights of a query's terms over these bitmaps. Between two
steps a term can bring no more than the score of the largest count in between, so the sums of
the steps, with each document's own length, give an upper bound of its score.

1. In every block, the documents with the largest bounds of each item are found, and the best
   of all blocks are rescored from their texts. Their tenth score is a floor of the result.
2. All documents whose bound reaches the floor are rescored from their texts, and the first
   ten are the result. A document left out has a bound, so a score, under the floor.

Terms are told apart by 64-bit hashes. Items are broadcast in shards of `SHARD_TERMS` terms,
with one pass over the index for each shard. A block holds at most `BLOCK_BITS` bits (or one
document), counts of terms leave a task in chunks and are added up by Spark, and the rows for
rescoring are joined by (doc_id, hash of text): by broadcast if there are few, else shuffled.

Nulls: a null text has no terms and is never found; a null item text has no results; rows
without item_id are skipped; a document without id comes last among equal scores. Repeated
documents are found each; of repeated items with one id the terms are put together. Empty
tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.chars import SLAB, mix
from tidemark.llm.common import small, small_batches, table

cloudpickle.register_pickle_by_value(sys.modules[__name__])

TOP = 10
STEPS = (1, 2, 3, 5, 9, 17)  # counts of a term that a signature tells apart
HASHES = 3
BITS_PER_KEY = 12  # at least; the next power of two is taken for all documents of a block
BLOCK_BITS = 1 << 23
BLOCK_DOCS = 4096
FIRST = 32  # documents of each item that set the floor
HELD_TERMS = 1 << 20  # terms counted in a task before they are sent on
CHUNK = 1 << 15
SHARD_TERMS = 1 << 20
SLACK = 1.0001  # more than what 32-bit floats lose in the sums
# Fixed values of the score: k1 = 0.8 in thousandths per hundredth of length, and its unit.
UNIT, LENGTH_UNIT, SATURATION = 1_000_000_000, 1000, 8

INDEX = (
    "rows int, docs int, ids array<bigint>, marks array<bigint>, sizes array<bigint>, bits binary, "
    "terms array<bigint>, counts array<bigint>"
)
_INDEX = pa.schema([
    ("rows", pa.int32()), ("docs", pa.int32()), ("ids", pa.list_(pa.int64())), ("marks", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())),
    ("bits", pa.binary()), ("terms", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())),
])

_inside = np.zeros(256, dtype=bool)
_inside[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_lower = np.arange(256, dtype=np.uint8)
_lower[0x41:0x5B] += 32
_power = np.zeros(0, dtype=np.uint64)


def _powers(n: int) -> np.ndarray:
    global _power
    if len(_power) < n:
        _power = np.cumprod(np.full(max(n, 256), 0x100000001B3, dtype=np.uint64), dtype=np.uint64)
    return _power


def _slabs(text: bytes) -> Iterator[bytes]:
    """Parts of about SLAB bytes that end between terms."""
    at = 0
    while len(text) - at > SLAB:
        ahead, end = np.frombuffer(text, dtype=np.uint8, offset=at + SLAB), None
        gap = np.flatnonzero(~_inside[ahead[: SLAB]]) if len(ahead) else ahead
        if not len(gap):
            gap = np.flatnonzero(~_inside[ahead])
        if not len(gap):
            break
        end = at + SLAB + int(gap[0])
        yield text[at:end]
        at = end
    yield text[at:]


def term_hashes(data: bytes) -> np.ndarray:
    """A hash of each term, in order."""
    code = np.frombuffer(data, dtype=np.uint8)
    inside = np.zeros(len(code) + 2, dtype=bool)
    inside[1:-1] = _inside[code]
    turn = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = turn[0::2], turn[1::2]
    if not len(start):
        return np.zeros(0, dtype=np.uint64)
    size = end - start
    first = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(first, size)
    letter = mix(_lower[code[inside[1:-1]]].astype(np.uint64) + np.uint64(1))
    total = np.zeros(len(place) + 1, dtype=np.uint64)
    np.cumsum(letter * _powers(int(size.max()))[place], out=total[1:])
    return mix(total[first + size] - total[first] + size.astype(np.uint64))


def term_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct term hashes, how often each stands in the text)."""
    parts = [np.unique(term_hashes(p), return_counts=True) for p in _slabs((text or "").encode("utf-8", "surrogatepass"))]
    return parts[0] if len(parts) == 1 else _added(parts)


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    terms, back = np.unique(np.concatenate([t for t, _ in parts]), return_inverse=True)
    return terms, np.bincount(back, weights=np.concatenate([c for _, c in parts]), minlength=len(terms)).astype(np.int64)


def _places(keys: np.ndarray, rows: int) -> np.ndarray:
    """(HASHES, keys): rows of each key; `rows` is a power of two."""
    low, high = keys & np.uint64(rows - 1), (keys >> np.uint64(32)) | np.uint64(1)
    return ((low + np.arange(HASHES, dtype=np.uint64)[:, None] * high) & np.uint64(rows - 1)).astype(np.int64)


def _key(terms: np.ndarray, step: int) -> np.ndarray:
    return mix(terms + np.uint64(0x9E3779B97F4A7C15 * (step + 1) % (1 << 64)))


class Blocks:
    """Blocks that a task is filling, one for each signature length, and the terms it has counted."""

    def __init__(self) -> None:
        self.open: dict[int, list[tuple[int | None, int, int, np.ndarray]]] = {}
        self.terms: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, doc_id: int | None, mark: int, text: str | None) -> Iterator[dict]:
        terms, counts = term_counts(text)
        if not len(terms):
            return
        keys = np.concatenate([_key(terms[counts >= s], k) for k, s in enumerate(STEPS)])
        rows = 1 << max(8, math.ceil(math.log2(len(keys) * BITS_PER_KEY)))
        places = _places(keys, rows).ravel()
        block = self.open.setdefault(rows, [])
        block.append((doc_id, mark, int(counts.sum()), places.astype(np.int32)))
        if len(block) >= min(BLOCK_DOCS, max(1, BLOCK_BITS // rows)):
            yield self._block(rows, self.open.pop(rows))
        self.terms.append((terms, np.ones(len(terms), dtype=np.int64)))
        self.held += len(terms)
        if self.held > 4 * HELD_TERMS:
            yield from self._counted(HELD_TERMS)

    def _block(self, rows: int, docs: list[tuple[int | None, int, int, np.ndarray]]) -> dict:
        width = -(-len(docs) // 8)
        bits = np.zeros(rows * width, dtype=np.uint8)
        for n in range(8):  # one document of each byte at a time, so no place is written twice
            some = docs[n::8]
            if some:
                at = np.concatenate([np.unique(d[3]).astype(np.int64) * width + i for i, d in enumerate(some)])
                bits[at] |= np.uint8(128 >> n)
        ids, marks, sizes, _ = zip(*docs, strict=True)
        return {"rows": rows, "docs": len(docs), "ids": list(ids), "marks": list(marks), "sizes": list(sizes), "bits": bits.tobytes()}

    def _counted(self, keep: int) -> Iterator[dict]:
        """Add the counts up; send them on if they are more than `keep`."""
        terms, counts = _added(self.terms) if self.terms else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        self.terms, self.held = [(terms, counts)], len(terms)
        if len(terms) > keep:
            for at in range(0, len(terms), CHUNK):
                yield {"terms": terms[at : at + CHUNK].view(np.int64), "counts": counts[at : at + CHUNK]}
            self.terms, self.held = [], 0

    def rest(self) -> Iterator[dict]:
        for rows, docs in sorted(self.open.items()):
            yield self._block(rows, docs)
        yield from self._counted(0)


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, mark, text -> blocks, and counts of documents that hold a term."""
    blocks = Blocks()
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for made in blocks.add(*row):
                yield pa.RecordBatch.from_pylist([made], schema=_INDEX)
    for made in blocks.rest():
        yield pa.RecordBatch.from_pylist([made], schema=_INDEX)


def _marked(docs: DataFrame) -> DataFrame:
    """doc_id, text and the hash that tells texts of one id apart."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), "text")


def build(docs: DataFrame) -> DataFrame:
    """The index of `docs`: a written table of blocks, and of term counts by parts."""
    small_batches(docs.sparkSession)
    return table(_marked(docs).filter("text IS NOT NULL").mapInArrow(_index, INDEX), "slices")


@dataclass
class Items:
    """Query items with weighted terms, and the corpus' counts."""

    ids: np.ndarray
    begin: np.ndarray  # terms of item i: begin[i] to begin[i + 1]
    term: np.ndarray
    weight: np.ndarray
    docs: int
    words: int
    floor: np.ndarray | None = None

    def spread(self, size: int) -> int:
        """The length part of the score's divisor."""
        return SATURATION * (100 - 90 + (90 * size * self.docs) // self.words)


def _bounds(items: Items, block: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """(item, upper bounds of all documents of the block) of items with a term there."""
    rows, n = block["rows"], block["docs"]
    bits = np.frombuffer(block["bits"], dtype=np.uint8).reshape(rows, -1)
    spread = np.array([items.spread(s) for s in block["sizes"]], dtype=np.float64)
    most = [UNIT * s / (LENGTH_UNIT * s + spread) for s in (*(s - 1 for s in STEPS[1:]), np.inf) if np.isfinite(s)]
    gain = np.diff([np.zeros(n), *most, np.full(n, UNIT / LENGTH_UNIT)], axis=0) * SLACK
    for i in range(len(items.ids)):
        own = slice(items.begin[i], items.begin[i + 1])
        term, weight = items.term[own], items.weight[own].astype(np.float32)
        seen, total = None, np.zeros(n)
        for k in range(len(STEPS)):
            at = _places(_key(term, k), rows)
            now = bits[at[0]]
            for a in at[1:]:
                now = now & bits[a]
            if seen is not None:
                now = now & seen
            some = now.any(1)
            term, weight, seen = term[some], weight[some], now[some]
            if not len(term):
                break
            total += gain[k] * (weight @ np.unpackbits(seen, axis=1, count=n).astype(np.float32))
        if total.any():
            yield i, total


FOUND = "item bigint, doc_id bigint, mark bigint, bound double"
_FOUND = pa.schema([("item", pa.int64()), ("doc_id", pa.int64()), ("mark", pa.int64()), ("bound", pa.float64())])


def _found(item: int, block: dict, at: np.ndarray, bound: np.ndarray) -> pa.RecordBatch:
    ids, marks = ([block[c][j] for j in at] for c in ("ids", "marks"))
    return pa.RecordBatch.from_arrays([pa.array([item] * len(at), pa.int64()), pa.array(ids, pa.int64()), pa.array(marks, pa.int64()), pa.array(bound[at])], schema=_FOUND)


def _search(items: Items, blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Without floors: the documents of each block with the largest bounds; with floors: all that reach them."""
    for batch in blocks:
        for block in batch.to_pylist():
            out = []
            for i, bound in _bounds(items, block):
                if items.floor is None:
                    at = np.argpartition(-bound, FIRST)[:FIRST] if len(bound) > FIRST else np.arange(len(bound))
                    at = at[bound[at] > 0]
                else:
                    at = np.flatnonzero(bound >= items.floor[i])
                if len(at):
                    out.append(_found(i, block, at, bound))
            if out:
                yield pa.Table.from_batches(out).combine_chunks().to_batches()[0]


SCORED = "item bigint, doc_id bigint, score bigint"


def _rescore(items: Items, rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, text, wanted (item numbers) -> exact scores above 0."""
    for batch in rows:
        out: list[tuple[int, int | None, int]] = []
        for doc_id, text, wanted in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            terms, counts = term_counts(text)
            spread = items.spread(int(counts.sum()))
            for i in wanted:
                own = slice(items.begin[i], items.begin[i + 1])
                at = np.minimum(np.searchsorted(terms, items.term[own]), len(terms) - 1)
                tf = np.where(terms[at] == items.term[own], counts[at], 0)
                score = int((items.weight[own] * ((UNIT * tf) // (LENGTH_UNIT * tf + spread))).sum())
                if score > 0:
                    out.append((i, doc_id, score))
        item, ids, score = zip(*out, strict=True) if out else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (item, ids, score)], names=["item", "doc_id", "score"])


def _run(df: DataFrame, step, items: Items, schema: str) -> DataFrame:  # noqa: ANN001 - _search or _rescore
    shared = df.sparkSession.sparkContext.broadcast(vars(items))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return step(Items(**shared.value), batches)

    return df.mapInArrow(run, schema)


def _scores(docs: DataFrame, items: Items, found: DataFrame) -> DataFrame:
    """Exact scores of the found documents."""
    wanted = found.groupBy(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark")).agg(F.collect_set("item").alias("wanted"))
    wanted = small(table(wanted, "wanted"))
    both = _marked(docs).join(wanted, F.col("mark").eqNullSafe(F.col("_mark")) & F.col("doc_id").eqNullSafe(F.col("_id")))
    return _run(both.select("doc_id", "text", "wanted"), _rescore, items, SCORED)


def _ranked(scores: DataFrame) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= TOP)


def search(docs: DataFrame, items: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """The contract of op12: item_id, rank, doc_id, score.

    docs: doc_id, text; items: item_id, text; index: of `docs`, made here if not given.
    """
    spark = docs.sparkSession
    small_batches(spark)
    index = build(docs) if index is None else index
    blocks = index.filter("rows IS NOT NULL").drop("terms", "counts")
    n, words = index.agg(F.sum("docs"), F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).first()
    named = items.filter("item_id IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text")
    terms = table(named.mapInArrow(_item_terms, "item_id bigint, term bigint").distinct(), "items")
    pairs = index.filter("terms IS NOT NULL").select(F.explode(F.arrays_zip("terms", "counts")).alias("t")).select(F.col("t.terms").alias("term"), F.col("t.counts").alias("n"))
    df = pairs.join(small(table(terms.select("term").distinct(), "asked")), "term").groupBy("term").agg(F.sum("n").alias("df"))
    weighed = table(terms.join(df, "term"), "weighed")
    shards = max(1, -(-weighed.count() // SHARD_TERMS))
    out = None
    for k in range(shards):
        some = _items(weighed.filter(F.pmod(F.xxhash64("item_id"), F.lit(shards)) == k), n or 0, words or 0)
        first = _run(blocks, _search, some, FOUND)
        best = Window.partitionBy("item").orderBy(F.desc("bound"), "doc_id", "mark")
        first = first.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= FIRST).select("item", "doc_id", "mark")
        tenth = _ranked(_scores(docs, some, first)).groupBy("item").agg(F.count("*").alias("n"), F.min("score").alias("floor"))
        floor = np.ones(len(some.ids))
        for r in tenth.filter(F.col("n") == TOP).collect():  # one row for each item of the shard
            floor[r["item"]] = r["floor"]
        some.floor = floor
        scored = _ranked(_scores(docs, some, _run(blocks, _search, some, FOUND)))
        names = F.broadcast(spark.createDataFrame(list(enumerate(some.ids.tolist())), "item bigint, item_id bigint"))
        part = scored.join(names, "item").select("item_id", "rank", "doc_id", "score")
        out = part if out is None else out.unionByName(table(part, "ranked"))
    return out


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            terms = term_counts(text)[0].view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(terms), item, dtype=np.int64)), pa.array(terms)], names=["item_id", "term"])


def _items(weighed: DataFrame, docs: int, words: int) -> Items:
    """The items of a shard: item_id, term, df."""
    rows = weighed.toArrow().sort_by([("item_id", "ascending"), ("term", "ascending")])
    ids, counts = np.unique(rows.column("item_id").to_numpy(), return_counts=True)
    # math.log, not numpy's, so that the floor is that of doubles elsewhere
    weight = [math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1))) for df in rows.column("df").to_pylist()]
    term = rows.column("term").to_numpy().view(np.uint64)
    return Items(ids, np.concatenate([[0], np.cumsum(counts)]), term, np.array(weight, dtype=np.int64), docs, words)
