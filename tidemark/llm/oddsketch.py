"""Near-duplicate documents by MinHash bands, odd sketches and exact confirmation.

A document's set holds the hashes of its distinct shingles, of four words unless another
width is given. Equal sets form a class, so copies are compared once. Classes are banded by MinHash (32 bands of 4 values: a
pair at the threshold shares no band in about one case of 20 million). The 128 MinHash
values are also folded into an odd sketch, a bitmap in which each (place, value) flips one
bit; the bits in which two sketches differ estimate the similarity closely when it is
high. Pairs within a band whose sketches or set sizes rule the threshold out, with a wide
margin, are left out; the rest is confirmed on the full sets.

No pairs are emitted. The members of a bucket meet in cells: a bucket of more than
`BLOCK` members is split into blocks, and each cell holds two blocks. A cell works through
its candidate pairs from the most similar on and skips pairs that confirmed links connect
already; it gives a spanning forest of links, so each component comes out whole. Two bands
go first; the other bands only see members that those have not yet connected. Buckets of
equal members are kept once.

Nulls, empty texts and texts without words have no set and link with nothing. A null
doc_id counts only if it shares its set with another id. Repeated rows fall in one class.
Empty tables give no rows, extra columns are ignored.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.chars import ByteWords, byte_groups, mix
from tidemark.llm.common import small, small_batches, table
from tidemark.llm.components import components

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SHINGLE = 4
PERCENT = 80
BANDS, ROWS = 32, 4
FIRST_BANDS = 2
SKETCH_BITS = 1024
# Similarity under which a sketch rules a pair out: over five standard errors under 0.8.
SKETCH_FLOOR = 0.6
BLOCK = 2048


def _perms() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    n = BANDS * ROWS
    return rng.integers(0, 1 << 32, n, dtype=np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, n, dtype=np.uint32)


def shingle_sets(texts: list[bytes], width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of all texts one after the other, set sizes)."""
    words = ByteWords([t.lower() for t in texts])  # bytes.lower() is A-Z only
    n = words.counts
    made = np.where(n >= width, n - width + 1, (n > 0).astype(np.int64))
    text = np.repeat(np.arange(len(texts)), made)
    base = np.cumsum(n) - n
    at = base[text] + np.arange(len(text)) - np.repeat(np.cumsum(made) - made, made)
    h = np.zeros(len(text), dtype=np.uint64)
    padded = np.append(words.hash, np.zeros(width, dtype=np.uint64))
    for j in range(width):  # a shorter text is one shingle of all its words
        real = j < np.minimum(n[text], width)
        h = mix(h * np.uint64(0x100000001B3) + np.where(real, padded[at + j], np.uint64(j + 1)))
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    return h[new], np.bincount(text[new], minlength=len(texts))


def signatures(h: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(two set hashes, band hashes, odd sketch) of each set, for sets that are not empty."""
    first = np.cumsum(sizes) - sizes
    keys = np.stack([np.add.reduceat(mix(h + np.uint64(s)), first) for s in (1, 2)], 1)
    a, b = _perms()
    low = (h & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    values = np.stack([np.minimum.reduceat(low * x + y, first) for x, y in zip(a, b, strict=True)], 1)
    n = len(sizes)
    band = np.zeros((n, BANDS), dtype=np.uint64)
    for r in range(ROWS):
        band = mix(band * np.uint64(31) + values[:, r::ROWS][:, :BANDS].astype(np.uint64) + np.uint64(r + 1))
    place = np.arange(BANDS * ROWS, dtype=np.uint64)[None]
    bit = (mix(values.astype(np.uint64) + (place << np.uint64(32))) % np.uint64(SKETCH_BITS)).astype(np.int64)
    flips = np.bincount((np.arange(n)[:, None] * SKETCH_BITS + bit).ravel(), minlength=n * SKETCH_BITS) & 1
    return keys, band, np.packbits(flips.reshape(n, SKETCH_BITS).astype(np.uint8), axis=1)


def _sign(width: int):  # noqa: ANN202 - a function over batches
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """doc_id, text -> doc_id, n_shingles, k1, k2, bands, sketch."""
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for row, group in byte_groups(texts):
                h, sizes = shingle_sets(group, width)
                full = np.flatnonzero(sizes)
                keys, bands, sketch = np.zeros((len(group), 2), np.uint64), np.zeros((len(group), BANDS), np.uint64), [None] * len(group)
                if len(full):
                    keys[full], bands[full], odd = signatures(h, sizes[full])
                    for i, x in zip(full, odd, strict=True):
                        sketch[i] = x.tobytes()
                flat = pa.array(bands.view(np.int64).ravel())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, len(group)), pa.array(sizes, pa.int64()), pa.array(keys[:, 0].view(np.int64)),
                     pa.array(keys[:, 1].view(np.int64)), pa.ListArray.from_arrays(pa.array(np.arange(len(group) + 1) * BANDS, pa.int32()), flat),
                     pa.array(sketch, pa.binary())],
                    names=["doc_id", "n_shingles", "k1", "k2", "bands", "sketch"],
                )

    return run


def _sets(width: int):  # noqa: ANN202 - a function over batches
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """class, k1, k2, text -> class, shingles, for texts that have the class's set."""
        for batch in batches:
            k1, k2 = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for row, group in byte_groups(batch.column(3).to_pylist()):
                h, sizes = shingle_sets(group, width)
                ids, sets = [], []
                for i, x in enumerate(np.split(h, np.cumsum(sizes)[:-1])):
                    one, two = (mix(x + np.uint64(s)).sum(dtype=np.uint64).astype(np.int64) for s in (1, 2))
                    if len(x) and one == k1[row + i] and two == k2[row + i]:
                        ids.append(batch.column(0)[row + i].as_py())
                        sets.append(x.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.binary())], names=["class", "shingles"])

    return run


def _most_bits() -> int:
    """Differing sketch bits that a pair at the sketch floor is expected to have."""
    return math.ceil(SKETCH_BITS / 2 * (1 - math.exp(-4 * BANDS * ROWS * (1 - SKETCH_FLOOR) / SKETCH_BITS)))


def candidates(sketch: np.ndarray, n: np.ndarray, comp: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, ...]:
    """(i, j, differing bits) of the pairs of left and right that may be linked and are not yet."""
    limit, found = _most_bits(), []
    for at in range(0, len(left), 256):
        i = left[at : at + 256]
        bits = np.zeros((len(i), len(right)), dtype=np.uint16)
        for w in range(sketch.shape[1]):
            bits += np.bitwise_count(sketch[i, w][:, None] ^ sketch[right, w][None]).astype(np.uint16)
        low, high = np.minimum(n[i][:, None], n[right][None]), np.maximum(n[i][:, None], n[right][None])
        ok = (bits <= limit) & (100 * low >= PERCENT * high) & (comp[i][:, None] != comp[right][None])
        x, y = np.nonzero(ok)
        found.append((i[x], right[y], bits[x, y]))
    if not found:
        return (np.zeros(0, np.int64),) * 3
    i, j, bits = (np.concatenate(x) for x in zip(*found, strict=True))
    keep = i < j if left is right else np.ones(len(i), bool)
    return i[keep], j[keep], bits[keep]


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
    """Rows of one cell at a time, from batches sorted by cell."""
    held: dict[str, list] = {}
    for batch in batches:
        names = batch.schema.names
        keys = np.stack([batch.column(names.index(k)).to_numpy() for k in ("bucket", "i", "j")], 1)
        cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
        bounds = [0, *cuts.tolist(), len(keys)]
        for a, b in zip(bounds, bounds[1:], strict=False):
            if a == b:
                continue
            if held and held["key"] != tuple(keys[a]):
                yield held
                held = {}
            if not held:
                held = {"key": tuple(keys[a]), "rows": []}
            held["rows"].append(batch.slice(a, b - a))
    if held:
        yield held


def _arrays(cell: dict[str, list]) -> tuple[np.ndarray, ...]:
    rows = pa.Table.from_batches(cell["rows"]).combine_chunks()
    sketch = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), dtype=np.uint64).reshape(-1, SKETCH_BITS // 64)
    block = rows.column("block").to_numpy()
    _, i, j = cell["key"]
    left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
    pairs = candidates(sketch, rows.column("n").to_numpy(), rows.column("comp").to_numpy(), left, left if i == j else right)
    return rows, *pairs


def _involved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of cells that are in a candidate pair."""
    for cell in _cells(batches):
        rows, i, j, _ = _arrays(cell)
        if len(i):
            yield from rows.take(pa.array(np.unique(np.concatenate([i, j])))).to_batches()


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spanning forest of the confirmed links of each cell."""
    for cell in _cells(batches):
        rows, i, j, bits = _arrays(cell)
        order = np.argsort(bits, kind="stable")
        i, j = i[order], j[order]
        ids, label = rows.column("class").to_numpy(), rows.column("comp").to_numpy().copy()
        sets = [None] * len(ids)
        raw = rows.column("shingles")
        links = []
        while len(i):
            now, i, j = (i[:512], j[:512]), i[512:], j[512:]
            for a, b in zip(*now, strict=True):
                if label[a] == label[b]:
                    continue
                for k in (a, b):
                    if sets[k] is None:
                        sets[k] = np.frombuffer(raw[int(k)].as_py(), dtype=np.uint64)
                both = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
                if 100 * both >= PERCENT * (len(sets[a]) + len(sets[b]) - both):
                    links.append((int(ids[a]), int(ids[b])))
                    label[label == label[b]] = label[a]
            alive = label[i] != label[j]
            i, j = i[alive], j[alive]
        if links:
            a, b = zip(*links, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _deal(members: DataFrame, buckets: DataFrame, comp: DataFrame | None) -> DataFrame:
    """Members of the buckets in cells (bucket, i, j) of two blocks, sorted by cell."""
    rows = members.join(buckets, "bucket")
    if comp is not None:
        rows = rows.join(comp.withColumnRenamed("node", "class"), "class", "left")
        rows = rows.withColumn("comp", F.coalesce("component", "class")).drop("component")
        mixed = rows.groupBy("bucket").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x <> y")
        rows = rows.join(mixed.select("bucket"), "bucket", "left_semi")
    else:
        rows = rows.withColumn("comp", F.col("class"))
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    rows = rows.withColumn("block", F.pmod(F.xxhash64(F.lit(5), "class"), blocks).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return rows.select(
        "bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "class", "comp", "n", "sketch"
    )


CELL = "bucket bigint, i int, j int, block int, class bigint, comp bigint, n bigint, sketch binary"


def _together(rows: DataFrame) -> DataFrame:
    return rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")


def near_duplicates(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """The contract of op7: doc_id, n_shingles, component_id, kept, on shingles of `width` words."""
    small_batches(docs.sparkSession)
    signed = table(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
            _sign(width), "doc_id bigint, n_shingles bigint, k1 bigint, k2 bigint, bands array<bigint>, sketch binary"
        ),
        "signed",
    )
    full = signed.filter("n_shingles > 0")
    classes = table(full.groupBy("k1", "k2").agg(F.min("doc_id").alias("class")), "classes")
    one = (
        full.join(classes.withColumnRenamed("class", "doc_id"), ["k1", "k2", "doc_id"])
        .dropDuplicates(["doc_id", "k1", "k2"])
        .withColumnRenamed("doc_id", "class")
    )
    banded = one.select("class", F.posexplode("bands").alias("band", "h"))
    banded = banded.select("class", "band", F.xxhash64("band", "h").alias("bucket"))
    buckets = (
        banded.groupBy("bucket")
        .agg(
            F.min("band").alias("band"), F.count("*").alias("members"), F.min("class").alias("low"), F.max("class").alias("high"),
            F.bit_xor(F.xxhash64("class")).alias("same"), F.sum(F.pmod(F.xxhash64(F.lit(9), "class"), F.lit(1 << 31))).alias("sum"),
        )
        .filter("members > 1")
        # Buckets of equal members are kept once.
        .groupBy("members", "low", "high", "same", "sum")
        .agg(F.min(F.struct("band", "bucket")).alias("b"))
        .select("b.bucket", "b.band", "members")
    )
    buckets = table(buckets, "buckets")
    where = banded.drop("band").join(buckets.select("bucket"), "bucket")
    slim = one.select("class", "k1", "k2", F.col("n_shingles").alias("n"), "sketch")
    members = table(where.join(slim, "class").select("bucket", "class", "n", "sketch", "k1", "k2"), "members")
    wanted = small(table(members.select("class", "k1", "k2").distinct(), "wanted"))
    texts = docs.select(F.col("doc_id").cast("long").alias("class"), "text").join(wanted, "class")
    sets = texts.select("class", "k1", "k2", "text").mapInArrow(_sets(width), "class bigint, shingles binary").dropDuplicates(["class"])
    sets = table(sets, "sets")
    members = members.drop("k1", "k2")

    links, comp = None, None
    for bands in (F.col("band") < FIRST_BANDS, F.col("band") >= FIRST_BANDS):
        cells = _together(_deal(members, buckets.filter(bands), comp))
        involved = table(cells.mapInArrow(_involved, CELL), "involved")
        found = table(
            _together(involved.join(sets, "class").select(*cells.columns, "shingles")).mapInArrow(_confirm, "a bigint, b bigint"), "links"
        )
        links = found if links is None else links.unionByName(found)
        comp = components(links)
    group = classes.join(comp.withColumnRenamed("node", "class"), "class", "left").select(
        "k1", "k2", F.coalesce("component", "class").alias("component")
    )
    key = F.when(F.col("n_shingles") > 0, F.col("k1"))
    out = signed.select("doc_id", "n_shingles", key.alias("k1"), "k2").join(group, ["k1", "k2"], "left")
    component = F.coalesce("component", "doc_id")
    return out.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept")
    )
