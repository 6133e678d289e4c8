"""Near-duplicate vectors by a robust-pruned flat graph over overlapping cluster shards.

Vectors that are equal up to a factor form a class and are handled once. Classes are split into
shards of bounded size by k-means on a bounded sample; each goes to its two nearest clusters, so
shards overlap; a shard that is still too large is split again. In each shard every vector gets
neighbours by robust pruning: from its nearest and some random members those are kept that
no kept one is much closer to. Reverse edges are added, and what the shard's medoid can't
reach is tied to it. The lists of a vector's shards are united, as far as neighbours from another
shard's list are close enough to be linked with the same vector as it.

Then every vector is a query in each of its shards: a greedy beam search from the medoid
finds its surroundings, and the range is expanded from all members found within the
threshold less `SLACK`, over the united lists, until nothing new is near. A pair in two
shards counts in the smaller one. A vector's home is the smallest of its shards. Where close
neighbours of a find are at home in a shard the query is not in, the query visits that shard and is
searched there in the same way; its new finds lead to more visits until there is none. Of two
vectors without a common shard the smaller id's visit counts for both, so their links and the
component agree. Neither pairs nor their vectors are written: a row is a vector in a shard. Every link
is verified by the cosine in double precision, so none is below the
threshold; the search may miss links, and `audit` measures the share it finds.

Nulls, zero vectors and vectors with null or non-finite components link with nothing, nor
do vectors of different lengths. Repeated vectors link with each other. A null vec_id
keeps its row. Empty tables give no rows; extra columns, the label too, are ignored.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from tidemark.llm.common import small, small_batches, table
from tidemark.llm.components import components

cloudpickle.register_pickle_by_value(sys.modules[__name__])

THRESHOLD = 0.95
SLACK = 0.15
SHARD, MOST = 1000, 4000  # vectors a shard aims at, and may have
CLUSTERS, PER_CLUSTER = 256, 40  # clusters of one split at most; sampled vectors for each
SPLITS_AT_ONCE = 64  # shards split in one pass, so that their centroids stay small
DEPTH = 5
DEGREE, NEAREST, RANDOM, ALPHA = 24, 48, 16, 1.2
BEAM = 16
BLOCK = 128  # queries searched at a time
GUESTS = MOST  # guests that one task serves
MEMBER, LISTS, GUEST = range(3)  # kinds of rows that a search gets


def _unit(rows: pa.Array | pa.ChunkedArray | list[list[float]], size: int | None = None) -> np.ndarray:
    """Rows as unit vectors, filled with zeros to one length."""
    if isinstance(rows, list):
        rows = pa.array(rows, pa.list_(pa.float64()))
    if isinstance(rows, pa.ChunkedArray):
        rows = rows.combine_chunks()
    length = rows.value_lengths().to_numpy(zero_copy_only=False)
    width = size or int(length.max(initial=0))
    out = np.zeros((len(rows), width))
    out[np.arange(width) < length[:, None]] = rows.flatten().to_numpy(zero_copy_only=False)
    # Scaled first, so that squares neither overflow nor vanish.
    out /= np.abs(out).max(1, keepdims=True)
    return out / np.sqrt((out * out).sum(1, keepdims=True))


def _kmeans(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    rng = np.random.default_rng(k)
    centre = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = (x @ centre.T).argmax(1)
        total = np.zeros_like(centre)
        np.add.at(total, near, x)
        norm = np.sqrt((total * total).sum(1))
        centre = np.where(norm[:, None] > 0, total / np.maximum(norm, 1e-300)[:, None], centre)
    return centre


def shards(vectors: DataFrame, width: int) -> DataFrame:
    """(shard, id, mult, vector) with up to two shards of each split per vector."""
    names = ["shard", "id", "mult", "vector"]
    known = vectors.select(F.lit(0).cast("long").alias("shard"), "id", "mult", "vector")
    # A shard's number tells those it was split from, so a vector reaches it by one way only.
    settled, depth = None, 0
    while depth < DEPTH:
        sizes = table(known.groupBy("shard").agg(F.count("*").alias("members")), "sizes").filter(F.col("members") > MOST)
        if sizes.isEmpty():
            break
        key = sizes.select("shard")
        stay = known.join(small(key), "shard", "left_anti").select(names)
        settled = stay if settled is None else settled.unionByName(stay)
        depth, parts = depth + 1, []
        # Dealt into groups that have as many centroids together as SPLITS_AT_ONCE full splits.
        centroids = sizes.agg(F.sum(F.least(F.lit(CLUSTERS), F.ceil(F.col("members") / SHARD)))).first()[0]
        groups = -(-centroids // (SPLITS_AT_ONCE * CLUSTERS))
        for g in range(groups):
            parts.append(table(_split(known, sizes.filter(F.pmod(F.xxhash64("shard"), F.lit(groups)) == g), width), "shards"))
        known = parts[0]
        for more in parts[1:]:
            known = known.unionByName(more)
    out = known.select(names)
    return out if settled is None else settled.unionByName(out)


def _split(members: DataFrame, now: DataFrame, width: int) -> DataFrame:
    """The members of the shards in `now` (shard, members), each in its two nearest clusters of its shard."""

    def centres(rows: pa.Table) -> pa.Table:
        k = min(CLUSTERS, -(-rows.column("members")[0].as_py() // SHARD))
        c = _kmeans(_unit(rows.sort_by("id").column("vector"), width), k)
        return pa.table({"shard": rows.column("shard").slice(0, 1), "centres": pa.array([c.ravel()], pa.list_(pa.float64()))})

    draw = F.pmod(F.xxhash64(F.lit(21), "id", "shard"), F.lit(1 << 30)) / float(1 << 30)
    share = F.lit(float(CLUSTERS * PER_CLUSTER)) / F.col("members")
    mine = members.join(F.broadcast(now), "shard")
    found = mine.filter(draw < share).groupBy("shard").applyInArrow(centres, "shard long, centres array<double>").collect()
    known = members.sparkSession.sparkContext.broadcast({r["shard"]: np.array(r["centres"]).reshape(-1, width) for r in found})

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard, take, to = batch.column(0).to_numpy(), [], []
            for s in np.unique(shard):
                c, at = known.value[int(s)], np.flatnonzero(shard == s)
                x = _unit(batch.column(3).take(pa.array(at)), width)
                near = np.argsort(-(x @ c.T), axis=1, kind="stable")[:, :2]
                for j in range(near.shape[1]):
                    take.append(at)
                    to.append(s * (CLUSTERS + 1) + near[:, j] + 1)
            if take:
                rows = batch.take(pa.array(np.concatenate(take)))
                columns = [pa.array(np.concatenate(to).astype(np.int64)), *rows.columns[1:]]
                yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    mine = mine.select(members.columns)
    return mine.mapInArrow(assign, mine.schema)


def robust_prune(x: np.ndarray, node: np.ndarray, near: np.ndarray) -> np.ndarray:
    """(nodes, DEGREE) neighbours kept of candidates sorted by closeness, -1 where fewer."""
    c = x[near]
    own = 1 - np.einsum("bcd,bd->bc", c, x[node])  # distance to the node
    between = 1 - c @ c.transpose(0, 2, 1)
    alive = near != node[:, None]
    kept = np.full((len(node), DEGREE), -1)
    rows = np.arange(len(node))
    for r in range(DEGREE):
        some = alive.any(1)
        if not some.any():
            break
        best = np.where(alive, own, np.inf).argmin(1)
        kept[some, r] = near[rows, best][some]
        alive &= ALPHA * between[rows, best] > own
        alive[rows, best] = False
    return kept


def _block(n: int, width: int) -> int:
    """Rows handled at a time: BLOCK, or fewer if their vectors are long or the shard is large."""
    return max(8, min(BLOCK, (1 << 16) // width, (1 << 19) // n) // 8 * 8)


def build(x: np.ndarray) -> list[np.ndarray]:
    """Neighbours of each vector of one shard."""
    n = len(x)
    rng = np.random.default_rng(n)
    sets: list[set[int]] = [set() for _ in range(n)]
    block = _block(n, x.shape[1])
    for at in range(0, n, block):
        node = np.arange(at, min(n, at + block))
        sim = x[node] @ x.T
        k = min(NEAREST + 1, n)
        near = np.argpartition(-sim, k - 1, axis=1)[:, :k]
        near = np.concatenate([near, rng.integers(0, n, (len(node), min(RANDOM, n)))], 1)
        for i, kept in zip(node, robust_prune(x, node, near), strict=True):
            sets[i].update(kept[kept >= 0].tolist())
    for i in range(n):
        for j in list(sets[i]):
            sets[j].add(i)
    # Tie what the medoid can't reach to it.
    start = medoid(x)
    seen = np.zeros(n, dtype=bool)
    for root in [start, *range(n)]:
        if seen[root]:
            continue
        if root != start:
            sets[start].add(root)
            sets[root].add(start)
        stack = [root]
        seen[root] = True
        while stack:
            for j in sets[stack.pop()]:
                if not seen[j]:
                    seen[j] = True
                    stack.append(j)
    return [np.array(sorted(s), dtype=np.int64) for s in sets]


def medoid(x: np.ndarray) -> int:
    return int((x @ x.mean(0)).argmax())


def range_search(x: np.ndarray, queries: np.ndarray, flat: np.ndarray, offset: np.ndarray, start: int, threshold: float) -> np.ndarray:
    """(queries, members): which members with a cosine of at least the threshold the search meets.

    Lists go both ways. What is held does not grow with the members found, nor with their neighbours.
    """
    b, n = len(queries), len(x)
    cosine = np.full((b, n), -np.inf)  # of the members met
    rows = np.arange(b)
    cosine[:, start] = queries @ x[start]
    beam, close = np.full((b, BEAM), start), np.full((b, BEAM), -np.inf)
    close[:, 0] = cosine[:, start]
    opened = np.zeros((b, BEAM), dtype=bool)
    opened[:, 1:] = True
    step = max(1, (1 << 21) // x.shape[1])

    def look(q: np.ndarray, to: np.ndarray) -> None:
        i, j = (np.flatnonzero(np.bincount(v)) for v in (q, to))
        if 8 * len(q) > len(i) * len(j):  # most of a block
            block = queries[i] @ x[j].T
            cosine[q, to] = block[np.searchsorted(i, q), np.searchsorted(j, to)]
            return
        for a in range(0, len(q), step):
            i, j = q[a : a + step], to[a : a + step]
            cosine[i, j] = np.einsum("ij,ij->i", queries[i], x[j])

    while True:
        best = np.where(opened, -np.inf, close).argmax(1)
        go = np.flatnonzero(~opened[rows, best])
        if not len(go):
            break
        opened[go, best[go]] = True
        node = beam[go, best[go]]
        size = offset[node + 1] - offset[node]
        many = np.cumsum(size)
        q, to = np.repeat(go, size), flat[np.repeat(offset[node] - (many - size), size) + np.arange(many[-1])]
        new = cosine[q, to] == -np.inf
        q, to = q[new], to[new]
        if not len(q):
            continue
        look(q, to)
        # Merge the new members into the beams.
        size = np.bincount(q, minlength=b)
        width = int(size.max())
        col = np.arange(len(q)) - np.repeat(np.cumsum(size) - size, size)
        more, more_close = np.zeros((b, width), np.int64), np.full((b, width), -np.inf)
        more[q, col], more_close[q, col] = to, cosine[q, to]
        beam, close = np.concatenate([beam, more], 1), np.concatenate([close, more_close], 1)
        opened = np.concatenate([opened, more_close == -np.inf], 1)
        top = np.argsort(-close, axis=1, kind="stable")[:, :BEAM]
        beam, close, opened = (np.take_along_axis(v, top, 1) for v in (beam, close, opened))
    # Expand the range: a bit for each query, so that an edge costs the same for one query and for all.
    some = np.flatnonzero(np.diff(offset))
    edge = cosine >= threshold - SLACK
    while edge.any():
        bits = np.zeros((n, 8 * -(-b // 64)), np.uint8)
        bits[:, : -(-b // 8)] = np.packbits(edge.T, axis=1)
        met = np.zeros_like(bits)
        words, reached = bits.view(np.uint64), met.view(np.uint64)
        for w in range(words.shape[1]):
            reached[some, w] = np.bitwise_or.reduceat(words[flat, w], offset[some])
        new = np.unpackbits(met, axis=1, count=b).T.astype(bool) & (cosine == -np.inf)
        look(*np.nonzero(new))
        edge = new & (cosine >= threshold - SLACK)
    return cosine >= threshold


def _labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest member that each one is linked with, over any number of links."""
    label = np.arange(n)
    while True:
        low = label.copy()
        np.minimum.at(low, i, label[j])
        np.minimum.at(low, j, label[i])
        low = low[low]
        if (low == label).all():
            return label
        label = low


def _joined(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The labels after more links between members."""
    i, j = label[i], label[j]
    apart = i != j
    return _labels(len(label), i[apart], j[apart])[label] if apart.any() else label


def _marks(*lists: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """The distinct values in the lists of all columns, and for each column a table of which row holds which."""
    flat = [x.flatten().to_numpy(zero_copy_only=False) for x in lists]
    values = np.unique(np.concatenate(flat))
    out = []
    for x, f in zip(lists, flat, strict=True):
        marks = np.zeros((len(x), len(values)), np.float32)
        marks[np.repeat(np.arange(len(x)), x.value_lengths().to_numpy(zero_copy_only=False)), np.searchsorted(values, f)] = 1
        out.append(marks)
    return values, out


def _lists(values: np.ndarray, marks: np.ndarray) -> pa.Array:
    """The values marked in each row, as a list column."""
    row, col = np.nonzero(marks)
    return pa.ListArray.from_arrays(np.searchsorted(row, np.arange(len(marks) + 1)).astype(np.int32), pa.array(values[col], pa.int64()))


def _graph(threshold: float, width: int):  # noqa: ANN202
    # No vector has links with two others that are farther from each other than this.
    least = 2 * threshold * threshold - 1 - 1e-9 if threshold > 0 else -1.0

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("id")
        x = _unit(rows.column("vector"), width)
        lists = build(x)
        ids, size = rows.column("id").to_numpy(), np.array([len(v) for v in lists])
        owner, to = np.repeat(np.arange(len(ids)), size), np.concatenate(lists)
        step, close = max(1, (1 << 21) // width), np.zeros(len(to), dtype=bool)
        for a in range(0, len(to), step):
            s = slice(a, a + step)
            close[s] = np.einsum("ij,ij->i", x[owner[s]], x[to[s]]) >= least
        edge = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
        some = np.concatenate([[0], np.cumsum(np.bincount(owner[close], minlength=len(ids)))]).astype(np.int32)
        return pa.table(
            {
                "shard": rows.column("shard"), "id": rows.column("id"),
                "near": pa.ListArray.from_arrays(edge, pa.array(to, pa.int32())),
                "close": pa.ListArray.from_arrays(some, pa.array(ids[to[close]], pa.int64())),
            }
        )

    return run


class _Shard:
    """A shard's members by id, with their vectors and their united lists, which are searched."""

    def __init__(self, rows: pa.Table, width: int) -> None:
        own = rows.filter(pc.equal(rows.column("kind"), MEMBER)).sort_by("id").combine_chunks()
        told = rows.filter(pc.equal(rows.column("kind"), LISTS)).sort_by("id").combine_chunks()
        self.ids, self.mult = own.column("id").to_numpy(), own.column("mult").to_numpy()
        self.shard, n = own.column("shard")[0].as_py(), len(self.ids)
        vectors = own.column("vector").combine_chunks()
        self.length, self.x = vectors.value_lengths().to_numpy(zero_copy_only=False), _unit(vectors, width)
        self.shards, self.homes = (told.column(c).combine_chunks() for c in ("shards", "homes"))
        near, close = (told.column(c).combine_chunks() for c in ("near", "close"))
        # The shard's own lists, and of the others' those neighbours that may matter to the range.
        to = close.flatten().to_numpy(zero_copy_only=False)
        at = np.minimum(np.searchsorted(self.ids, to), n - 1)
        local = self.ids[at] == to
        owner = [np.repeat(np.arange(n), v.value_lengths().to_numpy(zero_copy_only=False)) for v in (near, close)]
        key = np.concatenate([owner[0] * np.int64(n) + near.flatten().to_numpy(zero_copy_only=False), owner[1][local] * np.int64(n) + at[local]])
        key = np.unique(np.concatenate([key, key % n * n + key // n]))
        self.flat, self.offset = key % n, np.searchsorted(key, np.arange(n + 1) * np.int64(n))
        self.start = medoid(self.x)

    def search(self, queries: np.ndarray, length: np.ndarray, threshold: float) -> np.ndarray:
        hit = range_search(self.x, queries, self.flat, self.offset, self.start, threshold)
        return hit & (length[:, None] == self.length)


def _search(threshold: float, width: int):  # noqa: ANN202
    def run(rows: pa.Table) -> pa.Table:
        s = _Shard(rows, width)
        n = len(s.ids)
        block = _block(n, width)
        bits = np.zeros((n, -(-n // 8)), np.uint8)
        for a in range(0, n, block):
            hit = s.search(s.x[a : a + block], s.length[a : a + block], threshold)
            hit[np.arange(len(hit)), a + np.arange(len(hit))] = False
            bits[a : a + block] = np.packbits(hit, axis=1)
        values, (of,) = _marks(s.shards)
        lower = of[:, values < s.shard]
        homes, (lead,) = _marks(s.homes)
        links, label, visits = np.zeros(n, np.int64), np.arange(n), np.zeros((n, len(homes)), dtype=bool)
        for a in range(0, n, block):
            # A pair is one whichever end has found it.
            hit = np.unpackbits(bits[a : a + block], axis=1, count=n).astype(bool)
            hit |= np.unpackbits(bits[:, a // 8 : (a + block) // 8], axis=1)[:, : len(hit)].T.astype(bool)
            some = np.flatnonzero(hit.any(1))
            if not len(some):
                continue
            hit, some = hit[some], some + a
            # It counts in the smallest shard that both are in.
            links[some] = (hit & (lower[some] @ lower.T == 0)) @ s.mult
            i, j = np.nonzero(hit)
            label = _joined(label, some[i], j)
            # Where neighbours of a vector's finds are at home.
            visits[some] = hit.astype(np.float32) @ lead > 0
        if len(homes):
            visits[:, np.isin(homes, values)] &= of[:, np.searchsorted(values, homes[np.isin(homes, values)])] == 0
        return pa.table({"id": s.ids, "links": links, "root": s.ids[label], "visits": _lists(homes, visits)})

    return run


def _visit(threshold: float, width: int):  # noqa: ANN202
    def run(rows: pa.Table) -> pa.Table:
        s = _Shard(rows, width)
        guests = rows.filter(pc.equal(rows.column("kind"), GUEST)).sort_by("id").combine_chunks()
        ids, mult, vectors = guests.column("id").to_numpy(), guests.column("mult").to_numpy(), guests.column("vector").combine_chunks()
        n, g, length = len(s.ids), len(ids), vectors.value_lengths().to_numpy(zero_copy_only=False)
        values, (of, theirs) = _marks(s.shards, guests.column("shards").combine_chunks())
        at_home = of[:, values < s.shard].sum(1) == 0
        # Where neighbours of a vector are at home; of a guest also its own home.
        homes, (lead, leads) = _marks(s.homes, guests.column("homes").combine_chunks())
        first = values[theirs.argmax(1)]
        homes, old = np.union1d(homes, first), homes
        place = np.searchsorted(homes, old)
        wide = [np.zeros((len(v), len(homes)), np.float32) for v in (lead, leads)]
        for v, w in zip((lead, leads), wide, strict=True):
            w[:, place] = v
        lead, leads = wide
        leads[np.arange(g), np.searchsorted(homes, first)] = 1
        links, label = np.zeros(n + g, np.int64), np.arange(n + g)
        visits = np.zeros((n + g, len(homes)), dtype=bool)
        block = _block(n, width)
        for a in range(0, g, block):
            b = slice(a, a + block)
            hit = s.search(_unit(vectors[b], width), length[b], threshold)
            hit &= at_home & (theirs[b] @ of.T == 0)
            if not hit.any():
                continue
            visits[n:][b] = hit.astype(np.float32) @ lead > 0
            visits[:n] |= hit.T.astype(np.float32) @ leads[b] > 0
            # A pair counts where the larger id is at home.
            mine = hit & (ids[b][:, None] < s.ids)
            links[n:][b] = mine @ s.mult
            links[:n] += mult[b] @ mine
            i, j = np.nonzero(mine)
            label = _joined(label, n + a + i, j)
        both = np.isin(homes, values)
        visits[:, both] &= np.concatenate([of, theirs])[:, np.searchsorted(values, homes[both])] == 0
        every = np.concatenate([s.ids, ids])
        out = pa.table({"id": every, "links": links, "root": every[label], "visits": _lists(homes, visits)})
        return out.filter(pa.array((links > 0) | visits.any(1) | (label != np.arange(n + g))))

    return run


def near_vectors(embeddings: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The contract of op10: vec_id, n_links, component_id, kept."""
    small_batches(embeddings.sparkSession)
    # Vectors of single precision stay so where they are written or shuffled.
    single = isinstance(embeddings.schema["embedding"].dataType.elementType, FloatType)
    vector = F.col("embedding").cast("array<float>" if single else "array<double>")
    usable = F.coalesce(
        (F.size(vector) > 0)
        & F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
        & F.exists(vector, lambda v: v != 0),
        F.lit(False),
    )
    # Vectors that differ by a factor alone are one class too: no split could part them.
    largest = F.array_max(F.transform(vector, lambda v: F.abs(v.cast("double"))))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector"), F.when(usable, largest).alias("largest"))
    rows = rows.select("vec_id", "vector", F.when(F.col("largest").isNotNull(), F.xxhash64(F.transform("vector", lambda v: v.cast("double") / F.col("largest")))).alias("id"))
    full = rows.filter(F.col("id").isNotNull())
    classes = table(
        full.groupBy("id").agg(F.count("*").alias("mult"), F.min("vec_id").alias("low"), F.min("vector").alias("vector")), "vectors"
    )
    width = classes.agg(F.max(F.size("vector"))).first()[0] or 1
    members = shards(classes.select("id", "mult", "vector"), width)

    # Lists of places in the shard; neighbours close enough to matter to another shard also by id, united.
    graph = table(
        members.groupBy("shard").applyInArrow(_graph(threshold, width), "shard long, id long, near array<int>, close array<long>"), "graph"
    )
    united = graph.groupBy("id").agg(
        F.sort_array(F.collect_set("shard")).alias("shards"), F.array_distinct(F.flatten(F.collect_list("close"))).alias("close")
    )
    united = table(united, "united")
    home = united.select(F.col("id").alias("other"), F.col("shards")[0].alias("home"))
    homes = united.select("id", F.explode("close").alias("other")).join(home, "other").groupBy("id").agg(F.collect_set("home").alias("homes"))
    none = F.array().cast("array<long>")
    index = table(united.join(homes, "id", "left").withColumn("homes", F.coalesce("homes", none)), "index")
    lists = table(graph.select("shard", "id", "near").join(index, "id"), "lists")

    def kind(rows: DataFrame, k: int, *names: str) -> DataFrame:
        """Rows of one kind in a form that all kinds have."""
        empty = {"mult": "long", "vector": vectors, "near": "array<int>", "shards": "array<long>", "close": "array<long>", "homes": "array<long>"}
        return rows.select(*names, F.lit(k).alias("kind"), "id", *[F.col(c) if c in rows.columns else F.lit(None).cast(t).alias(c) for c, t in empty.items()])

    vectors = classes.schema["vector"].dataType.simpleString()
    ready = kind(members, MEMBER, "shard").unionByName(kind(lists, LISTS, "shard"))
    form = "id long, links long, root long, visits array<long>"
    found = table(ready.groupBy("shard").applyInArrow(_search(threshold, width), form), "found")

    # Vectors visit the shards where neighbours of their finds are at home, until none has a new one to visit.
    slim = classes.select("id", "mult", "vector").join(index.drop("close"), "id")
    last, told, visited = found, [found], None
    while True:
        asked = last.select("id", F.explode("visits").alias("shard")).distinct()
        asked = table(asked if visited is None else asked.join(visited, ["id", "shard"], "left_anti"), "visits")
        if asked.isEmpty():
            break
        visited = asked if visited is None else visited.unionByName(asked)
        # A shard with many guests serves them in several tasks.
        parts = asked.groupBy("shard").agg(F.ceil(F.count("*") / GUESTS).alias("parts"))
        parts = small(table(parts, "parts"))
        hosts = ready.join(parts, "shard").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        guests = asked.join(parts, "shard").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts"))).join(slim, "id")
        both = hosts.drop("parts").unionByName(kind(guests, GUEST, "shard", "part"))
        last = table(both.groupBy("shard", "part").applyInArrow(_visit(threshold, width), form), "found")
        told.append(last)
    for more in told[1:]:
        found = found.unionByName(more)

    edges = found.select(F.col("id").alias("a"), F.col("root").alias("b")).filter("a <> b")
    links = found.select("id", "links")
    comp = components(edges).withColumnRenamed("node", "id")
    grouped = classes.select("id", "mult", "low").join(comp, "id", "left").withColumn("component", F.coalesce("component", "id"))
    lowest = grouped.groupBy("component").agg(F.min("low").alias("component_id"))
    told = (
        grouped.join(links.groupBy("id").agg(F.sum("links").alias("links")), "id", "left")
        .join(lowest, "component")
        .select("id", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"), "component_id")
    )
    component = F.coalesce("component_id", "vec_id")
    return rows.drop("vector").join(told, "id", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )


def audit(embeddings: DataFrame, result: DataFrame, threshold: float = THRESHOLD, every: int = 20, block: int = 2000) -> float:
    """Share of the true links of every twentieth vec_id that `result` counts, by brute force in blocks."""
    rows = embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).filter(F.col("v").isNotNull())
    queries = rows.filter(F.pmod("vec_id", F.lit(every)) == 0)
    parts = max(1, -(-queries.count() // block))
    true, got = 0, 0
    for k in range(parts):
        mine = queries.filter(F.pmod(F.xxhash64("vec_id"), F.lit(parts)) == k).collect()
        if not mine:
            continue
        ids, q = [r["vec_id"] for r in mine], _unit([r["v"] for r in mine])
        known = embeddings.sparkSession.sparkContext.broadcast((ids, q))

        def count(batches: Iterator[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            ids, q = known.value
            for batch in batches:
                if batch.num_rows:
                    hit = (_unit(batch.column(1).to_pylist()) @ q.T >= threshold).sum(0)
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hit, pa.int64())], names=["vec_id", "n"])

        exact = rows.mapInArrow(count, "vec_id long, n long").groupBy("vec_id").agg((F.sum("n") - 1).alias("n"))
        both = exact.join(result, "vec_id").agg(F.sum("n"), F.sum(F.least("n", "n_links"))).first()
        true, got = true + (both[0] or 0), got + (both[1] or 0)
    return got / true if true else 1.0
