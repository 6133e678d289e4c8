"""Prefix trie of conversations, with subtree totals by parallel tree contraction.

A node is a distinct sequence of turns (role, text). It is named by its smallest member and
its depth, which is unique: a conversation has one prefix of each length. Prefixes are told
apart by 128-bit hashes, sums over hashes of (depth, turn), so that a prefix is a running sum.

Turns are numbered by one range sort, not by a window over a conversation: a partition of the
sort is a slice, positions and running sums are worked out inside the slices of a
conversation, and what lies before a slice is added from one row for each slice. A
conversation that holds a third of all turns is thus spread over many tasks.

Subtree totals (sums of node values) come from contraction in join rounds:

* compress: each node with one child points at the child; pointers double, round by round,
  until each points at the bottom of its chain. The bottom takes the place of the chain, and
  its edge carries the sum of what was taken out.
* rake: all nodes without children are taken out, and their totals added to their parents.

Every rake leaves at most half of the nodes, as none has a single child then. At the end the
phases are gone through backwards, and each compressed node gets the total of its bottom and
what its pointer had summed up. A state is a written table, so a lost executor costs a retry.
No step gathers the children, members or ends of a node: counts and sums combine before the
shuffle, and in the joins each key is unique on one side, so that adaptive execution splits
a hot parent or a long chain.

The digest of the ends of a node goes over all their ids in order, which is a sequence by its
nature. Ids are sorted by range and packed into texts of up to `PACK` ids in many tasks; one
task then only hashes the packed texts of a node, one after the other.

Nulls: a null conv_id belongs to no conversation and its rows are left out; null turns come
first; null roles and texts are empty. Ties in turn are ordered by role and text; repeated
rows are turns of their own. An empty table has no nodes. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import table

cloudpickle.register_pickle_by_value(sys.modules[__name__])

PACK = 1 << 14
DIGEST_BATCH = 10_000
PARTS = ["s1", "s2", "s3", "s4"]
VALUES = ["n_leaves", "saved"]


def number(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, slices): turns as hashes in order, and where each slice of a conversation begins."""
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.monotonically_increasing_id().alias("row"),  # spreads repeated rows
    )
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text", "row"]
    turns = table(
        rows.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select(
            "conv_id",
            F.spark_partition_id().alias("slice"),
            F.monotonically_increasing_id().alias("place"),  # counts up by one inside a partition
            F.xxhash64("role", "text").alias("h1"),
            F.xxhash64(F.lit(7), "text", "role").alias("h2"),
            F.length("text").cast("long").alias("chars"),
        ),
        "turns",
    )
    slices = turns.groupBy("conv_id", "slice").agg(F.min("place").alias("first"), F.count("*").alias("turns"))
    earlier = Window.partitionBy("conv_id").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.withColumn("before", F.coalesce(F.sum("turns").over(earlier), F.lit(0)))
    return turns, table(slices, "slices")


def place(turns: DataFrame, slices: DataFrame) -> DataFrame:
    """Turns with their position in the conversation, from 1."""
    at = F.col("place") - F.col("first") + F.col("before") + 1
    return turns.join(slices.drop("turns"), ["conv_id", "slice"]).select("conv_id", "slice", at.alias("depth"), "h1", "h2", "chars")


def whole(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, convs) of conversations as they are; the input of `trie`."""
    turns, slices = number(conversations)
    convs = table(slices.groupBy("conv_id").agg(F.sum("turns").alias("size")), "convs")
    return place(turns, slices).join(convs, "conv_id"), convs


def rebuild(conversations: DataFrame, share: int = 6, group: int = 100) -> tuple[DataFrame, DataFrame]:
    """(turns, convs) where each conversation takes over the head of another one.

    The first h = crc32(conv_id) % share turns of conversation conv_id - conv_id % group stand in
    for its own first h turns.
    """
    turns, slices = number(conversations)
    convs = slices.groupBy("conv_id").agg(F.sum("turns").alias("own"))
    convs = convs.withColumn("h", F.crc32(F.col("conv_id").cast("string")) % share).withColumn("donor", F.col("conv_id") - F.col("conv_id") % group)
    donors = convs.select(F.col("conv_id").alias("donor"), F.col("own").alias("given"))
    taken = F.least("h", F.coalesce("given", F.lit(0)))
    convs = table(
        convs.join(donors, "donor", "left").select(
            "conv_id", "donor", "h", taken.alias("taken"), (taken + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("size")
        ),
        "convs",
    )
    placed = table(place(turns, slices), "placed")
    kept = placed.join(convs, "conv_id").filter("depth > h")
    kept = kept.select("conv_id", "slice", (F.col("depth") - F.col("h") + F.col("taken")).alias("depth"), "h1", "h2", "chars", "size")
    heads = placed.filter(F.col("depth") < share).withColumnRenamed("conv_id", "donor").drop("slice")
    given = convs.filter("taken > 0").join(heads, "donor").filter("depth <= taken")
    given = given.select("conv_id", F.lit(-1).alias("slice"), "depth", "h1", "h2", "chars", "size")
    return kept.unionByName(given), convs.select("conv_id", "size")


def _name(depth: Column, sums: list[Column]) -> list[Column]:
    return [F.xxhash64(depth, *sums), F.xxhash64(sums[3], depth, *reversed(sums[:3]))]


def _paths(turns: DataFrame) -> DataFrame:
    """Each conversation's prefixes: conv_id, depth, chars, last, names of the prefix and of its parent."""
    a, b = F.xxhash64("depth", "h1", "h2"), F.xxhash64("h2", "depth", "h1")
    low = lambda h: h.bitwiseAND(F.lit(0xFFFFFFFF))  # noqa: E731 - sums of 32-bit parts never overflow
    high = lambda h: F.shiftrightunsigned(h, 32)
    parts = [part(h).alias(n) for n, (part, h) in zip(PARTS, [(low, a), (high, a), (low, b), (high, b)], strict=True)]
    steps = table(turns.select("conv_id", "slice", "depth", "chars", (F.col("depth") == F.col("size")).alias("last"), *parts), "steps")
    totals = steps.groupBy("conv_id", "slice").agg(*[F.sum(p).alias(p) for p in PARTS])
    earlier = Window.partitionBy("conv_id").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("conv_id", "slice", *[F.coalesce(F.sum(p).over(earlier), F.lit(0)).alias(f"before_{p}") for p in PARTS])
    here = Window.partitionBy("conv_id", "slice").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = steps.select("*", *[F.sum(p).over(here).alias(f"run_{p}") for p in PARTS]).join(before, ["conv_id", "slice"])
    sums = [F.col(f"before_{p}") + F.col(f"run_{p}") for p in PARTS]
    k1, k2 = _name(F.col("depth"), sums)
    p1, p2 = _name(F.col("depth") - 1, [s - F.col(p) for s, p in zip(sums, PARTS, strict=True)])
    return run.select("conv_id", "depth", "chars", "last", k1.alias("k1"), k2.alias("k2"), p1.alias("p1"), p2.alias("p2"))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (k1, k2, conv_id) -> rows of up to PACK ids of one key, joined by commas."""
    key, held, first = None, [], 0
    out: list[tuple[int, int, int, str]] = []

    def flush() -> None:
        if held:
            out.append((*key, first, ",".join(held)))
            held.clear()

    for batch in batches:
        a, b, ids = (c.to_numpy() for c in batch.columns)
        edges = np.flatnonzero((a[1:] != a[:-1]) | (b[1:] != b[:-1])) + 1
        begin = 0
        for run in np.split(ids, edges):
            at = 0
            while at < len(run):
                now = int(a[begin]), int(b[begin])
                if now != key or len(held) >= PACK:
                    flush()
                    key = now
                some = run[at : at + PACK - len(held)].tolist()
                if not held:
                    first = some[0]
                held.extend(map(str, some))
                at += len(some)
            begin += len(run)
        if len(out) >= 1000:
            yield _packed(out)
            out.clear()
    flush()
    if out:
        yield _packed(out)


def _packed(rows: list[tuple[int, int, int, str]]) -> pa.RecordBatch:
    k1, k2, first, ids = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (k1, k2, first)] + [pa.array(ids)], names=["k1", "k2", "first", "ids"])


def _hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed ids in order -> the digest of each key."""
    key, state, out = None, None, []
    for batch in batches:
        for k1, k2, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (k1, k2) == key:
                state.update(b",")
            else:
                if state:
                    out.append((*key, state.hexdigest()))
                key, state = (k1, k2), hashlib.sha256()
            state.update(ids.encode())
        if len(out) >= DIGEST_BATCH:
            yield _digests(out)
            out = []
    if state:
        yield _digests([*out, (*key, state.hexdigest())])


def _digests(rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
    k1, k2, h = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(h)], names=["k1", "k2", "ends_sha256"])


def _ends(ends: DataFrame) -> DataFrame:
    """k1, k2, ends_sha256 of all keys with ends (k1, k2, conv_id)."""
    order = ["k1", "k2", "conv_id"]
    packed = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    packed = packed.mapInArrow(_pack, "k1 bigint, k2 bigint, first bigint, ids string")
    together = packed.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "first").select("k1", "k2", "ids")
    return together.mapInArrow(_hash, "k1 bigint, k2 bigint, ends_sha256 string")


def _add(*names: str) -> list[Column]:
    return [(F.col(v) + F.coalesce(*[F.col(n.format(v)) for n in names], F.lit(0))).alias(v) for v in VALUES]


def _compress(alive: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes left, compressed): no node that is left has a single child.

    compressed: (v, d) has the total of its bottom (bv, bd) plus its own columns VALUES.
    """
    edge = [f"edge_{v}" for v in VALUES]
    kids = alive.filter(F.col("pv").isNotNull()).groupBy("pv", "pd").agg(F.count("*").alias("n"), F.max(F.struct("v", "d", *edge)).alias("kid"))
    only = kids.filter("n = 1").select(F.col("pv").alias("v"), F.col("pd").alias("d"), "kid")
    first = table(
        alive.join(only, ["v", "d"]).select(
            "v", "d", F.col("kid.v").alias("bv"), F.col("kid.d").alias("bd"), *[(F.col(v) + F.col(f"kid.edge_{v}")).alias(v) for v in VALUES]
        ),
        "chain",
    )
    done, open_ = [], first
    while not open_.isEmpty():
        known = open_
        for x in done:
            known = known.unionByName(x)
        ahead = known.select(F.col("v").alias("bv"), F.col("d").alias("bd"), F.struct("bv", "bd", *VALUES).alias("to"))
        step = table(
            open_.join(ahead, ["bv", "bd"], "left").select(
                "v", "d",
                F.coalesce("to.bv", "bv").alias("bv"), F.coalesce("to.bd", "bd").alias("bd"),
                *_add("to.{}"), F.col("to").isNull().alias("done"),
            ),
            "doubled",
        )
        done.append(step.filter("done").drop("done"))
        open_ = step.filter("NOT done").drop("done")
    chains = done[0] if done else first
    for x in done[1:]:
        chains = chains.unionByName(x)
    # The top of a chain is nobody's only child.
    tops = chains.join(first.select(F.col("bv").alias("v"), F.col("bd").alias("d")), ["v", "d"], "left_anti")
    tops = tops.withColumnsRenamed({v: f"sum_{v}" for v in VALUES}).join(alive.select("v", "d", "pv", "pd", *edge), ["v", "d"])
    moved = tops.select(
        F.col("bv").alias("v"), F.col("bd").alias("d"),
        F.struct("pv", "pd", *[(F.col(f"sum_{v}") + F.col(f"edge_{v}")).alias(f"edge_{v}") for v in VALUES]).alias("up"),
    )
    rest = alive.join(first.select("v", "d"), ["v", "d"], "left_anti").join(moved, ["v", "d"], "left")
    new = lambda c: F.when(F.col("up").isNotNull(), F.col(f"up.{c}")).otherwise(F.col(c)).alias(c)
    return table(rest.select("v", "d", *VALUES, *[new(c) for c in ("pv", "pd", *edge)]), "compressed"), chains


def _rake(alive: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes left, totals of the leaves taken out)."""
    parents = alive.select(F.col("pv").alias("v"), F.col("pd").alias("d")).distinct().withColumn("inner", F.lit(True))
    marked = table(alive.join(parents, ["v", "d"], "left"), "marked")
    leaves = marked.filter(F.col("inner").isNull())
    gain = leaves.groupBy(F.col("pv").alias("v"), F.col("pd").alias("d")).agg(*[F.sum(F.col(v) + F.col(f"edge_{v}")).alias(f"gain_{v}") for v in VALUES])
    rest = marked.filter("inner").join(gain, ["v", "d"], "left")
    left = rest.select("v", "d", "pv", "pd", *[f"edge_{v}" for v in VALUES], *_add("gain_{}"))
    return table(left, "raked"), leaves.select("v", "d", *VALUES)


def subtree_sums(nodes: DataFrame) -> DataFrame:
    """v, d and the sums of VALUES over the subtrees of all nodes of trees.

    nodes: (v, d) names a node, (pv, pd) its parent (null for a root).
    """
    alive, phases = nodes.select("*", *[F.lit(0).cast("long").alias(f"edge_{v}") for v in VALUES]), []
    while not alive.isEmpty():
        alive, chains = _compress(alive)
        alive, leaves = _rake(alive)
        phases.append((chains, leaves))
    total = nodes.select("v", "d", *VALUES).limit(0)
    for chains, leaves in reversed(phases):
        total = total.unionByName(leaves)
        bottom = total.select(F.col("v").alias("bv"), F.col("d").alias("bd"), F.struct(*VALUES).alias("to"))
        total = total.unionByName(table(chains.join(bottom, ["bv", "bd"]).select("v", "d", *_add("to.{}")), "expanded"))
    return total


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row for each distinct prefix of `turns`, the root included.

    turns: conv_id, slice, depth (from 1), h1, h2, chars, size; convs: conv_id and size of all
    conversations, those without turns too. The last turn of a node is turn `depth` of
    conversation `conv_id`. Columns: conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256.
    """
    paths = table(_paths(turns), "paths")
    zero = [F.lit(0).cast("long")] * 4
    root = [c.alias(n) for n, c in zip(("k1", "k2"), _name(F.lit(0).cast("long"), zero), strict=True)]
    nodes = paths.groupBy("depth", "k1", "k2").agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("chars").alias("chars"), F.min("p1").alias("p1"), F.min("p2").alias("p2")
    )
    top = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).filter("n_convs > 0")
    top = top.select("*", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("chars"), *root)
    nodes = table(nodes.unionByName(top, allowMissingColumns=True), "prefixes")
    above = nodes.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"))
    nodes = table(nodes.join(above, ["p1", "p2", "depth"], "left").drop("p1", "p2"), "nodes")
    kids = nodes.filter("depth > 0").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    nodes = table(nodes.join(kids, ["conv_id", "depth"], "left").fillna(0, ["n_children"]), "family")
    totals = subtree_sums(
        nodes.select(
            F.col("conv_id").alias("v"), F.col("depth").alias("d"), F.col("parent_conv_id").alias("pv"), (F.col("depth") - 1).alias("pd"),
            F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"),
        )
    )
    ends = paths.filter("last").select("k1", "k2", "conv_id").unionByName(convs.filter("size = 0").select(*root, "conv_id"))
    nodes = nodes.join(_ends(ends), ["k1", "k2"], "left")
    totals = totals.select(F.col("v").alias("conv_id"), F.col("d").alias("depth"), "n_leaves", F.col("saved").alias("saved_tokens"))
    return nodes.join(totals, ["conv_id", "depth"]).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def shared_heads(conversations: DataFrame) -> DataFrame:
    """The contract of op11: the trie of the rebuilt conversations."""
    return trie(*rebuild(conversations))
