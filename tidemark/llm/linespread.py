"""Remove lines that stand on many sites: cross-site boilerplate.

Every non-blank line, trimmed of spaces, is known by two 64-bit hashes. One aggregation
keeps, for each line, a HyperLogLog sketch of the sites (sources) it stands on; sketches
of single tasks merge in the same aggregation. A line whose estimate is clearly over or
under the threshold is decided by it. Lines near the threshold, within five standard
errors or one site, get an exact distinct count, so the result is that of exact counting.

A boilerplate line goes from every document except the one with the smallest doc_id that
has it, so that no text disappears from the corpus: of a document copied to many sites
one copy stays whole.

Nulls: a null source is no site; a null text has no lines and stays null; a null doc_id
is larger than any other. Blank lines always stay. A table without rows gives no rows.
Rows are told apart by doc_id only where a line's keeper is chosen; repeated rows are
treated alike. Extra columns pass through `drop_boilerplate` unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import table

MIN_SITES = 10
LOG_REGISTERS = 12
STANDARD_ERROR = 1.04 / 2 ** (LOG_REGISTERS / 2)


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _key(line: Column) -> Column:
    return F.struct(F.xxhash64(F.trim(line)).alias("h1"), F.xxhash64(F.lit(7), F.trim(line)).alias("h2"))


def occurrences(docs: DataFrame) -> DataFrame:
    """(doc_id, source, h1, h2) for each distinct non-blank line of a row."""
    full = F.filter(_lines(F.col("text")), lambda x: F.trim(x) != "")
    keys = F.array_distinct(F.transform(full, _key))
    return docs.select("doc_id", "source", F.explode(keys).alias("k")).select("doc_id", "source", "k.h1", "k.h2")


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """(h1, h2, keeper) of the lines on at least `min_sites` distinct sites."""
    spread = table(
        lines.groupBy("h1", "h2")
        .agg(
            F.hll_sketch_agg("source", F.lit(LOG_REGISTERS)).alias("sketch"),
            F.min("doc_id").alias("keeper"),
        )
        .select("h1", "h2", "keeper", F.hll_sketch_estimate("sketch").cast("double").alias("sites"))
        .filter(F.col("sites") >= min_sites - max(1.0, 5 * STANDARD_ERROR * min_sites)),
        "spread",
    )
    band = max(1.0, 5 * STANDARD_ERROR * min_sites)
    clear = spread.filter(F.col("sites") > min_sites + band)
    near = spread.filter(F.col("sites") <= min_sites + band)
    exact = (
        lines.join(near.select("h1", "h2"), ["h1", "h2"], "left_semi")
        .filter(F.col("source").isNotNull())
        .select("h1", "h2", "source")
        .distinct()
        .groupBy("h1", "h2")
        .agg(F.count("*").alias("exact"))
        .filter(F.col("exact") >= min_sites)
    )
    cols = ["h1", "h2", "keeper"]
    return clear.select(*cols).unionByName(near.join(exact, ["h1", "h2"]).select(*cols))


def drop_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, counts: bool = True) -> DataFrame:
    """`docs` with text cut to its kept lines; with `counts` also n_lines and n_removed (lines),
    in place of columns of these names."""
    lines = table(occurrences(docs), "lines")
    bad = boilerplate(lines, min_sites)
    drops = (
        lines.join(bad, ["h1", "h2"])
        .filter(~F.col("doc_id").eqNullSafe(F.col("keeper")))
        .groupBy("doc_id")
        .agg(F.collect_set(F.struct("h1", "h2")).alias("_drop"))
        .withColumnRenamed("doc_id", "_id")
    )
    # Columns by their tables: `docs` may have others of these names.
    text, drop = docs["text"], drops["_drop"]
    joined = docs.join(drops, docs["doc_id"].eqNullSafe(drops["_id"]), "left")
    kept = F.filter(_lines(text), lambda x: (F.trim(x) == "") | ~F.array_contains(drop, _key(x)))
    cut = F.when(drop.isNull(), text).otherwise(F.array_join(kept, "\n"))
    size = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
    n_lines = F.when(text.isNull(), F.lit(0).cast("long")).otherwise(size(_lines(text)))
    n_removed = F.when(drop.isNull(), F.lit(0).cast("long")).otherwise(n_lines - size(kept))
    added = {"n_lines": n_lines, "n_removed": n_removed} if counts else {}
    own = [cut.alias("text") if c == "text" else docs[f"`{c}`"] for c in docs.columns if c not in added]
    return joined.select(*own, *(c.alias(n) for n, c in added.items()))
