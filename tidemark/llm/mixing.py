"""Mix sources to target weights by capped water-filling, then sample repetitions.

Sources in code point order, null last, have the weights 1, 2, 3, repeating. They share
all words in proportion; a source stops at `epochs` times its own size and what it cannot
take is shared again among the others by weight, until none is above its cap. A share is
kept as two whole numbers (words left, weight left), so no rounding decides a clamp.

Each document is then taken whole as often as the target holds the source whole. The rest
is a seeded sample: documents in the order of a hash of seed and id are taken once more
until the rest is used up, and the document on the boundary gives only the words still
missing. A source's words taken are thus its target rounded to whole words.

Nulls: a null text has size 0, a null source is a source, a null id hashes as its own
value. Repeated rows each count. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import n_words, table

EPOCHS = 3
SEED = "mix-1"
WEIGHTS = 3


def source_weights(sized: DataFrame) -> DataFrame:
    """(source, source_size, weight), the weight from the rank in code point order.

    The rank is counted inside range partitions and shifted by the partitions before, so
    no task sees all sources.
    """
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ordered = sizes.repartitionByRange(F.col("source").asc_nulls_last())
    ordered = table(ordered.withColumn("part", F.spark_partition_id()), "sources")
    # One row for each partition, so at most as many as there are shuffle partitions.
    before = ordered.groupBy("part").agg(F.count("*").alias("n"))
    before = before.select(
        "part",
        F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(
            "before"
        ),
    )
    place = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last()))
    ranked = ordered.withColumn("place", place).join(before, "part")
    weight = (F.pmod(F.col("place") + F.col("before") - 1, F.lit(WEIGHTS)) + 1).cast("long")
    return ranked.select("source", "source_size", weight.alias("weight"))


def water_fill(sources: DataFrame, epochs: int = EPOCHS) -> DataFrame:
    """Add target: share by weight of all words, none above `epochs` times its size.

    Each round is one aggregate over the sources; only two totals reach the driver.
    """
    cap = F.col("source_size") * epochs
    big = lambda c: c.cast("decimal(19,0)")

    def clamped(left: int, weight: int) -> Column:
        return big(cap) * big(F.lit(weight)) <= big(F.col("weight")) * big(F.lit(left))

    total = sources.agg(F.sum("source_size").alias("left"), F.sum("weight").alias("weight")).first()
    everything, left, weight = total.left or 0, total.left or 0, total.weight or 0
    while weight:
        full = clamped(left, weight)
        now = sources.agg(
            F.sum(F.when(full, cap)).alias("used"),
            F.sum(F.when(~full, F.col("weight"))).alias("weight"),
        ).first()
        after = (everything - (now.used or 0), now.weight or 0)
        if after in ((left, weight), (0, 0)):
            left, weight = after
            break
        left, weight = after
    if not weight:  # no words at all, or every source at its cap
        return sources.withColumn("target", cap.cast("double"))
    share = (F.col("weight") * F.lit(left)).cast("double") / F.lit(float(weight))
    return sources.withColumn("target", F.when(clamped(left, weight), cap.cast("double")).otherwise(share))


def mix(docs: DataFrame, epochs: int = EPOCHS, seed: str = SEED) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken): words taken of each document."""
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    sized = table(
        docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), order.alias("order")).withColumn(
            "slot", F.conv(F.substring("order", 1, 4), 16, 10).cast("int")
        ),
        "sized",
    )
    goal = F.least(F.floor(F.col("target") + 0.5), F.col("source_size") * epochs).cast("long")
    size = F.greatest(F.col("source_size"), F.lit(1))
    plan = table(
        water_fill(table(source_weights(sized), "weights"), epochs)
        .withColumn("goal", goal)
        .withColumn("whole", F.floor(F.col("goal") / size).cast("long"))
        .withColumn("rest", F.col("goal") - F.col("whole") * F.col("source_size"))
        .select("source", "source_size", "target", "whole", "rest"),
        "plan",
    )
    # The slot in which the sampled words of a source run out, and the words before it.
    up_to = Window.partitionBy("source").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = (
        sized.groupBy("source", "slot")
        .agg(F.sum("size").alias("words"))
        .withColumn("before", F.coalesce(F.sum("words").over(up_to), F.lit(0)))
    )
    last = (
        slots.join(plan, slots.source.eqNullSafe(plan.source))
        .filter("before <= rest and rest < before + words")
        .select(slots.source, F.col("slot").alias("last_slot"), F.col("before").alias("slot_before"))
    )
    plan = plan.join(last, plan.source.eqNullSafe(last.source), "left").select(
        plan["*"], F.coalesce("last_slot", F.lit(1 << 16)).alias("last_slot"), "slot_before"
    )
    # Written, so that its size is known: small plans are broadcast and a hot source stays in its tasks.
    plan = table(plan, "plan")
    planned = sized.join(plan, sized.source.eqNullSafe(plan.source)).drop(plan.source)
    in_slot = Window.partitionBy("source", "slot").orderBy("order", "doc_id", "size")
    sampled = (
        planned.filter("slot = last_slot")
        .withColumn("before", F.coalesce(F.sum("size").over(in_slot.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn(
            "extra",
            F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("slot_before") - F.col("before"))),
        )
        .drop("before")
    )
    whole = planned.filter("slot <> last_slot").withColumn(
        "extra", F.when(F.col("slot") < F.col("last_slot"), F.col("size")).otherwise(F.lit(0))
    )
    taken = (F.col("whole") * F.col("size") + F.col("extra")).cast("long")
    return whole.unionByName(sampled).select(
        "doc_id", "source", "size", "source_size", "target", taken.alias("taken")
    )
