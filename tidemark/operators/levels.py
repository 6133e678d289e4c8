"""Price levels: union of origins, crossings that fire once and re-arm, distances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.dates import in_daily_window, local_day_number, minute_of_day
from tidemark.functions.numbers import change_pct
from tidemark.operators.walk import SHAPE, Watched, walk
from tidemark.rules import REARM_MARGIN_PCT, Gate

SALTS = 16
BUCKETS = 64  # price buckets of a series, at most
BLOCK = 60  # ticks in a row of a run, at most 62
SETTLED = 4  # a level fires, re-arms and fires again within so many ticks on one side
LEVEL_TRIGGER = "inr_price_levels"
LEVEL_SEVERITY = 10.0  # a level someone set outranks a configured threshold
# A gate that lets everything pass.
FREE = Gate(tz="UTC", max_per_day=2**31 - 1, cooldown_hours=0, quiet_from=0, quiet_to=0)


def level_union(configured: DataFrame, added: DataFrame) -> DataFrame:
    """Levels of both origins; on an equal value the configured one wins."""
    cols = ["subscriber", "value", "direction", "note"]
    both = configured.select(*cols, F.lit(0).alias("_p"), F.lit("config").alias("origin")).unionByName(
        added.select(*cols, F.lit(1).alias("_p"), F.lit("added").alias("origin"))
    )
    pick = F.min_by(F.struct("direction", "note", "origin"), F.struct("_p", "direction", "note"))
    return both.groupBy("subscriber", "value").agg(pick.alias("l")).select("subscriber", "value", "l.*")


# A salt spreads a hot series, and leaves an equality where a series is given as a constant.
def _salt(column: str) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(SALTS)).cast("int")


def _every_salt() -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))


def price_edges(levels: DataFrame) -> DataFrame:
    """(series, edges): prices that part the levels of a series evenly.

    They come from a sketch of the levels, so that a price far from all others moves no edge, and
    a series has no more edges than levels.
    """
    shares = [k / BUCKETS for k in range(1, BUCKETS)]
    return levels.groupBy("series").agg(F.array_distinct(F.percentile_approx("level", shares)).alias("edges"))


def price_runs(ticks: DataFrame, levels: DataFrame) -> DataFrame:
    """(series, level, tick, until, price, follow): runs of ticks on one side of a level.

    The sides are: under the level by more than the margin, just under, at it, just over,
    over by more than the margin; while the price stays on one, a level acts alike. A run
    begins at the first tick of a series and wherever the price changes sides. Those ticks
    are found by an equality join on price buckets of the series: a tick lies in the
    buckets between the price before it and its own, a level in those of its margins, and the
    first tick in buckets below all others, over which the levels are dealt once more.
    `levels` holds distinct (series, level). `follow` has the ticks of a run after its first,
    until no level changes any more.
    """
    along = Window.partitionBy("series").orderBy("tick")
    priced = ticks.select(
        "series", "tick", F.col("value").alias("price"),
        F.lag("value").over(along).alias("before"),
        F.array(*[F.lead("tick", k).over(along) for k in range(1, SETTLED)]).alias("follow"),
    )
    edges = price_edges(levels).withColumn("_salt", _every_salt())
    place = lambda c: F.size(F.filter("edges", lambda e: e <= c))
    margin = F.abs("level") * F.lit(REARM_MARGIN_PCT) / F.lit(100.0)
    deal = -1 - _salt("level")
    banded = levels.withColumn("_salt", _salt("level")).join(edges, ["series", "_salt"]).select("series", "level", (F.col("level") - margin).alias("low"), (F.col("level") + margin).alias("high"), "edges")
    near = banded.select(
        "series", "level", "low", "high",
        F.posexplode(F.concat(F.array(deal), F.sequence(place(F.col("low")), place(F.col("high"))))).alias("_nth", "bucket"),
    )

    def side(price: Column) -> Column:
        return (
            F.when(price < F.col("low"), 0).when(price < F.col("level"), 1).when(price == F.col("level"), 2)
            .when(price <= F.col("high"), 3).otherwise(4)
        )

    through = F.sequence(place(F.least("price", "before")), place(F.greatest("price", "before")))
    met = F.when(F.col("before").isNull(), F.sequence(F.lit(-SALTS), F.lit(-1))).otherwise(through)
    moves = (
        priced.filter(F.col("before").isNull() | (F.col("price") != F.col("before")))
        .withColumn("_salt", _salt("tick"))
        .join(edges, ["series", "_salt"])
        .select("series", "tick", "price", "before", "follow", F.posexplode(met).alias("_at", "bucket"))
    )
    # Of the buckets both lie in, the first one counts.
    crosses = (F.col("_nth") == 1) | (F.col("_at") == 0)
    begun = near.join(moves, ["series", "bucket"]).filter(
        (F.col("bucket") < 0) | (crosses & (side(F.col("price")) != side(F.col("before"))))
    )
    by_level = Window.partitionBy("series", "level").orderBy("tick")
    runs = begun.select("series", "level", "tick", "price", "follow", F.lead("tick").over(by_level).alias("until"))
    own = F.filter("follow", lambda t: t.isNotNull() & (F.col("until").isNull() | (t < F.col("until"))))
    return runs.withColumn("follow", own)


def _by_day(runs: DataFrame) -> DataFrame:
    """One row for each (series, level, direction, day) with its runs."""
    return runs.groupBy(*SHAPE, "day").agg(F.collect_list(F.struct("tick", "price", "bits", "open")).alias("runs"))


def level_runs(ticks: DataFrame, levels: DataFrame, gate: Gate) -> Watched:
    """What the gate's walk needs of levels: who watches which, and the runs of each level by
    local day, cut into blocks of `BLOCK` ticks, their ticks as bits. A run in which a level
    can't fire is its first ticks alone, at which the level may re-arm.

    `levels`: subscriber, series, value, direction, origin. Runs depend on series, level
    and direction alone; no subscriber has a copy of its own.
    """
    width = gate.tick_minutes * 60
    named = levels.withColumnRenamed("value", "level")
    wanted = named.select("series", "level", "direction").distinct()
    runs = price_runs(ticks, wanted.select("series", "level").distinct()).join(wanted, ["series", "level"])
    fires = ((F.col("direction") != "below") & (F.col("price") >= F.col("level"))) | (
        (F.col("direction") != "above") & (F.col("price") <= F.col("level"))
    )
    block = lambda c: F.floor(c / (BLOCK * width)).cast("bigint")
    offset = ((F.col("tick") - block(F.col("tick")) * BLOCK * width) / width).cast("int")
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), offset)
    quiet = in_daily_window(minute_of_day(F.timestamp_seconds("tick"), gate.tz), gate.quiet_from, gate.quiet_to)
    grid = (
        ticks.select("series", "tick", bit.alias("bit"), quiet.alias("quiet"), local_day_number(F.col("tick"), gate.tz).alias("day"))
        .groupBy("series", block(F.col("tick")).alias("block"), "day")
        .agg(F.bit_or("bit").alias("bits"), F.coalesce(F.bit_or(F.when(~F.col("quiet"), F.col("bit"))), F.lit(0).cast("bigint")).alias("open"), F.max("tick").alias("newest"))
    )
    last = grid.groupBy("series").agg(F.max("block").alias("last_block")).withColumn("_salt", _every_salt())
    shape = [*SHAPE, "price"]
    able = (
        runs.filter(fires)
        .withColumn("_salt", _salt("level"))
        .join(last, ["series", "_salt"])
        .withColumn("block", F.explode(F.sequence(block(F.col("tick")), F.coalesce(block(F.col("until") - 1), F.col("last_block")))))
        .join(grid, ["series", "block"])
    )
    base = F.col("block") * BLOCK * width
    cut = lambda c: F.least(F.greatest((c - base) / width, F.lit(0)), F.lit(BLOCK)).cast("int")
    ones = lambda n: F.call_function("shiftleft", F.lit(-1).cast("bigint"), n)
    mask = F.bitwise_not(ones(cut(F.coalesce("until", F.lit(2**62))))).bitwiseAND(ones(cut(F.col("tick"))))
    able = able.select(
        *shape, "day", base.alias("tick"), F.col("bits").bitwiseAND(mask).alias("bits"), F.col("open").bitwiseAND(mask).alias("open")
    ).filter("bits <> 0")
    still = runs.filter(~fires).select(
        *shape, local_day_number(F.col("tick"), gate.tz).alias("day"), "tick", F.lit(1).cast("bigint").alias("bits"), F.lit(0).cast("bigint").alias("open")
    )
    holders = named.select(
        "subscriber", F.lit(LEVEL_TRIGGER).alias("trigger"), *SHAPE, F.lit(LEVEL_SEVERITY).alias("severity"),
        # Configured levels come before added ones, then by value.
        (F.when(F.col("origin") == "config", 0).otherwise(1) * F.lit(10**15) + F.round(F.col("level") * 10_000)).cast("bigint").alias("id"),
    )
    return Watched(holders, _by_day(able.unionByName(still)))


def _ungated(ticks: DataFrame, levels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(levels with a key, walk of each key): every distinct (series, level, direction) is
    walked once, over the first ticks of each run; later ones change nothing."""
    key = F.xxhash64("series", "level", "direction")
    named = levels.withColumnRenamed("value", "level").withColumn("_key", key)
    wanted = named.select("series", "level", "direction", "_key").distinct()
    runs = price_runs(ticks, wanted.select("series", "level").distinct()).join(wanted, ["series", "level"])
    one = F.lit(1).cast("bigint")
    looked = runs.select(*SHAPE, "price", F.explode(F.concat(F.array("tick"), "follow")).alias("tick"), one.alias("bits"), one.alias("open"))
    days = _by_day(looked.withColumn("day", local_day_number(F.col("tick"), FREE.tz)))
    holders = wanted.select(
        F.col("_key").alias("subscriber"), F.lit(LEVEL_TRIGGER).alias("trigger"), *SHAPE,
        F.lit(LEVEL_SEVERITY).alias("severity"), one.alias("id"), F.lit(0).cast("bigint").alias("cooldown"),
    )
    walked = walk(None, FREE.tz, FREE.max_per_day, watched=Watched(holders, days), told=False)
    return named, walked.withColumnRenamed("subscriber", "_key")


def level_crossings(ticks: DataFrame, levels: DataFrame) -> DataFrame:
    """Crossings of each level, without a gate.

    A level fires once, then stays silent until the price has retreated past the margin.
    `levels`: subscriber, series, value, direction.
    """
    named, walked = _ungated(ticks, levels)
    fired = walked.filter("what = 'fired'").select("_key", "series", "tick", F.col("direction").alias("side"))
    at = fired.join(ticks.select("series", "tick", F.col("value").alias("price")), ["series", "tick"])
    return at.join(named.select("subscriber", "level", "_key"), "_key").select(
        "subscriber", "series", "level", F.timestamp_seconds("tick").alias("ts"), "price", F.col("side").alias("direction")
    )


def levels_hit(ticks: DataFrame, levels: DataFrame) -> DataFrame:
    """(subscriber, series, level) that have fired and not re-armed since, on either side."""
    named, walked = _ungated(ticks, levels)
    hit = walked.filter("what = 'hit'").select("_key", "mask")
    return named.select("subscriber", "series", "level", "_key").join(hit, "_key").drop("_key")


def level_distance(levels: DataFrame, latest: DataFrame) -> DataFrame:
    """Percent from the latest price of the series to each level."""
    current = latest.select("series", F.col("value").alias("current"))
    return levels.join(current, "series", "left").withColumn(
        "distance_pct", change_pct(F.col("value"), F.col("current"))
    )
