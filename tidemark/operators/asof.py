"""As-of work that survives a hot series.

A plain window per series would put a third of all rows into one task when one
series holds them. Here the rows of a series are cut into time buckets, each bucket
is one window group, and a small table with one row per (series, bucket) carries the
last value across the cut. A bucket is a UTC day; a day in which one series has more than
`ROWS_PER_BUCKET` rows is cut finer for this series alone, so that neither its other days
nor other series get more buckets than they need.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.dates import shift_hours

ROWS_PER_BUCKET = 2_000_000
_HOUR = 3_600_000_000  # microseconds
_DAY = 24 * _HOUR


def busy_days(df: DataFrame, keys: Sequence[str], ts: str, rows: int = ROWS_PER_BUCKET) -> DataFrame:
    """(keys, _day, _width): days in which a key has more than `rows` rows, and how fine to cut them.

    The width is such that the day's busiest hour, if evenly filled, gives `rows` rows a bucket.
    Counting combines on the map side and reads only the key and time columns. The result has at most
    one row for each `rows` rows of the input: some 500,000 for 10^12 readings, or 20 MB, so it
    is broadcast.
    """
    per_hour = (
        df.select(*keys, F.floor(F.unix_micros(ts) / F.lit(_HOUR)).alias("_hour"))
        .groupBy(*keys, "_hour")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    per_day = per_hour.groupBy(*keys, F.floor(F.col("_hour") / 24).alias("_day")).agg(
        F.sum("_n").alias("_rows"), F.max("_n").alias("_most")
    )
    width = F.least(F.lit(float(_DAY)), F.floor(F.lit(float(_HOUR) * rows) / F.col("_most")))
    return per_day.filter(F.col("_rows") > rows).select(*keys, "_day", F.greatest(F.lit(1.0), width).cast("bigint").alias("_width"))


def cut_in_buckets(df: DataFrame, keys: Sequence[str], ts: str, busy: DataFrame) -> DataFrame:
    """Add `_bucket`, the start of each row's bucket in microseconds."""
    at = F.unix_micros(ts)
    daily = df.withColumn("_day", F.floor(at / F.lit(_DAY)))
    begin, width = F.col("_day") * F.lit(_DAY), F.coalesce("_width", F.lit(_DAY))
    bucket = begin + F.floor((at - begin) / width) * width
    return daily.join(F.broadcast(busy), [*keys, "_day"], "left").select(*df.columns, bucket.alias("_bucket"))


def carry_forward(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    ties: Sequence[str],
    last: Mapping[str, str],
    first: Mapping[str, str] | None = None,
    busy: DataFrame | None = None,
) -> DataFrame:
    """Last non-null value of each column at or before every row, in (ts, ties) order.

    `last` maps output names to source columns. `first` does the same for the
    earliest non-null value of the key over all time. `ties` must make the order
    total. Result columns are added; rows are kept as they are. `busy` is what `busy_days`
    gives for the rows, if they were not counted here. Without keys, all days stay whole.
    """
    first = first or {}
    if keys:
        cut = cut_in_buckets(df, keys, ts, busy_days(df, keys, ts) if busy is None else busy)
    else:
        cut = df.withColumn("_bucket", F.floor(F.unix_micros(ts) / F.lit(_DAY)))
    order = F.struct(F.col(ts), *[F.col(t) for t in ties])

    in_bucket = (
        Window.partitionBy(*keys, "_bucket")
        .orderBy(ts, *ties)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    local = cut.select(
        "*", *[F.last(src, ignorenulls=True).over(in_bucket).alias(f"_in_{o}") for o, src in last.items()]
    )

    seen = [
        F.max_by(src, F.when(F.col(src).isNotNull(), order)).alias(f"_end_{o}") for o, src in last.items()
    ] + [
        F.min_by(src, F.when(F.col(src).isNotNull(), order)).alias(f"_min_{o}") for o, src in first.items()
    ]
    per_bucket = cut.groupBy(*keys, "_bucket").agg(*seen)
    along = Window.partitionBy(*keys).orderBy("_bucket")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    whole = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    carried = per_bucket.select(
        *keys,
        "_bucket",
        *[F.last(f"_end_{o}", ignorenulls=True).over(before).alias(f"_pre_{o}") for o in last],
        *[F.first(f"_min_{o}", ignorenulls=True).over(whole).alias(f"_all_{o}") for o in first],
    )
    joined = local.join(carried, [*keys, "_bucket"], "left")
    return joined.select(
        *df.columns,
        *[F.coalesce(f"_in_{o}", f"_pre_{o}").alias(o) for o in last],
        *[F.col(f"_all_{o}").alias(o) for o in first],
    )


def as_of(
    probes: DataFrame,
    data: DataFrame,
    keys: Sequence[str],
    probe_ts: str,
    data_ts: str,
    values: Sequence[str],
    tie: str,
    hit: str = "hit",
    first: str | None = None,
    busy: DataFrame | None = None,
) -> DataFrame:
    """Latest data row at or before each probe, as a struct column `hit`.

    Probes and data are stacked and walked in time order, data first at equal times.
    With `first`, the key's earliest data row comes along as a second struct.
    """
    payload = F.struct(*[F.col(v) for v in values])
    stacked = data.select(
        *keys,
        F.col(data_ts).alias("_t"),
        F.lit(0).alias("_kind"),
        F.col(tie).cast("bigint").alias("_tie"),
        payload.alias("_data"),
        F.lit(None).cast(_struct_type(probes)).alias("_probe"),
    ).unionByName(
        probes.select(
            *keys,
            F.col(probe_ts).alias("_t"),
            F.lit(1).alias("_kind"),
            F.lit(0).cast("bigint").alias("_tie"),
            F.lit(None).cast(_struct_type(data.select(*values))).alias("_data"),
            F.struct(*[F.col(c) for c in probes.columns]).alias("_probe"),
        )
    )
    busy = busy_days(data, keys, data_ts) if busy is None else busy
    walked = carry_forward(
        stacked, keys, "_t", ["_kind", "_tie"], {hit: "_data"}, {first: "_data"} if first else None, busy
    )
    return walked.filter(F.col("_kind") == 1).select(
        "_probe.*", hit, *([first] if first else [])
    )


def _struct_type(df: DataFrame) -> str:
    return df.schema.simpleString()


def window_baseline(probes: DataFrame, readings: DataFrame, busy: DataFrame | None = None) -> DataFrame:
    """Comparison point of a rolling window that ends at each probe.

    Probes carry `series`, `ts` and `window_hours`. The baseline is the last reading
    at or before the window start; where history does not reach back so far, it is
    the oldest reading, which understates a move rather than inventing one. Adds
    `baseline` (value, ts, id), null only for a series without readings.
    """
    data = readings.filter(F.col("value").isNotNull())
    cut = probes.withColumn("_cutoff", shift_hours(F.col("ts"), -F.col("window_hours")))
    walked = as_of(
        cut, data, ["series"], "_cutoff", "ts", ["value", "ts", "id"], "id", "_hit", "_oldest", busy
    )
    return walked.withColumn("baseline", F.coalesce("_hit", "_oldest")).drop(
        "_hit", "_oldest", "_cutoff"
    )


def rolling_baseline(readings: DataFrame, windows: str, busy: DataFrame | None = None) -> DataFrame:
    """The baseline of every reading for each of its windows, from one scan.

    `windows` names an array column of structs with `window_hours`; its fields and the reading's
    own columns come back beside `baseline`. Same result as `window_baseline` with the
    readings as probes, but each reading is read once and turned into its data row and
    its probes on the spot.
    """
    data = readings.filter(F.col("value").isNotNull()).withColumnRenamed(windows, "_w")
    point = F.struct("value", "ts", "id")
    own = [F.col(c) for c in readings.columns if c != windows]
    fields = data.schema["_w"].dataType.elementType.names

    def probe(w: Column) -> Column:
        return F.struct(*own, *[w[f].alias(f) for f in fields])

    def entry(t: Column, kind: int, tie: Column, data_part: Column, probe_part: Column) -> Column:
        return F.struct(
            t.alias("_t"),
            F.lit(kind).alias("_kind"),
            tie.cast("bigint").alias("_tie"),
            data_part.alias("_data"),
            probe_part.alias("_probe"),
        )

    no_point = F.when(F.lit(False), point)
    no_probe = F.when(F.lit(False), probe(F.get("_w", F.lit(0))))
    rows = F.concat(
        F.array(entry(F.col("ts"), 0, F.col("id"), point, no_probe)),
        F.transform(
            "_w",
            lambda w: entry(shift_hours(F.col("ts"), -w["window_hours"]), 1, F.lit(0), no_point, probe(w)),
        ),
    )
    stacked = data.select("series", F.inline(rows))
    busy = busy_days(data, ["series"], "ts") if busy is None else busy
    walked = carry_forward(
        stacked, ["series"], "_t", ["_kind", "_tie"], {"_hit": "_data"}, {"_oldest": "_data"}, busy
    )
    return walked.filter(F.col("_kind") == 1).select(
        "_probe.*", F.coalesce("_hit", "_oldest").alias("baseline")
    )
