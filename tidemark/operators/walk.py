"""The one sequential step of the gate, as a pass over a sorted stream of rows.

Subscribers are dealt into `DEALS` groups, rows are sorted by group and local day, and each
task walks its rows once with the state of the current group's subscribers: alerts of the
day, last fire per trigger, and which sides of each (series, level) are hit. Only the rows
of one day are held. What a level does on a day is one row for each group that watches it,
not one for each subscriber: the runs of ticks on one side of it, with the ticks as bits. The
walker jumps to the ticks at which it could fire, and subscribers share what was found.
"""

from __future__ import annotations

import heapq
import sys
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.dates import local_day_number
from tidemark.rules import REARM_MARGIN_PCT

# Ship the walker with its task, so that executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ABOVE, BELOW = 1, 2
_SIDE = {ABOVE: "above", BELOW: "below"}
_IN = (
    "deal", "stage", "day", "subscriber", "tick", "trigger", "id", "severity", "cooldown", "until",
    "series", "level", "direction", "mask", "runs",
)
_OUT = (
    "what string, subscriber bigint, tick bigint, trigger string, id bigint, cooled bigint, "
    "series string, level double, direction string, mask int, reason string"
)
_TYPES = [
    ("what", pa.string()), ("subscriber", pa.int64()), ("tick", pa.int64()), ("trigger", pa.string()), ("id", pa.int64()),
    ("cooled", pa.int64()), ("series", pa.string()), ("level", pa.float64()), ("direction", pa.string()),
    ("mask", pa.int32()), ("reason", pa.string()),
]
DEALS = 512  # groups of subscribers; the state of one is in memory at a time
SHAPE = ["series", "level", "direction"]
#: Columns that some kinds of rows do not have.
_MORE = {
    "day": "int", "tick": "bigint", "trigger": "string", "id": "bigint", "severity": "double", "cooldown": "bigint",
    "until": "bigint", "series": "string", "level": "double", "direction": "string", "mask": "int",
    "runs": "array<struct<tick:bigint,price:double,bits:bigint,open:bigint>>",
}


class Watched(NamedTuple):
    """Levels as the walk takes them.

    `holders`: subscriber, trigger, series, level, direction, id, severity. `days`: series,
    level, direction, day, and `runs`, which do not overlap: class price, ticks as bits from
    `tick` on, and those outside the quiet hours.
    """

    holders: DataFrame
    days: DataFrame


def level_move(mask: int, price: float, level: float, direction: str) -> tuple[int, int]:
    """(side that would fire or 0, mask after re-arming).

    Re-arming clears both sides. Above is looked at first, and one event per level
    and tick is enough.
    """
    margin = level * REARM_MARGIN_PCT / 100.0
    if direction != "below":
        if price >= level:
            if not mask & ABOVE:
                return ABOVE, mask
        elif mask & ABOVE and price < level - margin:
            mask = 0
    if direction != "above":
        if price <= level:
            if not mask & BELOW:
                return BELOW, mask
        elif mask & BELOW and price > level + margin:
            mask = 0
    return 0, mask


def _next_bit(bits: int, base: int, width: int, since: int) -> int | None:
    """First tick of the bits that is not before `since`."""
    skip = max(0, -((base - since) // width)) if since > base else 0
    rest = bits >> skip
    return base + (skip + (rest & -rest).bit_length() - 1) * width if rest else None


class _Day:
    """What a level does on one day, for any mask it is met with."""

    def __init__(self, level: float, direction: str, runs: list[tuple], width: int, told: bool) -> None:
        self.level, self.direction, self.width, self.told = level, direction, width, told
        self.runs = sorted(runs, key=lambda r: _next_bit(r[2], r[0], width, r[0]))
        self.found: dict[tuple, tuple] = {}
        self.ends: dict[tuple, int] = {}

    def move(self, n: int, mask: int) -> tuple[int, int]:
        return level_move(mask, self.runs[n][1], self.level, self.direction)

    def after(self, n: int, since: int, open_: bool = False) -> int | None:
        """First tick of a run, or first outside the quiet hours, that is not before `since`."""
        base, _, bits, free = self.runs[n]
        return _next_bit(free if open_ else bits, base, self.width, since)

    def seek(self, n: int, start: int, mask: int, since: int) -> tuple[int, int | None, int]:
        """(run, tick, mask) where the level next has to be looked at, from tick `start` of run n on.

        That is where it would fire. If nobody is told what is held back, ticks before `since`, at
        which it would be refused, and quiet ones count for re-arming alone.
        """
        key = (n, start, mask, max(start, since))
        if key not in self.found:
            self.found[key] = self._seek(*key)
        return self.found[key]

    def _seek(self, n: int, start: int, mask: int, since: int) -> tuple[int, int | None, int]:
        while n < len(self.runs):
            tick = self.after(n, start)
            while tick is not None:
                side, now = self.move(n, mask)
                if side:
                    tick = tick if self.told else self.after(n, max(tick, since), True)
                    if tick is not None:
                        return n, tick, now
                # Re-armed, it may fire at the next tick; else nothing more can happen while
                # the price stays where it is.
                again = tick is not None and now != mask
                mask = now
                tick = self.after(n, tick + 1) if again else None
            n += 1
        return n, None, mask

    def settled(self, n: int, mask: int) -> int:
        """The mask when the day ends, if nothing fires from run n on."""
        key = (n, mask)
        if key not in self.ends:
            for k in range(n, len(self.runs)):
                mask = self.move(k, mask)[1]
            self.ends[key] = mask
        return self.ends[key]


class _Subscriber:
    """What the walk knows of one subscriber."""

    def __init__(self, name: int, max_per_day: int, told: bool) -> None:
        self.name, self.max_per_day, self.told = name, max_per_day, told
        self.sent: dict[int, int] = {}
        self.last: dict[str, int] = {}
        self.hits: dict[tuple[str, float], int] = {}
        self.holds: list[tuple] = []
        self.sharing: set[tuple[str, float]] = set()
        self.muted = 0

    def recall(self, day: int, tick: int, trigger: str, series: str, level: float, mask: int | None) -> None:
        """A fire or a hit of an earlier run."""
        if mask is not None:
            self.hits[series, level] = self.hits.get((series, level), 0) | mask
        else:
            self.sent[day] = self.sent.get(day, 0) + 1
            self.last[trigger] = max(tick, self.last.get(trigger, tick))

    def hold(self, shape: tuple[str, float, str], trigger: str, ident: int, severity: float, cooldown: int) -> None:
        """A level it watches. Two of one price share their mask."""
        if any(h[0][:2] == shape[:2] for h in self.holds):
            self.sharing.add(shape[:2])
        self.holds.append((shape, trigger, ident, severity, cooldown))

    def refused(self, day: int, tick: int, trigger: str, cooldown: int) -> str | None:
        if tick < self.muted:
            return "muted"
        before = self.last.get(trigger)
        if before is not None and tick - before < cooldown:
            return "cooldown"
        return "budget" if self.sent.get(day, 0) >= self.max_per_day else None

    def refused_until(self, trigger: str, cooldown: int) -> int:
        """No tick before it passes mutes and cooldown."""
        before = self.last.get(trigger)
        return self.muted if before is None else max(self.muted, before + cooldown)

    def fire(self, day: int, tick: int, trigger: str) -> None:
        self.sent[day] = self.sent.get(day, 0) + 1
        self.last[trigger] = tick

    def next_look(self, plan: _Day, shape: tuple[str, float, str], n: int, start: int, since: int) -> tuple[int, int | None]:
        """(run, tick) at which a level is looked at next; its mask is moved on to there."""
        key = shape[:2]
        if key not in self.sharing:
            n, tick, self.hits[key] = plan.seek(n, start, self.hits.get(key, 0), since)
            return n, tick
        for k in range(n, len(plan.runs)):  # the other level of this price may move the mask at any tick
            tick = plan.after(k, start)
            if tick is not None:
                return k, tick
        return len(plan.runs), None

    def walk(self, day: int, rows: list[tuple], plans: dict[tuple, _Day]) -> list[tuple]:
        """Fires, and levels held back, of one day in (tick, severity, id) order."""
        out: list[tuple] = []
        queue: list[tuple] = []
        for tick, trigger, ident, severity, cooldown, until in rows:
            if until is not None:
                queue.append((tick, 0, -until, 0, "", 0, 0, None))
            else:
                queue.append((tick, 1, -severity, ident, "", len(queue), 0, (trigger, cooldown)))
        for k, (shape, trigger, ident, severity, cooldown) in enumerate(self.holds):
            plan = plans.get(shape)
            if plan is not None:
                n, tick = self.next_look(plan, shape, 0, plan.runs[0][0], self.refused_until(trigger, cooldown))
                if tick is not None:
                    queue.append((tick, 1, -severity, ident, shape[0], k, n, plan))
        heapq.heapify(queue)
        told: set[tuple[int, int]] = set()
        while queue:
            tick, kind, order, ident, series, k, n, what = heapq.heappop(queue)
            if kind == 0:
                self.muted = max(self.muted, -order)
                continue
            if isinstance(what, tuple):
                trigger, cooldown = what
                if self.refused(day, tick, trigger, cooldown) is None:
                    self.fire(day, tick, trigger)
                    out.append(("fired", self.name, tick, trigger, ident, tick + cooldown, None, None, None, None, None))
                continue
            shape, trigger, _, _, cooldown = self.holds[k]
            key = shape[:2]
            side, mask = what.move(n, self.hits.get(key, 0))
            self.hits[key] = mask
            look, start = n, tick + 1
            if side:
                quiet = what.after(n, tick, True) != tick
                reason = "quiet" if quiet else self.refused(day, tick, trigger, cooldown)
                if reason is None:
                    self.fire(day, tick, trigger)
                    self.hits[key] = mask | side
                    out.append(("fired", self.name, tick, trigger, ident, tick + cooldown, series, key[1], _SIDE[side], None, None))
                elif reason == "budget" and not self.told and key not in self.sharing:
                    # Nothing fires any more today; the price may still re-arm the level.
                    self.hits[key] = what.settled(n, mask)
                    continue
                elif self.told:
                    if (k, n) not in told:
                        told.add((k, n))
                        out.append(("held", self.name, tick, trigger, ident, None, series, key[1], _SIDE[side], None, reason))
                    if key not in self.sharing:
                        # It stays as it is until the run ends: only a tick at which it passes matters.
                        since = max(start, self.refused_until(trigger, cooldown))
                        again = None if reason == "budget" else what.after(n, since, True)
                        if again is not None:
                            heapq.heappush(queue, (again, kind, order, ident, series, k, n, what))
                            continue
                        look, start = n + 1, 0
            look, again = self.next_look(what, shape, look, start, self.refused_until(trigger, cooldown))
            if again is not None:
                heapq.heappush(queue, (again, kind, order, ident, series, k, look, what))
        self.sent.pop(day, None)
        return out

    def left(self) -> list[tuple]:
        """Levels that are hit when the rows end."""
        return [
            ("hit", self.name, None, None, None, None, series, level, None, mask, None)
            for (series, level), mask in self.hits.items()
            if mask
        ]


class _Group:
    """The subscribers of one deal, and the rows of the day that is being read."""

    def __init__(self, deal: int, max_per_day: int, width: int, told: bool) -> None:
        self.deal, self.max_per_day, self.width, self.told = deal, max_per_day, width, told
        self.people: dict[int, _Subscriber] = {}
        self.day: int | None = None
        self.rows: dict[int, list[tuple]] = {}
        self.plans: dict[tuple, _Day] = {}

    def take(self, row: tuple) -> list[tuple]:
        """Read a row; what the day before it came to, if it begins a new one."""
        _, stage, day, name, tick, trigger, ident, severity, cooldown, until, series, level, direction, mask, runs = row
        if stage == 0:
            who = self._of(name)
            if direction is not None:
                who.hold((series, level, direction), trigger, ident, severity, cooldown)
            else:
                who.recall(day, tick, trigger, series, level, mask)
            return []
        out = self.close() if day != self.day else []
        self.day = day
        if runs is not None:
            self.plans[series, level, direction] = _Day(level, direction, runs, self.width, self.told)
        else:
            self._of(name)
            self.rows.setdefault(name, []).append((tick, trigger, ident, severity, cooldown, until))
        return out

    def _of(self, name: int) -> _Subscriber:
        if name not in self.people:
            self.people[name] = _Subscriber(name, self.max_per_day, self.told)
        return self.people[name]

    def close(self) -> list[tuple]:
        """Walk the day."""
        out: list[tuple] = []
        for name, who in self.people.items():
            rows = self.rows.get(name, ())
            if rows or self.plans and who.holds:
                out += who.walk(self.day, rows, self.plans)
        self.rows, self.plans = {}, {}
        return out

    def left(self) -> list[tuple]:
        return [row for who in self.people.values() for row in who.left()]


def _values(column: pa.Array) -> list:
    """`to_pylist` by whole columns; a struct becomes a tuple."""
    kind = column.type
    if pa.types.is_list(kind):
        cells, sizes = _values(column.flatten()), column.value_lengths()
        ends = np.cumsum(sizes.fill_null(0).to_numpy()).tolist()
        return [None if n is None else cells[end - n : end] for n, end in zip(_values(sizes), ends, strict=True)]
    if pa.types.is_struct(kind):
        return list(zip(*(_values(c) for c in column.flatten()), strict=True))
    if pa.types.is_string(kind) or pa.types.is_large_string(kind):
        coded = column.dictionary_encode()
        names = [*coded.dictionary.to_pylist(), None]
        return [names[k] for k in coded.indices.fill_null(-1).to_numpy().tolist()]
    values = column.fill_null(0).to_numpy().astype(object)
    values[column.is_null().to_numpy(zero_copy_only=False)] = None
    return values.tolist()


def _walker(max_per_day: int, width: int, told: bool = True) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: _Group | None = None
        for batch in batches:
            out: list[tuple] = []
            for row in zip(*(_values(batch.column(c)) for c in _IN), strict=True):
                if group is None or row[0] != group.deal:
                    if group is not None:
                        out += group.close() + group.left()
                    group = _Group(row[0], max_per_day, width, told)
                out += group.take(row)
            yield _batch(out)
        if group is not None:
            yield _batch(group.close() + group.left())

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in _TYPES]
    arrays = [pa.array(list(c), t) for c, (_n, t) in zip(columns, _TYPES, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, [n for n, _t in _TYPES])


def walk(
    rows: DataFrame | None,
    tz: str,
    max_per_day: int,
    tick_minutes: int = 30,
    prior: DataFrame | None = None,
    mutes: DataFrame | None = None,
    prior_hits: DataFrame | None = None,
    watched: Watched | None = None,
    told: bool = True,
) -> DataFrame:
    """Fires, levels held back, and levels left hit, walked in (tick, severity, id) order.

    Rows: subscriber, tick, trigger, id, severity, cooldown. `watched` has levels, its holders
    with their cooldown. `prior` fires (subscriber, tick, trigger) and `prior_hits`
    (subscriber, series, level, mask) set the state. A mute is a row of the stream too:
    from its start on, ticks before its end are muted. Unless `told`, levels held back are
    not listed, which saves looking at every one.
    """
    dealt = F.pmod(F.xxhash64("subscriber"), F.lit(DEALS)).cast("int")
    parts: list[DataFrame] = []

    def add(more: DataFrame, stage: int) -> None:
        parts.append(more.withColumns({"deal": dealt, "stage": F.lit(stage)}))

    if rows is not None:
        add(rows.select("subscriber", "tick", "trigger", "id", "severity", "cooldown"), 1)
    if prior is not None:
        add(prior.select("subscriber", "tick", "trigger"), 0)
    if prior_hits is not None:
        add(prior_hits.select("subscriber", "series", "level", F.col("mask").cast("int").alias("mask")), 0)
    if mutes is not None:
        seconds = lambda c: F.ceil(F.unix_micros(c) / F.lit(1e6)).cast("bigint")
        add(mutes.select("subscriber", seconds("from_ts").alias("tick"), seconds("until_ts").alias("until")), 1)
    if watched is not None:
        add(watched.holders.select("subscriber", "trigger", "id", "severity", "cooldown", *SHAPE), 0)
        groups = watched.holders.select(dealt.alias("deal"), *SHAPE).distinct()
        parts.append(groups.join(watched.days, SHAPE).select("deal", F.lit(1).alias("stage"), "day", *SHAPE, "runs"))
    stream = parts[0]
    for more in parts[1:]:
        stream = stream.unionByName(more, allowMissingColumns=True)
    stream = stream.withColumns({n: F.lit(None).cast(t) for n, t in _MORE.items() if n not in stream.columns})
    # A group has few bytes for the work it makes, so small partitions are not to be merged.
    parallel = int(stream.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = (
        stream.withColumn("day", F.coalesce("day", local_day_number(F.col("tick"), tz)))
        .repartition(min(DEALS, parallel), "deal")
        .sortWithinPartitions("deal", "stage", "day")
    )
    return ordered.select(*_IN).mapInArrow(_walker(max_per_day, tick_minutes * 60, told), _OUT)
