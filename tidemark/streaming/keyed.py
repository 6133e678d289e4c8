"""The gate as one stateful operator, keyed by subscriber.

Candidates, prices and control commands of a subscriber meet in one keyed state, so levels and
mutes that someone sets act from the next tick on. Rows may come in any order: a tick is judged
by an event-time timer once the watermark has passed its end. Until then the state holds, for
each tick, the contenders of each trigger, the last price of each series and the commands;
afterwards only the day's count, the fires whose cooldown still runs, the levels with their
hit sides and the end of a mute. What has run out is removed, and a subscriber of whom nothing
is left has no state.

Spark commits state, timers and offsets of a batch together, so a restart goes on where the
last batch ended. Rows behind the watermark are dropped by Spark and counted in the progress of
the query; `gates.gate_batches` is the form that keeps late rows.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import reduce
from typing import Any

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidemark.functions.dates import in_daily_window, local_day_number, minute_of_day, tick_of
from tidemark.operators.gate import cooldown_column
from tidemark.operators.levels import LEVEL_SEVERITY, LEVEL_TRIGGER
from tidemark.operators.walk import _SIDE, level_move
from tidemark.rules import Gate

cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: kind is candidate, price, set, unset, mute or unmute; `stamp` is the time in microseconds.
ROWS = (
    "subscriber bigint, kind string, ts timestamp, stamp bigint, tick bigint, day int, quiet boolean, cooldown bigint, "
    "trigger string, id bigint, severity double, series string, price double, level double, direction string, "
    "origin string, until bigint"
)
JUDGED = "subscriber bigint, tick bigint, trigger string, id bigint, series string, level double, direction string, outcome string"
_COLUMNS = [c.split()[0] for c in ROWS.split(", ")]
_OUT = [c.split()[0] for c in JUDGED.split(", ")]


def keyed_state(spark: SparkSession) -> SparkSession:
    """Keyed state with timers needs the RocksDB state store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return spark


def _rows(source: DataFrame, gate: Gate, kind: Column, tick: Column, **more: Column) -> DataFrame:
    quiet = in_daily_window(minute_of_day(F.timestamp_seconds("tick"), gate.tz), gate.quiet_from, gate.quiet_to)
    trigger = more.pop("trigger", F.lit(LEVEL_TRIGGER))
    named = source.withColumns({"kind": kind, "tick": tick, "trigger": trigger, "stamp": F.unix_micros("ts"), **more})
    full = named.withColumns({"day": local_day_number(F.col("tick"), gate.tz), "quiet": quiet, "cooldown": cooldown_column(gate)})
    types = dict(c.split() for c in ROWS.split(", "))
    return full.select(*[(F.col(c) if c in full.columns else F.lit(None)).cast(types[c]).alias(c) for c in _COLUMNS])


def candidate_rows(candidates: DataFrame, gate: Gate) -> DataFrame:
    """Rows of (subscriber, trigger, ts, severity, id)."""
    return _rows(candidates, gate, F.lit("candidate"), tick_of(F.col("ts"), gate.tick_minutes), trigger=F.col("trigger"))


def price_rows(readings: DataFrame, watching: DataFrame, gate: Gate) -> DataFrame:
    """Rows of (series, ts, value, id), one for each subscriber of `watching` (subscriber, series).

    A subscriber gets a price once, however many levels they have on its series.
    """
    seen = readings.filter(F.col("value").isNotNull()).select("series", "ts", "id", F.col("value").alias("price"))
    each = seen.join(watching.select("subscriber", "series").distinct(), "series")
    return _rows(each, gate, F.lit("price"), tick_of(F.col("ts"), gate.tick_minutes))


def control_rows(commands: DataFrame, series: str, gate: Gate) -> DataFrame:
    """Rows of parsed commands (`control.parse`); levels are set on `series`.

    A command acts from the first tick that begins at its time or later.
    """
    width = gate.tick_minutes * 60
    tick = (F.ceil(F.unix_micros("ts") / F.lit(1e6 * width)) * width).cast("bigint")
    until = F.ceil((F.unix_micros("ts") + F.round(F.col("hours") * 3.6e9)) / F.lit(1e6)).cast("bigint")
    level = F.col("verb").isin("set", "unset") & F.col("value").isNotNull()
    mute = (F.col("verb") == "unmute") | ((F.col("verb") == "mute") & F.col("hours").isNotNull())
    return _rows(
        commands.filter(level | mute), gate, F.col("verb"), tick, id=F.col("seq"), series=F.lit(series),
        level=F.col("value"), origin=F.lit("added"), until=until,
    )


def level_rows(levels: DataFrame, since: Column, gate: Gate) -> DataFrame:
    """Configured levels (subscriber, series, value, direction, origin), set at one time."""
    timed = levels.withColumnsRenamed({"value": "level"}).withColumns({"ts": since, "id": F.lit(-1)})
    width = gate.tick_minutes * 60
    return _rows(timed, gate, F.lit("set"), (F.ceil(F.unix_micros("ts") / F.lit(1e6 * width)) * width).cast("bigint"))


def gate_stream(gate: Gate, lateness: str, *rows: DataFrame) -> DataFrame:
    """Judged contenders and level events of the streams of rows, as their ticks close.

    Of one (subscriber, tick, trigger) the worst candidate is a contender, or as many as a
    day's budget if the trigger has no cooldown; no other one can fire. A level event is
    told when it fires.
    """
    whole = reduce(DataFrame.unionByName, rows).withWatermark("ts", lateness)
    return whole.groupBy("subscriber").transformWithStateInPandas(
        statefulProcessor=KeyedGate(gate.max_per_day, gate.tick_minutes * 60, gate.enabled),
        outputStructType=JUDGED,
        outputMode="Append",
        timeMode="EventTime",
    )


class KeyedGate(StatefulProcessor):
    """State and timers of one subscriber at a time."""

    def __init__(self, max_per_day: int, width: int, enabled: bool = True) -> None:
        self.max_per_day, self.width, self.enabled = max_per_day, width, enabled

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        contender = "best array<struct<severity double, id bigint>>, cooldown bigint, day int, quiet boolean"
        self.contenders = handle.getMapState("contenders", "tick bigint, trigger string", contender)
        self.prices = handle.getMapState("prices", "tick bigint, series string", "stamp bigint, id bigint, price double, day int, quiet boolean, cooldown bigint")
        command = "kind string, series string, level double, direction string, origin string, until bigint"
        self.commands = handle.getMapState("commands", "tick bigint, stamp bigint, id bigint, nth int", command)
        self.levels = handle.getMapState("levels", "series string, level double", "direction string, origin string, mask int")
        self.last = handle.getMapState("last", "trigger string", "tick bigint, cooldown bigint")
        self.sent = handle.getValueState("sent", "day int, n int, tick bigint")
        self.muted = handle.getValueState("muted", "until bigint")

    def close(self) -> None:
        pass

    # Input: only what can still matter is kept of each tick.

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        ticks: set[int] = set()
        for frame in rows:
            best: dict[tuple, list] = {}
            newest: dict[tuple, tuple] = {}
            for r in frame[_COLUMNS].itertuples(index=False):
                tick = int(r.tick)
                ticks.add(tick)
                if r.kind == "candidate":
                    shown = best.setdefault((tick, r.trigger), [int(r.cooldown), int(r.day), bool(r.quiet), []])
                    shown[3].append((float(r.severity), int(r.id)))
                    if len(shown[3]) > 1024:
                        shown[3] = self._worst(shown[3], shown[0])
                elif r.kind == "price":
                    new = (int(r.stamp), int(r.id), float(r.price), int(r.day), bool(r.quiet), int(r.cooldown))
                    newest[(tick, r.series)] = max(new, newest.get((tick, r.series), new))
                else:
                    self._keep(tick, r)
            for at, (cooldown, day, quiet, found) in best.items():
                if self.contenders.containsKey(at):
                    found = found + [tuple(b) for b in self.contenders.getValue(at)[0]]
                self.contenders.updateValue(at, (self._worst(found, cooldown), cooldown, day, quiet))
            for at, new in newest.items():
                if not self.prices.containsKey(at) or tuple(self.prices.getValue(at))[:2] < new[:2]:
                    self.prices.updateValue(at, new)
        for tick in ticks:
            self.handle.registerTimer((tick + self.width) * 1000)
        return iter(())

    def _worst(self, found: list[tuple], cooldown: int) -> list[tuple]:
        return sorted(found, key=lambda b: (-b[0], b[1]))[: 1 if cooldown > 0 else max(1, self.max_per_day)]

    def _keep(self, tick: int, r: Any) -> None:
        row = (
            r.kind, r.series, float(r.level) if pd.notna(r.level) else None, r.direction, r.origin,
            int(r.until) if pd.notna(r.until) else None,
        )
        nth = 0
        # Commands without a number of their own that come at one time all count; the same one again does not.
        while self.commands.containsKey((tick, int(r.stamp), int(r.id), nth)):
            if tuple(self.commands.getValue((tick, int(r.stamp), int(r.id), nth))) == row:
                return
            nth += 1
        self.commands.updateValue((tick, int(r.stamp), int(r.id), nth), row)

    # Judgement: the ticks that have closed, in order.

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        until = timerValues.getCurrentWatermarkInMs() // 1000 - self.width
        due = lambda state: sorted(tuple(k) for k in state.keys() if k[0] <= until)
        contenders, prices, commands = due(self.contenders), due(self.prices), due(self.commands)
        ticks = sorted({k[0] for k in contenders + prices + commands})
        levels = {tuple(k): list(v) for k, v in self.levels.iterator()} if ticks else {}
        stored = {k: tuple(v) for k, v in levels.items()}
        last = {k[0]: tuple(v) for k, v in self.last.iterator()}
        day, sent, counted = tuple(self.sent.get()) if self.sent.exists() else (None, 0, 0)
        muted = self.muted.get()[0] if self.muted.exists() else 0
        out: list[tuple] = []
        at: dict[int, tuple[list, list, list]] = {t: ([], [], []) for t in ticks}
        for n, keys in enumerate((contenders, prices, commands)):
            for k in keys:
                at[k[0]][n].append(k)
        for tick in ticks:
            judged, moved, said = at[tick]
            for k in said:
                kind, series, level, direction, origin, end = self.commands.getValue(k)
                if kind == "set":
                    levels.setdefault((series, level), [direction, origin, 0])
                elif kind == "unset":
                    levels.pop((series, level), None)
                else:
                    muted = end if kind == "mute" else 0
            queue = []
            for k in judged:
                best, cooldown, today, quiet = self.contenders.getValue(k)
                queue += [(-b[0], b[1], "", k[1], None, 0.0, cooldown, today, quiet) for b in best]
            for k in moved:
                _, _, price, today, quiet, cooldown = self.prices.getValue(k)
                for (series, level), (direction, origin, _mask) in levels.items():
                    if series == k[1]:
                        ident = (0 if origin == "config" else 10**15) + int(level * 10_000 + 0.5)
                        queue.append((-LEVEL_SEVERITY, ident, series, LEVEL_TRIGGER, (level, direction), price, cooldown, today, quiet))
            for severity, ident, series, trigger, watched, price, cooldown, today, quiet in sorted(queue, key=lambda q: q[:3]):
                day, sent = (today, sent) if today == day else (today, 0)
                side = 0
                if watched is not None:
                    side, levels[series, watched[0]][2] = level_move(levels[series, watched[0]][2], price, *watched)
                    if not side:
                        continue
                before = last.get(trigger)
                outcome = (
                    "disabled" if not self.enabled else "muted" if tick < muted else "quiet" if quiet
                    else "cooldown" if before is not None and tick - before[0] < cooldown
                    else "budget" if sent >= self.max_per_day else "fired"
                )
                if outcome == "fired":
                    sent, counted, last[trigger] = sent + 1, tick, (tick, cooldown)
                if watched is None:
                    out.append((key[0], tick, trigger, ident, None, None, None, outcome))
                elif outcome == "fired":
                    levels[series, watched[0]][2] |= side
                    out.append((key[0], tick, trigger, ident, series, watched[0], _SIDE[side], outcome))
        for state, keys in ((self.contenders, contenders), (self.prices, prices), (self.commands, commands)):
            for k in keys:
                state.removeKey(k)
        self._store_levels(levels, stored)
        self._store_rest(until, last, (day, sent, counted), muted, bool(ticks))
        if out:
            yield pd.DataFrame(out, columns=_OUT).astype({"level": "float64"})

    def _store_levels(self, levels: dict, stored: dict) -> None:
        for k in stored.keys() - levels.keys():
            self.levels.removeKey(k)
        for k, v in levels.items():
            if stored.get(k) != tuple(v):
                self.levels.updateValue(k, tuple(v))

    def _store_rest(self, until: int, last: dict, sent: tuple, muted: int, changed: bool) -> None:
        """Keep what ticks after `until` can need, and come back when the last of it has run out."""
        wake = 0
        for trigger, (fired, cooldown) in last.items():
            if fired + cooldown > until:
                self.last.updateValue((trigger,), (fired, cooldown))
                wake = max(wake, fired + cooldown)
            elif self.last.containsKey((trigger,)):
                self.last.removeKey((trigger,))
        # A day is at most 25 hours long; by then its count is worth nothing.
        if sent[1] and sent[2] + 90_000 > until:
            self.sent.update(sent)
            wake = max(wake, sent[2] + 90_000)
        else:
            self.sent.clear()
        if muted > until:
            self.muted.update((muted,))
            wake = max(wake, muted)
        else:
            self.muted.clear()
        if changed and wake:
            self.handle.registerTimer((wake + self.width) * 1000)
