"""Streams whose results depend on what did not happen: state per key with event-time timers.

A key's state is small and bounded: rows that are not final yet, the current spell, and one timer. Rows become final
when the watermark passes them, so the result does not depend on how the input is cut into batches or ordered within
the allowed delay. State is kept in RocksDB, survives a restart from the checkpoint, and is dropped by a timer of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tillmark.functions.scalars import DAY_MICROS

MILLI = 1000


class KeyTimer:
    """At most one timer a key, at the earliest moment asked for; no state of its own."""

    def __init__(self, handle: StatefulProcessorHandle):
        self.handle = handle

    def ask(self, micros: int, fired: int | None = None) -> None:
        """Wake at the first millisecond after `micros`; the timer that just fired is still listed and does not count."""
        wanted = micros // MILLI + 1
        held = [timer for timer in self.handle.listTimers() if timer != fired]
        if not held or wanted < min(held):
            for timer in held:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(wanted)


class QuietSpells(StatefulProcessor):
    """Alarms after a quiet spell, withdrawn when the key comes back; forgotten after a long one.

    A row counts when the watermark has passed it; the rows of a key then count in the order of their times.
    """

    def __init__(self, by: str, quiet: int, forget: int):
        self.by, self.quiet, self.forget = by, quiet, forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.pending = handle.getListState("pending", "at LONG")
        self.spell = handle.getValueState("spell", "last LONG, purchases LONG, alarmed BOOLEAN")
        self.timer = KeyTimer(handle)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        times = [row["at"] for row in rows]
        self.pending.appendList([(at,) for at in times])
        self.timer.ask(min(times))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs() * MILLI
        waiting = sorted(row[0] for row in self.pending.get()) if self.pending.exists() else []
        final = [at for at in waiting if at < now]
        last, purchases, alarmed = self.spell.get() if self.spell.exists() else (None, 0, False)

        def said(event: str, at: int) -> Row:
            return Row(**{self.by: key[0], "event": event, "last": last, "at": at, "purchases": purchases})

        for at in final:
            if last is not None and at - last > self.quiet:
                if not alarmed:
                    yield said("alarm", last + self.quiet)
                if at - last <= self.forget:
                    yield said("return", at)
                purchases = 0
            last, purchases, alarmed = at, purchases + 1, False
        if last is not None and not alarmed and last + self.quiet < now:
            yield said("alarm", last + self.quiet)
            alarmed = True
        left = waiting[len(final):]
        if final:
            self.pending.put([(at,) for at in left]) if left else self.pending.clear()
        if last is not None and last + self.forget < now:
            self.spell.clear()
            last = None
        elif last is not None:
            self.spell.update((last, purchases, alarmed))
        asked = left[:1] + ([last + (self.forget if alarmed else self.quiet)] if last is not None else [])
        if asked:
            self.timer.ask(min(asked), expiredTimerInfo.getExpiryTimeInMs())

    def close(self) -> None:
        pass


def quiet_alarms(stream: DataFrame, ts: str, by: str, days: int = 28, forget_days: int = 730, delay: str = "1 day") -> DataFrame:
    """(by, event, last_purchase, at, purchases): 'alarm' when a key was quiet for `days`, 'return' when it comes back.

    An alarm is due as soon as the watermark passes the last purchase by `days`, while the customer may still come back;
    a return withdraws it. `purchases` counts those of the spell that ended. A purchase exactly `days` later is no quiet
    spell. State is dropped `forget_days` after the last purchase; who comes back later starts anew, without a return.
    Rows without a key or time are left out; rows behind the watermark are dropped by Spark.
    """
    kind = stream.schema[by].dataType.simpleString()
    rows = stream.where(F.col(by).isNotNull() & F.col(ts).isNotNull()).withWatermark(ts, delay)
    rows = rows.select(by, ts, F.unix_micros(ts).alias("at"))
    found = rows.groupBy(by).transformWithState(
        QuietSpells(by, days * DAY_MICROS, forget_days * DAY_MICROS),
        f"`{by}` {kind}, event STRING, last LONG, at LONG, purchases LONG", "Append", "EventTime")
    return found.select(by, "event", F.timestamp_micros("last").alias("last_purchase"), F.timestamp_micros("at").alias("at"),
                        "purchases")


class Streaks(StatefulProcessor):
    """The last shock of every run of shocks on consecutive days; bars come in the order of their days."""

    def __init__(self, by: str, z: float, max_gap_days: int):
        self.by, self.z, self.gap = by, z, max_gap_days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.close_of = handle.getValueState("close", "close DOUBLE")
        self.shock = handle.getValueState("shock", "day LONG, move DOUBLE")
        self.timer = KeyTimer(handle)

    def found(self, key, day: int, move: float) -> Row:
        return Row(**{self.by: key[0], "day": day, "daily_return": move})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        before = self.close_of.get()[0] if self.close_of.exists() else None
        shock = self.shock.get() if self.shock.exists() else None
        for row in sorted(rows, key=lambda r: r["day"]):
            move = row["close"] / before - 1 if before and row["close"] is not None else None
            before = row["close"]
            if move is None or not row["std"] or abs((move - row["mean"]) / row["std"]) <= self.z:
                continue
            if shock is not None and row["day"] - shock[0] > self.gap:
                yield self.found(key, *shock)
            shock = (row["day"], move)
        if before is not None:
            self.close_of.update((before,))
        else:
            self.close_of.clear()
        if shock is not None:
            self.shock.update(shock)
            self.timer.ask(self.closes(shock[0]))

    def closes(self, day: int) -> int:
        """No bar can prolong the run any more when the days that may follow are over."""
        return (day + self.gap + 1) * DAY_MICROS

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        shock = self.shock.get() if self.shock.exists() else None
        if shock is None:
            return
        if self.closes(shock[0]) < timerValues.getCurrentWatermarkInMs() * MILLI:
            yield self.found(key, *shock)
            self.shock.clear()
        else:
            self.timer.ask(self.closes(shock[0]), expiredTimerInfo.getExpiryTimeInMs())

    def close(self) -> None:
        pass


def shock_streaks(stream: DataFrame, stats: DataFrame, ts: str, by: str, price: str, tiebreak: str, z: float = 2.0,
                  max_gap_days: int = 1, delay: str = "1 day") -> DataFrame:
    """(by, date, daily_return, shock_polarity): the last shock of each run of consecutive days, once no bar can prolong it.

    Two stateful steps: daily bars close when the watermark passes the day, and a state per entity holds the last close
    and the open run. `stats` has each entity's mean and std of the daily return, as fitted before on a batch. An entity
    without them has no shocks.
    """
    order = F.struct(ts, tiebreak)
    bars = stream.withWatermark(ts, delay).groupBy(F.window(ts, "1 day").alias("w"), by).agg(F.max_by(price, order).alias("close"))
    bars = bars.select(by, F.window_time("w").alias("closed_at"), F.unix_date(F.to_date("w.start")).cast("long").alias("day"), "close")
    bars = bars.join(stats.select(by, "mean", "std"), by)
    kind = stream.schema[by].dataType.simpleString()
    found = bars.groupBy(by).transformWithState(
        Streaks(by, z, max_gap_days), f"`{by}` {kind}, day LONG, daily_return DOUBLE", "Append", "EventTime")
    polarity = F.when(F.col("daily_return") > 0, "positive").when(F.col("daily_return") < 0, "negative").otherwise("neutral")
    return found.select(by, F.date_from_unix_date(F.col("day").cast("int")).alias("date"), "daily_return",
                        polarity.alias("shock_polarity"))
