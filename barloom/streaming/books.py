"""Alert books: keyed state with event-time order, timers and an end.

A key's ticks wait in its state until the watermark passes them, so triggers may bring them in any order. Recommendations
come as initial state and end with their validity: a timer resolves what is still open and drops all state of the
recommendation. Ticks enter the state chunk by chunk; a timer handles those that are due.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from barloom.streaming.streams import ZONES, zone_step

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BOOK = "code long, rec long, zone string, event_id long, ts timestamp, price double, status string"

def stateful_session(spark: SparkSession) -> SparkSession:
    """A session of its own with the state store that timers and maps need; the caller's settings stay as they are."""
    own = spark.newSession()
    for name in ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions"):
        if (value := spark.conf.get(name, None)) is not None:
            own.conf.set(name, value)
    own.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return own


class ZoneBook(StatefulProcessor):
    """All recommendations and zones of one instrument."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us long, event_id long, price double")
        self.recs = handle.getMapState("recs", "rec long", "start long, stop long, " + ", ".join(f"{z} double" for z in ZONES))
        self.zones = handle.getMapState("zones", "rec long, zone string", "last double, sent double, open boolean")
        self.due = handle.getValueState("due", "ms long")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues: TimerValues) -> None:
        for r in initialState.itertuples():
            self.recs.updateValue((int(r.rec),), (int(r.start), int(r.stop), *(float(getattr(r, z)) for z in ZONES)))
        self._wait_for(min(int(s) for s in initialState["stop"]))

    def _wait_for(self, ms: int) -> None:
        """One timer a key, for the earliest tick or end of a recommendation."""
        have = self.due.get()[0] if self.due.exists() else None
        if have is None or ms < have:
            if have is not None:
                self.handle.deleteTimer(have)
            self.handle.registerTimer(ms)
            self.due.update((ms,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        if not self.recs.exists():
            return iter(())
        earliest = None
        for chunk in rows:
            us = chunk["ts"].astype("datetime64[us]").astype("int64")
            ticks = list(zip(us.tolist(), chunk["event_id"].tolist(), chunk["price"].tolist(), strict=True))
            self.waiting.appendList(ticks)
            first = min(ticks)[0]
            earliest = first if earliest is None else min(earliest, first)
        if earliest is not None:
            self._wait_for(earliest // 1000)
        return iter(())

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        ticks = sorted(self.waiting.get())
        ready = [t for t in ticks if t[0] // 1000 <= mark]
        rest = ticks[len(ready) :]
        recs = {k[0]: v for k, v in self.recs.iterator()}
        zones = {tuple(k): tuple(v) for k, v in self.zones.iterator()}
        out = list(self._run(key[0], ready, recs, zones, mark))
        live = {r for r, v in recs.items() if v[1] > mark}
        for rec in set(recs) - live:
            self.recs.removeKey((rec,))
        for (rec, zone), state in zones.items():
            if rec in live:
                self.zones.updateValue((rec, zone), state)
            elif self.zones.containsKey((rec, zone)):
                self.zones.removeKey((rec, zone))
        self.due.clear()
        if live:
            self.waiting.put(rest) if rest else self.waiting.clear()
            self._wait_for(min([*(t[0] // 1000 for t in rest[:1]), *(recs[r][1] for r in live)]))
        else:
            self.waiting.clear()
        if out:
            frame = pd.DataFrame(out, columns=["code", "rec", "zone", "event_id", "ts", "price", "status"])
            frame["ts"] = pd.to_datetime(frame["ts"], unit="us")
            yield frame

    @staticmethod
    def _run(code: int, ticks: list[tuple], recs: dict, zones: dict, mark: int) -> Iterator[tuple]:
        """Rows of the ticks that are due, in order, and of recommendations that end by `mark` (milliseconds)."""
        for us, event_id, price in ticks:
            for rec, (start, stop, *bounds) in recs.items():
                if not start <= us // 1000 < stop:
                    continue
                for zone, bound in zip(ZONES, bounds, strict=True):
                    if bound <= 0:
                        continue
                    last, sent, is_open = zones.get((rec, zone), (0.0, 0.0, False))
                    (last, sent), hit = zone_step((last, sent), us / 1e6, price, bound, zone)
                    if hit:
                        is_open = True
                        yield code, rec, zone, event_id, us, price, "new"
                    elif is_open and not _inside(price, bound, zone):
                        is_open = False
                        yield code, rec, zone, event_id, us, price, "resolved"
                    zones[rec, zone] = (last, sent, is_open)
        for rec, (_, stop, *_bounds) in recs.items():
            if stop <= mark:
                for zone in ZONES:
                    last, _, is_open = zones.get((rec, zone), (0.0, 0.0, False))
                    if is_open:
                        yield code, rec, zone, None, stop * 1000, last, "expired"

    def close(self) -> None:
        pass


def _inside(price: float, bound: float, zone: str) -> bool:
    side = ZONES[zone]
    return side * price < side * bound or (price == bound and zone != "cost")


def zone_book(ticks: DataFrame, recommendations: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Alerts of (code, event_id, ts, price) against (code, rec, start, stop, buy, profit, loss, cost); a bound of 0 is no zone.

    start and stop are timestamps, stop exclusive. A row is `new` when an alert fires, `resolved` when the price leaves
    the zone, `expired` when the recommendation ends before that (no event id, the time of the end).
    """
    initial = recommendations.select("code", "rec", F.unix_millis("start").alias("start"), F.unix_millis("stop").alias("stop"), *[F.col(z).cast("double").alias(z) for z in ZONES])
    rows = ticks.withWatermark("ts", delay).filter("price > 0").select("code", "event_id", "ts", F.col("price").cast("double").alias("price"))
    return rows.groupBy("code").transformWithStateInPandas(
        statefulProcessor=ZoneBook(), outputStructType=BOOK, outputMode="append", timeMode="EventTime", initialState=initial.groupBy("code")
    )
