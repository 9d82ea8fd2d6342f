"""Awakenings as a stream: sessions of each address in order of event time, given out when the watermark closes them."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.times import micros
from ..operators.sets import undirected_view

US, DAY = 1_000_000, 86_400
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "address string, session long, n long, sent double, received double, destinations long, dormant_days double, kind string, volume_factor double, mean_gap double, confidence double"
#: The open session, the sums of all before it, the time of the first waiting event, the timer, and how many accounts the list holds (and held when it was last made distinct).
OPEN = "session long, n long, sent double, received double, gaps double, dormant double, last long, past double, past_n long, waits long, timer long, listed long, distinct long"
NONE_YET = (0, 0, 0.0, 0.0, 0.0, None, None, 0.0, 0, None, None, 0, 0)
#: A row of a list holds so many events (or accounts) at most, as JSON: a list is written and read by the row, and each row is a message of its own to the state.
ROW = 1000
AWAKENING = Row(*(c.split()[0] for c in OUT.split(", ")))


def _rows(items: list) -> list[tuple]:
    return [(json.dumps(items[k : k + ROW]),) for k in range(0, len(items), ROW)]


def _items(state) -> list:
    return [x for (row,) in state.get() for x in json.loads(row)]


class Awakening(StatefulProcessor):
    """State of an address: the events that the watermark has not passed, the open session, the accounts that it sent to, and the sums of all sessions before.

    Events wait in a list until the watermark has passed them and are then taken in order, so the order in which files land does not matter.
    Event-time timers call an address up again, for its next waiting event or for the end of its session, when no new row does. Every call of the state is a
    message, so a call of an address makes a few, whatever its number of events: the waiting list is read only if an event in it is due, and accounts are
    written only for the session that stays open.
    """

    def __init__(self, gap_days: float, fan_out: int):
        self.gap, self.fan_out = int(gap_days * DAY * US), fan_out

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "events string")
        self.open = handle.getValueState("open", OPEN)
        self.sent_to = handle.getListState("sent_to", "accounts string")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        yield from self._go_on(key[0], [(r.us, r.hash, r.direction, r.other, r.x) for r in rows], timerValues, False)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self._go_on(key[0], [], timerValues, True)

    def _go_on(self, address: str, new: list[tuple], timerValues, expired: bool) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        *now, waits, timer, listed, distinct = self.open.get() or NONE_YET
        ready, fresh, out = [], set(), []
        waited = waits is not None
        if new:
            first = min(e[0] for e in new)
            waits = min(first, waits) if waited else first
        if waits is not None and waits <= passed:
            events = sorted([*(map(tuple, _items(self.waiting)) if waited else []), *new])
            ready = [e for e in events if e[0] <= passed]
            left = events[len(ready) :]
            waits = left[0][0] if left else None
            if left:
                self.waiting.put(_rows(left))
            elif waited:
                self.waiting.clear()
        elif new:
            self.waiting.appendList(_rows(new))
        for us, _, direction, other, x in ready:
            if now[6] is None or us - now[6] > self.gap:
                if now[1]:
                    out += self._close(address, now, fresh, listed)
                    fresh, listed, distinct = set(), 0, 0
                dormant = None if now[6] is None else (us - now[6]) / US / DAY
                now = [now[0] + 1, 0, 0.0, 0.0, 0.0, dormant, us, now[7], now[8]]
            else:
                now[4] += (us - now[6]) / US
            now[1] += 1
            now[2 if direction == "out" else 3] += x
            now[6] = us
            if direction == "out":
                fresh.add(other)
        if now[1] and passed > now[6] + self.gap:
            out += self._close(address, now, fresh, listed)
            now[1:6] = [0, 0.0, 0.0, 0.0, None]
            fresh, listed, distinct = set(), 0, 0
        if fresh:
            if listed + len(fresh) > 2 * distinct + ROW:  # so the list stays within twice its accounts
                fresh |= set(_items(self.sent_to)) if listed else set()
                self.sent_to.put(_rows(sorted(fresh)))
                listed = distinct = len(fresh)
            else:
                self.sent_to.appendList(_rows(sorted(fresh)))
                listed += len(fresh)
        ends = [t for t in (waits, now[6] + self.gap if now[1] else None) if t is not None]
        call = min(ends) // 1000 + 1 if ends else None
        if call != timer or expired:
            if timer is not None and not expired:  # one that has expired is taken away by Spark
                self.handle.deleteTimer(timer)
            if call is not None:
                self.handle.registerTimer(call)
        self.open.update((*now, waits, call, listed, distinct))
        yield from (AWAKENING(*r) for r in out)

    def _close(self, address: str, now: list, fresh: set[str], listed: int) -> list[tuple]:
        """The closed session as a row, if it is not the first; its sums become part of the past. It sent to the accounts that are listed and to the fresh ones."""
        session, n, sent, received, gaps, dormant, _, past, past_n = now
        destinations = len(fresh.union(_items(self.sent_to))) if listed else len(fresh)
        if listed:
            self.sent_to.clear()
        whole = sent + received
        now[7], now[8] = past + whole, past_n + n
        if session == 1 or not n:
            return []
        kind = "liquidation" if sent > 0.8 * whole and destinations <= 2 else "distribution" if destinations >= self.fan_out else "consolidation" if received > sent else "testing"
        factor = whole / n / (past / past_n) if past else None
        mean_gap = gaps / (n - 1) if n > 1 else None
        confidence = 0.5 + (0.2 if factor is not None and factor > 1 else 0.0) + (0.2 if mean_gap is not None and mean_gap < 60 else 0.0)
        return [(address, session, n, sent, received, destinations, dormant, kind, factor, mean_gap, confidence)]

    def close(self) -> None:
        pass


def awakenings(transfers: DataFrame, gap_days: float = 30, fan_out: int = 3, late: str = "1 hour") -> DataFrame:
    """The rows of operators.anomalies.awakening, each when the watermark has passed the end of its session by the gap.

    State is kept by RocksDB, which this sets for the session, as a list that changes in place needs it. It grows with the addresses, with
    the events inside the watermark's delay and with the accounts that an open session sends to. Late rows are dropped and counted by Spark.
    """
    transfers.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    v = undirected_view(transfers.withWatermark("timestamp", late))
    rows = v.select("address", "other", "hash", "direction", "timestamp", micros("timestamp").alias("us"), (F.col("value").cast("double") / 1e12).alias("x"))
    return rows.groupBy("address").transformWithState(Awakening(gap_days, fan_out), outputStructType=OUT, outputMode="append", timeMode="eventTime")
