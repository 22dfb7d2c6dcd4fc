"""Connection tables and sensor heartbeats as streams, in event time.

``InOrder`` keeps a key's rows until the watermark has passed them and takes
them in time order, so late rows (within the watermark's delay), repeated
micro-batches and any batching change nothing; a timer wakes a key when its next row or its next
deadline is due, and a key without either keeps no state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .stateful import plain_rows, timed

SECOND = 1_000_000


class InOrder(StatefulProcessor):
    """Base of processors that take a key's rows in event-time order.

    A subclass names its input columns (``us`` first, then what orders rows of
    one moment), its state and its output, and says what a row and the
    passing of time do.
    """

    columns: list[str]
    kinds: str
    state: str
    output: list[str]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.kinds)
        self.kept = handle.getListState("kept", self.state)

    def row(self, kept: list[tuple], row: tuple) -> list[tuple]:
        """Takes a row: changes ``kept`` in place, returns output rows."""
        raise NotImplementedError

    def until(self, kept: list[tuple], us: int) -> list[tuple]:
        """Time has passed to ``us``: what is due goes out of ``kept``."""
        raise NotImplementedError

    def due(self, kept: list[tuple]) -> int | None:
        """When the next entry of ``kept`` falls due."""
        raise NotImplementedError

    def _wake(self, us: int | None) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if us is not None:
            self.handle.registerTimer(-(-us // 1000))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for part in rows:
            self.waiting.appendList(plain_rows(part[self.columns], self.kinds))
        self._wake(min(r[0] for r in self.waiting.get()))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs() * 1000
        order = lambda r: tuple((x is not None, x) for x in r)
        rows = sorted((tuple(r) for r in self.waiting.get()), key=order) if self.waiting.exists() else []
        kept, out = [tuple(r) for r in self.kept.get()] if self.kept.exists() else [], []
        later = [r for r in rows if r[0] > now]
        for r in rows[: len(rows) - len(later)]:
            out += self.until(kept, r[0]) + self.row(kept, r)
        out += self.until(kept, now)
        for state, some in ((self.waiting, later), (self.kept, kept)):
            state.put(some) if some else state.clear()
        times = [x for x in (later[0][0] if later else None, self.due(kept)) if x is not None]
        self._wake(max(min(times), now + 1000) if times else None)
        if out:
            yield pd.DataFrame([(key[0], *r) for r in out], columns=self.output)

    def close(self) -> None:
        pass


class Connections(InOrder):
    """A server's connection table: SYN seen, banner captured, closed; first in, first out beyond ``most``.

    Events of one moment are taken in the order syn, data, banner, close.  A
    SYN of a known connection changes nothing; other events of unknown
    connections (their SYN was lost) are ignored.
    """

    EVENTS = {0: "syn", 1: "data", 2: "banner", 3: "close"}
    columns = ["us", "event", "client", "client_port", "server_port", "bytes"]
    kinds = "us long, event int, client string, client_port int, server_port int, bytes long"
    state = "client string, client_port int, server_port int, first_us long, last_us long, state string, bytes long"
    output = ["server", "client", "client_port", "server_port", "first_us", "last_us", "state", "bytes", "ended", "us"]

    def __init__(self, idle: int, most: int) -> None:
        self.idle, self.most = idle, most

    def until(self, kept: list[tuple], us: int) -> list[tuple]:
        gone = sorted((e for e in kept if us > e[4] + self.idle), key=lambda e: (e[4], e))
        kept[:] = [e for e in kept if us <= e[4] + self.idle]
        return [(*e, "expired", e[4] + self.idle) for e in gone]

    def due(self, kept: list[tuple]) -> int | None:
        return min((e[4] + self.idle + 1 for e in kept), default=None)

    def row(self, kept: list[tuple], row: tuple) -> list[tuple]:
        us, event, *key, n = row
        at = next((i for i, e in enumerate(kept) if list(e[:3]) == key), None)
        if event == 0:
            if at is not None:
                return []
            out = [(*kept.pop(0), "evicted", us)] if len(kept) >= self.most else []
            kept.append((*key, us, us, "syn_seen", 0))
            return out
        if at is None:
            return []
        entry = kept[at]
        if event == 3:
            del kept[at]
            return [(*entry[:4], us, "closed", entry[6], "closed", us)]
        kept[at] = (*entry[:4], us, "banner_captured" if event == 2 else entry[5], entry[6] + (n or 0) * (event == 1))
        return []


class Heartbeats(InOrder):
    """A sensor connects with its first sign of life, and disconnects when none has come for ``silent``."""

    columns = ["us"]
    kinds = "us long"
    state = "last_us long"
    output = ["sensor", "us", "event"]

    def __init__(self, silent: int) -> None:
        self.silent = silent

    def until(self, kept: list[tuple], us: int) -> list[tuple]:
        if kept and us > kept[0][0] + self.silent:
            return [(kept.pop()[0] + self.silent, "sensor_disconnect")]
        return []

    def due(self, kept: list[tuple]) -> int | None:
        return kept[0][0] + self.silent + 1 if kept else None

    def row(self, kept: list[tuple], row: tuple) -> list[tuple]:
        out = [] if kept else [(row[0], "sensor_connect")]
        kept[:] = [(row[0],)]
        return out


CONNECTION = "server string, client string, client_port int, server_port int, first_us long, last_us long, state string, bytes long, ended string, us long"


def connections(events: DataFrame, idle: int = 30 * SECOND, most: int = 10_000, lateness: str = "10 seconds") -> DataFrame:
    """Ended connections of a stream of TCP events: CONNECTION.

    ``events``: server, us, event (0 syn, 1 data, 2 banner, 3 close), client,
    client_port, server_port, bytes.  ``most`` bounds the open connections of a
    server, ``idle`` the time without an event.
    """
    rows = timed(events.where("server IS NOT NULL AND us IS NOT NULL AND event IS NOT NULL").select("server", *Connections.columns), lateness)
    return rows.groupBy("server").transformWithStateInPandas(Connections(idle, most), CONNECTION, "append", "EventTime", eventTimeColumnName="")


def sensor_events(beats: DataFrame, silent: int = 90 * SECOND, lateness: str = "10 seconds") -> DataFrame:
    """sensor_connect and sensor_disconnect events of a stream of heartbeats (sensor, us)."""
    rows = timed(beats.where("sensor IS NOT NULL AND us IS NOT NULL").select("sensor", "us"), lateness)
    return rows.groupBy("sensor").transformWithStateInPandas(Heartbeats(silent), "sensor string, us long, event string", "append", "EventTime", eventTimeColumnName="")
