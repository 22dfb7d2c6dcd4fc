"""Drift of an address's DNS vendors as a stream, judged in event time.

Rows wait in the state until the watermark has passed them and are then taken
in time order, so batches and lateness change nothing.  An address learns its
baseline vendor (most queries; ties: seen first) from its first ``least`` queries or
more over ``learn``.  Later, its baseline is displaced when another vendor leads
with ``top`` of all queries and the baseline has lost ``early`` of them within the
``young`` age, ``stable`` of them after.  A young displacement is reported at
once, with the shares behind the last displaced query of that moment, a later
one when it has held for ``hold``: a timer tells, whether or not another query
comes.  It is reported once until the baseline is back, and once a moment.  An
address without queries for ``forget`` is forgotten by a timer, too.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .stateful import timed

SECOND = 1_000_000
OUT = "hw_addr string, us long, from_vendor string, from_pct double, to_vendor string, to_pct double"
_NAMES = [c.split()[0] for c in OUT.split(", ")]


@dataclass(frozen=True)
class Limits:
    """Fixed values of the profile; times in microseconds."""

    least: int = 20
    learn: int = 600 * SECOND
    young: int = 3600 * SECOND
    hold: int = 1800 * SECOND
    early: float = 0.60
    stable: float = 0.50
    top: float = 0.40
    forget: int = 7 * 86_400 * SECOND


def percent(part: int, total: int) -> float:
    """To one place, halves up as SQL's ``round`` has them (6.25 is 6.3)."""
    tenths = part * 100 / total * 10
    return (math.floor(tenths) + (tenths % 1 >= 0.5)) / 10


class Profile:
    """What is known of one address; rows come in time order."""

    def __init__(self, limits: Limits, first: int | None = None, last: int = 0, baseline: str | None = None, since: int | None = None, told: bool = False, counts: dict[str, int] | None = None) -> None:
        self.limits, self.first, self.last, self.baseline, self.since, self.told = limits, first, last, baseline, since, told
        self.counts = counts if counts is not None else {}  # in the order in which vendors were seen
        self.quick: tuple | None = None  # a young displacement's report while its moment lasts

    def until(self, us: int) -> list[tuple]:
        """Time passes to ``us``, before any row of it: what becomes due."""
        due = []
        if self.quick is not None and us > self.quick[0]:
            due.append(self.quick)
            self.quick = None
        if self.since is not None and not self.told and us >= self.since + self.limits.hold:
            due.append(self._report(self.since + self.limits.hold))
        if self.first is not None and us >= self.last + self.limits.forget:
            self.__init__(self.limits)
        return due

    def row(self, us: int, vendor: str) -> list[tuple]:
        out, limits = self.until(us), self.limits
        self.first = us if self.first is None else self.first
        self.last = us
        self.counts[vendor] = self.counts.get(vendor, 0) + 1
        total, age = sum(self.counts.values()), us - self.first
        top = max(self.counts, key=self.counts.get)
        if self.baseline is None:
            if total >= limits.least and age >= limits.learn:
                self.baseline = top
            return out
        gone = 1 - self.counts[self.baseline] / total
        need = limits.early if age < limits.young else limits.stable
        if top == self.baseline or gone < need or self.counts[top] / total < limits.top:
            self.since, self.told = None, False
        elif age < limits.young:
            if not self.told or self.quick is not None:
                self.quick = self._report(us)
        elif self.since is None:
            self.since = us
        return out

    def _report(self, us: int) -> tuple:
        total, top = sum(self.counts.values()), max(self.counts, key=self.counts.get)
        self.told = True
        return us, self.baseline, percent(self.counts[self.baseline], total), top, percent(self.counts[top], total)

    def next(self) -> int | None:
        """When something becomes due without a further row."""
        if self.first is None:
            return None
        held = [self.since + self.limits.hold] if self.since is not None and not self.told else []
        return min([*held, self.last + self.limits.forget])


class Affinity(StatefulProcessor):
    def __init__(self, limits: Limits) -> None:
        self.limits = limits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us long, id long, vendor string")
        self.profile = handle.getValueState("profile", "first long, last long, baseline string, since long, told boolean")
        self.counts = handle.getListState("counts", "vendor string, n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for part in rows:
            self.waiting.appendList(list(part[["us", "id", "vendor"]].itertuples(index=False, name=None)))
        self._wake(min(r[0] for r in self.waiting.get()))
        return iter(())

    def _wake(self, us: int | None) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if us is not None:
            self.handle.registerTimer(-(-us // 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted(tuple(r) for r in self.waiting.get()) if self.waiting.exists() else []
        known = self.profile.get() if self.profile.exists() else (None, 0, None, None, False)
        counts = dict(tuple(r) for r in self.counts.get()) if self.counts.exists() else {}
        p, out, later = Profile(self.limits, *known, counts), [], []
        for us, id_, vendor in rows:
            if us <= now:
                out += p.row(us, vendor)
            else:
                later.append((us, id_, vendor))
        out += p.until(now + 1)  # all rows of ``now`` are in
        if later:
            self.waiting.put(later)
        else:
            self.waiting.clear()
        if p.first is None:
            self.profile.clear()
            self.counts.clear()
        else:
            self.profile.update((p.first, p.last, p.baseline, p.since, p.told))
            self.counts.put(list(p.counts.items()))
        due = [x for x in (later[0][0] if later else None, p.next()) if x is not None]
        self._wake(max(min(due), now + 1000) if due else None)
        if out:
            yield pd.DataFrame([(key[0], *r) for r in out], columns=_NAMES)

    def close(self) -> None:
        pass


def drift(dns: DataFrame, limits: Limits | None = None, lateness: str = "10 minutes") -> DataFrame:
    """Reports of a stream of classified queries (hw_addr, us, id, vendor): OUT.

    ``id`` orders rows of one moment.  Rows later than ``lateness`` are dropped.
    """
    rows = timed(dns.where("hw_addr IS NOT NULL AND us IS NOT NULL AND vendor IS NOT NULL").select("hw_addr", "us", "id", "vendor"), lateness)
    return rows.groupBy("hw_addr").transformWithStateInPandas(Affinity(limits or Limits()), OUT, "append", "EventTime", eventTimeColumnName="")
