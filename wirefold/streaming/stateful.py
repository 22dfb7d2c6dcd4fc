"""Streaming twins of the keyed stateful operators.

All work on event time (``us``, microseconds, and ``ts``, its timestamp) with
a watermark; state is dropped by timers, not by a bound on keys.  The stateful
processors need the RocksDB state store (``state_conf``).
"""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources.shared import fresh

STATE_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def state_conf(spark) -> None:
    """Use the state store that ``transformWithState`` needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_PROVIDER)


@contextlib.contextmanager
def state_store(spark) -> Iterator[None]:
    """``state_conf`` for a while; the session's own setting comes back."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    state_conf(spark)
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def plain_rows(part: pd.DataFrame, kinds: str) -> list[tuple]:
    """Rows of plain values in the order of a DDL string: null is None, and
    whole numbers are int, also where nulls have made their column one of floats."""
    whole = {c.split()[0] for c in kinds.split(", ") if c.split()[1] in ("int", "long")}
    columns = [[None if pd.isna(x) else int(x) if name in whole else x for x in part[name].tolist()] for name in (c.split()[0] for c in kinds.split(", "))]
    return list(zip(*columns))


def replayed(parts: list[DataFrame], work: Callable[[DataFrame], DataFrame], files: int = 1) -> DataFrame:
    """What a stream over ``parts`` has appended at its end; each part is a micro-batch of ``files`` files."""
    spark = parts[0].sparkSession
    folder, out = fresh(spark, "parts"), fresh(spark, "appended")
    for part in parts:
        # Rows are dealt by a number, so that no file is left out for want of rows.
        part.withColumn("_file", F.monotonically_increasing_id() % files).repartition(files, "_file").drop("_file").write.mode("append").parquet(folder)
    with state_store(spark):
        done = work(spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", files).parquet(folder))
        query = done.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{folder}-checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.schema(done.schema).parquet(out)


def timed(packets: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """Adds ``ts`` and the watermark."""
    return packets.withColumn("ts", F.timestamp_micros("us")).withWatermark("ts", lateness)


def deduplicated(packets: DataFrame, keys: list[str], within: str = "300 seconds") -> DataFrame:
    """First packet per key; repeats within the time are dropped."""
    return packets.withWatermark("ts", within).dropDuplicatesWithinWatermark(keys)


class Throttle(StatefulProcessor):
    """Fires a key at most once per ``interval`` microseconds.

    The timer restarts only when an event fires.  Rows of a batch are taken in
    time order; state expires ``interval`` after the last firing.
    """

    def __init__(self, interval: int) -> None:
        self.interval = interval

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "us long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last = self.last.get()[0] if self.last.exists() else None
        fired = []
        for us in sorted(int(x) for part in rows for x in part["us"]):
            if last is None or us - last >= self.interval:
                fired.append(us)
                last = us
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(-(-(last + self.interval) // 1000))
        self.last.update((last,))
        if fired:
            yield pd.DataFrame({"hw_addr": [key[0]] * len(fired), "us": fired})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.last.clear()  # rows after the watermark fire with or without it
        return iter(())

    def close(self) -> None:
        pass


def throttled(packets: DataFrame, interval: int, lateness: str = "10 minutes") -> DataFrame:
    """(hw_addr, us) of the packets that fire; later ones than ``lateness`` are dropped."""
    return timed(packets, lateness).groupBy("hw_addr").transformWithStateInPandas(Throttle(interval), "hw_addr string, us long", "append", "EventTime", eventTimeColumnName="")


class Presence(StatefulProcessor):
    """Online and offline transitions by event-time timers."""

    def __init__(self, seconds: int) -> None:
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "us long, online boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        newest, online = self.seen.get() if self.seen.exists() else (None, False)
        wait, out = self.seconds * 1_000_000, []
        for us in sorted(int(x) for part in rows for x in part["us"]):
            if online and us - newest > wait:
                out.append((key[0], newest + wait, "offline"))
                online = False
            if not online:
                out.append((key[0], us, "online"))
                online = True
            newest = us if newest is None else max(newest, us)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(newest // 1000 + self.seconds * 1000)
        self.seen.update((newest, online))
        if out:
            yield pd.DataFrame(out, columns=["hw_addr", "us", "state"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        newest, _ = self.seen.get()
        self.seen.clear()  # the next row of an address without state comes online
        yield pd.DataFrame({"hw_addr": [key[0]], "us": [newest + self.seconds * 1_000_000], "state": ["offline"]})

    def close(self) -> None:
        pass


def presence(packets: DataFrame, seconds: int) -> DataFrame:
    """(hw_addr, us, state) transitions; ``packets`` has ``ts`` and a watermark."""
    return packets.groupBy("hw_addr").transformWithStateInPandas(Presence(seconds), "hw_addr string, us long, state string", "append", "EventTime", eventTimeColumnName="")


class Affinity(StatefulProcessor):
    """Counts DNS names per vendor; reports when the main vendor leaves the
    one that was learned from the first ``least`` queries."""

    def __init__(self, least: int, displaced: float = 0.5, top: float = 0.4) -> None:
        self.least, self.displaced, self.top = least, displaced, top

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counts = handle.getMapState("counts", "vendor string", "n long")
        self.baseline = handle.getValueState("baseline", "vendor string, drifted boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        counts = {k[0]: v[0] for k, v in self.counts.iterator()}
        base, drifted = self.baseline.get() if self.baseline.exists() else (None, False)
        out = []
        every = pd.concat(list(rows)).sort_values(["us", "vendor"])
        for us, vendor in zip(every["us"], every["vendor"]):
            counts[vendor] = counts.get(vendor, 0) + 1
            total = sum(counts.values())
            first = max(sorted(counts), key=counts.get)
            if base is None and total >= self.least:
                base = first
            elif base is not None and first != base:
                gone, now = 1 - counts[base] / total, counts[first] / total
                if gone >= self.displaced and now >= self.top and not drifted:
                    drifted = True
                    out.append((key[0], int(us), base, first))
        for vendor, n in counts.items():
            self.counts.updateValue((vendor,), (n,))
        if base is not None:
            self.baseline.update((base, drifted))
        if out:
            yield pd.DataFrame(out, columns=["hw_addr", "us", "from_vendor", "to_vendor"])

    def close(self) -> None:
        pass


def affinity(dns: DataFrame, least: int = 20) -> DataFrame:
    return dns.groupBy("hw_addr").transformWithStateInPandas(Affinity(least), "hw_addr string, us long, from_vendor string, to_vendor string", "append", "None")


def activity(packets: DataFrame, width: str = "1 hour") -> DataFrame:
    """Packets per protocol and window of event time."""
    return packets.groupBy(F.window("ts", width), "protocol").agg(F.count("*").alias("n"), F.approx_count_distinct("hw_addr").alias("hosts"))


def sessions(packets: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Sessions of each address: packets without a longer pause."""
    return packets.groupBy(F.session_window("ts", gap), "hw_addr").agg(F.count("*").alias("n"))


def merged_hosts(batch: DataFrame, store: str, epoch: int) -> None:
    """``foreachBatch`` sink: fold a batch into the host table by D01's rules.

    Each epoch writes a new version beside the last one, so a repeated epoch
    gives the same version and a reader never sees half of one.
    """
    spark = batch.sparkSession
    new = batch.groupBy("hw_addr").agg(F.max_by("ip_addr", F.struct("us", "packet_id")).alias("ip_addr"), F.min("us").alias("discovered_us"), F.max("us").alias("last_us"))
    if epoch > 0:
        new = new.unionByName(spark.read.parquet(f"{store}/v{epoch - 1}"))
    folded = new.groupBy("hw_addr").agg(F.max_by("ip_addr", "last_us").alias("ip_addr"), F.min("discovered_us").alias("discovered_us"), F.max("last_us").alias("last_us"))
    folded.write.mode("overwrite").parquet(f"{store}/v{epoch}")
