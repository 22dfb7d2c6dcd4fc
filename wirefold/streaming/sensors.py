"""Frames from remote sensors' byte streams, across messages and micro-batches.

A sensor sends frames (length, nanoseconds, interface, bytes) as one stream of
bytes, cut into numbered messages wherever it likes.  The state of a sensor is
the number of the next message, the bytes that have not made a frame yet, and
the messages that came before their turn.  However messages are cut, repeated,
dealt into batches or mixed up (by less than ``wait`` messages), the frames are
the same.

Where a message stays away, its number is given up after ``wait`` later ones.
The bytes at hand are dropped, and the stream is taken up again at the first
place from where headers lead on to one another.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources.shared import fresh
from .stateful import state_store

FRAME = "sensor string, n long, us long, interface long, frame binary, broken string"
_COLUMNS = ["sensor", "n", "us", "interface", "frame", "broken"]
HEADER = 16
#: Longest frame and highest interface number that are taken for one.
LONGEST, INTERFACES = 1 << 18, 1 << 12
#: Nanoseconds between neighbouring frames that are believed after a gap.
SPAN = 86_400 * 10**9


def _header(data: bytes, at: int) -> tuple[int, int, int] | None:
    """(length, nanoseconds, interface) at a place, None if they cannot be a frame's."""
    size, ns, interface = struct.unpack_from(">IqI", data, at)
    return (size, ns, interface) if size <= LONGEST and interface < INTERFACES else None


def cut(data: bytes) -> tuple[list[tuple[int, int, bytes]], bytes, bool]:
    """Whole frames (us, interface, bytes), what is left, and whether a header was no header."""
    out, at = [], 0
    while at + HEADER <= len(data):
        head = _header(data, at)
        if head is None:
            return out, data[at:], True
        size, ns, interface = head
        if at + HEADER + size > len(data):
            break
        out.append((ns // 1000, interface, data[at + HEADER : at + HEADER + size]))
        at += HEADER + size
    return out, data[at:], False


def taken_up(data: bytes, last: int | None) -> int | None:
    """The first place from where two headers follow one another, in time near ``last`` (ns); None so far."""
    for at in range(len(data) - HEADER + 1):
        head = _header(data, at)
        if head is None or last is not None and abs(head[1] - last) > SPAN:
            continue
        behind = at + HEADER + head[0]
        if behind + HEADER <= len(data):
            follows = _header(data, behind)
            if follows and abs(follows[1] - head[1]) <= SPAN:
                return at
    return None


class Sensor(StatefulProcessor):
    """Puts a sensor's messages in order and cuts them into frames."""

    def __init__(self, first: int, wait: int, ttl: int | None) -> None:
        self.first, self.wait, self.ttl = first, wait, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        # lost: the stream is being taken up again; ns: time of the last frame.
        self.place = handle.getValueState("place", "seq long, frames long, tail binary, lost boolean, ns long", self.ttl)
        self.early = handle.getListState("early", "seq long, body binary", self.ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        seq, frames, tail, lost, ns = self.place.get() if self.place.exists() else (self.first, 0, b"", False, None)
        waiting = {s: bytes(b) for s, b in self.early.get()} if self.early.exists() else {}
        for part in rows:
            for s, b in zip(part["seq"], part["body"]):
                if s >= seq:
                    waiting.setdefault(int(s), bytes(b) if b is not None else b"")
        out, buffer = [], bytearray(tail)

        def settle() -> None:
            nonlocal frames, lost, ns
            while True:
                if lost:
                    at = taken_up(bytes(buffer), ns)
                    if at is None:
                        del buffer[: max(0, len(buffer) - LONGEST - 2 * HEADER)]
                        return
                    del buffer[:at]
                    lost = False
                found, left, broken = cut(bytes(buffer))
                for us, interface, frame in found:
                    out.append((key[0], frames, us, interface, frame, None))
                    frames, ns = frames + 1, us * 1000
                buffer[:] = left
                if not broken:
                    return
                out.append((key[0], None, None, None, None, "not a frame header"))
                lost = True
                del buffer[:1]

        while waiting:
            if seq in waiting:
                buffer += waiting.pop(seq)
                seq += 1
            elif len(waiting) >= self.wait:
                settle()
                later = min(waiting)
                out.append((key[0], None, None, None, None, f"messages {seq} to {later - 1} are missing"))
                seq, lost = later, True
                buffer.clear()
            else:
                break
        settle()
        self.place.update((seq, frames, bytes(buffer), lost, ns))
        if waiting:
            self.early.put(sorted(waiting.items()))
        else:
            self.early.clear()
        if out:
            yield pd.DataFrame(out, columns=_COLUMNS).astype({"n": "Int64", "us": "Int64", "interface": "Int64"})

    def close(self) -> None:
        pass


def framed(messages: DataFrame, first: int = 0, wait: int = 64, ttl_ms: int | None = None) -> DataFrame:
    """Frames of a stream of (sensor, seq, body): FRAME.

    ``sensor`` names one connection, whose messages count from ``first``.
    Broken places are rows with ``broken`` and without a frame.  ``ttl_ms``
    (processing time) forgets sensors that have been silent for so long.
    """
    rows = messages.where("sensor IS NOT NULL AND seq IS NOT NULL").select("sensor", "seq", "body").groupBy("sensor")
    return rows.transformWithStateInPandas(Sensor(first, wait, ttl_ms), FRAME, "Append", "ProcessingTime" if ttl_ms else "None")


def replayed_frames(parts: list[DataFrame], files: int = 4, **options) -> DataFrame:
    """Frames of messages that come in these parts, a micro-batch each."""
    spark = parts[0].sparkSession
    folder, out = fresh(spark, "messages"), fresh(spark, "frames")
    for part in parts:
        part.select("sensor", "seq", "body").repartition(files).write.mode("append").parquet(folder)
    with state_store(spark):
        stream = spark.readStream.schema("sensor string, seq long, body binary").option("maxFilesPerTrigger", files).parquet(folder)
        query = framed(stream, **options).writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{folder}-checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.schema(FRAME).parquet(out)
