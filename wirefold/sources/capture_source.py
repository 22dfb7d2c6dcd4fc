"""Capture files as a data source: ``spark.read.format("capture").load(path)``.

A file is read in byte ranges.  A range that starts inside the file has to find
the first record at or behind its start.  It looks for a place, well before
its start, from where record headers lead to one another over more bytes than
any record can hold, and follows them; headers inside a packet's own bytes (a
capture sent over the network) cannot lead that far.  The same search finds the
way on behind a broken record, so every split size gives the same rows.

Columns: file, position (of the record in the file), us (microseconds, null
where the format has none), interface, frame; broken says why a record could
not be read, and is null for frames.

Options: ``splitBytes`` (64 MiB), ``maxFileBytes`` (files beyond it are
refused; no bound by default).  ``path`` may be a file, a folder or a glob, on
any file system that pyarrow knows.
"""

from __future__ import annotations

import fnmatch
import posixpath
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "file string, position long, us long, interface long, frame binary, broken string"
SUFFIXES = (".pcap", ".pcapng", ".cap")
SPLIT = 64 << 20
#: Longest frame, and longest block, that is taken for one.
LONGEST, LONGEST_BLOCK = 1 << 18, 1 << 20
#: Seconds that a record may lie from the file's first one.
SPAN = 1 << 28
BATCH = 1024
# Magic numbers of classic files (byte order, parts of a second), and block types.
MAGIC = {b"\xd4\xc3\xb2\xa1": ("<", 10**6), b"\xa1\xb2\xc3\xd4": (">", 10**6), b"\x4d\x3c\xb2\xa1": ("<", 10**9), b"\xa1\xb2\x3c\x4d": (">", 10**9)}
SECTION, INTERFACE, SIMPLE, ENHANCED = 0x0A0D0D0A, 1, 3, 6
RESOLUTION = 9


class _Window:
    """Bytes of a file by position, through a buffer that moves forward."""

    def __init__(self, file, size: int) -> None:
        self.file, self.size, self.at, self.held = file, size, 0, b""

    def get(self, at: int, n: int) -> bytes:
        """Up to ``n`` bytes from ``at`` on; fewer at the file's end."""
        if at < self.at or at + n > self.at + len(self.held):
            self.at, self.held = at, self.file.read_at(max(0, min(max(n, 1 << 20), self.size - at)), at) if at < self.size else b""
        return self.held[at - self.at : at - self.at + n]


class Classic:
    """Records of 16 header bytes and a frame behind a file header of 24."""

    first, step, longest = 24, 1, LONGEST

    def __init__(self, window: _Window, order: str, parts: int) -> None:
        self.window, self.order, self.parts = window, order, parts
        head = window.get(24, 4)
        self.begin = struct.unpack(order + "I", head)[0] if len(head) == 4 else 0

    def plausible(self, data: bytes) -> np.ndarray:
        """Offsets of ``data`` at which a record header may stand."""
        n = len(data) - 15
        if n <= 0:
            return np.empty(0, np.int64)
        raw = np.frombuffer(data, np.uint8).astype(np.int64)
        def word(k):
            four = [raw[k + j : k + j + n] for j in range(4)]
            four = four[::-1] if self.order == "<" else four
            return four[0] << 24 | four[1] << 16 | four[2] << 8 | four[3]

        sec, part, size, whole = (word(4 * k) for k in range(4))
        return np.flatnonzero((size > 0) & (size <= LONGEST) & (whole >= size) & (part < self.parts) & (np.abs(sec - self.begin) <= SPAN))

    def length(self, at: int) -> tuple[int, str | None]:
        """Bytes of the record at ``at``, or why there is none."""
        head = self.window.get(at, 16)
        if len(head) < 16:
            return 0, "cut off in a header"
        sec, part, size, whole = struct.unpack(self.order + "IIII", head)
        if not (0 < size <= LONGEST and whole >= size and part < self.parts and abs(sec - self.begin) <= SPAN):
            return 0, "not a record header"
        return (16 + size, None) if at + 16 + size <= self.window.size else (0, "cut off in a frame")

    def row(self, at: int, size: int) -> tuple[int | None, int, bytes] | None:
        sec, part = struct.unpack(self.order + "II", self.window.get(at, 8))
        return sec * 10**6 + part * 10**6 // self.parts, 0, self.window.get(at + 16, size - 16)


class Blocks:
    """Blocks whose length stands before and behind them; interfaces are described before the first packet."""

    first, step, longest = 0, 4, LONGEST_BLOCK

    def __init__(self, window: _Window) -> None:
        self.window = window
        self.order = "<" if window.get(8, 4) == b"\x4d\x3c\x2b\x1a" else ">"
        self.units: list[int] = []
        at = 0
        while True:
            size, broken = self.length(at)
            kind = self._kind(at)
            if broken or kind in (SIMPLE, ENHANCED):
                break
            if kind == INTERFACE:
                self.units.append(self._unit(self.window.get(at + 16, size - 20)))
            at += size

    def _kind(self, at: int) -> int:
        data = self.window.get(at, 4)
        return struct.unpack(self.order + "I", data)[0] if len(data) == 4 else -1

    def _unit(self, options: bytes) -> int:
        """Ticks a second of an interface."""
        at = 0
        while at + 4 <= len(options):
            code, size = struct.unpack_from(self.order + "HH", options, at)
            if code == RESOLUTION and size and at + 4 < len(options):
                value = options[at + 4]
                return 2 ** (value & 127) if value & 128 else 10**value
            at += 4 + (size + 3) // 4 * 4
        return 10**6

    def plausible(self, data: bytes) -> np.ndarray:
        words = np.frombuffer(data[: len(data) // 4 * 4], self.order + "u4").astype(np.int64)
        size = words[1:]
        return 4 * np.flatnonzero((size >= 12) & (size <= LONGEST_BLOCK) & (size % 4 == 0))

    def length(self, at: int) -> tuple[int, str | None]:
        head = self.window.get(at, 8)
        if len(head) < 8:
            return 0, "cut off in a header"
        size = struct.unpack_from(self.order + "I", head, 4)[0]
        if size < 12 or size % 4 or size > LONGEST_BLOCK:
            return 0, "not a block"
        if at + size > self.window.size:
            return 0, "cut off in a block"
        return (size, None) if self.window.get(at + size - 4, 4) == head[4:] else (0, "lengths of a block differ")

    def row(self, at: int, size: int) -> tuple[int | None, int, bytes] | None:
        kind, body = self._kind(at), self.window.get(at + 8, size - 12)
        if kind == SIMPLE and len(body) >= 4:
            return None, 0, body[4 : 4 + struct.unpack_from(self.order + "I", body)[0]]
        if kind != ENHANCED or len(body) < 20:
            return None
        interface, high, low, n = struct.unpack_from(self.order + "IIII", body)
        unit = self.units[interface] if interface < len(self.units) else 10**6
        return (high << 32 | low) * 10**6 // unit, interface, body[20 : 20 + n]


def opened(file, size: int) -> Classic | Blocks | None:
    """The format of a file by its first bytes."""
    window = _Window(file, size)
    magic = window.get(0, 4)
    if magic in MAGIC:
        return Classic(window, *MAGIC[magic])
    return Blocks(window) if magic == b"\x0a\x0d\x0d\x0a" else None


def _leads_on(form: Classic | Blocks, at: int) -> bool:
    """Whether records from ``at`` follow one another beyond the longest record, or to the file's end."""
    start, size = at, form.window.size
    while at - start <= form.longest + 16:
        n, broken = form.length(at)
        if broken:
            return False
        at += n
        if at == size:
            return True
    return True


def next_record(form: Classic | Blocks, at: int) -> int:
    """The first place from ``at`` on where records lead on; the file's size if there is none."""
    size = form.window.size
    at = -(-at // form.step) * form.step
    while at < size:
        data = form.window.get(at, 1 << 16)
        for i in form.plausible(data).tolist():
            if _leads_on(form, at + i):
                return at + i
        at += max(form.step, (len(data) - 15) // form.step * form.step if len(data) > 15 + form.step else len(data))
    return size


def records(form: Classic | Blocks, start: int, end: int) -> Iterator[tuple[int, int, str | None]]:
    """(position, length, broken) of the records that begin in a byte range."""
    at = form.first
    back = start - 4 * (form.longest + 16)
    if start > form.first and back > form.first:
        at = next_record(form, back)
    while at < end:
        size, broken = form.length(at)
        if at >= start:
            yield at, size, broken
        at = next_record(form, at + form.step) if broken else at + size


def _system(path: str):
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class _Range(InputPartition):
    def __init__(self, file: str, size: int, start: int, end: int) -> None:
        self.file, self.size, self.start, self.end = file, size, start, end


class CaptureReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        self.split = int(options.get("splitbytes", options.get("splitBytes", SPLIT)))
        self.most = int(options.get("maxfilebytes", options.get("maxFileBytes", 0)))
        if self.split < 1:
            raise ValueError("splitBytes must be positive")

    def files(self) -> list[tuple[str, int]]:
        base = self.path
        glob = any(c in posixpath.basename(base) for c in "*?[")
        folder, pattern = posixpath.split(base) if glob else (base, "*")
        system, at = _system(folder)
        info = system.get_file_info(at)
        if info.type == fs.FileType.File:
            found = [info]
        elif info.type == fs.FileType.Directory:
            found = [i for i in system.get_file_info(fs.FileSelector(at)) if i.type == fs.FileType.File and fnmatch.fnmatch(i.base_name, pattern) and i.base_name.lower().endswith(SUFFIXES)]
        else:
            raise FileNotFoundError(self.path)
        head = folder[: len(folder) - len(at)] if folder.endswith(at) else ""
        if self.most and any(i.size > self.most for i in found):
            raise ValueError(f"a capture file is larger than {self.most} bytes")
        return sorted((head + i.path, i.size) for i in found)

    def partitions(self) -> list[InputPartition]:
        return [_Range(f, n, a, min(n, a + self.split)) for f, n in self.files() for a in range(0, n, self.split)] or [_Range("", 0, 0, 0)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        if not partition.size:
            return
        system, at = _system(partition.file)
        with system.open_input_file(at) as file:
            form = opened(file, partition.size)
            rows: list[tuple] = [] if form or partition.start else [(partition.file, 0, None, None, None, "not a capture file")]
            held = 0
            for position, size, broken in records(form, partition.start, partition.end) if form else ():
                got = None if broken else form.row(position, size)
                if broken:
                    rows.append((partition.file, position, None, None, None, broken))
                elif got:
                    rows.append((partition.file, position, *got, None))
                    held += len(got[2])
                if len(rows) >= BATCH or held > 4 << 20:
                    yield _batch(rows)
                    rows, held = [], 0
            if rows:
                yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["file", "position", "us", "interface", "frame", "broken"])


class CaptureSource(DataSource):
    """The data source ``capture``."""

    @classmethod
    def name(cls) -> str:
        return "capture"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> CaptureReader:
        return CaptureReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make ``spark.read.format("capture")`` known to the session."""
    spark.dataSource.register(CaptureSource)
