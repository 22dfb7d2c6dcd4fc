"""Big JSON arrays in byte ranges: one row for each element.

Where an element starts depends on everything before it: on quotes, escapes
and brackets.  A first pass counts, for each range and each state it may start
in (behind an odd run of backslashes or not, inside a string or not), how the
state and the depth change.  One small row a range reaches the driver, which
chains them; then every range knows its state and cuts its own elements.  An
element belongs to the range that it starts in, which reads on to its end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPLIT = 32 << 20
#: Bytes read at once behind a range's end.
MORE = 1 << 16
_OPEN, _CLOSE, _QUOTE, _ESCAPE, _COMMA = (np.frombuffer(x, np.uint8) for x in (b"[{", b"]}", b'"', b"\\", b","))
RANGE = "file string, size long, start long, end long"


def _system(path: str):
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def marks(data: bytes, escaped: bool, inside: bool) -> tuple[np.ndarray, np.ndarray, bool, bool]:
    """Depth change at each byte, whether it is a comma that counts, and the state behind the last.

    ``escaped``: the first byte stands behind an odd run of backslashes;
    ``inside``: it stands in a string.
    """
    raw = np.frombuffer(data, np.uint8)
    n = len(raw)
    slash = raw == _ESCAPE[0]
    # Backslashes right before each byte (n + 1 places), the range before included.
    last = np.concatenate(([-1], np.maximum.accumulate(np.where(slash, -1, np.arange(n))))) if n else np.array([-1])
    hit = (np.arange(n + 1) - 1 - last + (last == -1) * escaped) % 2 == 1
    quote = (raw == _QUOTE[0]) & ~hit[:n]
    # A quote that opens counts as inside already, one that closes as outside.
    within = (np.cumsum(quote) + inside) % 2 == 1
    free = ~within & ~quote
    step = (np.isin(raw, _OPEN) & free).astype(np.int64) - (np.isin(raw, _CLOSE) & free)
    return step, (raw == _COMMA[0]) & free, bool(hit[n]), bool(within[-1]) if n else inside


def _ranges(spark: SparkSession, path: str, split: int) -> DataFrame:
    system, at = _system(path)
    info = system.get_file_info(at)
    found = [info] if info.type == fs.FileType.File else [i for i in system.get_file_info(fs.FileSelector(at, recursive=True)) if i.type == fs.FileType.File and not i.base_name.startswith((".", "_"))]
    head = path[: len(path) - len(at)] if path.endswith(at) else ""
    rows = [(head + i.path, i.size, a, min(i.size, a + split)) for i in sorted(found, key=lambda i: i.path) for a in range(0, i.size, split)]
    return spark.createDataFrame(rows, RANGE).repartition(max(1, min(len(rows), 10_000)), "file", "start")


def _read(row: dict, start: int, n: int) -> bytes:
    system, at = _system(row["file"])
    with system.open_input_file(at) as file:
        return file.read_at(max(0, min(n, row["size"] - start)), start)


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            data, out = _read(row, row["start"], row["end"] - row["start"]), []
            for escaped in (False, True):
                for inside in (False, True):
                    step, _, e, i = marks(data, escaped, inside)
                    out += [int(step.sum()), int(e), int(i)]
            yield pa.RecordBatch.from_pylist([{"file": row["file"], "start": row["start"], "changes": out}], pa.schema([("file", pa.string()), ("start", pa.int64()), ("changes", pa.list_(pa.int64()))]))


def _elements(row: dict) -> Iterator[tuple[int, str]]:
    """(position, text) of the elements that start in a range."""
    escaped, inside, depth, at = bool(row["escaped"]), bool(row["inside"]), row["depth"], row["start"]
    data, limit = _read(row, at, row["end"] - at), row["end"]
    piece, begun = b"", None  # an element that starts in this range, and where
    if depth == 1 and at > 0 and not inside:
        # The border may lie right behind the comma or bracket before an element.
        before = _read(row, at - 1, 1)
        begun = at if before in (b",", b"[") else None
    while data:
        step, comma, e, i = marks(data, escaped, inside)
        level = depth + np.cumsum(step)
        ends = np.flatnonzero((comma & (level == 1)) | ((step == -1) & (level == 0)))
        opens = np.flatnonzero((step == 1) & (level == 1) & (np.frombuffer(data, np.uint8) == ord("[")))
        cursor = 0
        for p in np.union1d(ends, opens).tolist():
            if begun is not None and step[p] != 1:
                yield begun, (piece + data[cursor:p]).decode("utf-8", "replace")
                piece, begun = b"", None
            if step[p] != -1:
                if at + p + 1 >= limit:
                    return
                begun, cursor, piece = at + p + 1, p + 1, b""
        if begun is None:
            return  # nothing open: the next range goes on
        piece += data[cursor:]
        at, depth, escaped, inside = at + len(data), int(level[-1]) if len(level) else depth, e, i
        data = _read(row, at, MORE)


def array_elements(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """(file, position, value) for each element of the JSON array in each file of ``path``.

    ``value`` is the element's text.  White space around elements is cut off;
    an empty array gives no rows; what stands outside the array is ignored.
    """
    ranges = _ranges(spark, path, split)
    found = ranges.mapInArrow(_summaries, "file string, start long, changes array<long>").collect()  # a row of twelve numbers a range
    states, file = [], None
    for r in sorted(found, key=lambda r: (r.file, r.start)):
        if r.file != file:
            file, depth, escaped, inside = r.file, 0, 0, 0
        states.append((r.file, r.start, depth, escaped, inside))
        change, escaped, inside = r.changes[3 * (2 * escaped + inside) :][:3]
        depth += change
    known = F.broadcast(spark.createDataFrame(states, "file string, start long, depth long, escaped int, inside int"))
    rows = ranges.join(known, ["file", "start"]).select("file", "size", "start", "end", "depth", "escaped", "inside")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                some: list[tuple] = []
                for position, text in _elements(row):
                    if text.strip():
                        some.append((row["file"], position, text.strip()))
                    if len(some) == 4096:
                        yield _batch(some)
                        some = []
                if some:
                    yield _batch(some)

    return rows.mapInArrow(cut, "file string, position long, value string")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.string()))], ["file", "position", "value"])


def read_array(spark: SparkSession, path: str, schema: str, split: int = SPLIT) -> DataFrame:
    """The elements as rows of ``schema``; elements that are no objects of it are left out."""
    rows = array_elements(spark, path, split).select(F.from_json("value", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("r"))
    return rows.where("r IS NOT NULL AND r._bad IS NULL").select("r.*").drop("_bad")
