"""Vectorised text primitives over Arrow string columns.

Texts are handled as one byte array plus offsets, so that whole batches of
documents are tokenised and hashed by a few numpy passes.
"""

from __future__ import annotations

import ctypes
import ctypes.util
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; a longer text is handled alone.
CHUNK_BYTES = 1 << 19

_BASE = 0x9E3779B97F4A7C15 | 1
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_libc = ctypes.CDLL(ctypes.util.find_library("c")) if ctypes.util.find_library("c") else None
if not hasattr(_libc, "malloc_trim"):
    _libc = None


def mix(x: np.ndarray) -> np.ndarray:
    """Finalising 64-bit mixer (the splitmix64 constants)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _tables() -> tuple[np.ndarray, np.ndarray]:
    code = np.arange(256)
    lower = code.astype(np.uint8)
    lower[65:91] += 32
    word = ((code >= 0x30) & (code <= 0x39)) | ((code >= 0x61) & (code <= 0x7A)) | (code >= 0x80)
    return lower, word


LOWER, WORD = _tables()


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64."""
    size = 1 << max(16, int(n - 1).bit_length())
    if size not in _powers:
        _powers.clear()
        up = np.ones(size, np.uint64)
        down = np.ones(size, np.uint64)
        for out, base in ((up, _BASE), (down, pow(_BASE, -1, 1 << 64))):
            done = 1
            while done < size:
                out[done : 2 * done] = out[:done] * np.uint64(pow(base, done, 1 << 64))
                done *= 2
        _powers[size] = up, down
    return _powers[size]


def view(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    if data is None:
        return np.empty(0, np.uint8), np.zeros(n + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def sliced(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches at row bounds so that each holds about ``limit`` bytes of text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        length = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        group = np.cumsum(length.astype(np.int64)) // limit
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)


#: What this worker keeps for the tasks that follow, by the name of its use.
_kept: dict[str, dict] = {}


def kept(name: str) -> dict:
    """The worker's memory of one use; the next task of any other use drops it."""
    return _kept.setdefault(name, {})


def trimmed(batches: Iterator[pa.RecordBatch], keep: str = "") -> Iterator[pa.RecordBatch]:
    """Pass batches on; at the task's end give freed memory back to the system.

    Workers live on between tasks and stages, and neither the allocator nor
    Arrow's pool returns the peaks of a task by itself.  What is kept for
    another use than ``keep`` goes before the task starts.
    """
    others = [name for name in _kept if name != keep]
    for name in others:
        del _kept[name]
    if others:
        _trim()
    yield from batches
    _powers.clear()
    _trim()


def _trim() -> None:
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


def separated(data: np.ndarray, offsets: np.ndarray, gap: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The texts with one ``gap`` byte after each, and the new starts (n + 1)."""
    n = len(offsets) - 1
    out = np.full(len(data) + n, gap, np.uint8)
    keep = np.ones(len(out), bool)
    keep[offsets[1:] + np.arange(n)] = False
    out[keep] = data
    return out, offsets + np.arange(n + 1)


def words(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the A-Z-lowered texts.

    Returns ``hash`` (uint64), ``doc`` (row of each word), ``first`` (n + 1
    word offsets per row), ``start`` and ``end`` (byte span in ``bytes``),
    and ``bytes``, the lowered texts with one zero byte after each.
    """
    text, starts = separated(data, offsets)
    text = LOWER[text]
    inside = WORD[text]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False]))))
    start, end = edge[::2], edge[1::2]
    up, down = powers(len(text) + 1)
    total = np.zeros(len(text) + 1, np.uint64)
    np.cumsum((text.astype(np.uint64) + np.uint64(1)) * up[: len(text)], out=total[1:])
    code = mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
    first = np.searchsorted(start, starts)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    return {"hash": code, "doc": doc, "first": first, "start": start, "end": end, "bytes": text, "starts": starts}


def grams(code: np.ndarray, k: int) -> np.ndarray:
    """Rolling hashes of ``k`` consecutive word hashes (empty if there are fewer)."""
    n = len(code) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for j in range(k):
        total = total * np.uint64(0x100000001B3) + code[j : j + n]
    return mix(total)


def shingles(w: dict[str, np.ndarray], k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word k-shingles of every row and their n + 1 offsets.

    A row with 1 to k - 1 words has one shingle of all its words; a row
    without words has none.  Repeats are kept.
    """
    code, first = w["hash"], w["first"]
    count = np.diff(first)
    number = np.where(count >= k, count - k + 1, (count > 0).astype(np.int64))
    offsets = np.concatenate(([0], np.cumsum(number)))
    out = np.empty(offsets[-1], np.uint64)
    if offsets[-1] == 0:
        return out, offsets
    rolled = grams(code, k)
    long = count >= k
    at = np.arange(offsets[-1]) - np.repeat(offsets[:-1], number) + np.repeat(first[:-1], number)
    of_long = np.repeat(long, number)
    out[of_long] = rolled[at[of_long]]
    for i in np.flatnonzero((count > 0) & ~long):
        part = code[first[i] : first[i + 1]]
        out[offsets[i]] = mix(np.array([int(grams(part, len(part))[0]) ^ len(part)], np.uint64))[0]
    return out, offsets


def complete_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 4096) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups and a group number per row, from rows sorted by ``keys``."""
    pending: list[pa.RecordBatch] = []
    held = 0

    def numbered(table: pa.Table) -> np.ndarray:
        new = np.zeros(table.num_rows, bool)
        for k in keys:
            v = table[k].to_numpy()
            new[1:] |= v[1:] != v[:-1]
        return np.cumsum(new)

    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            part = batch.slice(a, rows)
            pending.append(part)
            held += part.num_rows
            if held < rows:
                continue
            table = pa.Table.from_batches(pending)
            group = numbered(table)
            cut = int(np.searchsorted(group, group[-1])) if len(group) else 0
            if cut:
                yield table.slice(0, cut), group[:cut]
                pending = table.slice(cut).to_batches()
                held = table.num_rows - cut
    if held:
        table = pa.Table.from_batches(pending)
        yield table, numbered(table)


def pairs_at(group: np.ndarray, distance: int) -> np.ndarray:
    """Rows i whose row i + distance is in the same group."""
    return np.flatnonzero(group[:-distance] == group[distance:]) if distance < len(group) else np.empty(0, np.int64)


def matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """A list column of constant length as a matrix."""
    column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
