"""Periodic runs of words: stretches that repeat one block several times.

A run is a stretch of consecutive words with smallest period q and a length of
at least ``max(min_length, min_exponent * q)`` that no neighbouring word
extends.  Two steps find all of them:

1. Masking.  A run of length L and period q overlaps its own copy, q words on,
   in L - q words, so each of its words lies in a k-gram that occurs twice in
   the document, where k is the least L - q over all periods.  Words outside
   such k-grams cannot join a run; the others form segments.
2. Main-Lorentz on the segments.  Centres at odd multiples of h = 1, 2, 4, ...
   stand for a divide and conquer: every run crosses exactly one centre of its
   highest level, where its period is at most 2h / min_exponent and one side
   holds half of it.  For each centre and period the equal stretch of words
   and words one period on is extended to both sides; a stretch of m words of
   period p is a run of m + p words.  Extensions come from identifiers of all
   substrings of 2^i words (doubling), so one level is a few array operations
   over all segments at once.

All comparisons are exact but those of the mask, whose hash collisions can
only keep more words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import extended, mapped
from .textvec import grams, mix, sliced

#: Centre and period pairs tested at once.
GRID = 1 << 20
COLUMNS = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def least_overlap(min_length: int, min_exponent: int) -> int:
    """Least number of words that a run shares with its copy one period on."""
    return min(max(min_length, min_exponent * q) - q for q in range(1, min_length + 1))


def masked_segments(words: np.ndarray, doc: np.ndarray, k: int) -> np.ndarray:
    """Whether each word lies in a k-gram that its document holds twice."""
    n = len(words)
    if n < k:
        return np.zeros(n, bool)
    key = mix(grams(mix(words.astype(np.uint64)), k) ^ mix(doc[: n - k + 1].astype(np.uint64)))
    whole = np.flatnonzero(doc[: n - k + 1] == doc[k - 1 :])
    order = whole[np.argsort(key[whole], kind="stable")]
    same = key[order[1:]] == key[order[:-1]]
    edges = np.zeros(n + 1, np.int64)
    for at in (order[1:][same], order[:-1][same]):
        np.add.at(edges, at, 1)
        np.add.at(edges, at + k, -1)
    return np.cumsum(edges[:-1]) > 0


class _Substrings:
    """Identifiers of all substrings of 1, 2, 4, ... words; equal ones share one."""

    def __init__(self, words: np.ndarray, longest: int) -> None:
        n = len(words)
        self.n, self.ids, width = n, [words.astype(np.int64)], 1
        while 2 * width <= longest:
            last = self.ids[-1]
            ahead = np.concatenate((last[width:], n + np.arange(min(width, n))))[:n]  # past the end: like nothing
            self.ids.append(np.unique(last * (2 * n + 1) + ahead, return_inverse=True)[1])
            width *= 2

    def equal(self, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the ``length`` words from a and from b (both inside) are the same."""
        out = np.zeros(len(a), bool)
        level = np.minimum(np.frexp(length)[1] - 1, len(self.ids) - 1)
        for i in np.unique(level):
            at = np.flatnonzero(level == i)
            x, y, rest = a[at], b[at], length[at] - (1 << i)
            ids = self.ids[i]
            out[at] = (rest <= 1 << i) & (ids[x] == ids[y]) & (ids[x + rest] == ids[y + rest])
        return out

    def forward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words from a on equal those from b > a on."""
        done = np.zeros(len(a), np.int64)
        # The top level may repeat, as no substring is longer than a segment.
        for i in range(len(self.ids) - 1, -1, -1):
            ids = self.ids[i]
            while True:
                y = b + done
                ok = y < self.n
                ok[ok] = ids[(a + done)[ok]] == ids[y[ok]]
                done[ok] += 1 << i
                if i < len(self.ids) - 1 or not ok.any():
                    break
        return done

    def backward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words before a equal those before b > a."""
        done = np.zeros(len(a), np.int64)
        for i in range(len(self.ids) - 1, -1, -1):
            ids = self.ids[i]
            while True:
                x = a - done - (1 << i)
                ok = x >= 0
                ok[ok] = ids[x[ok]] == ids[(b - done - (1 << i))[ok]]
                done[ok] += 1 << i
                if i < len(self.ids) - 1 or not ok.any():
                    break
        return done


def runs_of(words: np.ndarray, longest: int, min_length: int, min_exponent: int) -> np.ndarray:
    """All runs as rows (start, end, period) of a word array.

    Stretches that no run may cross are kept apart by words that occur once;
    ``longest`` bounds their length.
    """
    n, found = len(words), [np.empty((0, 3), np.int64)]
    same = _Substrings(np.unique(words, return_inverse=True)[1], longest)
    h = 1
    while h < n:
        top = min(2 * h, longest) // min_exponent
        centres = np.arange(h, n, 2 * h)
        step = max(1, GRID // max(1, top))
        for first in range(0, len(centres) if top else 0, step):
            c, p = (x.ravel() for x in np.meshgrid(centres[first : first + step], np.arange(1, top + 1), indexing="ij"))
            need = (np.maximum(min_length, min_exponent * p) + 1) // 2 - p  # equal words on the side with half the run
            for a in (c, c - p - need):
                ok = (a >= 0) & (a + need + p <= n)
                ok[ok] = same.ids[0][a[ok]] == same.ids[0][a[ok] + p[ok]]
                ok[ok] = same.equal(a[ok], a[ok] + p[ok], need[ok])
                x, q = a[ok], p[ok]
                start, end = x - same.backward(x, x + q), x + q + same.forward(x, x + q)
                long = end - start >= np.maximum(min_length, min_exponent * q)
                found.append(np.unique(np.stack((start, end, q), 1)[long], axis=0))
        h *= 2
    rows = np.unique(np.concatenate(found), axis=0)
    if len(rows):  # multiples of the smallest period give the same stretch
        rows = rows[np.concatenate(([True], (rows[1:, :2] != rows[:-1, :2]).any(axis=1)))]
    return rows


def batch_runs(texts: list[list[bytes]], min_length: int, min_exponent: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs of many documents: rows (start, end, period) over their joined words, and word offsets."""
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
    flat = [w for t in texts for w in t]
    empty = np.empty((0, 3), np.int64)
    if len(flat) < min_length:
        return empty, offsets
    codes = pa.array(flat, pa.large_binary()).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    doc = np.repeat(np.arange(len(texts)), np.diff(offsets))
    kept = masked_segments(codes, doc, least_overlap(min_length, min_exponent))
    new = np.concatenate(([True], doc[1:] != doc[:-1]))
    begin = np.flatnonzero(kept & (new | ~np.concatenate(([False], kept[:-1]))))
    close = np.flatnonzero(kept & np.concatenate((new[1:] | ~kept[1:], [True]))) + 1
    long = close - begin >= min_length
    begin, close = begin[long], close[long]
    if not len(begin):
        return empty, offsets
    # Segments side by side, a word of its own behind each.
    size = close - begin
    at = np.concatenate(([0], np.cumsum(size + 1)))
    place = np.arange(at[-1]) - np.repeat(at[:-1], size + 1) + np.repeat(begin, size + 1)
    gap = at[1:] - 1
    words = codes[np.minimum(place, len(codes) - 1)]
    words[gap] = codes.max() + 1 + np.arange(len(gap))
    rows = runs_of(words, int(size.max()), min_length, min_exponent)
    rows[:, 1] += place[rows[:, 0]] - rows[:, 0]
    rows[:, 0] = place[rows[:, 0]]
    return rows, offsets


def periodic_runs(
    docs: DataFrame, min_length: int = 6, min_exponent: int = 4, rewrite: Callable[[int | None, list[bytes]], list[bytes]] | None = None, texts: bool = False
) -> DataFrame:
    """All runs of every document, and its text with each run cut to one period.

    ``docs`` has ``doc_id`` and ``text``; words are what ASCII white space
    separates.  ``rewrite`` may change a document's words first.  Returns one
    row per input row: doc_id, n_runs, the longest run (start, length, period,
    exponent_milli; ties: smallest start, then period; nulls without a run),
    digests of the run list and of the collapsed text; with ``texts`` also
    ``runs`` (array of start, length, period) and ``collapsed`` themselves.

    A null or empty text has no words and no run; a null ``doc_id`` and
    repeated rows keep their rows; other columns are ignored; a text of any
    length is taken whole, by itself.  Nothing is shuffled.
    """
    if min_exponent < 3:
        raise ValueError("min_exponent must be 3 or more")
    from pyspark.sql.types import StructType

    more = ", runs array<struct<start: long, length: long, period: long>>, collapsed string" if texts else ""
    schema = extended(StructType([docs.schema["doc_id"]]), COLUMNS + more)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            ids = batch.column(0)
            found = [(t or b"").split() for t in batch.column(1).cast(pa.large_binary()).to_pylist()]
            if rewrite:
                found = [rewrite(i, w) for i, w in zip(ids.to_pylist(), found)]
            rows, offsets = batch_runs(found, min_length, min_exponent)
            drop = np.zeros(offsets[-1] + 1, np.int64)
            np.add.at(drop, rows[:, 0] + rows[:, 2], 1)
            np.add.at(drop, rows[:, 1], -1)
            drop = np.cumsum(drop[:-1]) > 0
            rows = rows[np.lexsort((rows[:, 2], rows[:, 0]))]
            cut = np.searchsorted(rows[:, 0], offsets)
            out: dict[str, list] = {c.split()[0]: [] for c in COLUMNS.split(", ")}
            lists, collapsed = [], []
            for i, words in enumerate(found):
                runs = [(s - offsets[i], e - s, q) for s, e, q in rows[cut[i] : cut[i + 1]].tolist()]
                best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
                if runs:
                    gone = drop[offsets[i] : offsets[i + 1]].tolist()
                    words = [w for w, x in zip(words, gone) if not x]
                text = b" ".join(words)
                out["n_runs"].append(len(runs))
                for name, value in zip(("start", "length", "period"), best):
                    out[name].append(None if value is None else int(value))
                out["exponent_milli"].append(None if not runs else int(1000 * best[1] // best[2]))
                out["runs_sha256"].append(hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest())
                out["collapsed_sha256"].append(hashlib.sha256(text).hexdigest())
                if texts:
                    lists.append([{"start": int(s), "length": n, "period": q} for s, n, q in runs])
                    collapsed.append(text.decode())
            columns = [ids, *(pa.array(v, pa.string() if k.endswith("256") else pa.int64()) for k, v in out.items())]
            if texts:
                kind = pa.list_(pa.struct([(x, pa.int64()) for x in ("start", "length", "period")]))
                columns += [pa.array(lists, kind), pa.array(collapsed, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return mapped(docs.select("doc_id", "text"), step, schema)
