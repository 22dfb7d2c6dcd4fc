"""Long repeated byte strings, found with run-compressed Burrows-Wheeler indexes.

A byte is removed if a ``window``-byte string (within one text) that covers it
starts at another place too.  Sorting all suffixes of a corpus in one index
does not distribute, so the index is cut by content: winnowing picks in every
window at least one anchor gram, by content alone, so both places of a
repeated window pick the same anchor at the same offset.  All contexts of one
anchor form one index.  Contexts that are equal are one entry with a count.

Within an index the suffixes are aligned at the anchor.  Their order by right
context is the anchor's suffix-array interval; each step to the left is the
LF mapping of that interval: the column of preceding bytes is run-length
compressed, whole runs are moved, matches inside a run grow by one byte, and
only at run ends (whose neighbours are sampled) a range minimum is taken.  The
matching statistic of a suffix, streamed along with the steps, is the longer
of its matches with its two neighbours; from ``window`` bytes on it marks its
text.  An index with too many entries is split by the position of the window
around the anchor, on and on, down to single windows, so no task holds an
unbounded one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_broadcast, extended, mapped, written
from .textvec import complete_groups, mix, powers, separated, sliced, view

WINDOW = 400
GRAM = 32
#: Most entries of one index; beyond it the index is split.
LIMIT = 40_000
SPLIT = 8
#: Windows whose anchors are found at once; far fewer than ``_POS``.
BLOCK = 1 << 20
_POS = np.uint64((1 << 28) - 1)
_PAD = 0xFF  # never a byte of UTF-8
#: Words of a passage, and bytes (of seven bits) that stand for one word.
PASSAGE = 51
CODE = 6
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def anchors(data: np.ndarray, offsets: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor positions in ``data``, their rows and their gram hashes.

    Every ``window`` bytes of a text hold the rightmost of their smallest gram
    hashes as an anchor.  BLOCK windows are handled at once, so a text of any
    length takes bounded memory and no position outgrows ``_POS``.
    """
    starts = len(data) - window + 1
    if starts < 1:
        none = np.empty(0, np.int64)
        return none, none, none.astype(np.uint64)
    found = [_anchors(data, offsets, a, min(a + BLOCK, starts), window, gram) for a in range(0, starts, BLOCK)]
    at, code = (np.concatenate(x) for x in zip(*found))
    new = np.ones(len(at), bool)
    new[1:] = at[1:] != at[:-1]
    at, code = at[new], code[new]
    return at, np.searchsorted(offsets, at, side="right") - 1, code


def _anchors(data: np.ndarray, offsets: np.ndarray, first: int, last: int, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Anchor and its gram hash of each window that starts in data[first:last]."""
    code = data[first : last + window - 1].astype(np.uint64) + np.uint64(1)
    done, factor = 1, 0xD6E8FEB86659FD93
    while done < gram:
        step = min(done, gram - done)
        if step == done:
            code = code[:-done] * np.uint64(factor) + code[done:]
            factor = factor * factor % (1 << 64)
            done *= 2
        else:
            raise ValueError("gram must be a power of two")
    code = mix(code)
    span = window - gram + 1
    low = (code & ~_POS) | (_POS - np.arange(len(code), dtype=np.uint64))
    size = 1
    while 2 * size <= span:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if size < span:
        low = np.minimum(low[: len(low) - (span - size)], low[span - size :])
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(np.clip(offsets, first, last)))
    inside = offsets[1:][row] - np.arange(first, last) >= window
    at = (_POS - (low[inside] & _POS)).astype(np.int64)
    new = np.ones(len(at), bool)
    new[1:] = at[1:] != at[:-1]
    at = at[new]
    return at + first, code[at]


def _segment(text: bytes, at: int, window: int, gram: int) -> tuple[bytes, int]:
    """All bytes of windows around the anchor, and how many stand before it."""
    low = max(0, at + gram - window)
    return text[low : at + window], at - low


def _code(*parts: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(b"".join(parts), digest_size=8).digest(), "little", signed=True)


def listed(texts: DataFrame, window: int, gram: int, code: Callable | None = None) -> DataFrame:
    """(k0, k1, text) to one row per anchor; ``seg`` identifies its context.

    ``code`` puts other bytes in the place of a column of texts.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = batch.column("text")
            data, offsets = view(code(texts) if code else texts)
            at, row, grams = anchors(data, offsets, window, gram)
            if not len(at):
                continue
            whole, start, end = data.tobytes(), offsets[row], offsets[row + 1]
            low, high = np.maximum(start, at + gram - window), np.minimum(end, at + window)
            left, size = at - low, high - low
            blake = hashlib.blake2b
            seg = np.frombuffer(b"".join([blake(whole[a:b], digest_size=8, salt=c).digest() for a, b, c in zip(low.tolist(), high.tolist(), left.astype("<u8").view("S8").tolist())]), np.int64)
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [pa.array(grams.view(np.int64)), pa.array(seg), batch.column("k0").take(take), batch.column("k1").take(take),
                 pa.array((at - start).astype(np.int32)), pa.array(left.astype(np.int32)), pa.array(size.astype(np.int32))],
                ["anchor", "seg", "k0", "k1", "pos", "left", "size"],
            )

    return mapped(texts, scan, "anchor long, seg long, k0 long, k1 long, pos int, left int, size int")


def _range_min(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Minimum of values[low:high] for each pair; a large number if empty."""
    out = np.full(len(low), 1 << 30, np.int64)
    some = high > low
    low, high = low[some], high[some]
    if len(low):
        depth = np.frexp(high - low)[1] - 1
        level, got, result = 0, values, np.empty(len(low), np.int64)
        while True:
            mine = depth == level
            if mine.any():
                result[mine] = np.minimum(got[low[mine]], got[high[mine] - (1 << level)])
            if level >= depth.max():
                break
            got = np.minimum(got[: len(got) - (1 << level)], got[1 << level :])
            level += 1
        out[some] = result
    return out


class AnchorIndex:
    """Run-length BWT columns of many aligned groups of contexts at once.

    ``group`` must be ascending.  ``low``/``high`` bound the bytes before the
    anchor at which a window may start.
    """

    def __init__(self, group: np.ndarray, left: np.ndarray, contexts: list[bytes], window: int, gram: int) -> None:
        self.window, n = window, len(contexts)
        self.group, self.left = group, left
        self.right = np.array([len(c) for c in contexts]) - left
        self.reach = window - gram
        self.before = np.full((n, self.reach), _PAD, np.uint8)
        after = np.full((n, window), _PAD, np.uint8)
        for i, (c, a) in enumerate(zip(contexts, left.tolist())):
            both = np.frombuffer(c, np.uint8)
            self.before[i, :a] = both[:a][::-1]
            after[i, : len(c) - a] = both[a:]
        tails = [c[a:] for c, a in zip(contexts, left.tolist())]
        self.order = np.array(sorted(range(n), key=lambda i: (group[i], tails[i] + b"\xff")), np.int64)
        self.match = np.zeros(n, np.int64)
        for a in range(1, n, 4096):
            b = min(n, a + 4096)
            x, y = self.order[a - 1 : b - 1], self.order[a:b]
            differ = after[x] != after[y]
            same = np.where(differ.any(1), differ.argmax(1), window)
            self.match[a:b] = np.where(group[x] == group[y], same, 0)

    def statistics(self) -> np.ndarray:
        """Matching statistics of the current column, in suffix order."""
        return np.maximum(self.match, np.append(self.match[1:], 0))

    def prune(self, column: int) -> None:
        """Drop suffixes that no further step can bring to a full window."""
        keep = self.statistics() + (self.reach - column) >= self.window
        if keep.all():
            return
        start = np.flatnonzero(keep)
        if not len(start):
            self.order, self.match = self.order[:0], self.match[:0]
            return
        # A kept suffix' new match: the least since the kept one before it.
        padded = np.minimum.reduceat(self.match[: start[-1] + 1], np.concatenate(([0], start[:-1] + 1)))
        same = np.concatenate(([False], self.group[self.order[start[1:]]] == self.group[self.order[start[:-1]]]))
        self.order, self.match = self.order[start], np.where(same, padded, 0)

    def step(self, column: int) -> None:
        """LF mapping: put the byte before each suffix in front of it."""
        order, match = self.order, self.match
        n = len(order)
        key = self.group[order] * 256 + self.before[order, column]
        head = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        size = np.diff(np.append(head, n))
        symbol = key[head]
        run = np.argsort(symbol, kind="stable")
        ordered = symbol[run]
        again = np.concatenate(([False], ordered[1:] == ordered[:-1]))
        least = np.minimum.reduceat(match, head)
        grown = match + 1
        fresh = np.zeros(len(run), np.int64)
        if again.any():
            here, there = run[again], run[np.flatnonzero(again) - 1]
            fresh[again] = 1 + np.minimum(match[head[here]], _range_min(least, there + 1, here))
        at = np.cumsum(size[run]) - size[run]
        grown_at = np.repeat(head[run] - at, size[run]) + np.arange(n)
        self.match = grown[grown_at]
        self.match[at] = fresh
        self.order = order[grown_at]

    def marks(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes before and after each anchor that repeated windows cover (0, 0: none)."""
        n = len(self.left)
        before, after = np.full(n, -1), np.zeros(n, np.int64)
        last = int(min(self.reach, high.max(initial=0)))
        for column in range(last + 1):
            row = self.order
            got = np.minimum(self.statistics(), column + self.right[row])
            hit = (got >= self.window) & (self.left[row] >= column) & (low[row] <= column) & (column <= high[row])
            row = row[hit]
            before[row] = column
            after[row] = np.maximum(after[row], got[hit] - column)
            if column < last:
                if column % 8 == 0:
                    self.prune(column)
                if len(self.order) < 2:
                    break
                self.step(column)
        return np.maximum(before, 0), after


_ENTRY = "gkey long, entry long, low int, high int, left int, copies long, context binary"


def _indexed(entries: DataFrame, window: int, gram: int) -> DataFrame:
    """Marks (gkey, entry, before, after) of the entries of whole indexes."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, group in complete_groups(batches, ["gkey"], 8192):
            low, high, left, copies = (table[c].to_numpy().astype(np.int64) for c in ("low", "high", "left", "copies"))
            contexts = table["context"].to_pylist()
            index = AnchorIndex(group.astype(np.int64), left, contexts, window, gram)
            before, after = index.marks(low, high)
            many = (copies > 1) & (np.minimum(left, high) + index.right >= window)
            before[many] = np.minimum(left, high)[many]
            after[many] = index.right[many]
            has = pa.array(np.flatnonzero(after > 0))
            pick = lambda c: table[c].combine_chunks().take(has)
            put = [pa.array(x[after > 0].astype(np.int32)) for x in (before, after)]
            yield pa.RecordBatch.from_arrays([pick("gkey"), pick("entry"), *put], ["gkey", "entry", "before", "after"])

    dealt = entries.repartition("gkey").sortWithinPartitions("gkey")
    return mapped(dealt, build, "gkey long, entry long, before int, after int")


def _split(entries: DataFrame, window: int) -> DataFrame:
    """Cut each entry's range of window starts into SPLIT parts.

    All windows of a part share the bytes that lie in every one of them; that
    core is the key of the part's index, and the bytes of all of the part's
    windows are its new, shorter context.  A part of one window has itself as
    core, so its index has one entry and the splitting ends.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for gkey, entry, low, high, left, copies, context in zip(*(batch.column(i).to_pylist() for i in range(7))):
                step = -(-(high - low + 1) // SPLIT)
                least = window - (len(context) - left)  # windows that start later pass the text's end
                for a in range(low, high + 1, step):
                    b = min(high, a + step - 1)
                    if max(a, least) > min(b, left):
                        continue
                    core = context[left - a : left - b + window]
                    wide = context[max(0, left - b) : left - a + window]
                    lead = min(left, b)
                    bounds = np.array([gkey, a, b], "<i8").tobytes()
                    rows.append((_code(bounds, core), _code(lead.to_bytes(4, "little"), wide), a, b, lead, copies, wide, gkey, entry))
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
                names = [*(f.split()[0] for f in _ENTRY.split(", ")), "parent_gkey", "parent"]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names)

    return mapped(entries, cut, f"{_ENTRY}, parent_gkey long, parent long")


def _keys() -> tuple[F.Column, F.Column]:
    """Two hashes that stand for a text."""
    return F.xxhash64("text"), F.xxhash64(F.lit("second"), "text")


def _spans(texts: DataFrame, window: int, gram: int, limit: int, code: Callable | None = None) -> DataFrame:
    """Byte spans (_k0, _k1, _spans) that repeated windows cover in (k0, k1, text); they may overlap.

    With ``code`` they are those of the bytes that it puts in a text's place.
    """
    places = written(listed(texts, window, gram, code), "repeat-places")
    rep = F.struct("k0", "k1", "pos", "left", "size")
    segs = places.groupBy("anchor", "seg").agg(F.count("*").alias("copies"), F.min(rep).alias("at"))
    segs = written(segs, "repeat-segments")
    many = segs.groupBy("anchor").agg(F.count("*").alias("entries")).where("entries > 1")
    several = segs.join(many, "anchor").select("anchor", "seg", "copies", "at.*", "entries")
    several = written(several, "repeat-several")

    # Contexts of one place per distinct segment.
    wanted = several.groupBy("k0", "k1").agg(F.collect_list(F.struct("anchor", "seg", "copies", "pos", "entries")).alias("places"))
    keys = bounded_broadcast(several.select("k0", "k1").distinct())
    sources = texts.join(keys, ["k0", "k1"], "left_semi").dropDuplicates(["k0", "k1"]).join(wanted, ["k0", "k1"])

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            out = []
            texts = batch.column("text")
            for text, places in zip((code(texts) if code else texts).to_pylist(), batch.column("places").to_pylist()):
                raw = text.encode()
                for p in places:
                    context, left = _segment(raw, p["pos"], window, gram)
                    out.append((p["anchor"], p["seg"], 0, window - gram, left, p["copies"], context, p["entries"]))
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["gkey", "entry", "low", "high", "left", "copies", "context", "entries"])

    entries = mapped(sources.select("text", "places"), contexts, f"{_ENTRY}, entries long")
    entries = written(entries, "repeat-entries")
    small = _indexed(entries.where(F.col("entries") <= limit).drop("entries"), window, gram)
    marks = small.select(F.col("gkey").alias("anchor"), F.col("entry").alias("seg"), "before", "after")
    large = entries.where(F.col("entries") > limit).drop("entries")
    if not large.isEmpty():
        marks = marks.unionByName(_split_marks(large, window, gram, limit))

    # A segment that occurs twice is marked whole, wherever it occurs; others
    # have one place only.
    twice = segs.where(F.col("copies") > 1).where(F.col("at.size") >= window).select(F.col("anchor"), F.col("seg"))
    whole = places.join(twice, ["anchor", "seg"], "left_semi")
    whole = whole.select("k0", "k1", (F.col("pos") - F.col("left")).alias("a"), (F.col("pos") - F.col("left") + F.col("size")).alias("b"))
    single = several.where("copies = 1").join(marks, ["anchor", "seg"])
    single = single.select("k0", "k1", (F.col("pos") - F.col("before")).alias("a"), (F.col("pos") + F.col("after")).alias("b"))
    spans = whole.distinct().unionByName(single).groupBy("k0", "k1").agg(F.collect_list(F.struct("a", "b")).alias("_spans"))
    return written(spans.withColumnsRenamed({"k0": "_k0", "k1": "_k1"}), "repeat-spans")


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, limit: int = LIMIT) -> DataFrame:
    """Adds n_bytes, n_removed, n_spans, kept_sha256 and kept_text to every document.

    Texts are UTF-8 bytes (null: empty, kept_text empty).  A byte is removed
    if a string of ``window`` bytes that covers it also starts anywhere else,
    in this or another text; overlaps count and all is judged on the input.
    Texts shorter than ``window`` lose nothing.  Repeated rows count as
    separate texts.  kept_text is the rest as a binary column (a cut may fall
    within a character).  Input columns of the added names, and of ``_k0``
    and ``_k1``, are replaced; an empty table stays empty.
    """
    added = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"]
    docs = docs.drop(*added, "_k0", "_k1")
    k0, k1 = _keys()
    long = F.octet_length("text") >= window
    spans = _spans(docs.where(long).select(k0.alias("k0"), k1.alias("k1"), "text"), window, gram, limit)
    names = docs.columns
    keyed = docs.withColumn("_k0", F.when(long, k0)).withColumn("_k1", F.when(long, k1))
    # Short and null texts meet no span: a key of their own keeps them apart.
    keyed = keyed.withColumn("_k0", F.coalesce("_k0", F.xxhash64(F.lit("short"), "doc_id"))).withColumn("_k1", F.coalesce("_k1", F.lit(0)))
    met = keyed.join(spans, ["_k0", "_k1"], "left").select(*names, "_spans")
    schema = extended(docs.schema, "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept_text binary")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            out = []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("_spans").to_pylist()):
                raw = (text or "").encode()
                runs: list[list[int]] = []
                for a, b in sorted((s["a"], s["b"]) for s in spans or ()):
                    if runs and a <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], b)
                    else:
                        runs.append([a, b])
                kept = [raw[a:b] for a, b in zip([0, *(r[1] for r in runs)], [*(r[0] for r in runs), len(raw)])]
                removed, number = sum(b - a for a, b in runs), len(runs)
                rest = b"".join(kept)
                out.append((len(raw), removed, number, hashlib.sha256(rest).hexdigest(), rest))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            new = [pa.array(c, t) for c, t in zip(zip(*out), kinds)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *new], [*names, *added])

    return mapped(met, cut, schema)


def word_bytes(texts: pa.Array) -> pa.Array:
    """CODE bytes of a hash in place of each word of each text."""
    text, starts = separated(*view(texts), 32)
    edge = np.flatnonzero(np.diff(np.concatenate(([False], ~_SPACE[text], [False]))))
    start, end = edge[::2], edge[1::2]
    up, down = powers(len(text) + 1)
    total = np.zeros(len(text) + 1, np.uint64)
    np.cumsum((text.astype(np.uint64) + np.uint64(1)) * up[: len(text)], out=total[1:])
    word = mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
    coded = np.empty((len(word), CODE), np.uint8)
    for i in range(CODE):
        coded[:, i] = (word >> np.uint64(7 * i)) & np.uint64(127)
    offsets = np.searchsorted(start, starts) * CODE
    return pa.LargeStringArray.from_buffers(len(starts) - 1, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(coded))


def repeated_words(docs: DataFrame, passage: int = PASSAGE, gram: int = GRAM, limit: int = LIMIT) -> DataFrame:
    """(k0, k1, n_repeat_words) of the texts with a passage that also starts anywhere else.

    Counts the words ``[^\\x20\\x09-\\x0D]+`` that lie in a string of
    ``passage`` words which starts at another place too, in this or another
    row.  The index is that of ``remove_repeats``, over word hashes of 42 bits.
    """
    k0, k1 = _keys()
    texts = docs.where(F.octet_length("text") >= 2 * passage - 1).select(k0.alias("k0"), k1.alias("k1"), "text")
    spans = _spans(texts, CODE * passage, gram, limit, word_bytes)
    whole = lambda x: F.greatest(F.lit(0), F.floor(x["b"] / CODE) - F.ceil(x["a"] / CODE))

    def joined(run: F.Column, s: F.Column) -> F.Column:
        on = s["a"] <= run["b"]
        a, b = F.when(on, run["a"]).otherwise(s["a"]), F.when(on, F.greatest(run["b"], s["b"])).otherwise(s["b"])
        return F.struct(a.alias("a"), b.alias("b"), (run["n"] + F.when(on, F.lit(0)).otherwise(whole(run))).alias("n"))

    none = F.struct(F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(0).cast("long").alias("n"))
    n = F.aggregate(F.array_sort("_spans"), none, joined, lambda run: run["n"] + whole(run))
    return spans.select(F.col("_k0").alias("k0"), F.col("_k1").alias("k1"), n.alias("n_repeat_words"))


def _split_marks(large: DataFrame, window: int, gram: int, limit: int) -> DataFrame:
    """Marks of oversized indexes, by splitting them until they fit."""
    # Every entry of the current level, by the (gkey, entry) of the first.
    names = large.select("gkey", "entry", F.col("gkey").alias("anchor"), F.col("entry").alias("seg"))
    out, level = None, large
    while True:
        cut = written(_split(level, window), "repeat-split")
        names = written(
            names.join(cut.select("parent_gkey", "parent", F.col("gkey").alias("g"), F.col("entry").alias("e")).distinct(), (F.col("gkey") == F.col("parent_gkey")) & (F.col("entry") == F.col("parent")))
            .select(F.col("g").alias("gkey"), F.col("e").alias("entry"), "anchor", "seg").distinct(),
            "repeat-names",
        )
        level = cut.groupBy("gkey", "entry").agg(F.sum("copies").alias("copies"), F.min(F.struct("low", "high", "left", "context")).alias("x"))
        level = level.select("gkey", "entry", "x.low", "x.high", "x.left", "copies", "x.context")
        number = level.groupBy("gkey").agg(F.count("*").alias("entries"))
        level = written(level.join(number, "gkey"), "repeat-level")
        got = _indexed(level.where(F.col("entries") <= limit).drop("entries"), window, gram)
        got = got.join(names, ["gkey", "entry"]).select("anchor", "seg", "before", "after")
        got = written(got, "repeat-marks")
        out = got if out is None else out.unionByName(got)
        level = level.where(F.col("entries") > limit).drop("entries")
        if level.isEmpty():
            return out
