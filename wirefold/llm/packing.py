"""Pack a token stream into fixed windows by dynamic programming.

Documents stay in order.  A partition's documents form one stream of token ids
(each document's ids, then its end id); windows cut it at document ends, at
sentence ends, or, for more, at places inside long sentences.  The cost of a
window (i, j] is its padding, ``width - (j - i)``, or none if its length is a
power of two, plus the truncation penalty of the cut at j and a small cost per
window.  With f(j) the least cost up to cut j,

    f(j) = penalty(j) + 1 + min( width - j + min of f(i) + i over j - width <= i < j,
                                 min of f(j - 2**k) over k )

The first minimum slides, so a monotone queue gives it in constant time; the
second looks at the few cuts that lie a power of two back.

Decisions are final as far as all cuts that a coming window may start at share
their past.  What lies before leaves the memory; so a task holds a short
stretch of its stream, whatever its partition's size.  Where cuts don't agree for
``HORIZON`` tokens, the best of them is taken, which costs at most one window's
padding and penalty a horizon.
"""

from __future__ import annotations

import re
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, written
from .textvec import sliced
from .token_binary import _INNER, KEEP, Encoder, Words, _Odd, encoder_of, gathered, words_of

#: Penalties of cuts, in tokens of padding.
DOCUMENT, SENTENCE, INSIDE, WINDOW = 0, 4, 12, 1
#: Sentences of more tokens than LONG may also be cut every SPACING tokens.
LONG, SPACING = 96, 61
#: Tokens gathered before windows are chosen, and tokens after which they are
#: settled even where cuts don't agree.
STEP, HORIZON = 1 << 16, 1 << 20
#: Bytes of text whose pieces are looked up together, and of remembered pieces.
BATCH_BYTES, MEMORY = 1 << 23, 64 << 20
_SENTENCE = re.compile(r"[.!?] ")


def sentence_ids(encoder: Encoder, text: str) -> tuple[bytes, list[int]]:
    """Ids of a whole text, and the number of ids up to each sentence end and the text's end.

    A sentence ends at a full stop, question or exclamation mark before a space.
    """
    width = encoder.dtype.itemsize
    ends = [m.start() + 1 for m in _SENTENCE.finditer(text)]
    ends.append(len(text))
    if encoder.by_piece:
        first, rest = encoder.first, encoder.rest

        def pieces() -> tuple[bytes, list[int]]:
            head, *tail = text[: ends[0]].split(" ")
            parts = [first[head] + b"".join(map(rest.__getitem__, tail))]
            for a, b in zip(ends, ends[1:]):
                parts.append(b"".join(map(rest.__getitem__, text[a + 1 : b].split(" "))))
            return b"".join(parts), np.cumsum([len(x) // width for x in parts]).tolist()

        try:
            return pieces()
        except _Odd:
            if not _INNER.search(text):
                first.odd = rest.odd = True
                try:
                    return pieces()
                finally:
                    first.odd = rest.odd = False
    found = encoder.tokenizer.encode(text, add_special_tokens=False)
    starts = np.array([a for a, _ in found.offsets], np.int64)
    cuts = np.searchsorted(np.maximum.accumulate(starts) if len(starts) else starts, ends[:-1])
    return np.array(found.ids, encoder.dtype).tobytes(), [*cuts.tolist(), len(found.ids)]


def batch_ids(encoder: Encoder, column: pa.Array, words: Words) -> Iterator[tuple[bytes, list[int]]]:
    """``sentence_ids`` of every text of a column (null: empty, without ids).

    Each distinct piece of the batch is looked up once; the ids of all texts
    are then gathered from those of the pieces.
    """
    texts = pc.fill_null(column.cast(pa.large_string()), "")
    if not encoder.by_piece or not len(texts):
        yield from (sentence_ids(encoder, t) if t else (b"", [0]) for t in texts.to_pylist())
        return
    pieces, code, bounds, strange, ids, upto = gathered(encoder, texts, words)
    stops = [pc.ends_with(pieces, mark) for mark in ".!?"]
    sentence = pc.or_(pc.or_(stops[0], stops[1]), stops[2]).to_numpy(zero_copy_only=False)[code]
    sentence[bounds[1:] - 1] = False
    marks = np.flatnonzero(sentence)
    cut = np.searchsorted(marks, bounds)
    for i in range(len(texts)):
        if strange[i]:
            text = texts[i].as_py()
            yield sentence_ids(encoder, text) if text else (b"", [0])
            continue
        a, b = upto[bounds[i]], upto[bounds[i + 1]]
        yield ids[a:b].tobytes(), [*(upto[marks[cut[i] : cut[i + 1]] + 1] - a).tolist(), int(b - a)]


class Windows:
    """Least-cost cuts of a stream that is given bit by bit.

    ``add`` takes further cut positions (ascending) and their penalties;
    ``settled`` gives the window ends that no later position can change.
    """

    def __init__(self, width: int) -> None:
        self.width = width
        self.powers = [1 << k for k in range((width - 1).bit_length()) if 1 << k < width]
        self._start(0)

    def _start(self, at: int) -> None:
        self.at = [at]  # cut positions from the last settled one on
        self.cost, self.back, self.penalty = [0], [0], [0]
        self.queue: deque = deque([(at, at, 0)])  # (f(i) + i, position, index), ascending

    def add(self, cuts: list[int], penalties: list[int]) -> None:
        at, cost, back, queue, width = self.at, self.cost, self.back, self.queue, self.width
        known = len(at)
        at += cuts
        self.penalty += penalties
        low = max(0, int(np.searchsorted(at[:known], cuts[0] - width))) if cuts else 0
        near, new = np.array(at[low:], np.int64), np.array(cuts, np.int64)
        jumps: dict[int, list[int]] = {}
        for p in self.powers:
            i = np.searchsorted(near, new - p)
            hit = np.flatnonzero(near[i] == new - p)
            for x, y in zip((hit + known).tolist(), (i[hit] + low).tolist()):
                jumps.setdefault(x, []).append(y)
        for j, (p, extra) in enumerate(zip(cuts, penalties), known):
            while queue[0][1] < p - width:
                queue.popleft()
            value, _, arg = queue[0]
            value += width - p
            for i in jumps.get(j, ()):
                if cost[i] < value:
                    value, arg = cost[i], i
            value += extra + WINDOW
            cost.append(value)
            back.append(arg)
            value += p
            while queue and queue[-1][0] > value:
                queue.pop()
            queue.append((value, p, j))

    def _path(self, last: int) -> list[int]:
        found = []
        while last:
            found.append(self.at[last])
            last = self.back[last]
        return found[::-1]

    def settled(self, end: bool = False) -> list[int]:
        """Ends of the windows that are final; all of them at the stream's end."""
        last = len(self.at) - 1
        if end:
            out = self._path(last)
            self._start(self.at[last])
            return out
        live = int(np.searchsorted(self.at, self.at[last] - self.width))
        shared = set(range(live, last + 1))
        while len(shared) > 1:
            top = max(shared)
            shared.remove(top)
            shared.add(self.back[top])
        root = shared.pop()
        if root == 0 and self.at[last] - self.at[0] > HORIZON:
            root = min(range(live, last + 1), key=lambda i: (self.cost[i], i))
            out, at, penalty = self._path(root), self.at[root:], self.penalty[root:]
            self._start(at[0])
            self.add(at[1:], penalty[1:])
            return out
        out = self._path(root)
        if root:
            self.at, self.penalty = self.at[root:], self.penalty[root:]
            less = self.cost[root]
            self.cost = [x - less for x in self.cost[root:]]
            self.back = [max(0, i - root) for i in self.back[root:]]
            self.queue = deque((v - less, p, i - root) for v, p, i in self.queue if i >= root)
        return out


def cuts_of(start: int, ends: list[int]) -> tuple[list[int], list[int]]:
    """Cut positions and penalties of one document whose sentences end at ``ends``."""
    cuts, penalties, last = [], [], start
    for end in ends:
        end += start
        if end - last > LONG:
            inside = range(last + SPACING, end, SPACING)
            cuts += inside
            penalties += [INSIDE] * len(inside)
        if end > last:
            cuts.append(end)
            penalties.append(SENTENCE)
            last = end
    penalties[-1] = DOCUMENT
    return cuts, penalties


def _tail(cuts: list[int], penalties: list[int], start: int, width: int) -> tuple[list[int], list[int]]:
    """The last cuts of a stream with every position of the last window among them."""
    end = cuts[-1]
    known = dict(zip(cuts, penalties))
    for p in range(max(start + 1, end - width + 1), end):
        known.setdefault(p, INSIDE)
    cuts = sorted(known)
    return cuts, [known[p] for p in cuts]


def packed(documents: Iterator[tuple[object, bytes, list[int]]], dtype: np.dtype, width: int) -> Iterator[tuple]:
    """Pieces of a stream of (id, ids as bytes, sentence ends):

    (id, start, length, crc32 of the ids as 32-bit, document's ids, window number, offset in it).
    """
    windows, held = Windows(width), deque()
    cuts, penalties, total, number, opened = [], [], 0, 0, 0

    def pieces(ends: list[int]) -> Iterator[tuple]:
        nonlocal number, opened
        for end in ends:
            at = opened
            while at < end:
                key, begin, n, wide = held[0]
                stop = min(end, begin + n)
                part = wide[at - begin : stop - begin]
                yield key, at - begin, stop - at, zlib.crc32(part), n, number, at - opened
                if stop == begin + n:
                    held.popleft()
                at = stop
            number, opened = number + 1, end

    gathered = total
    for key, ids, ends in documents:
        wide = np.frombuffer(ids, dtype).astype("<u4")
        # Keep one document back, so that the last one is known to be the last.
        if total - gathered >= STEP:
            windows.add(cuts, penalties)
            cuts, penalties, gathered = [], [], total
            yield from pieces(windows.settled())
        more = cuts_of(total, ends)
        cuts += more[0]
        penalties += more[1]
        held.append((key, total, len(wide), wide))
        total += len(wide)
    if cuts:
        windows.add(*_tail(cuts, penalties, gathered, width))
        yield from pieces(windows.settled(end=True))


def pack(docs: DataFrame, tokenizer_path: str, end_id: int, width: int = 2048, partitions: int | None = None) -> DataFrame:
    """Pack all documents into windows of at most ``width`` tokens, in order of ``doc_id``.

    Returns one row per piece: doc_id, start (its document's ids before it),
    length, ids_crc32, doc_tokens (with the end id), sequence_id, offset
    (within the sequence).  Every id of every document lies in exactly one
    piece; a sequence is a gapless range of consecutive pieces of at most
    ``width`` ids; only sequences whose length is no power of two need padding.

    A null or empty text is a document of its end id alone; a null ``doc_id``
    comes first, and repeated ones are ordered by text, as equal rows are
    alike; texts of any length are taken whole; other columns are ignored; an
    empty table gives no rows.
    """
    if width < LONG + SPACING:
        raise ValueError(f"width must be at least {LONG + SPACING}")
    spark = docs.sparkSession
    number = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, part = encoder_of(tokenizer_path), TaskContext.get().partitionId()
        words = words_of(encoder, MEMORY)
        dtype = encoder.dtype if end_id <= np.iinfo(encoder.dtype).max else np.dtype("<u4")
        last = np.array([end_id], dtype).tobytes()

        def documents() -> Iterator[tuple[object, bytes, list[int]]]:
            for batch in sliced(batches, limit=BATCH_BYTES):
                for key, (ids, ends) in zip(batch.column(0).to_pylist(), batch_ids(encoder, batch.column(1), words)):
                    if dtype != encoder.dtype:
                        ids = np.frombuffer(ids, encoder.dtype).astype(dtype).tobytes()
                    ends[-1] += 1
                    yield key, ids + last, ends

        rows: list[tuple] = []
        for piece in packed(documents(), dtype, width):
            rows.append(piece)
            if len(rows) == 4096:
                yield _batch(part, rows)
                rows = []
        if rows:
            yield _batch(part, rows)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = rows.withColumn("_start", F.substring("text", 1, 64)).repartitionByRange(number, "doc_id", "_start")
    rows = rows.select("doc_id", "text").sortWithinPartitions("doc_id", "text")
    found = written(mapped(rows, step, _SCHEMA, KEEP), "pieces")
    # One row a partition: its number of sequences, then the sum before it.
    counts = sorted((r.part, r.n) for r in found.groupBy("part").agg((F.max("sequence") + 1).alias("n")).collect())
    base, at = [], 0
    for part, n in counts:
        base.append((part, at))
        at += n
    bases = F.broadcast(spark.createDataFrame(base, "part int, base long"))
    return found.join(bases, "part").select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("base") + F.col("sequence")).alias("sequence_id"), "offset"
    )


_SCHEMA = "part int, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence long, offset long"


def _batch(part: int, rows: list[tuple]) -> pa.RecordBatch:
    columns = [pa.array([part] * len(rows), pa.int32()), *(pa.array(c, pa.int64()) for c in zip(*rows))]
    return pa.RecordBatch.from_arrays(columns, ["part", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence", "offset"])
