"""Language identification by interpolated Kneser-Ney character models.

Training counts every character 5-gram of all training texts, per language,
with Spark; lower orders are Kneser-Ney continuation counts derived from
them.  An n-gram is a string of n symbols: lower-case letters of any script as
they are, a space for any run of other characters, and a border mark.  The
model keeps all n-grams, however large the corpus is: arrays sorted by the
n-grams' 64-bit hashes with a row of log probabilities and back-off
weights per language, in files of the shared folder that the workers map into
memory; none of it passes through the driver.  A text
gets the language of the lowest length-normalised cross-entropy; the score is
calibrated on training texts, and so is the entropy above which a text is
rejected.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard_later, extended, mapped, shared_dir, written
from .textvec import mix, sliced, view
from .token_binary import _mapped, _open, _put

ORDER = 5
#: Symbols that are no letters: the text border, and any run of other characters.
BORDER, GAP = 2, 32
#: Odd factor of the hashes of symbol strings.
_FACTOR = 0xD1342543DE82EF95
#: The model is written in up to 2**PART_BITS files of about PART_CELLS numbers
#: each; beyond that the files grow, and nothing is left out.
PART_BITS = 12
PART_CELLS = 1 << 21
#: Symbols scored at once, and slots and numbers of the remembered scores.
STEP, MEMO_BITS, MEMO_CELLS = 1 << 16, 18, 1 << 20
#: Bits of a symbol's number within a task, and distinct n-grams a task holds.
NUMBER_BITS, TALLY = 12, 1 << 18
#: Distinct texts of each language used to fit the calibration.
CALIBRATION_DOCS = 2_000
UNKNOWN = "und"


def _letter_table() -> np.ndarray:
    """Symbol of every code point: its lower-case letter, or GAP."""
    out = np.full(0x110000, GAP, np.uint32)
    for code in range(0x110000):
        ch = chr(code)
        if ch.isalpha():
            out[code] = ord(ch.lower()[0])
    return out


_table: np.ndarray | None = None


def symbols(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts with runs of non-letters collapsed; n + 1 offsets.

    Every text starts with a border symbol; a run of non-letters right behind
    it leaves none, any other run leaves one.
    """
    global _table
    if _table is None:
        _table = _letter_table()
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    lead = (data & 0xC0) != 0x80
    at = np.concatenate(([0], np.cumsum(lead)))[offsets]
    if at[-1] != len(points):  # broken UTF-8: decode text by text
        parts = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(offsets, offsets[1:])]
        at = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
        points = np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32)
    n = len(offsets) - 1
    sym = np.empty(len(points) + n, np.uint32)
    keep = np.ones(len(sym), bool)
    border = at[:-1] + np.arange(n)
    keep[border] = False
    sym[keep] = _table[points]
    sym[border] = BORDER
    stay = np.ones(len(sym), bool)
    stay[1:] = (sym[1:] != GAP) | (sym[:-1] > GAP)
    stay[border] = True
    where = np.concatenate(([0], np.cumsum(stay)))
    starts = where[np.concatenate((border, [len(sym)]))]
    return sym[stay], starts


def _hashed(code: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n-grams; those of different orders differ."""
    return mix(code + np.uint64(n * 0x9E3779B97F4A7C15 % (1 << 64)))


@dataclass
class Coded:
    """The n-grams that end at each symbol but the borders: ``ends[n]`` are their
    hashes, ``before[n]`` those of the n-grams that end one symbol earlier."""

    ends: list[np.ndarray]
    before: list[np.ndarray]


def padded(sym: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts with ORDER - 1 borders before each; the places of all other symbols;
    and how many of these come before each text (n + 1 numbers).

    The n-gram that ends at a symbol is so a slice, wherever in its text it stands.
    """
    n, more = len(starts) - 1, ORDER - 2
    out = np.full(len(sym) + more * n, BORDER, np.uint32)
    keep = np.ones(len(out), bool)
    for j in range(more):
        keep[starts[:-1] + more * np.arange(n) + j] = False
    out[keep] = sym
    return out, np.flatnonzero(out != BORDER), starts - np.arange(n + 1)


def windows(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The ORDER symbols up to each of some places of a padded text, one row each."""
    if not len(at):
        return np.empty((0, ORDER), np.uint32)
    return np.lib.stride_tricks.sliding_window_view(text, ORDER)[at - (ORDER - 1)]


def keys_of(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hashes of the ORDER-grams that end at ascending places of a padded text."""
    if not len(at):
        return np.empty(0, np.uint64)
    low, high = at[0] - (ORDER - 1), at[-1] + 1
    code = text[low : high - (ORDER - 1)].astype(np.uint64)
    for j in range(1, ORDER):
        code *= np.uint64(_FACTOR)
        code += text[low + j : high - (ORDER - 1) + j]
    return _hashed(code[at - at[0]], ORDER)


def coded_windows(window: np.ndarray) -> Coded:
    """N-grams of all orders at the end of each row of ``windows``."""

    def ending(last: int) -> list[np.ndarray]:
        out, code = [np.empty(0, np.uint64)], np.zeros(len(window), np.uint64)
        for n in range(1, last + 2):
            code = code + window[:, last - (n - 1)].astype(np.uint64) * np.uint64(pow(_FACTOR, n - 1, 1 << 64))
            out.append(_hashed(code, n))
        return out

    return Coded(ending(ORDER - 1), ending(ORDER - 2))


def coded(sym: np.ndarray, starts: np.ndarray) -> Coded:
    """Near a text's start the missing symbols count as borders."""
    text, at, _ = padded(sym, starts)
    return coded_windows(windows(text, at))


def grams_of(column: pa.Array, n: int) -> np.ndarray:
    """Hashes of a column of strings of n symbols, as ``coded`` makes them."""
    data, offsets = view(column)
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32).reshape(len(offsets) - 1, n)
    code = np.zeros(len(points), np.uint64)
    for j in range(n):
        code += points[:, n - 1 - j].astype(np.uint64) * np.uint64(pow(_FACTOR, j, 1 << 64))
    return _hashed(code, n)


def _strings(points: np.ndarray) -> pa.Array:
    """A matrix of symbols as a column of strings, one a row."""
    size = 1 + (points >= 0x80).astype(np.int32) + (points >= 0x800) + (points >= 0x10000)
    offsets = np.concatenate(([0], np.cumsum(size.sum(1)))).astype(np.int32)
    data = points.astype("<u4").tobytes().decode("utf-32-le").encode()
    return pa.StringArray.from_buffers(len(points), pa.py_buffer(offsets.tobytes()), pa.py_buffer(data))


@dataclass
class Model:
    """A model in files: ``bits`` leading bits of an n-gram's hash tell its part.

    A part is three arrays: n-gram hashes in order, the first row of each
    bucket of hashes, and rows of log probabilities and back-off weights (a
    column per language, natural logs).  A task maps the parts it needs and lets
    go of them at its end: workers live on, and would keep the files of every
    model they have seen.
    """

    langs: list[str]
    floor: np.ndarray
    vocabulary: int
    folder: str
    bits: int
    sizes: dict[int, int]
    slope: float = 1.0
    bias: float = 0.0
    limits: np.ndarray | None = None
    index: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, int]] = field(default_factory=dict)
    memo: tuple[int, np.ndarray, np.ndarray] | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"index": {}, "memo": None}  # each worker maps the files itself

    def part(self, p: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        if p not in self.index:
            keys, first, values = (_mapped(self.folder, f"{p:05d}-{x}", t)[:] for x, t in (("keys", "<u8"), ("first", "<i4"), ("values", "<f4")))
            self.index[p] = keys, first, values.reshape(len(keys), -1), (len(first) - 1).bit_length() - 1
        return self.index[p]

    def look(self, key: np.ndarray, weights: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Which n-grams are known, and their log probabilities or back-off weights."""
        width = len(self.langs)
        row, values = np.full(len(key), -1, np.int32), np.empty((len(key), width), np.float32)
        part = (key >> np.uint64(64 - self.bits)).astype(np.uint16) if self.bits else np.zeros(len(key), np.uint16)
        order = np.argsort(part, kind="stable") if self.bits else np.arange(len(key))
        every, cuts = np.unique(part[order], return_index=True)
        for p, a, b in zip(every.tolist(), cuts, [*cuts[1:], len(order)]):
            if p not in self.sizes:
                continue
            mine = order[a:b]
            hashes, first, numbers, size = self.part(p)
            slot = ((key[mine] << np.uint64(self.bits)) >> np.uint64(64 - size)).astype(np.int64)
            low, high, left, wanted = first[slot], first[slot + 1], mine, key[mine]
            some = low < high
            low, high, left, wanted = low[some], high[some], left[some], wanted[some]
            while len(left):
                hit = hashes[low] == wanted
                row[left[hit]] = low[hit]
                low = low + 1
                more = ~hit & (low < high)
                left, low, high, wanted = left[more], low[more], high[more], wanted[more]
            found = mine[row[mine] >= 0]
            values[found] = numbers[row[found], width:] if weights else numbers[row[found], :width]
        hit = row >= 0
        return hit, values[hit]

    def score(self, text: Coded) -> np.ndarray:
        """Log probabilities of all symbols (a row each, a column per language)."""
        out = np.zeros((len(text.ends[ORDER]), len(self.langs)), np.float32)
        left = np.arange(len(out))
        for n in range(ORDER, 0, -1):
            hit, values = self.look(text.ends[n][left])
            out[left[hit]] += values
            left = left[~hit]
            if not len(left):
                break
            if n == 1:
                out[left] += self.floor
            else:  # an unknown n-gram: the weight of its context, then the shorter one
                known, values = self.look(text.before[n - 1][left], weights=True)
                out[left[known]] += values
        return out

    def remembered(self, text: np.ndarray, at: np.ndarray) -> np.ndarray:
        """``score`` of the symbols at places of a padded text.

        A score depends on the ORDER-gram alone.  Those met lately stand in a
        table with one slot for each value of their hashes' leading bits, which
        a task drops at its end; only others are looked up in the model.
        """
        if self.memo is None:
            bits = max(10, min(MEMO_BITS, (MEMO_CELLS // len(self.langs)).bit_length() - 1))
            # A free slot holds a hash that belongs to another one.
            free = ~(np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
            self.memo = bits, free, np.zeros((1 << bits, len(self.langs)), np.float32)
        bits, known, values = self.memo
        key = keys_of(text, at)
        slot = (key >> np.uint64(64 - bits)).astype(np.int64)
        out = values.take(slot, axis=0)
        miss = np.flatnonzero(known.take(slot) != key)
        if len(miss):
            new, first, number = np.unique(key[miss], return_index=True, return_inverse=True)
            got = self.score(coded_windows(windows(text, at[miss[first]])))
            out[miss] = got[number]
            slot = (new >> np.uint64(64 - bits)).astype(np.int64)
            last = np.append(slot[1:] != slot[:-1], True)  # one for each slot
            known[slot[last]], values[slot[last]] = new[last], got[last]
        return out

    def entropies(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per symbol for each text and language, and lengths.

        Texts without a letter have length 0.
        """
        sym, starts = symbols(data, offsets)
        count = _lengths(sym, starts)
        text, at, first = padded(sym, starts)
        total = np.zeros((len(count), len(self.langs)))
        some = np.flatnonzero(np.diff(first))
        first = first[some]
        for a in range(0, len(at), STEP):
            got = self.remembered(text, at[a : a + STEP])
            i, j = np.searchsorted(first, a, "right") - 1, np.searchsorted(first, a + len(got))
            total[some[i:j]] += np.add.reduceat(got, np.maximum(first[i:j] - a, 0), axis=0, dtype=np.float64)
        return -total / np.maximum(count, 1)[:, None], count

    def forget(self) -> None:
        """Let go of mapped files and remembered scores."""
        self.index.clear()
        self.memo = None


def _lengths(sym: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Symbols of each text but its border; 0 for one without a letter."""
    if len(starts) < 2:
        return np.zeros(0)
    letters = np.add.reduceat(sym > GAP, starts[:-1], dtype=np.int64)
    return np.where(letters > 0, np.diff(starts) - 1, 0).astype(float)


class Tally:
    """Counts of ORDER-grams by language, gathered over the batches of a task.

    An n-gram is packed into one number, NUMBER_BITS for each symbol; a symbol's
    number is its place among those met so far.  ``add`` and ``flush`` give
    (language, windows, counts) when more than ``limit`` distinct n-grams are
    held, when the numbers run out, and at the end.
    """

    def __init__(self, limit: int) -> None:
        self.limit = limit
        self._restart()

    def _restart(self) -> None:
        self.number, self.known = np.full(0x110000, -1, np.int16), np.empty(0, np.uint32)
        self.parts: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        self.held = 0

    def _merge(self) -> None:
        self.held = 0
        for i, parts in self.parts.items():
            key, count = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(key, kind="stable")
            key, count = key[order], count[order]
            head = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            self.parts[i] = [(key[head], np.add.reduceat(count, head))]
            self.held += len(head)

    def flush(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        self._merge()
        for i, [(key, count)] in self.parts.items():
            window = np.empty((len(key), ORDER), np.uint32)
            for j in range(ORDER):
                window[:, ORDER - 1 - j] = self.known[((key >> np.uint64(j * NUMBER_BITS)) & np.uint64((1 << NUMBER_BITS) - 1)).astype(np.int64)]
            yield i, window, count
        self._restart()

    def add(self, lang: np.ndarray, sym: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Count the texts, whose languages are ``lang``."""
        text, at, first = padded(sym, starts)
        if not len(at):
            return
        of = np.repeat(lang, np.diff(first))
        new = self._new(text)
        if len(self.known) + len(new) > 1 << NUMBER_BITS:
            yield from self.flush()
            new = self._new(text)
            if len(new) > 1 << NUMBER_BITS:  # this batch alone has too many: by hashes
                key = keys_of(text, at)
                for i in np.unique(lang[np.diff(first) > 0]).tolist():
                    mine = np.flatnonzero(of == i)
                    _, one, count = np.unique(key[mine], return_index=True, return_counts=True)
                    yield i, windows(text, at[mine[one]]), count
                return
        self.number[new] = np.arange(len(self.known), len(self.known) + len(new))
        self.known = np.concatenate((self.known, new))
        short = self.number[text].astype(np.uint64)
        code = short[: len(short) - (ORDER - 1)].copy()
        for j in range(1, ORDER):
            code <<= np.uint64(NUMBER_BITS)
            code |= short[j : len(short) - (ORDER - 1) + j]
        code = code[at - (ORDER - 1)]
        for i in np.unique(lang[np.diff(first) > 0]).tolist():
            key = np.sort(code[of == i])
            head = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            self.parts.setdefault(i, []).append((key[head], np.diff(np.append(head, len(key)))))
            self.held += len(head)
        if self.held > 2 * self.limit:
            self._merge()
            if self.held > self.limit:
                yield from self.flush()

    def _new(self, text: np.ndarray) -> np.ndarray:
        """Symbols without a number."""
        return np.unique(text[self.number[text] < 0])


def _count(texts: DataFrame, langs: list[str]) -> DataFrame:
    code = {name: i for i, name in enumerate(langs)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally(TALLY)

        def rows(found: Iterator) -> Iterator[pa.RecordBatch]:
            for i, window, number in found:
                for a in range(0, len(number), STEP):
                    part = _strings(window[a : a + STEP])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), i)), part, pa.array(number[a : a + STEP])], ["l", "g", "c"])

        for batch in sliced(batches):
            lang = np.array([code[x] for x in batch.column("lang").to_pylist()])
            yield from rows(tally.add(lang, *symbols(*view(batch.column("text")))))
        yield from rows(tally.flush())

    return mapped(texts, count, "l long, g string, c long").groupBy("l", "g").agg(F.sum("c").alias("c"))


def _dense(column: pa.Array, name: str, width: int) -> np.ndarray:
    """A column of lists of (l, number) as a matrix with a column per language."""
    out = np.zeros((len(column), width))
    row = np.repeat(np.arange(len(column)), pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False))
    flat = column.flatten()
    out[row, pc.struct_field(flat, "l").to_numpy(zero_copy_only=False)] = pc.struct_field(flat, name).to_numpy(zero_copy_only=False)
    return out


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], np.ascontiguousarray(x).ravel())


def _put_part(folder: str, p: int, key: np.ndarray, values: np.ndarray, bits: int) -> None:
    code = key << np.uint64(bits)
    size = max(2, int(len(key) * 2).bit_length())
    order = np.argsort(code, kind="stable")
    first = np.searchsorted(code[order] >> np.uint64(64 - size), np.arange((1 << size) + 1, dtype=np.uint64))
    for name, x in (("keys", key[order].astype("<u8")), ("first", first.astype("<i4")), ("values", values[order].astype("<f4"))):
        _put(folder, f"{p:05d}-{name}", x.tobytes())


def store(counts: DataFrame, langs: list[str]) -> Model:
    """The interpolated Kneser-Ney model of all counts (l, g, c), built with joins.

    Discounts are n1 / (n1 + 2 n2) of each order and language, within 0.1 and 0.95.
    """
    width, spark = len(langs), counts.sparkSession
    # One table for each order: for every n-gram, by language, its count (lower
    # orders: distinct symbols before it) and, as a context, the sum and the
    # number of what follows.  Endings and contexts of longer n-grams are all
    # n-grams that a text can fall back to.
    facts = F.array_sort(F.collect_list(F.struct("l", "c", "total", "kinds"))).alias("facts")
    zero = F.lit(0).cast("long")
    tables = {ORDER: written(counts.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("l", "c", zero.alias("total"), zero.alias("kinds")))).alias("facts")), "lid-grams")}
    for n in range(ORDER - 1, 0, -1):
        longer = tables[n + 1].select("g", F.inline("facts")).where("c > 0")
        ending = longer.select(F.right("g", F.lit(n)).alias("g"), "l", F.lit(1).cast("long").alias("c"), zero.alias("total"), zero.alias("kinds"))
        context = longer.select(F.left("g", F.lit(n)).alias("g"), "l", zero.alias("c"), F.col("c").alias("total"), F.lit(1).cast("long").alias("kinds"))
        both = ending.unionByName(context).groupBy("g", "l").agg(*(F.sum(c).alias(c) for c in ("c", "total", "kinds")))
        tables[n] = written(both.groupBy("g").agg(facts), "lid-grams")
    every = None
    for n, table in tables.items():
        one = table.select(F.lit(n).alias("n"), "g", F.explode("facts").alias("x")).select("n", "g", "x.*")
        one = one.groupBy("n", "l").agg(F.count_if(F.col("c") == 1).alias("ones"), F.count_if(F.col("c") == 2).alias("twos"), F.sum("c").alias("total"), F.count_if(F.col("c") > 0).alias("kinds"))
        size = table.groupBy().agg(F.lit(n).alias("n"), F.lit(-1).cast("long").alias("l"), zero.alias("ones"), zero.alias("twos"), zero.alias("total"), F.count("*").alias("kinds"))
        every = one.unionByName(size) if every is None else every.unionByName(one).unionByName(size)
    discount, first, sizes = np.full((ORDER + 1, width), 0.1), np.zeros((2, width)), {}
    for r in every.collect():  # a row for each order and language
        if r.l < 0:
            sizes[r.n] = r.kinds
            continue
        discount[r.n, r.l] = min(0.95, max(0.1, r.ones / max(1, r.ones + 2 * r.twos)))
        if r.n == 1:
            first[:, r.l] = r.total, r.kinds
    vocabulary = sizes[1] + 1
    start = np.where(first[1] > 0, discount[1] * first[1] / np.maximum(first[0], 1), 1.0)

    def chances(n: int):
        def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                count = _dense(batch.column("facts"), "c", width)
                if n == 1:
                    total, weight, below = first[0], start, 1 / vocabulary
                else:
                    total, kinds = (_dense(batch.column("above"), x, width) for x in ("total", "kinds"))
                    weight = np.where(total > 0, discount[n] * kinds / np.maximum(total, 1), 1.0)
                    below = batch.column("below").flatten().to_numpy().reshape(-1, width)
                prob = weight * below + np.where(count > 0, np.maximum(count - discount[n], 0) / np.maximum(total, 1), 0)
                yield pa.RecordBatch.from_arrays([batch.column("g"), _lists(prob), batch.column("facts")], ["g", "prob", "facts"])

        return step

    bits = min(PART_BITS, int(max(0, 2 * width * sum(sizes.values()) // PART_CELLS)).bit_length())

    def rows(n: int):
        def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                key = grams_of(batch.column("g"), n)
                part = key >> np.uint64(64 - bits) if bits else np.zeros(len(key))
                logp = np.log(np.maximum(batch.column("prob").flatten().to_numpy().reshape(-1, width), 1e-12))
                total, kinds = (_dense(batch.column("facts"), x, width) for x in ("total", "kinds"))
                gamma = np.where(total > 0, discount[min(n + 1, ORDER)] * kinds / np.maximum(total, 1), 1.0)
                values = np.column_stack((logp, np.log(gamma))).astype(np.float32)
                yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(key.view(np.int64)), _lists(values)], ["part", "key", "numbers"])

        return step

    below, every = None, None
    kind = "array<struct<l:bigint,c:bigint,total:bigint,kinds:bigint>>"
    for n in range(1, ORDER + 1):
        table = tables[n]
        if n > 1:
            above = below.select(F.col("g").alias("h"), F.col("facts").alias("above"))
            shorter = below.select(F.col("g").alias("s"), F.col("prob").alias("below"))
            table = table.join(above, F.left("g", F.lit(n - 1)) == F.col("h")).join(shorter, F.right("g", F.lit(n - 1)) == F.col("s"))
            table = table.select("g", "facts", "above", "below")
        below = written(mapped(table, chances(n), f"g string, prob array<double>, facts {kind}"), "lid-chances")
        out = mapped(below, rows(n), "part int, key long, numbers array<float>")
        every = out if every is None else every.unionByName(out)
    folder = f"{shared_dir(spark)}/lid-model-{uuid.uuid4().hex}"
    system, at = _open(folder)
    system.create_dir(at, recursive=True)
    discard_later(folder)

    def put(table: pa.Table) -> pa.Table:
        p, key = table["part"][0].as_py(), np.ascontiguousarray(table["key"].to_numpy()).view(np.uint64)
        _put_part(folder, p, key, pc.list_flatten(table["numbers"]).to_numpy().reshape(len(key), -1), bits)
        return pa.table({"part": [p], "n": [len(key)]})

    sizes = {r.part: r.n for r in every.groupBy("part").applyInArrow(put, "part long, n long").collect()}
    floor = np.log(np.maximum(start / vocabulary, 1e-12)).astype(np.float32)
    return Model(langs, floor, vocabulary, folder, bits, sizes)


def train(docs: DataFrame, calibration_docs: int = CALIBRATION_DOCS) -> Model | None:
    """Fit on ``text`` and ``lang`` of all rows where both are present.

    Counts cover every whole text, and all of them are in the model, which is
    written to the shared folder.  Returns None if there is nothing to learn
    from.
    """
    texts = docs.where("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang")
    langs = sorted(r.lang for r in texts.select("lang").distinct().collect())
    if not langs:
        return None
    model = store(written(_count(texts, langs), "lid-counts"), langs)
    _calibrate(model, texts, calibration_docs)
    return model


def _sample(model: Model, texts: DataFrame, number: int) -> tuple[np.ndarray, ...]:
    """Language, entropies, length and weight of the sampled texts.

    Each language gives the ``number`` distinct texts with the lowest hashes
    (all, if it has fewer), so neither the order of rows nor the number of a
    text's copies matters.  Texts of any length are scored where they are; only
    numbers reach the driver.
    """
    width = len(model.langs)
    code = {name: i for i, name in enumerate(model.langs)}
    hashed = texts.withColumn("h", F.xxhash64("text"))
    distinct = {r.lang: r.n for r in hashed.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()}
    # Twice the number is expected below the bound; the lowest of them are taken.
    share = {name: 2.0 if n <= 2 * number else 2 * number / n for name, n in distinct.items()}
    chance = F.pmod("h", F.lit(1 << 30)) / float(1 << 30)
    bound = F.create_map(*(F.lit(x) for pair in share.items() for x in pair))
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in sliced(batches):
            l, h = np.array([code[x] for x in batch.column("lang").to_pylist()]), batch.column("h").to_numpy()
            _, one = np.unique(np.column_stack((l, h)), axis=0, return_index=True)  # copies
            entropy, count = model.entropies(*view(batch.column("text").take(pa.array(one))))
            yield pa.RecordBatch.from_arrays([pa.array(l[one]), pa.array(h[one]), _lists(entropy), pa.array(count)], ["l", "h", "entropy", "count"])
        model.forget()

    scored = mapped(hashed.where(chance < F.element_at(bound, F.col("lang"))), score, "l long, h long, entropy array<double>, count double")
    table = scored.where("count > 0").groupBy("l", "h").agg(F.first("entropy").alias("entropy"), F.first("count").alias("count")).toArrow()
    l, h, count = (table[c].to_numpy() for c in ("l", "h", "count"))
    entropy = pc.list_flatten(table["entropy"]).to_numpy().reshape(-1, width)
    low = (h & ((1 << 30) - 1)).astype(np.int64)
    order = np.lexsort((h, low, l))
    first = np.searchsorted(l[order], l[order])
    order = order[np.arange(len(order)) - first < number]
    l = l[order]
    weight = np.array([distinct[name] for name in model.langs], float)[l] / np.bincount(l, minlength=width)[l]
    return l, entropy[order], count[order], weight


def _calibrate(model: Model, texts: DataFrame, number: int) -> None:
    """Fit the score's logistic curve and the entropy limits on a bounded sample."""
    right, entropy, count, weight = _sample(model, texts, number)
    if not len(right):
        return
    weight = weight / weight.mean()
    best = np.argmin(entropy, axis=1)
    x, y = _margin(entropy, count), (best == right).astype(float)
    # Logistic regression by Newton steps with a weak prior.
    w = np.array([0.0, 1.0])
    features = np.column_stack((np.ones(len(x)), x))
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(features @ w, -30, 30)))
        gradient = features.T @ ((y - p) * weight) - 0.1 * (w - [0.0, 1.0])
        w += np.linalg.solve((features * (p * (1 - p) * weight)[:, None]).T @ features + 0.1 * np.eye(2), gradient)
    model.bias, model.slope = float(w[0]), float(max(w[1], 0.0))
    # Reject far outside what training texts of the language have.  Short texts
    # vary more: the limit widens with 1/sqrt(length).  A language is measured by
    # its own texts alone; one without a letter in any of them rejects nothing.
    limits = np.full((2, len(model.langs)), np.inf)
    for i in range(len(model.langs)):
        mine = right == i
        if not mine.any():
            continue
        sure = mine & (best == i)
        e = entropy[sure if sure.any() else mine, i]
        middle = np.median(e)
        limits[:, i] = middle + max(1.5, 8 * np.median(np.abs(e - middle))), 12.0
    model.limits = limits


def _margin(entropy: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Gap to the second-best language, in nats, damped for long texts."""
    if entropy.shape[1] == 1:
        return np.full(len(entropy), 5.0)
    two = np.partition(entropy, 1, axis=1)[:, :2]
    return np.minimum((two[:, 1] - two[:, 0]) * np.sqrt(count), 20.0)


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """Adds lang_pred, score (0 to 1), entropy and rejected to every row.

    A null text, or one without a letter, gets ``und``, score 0 and is
    rejected.  Without a model, where nothing could be learned, texts with
    letters get ``und`` and score 0, too, but are not rejected.  With one, a
    text with letters always gets a learned language; ``rejected`` tells whether its
    cross-entropy lies beyond the calibrated limit.  Whole texts of any length
    are read.  Ties go to the first language in code-point order; repeated
    rows get the same; an empty table stays empty; columns of these four names
    in the input are replaced.
    """
    names = [c for c in docs.columns if c not in ("lang_pred", "score", "entropy", "rejected")]
    schema = extended(docs.select(*names).schema, "lang_pred string, score double, entropy double, rejected boolean")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in sliced(batches):
            n = batch.num_rows
            lang, score, least, out = np.full(n, UNKNOWN, object), np.zeros(n), np.full(n, np.nan), np.ones(n, bool)
            if model is None:
                out = _lengths(*symbols(*view(batch.column("text")))) == 0
            else:
                entropy, count = model.entropies(*view(batch.column("text")))
                ok = count > 0
                best = np.argmin(entropy, axis=1)
                lang[ok] = np.array(model.langs, object)[best[ok]]
                x = np.clip(model.bias + model.slope * _margin(entropy, count), -30, 30)
                score[ok] = (1 / (1 + np.exp(-x)))[ok]
                least[ok] = entropy[np.arange(n), best][ok]
                if model.limits is None:
                    out[ok] = False
                else:
                    base, wide = model.limits[0][best], model.limits[1][best]
                    out[ok] = (least > base + wide / np.sqrt(np.maximum(count, 1)))[ok]
            new = [pa.array(lang, pa.string()), pa.array(score), pa.array(least, mask=np.isnan(least)), pa.array(out)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, "lang_pred", "score", "entropy", "rejected"])
        if model is not None:
            model.forget()

    return mapped(docs.select(*names), label, schema)
