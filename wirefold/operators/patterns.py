"""Many regular expressions against many texts, by the literals they require.

A match of a pattern has to contain one of a few literal strings: those are
read off the pattern and become the index, a long one by one of its grams (the
one that the fewest literals have).  Texts meet rules by the keys of the
grams that they hold, of the sizes that the index has, after a filter of all keys.
So a text meets the rules whose literals it holds, however many there are, and
not all with a few characters in common.  Only such candidates are searched for the
whole literal, and only what holds it is given to the regular expression.  Rules
without a literal (a class and a count, say) meet every text; there should be few.

Patterns are in the dialect of ``rlike``.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from ..sources.shared import written

#: Escapes that stand for a class, an assertion or a reference.
_CLASSES = set("dDwWsSbBAzZGhHvVRXpPkux0123456789QEcNae")
_CONTROL = {"n": "\n", "t": "\t", "r": "\r", "f": "\f"}
#: Characters that stand for themselves and have no quantifier behind them.
_PLAIN = re.compile(r"[ !\"#%&',/:;<=>@A-Z_`a-z~0-9-]+(?![*?+{])")
#: Longest gram that the index is keyed by.
GRAM = 16
#: The filter of the keys has 2**FILTER_BITS bits at most (16 MB); more keys let more through to the join.
FILTER_BITS = 27
#: Bytes of text hashed at once, and rows passed on at once.
BYTES, ROWS = 1 << 21, 50_000
_WORD, _BASE, _ODD = (1 << 64) - 1, 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9


class _Reader:
    """Required literals of a pattern: sets of strings, one of which any match holds."""

    def __init__(self, pattern: str) -> None:
        self.p, self.at = pattern, 0

    def alternatives(self) -> list[str] | None:
        """Up to the closing parenthesis or the end; None if nothing is required."""
        found: list[list[str] | None] = [self.sequence()]
        while self.at < len(self.p) and self.p[self.at] == "|":
            self.at += 1
            found.append(self.sequence())
        if any(x is None for x in found):
            return None
        return sorted({s for x in found for s in x or []})

    def sequence(self) -> list[str] | None:
        options: list[list[str]] = []
        run = ""

        def close() -> None:
            nonlocal run
            if run:
                options.append([run])
            run = ""

        while self.at < len(self.p) and self.p[self.at] not in "|)":
            if plain := _PLAIN.match(self.p, self.at):  # many characters that stand for themselves, at once
                run += plain[0].lower()
                self.at = plain.end()
                continue
            c = self.p[self.at]
            inner: list[str] | None = None
            char = ""
            if c == "(":
                inner = self.group()
            elif c == "[":
                self.skip_class()
            elif c == "\\":
                char = self.escaped()
            else:
                self.at += 1
                char = "" if c in ".^$" or ord(c) > 126 else c
            least, more = self.quantifier()
            if char and least > 0:
                run += char.lower()
                if more:  # repeated: what follows need not stand right behind
                    close()
                continue
            close()
            if inner and least > 0:
                options.append(inner)
        close()
        return max(options, key=lambda o: (min(map(len, o)), -len(o)), default=None)

    def group(self) -> list[str] | None:
        self.at += 1
        counts = True
        if self.p.startswith("?", self.at):
            for head in ("?<=", "?<!", "?=", "?!", "?:", "?>"):
                if self.p.startswith(head, self.at):
                    counts = head in ("?:", "?>")
                    self.at += len(head)
                    break
            else:
                end = min((i for i in (self.p.find(c, self.at) for c in ">:)") if i >= 0), default=len(self.p))
                if "x" in self.p[self.at : end] and not self.p.startswith("?<", self.at):
                    raise ValueError("free spacing")
                self.at = end + (self.p[end : end + 1] != ")")
        inner = self.alternatives()
        self.at += 1
        return inner if counts else None

    def skip_class(self) -> None:
        depth = 0
        while self.at < len(self.p):
            c = self.p[self.at]
            self.at += 1
            if c == "\\":
                self.at += 1
            elif c == "[":
                depth += 1
                self.at += self.p.startswith("^", self.at)
                self.at += self.p.startswith("]", self.at) and depth == 1
            elif c == "]":
                depth -= 1
                if not depth:
                    return

    def escaped(self) -> str:
        c = self.p[self.at + 1 : self.at + 2]
        self.at += 2
        if c in _CLASSES:
            if c in "QE":
                raise ValueError("quoted part")
            if c in "xucN0k" or self.p.startswith("{", self.at) and c in "pP":
                end = self.p.find("}", self.at) if self.p.startswith("{", self.at) else -1
                self.at = end + 1 if end > 0 else self.p.find(">", self.at) + 1 if c == "k" else self.at + {"x": 2, "u": 4, "c": 1, "0": 0}.get(c, 0)
            elif c in "pP":
                self.at += 1
            return ""
        char = _CONTROL.get(c, c)
        return char if char and ord(char) < 127 else ""

    def quantifier(self) -> tuple[int, bool]:
        """Least repeats of what stands before, and whether there is a quantifier."""
        least, more = 1, False
        c = self.p[self.at : self.at + 1]
        if c and c in "*?+":
            least, more = int(c == "+"), True
            self.at += 1
        elif c == "{":
            end = self.p.find("}", self.at)
            number = self.p[self.at + 1 : end].split(",")[0]
            if end > 0 and number.isdigit():
                least, more = int(number), True
                self.at = end + 1
        if more and self.p[self.at : self.at + 1] in ("?", "+"):
            self.at += 1
        return least, more


def required_literals(pattern: str) -> list[str]:
    """ASCII strings in lower case, one of which the lower-cased text of any match contains.

    Empty if none is known.
    """
    try:
        reader = _Reader(pattern)
        found = reader.alternatives()
        return found if found and reader.at >= len(pattern) else []
    except (ValueError, IndexError, RecursionError):
        return []


@F.pandas_udf(ArrayType(StringType()))
def _literals(patterns: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in patterns:
        yield part.map(lambda p: required_literals(p) if p is not None else [])


def _mixed(value, size: int):
    """A gram's key from its polynomial value; its leading bits are its place in the filter."""
    return ((value ^ (value >> 29)) * _ODD + size) * _ODD & _WORD


#: Key of rules without a literal.
_EMPTY = int(np.array([_mixed(0, 0)], np.uint64).view(np.int64)[0])


@F.pandas_udf(LongType())
def _key(grams: pd.Series) -> pd.Series:
    def one(gram: str) -> int:
        value = 0
        for b in gram.encode():
            value = (value * _BASE + b + 1) & _WORD
        return _mixed(value, len(gram))

    return pd.Series(np.array([one(x) for x in grams], np.uint64).view(np.int64))


def _grams(text: Column) -> Column:
    """Distinct grams of ``GRAM`` characters."""
    starts = F.sequence(F.lit(1), F.length(text) - GRAM + 1)
    return F.array_distinct(F.transform(starts, lambda i: text.substr(i, F.lit(GRAM))))


def indexed(rules: DataFrame) -> DataFrame:
    """``rules`` once for each of a pattern's literals, with ``_literal``, the size of its gram and the gram's ``_key``."""
    keyed = rules.withColumn("_literal", F.explode_outer(_literals("pattern"))).withColumn("_literal", F.coalesce("_literal", F.lit("")))
    keyed = written(keyed, "literals")
    long = keyed.where(F.length("_literal") > GRAM).select("_literal").distinct().withColumn("_gram", F.explode(_grams(F.col("_literal"))))
    often = long.groupBy("_gram").agg(F.count("*").alias("_n"))
    rare = long.join(often, "_gram").groupBy("_literal").agg(F.min_by("_gram", F.struct("_n", "_gram")).alias("_gram"))
    short = keyed.where(F.length("_literal") <= GRAM).withColumn("_gram", F.col("_literal"))
    every = short.unionByName(keyed.join(rare, "_literal").select(*short.columns))
    return every.withColumn("_size", F.length("_gram")).withColumn("_key", _key("_gram")).drop("_gram")


def _filter(index: DataFrame) -> tuple[np.ndarray, int]:
    """Bits of all keys, by their leading bits, as 64-bit words."""
    bits = min(FILTER_BITS, max(16, int(16 * index.count()).bit_length()))
    place = F.shiftrightunsigned("_key", 64 - bits)
    one = F.expr(f"shiftleft(1L, cast(shiftrightunsigned(_key, {64 - bits}) & 63 AS INT))")
    words = index.groupBy(F.shiftright(place, 6).alias("at")).agg(F.bit_or(one).alias("word")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[words["at"].to_numpy()] = words["word"].to_numpy().view(np.uint64)
    return out, bits


def _parts(batch: pa.RecordBatch, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``BYTES`` bytes, or of one row."""
    start = 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + BYTES, "right")) - 1)
        yield start, end
        start = end


def _keyed(sizes: list[int], shared: Broadcast, bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each text (its lower case is the last column) once for each key that it may share with the index."""

    def found(offsets: np.ndarray, data: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        words = shared.value
        owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        left = offsets[1:][owner] - np.arange(offsets[0], offsets[-1])
        value = np.zeros(len(data), np.uint64)
        for size in range(1, min(max(sizes), len(data)) + 1):
            value = value[: len(data) - size + 1] * np.uint64(_BASE) + data[size - 1 :] + np.uint64(1)
            if size in sizes:
                key = ((value ^ (value >> np.uint64(29))) * np.uint64(_ODD) + np.uint64(size)) * np.uint64(_ODD)
                place = key >> np.uint64(64 - bits)
                hit = (words[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)
                at = np.flatnonzero(hit & (left[: len(key)] >= size))
                yield owner[at], key[at].view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low = batch.column(batch.num_columns - 1).cast(pa.large_string())
            offsets = np.frombuffer(low.buffers()[1], np.int64, batch.num_rows + 1, low.offset * 8)
            held = low.buffers()[2]
            data = np.frombuffer(held, np.uint8) if held is not None and held.size else np.zeros(0, np.uint8)
            for start, end in _parts(batch, offsets):
                own = offsets[start : end + 1]
                met = list(found(own, data[own[0] : own[-1]].astype(np.uint64)))
                if 0 in sizes:  # rules without a literal meet every text
                    valid = np.flatnonzero(low.slice(start, end - start).is_valid().to_numpy(zero_copy_only=False))
                    met.append((valid, np.full(len(valid), _EMPTY, np.int64)))
                if not met:
                    continue
                rows, keys = (np.concatenate(x) for x in zip(*met))
                order = np.lexsort((keys, rows))
                rows, keys = rows[order], keys[order]
                once = np.concatenate(([True], (np.diff(rows) != 0) | (np.diff(keys) != 0)))[: len(rows)]
                rows, keys = rows[once], keys[once]
                for some in range(0, len(rows), ROWS):
                    out = [c.slice(start, end - start).take(pa.array(rows[some : some + ROWS])) for c in batch.columns[:-1]]
                    yield pa.RecordBatch.from_arrays([*out, pa.array(keys[some : some + ROWS])], [*batch.schema.names[:-1], "_key"])

    return run


def candidates(texts: DataFrame, column: str, index: DataFrame, bounded) -> DataFrame:
    """Pairs of a text and an index row whose literal the text contains (of keys that are whole literals, but for equal hashes)."""
    sizes = sorted(r[0] for r in index.select("_size").distinct().collect())
    if not sizes:
        return texts.join(index, F.lit(False))
    low = texts.withColumn("_low", F.lower(F.col(column)))
    words, bits = _filter(index.select("_key"))
    keyed = low.mapInArrow(_keyed(sizes, texts.sparkSession.sparkContext.broadcast(words), bits), StructType([*texts.schema.fields, StructField("_key", LongType())]))
    return keyed.join(bounded(index), "_key").where((F.length("_literal") == F.col("_size")) | F.lower(F.col(column)).contains(F.col("_literal")))


def matches(texts: DataFrame, column: str, rules: DataFrame, bounded) -> DataFrame:
    """All pairs of a text and a rule whose ``pattern`` it matches; a pair comes
    again where the text holds several of the rule's literals.

    ``bounded`` puts a broadcast hint on a side that has been counted.
    """
    met = candidates(texts, column, written(indexed(rules), "pattern-index"), bounded).where(F.expr(f"`{column}` rlike pattern"))
    return met.drop("_key", "_size", "_literal")
