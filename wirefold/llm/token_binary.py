"""Token ids as flat binary files.

File format (little endian), one pair of files for each range partition:

``ids-PPPPP.bin``      unsigned integers of ``width`` bytes, documents one
                       after another, each followed by the end id;
``offsets-PPPPP.bin``  64-bit unsigned: for each document its first id within
                       the partition, then the partition's number of ids;
``docs-PPPPP.bin``     64-bit signed document ids in file order.

Partitions hold ascending ranges of ``doc_id``; a partition's base (ids in all
partitions before it) is the prefix sum of the partition totals.
"""

from __future__ import annotations

import json
import os
import re
import sys
import uuid
import zlib
from array import array
from collections.abc import Iterator
from contextlib import ExitStack
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, shared_dir
from .textvec import kept, sliced

#: Bytes that end an alphabetic word without joining it to what follows.
_TAIL = ",.!?;:|*#$%&)"
#: A space that stands inside a run of white space: the only place where
#: cutting before a space can differ from the tokenizer's own cuts.
_INNER = re.compile(r"\s \s")


#: Bytes of text whose pieces are looked up together.
BATCH_BYTES = 1 << 22

#: The byte-level alphabet: printable Latin-1 characters stand for themselves,
#: all other bytes for characters from 256 on, in order.
_SELF = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_CHARS = {b: 256 + i for i, b in enumerate(x for x in range(256) if x not in set(_SELF))}


class _Odd(Exception):
    """A piece is empty, or has white space at an end: its text may hold _INNER."""


class _Units(dict):
    """Ids (as bytes) of a space-separated piece, encoded on first use.

    The byte-level pre-tokenizer never joins a non-space with a following
    space, so a text's ids are the concatenation of the ids of its pieces.
    """

    #: About so many bytes make a generation.  The generation before is kept, and
    #: pieces of it that come again pass to the new one; others are forgotten.
    LIMIT = 28 << 20

    def __init__(self, tokenizer, dtype, lead: str) -> None:
        super().__init__()
        self.tokenizer, self.dtype, self.lead = tokenizer, dtype, lead
        self.model, self.code = tokenizer.model, {2: "H", 4: "I"}[dtype.itemsize]
        self.plain: _Units = self
        self.held, self.old = 0, {}
        self.odd = False  # odd pieces are allowed: the text holds no _INNER

    def ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def word_ids(self, word: str) -> bytes:
        """Ids of a word of letters: one pre-token, so the model alone decides."""
        raw = (self.lead + word).encode().decode("latin-1").translate(_BYTE_CHARS)
        return array(self.code, [t.id for t in self.model.tokenize(raw)]).tobytes()

    def __missing__(self, piece: str) -> bytes:
        if not piece or piece[0].isspace() or piece[-1].isspace():
            if not self.odd:
                raise _Odd
            return self.ids(self.lead + piece)
        out = self.old.pop(piece, None)
        if out is None:
            out = self.encoded(piece)
        if self.held >= self.LIMIT:
            self.old = self.copy()
            self.clear()
            self.held = 0
        self[piece] = out
        self.held += len(piece) + len(out) + 200  # two objects and a slot
        return out

    def encoded(self, piece: str) -> bytes:
        left, line, right = piece.partition("\n")
        if line and left and right and not left[-1].isspace() and not right[0].isspace():
            return self[left] + self.line + self.plain[right]
        word = piece.rstrip(_TAIL)
        if word.isalpha() and (word.isascii() or max(word) < "\u0250"):
            return self.word_ids(word) if word == piece else self[word] + self.plain[piece[len(word) :]]
        return self.ids(self.lead + piece)


class Encoder:
    """Encodes whole texts with a ``tokenizers`` file, remembering pieces."""

    def __init__(self, path: str, limit: int = _Units.LIMIT) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        spec = json.loads(self.tokenizer.to_str())
        pre = spec.get("pre_tokenizer") or {}
        byte_level = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        model = spec.get("model") or {}
        added = spec.get("added_tokens") or []
        simple = all(re.fullmatch(r"<\S+>", t["content"]) and not t["lstrip"] and not t["rstrip"] and not t["single_word"] for t in added)
        self.by_piece = bool(sys.byteorder == "little" and byte_level and not spec.get("normalizer") and model.get("type") == "BPE" and not model.get("dropout") and simple)
        self.first = _Units(self.tokenizer, self.dtype, "")
        self.rest = _Units(self.tokenizer, self.dtype, " ")
        self.rest.plain = self.first
        self.first.LIMIT = self.rest.LIMIT = limit
        self.first.line = self.rest.line = self.first.ids("\n")

    def encode(self, text: str) -> bytes:
        """Ids of one text as bytes of ``dtype``."""
        if not self.by_piece or not text:
            return self.first.ids(text)
        head, *tail = text.split(" ")
        try:
            return self.first[head] + b"".join(map(self.rest.__getitem__, tail))
        except _Odd:
            if _INNER.search(text):
                return self.first.ids(text)
        self.first.odd = self.rest.odd = True
        out = self.first[head] + b"".join(map(self.rest.__getitem__, tail))
        self.first.odd = self.rest.odd = False
        return out


class Words(dict):
    """Ids (as bytes) of words of letters behind a space.

    About ``limit`` bytes make a generation; words of the generation before
    pass to the new one when they come again, others are forgotten.
    """

    def __init__(self, encoder: Encoder, limit: int) -> None:
        super().__init__()
        self.encoder, self.limit, self.held, self.old = encoder, limit, 0, {}
        self.model, self.code = encoder.tokenizer.model, encoder.rest.code

    def __missing__(self, word: str) -> bytes:
        out = self.old.pop(word, None)
        if out is None:
            if word.isascii():  # these letters stand for themselves, a space for U+0120
                out = array(self.code, [t.id for t in self.model.tokenize("\u0120" + word)]).tobytes()
            else:
                out = self.encoder.rest.word_ids(word)
        if self.held >= self.limit:
            self.old = self.copy()
            self.clear()
            self.held = 0
        self[word] = out
        self.held += len(word) + len(out) + 200  # two objects and a slot
        return out

    def of(self, piece: str) -> bytes:
        """Ids of a piece that follows a space and does not end in white space."""
        word = piece.rstrip(_TAIL)
        if word.isalpha() and (word.isascii() or max(word) < "\u0250"):
            return self[word] if len(word) == len(piece) else self[word] + self.encoder.first[piece[len(word) :]]
        left, line, right = piece.partition("\n")
        if line and left and right and not left[-1].isspace() and not right[0].isspace():
            return self.of(left) + self.encoder.first.line + self.encoder.first[right]
        return self.encoder.rest[piece]


def _piece_ids(encoder: Encoder, words: Words, pieces: pa.Array) -> tuple[list[bytes], np.ndarray]:
    """Ids of distinct pieces behind a space; and which pieces are odd (left empty):
    they are empty or have white space at an end."""
    stem = pc.utf8_rtrim(pieces, characters=_TAIL)
    plain = pc.and_(pc.utf8_is_alpha(stem), pc.string_is_ascii(stem)).to_numpy(zero_copy_only=False)
    found, odd = np.full(len(pieces), b"", object), np.zeros(len(pieces), bool)
    # ASCII words with or without marks behind: once for each word and each tail.
    at = np.flatnonzero(plain)
    some = stem.take(pa.array(at)).dictionary_encode()
    ids = np.empty(len(some.dictionary), object)
    ids[:] = list(map(words.__getitem__, some.dictionary.to_pylist()))
    found[at] = ids[some.indices.to_numpy(zero_copy_only=False)]
    tail = (pc.binary_length(pieces).to_numpy(zero_copy_only=False) - pc.binary_length(stem).to_numpy(zero_copy_only=False))[at]
    for n in np.unique(tail[tail > 0]).tolist():
        mine = at[tail == n]
        marks = pc.utf8_slice_codeunits(pieces.take(pa.array(mine)), -n).dictionary_encode()
        ends = np.empty(len(marks.dictionary), object)
        ends[:] = [encoder.first[m] for m in marks.dictionary.to_pylist()]
        found[mine] += ends[marks.indices.to_numpy(zero_copy_only=False)]
    rest = np.flatnonzero(~plain)
    for i, p in zip(rest.tolist(), pieces.take(pa.array(rest)).to_pylist()):
        if not p or len(p.strip()) != len(p):
            odd[i] = True
        else:
            found[i] = words.of(p)
    return found.tolist(), odd


def gathered(encoder: Encoder, texts: pa.Array, words: Words) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids of all texts (at least one, without nulls), each distinct piece looked up once.

    Returns the distinct pieces, the piece of every place, the texts' bounds in
    these, which texts hold odd pieces (their ids are not right), the ids, and the
    number of ids up to each place.
    """
    split = pc.split_pattern(texts, " ")
    number = pc.list_value_length(split).to_numpy(zero_copy_only=False)
    bounds = np.concatenate(([0], np.cumsum(number)))
    coded = pc.list_flatten(split).dictionary_encode()
    pieces, code = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    found, odd = _piece_ids(encoder, words, pieces)
    strange = np.add.reduceat(odd[code], bounds[:-1]) > 0
    heads = code[bounds[:-1]]
    found += [b"" if o else encoder.first[p] for p, o in zip(pieces.take(pa.array(heads)).to_pylist(), odd[heads].tolist())]
    unit = code.copy()
    unit[bounds[:-1]] = len(pieces) + np.arange(len(texts))
    pool = np.frombuffer(b"".join(found), encoder.dtype)
    size = np.array([len(x) for x in found]) // encoder.dtype.itemsize
    start = np.cumsum(size) - size
    each = size[unit]
    upto = np.concatenate(([0], np.cumsum(each)))
    ids = pool[np.repeat(start[unit] - upto[:-1], each) + np.arange(upto[-1])]
    return pieces, code, bounds, strange, ids, upto


def column_ids(encoder: Encoder, column: pa.Array, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts of a column (null: empty), one after another, and each text's number of ids."""
    texts = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(texts):
        return np.empty(0, encoder.dtype), np.empty(0, np.int64)
    if encoder.by_piece:
        _, _, bounds, strange, ids, upto = gathered(encoder, texts, words)
    else:
        bounds, strange, ids, upto = np.zeros(len(texts) + 1, np.int64), np.ones(len(texts), bool), np.empty(0, encoder.dtype), np.zeros(1, np.int64)
    at = upto[bounds]
    counts, parts, done = np.diff(at), [], 0
    for i in np.flatnonzero(strange).tolist():
        text = texts[i].as_py()
        one = np.frombuffer(encoder.encode(text) if text else b"", encoder.dtype)
        parts += (ids[at[done] : at[i]], one)
        counts[i], done = len(one), i + 1
    return np.concatenate([*parts, ids[at[done] :]]), counts


#: Name by which workers keep encoders and their pieces.
KEEP = "encoders"


def encoder_of(path: str, limit: int = _Units.LIMIT) -> Encoder:
    """The worker's encoder: kept, with its pieces, for the encoding tasks that follow."""
    encoders = kept(KEEP)
    if (path, limit) not in encoders:
        encoders[path, limit] = Encoder(path, limit)
    return encoders[path, limit]


def words_of(encoder: Encoder, limit: int) -> Words:
    """The worker's words of an encoder, kept like it."""
    return kept(KEEP).setdefault(("words of", encoder, limit), Words(encoder, limit))


def _open(path: str):
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _publish(system, part: str, at: str) -> None:
    """Give a finished file its name; a repeated task has written the same bytes."""
    try:
        system.move(part, at)
    except OSError:
        if system.get_file_info(at).type != fs.FileType.File:
            raise
        system.delete_file(part)


def _put(folder: str, name: str, data: bytes) -> None:
    """Write through a temporary name, so that a repeated task leaves whole files."""
    system, at = _open(folder)
    part = f"{at}/.{name}-{uuid.uuid4().hex}"
    with system.open_output_stream(part) as out:
        out.write(data)
    _publish(system, part, f"{at}/{name}")


class _Ranges:
    """A file of numbers in a store that cannot be mapped: slices are read alone."""

    def __init__(self, source, dtype: str) -> None:
        self.source, self.dtype = source, np.dtype(dtype)
        self.size = source.size() // self.dtype.itemsize

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, cut: slice) -> np.ndarray:
        a, b, _ = cut.indices(self.size)
        width = self.dtype.itemsize
        return np.frombuffer(self.source.read_at(max(0, b - a) * width, a * width), self.dtype)


def _mapped(folder: str, name: str, dtype: str) -> np.ndarray | _Ranges:
    """A file as an array: memory-mapped on a local or mounted folder, else read in slices."""
    system, at = _open(f"{folder}/{name}")
    if isinstance(system, fs.LocalFileSystem):
        return np.memmap(at, dtype, "r") if Path(at).stat().st_size else np.empty(0, dtype)
    return _Ranges(system.open_input_file(at), dtype)


def write_tokens(docs: DataFrame, tokenizer_path: str, end_id: int, folder: str | None = None, partitions: int | None = None, batch_bytes: int = BATCH_BYTES, memory: int = _Units.LIMIT) -> tuple[str, list[tuple[int, int, int]], int]:
    """Encode every whole text (null: empty) and write the files.

    Returns the folder, the sorted list of (partition, documents, ids) that
    hold anything, and the id width in bytes.  Rows come in ascending
    ``doc_id`` order, nulls first; repeated ``doc_id`` values are ordered by
    text, and may lie in several partitions.  Other columns are ignored.  An
    empty table writes no files.  Ids, offsets and document ids are written
    as they come; no task holds its partition's.

    A task encodes about ``batch_bytes`` of text at a time and remembers pieces
    in generations of ``memory`` bytes; both change its memory and time only.
    Only tasks load the tokenizer, the driver does not.
    """
    spark = docs.sparkSession
    folder = folder or f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    system, at = _open(folder)
    system.create_dir(at, recursive=True)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = encoder_of(tokenizer_path, memory)
        width = 2 if encoder.dtype.itemsize == 2 and end_id < 1 << 16 else 4
        dtype = np.dtype(f"<u{width}")
        words = words_of(encoder, memory)
        part, total, rows = TaskContext.get().partitionId(), 0, 0
        where, base = _open(folder)
        names = [f"{x}-{part:05d}.bin" for x in ("ids", "offsets", "docs")]
        parts = [f"{base}/.{name}-{uuid.uuid4().hex}" for name in names]
        with ExitStack() as stack:
            ids, offsets, keys = (stack.enter_context(where.open_output_stream(x)) for x in parts)
            for batch in sliced(batches, limit=batch_bytes):
                found, number = column_ids(encoder, batch.column(1), words)
                upto = np.cumsum(number)
                ids.write(np.insert(found.astype(dtype), upto, end_id).tobytes())
                number += 1
                offsets.write((total + np.cumsum(number) - number).astype("<u8").tobytes())
                total += int(number.sum())
                keys.write(pc.fill_null(batch.column(0), -(1 << 63)).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
                rows += batch.num_rows
            offsets.write(np.array([total], "<u8").tobytes())
        for name, x in zip(names, parts):
            if rows:
                _publish(where, x, f"{base}/{name}")
            else:
                where.delete_file(x)
        yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([rows]), pa.array([total]), pa.array([width])], ["part", "docs", "ids", "width"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    number = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Ties of doc_id (nulls, too) are dealt by the first characters of the text,
    # which agrees with their order by whole text.
    rows = rows.withColumn("_start", F.substring("text", 1, 64)).repartitionByRange(number, "doc_id", "_start")
    rows = rows.select("doc_id", "text").sortWithinPartitions("doc_id", "text")
    made = mapped(rows, encode, "part long, docs long, ids long, width long", KEEP).collect()  # one row for each partition
    for info in system.get_file_info(fs.FileSelector(at)):
        if info.base_name.startswith(".") and not info.base_name.endswith(".crc"):
            system.delete_file(info.path)  # what lost tasks have left
    return folder, sorted((r.part, r.docs, r.ids) for r in made if r.docs), max((r.width for r in made), default=2)


def read_tokens(spark, folder: str, parts: list[tuple[int, int, int]], width: int) -> DataFrame:
    """One row per document from the files: doc_id, start, n_tokens, ids_crc32."""
    base, rows = 0, []
    for part, docs, ids in parts:
        rows.append((part, base))
        base += ids

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = _mapped(folder, f"ids-{part:05d}.bin", f"<u{width}")
                offsets = _mapped(folder, f"offsets-{part:05d}.bin", "<u8")
                keys = _mapped(folder, f"docs-{part:05d}.bin", "<i8")
                for a in range(0, len(keys), 1024):
                    cut = offsets[a : a + 1025].astype(np.int64)
                    sums = [zlib.crc32(ids[x:y].astype("<u4").tobytes()) for x, y in zip(cut, cut[1:])]
                    some = np.array(keys[a : a + 1024])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(some, mask=some == -(1 << 63)), pa.array(at + cut[:-1]), pa.array(np.diff(cut)), pa.array(sums, pa.int64())],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not rows:
        return spark.createDataFrame([], schema)
    table = spark.createDataFrame(rows, "part long, base long").repartition(len(rows), "part")
    return mapped(table, read, schema)


def token_binary(docs: DataFrame, tokenizer_path: str, end_id: int, folder: str | None = None, partitions: int | None = None, batch_bytes: int = BATCH_BYTES, memory: int = _Units.LIMIT) -> DataFrame:
    """Write the files and read them back: doc_id, start, n_tokens, ids_crc32.

    Nulls: a null text is empty (its end id remains), a null ``doc_id`` comes
    first.  Whole texts of any length are encoded; ties in ``doc_id`` keep one
    output row each; an empty table gives no rows; other columns are ignored.
    """
    folder, parts, width = write_tokens(docs, tokenizer_path, end_id, folder, partitions, batch_bytes, memory)
    return read_tokens(docs.sparkSession, folder, parts, width)
