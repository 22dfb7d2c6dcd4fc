"""Benchmark decontamination by greedy string tiling.

Texts and benchmark items are sequences of lower-cased words.  Rolling
(Karp-Rabin) hashes of ``k`` words are the seeds.  A Spark join of the
documents' seeds with the benchmark's gives, for each text and item that share
any, the places of the shared seeds; a bit filter of the benchmark's seeds
keeps all other places of the documents out of the join.  Each such pair is
then tiled: the longest match of unmarked words is marked, again and again, so
moved passages count as well as whole ones.  The share of an item's words under
tiles is its coverage; a document is contaminated if an item's coverage reaches
the threshold.

Nothing is collected but the filter, whose size is bounded; texts that share no
seed are never shuffled while the benchmark's matches are few, and a text's
copies are tiled once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, bounded_broadcast, mapped, written
from .textvec import grams, powers, sliced, view, words

K = 5
THRESHOLD = 0.5
#: The filter has 2**FILTER_BITS bits at most (16 MB).  A larger benchmark lets
#: more places pass it; the join that follows is exact in any case.
FILTER_BITS = 27
#: Parts of each seed in a shuffled join, so that a hot one meets several tasks.
SALT = 16


def _items(benchmark: DataFrame, k: int) -> DataFrame:
    """(item, item_id, words, k, grams) of the items with a word; an item of
    fewer than ``k`` words has one seed of all its words."""
    rows = benchmark.where("text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            w = words(*view(batch.column("text")))
            code, first = w["hash"], w["first"]
            number = np.diff(first)
            has = np.flatnonzero(number)
            length = np.minimum(number[has], k)
            lists = [grams(code[a : a + n], m).view(np.int64) for a, n, m in zip(first[has], number[has], length)]
            take = pa.array(has)
            yield pa.RecordBatch.from_arrays(
                [batch.column("item").take(take), batch.column("item_id").take(take), pa.array(number[has]), pa.array(length), pa.array(lists, pa.list_(pa.int64()))],
                ["item", "item_id", "words", "k", "grams"],
            )

    return mapped(rows.withColumn("item", F.xxhash64("item_id", "text")), scan, "item long, item_id long, words long, k long, grams array<long>")


def _filter(seeds: DataFrame, number: int) -> tuple[np.ndarray, int]:
    """Bits of all seeds, by their leading bits, as 64-bit words."""
    bits = min(FILTER_BITS, max(16, int(16 * number).bit_length()))
    place = F.shiftrightunsigned("gram", 64 - bits)
    one = F.expr(f"shiftleft(1L, cast(shiftrightunsigned(gram, {64 - bits}) & 63 AS INT))")
    table = seeds.groupBy(F.shiftright(place, 6).alias("at")).agg(F.bit_or(one).alias("word")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[table["at"].to_numpy()] = np.ascontiguousarray(table["word"].to_numpy()).view(np.uint64)
    return out, bits


def tile(place: np.ndarray, gram: np.ndarray, item: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (item start, text start, length), all in words.

    ``place`` (ascending) and ``gram`` are the text's seeds that occur in the
    item, ``item`` all seeds of the item in order.  Of equally long matches the
    first in the item goes first, then the first in the text.  Matches are
    found by their rolling hashes, longest first, by bisection of the length;
    memory is linear in both sides whatever repeats in them.
    """
    if not len(place):
        return []
    # Seeds further apart than k words don't overlap: their distance is cut.
    at = np.concatenate(([0], np.cumsum(np.minimum(np.diff(place), k + 1))))
    code = np.zeros(at[-1] + 1, np.uint64)
    code[at] = gram
    where = np.zeros(len(code), np.int64)
    where[at] = place
    real = np.zeros(len(code), bool)
    real[at] = True
    up, down = powers(max(len(code), len(item)) + 1)
    sums = [np.concatenate((np.zeros(1, np.uint64), np.cumsum(c * up[: len(c)], dtype=np.uint64))) for c in (item, code)]
    free = [np.ones(len(item) + k - 1, bool), np.ones(len(code) + k - 1, bool)]
    known = [np.ones(len(item), bool), real]

    def starts(side: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Unmarked starts of n seeds in a row (n + k - 1 words), and their hashes."""
        total = len(known[side]) - n + 1
        if total <= 0:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        ok = np.concatenate(([0], np.cumsum(known[side])))
        open_ = np.concatenate(([0], np.cumsum(free[side])))
        good = np.flatnonzero((ok[n : n + total] - ok[:total] == n) & (open_[n + k - 1 : n + k - 1 + total] - open_[:total] == n + k - 1))
        return good, (sums[side][good + n] - sums[side][good]) * down[good]

    def shared(n: int) -> bool:
        return bool(np.isin(starts(0, n)[1], starts(1, n)[1]).any())

    tiles, most = [], min(len(item), len(code))
    while most and shared(1):
        low, high = 1, most
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if shared(middle) else (low, middle - 1)
        length = low + k - 1
        (mine, a), (theirs, b) = starts(0, low), starts(1, low)
        order = np.argsort(b, kind="stable")  # by hash, then by place
        b, theirs = b[order], theirs[order]
        for i, left, right in zip(mine.tolist(), np.searchsorted(b, a, "left").tolist(), np.searchsorted(b, a, "right").tolist()):
            if left == right or not free[0][i : i + length].all():
                continue
            for t in theirs[left:right].tolist():
                if free[1][t : t + length].all():
                    free[0][i : i + length] = free[1][t : t + length] = False
                    tiles.append((i, int(where[t]), length))
                    break
        most = low - 1
    return tiles


def _shared_seeds(keyed: DataFrame, items: DataFrame) -> DataFrame:
    """(k0, k1, item, hits): the places of all seeds a text shares with an item."""
    seeds = items.select("item", "k", F.explode("grams").alias("gram")).distinct()
    number = seeds.count()
    bitmap, bits = _filter(seeds, number)
    lengths = sorted(r.k for r in items.select("k").distinct().collect())  # at most k numbers
    shared = keyed.sparkSession.sparkContext.broadcast(bitmap)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = shared.value
        for batch in sliced(batches):
            w = words(*view(batch.column("text")))
            first = w["first"]
            for length in lengths:
                got = grams(w["hash"], length)
                place = got >> np.uint64(64 - bits)
                hit = np.flatnonzero((bitmap[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1))
                row = w["doc"][hit]
                inside = hit + length <= first[row + 1]
                hit, row = hit[inside], row[inside]
                if len(hit):
                    take = pa.array(row)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("k0").take(take), batch.column("k1").take(take), pa.array((hit - first[row]).astype(np.int64)), pa.array(got[hit].view(np.int64)), pa.array(np.full(len(hit), length))],
                        ["k0", "k1", "pos", "gram", "k"],
                    )

    # A text's copies find the same places: one of each is joined.
    places = mapped(keyed.where("text IS NOT NULL").select("k0", "k1", "text"), scan, "k0 long, k1 long, pos long, gram long, k long").distinct()
    if number <= BROADCAST_ROWS:
        met = places.join(F.broadcast(seeds), ["gram", "k"])
    else:
        salted = seeds.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        met = places.withColumn("salt", F.pmod(F.xxhash64("k0", "pos"), F.lit(SALT)).cast("int")).join(salted, ["gram", "k", "salt"])
    # The list of a text and an item is no longer than the text.
    found = met.groupBy("k0", "k1", "item").agg(F.collect_list(F.struct("pos", "gram")).alias("hits"))
    return found.join(bounded_broadcast(items, rows=number), "item")


def coverages(keyed: DataFrame, benchmark: DataFrame, k: int) -> DataFrame:
    """(k0, k1, item_id, coverage, tiles) of all pairs of a text and an item that share a seed."""
    items = written(_items(benchmark, k), "decon-items")

    def cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            share, number = [], []
            for row in range(batch.num_rows):
                hits = batch.column("hits")[row].values
                place, gram = (np.ascontiguousarray(pc.struct_field(hits, x).to_numpy(zero_copy_only=False)) for x in ("pos", "gram"))
                order = np.argsort(place)
                mine = np.ascontiguousarray(batch.column("grams")[row].values.to_numpy()).view(np.uint64)
                tiles = tile(place[order], gram[order].view(np.uint64), mine, batch.column("k")[row].as_py())
                share.append(sum(t[2] for t in tiles) / batch.column("words")[row].as_py())
                number.append(len(tiles))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("k0", "k1", "item_id")), pa.array(share, pa.float64()), pa.array(number, pa.int32())], ["k0", "k1", "item_id", "coverage", "tiles"])

    return mapped(_shared_seeds(keyed, items), cover, "k0 long, k1 long, item_id long, coverage double, tiles int")


def decontaminate(docs: DataFrame, benchmark: DataFrame, k: int = K, threshold: float = THRESHOLD) -> DataFrame:
    """Adds coverage, item_id, n_tiles, items and contaminated to every document.

    ``coverage`` is the largest share of an item's words under tiles (0 if no
    seed is shared), ``item_id`` that item (the smallest of ties), ``n_tiles``
    its tiles, ``items`` all items whose coverage reaches ``threshold``, sorted.
    Words are ``[0-9a-z]`` and non-ASCII runs of the A-Z-lowered text.  Null
    and empty texts are clean; items without a word match nothing; an item with
    a text but no item_id counts like any other and is reported as null (behind
    the others in ``items`` and in ties); an item of fewer than k words must
    occur whole; repeated items count once.  Whole texts are read; repeated
    rows get the same; input columns of the added names, and of ``_k0`` and
    ``_k1``, are replaced; empty tables are fine on either side.
    """
    added = ["coverage", "item_id", "n_tiles", "items", "contaminated"]
    names = [c for c in docs.columns if c not in (*added, "_k0", "_k1")]
    docs = docs.select(*names)
    k0, k1 = F.xxhash64("text"), F.xxhash64(F.lit("second"), "text")
    pairs = coverages(docs.select(k0.alias("k0"), k1.alias("k1"), "text"), benchmark, k)
    enough = F.col("coverage") >= threshold
    best = F.struct("coverage", F.col("item_id").isNotNull(), -F.coalesce("item_id", F.lit(0)), "tiles", "item_id")
    found = pairs.groupBy(F.col("k0").alias("_k0"), F.col("k1").alias("_k1")).agg(
        F.max(best).alias("best"), F.array_sort(F.collect_set(F.when(enough, F.col("item_id")))).alias("items"),
        F.max(enough & F.col("item_id").isNull()).alias("unnamed"),
    )
    every = F.when(F.col("unnamed"), F.concat("items", F.array(F.lit(None).cast("long")))).otherwise(F.col("items"))
    found = written(found.select("_k0", "_k1", "best.coverage", "best.item_id", F.col("best.tiles").alias("n_tiles"), every.alias("items")), "decon-found")
    # One row of ``found`` for each text: copies of a hot text are split by the
    # adaptive skew join, and texts that cannot match stay out of it.
    some = docs.where("text IS NOT NULL").withColumn("_k0", k0).withColumn("_k1", k1).join(bounded_broadcast(found), ["_k0", "_k1"], "left")
    none = docs.where("text IS NULL").select(*names, *(F.lit(None).cast(t).alias(c) for c, t in (("coverage", "double"), ("item_id", "long"), ("n_tiles", "int"), ("items", "array<long>"))))
    out = some.select(*names, "coverage", "item_id", "n_tiles", "items").unionByName(none)
    items = F.coalesce("items", F.array().cast("array<long>"))
    return out.select(
        *names, F.coalesce("coverage", F.lit(0.0)).alias("coverage"), "item_id", F.coalesce("n_tiles", F.lit(0)).alias("n_tiles"),
        items.alias("items"), (F.size(items) > 0).alias("contaminated"),
    )
