"""N-gram Jaccard self-join by chosen paths.

Each text is its set of word shingles.  A path is a sequence of shingles of the
set: in every run and at every level, a set extends each of its paths by all
its shingles whose hash (with the run and the path so far) lies below
``branching / (threshold * size)``, so a set follows several paths and two sets
that share the most of their shingles share ``branching`` extensions or more
on average.  Sets with the same path are a bucket.  Buckets of more than
``limit`` sets are split by the next level; small buckets, those of the last
level, and large ones whose sets are alike (splitting would only repeat them)
are compared by brute force.  Runs are repeated until a pair at the
threshold is found with the target recall, even if all levels split it.

In a bucket, pairs are first judged by bottom-k sketches of their sets, whose
bound is chosen so that its losses are a part of the target recall, then
exactly.  Large last-level buckets are cut into block pairs, so no task holds an
unbounded bucket; a pair is only judged in the smallest bucket number it
shares, and only counts and a spanning forest leave a block, never all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_broadcast, connected_components, mapped, written
from .textvec import complete_groups, mix, pairs_at, shingles, sliced, view, words

SHINGLE = 5
THRESHOLD = 0.8
RECALL = 0.9995
LEVELS = 3
#: Shared extensions of a path that a pair at the threshold has on average.  At 1
#: half-alike pairs die out fastest but more runs are needed; at 2 they multiply.
BRANCHING = 1.5
LIMIT = 64
#: Share of a large bucket's sets with the most common probes (minimal hashes of
#: PROBES classes of shingles) from which it is not split.
ALIKE = 0.6
PROBES = 4
BLOCK = 512
#: Shingle hashes in a sketch, and the share of pairs at the threshold that the
#: sketches may lose.
SKETCH = 64
SKETCH_LOSS = 1e-4
KEYS = ["leaf", "low", "high"]
#: Pairs handled at once, and groups up to which pairs are listed across groups.
_PAIRS = 8192
_SMALL = 40
_NONE = np.int64((1 << 63) - 1)


def survival(levels: int, branching: float) -> float:
    """Chance that a pair at the threshold shares a path of full length in a run.

    The number of shared extensions of a path is binomial with a mean of at
    least ``branching``; a Poisson number has more of its weight at 0.
    """
    q = 1.0
    for _ in range(levels):
        q = 1 - math.exp(-branching * q)
    return q


def runs_needed(recall: float, levels: int = LEVELS, branching: float = BRANCHING) -> int:
    """Runs so that a pair at the threshold is found even if all levels split it."""
    lost = max(1 - survival(levels, branching), 1e-300)
    return max(1, math.ceil(math.log(1 - recall) / math.log(lost)))


def sketch_bound(size: int, threshold: float, loss: float) -> int:
    """Largest number of matches that a pair at the threshold misses with chance ``loss`` at most."""
    total, k = 0.0, 0
    while True:
        total += math.comb(size, k) * threshold**k * (1 - threshold) ** (size - k)
        if total > loss:
            return k
        k += 1


def _sets(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row's text, and their offsets."""
    code, offsets = shingles(words(*view(batch.column("text"))), k)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    order = np.lexsort((code, row))
    code, row = code[order], row[order]
    new = np.ones(len(code), bool)
    new[1:] = (code[1:] != code[:-1]) | (row[1:] != row[:-1])
    return code[new], np.searchsorted(row[new], np.arange(len(offsets)))


def _bounds(size: np.ndarray, threshold: float, branching: float) -> np.ndarray:
    """Hash below which a shingle of a set of the given size extends a path."""
    rate = np.minimum(branching / (threshold * np.maximum(size, 1)), 1.0)
    return np.minimum(rate * 2.0**64, 2.0**64 - 2048).astype(np.uint64)


def _chance(code: np.ndarray, seed) -> np.ndarray:
    """Hash of shingles under a path (or a run's seed)."""
    x = (code ^ seed) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _extended(path, code: np.ndarray) -> np.ndarray:
    return mix(path * np.uint64(0x9E3779B97F4A7C15) + code)


def _list_array(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.view(np.int64)))


def first_paths(texts: DataFrame, k: int, runs: int, threshold: float, branching: float) -> DataFrame:
    """(key, text) to (key, size, sketch, probes, paths): one step of every run's paths."""
    seeds = mix(np.arange(1, runs + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            code, offsets = _sets(batch, k)
            size = np.diff(offsets)
            row = np.repeat(np.arange(len(size)), size)
            bound = _bounds(size, threshold, branching)[row]
            path, owner = [], []
            for seed in seeds:
                hit = np.flatnonzero(_chance(code, seed) < bound)
                path.append(_extended(np.full(len(hit), seed), code[hit]))
                owner.append(row[hit])
            path, owner = np.concatenate(path), np.concatenate(owner)
            order = np.argsort(owner, kind="stable")
            path, owner = path[order], owner[order]
            has = np.flatnonzero(size)
            low = np.minimum(size, SKETCH)
            at = np.arange(low.sum()) - np.repeat(np.cumsum(low) - low, low) + np.repeat(offsets[:-1], low)
            sketches = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(low))).astype(np.int32)), pa.array((code[at] >> np.uint64(32)).astype(np.int64) - (1 << 31), pa.int32()))
            lists = _list_array(path, np.searchsorted(owner, np.arange(len(size) + 1)))
            take = pa.array(has)
            probes = np.full((len(size), PROBES), -1)
            kind = (code % np.uint64(PROBES)).astype(np.int64)
            for j in range(PROBES):
                mine = np.flatnonzero(kind == j)[::-1]  # the smallest of each row is written last
                probes[row[mine], j] = (code[mine] >> np.uint64(32)).astype(np.int64)
            tests = pa.ListArray.from_arrays(pa.array(np.arange(len(size) + 1, dtype=np.int32) * PROBES), pa.array(probes.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("key").take(take), pa.array(size[has].astype(np.int32)), *(x.take(take) for x in (sketches, tests, lists))], ["key", "size", "sketch", "probes", "paths"])

    return mapped(texts.select("key", "text"), sign, "key string, size int, sketch array<int>, probes array<long>, paths array<long>")


def deeper_paths(texts: DataFrame, k: int, levels: int, threshold: float, branching: float) -> DataFrame:
    """(key, text, paths) to (key, level, parent, paths): all extensions of the given paths, a row for each path."""

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            code, offsets = _sets(batch, k)
            size = np.diff(offsets)
            bound = _bounds(size, threshold, branching)
            lists = batch.column("paths")
            path = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            row = np.repeat(np.arange(len(size)), lists.value_lengths().to_numpy(zero_copy_only=False))
            for level in range(2, levels + 1):
                found = []
                upto = np.cumsum(size[row])
                cuts = np.searchsorted(upto, np.arange(0, (upto[-1] if len(upto) else 0) + (1 << 20), 1 << 20))
                for a, b in zip(cuts, [*cuts[1:], len(row)]):
                    if a == b:
                        continue
                    mine, number = row[a:b], size[row[a:b]]
                    at = np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number) + np.repeat(offsets[mine], number)
                    which = np.repeat(np.arange(a, b), number)
                    token = code[at]
                    hit = np.flatnonzero(_chance(token, path[which]) < bound[row[which]])
                    which = which[hit]
                    found.append((which, _extended(path[which], token[hit])))
                if not found:
                    break
                which, longer = (np.concatenate(x) for x in zip(*found))
                of, first = np.unique(which, return_index=True)  # ascending already
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key").take(pa.array(row[of])), pa.array(np.full(len(of), level, np.int32)), pa.array(path[of].view(np.int64)), _list_array(longer, np.append(first, len(which)))],
                    ["key", "level", "parent", "paths"],
                )
                row, path = row[which], longer

    return mapped(texts.select("key", "text", "paths"), extend, "key string, level int, parent long, paths array<long>")


def _buckets(rows: DataFrame, limit: int, tag: str) -> tuple[DataFrame, DataFrame]:
    """(key, leaf, size) of the buckets with 2 to ``limit`` sets, and (path, size) of the larger ones.

    Larger buckets are known from counts alone; they are out of the way before
    the members of small ones are put together.
    """
    large = written(rows.groupBy("path").agg(F.count("*").alias("size")).where(F.col("size") > limit), tag)
    small = rows.join(bounded_broadcast(large.select("path")), "path", "left_anti")
    small = small.groupBy("path").agg(F.collect_list("key").alias("keys")).where("size(keys) > 1")
    return small.select(F.explode("keys").alias("key"), F.col("path").alias("leaf"), F.size("keys").cast("long").alias("size")), large


def _alike(rows: DataFrame, large: DataFrame, share: float) -> DataFrame:
    """(path, size) of the large buckets in which most sets have the same probes."""
    probed = rows.join(bounded_broadcast(large), "path").select("path", "size", F.posexplode("probes").alias("kind", "probe"))
    times = probed.groupBy("path", "size", "kind", "probe").agg(F.count("*").alias("n"))
    most = times.groupBy("path", "size", "kind").agg(F.max("n").alias("n"))
    return most.groupBy("path", "size").agg(F.avg(F.col("n") / F.col("size")).alias("share")).where(F.col("share") >= share).drop("share")


def leaves(signed: DataFrame, texts, k: int, levels: int, limit: int, threshold: float, branching: float, alike: float) -> DataFrame:
    """(key, leaf, size) of all buckets with two sets or more; ``texts(keys)``
    gives (key, text) for the keys of a table."""
    probed = signed.select("key", "probes", F.explode("paths").alias("path"))
    rows = probed.select("key", "path")
    out, large = _buckets(rows, limit, "join-large")
    if large.isEmpty():
        return out
    done = large if levels == 1 else written(_alike(probed, large, alike), "join-alike")
    out = out.unionByName(_whole(rows, done))
    large = large.join(done.select("path"), "path", "left_anti")
    if large.isEmpty():
        return out
    # Only sets of large buckets go on, with those of their paths.
    deep = rows.join(bounded_broadcast(large.select("path")), "path", "left_semi").groupBy("key").agg(F.collect_list("path").alias("paths"))
    deep = written(deep, "join-deep")
    every = written(deeper_paths(texts(deep).join(deep, "key"), k, levels, threshold, branching), "join-paths")
    for level in range(2, levels + 1):
        rows = every.where(F.col("level") == level)
        if level > 2:
            rows = rows.join(bounded_broadcast(large.select(F.col("path").alias("parent"))), "parent", "left_semi")
        rows = rows.select("key", F.explode("paths").alias("path"))
        small, large = _buckets(rows, limit, "join-large")
        out = out.unionByName(small)
        if large.isEmpty():
            break
        if level == levels:
            out = out.unionByName(_whole(rows, large))
    return out


def _whole(rows: DataFrame, large: DataFrame) -> DataFrame:
    return rows.join(bounded_broadcast(large), "path").select("key", F.col("path").alias("leaf"), "size")


def padded(column: pa.ChunkedArray, fill) -> np.ndarray:
    """A list column as a matrix of sorted rows, filled up behind."""
    column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    number = column.value_lengths().to_numpy(zero_copy_only=False)
    out = np.full((len(number), max(1, number.max(initial=1))), fill, np.int64)
    row = np.repeat(np.arange(len(number)), number)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(number) - number, number)] = column.flatten().to_numpy(zero_copy_only=False)
    return np.sort(out, axis=1)


def similar(sketch: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float, loss: float) -> np.ndarray:
    """Which pairs of rows their bottom-k sketches don't rule out.

    Of the k smallest hashes of the union, the share in both sets estimates
    the similarity; unions of fewer hashes are known whole.
    """
    both = np.sort(np.concatenate((sketch[a], sketch[b]), axis=1), axis=1)
    real = both != _NONE
    twice = np.zeros(both.shape, bool)
    twice[:, 1:] = (both[:, 1:] == both[:, :-1]) & real[:, 1:]
    place = np.cumsum(real & ~twice, axis=1)
    matches, union = (twice & (place <= SKETCH)).sum(1), place[:, -1]
    bound = sketch_bound(SKETCH, threshold, loss)
    return np.where(union >= SKETCH, matches >= bound, matches >= threshold * union - 1e-9)


def _first(leaf: np.ndarray, own: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs share no leaf with a smaller number than their own."""
    both = np.sort(np.concatenate((leaf[a], leaf[b]), axis=1), axis=1)
    return ~((both[:, 1:] == both[:, :-1]) & (both[:, 1:] < own[a][:, None])).any(1)


def _judged(table: pa.Table, group: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows that their group has to judge: first shared leaf, right blocks."""
    low, high, block, own = (table[c].to_numpy() for c in ("low", "high", "block", "leaf"))
    leaf = padded(table["leaves"], _NONE)
    size = np.bincount(group)[group]
    few = np.where(size <= _SMALL, group, -1 - np.arange(len(group)))
    for distance in range(1, _SMALL):
        a = pairs_at(few, distance)
        if not len(a):
            break
        a = a[(low[a] == high[a]) | (block[a] != block[a + distance])]
        for x in range(0, len(a), _PAIRS):
            some = a[x : x + _PAIRS]
            ok = _first(leaf, own, some, some + distance)
            yield some[ok], some[ok] + distance
    for g in np.unique(group[size > _SMALL]):
        start, end = np.searchsorted(group, (g, g + 1))
        rows = np.arange(start, end)
        earlier = [x[x < own[start]].astype(np.uint64) for x in leaf[start:end]]
        ok = np.triu(intersections(earlier) == 0, 1)
        if low[start] != high[start]:
            ok &= block[rows][:, None] != block[rows][None, :]
        a, b = np.nonzero(ok)
        for x in range(0, len(a), _PAIRS):
            yield a[x : x + _PAIRS] + start, b[x : x + _PAIRS] + start


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections of sets of hashes."""
    n = len(sets)
    code = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    every, inverse, times = np.unique(code, return_inverse=True, return_counts=True)
    shared = np.flatnonzero(times > 1)
    place = np.full(len(every), -1)
    place[shared] = np.arange(len(shared))
    column = place[inverse]
    owner, column = owner[column >= 0], column[column >= 0]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((n, n), np.float32)
    step = max(256, (8 << 20) // max(1, n))
    for a in range(0, len(shared), step):
        lo, hi = np.searchsorted(column, (a, a + step))
        block = np.zeros((n, min(step, len(shared) - a)), np.float32)
        block[owner[lo:hi], column[lo:hi] - a] = 1
        out += block @ block.T
    return out


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest reachable row of each row, for links (a, b)."""
    label = np.arange(n)
    while len(a):
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            break
    return label


def near_duplicates(docs: DataFrame, k: int = SHINGLE, threshold: float = THRESHOLD, recall: float = RECALL, levels: int = LEVELS, limit: int = LIMIT, block: int = BLOCK, branching: float = BRANCHING, loss: float = SKETCH_LOSS, alike: float = ALIKE) -> DataFrame:
    """Adds class_id, n_links and kept to every document.

    ``class_id`` is the smallest doc_id of the documents joined by links,
    ``n_links`` the number of other documents with Jaccard similarity of at
    least ``threshold`` (copies included), ``kept`` marks one document per
    class (repeated rows of the kept doc_id are all but one dropped).

    Texts are compared as sets of lower-cased (A-Z) word k-shingles; a text
    of fewer than k words is one shingle of all its words.  Null texts and
    texts without a word link with nothing.  A null doc_id sorts last in its
    class.  Whole texts are read; no bucket or partner is dropped.  Columns of
    the three names in the input are replaced; an empty table stays empty.
    """
    # Runs and sketches together lose at most 1 - recall of the pairs at the threshold.
    loss = min(loss, (1 - recall) / 2)
    runs = runs_needed(recall / (1 - loss), levels, branching)
    names = [c for c in docs.columns if c not in ("class_id", "n_links", "kept")]
    docs = docs.select(*names)
    key = F.md5(F.col("text").cast("binary"))
    # Exact copies are one set: a partial aggregate, whatever the group's size.
    groups = docs.where("text IS NOT NULL").groupBy(key.alias("key")).agg(F.min("doc_id").alias("low"), F.count("*").alias("copies"))
    groups = written(groups, "join-groups")
    chosen = docs.where("text IS NOT NULL").select(key.alias("key"), "doc_id", "text")

    def texts(keys: DataFrame) -> DataFrame:
        """One text for each key: that of its smallest doc_id, so a hot text's copies stay where they are."""
        wanted = written(keys.select("key").distinct().join(groups, "key").select(F.col("key").alias("_k"), F.col("low").alias("_low")), "join-wanted")
        met = F.col("key").eqNullSafe(F.col("_k")) & F.col("doc_id").eqNullSafe(F.col("_low"))
        return chosen.join(bounded_broadcast(wanted), met, "left_semi").select("key", "text").dropDuplicates(["key"])

    signed = first_paths(chosen, k, runs, threshold, branching).groupBy("key")
    signed = written(signed.agg(F.first("size").alias("size"), *(F.first(c).alias(c) for c in ("sketch", "probes", "paths"))), "join-signed")
    found = written(leaves(signed, texts, k, levels, limit, threshold, branching, alike), "join-leaves")
    of_key = found.groupBy("key").agg(F.array_sort(F.collect_list("leaf")).alias("leaves"))
    members = found.join(of_key, "key").join(signed.select("key", F.col("size").alias("shingles"), "sketch"), "key")
    parts = F.ceil(F.col("size") / block).cast("int")
    members = members.withColumn("parts", parts).withColumn("block", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    members = members.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, group in complete_groups(batches, KEYS):
            sketch, size = padded(table["sketch"], _NONE), table["shingles"].to_numpy()
            hit = np.zeros(table.num_rows, bool)
            for a, b in _judged(table, group):
                near = np.minimum(size[a], size[b]) >= threshold * np.maximum(size[a], size[b]) - 1e-9
                a, b = a[near], b[near]
                ok = similar(sketch, a, b, threshold, loss)
                hit[a[ok]] = hit[b[ok]] = True
            yield from table.drop_columns(["sketch", "shingles"]).filter(pa.array(hit)).to_batches()

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.repartition(*KEYS).sortWithinPartitions(*KEYS)

    schema = "leaf long, low int, high int, key string, block int, leaves array<long>"
    kept = mapped(dealt(members.select(*KEYS, "key", "block", "leaves", "sketch", "shingles")), candidates, schema)
    kept = written(kept, "join-candidates")
    sized = kept.join(groups.select("key", "copies"), "key").join(texts(kept), "key").select(*KEYS, "key", "block", "leaves", "copies", "text")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, group in complete_groups(batches, KEYS, 1024):
            sets: list[np.ndarray] = []
            for part in sliced(iter(pa.Table.from_arrays([table["text"].cast(pa.large_string())], ["text"]).combine_chunks().to_batches())):
                code, offsets = _sets(part, k)
                sets += [code[a:b] for a, b in zip(offsets, offsets[1:])]
            size = np.array([len(s) for s in sets], np.int64)
            found = [[], []]
            for a, b in _judged(table, group):
                ok = np.minimum(size[a], size[b]) >= threshold * np.maximum(size[a], size[b]) - 1e-9
                found[0].append(a[ok])
                found[1].append(b[ok])
            a, b = (np.concatenate([*x, np.empty(0, np.int64)]) for x in found)
            order = np.argsort(group[a], kind="stable")
            a, b = a[order], b[order]
            common = np.empty(len(a), np.int64)
            cuts = np.flatnonzero(np.diff(group[a], prepend=-1))
            for lo, hi in zip(cuts, [*cuts[1:], len(a)]):
                if hi - lo > 40:
                    first, last = np.searchsorted(group, (group[a[lo]], group[a[lo]] + 1))
                    common[lo:hi] = intersections(sets[first:last])[a[lo:hi] - first, b[lo:hi] - first]
                else:
                    common[lo:hi] = [len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(a[lo:hi], b[lo:hi])]
            link = common >= threshold * (size[a] + size[b] - common) - 1e-9
            a, b = a[link], b[link]
            copies = table["copies"].to_numpy()
            number = np.zeros(len(size), np.int64)
            np.add.at(number, a, copies[b])
            np.add.at(number, b, copies[a])
            root = forest(len(size), a, b)
            has = pa.array(np.flatnonzero(number))
            name = table["key"].combine_chunks()
            yield pa.RecordBatch.from_arrays([name.take(has), pa.array(number[number > 0]), name.take(pa.array(root[number > 0]))], ["key", "links", "root"])

    judged = written(mapped(dealt(sized), verify, "key string, links long, root string"), "join-links")
    links = judged.groupBy("key").agg(F.sum("links").alias("links"))
    classes = connected_components(judged.select(F.col("key").alias("u"), F.col("root").alias("v")))
    member = groups.join(links, "key", "left").join(classes.withColumnRenamed("node", "key"), "key", "left")
    has_word = signed.select("key", F.lit(True).alias("_word"))
    member = member.join(has_word, "key", "left").withColumn("component", F.coalesce("component", "key"))
    lowest = member.where("_word").groupBy("component").agg(F.min("low").alias("class_id"))
    member = member.join(lowest, "component", "left").select(
        F.col("key").alias("_key"), F.col("_word"), "class_id",
        F.when(F.col("_word"), F.coalesce("links", F.lit(0)) + F.col("copies") - 1).otherwise(0).alias("n_links"),
    )
    # Only texts in a group of their own are absent from ``special``.
    special = written(member.where("n_links > 0"), "join-special")
    out = docs.withColumn("_key", key)
    out = out.join(bounded_broadcast(special), "_key", "left")
    out = out.withColumn("class_id", F.coalesce("class_id", "doc_id")).withColumn("n_links", F.coalesce("n_links", F.lit(0)).cast("long"))
    linked = F.col("n_links") > 0
    heads = out.where(linked & F.col("doc_id").eqNullSafe(F.col("class_id")))
    once = Window.partitionBy("class_id").orderBy("_key")
    repeated = heads.groupBy("class_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("class_id").alias("_again"))
    plain = out.withColumn("kept", ~linked | F.col("doc_id").eqNullSafe(F.col("class_id")))
    if repeated.isEmpty():
        return plain.select(*names, "class_id", "n_links", "kept")
    # Repeated rows of a head: the first of them stays.
    hit = plain.join(bounded_broadcast(repeated), F.col("class_id").eqNullSafe(F.col("_again")), "left")
    rest = hit.where("_again IS NULL OR NOT kept")
    first = hit.where("_again IS NOT NULL AND kept").withColumn("_n", F.row_number().over(once)).withColumn("kept", F.col("_n") == 1).drop("_n")
    return rest.unionByName(first).select(*names, "class_id", "n_links", "kept")
