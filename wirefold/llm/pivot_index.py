"""Near-duplicate vectors through a pivot-permutation index.

Every vector is described by its nearest pivots in order (its permutation
prefix) and posted to the inverted list of each of them.  Two vectors that
meet in a list are candidates if their prefixes share at least ``shared``
pivots; candidates are verified by cosine in double precision.  A pair is
judged only in the list of its first shared pivot, long lists are cut into
block pairs, and only link counts and spanning links leave a list, so neither
a hot list nor a dense group is held by one task or written out as pairs.

Pivots are vectors of a bounded sample, ``pivots_per_root`` times the square
root of a label's size, at most ``max_pivots``.  A sampled vector near an
earlier pivot is left out: pivots inside one dense group would order its
members by noise.  Every vector is indexed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_broadcast, connected_components, mapped, written
from .ngram_join import forest
from .textvec import complete_groups, matrix, pairs_at

THRESHOLD = 0.98
PREFIX = 8
SHARED = 2
PIVOTS_PER_ROOT = 2.0
MAX_PIVOTS = 2048
BLOCK = 1024
#: Cosine from which a sampled vector is too near to a pivot to be one.
APART = 0.8
KEYS = ["label", "pivot", "low", "high"]


def _pivots(vectors: DataFrame, per_root: float, most: int) -> dict[int, np.ndarray]:
    """Unit pivot vectors per label (code), from a sample bounded by ``most``."""
    sizes = {r.label: r.n for r in vectors.groupBy("label").agg(F.count("*").alias("n")).collect()}
    want = {c: min(most, max(8, math.ceil(per_root * math.sqrt(n)))) for c, n in sizes.items()}
    # A threshold on a hash leaves about twice as many rows as are wanted.
    share = F.element_at(F.create_map(*[F.lit(x) for c in sizes for x in (c, min(1.0, 2 * want[c] / sizes[c] + 20 / sizes[c]))]), F.col("label"))
    chance = F.pmod(F.xxhash64("key", F.lit(1)), F.lit(1 << 20)) / float(1 << 20)
    rows = vectors.where(chance <= share).select("label", "key", "unit").collect()  # at most about 2 * most per label
    out, number = {}, dict.fromkeys(sizes, 0)
    for r in sorted(rows, key=lambda r: (r.label, r.key)):
        x, n = np.frombuffer(r.unit, np.float64), number[r.label]
        mine = out.setdefault(r.label, np.empty((want[r.label], len(x))))
        if n < want[r.label] and (not n or (mine[:n] @ x).max() < APART):
            mine[n] = x
            number[r.label] += 1
    return {c: v[: number[c]] for c, v in out.items()}


def near_vectors(table: DataFrame, threshold: float = THRESHOLD, prefix: int = PREFIX, shared: int = SHARED, per_root: float = PIVOTS_PER_ROOT, max_pivots: int = MAX_PIVOTS, block: int = BLOCK) -> DataFrame:
    """Adds n_links, component_id and kept to every (vec_id, embedding, label).

    Links join vectors of one non-null label whose cosine is at least
    ``threshold``.  Null, zero or wrong vectors (a null or non-finite
    component, or another length than most of their label) link with nothing.  Exact
    copies are one entry of the index and link with each other.
    ``component_id`` is the smallest vec_id reachable; repeated rows of one
    vec_id count as vectors of their own.  Only vec_id, embedding and label
    are read; other columns pass through, those of the added names are
    replaced; an empty table stays empty.
    """
    names = [c for c in table.columns if c not in ("n_links", "component_id", "kept")]
    table = table.select(*names)
    key = F.md5(F.concat_ws(",", F.col("label").cast("string"), F.lit("|"), F.col("embedding").cast("array<string>")).cast("binary"))
    usable = F.col("label").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)
    usable &= ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    usable &= F.exists("embedding", lambda x: x != 0)
    keyed = table.withColumn("_key", F.when(usable, key))
    groups = keyed.where("_key IS NOT NULL").groupBy(F.col("_key").alias("key")).agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"), F.min("label").cast("string").alias("name"), F.first("embedding").alias("embedding"))

    def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for v in batch.column("embedding").to_pylist():
                x = np.array(v, np.float64)
                x /= np.abs(x).max()
                out.append((x / np.sqrt(x @ x)).tobytes())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "first", "copies")), batch.column("name"), pa.array([len(u) // 8 for u in out]), pa.array(out, pa.binary())], ["key", "first", "copies", "name", "width", "unit"])

    kind = table.schema["vec_id"].dataType.simpleString()
    vectors = mapped(groups, unit, f"key string, first {kind}, copies long, name string, width long, unit binary")
    # Vectors of different lengths never link: the length is part of the label.
    vectors = written(vectors.withColumn("label", F.xxhash64("name", "width")), "pivot-vectors")
    pivots = vectors.sparkSession.sparkContext.broadcast(_pivots(vectors, per_root, max_pivots))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = batch.column("label").to_numpy()
            for c in np.unique(label):
                row = np.flatnonzero(label == c)
                x = np.frombuffer(b"".join(batch.column("unit").take(pa.array(row)).to_pylist()), np.float64).reshape(len(row), -1)
                near = x @ pivots.value[c].T
                k = min(prefix, near.shape[1])
                top = np.argpartition(-near, k - 1, axis=1)[:, :k]
                order = np.take_along_axis(top, np.argsort(-np.take_along_axis(near, top, 1), axis=1, kind="stable"), 1)
                order = np.pad(order, ((0, 0), (0, prefix - k)), constant_values=-1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, order.size + 1, prefix, dtype=np.int32)), pa.array(order.ravel().astype(np.int32)))
                part = batch.take(pa.array(row)) if hasattr(batch, "take") else pa.Table.from_batches([batch]).take(pa.array(row)).combine_chunks().to_batches()[0]
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in ("label", "key", "copies", "unit")), lists], ["label", "key", "copies", "unit", "prefix"])

    posted = written(mapped(vectors, post, "label long, key string, copies long, unit binary, prefix array<int>"), "pivot-posted")
    entries = posted.withColumn("pivot", F.explode("prefix")).where("pivot >= 0")
    sizes = posted.select("label", F.explode("prefix").alias("pivot")).groupBy("label", "pivot").agg(F.count("*").alias("size")).where("size > 1")
    entries = entries.join(bounded_broadcast(sizes), ["label", "pivot"])
    entries = entries.withColumn("parts", F.ceil(F.col("size") / block).cast("int"))
    entries = entries.withColumn("block", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))
    entries = entries.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    entries = entries.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
    entries = entries.select(*KEYS, "block", "key", "copies", "unit", "prefix")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, group in complete_groups(batches, KEYS):
            pre, pivot = matrix(table["prefix"], prefix), table["pivot"].to_numpy()
            low, high, part, copies = (table[c].to_numpy() for c in ("low", "high", "block", "copies"))
            raw = table["unit"].to_pylist()
            cuts = np.append(np.flatnonzero(np.diff(group, prepend=-1)), len(group))
            a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for start, end in zip(cuts, cuts[1:]):
                x = np.frombuffer(b"".join(raw[start:end]), np.float64).reshape(end - start, -1)
                mine, n = pre[start:end], end - start
                # Shared-pivot counts, and those below this list's pivot.
                every, place = np.unique(mine, return_inverse=True)
                bits = np.zeros((n, len(every)), np.float32)
                bits[np.repeat(np.arange(n), prefix), place.ravel()] = every[place.ravel()] >= 0
                common = bits @ bits.T
                earlier = bits[:, every < pivot[start]]
                ok = (common >= min(shared, int((mine[0] >= 0).sum()))) & (earlier @ earlier.T == 0)
                if low[start] != high[start]:
                    ok &= part[start:end, None] != part[None, start:end]
                i, j = np.nonzero(np.triu(ok & (x @ x.T >= threshold - 1e-9), 1))
                link = np.einsum("ij,ij->i", x[i], x[j]) >= threshold
                a.append(i[link] + start)
                b.append(j[link] + start)
            a, b = np.concatenate(a), np.concatenate(b)
            number = np.zeros(len(group), np.int64)
            np.add.at(number, a, copies[b])
            np.add.at(number, b, copies[a])
            root = forest(len(group), a, b)
            has = pa.array(np.flatnonzero(number))
            name = table["key"].combine_chunks()
            yield pa.RecordBatch.from_arrays([name.take(has), pa.array(number[number > 0]), name.take(pa.array(root[number > 0]))], ["key", "links", "root"])

    judged = mapped(entries.repartition(*KEYS).sortWithinPartitions(*KEYS), verify, "key string, links long, root string")
    judged = written(judged, "pivot-links")
    classes = connected_components(judged.select(F.col("key").alias("u"), F.col("root").alias("v")))
    member = vectors.select("key", "first", "copies")
    member = member.join(judged.groupBy("key").agg(F.sum("links").alias("links")), "key", "left")
    member = member.join(classes.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    lowest = member.groupBy("component").agg(F.min("first").alias("component_id"))
    member = member.join(lowest, "component").select(F.col("key").alias("_key"), "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = keyed.join(member, "_key", "left")
    return out.select(
        *names, F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        F.col("vec_id").eqNullSafe(F.coalesce("component_id", "vec_id")).alias("kept"),
    )
