"""License scans by diagonal voting.

All rolling word ``k``-gram hashes of all documents are joined to the
template positions with the same hash.  A hit votes for its diagonal, the
document position minus the template position; votes are counted per diagonal,
neighbouring diagonals (inserted or missing words) are merged, and spans with
enough votes are verified word by word.
"""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_broadcast, extended, mapped, written
from .textvec import grams, sliced, view, words

K = 2
#: Diagonals at most so far apart are one alignment.
NEAR = 2
#: Share of a notice's k-grams that must vote, and of its words that must match.
VOTES = 0.55
MATCH = 0.75

# Phrases whose every place counts, and their labels.
PHRASES = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]
# Notices of common licenses and their labels.
NOTICES = [
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("you may not use this file except in compliance with the license", "apache-2.0"),
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("licensed under the gnu general public license version 3", "gpl-3.0"),
    ("licensed under the gnu general public license version 2", "gpl-2.0"),
    ("under the terms of the gnu general public license as published by the free software foundation", "gpl"),
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0"),
    ("licensed under cc by sa 4 0", "cc-by-sa-4.0"),
    ("licensed under cc by 4 0", "cc-by-4.0"),
    ("licensed under a creative commons attribution 4 0 international license", "cc-by-4.0"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("mozilla public license version 2 0", "mpl-2.0"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
]


def template_rows(templates: list[str], k: int) -> list[tuple[int, int, int]]:
    """(hash, template, position) of every k-gram of the templates."""
    rows = []
    for i, text in enumerate(templates):
        w = words(*view(pa.array([text], pa.large_string())))
        rows += [(int(h), i, j) for j, h in enumerate(grams(w["hash"], k).view(np.int64))]
    return rows


def _best(spans: list[dict]) -> list[dict]:
    """Without the spans that overlap a more similar one."""
    kept: list[dict] = []
    for s in sorted(spans, key=lambda s: -s["similarity"]):
        a, b = s["first_word"], s["first_word"] + s["n_words"]
        if not any(x["similarity"] > s["similarity"] and x["first_word"] < b and a < x["first_word"] + x["n_words"] for x in kept):
            kept.append(s)
    return kept


def _hashed(docs: DataFrame, k: int) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            w = words(*view(batch.column("text")))
            first = w["first"]
            number = np.maximum(np.diff(first) - k + 1, 0)
            rolled = grams(w["hash"], k).view(np.int64)
            ends = np.cumsum(number)
            at = np.arange(ends[-1]) - np.repeat(ends - number, number) + np.repeat(first[:-1], number)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(rolled[at]))
            yield pa.RecordBatch.from_arrays([batch.column("_k0"), batch.column("_k1"), lists], ["_k0", "_k1", "grams"])

    return mapped(docs.select("_k0", "_k1", "text"), scan, "_k0 long, _k1 long, grams array<long>")


def scan_licenses(docs: DataFrame, k: int = K, near: int = NEAR, votes: float = VOTES, match: float = MATCH) -> DataFrame:
    """Adds n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    ``n_base`` counts all places of the fixed phrases, ``first_word`` and
    ``last_word`` are their smallest and largest start (words from 0; null
    without one).  ``spans`` lists every verified alignment (label, first
    word, words, similarity); ``labels`` are the distinct labels of phrases
    and spans, ``score`` the best similarity (a bare phrase counts 0.5).

    A null text is empty; texts without a word have no labels; whole texts are
    scanned and repeated rows get the same.  Input columns of the added names,
    and of ``_k0`` and ``_k1``, are replaced; an empty table stays empty.
    """
    added = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
    names = [c for c in docs.columns if c not in (*added, "_k0", "_k1", "_found")]
    docs = docs.select(*names)
    spark = docs.sparkSession
    texts = [t for t, _ in PHRASES] + [t for t, _ in NOTICES]
    labels = [x for _, x in PHRASES] + [x for _, x in NOTICES]
    size = [len(t.split()) for t in texts]
    # The templates are fixed values, a few hundred rows.
    templates = F.broadcast(spark.createDataFrame(template_rows(texts, k), "gram long, template int, at int"))
    # Null texts meet nothing: keys of their own keep them apart in a shuffle.
    k0 = F.when(F.col("text").isNull(), F.monotonically_increasing_id()).otherwise(F.xxhash64("text"))
    keyed = docs.withColumn("_k0", k0).withColumn("_k1", F.xxhash64(F.lit("second"), "text"))
    rows = _hashed(keyed.where("text IS NOT NULL"), k).select("_k0", "_k1", F.posexplode("grams").alias("pos", "gram"))
    hits = rows.join(templates, "gram").select("_k0", "_k1", "template", (F.col("pos") - F.col("at")).alias("diagonal"), "pos").distinct()
    by = hits.groupBy("_k0", "_k1", "template", "diagonal").agg(F.count("*").alias("votes"), F.min("pos").alias("low"), F.max("pos").alias("high"))
    # Neighbouring diagonals of one text and template: a run without a large gap.
    order = Window.partitionBy("_k0", "_k1", "template").orderBy("diagonal", "low")
    gap = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(order) > near) | (F.col("low") - F.lag("low").over(order) > 40), F.lit(True))
    phrase = F.col("template") < len(PHRASES)
    by = by.withColumn("run", F.when(phrase, F.col("diagonal")).otherwise(F.sum(gap.cast("int")).over(order)))
    runs = by.groupBy("_k0", "_k1", "template", "run").agg(F.sum("votes").alias("votes"), F.min("low").alias("low"), F.max("high").alias("high"), F.min("diagonal").alias("diagonal"))
    words_in = F.element_at(F.array(*map(F.lit, size)), F.col("template") + 1)
    enough = F.when(phrase, F.col("votes") == words_in - k + 1).otherwise(F.col("votes") >= votes * (words_in - k + 1))
    found = runs.where(enough).groupBy("_k0", "_k1").agg(F.collect_list(F.struct("template", "diagonal", "low", "high")).alias("_found"))
    found = written(found, "license-found")
    total = found.agg(F.sum(F.size("_found"))).first()[0] or 0
    met = keyed.join(bounded_broadcast(found, rows=total), ["_k0", "_k1"], "left").select(*names, "_found")
    schema = extended(
        docs.schema,
        "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, "
        "spans array<struct<label:string,first_word:bigint,n_words:bigint,similarity:double>>",
    )
    split = [t.split() for t in texts]

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            w = words(*view(batch.column("text")))
            first, raw = w["first"], w["bytes"]
            out = []
            for i, got in enumerate(batch.column("_found").to_pylist()):
                number = int(first[i + 1] - first[i])
                if not got:
                    out.append((number, 0, None, None, "", "", 0.0, []))
                    continue
                start, end = w["start"][first[i] : first[i + 1]], w["end"][first[i] : first[i + 1]]

                def text(a: int, b: int) -> list[str]:
                    return [raw[x:y].tobytes().decode("utf-8", "replace") for x, y in zip(start[max(a, 0) : b], end[max(a, 0) : b])]  # noqa: B023

                places, base, spans = [], set(), []
                for f in got:
                    t, template = f["template"], split[f["template"]]
                    if t < len(PHRASES):
                        if text(f["diagonal"], f["diagonal"] + len(template)) == template:
                            places.append(f["diagonal"])
                            base.add(labels[t])
                        continue
                    a = max(0, f["low"] - 2)
                    b = min(number, max(f["high"] + k + 2, f["low"] + len(template) + near))
                    blocks = SequenceMatcher(None, text(a, b), template, autojunk=False).get_matching_blocks()
                    if len(blocks) < 2:
                        continue
                    lo, hi = a + blocks[0].a, a + blocks[-2].a + blocks[-2].size
                    share = sum(x.size for x in blocks) / max(len(template), hi - lo)
                    met = {j for x in blocks for j in range(x.b, x.b + x.size)}
                    # Numbers tell versions apart: all of them must match.
                    if share >= match and all(j in met for j, word in enumerate(template) if word.isdigit()):
                        spans.append({"label": labels[t], "first_word": lo, "n_words": hi - lo, "similarity": min(1.0, share)})
                spans = _best(spans)
                spans.sort(key=lambda s: (s["first_word"], s["label"], s["n_words"]))
                every = sorted(base | {s["label"] for s in spans})
                score = max([0.5 * bool(base), *(s["similarity"] for s in spans)])
                out.append((number, len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(every), score, spans))
            kind = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("similarity", pa.float64())]))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *(pa.array(x, t) for x, t in zip(zip(*out), kind))], [*names, *added])

    return mapped(met, verify, schema)
