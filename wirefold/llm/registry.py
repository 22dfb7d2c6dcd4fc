"""The contract queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import word_queries

END_ID = 2


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op4_mixing(spark, sf_dir):
    from .mixing import mix_sources

    mixed = mix_sources(table(spark, sf_dir, "documents"))
    # What the shards of the splitting tree draw of a document.
    taken = F.col("size") * F.size("shards")
    return mixed.select("doc_id", "size", "source_size", "target", taken.alias("taken"), F.array_join(F.col("shards").cast("array<string>"), ",").alias("shards"))


def op5_token_binary(spark, sf_dir):
    import public_tokenizers

    from .token_binary import token_binary

    return token_binary(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), END_ID)


def _remainder(divisor: int):
    """crc32 of the doc_id's decimal text modulo ``divisor``."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % divisor


def op2_language_id(spark, sf_dir):
    from .language_id import predict, train

    docs = table(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(_remainder(4) == 2, F.lit(False)))
    model = train(docs.where("NOT held_out"))
    out = predict(docs.select("doc_id", "text", "held_out"), model)
    return out.select("doc_id", "held_out", "lang_pred", "score", "entropy", "rejected")


def op7_toxicity(spark, sf_dir):
    from .toxicity import predict, train

    docs = table(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(_remainder(3) == 1, F.lit(False)))
    model = train(docs.where("NOT held_out"), table(spark, sf_dir, "labels"))
    return predict(docs.select("doc_id", "text", "held_out"), model).select("doc_id", "held_out", "score", "predicted")


def op8_ngram_join(spark, sf_dir):
    from .ngram_join import near_duplicates

    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "class_id", "n_links", "kept")


def op10_repeat_index(spark, sf_dir):
    from .common import made, release, written
    from .repeat_index import remove_repeats, repeated_words

    docs, before = table(spark, sf_dir, "documents").select("doc_id", "text"), made()
    words = written(repeated_words(docs), "repeat-words")
    release(spark, before, keep=1)
    k0, k1 = F.xxhash64("text"), F.xxhash64(F.lit("second"), "text")
    out = remove_repeats(docs.withColumn("k0", k0).withColumn("k1", k1)).join(words, ["k0", "k1"], "left")
    words = F.coalesce("n_repeat_words", F.lit(0).cast("long")).alias("n_repeat_words")
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", words)


def op1_pivot_index(spark, sf_dir):
    from .pivot_index import near_vectors

    out = near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    return out.select("vec_id", "n_links", "component_id", "kept")


def op3_chat_format(spark, sf_dir):
    from .chat_format import format_transcripts, train, transcripts

    turns = table(spark, sf_dir, "conversations")
    out = format_transcripts(transcripts(turns), train(turns))
    return out.select(
        "conv_id", "part", "n_turns", F.array_join("roles", ",").alias("roles"), F.array_join("truth", ",").alias("truth"),
        F.sha2("chat", 256).alias("chat_sha256"),
    )


def op6_license_scan(spark, sf_dir):
    from .license_scan import scan_licenses

    out = scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op9_decontaminate(spark, sf_dir):
    from .decontaminate import decontaminate

    out = decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "coverage", "item_id", "n_tiles", "items", "contaminated")


def queries() -> dict:
    found = [
        op1_pivot_index, op2_language_id, op3_chat_format, op4_mixing, op5_token_binary, op6_license_scan, op7_toxicity,
        op8_ngram_join, op9_decontaminate, op10_repeat_index,
    ]
    return {f.__name__: f for f in found} | word_queries.queries()


def oracle_sql() -> dict:
    return {"op1_pivot_index": VECTORS_SQL, "op4_mixing": MIXING_SQL} | word_queries.oracle_sql()


#: All pairs of a label by brute force, components by reachability.
VECTORS_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
r AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y)
SELECT r.x AS vec_id, (SELECT count(*) FROM l WHERE l.x = r.x) AS n_links, min(r.y) AS component_id, min(r.y) = r.x AS kept
FROM r GROUP BY r.x
"""


_TREE_LEVEL = """
h{n} AS (
  SELECT * EXCLUDE (node), node * 2 + CASE WHEN row_number() OVER (PARTITION BY node ORDER BY
      ('0x' || substr(md5('tree7.{n}:' || coalesce(source, chr(0)) || ':' || unit || ':' || pass), 1, 15))::BIGINT, source NULLS FIRST, unit, pass)
    > (count(*) OVER (PARTITION BY node) + node % 2) // 2 THEN 1 ELSE 0 END AS node
  FROM {source}),"""

_NEARER_ROUND = """
f{n} AS (
  SELECT e.source, min({{'miss': abs(e.gap - d.size * e.sign), 'k': d.k, 'size': d.size, 'sign': e.sign}}) AS x
  FROM (SELECT *, CASE WHEN gap > 0 THEN 1 WHEN gap < 0 THEN -1 END AS sign FROM {source}) e
  JOIN c d ON d.source IS NOT DISTINCT FROM e.source AND (d.base > d.whole) = (e.sign < 0)
  WHERE abs(e.gap - d.size * e.sign) < abs(e.gap) AND NOT list_contains(e.flips, {{'k': d.k, 'size': d.size, 'sign': e.sign}})
  GROUP BY e.source),
g{n} AS (
  SELECT e.source, CASE WHEN f.x IS NULL THEN e.gap ELSE e.gap - f.x.size * f.x.sign END AS gap,
         CASE WHEN f.x IS NULL THEN e.flips ELSE list_append(e.flips, {{'k': f.x.k, 'size': f.x.size, 'sign': f.x.sign}}) END AS flips
  FROM {source} e LEFT JOIN f{n} f ON f.source IS NOT DISTINCT FROM e.source),"""

#: Blocks, targets, the splitting tree, the edge block's documents and the single
#: documents that come nearer, by the same md5 numbers.
MIXING_SQL = (
    r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('doc7:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS k
  FROM documents),
b AS (
  SELECT source, k % 256 AS block, sum(size)::BIGINT AS block_size FROM d GROUP BY ALL),
s AS (
  SELECT source, sum(block_size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS r FROM b GROUP BY source),
w AS (
  SELECT *, (r - 1) % 3 + 1 AS weight, source_size * 3 AS cap FROM s),
v AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER o, 0))::DOUBLE
            / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0))::DOUBLE AS level,
         row_number() OVER (ORDER BY cap::DOUBLE / weight, r) AS place
  FROM w WINDOW o AS (ORDER BY cap::DOUBLE / weight, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (
  SELECT source, source_size,
         least(cap::DOUBLE, (SELECT arg_min(level, place) FROM v WHERE level * weight <= cap) * weight) AS target FROM v),
u AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t),
p AS (
  SELECT b.source, b.block, b.block_size, u.source_size, u.target, u.whole, row_number() OVER o AS unit,
         u.target - u.whole * u.source_size - (sum(b.block_size) OVER o - b.block_size) AS quota
  FROM b JOIN u ON b.source IS NOT DISTINCT FROM u.source
  WINDOW o AS (PARTITION BY b.source ORDER BY ('0x' || substr(md5('perm7:' || coalesce(b.source, chr(0)) || ':' || b.block), 1, 15))::BIGINT, b.block)),
q AS (
  SELECT *, quota > 0 AND quota < block_size AS edge, (whole + CASE WHEN quota >= block_size THEN 1 ELSE 0 END)::BIGINT AS passes FROM p),
h AS (
  SELECT source, unit, block, unnest(range(1, passes + CASE WHEN edge THEN 2 ELSE 1 END)) AS pass, 0 AS node FROM q),"""
    + "".join(_TREE_LEVEL.format(n=n, source=f"h{n - 1}" if n else "h") for n in range(4))
    + r"""
a AS (
  SELECT x.source, x.block, list(y.node ORDER BY x.pass) AS shards
  FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY pass, unit) AS i FROM h3) x
  JOIN (SELECT *, row_number() OVER (PARTITION BY source ORDER BY node, pass, unit) AS i FROM h3) y
    ON x.source IS NOT DISTINCT FROM y.source AND x.i = y.i
  GROUP BY ALL),
m AS (
  SELECT d.*, q.* EXCLUDE (source, block), q.block,
         sum(d.size) OVER (PARTITION BY d.source, d.k % 256 ORDER BY d.k, d.size ROWS UNBOUNDED PRECEDING) - d.size / 2.0 AS near
  FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source AND d.k % 256 = q.block),
z AS (
  SELECT *, max(CASE WHEN edge AND near <= quota THEN k END) OVER (PARTITION BY source, block) AS cut FROM m),
c AS (
  SELECT *, passes + CASE WHEN edge AND k <= cut THEN 1 ELSE 0 END AS base FROM z),
g AS (
  SELECT source, any_value(quota) - sum(CASE WHEN k <= cut THEN size ELSE 0 END) AS gap, []::STRUCT(k BIGINT, size BIGINT, sign INTEGER)[] AS flips
  FROM c WHERE edge GROUP BY source),"""
    + "".join(_NEARER_ROUND.format(n=n, source=f"g{n - 1}" if n else "g") for n in range(2))
    + r"""
e AS (
  SELECT q.source, any_value(a.shards[-1]) AS shard FROM q JOIN a ON a.source IS NOT DISTINCT FROM q.source AND a.block = q.block WHERE q.edge GROUP BY q.source),
r AS (
  SELECT c.*, a.shards, e.shard, coalesce(list_filter(g1.flips, lambda x: x.k = c.k AND x.size = c.size)[1].sign, 0) AS sign
  FROM c LEFT JOIN a ON a.source IS NOT DISTINCT FROM c.source AND a.block = c.block
  LEFT JOIN e ON e.source IS NOT DISTINCT FROM c.source LEFT JOIN g1 ON g1.source IS NOT DISTINCT FROM c.source)
SELECT doc_id, size, source_size, target, (size * (base + sign))::BIGINT AS taken,
       array_to_string(list_concat(coalesce(shards, [])[1:base + least(sign, 0)], CASE WHEN sign > 0 THEN [shard] ELSE [] END), ',') AS shards
FROM r
"""
)
