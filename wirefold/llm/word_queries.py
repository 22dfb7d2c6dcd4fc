"""Contract queries of the operators on words and windows, and their SQL."""

from __future__ import annotations

import zlib

from pyspark.sql import functions as F

#: End id of a packed document.
PACK_END = 1


def _documents(spark, sf_dir: str):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def repeated_tail(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The contract's rewriting: in one document of ten, words from a on repeat with period p."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n = len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    block = words[a : a + p]
    return words[:a] + (block * -(-(n - a) // p))[: n - a]


def op11_periodic_runs(spark, sf_dir):
    from .periodic_runs import periodic_runs

    return periodic_runs(_documents(spark, sf_dir), min_length=6, min_exponent=4, rewrite=repeated_tail)


def op12_spelling_variants(spark, sf_dir):
    from .spelling import occurrences, spelling_variants, without

    runs = occurrences(_documents(spark, sf_dir))
    key = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run"))
    code = F.crc32(key.cast("binary"))
    # The contract's misspellings: one code point less in one occurrence of 97.
    word = F.when(code % 97 == 0, without(F.col("run"), (code % F.length("run")).cast("int"))).otherwise(F.col("run"))
    return spelling_variants(runs.where(F.length("run") >= 5).select(word.alias("word"))).select("word", "form", "root", "n", "n_near", "form_n")


def op13_order_packing(spark, sf_dir):
    import public_tokenizers

    from .packing import pack

    return pack(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), PACK_END, width=2048)


def queries() -> dict:
    return {f.__name__: f for f in (op11_periodic_runs, op12_spelling_variants, op13_order_packing)}


def oracle_sql() -> dict:
    return {"op11_periodic_runs": RUNS_SQL, "op12_spelling_variants": SPELLING_SQL}


#: crc32 of a string, byte by byte with a table of 256 numbers.
_CRC_TABLE = """
crc_table AS (
  SELECT list(list_reduce([i::BIGINT] || range(8), lambda c, x: xor(c >> 1, CASE WHEN (c & 1) = 1 THEN 3988292384 ELSE 0 END)) ORDER BY i) AS t
  FROM range(256) r(i)),"""

_CRC = """xor(4294967295, list_reduce([4294967295] || list_transform(range(octet_length({0})),
    lambda i: ('0x' || substr(hex({0}), (2 * i + 1)::INT, 2))::BIGINT), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])))"""

#: Runs from pairs of equal word 5-grams, grouped by distance into maximal stretches.
RUNS_SQL = (
    r"""
WITH"""
    + _CRC_TABLE
    + r"""
d AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         """
    + _CRC.format("encode(doc_id::VARCHAR)")
    + r""" AS h
  FROM documents, crc_table),
e AS (
  SELECT row, doc_id, w, len(w) AS n, coalesce(h, 1) AS h, coalesce(h, 1) // 10 AS g FROM d),
f AS (
  SELECT *, CASE WHEN n > 0 THEN g % n END AS a, CASE WHEN n > 0 THEN 1 + (n - g % n) // (3 + g % 8) END AS p FROM e),
t AS (
  SELECT row, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: w[CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1]) ELSE w END AS w
  FROM f),
k AS (
  SELECT row, n, unnest(range(n - 4)) AS i, unnest(list_transform(range(n - 4), lambda i: array_to_string(w[i + 1:i + 5], ' '))) AS gram FROM t WHERE n >= 6),
m AS (
  SELECT row, i, gram, count(*) OVER (PARTITION BY row, gram) AS c FROM k),
j AS (
  SELECT x.row, x.i, y.i - x.i AS q FROM m x JOIN m y ON x.row = y.row AND x.gram = y.gram AND y.i > x.i WHERE x.c > 1 AND y.c > 1),
s AS (
  SELECT row, q, min(i) AS start, max(i) - min(i) + 5 + q AS length
  FROM (SELECT *, i - row_number() OVER (PARTITION BY row, q ORDER BY i) AS island FROM j) GROUP BY row, q, island),
r AS (
  SELECT row, start, length, min(q) AS period FROM s WHERE length >= greatest(6, 4 * q) GROUP BY ALL),
b AS (
  SELECT row, count(*) AS n_runs, arg_max({'start': start, 'length': length, 'period': period}, (length, -start, -period)) AS best,
         string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed
  FROM r GROUP BY row),
z AS (
  SELECT row, list(DISTINCT i) AS gone FROM (SELECT row, unnest(range(start + period, start + length)) AS i FROM r) GROUP BY row)
SELECT t.doc_id, coalesce(n_runs, 0) AS n_runs, best.start AS start, best.length AS length, best.period AS period,
       1000 * best.length // best.period AS exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256,
       sha256(CASE WHEN gone IS NULL THEN array_to_string(w, ' ')
              ELSE array_to_string(list_transform(list_filter(range(n), lambda i: NOT list_contains(gone, i)), lambda i: w[i + 1]), ' ') END) AS collapsed_sha256
FROM t LEFT JOIN b ON b.row = t.row LEFT JOIN z ON z.row = t.row
"""
)

#: Neighbours by join on wildcards and on deletions, roots by recursion.
SPELLING_SQL = (
    r"""
WITH RECURSIVE"""
    + _CRC_TABLE
    + r"""
o AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents) GROUP BY ALL),
c AS (
  SELECT run, n, """
    + _CRC.format("encode(coalesce(doc_id::VARCHAR, '') || ':' || run)")
    + r""" AS h FROM o, crc_table WHERE length(run) >= 5),
v AS (
  SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, sum(n)::BIGINT AS n
  FROM c GROUP BY 1 HAVING length(word) >= 5 AND sum(n) >= 3),
x AS (
  SELECT word, n, substr(word, 1, i::INT) AS before, substr(word, i::INT + 2) AS after FROM v, unnest(range(length(word))) u(i)),
p AS (
  SELECT a.word, b.word AS near, b.n AS m FROM x a JOIN x b ON a.before = b.before AND a.after = b.after AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM x a JOIN v b ON a.before || a.after = b.word
  UNION SELECT b.word, a.word, a.n FROM x a JOIN v b ON a.before || a.after = b.word),
q AS (
  SELECT word, count(*) AS n_near, arg_min({'near': near, 'm': m}, (-m, near)) AS best FROM p GROUP BY word),
f AS (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN best.m >= 2 * v.n THEN best.near END AS form, CASE WHEN best.m >= 2 * v.n THEN best.m END AS form_n
  FROM v LEFT JOIN q ON q.word = v.word),
w AS (
  SELECT word, word AS last FROM f UNION ALL SELECT w.word, f.form FROM w JOIN f ON f.word = w.last WHERE f.form IS NOT NULL)
SELECT f.word, f.form, r.last AS root, f.n, f.n_near, f.form_n
FROM f JOIN (SELECT w.word, w.last FROM w JOIN f ON f.word = w.last WHERE f.form IS NULL) r ON r.word = f.word
"""
)
