"""Spelling variants: words one code point apart, grouped without pairs.

* Replacements: a word belongs to one wildcard group for each position
  (position, what stands before, what stands after).  Members of a group differ
  in that position only, so a group holds at most one word for each letter.
  Its size and its two most frequent words tell every member how many
  neighbours it has there and which is the most frequent other one.
* Insertions and deletions: each word's distinct deletions meet the vocabulary
  under the deleted form.  A key's group has at most one word, and its
  longer neighbours, of which the number and the most frequent one are kept.

The parts are added for each word.  All work grows with the vocabulary times
the word length; the list of neighbouring pairs is never built.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_broadcast, written

#: Maximal runs of Latin letters.
LETTERS = r"[A-Za-zÀ-ÿ]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def without(word: Column, at: Column) -> Column:
    """``word`` without its code point number ``at`` (from 0)."""
    return F.concat(word.substr(F.lit(1), at), word.substr(at + 2, F.length(word)))


def occurrences(docs: DataFrame) -> DataFrame:
    """Every letter run of every whole text, A-Z lower-cased: doc_id, run.

    A null or empty text has none.
    """
    runs = F.regexp_extract_all(F.col("text"), F.lit(LETTERS), F.lit(0))
    return docs.select("doc_id", F.explode(runs).alias("run")).withColumn("run", F.translate("run", _UPPER, _LOWER))


def vocabulary(words: DataFrame, min_length: int = 5, min_count: int = 3) -> DataFrame:
    """Words of at least ``min_length`` code points and ``min_count`` rows, with their number n."""
    return words.where(F.length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def _replacements(vocab: DataFrame) -> DataFrame:
    """For each word and position with neighbours: how many, and the most frequent."""
    places = F.explode(F.sequence(F.lit(0), F.length("word") - 1))
    keyed = vocab.select("word", "n", places.alias("at"))
    keyed = keyed.select("*", F.substring("word", F.lit(1), F.col("at")).alias("before"), F.col("word").substr(F.col("at") + 2, F.length("word")).alias("after"))
    group = Window.partitionBy("at", "before", "after")
    ranked = group.orderBy(F.desc("n"), "word")
    whole = ranked.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    entry = F.struct((-F.col("n")).alias("minus"), F.col("word").alias("near"))
    sized = keyed.select(
        "word", (F.count("*").over(group) - 1).alias("found"), F.row_number().over(ranked).alias("place"),
        F.first(entry).over(whole).alias("top"), F.nth_value(entry, 2).over(whole).alias("next"),
    )
    return sized.where("found > 0").select("word", "found", F.when(F.col("place") == 1, F.col("next")).otherwise(F.col("top")).alias("best"))


def _indels(vocab: DataFrame, shortest: int) -> DataFrame:
    """For each word and key with neighbours one code point longer or shorter: how many, and the most frequent."""
    forms = F.array_distinct(F.transform(F.sequence(F.lit(0), F.length("word") - 1), lambda i: without(F.col("word"), i)))
    longer = vocab.where(F.length("word") > shortest).select(F.explode(forms).alias("key"), "word", "n", F.lit(False).alias("own"))
    both = vocab.select(F.col("word").alias("key"), "word", "n", F.lit(True).alias("own")).unionByName(longer)
    group = Window.partitionBy("key")
    entry = F.struct((-F.col("n")).alias("minus"), F.col("word").alias("near"))
    met = both.select(
        "word", "own", F.min(F.when(F.col("own"), entry)).over(group).alias("short"),
        F.count(F.when(~F.col("own"), 1)).over(group).alias("many"), F.min(F.when(~F.col("own"), entry)).over(group).alias("long"),
    ).where("short IS NOT NULL AND many > 0")
    return met.select("word", F.when(F.col("own"), F.col("many")).otherwise(1).alias("found"), F.when(F.col("own"), F.col("long")).otherwise(F.col("short")).alias("best"))


def _roots(forms: DataFrame) -> DataFrame:
    """The end of each chain word -> form, by doubling the steps taken.

    A form is at least ``ratio`` > 1 times as frequent as its word, so chains
    end, after at most log_ratio(largest n) steps.
    """
    known = written(forms.select("word", F.col("form").alias("root")), "forms")
    rows = known.count()
    while True:
        ahead = bounded_broadcast(known.select(F.col("word").alias("root"), F.col("root").alias("later")), rows)
        stepped = written(known.join(ahead, "root", "left").select("word", F.coalesce("later", "root").alias("root"), F.col("later").isNotNull().alias("moved")), "forms")
        known = stepped.select("word", "root")
        if not stepped.where("moved").limit(1).count():
            return known


def spelling_variants(words: DataFrame, min_length: int = 5, min_count: int = 3, ratio: int = 2) -> DataFrame:
    """Group a corpus's words with their more frequent spellings.

    ``words`` has one row per occurrence in column ``word`` (nulls and short
    words are no words; other columns are ignored).  Returns per word of the
    vocabulary: word, n, n_near (words exactly one inserted, deleted or
    replaced code point away), form (the most frequent of these, ties smallest
    in code-point order, if at least ``ratio`` > 1 times as frequent, else null),
    form_n, and root (where following the forms ends; the word itself without
    a form).  An empty table gives no rows.
    """
    if ratio <= 1:
        raise ValueError("ratio must be above 1")
    vocab = written(vocabulary(words, min_length, min_count), "vocabulary")
    near = _replacements(vocab).unionByName(_indels(vocab, min_length))
    near = near.groupBy("word").agg(F.sum("found").alias("n_near"), F.min("best").alias("best"))
    taken = -F.col("best.minus") >= ratio * F.col("n")
    out = vocab.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(taken, F.col("best.near")).alias("form"), F.when(taken, -F.col("best.minus")).alias("form_n"),
    )
    out = written(out, "variants")
    roots = _roots(out.where("form IS NOT NULL"))
    return out.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))
