"""Fingerprint lookups as joins against pattern tables.

A pattern table is broadcast only after a count has shown that it is small;
a larger one is joined by shuffle.  Containment is met by equality of an anchor
(a rare option, the first characters) and then verified, so no row is compared
with every pattern.  Every join returns at most one match per input row and
key, the first by priority.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .patterns import matches

#: Patterns up to which a table is broadcast.
BROADCAST_ROWS = 100_000


def bounded(patterns: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """With a broadcast hint if the table has at most so many rows."""
    return F.broadcast(patterns) if patterns.limit(rows + 1).count() <= rows else patterns


def _first(met: DataFrame, keys: list[str], order: Column, values: list[str]) -> DataFrame:
    return met.groupBy(*keys).agg(F.min_by(F.struct(*values), order).alias("_v")).select(*keys, "_v.*")


def longest_prefix_join(df: DataFrame, column: str, prefixes: DataFrame, lengths: list[int]) -> DataFrame:
    """Left join on the longest of several prefixes (``prefixes``: prefix, values)."""
    small = bounded(prefixes)
    out = df
    values = [c for c in prefixes.columns if c != "prefix"]
    for n in sorted(lengths, reverse=True):
        part = small.where(F.length("prefix") == n).select(F.col("prefix").alias(f"_p{n}"), *[F.col(c).alias(f"_{c}{n}") for c in values])
        out = out.join(part, F.upper(F.substring(column, 1, n)) == F.col(f"_p{n}"), "left")
    longest = sorted(lengths, reverse=True)
    picked = [F.coalesce(*[F.when(F.col(f"_p{n}").isNotNull(), F.col(f"_{c}{n}")) for n in longest]).alias(c) for c in values]
    return out.select(*df.columns, *picked)


def suffix_join(df: DataFrame, column: str, suffixes: DataFrame, keys: list[str]) -> DataFrame:
    """First rule by priority whose suffix ends ``column`` at a label.

    ``suffixes``: priority, suffix, values.  Label suffixes are exploded and
    met by equality, so no row is compared with every rule.
    """
    labels = F.split(F.lower(F.col(column)), r"\.")
    tails = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    values = [c for c in suffixes.columns if c not in ("priority", "suffix")]
    met = df.withColumn("suffix", F.explode(tails)).join(bounded(suffixes), "suffix")
    best = met.groupBy(*keys).agg(F.min_by(F.struct(*values), F.col("priority")).alias("_v"))
    return df.join(best, keys).select(*df.columns, *[F.col("_v")[v].alias(v) for v in values])


def first_regex_join(df: DataFrame, column: str, rules: DataFrame, keys: list[str]) -> DataFrame:
    """First rule by priority whose ``pattern`` matches; adds ``version`` from
    its first group if it has one (``rules``: priority, pattern, values).

    Matching is done once per distinct text, and only where a literal that the
    pattern requires is found (``patterns``).
    """
    values = [c for c in rules.columns if c not in ("priority", "pattern")]
    texts = df.select(column).where(F.col(column).isNotNull()).distinct()
    met = matches(texts, column, rules, bounded)
    grouped = F.expr("pattern rlike '(?<!\\\\\\\\)\\\\((?!\\\\?)'")
    version = F.when(grouped, F.expr(f"regexp_extract(`{column}`, pattern, 1)")).otherwise(F.lit(""))
    best = _first(met.withColumn("version", version), [column], F.col("priority"), [*values, "version"])
    return df.join(best, column, "left").select(*df.columns, *values, "version")


def fingerprint_join(df: DataFrame, column: str, rules: DataFrame) -> DataFrame:
    """First fingerprint by priority that matches: adds description and ``stated``,
    a map of its parameters (``rules``: priority, pattern, description, params).

    A parameter at position 0 has its own value, one at another position the
    text of that group; what is empty is left out.
    """
    texts = df.select(column).where(F.col(column).isNotNull()).distinct()
    met = matches(texts, column, rules, bounded)
    best = _first(met, [column], F.col("priority"), ["pattern", "description", "params"])
    value = f"if(p._pos = 0, p._value, regexp_extract(`{column}`, pattern, p._pos))"
    stated = F.expr(f"map_from_entries(filter(transform(coalesce(params, array()), p -> struct(p._name AS key, {value} AS value)), e -> e.key IS NOT NULL AND e.value <> ''))")
    return df.join(best.select(column, "description", stated.alias("stated")), column, "left")


def _by_rarest_option(patterns: DataFrame) -> DataFrame:
    """Adds ``_option``: of a pattern's options the one that the fewest patterns have."""
    parts = patterns.select("options").distinct().withColumn("_option", F.explode(F.array_distinct(F.split("options", ","))))
    often = parts.groupBy("_option").agg(F.count("*").alias("_n"))
    rare = parts.join(often, "_option").groupBy("options").agg(F.min_by("_option", F.struct("_n", "_option")).alias("_option"))
    return patterns.join(rare, "options")


def subset_join(df: DataFrame, column: str, patterns: DataFrame, least: int = 6, keys: list[str] | None = None) -> DataFrame:
    """Exact option list, else the largest pattern inside it with ``least`` options.

    ``patterns``: priority, options (comma list), confidence, values.  A
    partial match loses 15 plus 10 per surplus option, down to 20.
    """
    values = [c for c in patterns.columns if c not in ("priority", "options", "confidence")]
    texts = df.select(column).where(F.col(column).isNotNull()).distinct()
    p = bounded(_by_rarest_option(patterns))
    exact = _first(texts.join(p, F.col(column) == F.col("options")).withColumn("match", F.lit("exact")), [column], F.col("priority"), [*values, "confidence", "match"])
    rest = texts.join(exact.select(column), column, "left_anti")
    mine, theirs = F.split(F.col(column), ","), F.split("options", ",")
    met = rest.withColumn("_option", F.explode(F.array_distinct(mine))).join(p, "_option")
    part = met.where((F.size(theirs) >= least) & (F.size(F.array_except(theirs, mine)) == 0) & (F.size(theirs) < F.size(mine)))
    surplus = F.size(mine) - F.size(theirs)
    part = part.withColumn("confidence", F.greatest(F.lit(20), F.col("confidence") - 15 - 10 * surplus)).withColumn("match", F.lit("subset"))
    part = _first(part, [column], F.struct(-F.size(theirs), "priority"), [*values, "confidence", "match"])
    return df.join(exact.unionByName(part), column, "left").select(*df.columns, *values, "confidence", "match")


def _containing(texts: DataFrame, column: str, rules: DataFrame) -> DataFrame:
    """Pairs of a text and a rule whose ``text`` it contains, in any case.

    Rules are met by their first three characters (all, if shorter).
    """
    low = F.lower(F.col(column))
    starts = F.sequence(F.lit(1), F.greatest(F.length(low), F.lit(1)))
    grams = F.transform(starts, lambda i: F.array(*[low.substr(i, F.lit(n)) for n in (0, 1, 2, 3)]))
    keyed = texts.withColumn("_anchor", F.explode(F.array_distinct(F.flatten(grams))))
    r = bounded(rules.withColumn("_anchor", F.lower("text").substr(1, 3)))
    return keyed.join(r, "_anchor").where(low.contains(F.lower("text"))).drop("_anchor")


def longest_substring_join(df: DataFrame, column: str, rules: DataFrame) -> DataFrame:
    """The longest rule text contained in ``column`` (``rules``: text, values)."""
    values = [c for c in rules.columns if c != "text"]
    texts = df.select(column).where(F.col(column).isNotNull()).distinct()
    best = _first(_containing(texts, column, rules), [column], F.struct(-F.length("text"), "text"), values)
    return df.join(best, column, "left").select(*df.columns, *values)


def exact_then_partial_join(df: DataFrame, column: str, rules: DataFrame) -> DataFrame:
    """Equal text (any case) first, else the heaviest contained one (``rules``: text, weight, values)."""
    values = [c for c in rules.columns if c not in ("text", "weight")]
    texts = df.select(column).where(F.col(column).isNotNull()).distinct()
    r = bounded(rules)
    order = F.struct(-F.col("weight"), F.col("text"))
    exact = _first(texts.join(r, F.lower(F.col(column)) == F.lower("text")), [column], order, values)
    rest = texts.join(exact.select(column), column, "left_anti")
    part = _first(_containing(rest, column, rules), [column], order, values)
    return df.join(exact.unionByName(part), column, "left").select(*df.columns, *values)
