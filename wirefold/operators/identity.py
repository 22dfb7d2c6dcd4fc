"""Identities of addresses: similarity of signals, and gapless numbers."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written

# What an equal signal counts, and the least sum that identifies.
SIGNALS = {"hostname": 0.35, "opt60": 0.25, "opt55": 0.15, "query_name": 0.15, "service": 0.1}
LEAST = 0.40


def _sets(weights: dict[str, float], least: float) -> list[tuple[float, tuple[str, ...]]]:
    """All sets of signals that weigh enough, with their weight."""
    some = [c for n in range(1, len(weights) + 1) for c in combinations(weights, n)]
    return [(w, c) for c in some if (w := round(sum(weights[k] for k in c), 6)) >= least]


def _keys(weights: dict[str, float], least: float) -> Column:
    """For each heavy enough set whose signals are all stated: number, weight and values."""
    one = lambda i, w, names: F.when(
        F.forall(F.array(*names), lambda x: x.isNotNull()), F.struct(F.lit(i).alias("number"), F.lit(w).alias("weight"), F.to_json(F.array(*names)).alias("values"))
    )
    return F.explode(F.filter(F.array(*[one(i, w, names) for i, (w, names) in enumerate(_sets(weights, least))]), lambda x: x.isNotNull()))


def most_similar(rows: DataFrame, others: DataFrame, key: str = "hw_addr", weights: dict[str, float] = SIGNALS, least: float = LEAST) -> DataFrame:
    """The other address with the greatest weight of equal signals, if it is ``least`` or more.

    Returns ``key``, identity (ties: the greatest) and score.  The best other
    address agrees in some set of signals that weighs the score.  So each set
    (there are as many as the few signals allow) keeps one address for each
    combination of values, and each row asks all its combinations: the work is
    linear in the rows, however many share a hostname.  Null signals are
    equal to nothing.
    """
    stored = others.select(key, _keys(weights, least).alias("_k")).groupBy("_k.number", "_k.values").agg(F.max(key).alias("_other"))
    # Rows with the same signals ask once.
    names = list(weights)
    asked = rows.select(*names).distinct().select(*names, _keys(weights, least).alias("_k")).select(*names, "_k.number", "_k.values", "_k.weight")
    best = asked.join(stored, ["number", "values"]).groupBy(*names).agg(F.max(F.struct(F.col("weight"), F.col("_other"))).alias("_best"))
    same = [rows[n].eqNullSafe(best[n]) for n in names]
    return rows.join(best, same).select(rows[key], F.col("_best._other").alias("identity"), F.col("_best.weight").alias("score"))


def numbered(keys: DataFrame, name: str, first: int = 1) -> DataFrame:
    """Gapless numbers of the distinct values of ``name`` in their order: name, number.

    Values are dealt by range; a partition numbers its own, after the sum of
    the partitions before it.  Nulls are left out.
    """
    spark = keys.sparkSession
    values = keys.select(name).where(F.col(name).isNotNull()).distinct()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = values.repartitionByRange(parts, name).sortWithinPartitions(name)
    # The high bits of the id are the partition, the low 33 the place within it.
    ranged = written(ranged.withColumn("_id", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_id", 33).cast("int").alias("_part")
    counts = sorted(tuple(r) for r in ranged.groupBy(part).agg(F.count("*").alias("n")).collect())  # one row a partition
    bases, at = [], first
    for p, n in counts:
        bases.append((p, at))
        at += n
    known = F.broadcast(spark.createDataFrame(bases, "_part int, _base long"))
    place = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return ranged.select(name, part, place.alias("_place")).join(known, "_part").select(name, (F.col("_base") + F.col("_place")).alias("number"))


def identities(verdicts: DataFrame, signals: DataFrame, randomized: Column) -> DataFrame:
    """hw_addr, identity, score of every address: first the real ones, then the randomized.

    Real addresses share an identity by hostname, else stand alone.  A
    randomized one joins the most similar real one (score), or else gets a
    number of its own behind them.
    """
    keyed = written(verdicts.select("hw_addr", F.coalesce("hostname", "hw_addr").alias("_key"), randomized.alias("_random")), "identity-keys")
    real = keyed.where("NOT _random")
    numbers = numbered(real, "_key")
    done = written(real.join(numbers, "_key").select("hw_addr", F.col("number").alias("identity")), "identity-real")
    facing = signals.join(keyed.select("hw_addr", "_random"), "hw_addr")
    met = most_similar(facing.where("_random"), facing.where("NOT _random")).withColumnRenamed("identity", "_real")
    joined = written(met.join(done.select(F.col("hw_addr").alias("_real"), "identity"), "_real").select("hw_addr", "identity", "score"), "identity-joined")
    alone = keyed.where("_random").join(joined, "hw_addr", "left_anti")
    last = done.agg(F.coalesce(F.max("identity"), F.lit(0))).first()[0]
    new = alone.join(numbered(alone, "_key", last + 1), "_key").select("hw_addr", F.col("number").alias("identity"))
    none = F.lit(None).cast("double")
    return done.withColumn("score", none).unionByName(joined).unionByName(new.withColumn("score", none))
