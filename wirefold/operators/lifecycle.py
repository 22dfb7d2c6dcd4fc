"""Versioned merges: the new state of a table as a DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upserted(current: DataFrame, changes: DataFrame, key: str, order: str) -> DataFrame:
    """Last change per key wins; a change whose ``deleted`` is true removes the row."""
    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    last = changes.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", order)
    kept = current.join(last.select(key), key, "left_anti")
    return kept.unionByName(last.where("NOT deleted").drop("deleted"))


def ring(df: DataFrame, keys: list[str], time: str, tie: str, size: int) -> DataFrame:
    """The newest ``size`` rows of each subscriber: the oldest are dropped."""
    w = Window.partitionBy(*keys).orderBy(F.col(time).desc(), F.col(tie).desc())
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= size).drop("_n")


def stale(beats: DataFrame, key: str, time: str, now, limit: int) -> DataFrame:
    """Keys whose last sign of life is older than ``limit``."""
    return beats.groupBy(key).agg(F.max(time).alias("last")).where(now - F.col("last") > limit)


# Seconds to wait after so many failures in a row, and the share of them that is jitter.
LADDER, JITTER = [60, 120, 240, 480, 960, 1920, 3600], 5


def backoff(runs: DataFrame, key: str, order: list[str], interval: Column) -> DataFrame:
    """``runs`` (with ``failed``) and after each its level, the failures in a row up to
    the ladder's length, and the seconds to the next run.

    Without failures ``interval`` counts.  A fifth to either side is jitter, drawn by a
    digest of the key and the last of the order columns, so that reruns agree.
    """
    w = Window.partitionBy(key).orderBy(*order)
    out = runs.withColumn("_run", F.sum((~F.col("failed")).cast("long")).over(w))
    place = F.row_number().over(Window.partitionBy(key, "_run").orderBy(*order)) - (F.col("_run") > 0).cast("int")
    out = out.withColumn("level", F.when(F.col("failed"), F.least(place, F.lit(len(LADDER)))).otherwise(0))
    base = F.when(F.col("level") > 0, F.get(F.array(*map(F.lit, LADDER)), F.col("level") - 1)).otherwise(interval)
    chance = F.conv(F.substring(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.col(order[-1]).cast("string"))), 1, 8), 16, 10).cast("long")
    side = F.floor(base / JITTER)
    return out.withColumn("seconds", F.greatest(F.lit(1), base + chance % (2 * side + 1) - side).cast("long")).drop("_run")
