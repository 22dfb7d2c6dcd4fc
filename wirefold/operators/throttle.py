"""Order-dependent folds over event times.

``throttled`` keeps an event only if its key fired longer than ``interval``
ago; the timer restarts when an event fires, not when one is swallowed.  It is
not a window function: the fold runs over each key's sorted times, a batch at a
time, so no key's events are held at once.

Sliding windows are differences of running counts: a row in the place of each
window's start takes over the count of the next event.  The work grows with
the events, not with the events a window holds.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _firing(keys: list[str], time: str, interval: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of rows sorted by keys and time, those that fire."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, last = None, None
        for part in batches:
            if not part.num_rows:
                continue
            columns = [part.column(k) for k in keys]
            codes = [c.dictionary_encode(null_encoding="encode").indices.to_numpy() for c in columns]
            changes = np.flatnonzero(np.any([np.diff(c) != 0 for c in codes], axis=0)) + 1
            times, fired = part.column(time).to_pylist(), []
            for start, end in zip([0, *changes.tolist()], [*changes.tolist(), part.num_rows]):
                own = tuple(c[start].as_py() for c in columns)
                if own != key:
                    key, last = own, None
                at = start if last is None else bisect_left(times, last + interval, start, end)
                while at < end:
                    fired.append(at)
                    last = times[at]
                    at = bisect_left(times, last + interval, at + 1, end)
            yield part.take(pa.array(fired, pa.int64()))

    return run


def fired(df: DataFrame, keys: list[str], time: str, interval: int, ties: list[str] | None = None) -> DataFrame:
    """Rows that fire, whole; of rows of one moment the first by ``ties``."""
    rows = df.where(F.col(time).isNotNull()).repartition(*keys).sortWithinPartitions(*keys, time, *(ties or []))
    return rows.mapInArrow(_firing(keys, time, interval), rows.schema)


def throttled(df: DataFrame, keys: list[str], time: str, interval: int) -> DataFrame:
    """Keys and times that fire."""
    return fired(df.select(*keys, time), keys, time, interval)


def _from_start(rows: DataFrame, keys: list[str], time: str, ties: list[str], width: int, value: Column, name: str) -> DataFrame:
    """Adds ``value`` of the first event of the key in (t - width, t]."""
    places = F.array(F.struct(F.col(time).alias("_at"), F.lit(False).alias("_start")), F.struct((F.col(time) - width + 1).alias("_at"), F.lit(True).alias("_start")))
    # Backwards in time; a start comes behind the events of its own moment and takes the last one's value.
    w = Window.partitionBy(*keys).orderBy(F.col("_at").desc_nulls_last(), "_start", *[F.col(c).desc_nulls_last() for c in ties]).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.select("*", F.inline(places)).withColumn(name, F.last(F.when(~F.col("_start"), value), ignorenulls=True).over(w))
    return out.where("_start").drop("_at", "_start")


def sliding_count(df: DataFrame, keys: list[str], time: str, width: int, name: str = "n") -> DataFrame:
    """Events of the key in (t - width, t]."""
    w = Window.partitionBy(*keys).orderBy(time)
    rows = df.withColumn("_all", F.count("*").over(w)).withColumn("_before", F.rank().over(w) - 1)
    return _from_start(rows, keys, time, [], width, F.col("_before"), "_out").withColumn(name, F.col("_all") - F.col("_out")).drop("_all", "_before", "_out")


def sliding_changes(df: DataFrame, keys: list[str], time: str, tie: str, value: str, width: int, name: str = "changes") -> DataFrame:
    """Changes of ``value`` between neighbours that both lie in (t - width, t].

    The first row's own change looks back out of the window and is left out.
    """
    order = Window.partitionBy(*keys).orderBy(time, tie)
    flag = F.coalesce((F.lag(value).over(order) != F.col(value)).cast("int"), F.lit(0))
    rows = df.withColumn("_flag", flag).withColumn("_all", F.sum("_flag").over(Window.partitionBy(*keys).orderBy(time)))
    rows = rows.withColumn("_to", F.sum("_flag").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return _from_start(rows, keys, time, [tie], width, F.col("_to"), "_out").withColumn(name, F.col("_all") - F.col("_out")).drop("_flag", "_all", "_to", "_out")
