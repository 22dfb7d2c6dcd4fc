"""Verdicts from a stream of evidence, one state per hardware address.

The state of an address is what its verdict can ever depend on: the
``per_source`` surest rows of each source (a list), the number of all rows and
the newest time.  Both are the same however the rows are dealt into batches and
in whatever order they come, so after any replay a verdict equals the one of
the batch query over all rows.  An address that changes sends its list on, the
fusion of the batch query turns it into a verdict, and the verdict table is
upserted bucket by bucket.  State expires ``ttl`` after its last write.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import fusion
from ..sources.bucketed import BucketedTable
from ..sources.shared import fresh
from .stateful import plain_rows, state_store

_ROW = "id long, source string, certainty double, vendor string, category string, platform string, hostname string, model string, us long"
_NAMES = [c.split()[0] for c in _ROW.split(", ")]
#: A changed address: its kept rows, with its counters on each.
CHANGED = f"hw_addr string, {_ROW}, rows long, newest_us long"
VERDICT = "hw_addr string, category string, vendor string, platform string, hostname string, model string, certainty int, evidence long, us long, epoch long"


def kept(rows: list[tuple], per_source: int) -> list[tuple]:
    """The surest rows of each source: by certainty, then time, then id."""
    by: dict[str | None, list[tuple]] = {}
    for row in rows:
        by.setdefault(row[1], []).append(row)
    lowest = float("-inf")
    order = lambda r: tuple(lowest if r[i] is None else r[i] for i in (2, 8, 0))
    return [r for some in by.values() for r in sorted(some, key=order, reverse=True)[:per_source]]


class EvidenceState(StatefulProcessor):
    """Keeps the capped list of an address and sends it on when rows arrive."""

    def __init__(self, per_source: int, ttl: int | None) -> None:
        self.per_source, self.ttl = per_source, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.evidence = handle.getListState("evidence", _ROW, self.ttl)
        self.seen = handle.getValueState("seen", "rows long, newest_us long", self.ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = [tuple(r) for r in self.evidence.get()] if self.evidence.exists() else []
        number, newest = self.seen.get() if self.seen.exists() else (0, None)
        for part in rows:
            new = plain_rows(part[_NAMES], _ROW)
            number += len(new)
            times = [r[8] for r in new if r[8] is not None]
            newest = max(times + ([newest] if newest is not None else []), default=None)
            held = kept(held + new, self.per_source)  # after each part: the list stays short
        self.evidence.put(held)
        self.seen.update((number, newest))
        yield pd.DataFrame([(key[0], *r, number, newest) for r in held], columns=["hw_addr", *_NAMES, "rows", "newest_us"]).astype(object)

    def close(self) -> None:
        pass


def changed_evidence(evidence: DataFrame, per_source: int = 3, ttl_ms: int | None = None) -> DataFrame:
    """The kept rows of every address with new rows, a list per micro-batch.

    ``evidence`` is a stream with the columns of the evidence view.  ``ttl_ms``
    (processing time) drops the state of addresses without rows for so long.
    """
    grouped = evidence.where("hw_addr IS NOT NULL").select("hw_addr", *_NAMES).groupBy("hw_addr")
    return grouped.transformWithStateInPandas(EvidenceState(per_source, ttl_ms), CHANGED, "Update", "ProcessingTime" if ttl_ms else "None")


def verdicts_of(changed: DataFrame, total: int = 100) -> DataFrame:
    """Verdicts of the addresses of one micro-batch, by the fusion of the batch query."""
    spark = changed.sparkSession
    out = fusion.verdicts(changed, fusion.weight_table(spark), total=total).drop("evidence", "us")
    counted = changed.groupBy("hw_addr").agg(F.max("rows").alias("evidence"), F.max("newest_us").alias("us"))
    return out.join(counted, "hw_addr")


def verdict_table(spark, path: str, buckets: int = 16, keep_hostname: bool = False) -> BucketedTable:
    """The stored verdicts: the newest epoch's row replaces the one before.

    With ``keep_hostname`` a verdict without a hostname keeps the last known one.
    """

    def merge(rows: DataFrame) -> DataFrame:
        names = rows.columns
        known = F.when(F.col("hostname").isNotNull(), F.col("epoch"))
        out = rows.groupBy("hw_addr").agg(F.max_by(F.struct(*names), "epoch").alias("_r"), F.max_by("hostname", known).alias("_host")).select("_r.*", "_host")
        return out.withColumn("hostname", F.col("_host")).drop("_host") if keep_hostname else out.drop("_host")

    return BucketedTable(spark, path, "hw_addr", VERDICT, merge, buckets)


def stream_verdicts(evidence: DataFrame, table: BucketedTable, checkpoint: str, per_source: int = 3, total: int = 100, ttl_ms: int | None = None, trigger: dict | None = None):
    """Start the query that keeps ``table`` up to date; ``availableNow`` by default.

    The session needs the state store of ``state_conf``.  With ``ttl_ms`` the
    clock alone can change state, so the query runs until it is stopped.
    """

    def upsert(batch: DataFrame, epoch: int) -> None:
        batch = batch.persist()
        try:
            table.upsert(verdicts_of(batch, total).withColumn("epoch", F.lit(epoch).cast("long")), epoch)
        finally:
            batch.unpersist()

    writer = changed_evidence(evidence, per_source, ttl_ms).writeStream.foreachBatch(upsert).outputMode("update")
    return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def replayed_verdicts(evidence: DataFrame, batches: int = 3, files: int = 8) -> DataFrame:
    """Verdicts of a table's rows sent through the stream in ``batches`` micro-batches of ``files`` files.

    The files cut across addresses and times, so most addresses change in each batch.
    """
    spark = evidence.sparkSession
    folder = fresh(spark, "evidence-stream")
    evidence.repartition(batches * files, F.xxhash64("id")).write.parquet(folder)
    with state_store(spark):
        table = verdict_table(spark, fresh(spark, "verdicts"))
        stream = spark.readStream.schema(evidence.schema).option("maxFilesPerTrigger", files).parquet(folder)
        stream_verdicts(stream, table, f"{folder}-checkpoint").awaitTermination()
    return table.read()
