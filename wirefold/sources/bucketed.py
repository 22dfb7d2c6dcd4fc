"""Keyed tables that a stream upserts: hash buckets, rewritten one by one.

A table is a folder:

``data/<epoch>-<attempt>/bucket=<n>/``  Parquet files of the buckets that an epoch touched;
``commits/<epoch>``                      JSON: the folder of every bucket as of that epoch.

An epoch reads, merges and rewrites only the buckets its keys fall into; the
files of the others stay as they are.  A commit record is renamed into place
once all files are there, so readers see an epoch whole or not at all, and an
epoch that has a record is not applied again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .shared import Folder


class BucketedTable:
    """A table of at most one row per ``key``; ``schema`` is a DDL string or StructType.

    ``merge`` folds rows of old and new into one row per key; it must not
    depend on how the rows are dealt into epochs.  ``buckets`` is fixed at
    creation: choose it so that a bucket is a file or two.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, schema: StructType | str, merge: Callable[[DataFrame], DataFrame], buckets: int = 16) -> None:
        self.spark, self.path, self.key, self.merge, self.buckets = spark, path.rstrip("/"), key, merge, buckets
        self.schema = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
        self.folder = Folder(spark, self.path)

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def epochs(self) -> list[int]:
        """The committed epochs, ascending."""
        return sorted(int(n) for n in self.folder.names("commits") if n.isdigit())

    def state(self) -> dict[int, str]:
        """The folder of each bucket that has rows."""
        done = self.epochs()
        if not done:
            return {}
        record = json.loads(self.folder.text(f"commits/{done[-1]}"))
        if record["buckets"] != self.buckets:
            raise ValueError(f"the table has {record['buckets']} buckets, not {self.buckets}")
        return {int(k): v for k, v in record["state"].items()}

    def _of(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{f}" for f in sorted(folders)])

    def read(self) -> DataFrame:
        """The table as of its last committed epoch."""
        return self._of(list(self.state().values()))

    def lookup(self, value) -> DataFrame:
        """The row of one key; only its bucket is read."""
        number = self.spark.range(1).select(F.lit(value).alias(self.key)).select(self.bucket()).first()[0]
        folder = self.state().get(number)
        return self._of([folder] if folder else []).where(F.col(self.key) == value)

    def upsert(self, rows: DataFrame, epoch: int) -> bool:
        """Merge ``rows`` in; False if ``epoch`` has been applied before.

        Rows with a null key are ignored.  Usable as a ``foreachBatch`` function.
        """
        done = self.epochs()
        if done and epoch <= done[-1]:
            return False
        columns = [f.name for f in self.schema]
        new = rows.where(F.col(self.key).isNotNull()).select(*columns)
        new = self.merge(new).select(*columns).persist()
        try:
            state = self.state()
            touched = sorted(r[0] for r in new.select(self.bucket()).distinct().collect())  # at most ``buckets`` numbers
            made = f"data/{epoch}-{uuid.uuid4().hex}"
            if touched:
                old = self._of([state[b] for b in touched if b in state])
                both = self.merge(old.unionByName(new)).select(*columns).withColumn("bucket", self.bucket())
                both.repartition(len(touched), "bucket").write.partitionBy("bucket").parquet(f"{self.path}/{made}")
            if not touched:  # nothing to write: an idle stream leaves no records
                return True
            state |= {b: f"{made}/bucket={b}" for b in touched}
            self.folder.publish(f"commits/{epoch}", json.dumps({"buckets": self.buckets, "state": state}))
        finally:
            new.unpersist()
        return True

    def vacuum(self, keep: int = 2) -> int:
        """Delete all but the last ``keep`` commits and the data folders that only
        others name; returns how many folders went.  Not while an epoch is being written.
        """
        used: set[str] = set()
        for epoch in self.epochs()[-keep:]:
            used |= {v.split("/")[1] for v in json.loads(self.folder.text(f"commits/{epoch}"))["state"].values()}
        for epoch in self.epochs()[:-keep]:
            self.folder.delete(f"commits/{epoch}")
        gone = [n for n in self.folder.names("data") if n not in used]
        for name in gone:
            self.folder.delete(f"data/{name}")
        return len(gone)


# Merge rules of the stored tables.


def merge_hosts(rows: DataFrame) -> DataFrame:
    """The newest address, first and last time, and whether it was ever randomized."""
    return rows.groupBy("hw_addr").agg(
        F.max_by("ip_addr", F.struct("last_us", "ip_addr")).alias("ip_addr"), F.min("discovered_us").alias("discovered_us"), F.max("last_us").alias("last_us"),
        F.max("randomized").alias("randomized"),
    )


def merge_arp(rows: DataFrame) -> DataFrame:
    """First and last time, packets, and whether any was gratuitous, of each pairing."""
    return rows.groupBy("pairing").agg(
        F.min("hw_addr").alias("hw_addr"), F.min("ip_addr").alias("ip_addr"), F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"),
        F.sum("packets").alias("packets"), F.max("gratuitous").alias("gratuitous"),
    )


def newest(key: str, order: str) -> Callable[[DataFrame], DataFrame]:
    """The row of each key with the greatest ``order`` wins whole."""

    def merge(rows: DataFrame) -> DataFrame:
        names = rows.columns
        return rows.groupBy(key).agg(F.max_by(F.struct(*names), F.struct(order, *[c for c in names if c not in (key, order)])).alias("_r")).select("_r.*")

    return merge
