"""Exports and writers: flat files, SQL text and appended or replaced tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The columns of the exports, in order.
DEVICE_COLUMNS = [
    "mac", "ip_v4", "ip_v6", "manufacturer", "device_type", "os_family", "os_version", "hostname", "confidence", "first_seen", "last_seen", "alert_status",
    "owner", "location", "criticality", "tags", "notes", "authorization", "authorized_at", "authorized_by", "is_online", "offline_since", "presence_threshold_seconds",
]
ALERT_COLUMNS = ["id", "device_mac", "alert_type", "severity", "message", "timestamp", "acknowledged", "status", "disposition"]
INCIDENT_COLUMNS = ["id", "rule", "severity", "status", "disposition", "hw_addr", "message", "timestamp", "notes"]
ACTIVE_ALERTS, ALL_INCIDENTS = 10_000, 50_000


def shaped(df: DataFrame, columns: list[str]) -> DataFrame:
    """Exactly ``columns`` in order; absent ones are null, lists are joined by commas."""
    known = dict(df.dtypes)
    one = lambda c: F.lit(None).cast("string") if c not in known else F.array_join(c, ",") if known[c].startswith("array") else F.col(c)
    return df.select(*[one(c).alias(c) for c in columns])


def device_export(devices: DataFrame) -> DataFrame:
    return shaped(devices, DEVICE_COLUMNS)


def alert_export(findings: DataFrame, limit: int = ACTIVE_ALERTS) -> DataFrame:
    """The newest unresolved findings, up to ``limit``, as alerts."""
    newest = findings.where("NOT resolved").orderBy(F.col("us").desc(), F.col("id").desc()).limit(limit)
    named = newest.withColumnsRenamed({"hw_addr": "device_mac", "rule": "alert_type", "us": "timestamp"})
    return shaped(named.withColumn("acknowledged", F.col("status") == "acknowledged"), ALERT_COLUMNS)


def incident_export(findings: DataFrame, limit: int = ALL_INCIDENTS) -> DataFrame:
    """The newest findings of any state, up to ``limit``."""
    newest = findings.orderBy(F.col("us").desc(), F.col("id").desc()).limit(limit)
    return shaped(newest.withColumnRenamed("us", "timestamp"), INCIDENT_COLUMNS)


def write_export(df: DataFrame, path: str, kind: str = "csv") -> None:
    """CSV with a header, or JSON lines; anything else is refused."""
    if kind not in ("csv", "json"):
        raise ValueError(f"unknown export format {kind!r}")
    writer = df.write.mode("overwrite")
    if kind == "csv":
        writer.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    else:
        writer.option("ignoreNullFields", False).json(path)


def _literal(name: str, kind: str) -> Column:
    text = F.col(name).cast("string")
    numeric = kind.startswith(("decimal", "tinyint", "smallint", "int", "bigint", "float", "double"))
    if kind == "boolean":
        text = F.col(name).cast("int").cast("string")
    elif not numeric:
        text = F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("''")), F.lit("'"))
    return F.coalesce(text, F.lit("NULL"))


def sql_dump(df: DataFrame, table: str) -> DataFrame:
    """(value) one INSERT statement per row; quotes are doubled, nulls are NULL."""
    values = F.concat_ws(",", *[_literal(n, k) for n, k in df.dtypes])
    return df.select(F.concat(F.lit(f'INSERT INTO "{table}" VALUES ('), values, F.lit(");")).alias("value"))


def append_sightings(packets: DataFrame, path: str) -> None:
    """Appends packets, partitioned by their UTC date; maps become JSON text here only."""
    flat = [F.to_json(n).alias(n) if k.startswith(("map", "struct")) else F.col(n) for n, k in packets.dtypes]
    date = F.date_format(F.timestamp_micros("us"), "yyyy-MM-dd")
    packets.select(*flat, date.alias("date")).write.mode("append").partitionBy("date").parquet(path)


def append_anomalies(rows: DataFrame, path: str) -> None:
    """Appends anomalies as JSON lines; each job adds files, so none has to be rotated."""
    rows.write.mode("append").option("ignoreNullFields", False).json(path)


def batched(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, seconds: float = 0.1):
    """Writes a stream in micro-batches, one transaction of ``write`` each."""
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(processingTime=f"{int(seconds * 1000)} milliseconds").start()
