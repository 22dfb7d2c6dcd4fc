"""Parsers of fingerprint feeds and lease files: text lines to typed rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LEASE_LINE = r"^(\d+)\s+([0-9a-fA-F]{2}(?::[0-9a-fA-F]{2}){5})\s+(\d+\.\d+\.\d+\.\d+)\s+(\S+)(?:\s+(\S+))?"


def oui_lines(lines: DataFrame) -> DataFrame:
    """``XX-XX-XX   (hex)   Vendor`` lines; others are skipped."""
    pattern = r"^([0-9A-Fa-f]{2}-[0-9A-Fa-f]{2}-[0-9A-Fa-f]{2})\s+\(hex\)\s+(.*)$"
    out = lines.select(F.upper(F.regexp_replace(F.regexp_extract("value", pattern, 1), "-", ":")).alias("prefix"), F.trim(F.regexp_extract("value", pattern, 2)).alias("vendor"))
    short = F.when(F.length("vendor") > 30, F.concat(F.left(F.col("vendor"), F.lit(27)), F.lit("..."))).otherwise(F.col("vendor"))
    return out.where("prefix <> ''").withColumn("vendor", short)


def signature_lines(lines: DataFrame) -> DataFrame:
    """Sections of ``label = x`` and ``sig = a:b:c`` lines (value, n): each
    signature with the label above it."""
    key = F.trim(F.regexp_extract("value", r"^\s*(\w+)\s*=", 1))
    text = F.trim(F.regexp_extract("value", r"=\s*(.*)$", 1))
    w = Window.partitionBy("file").orderBy("n")
    rows = lines.withColumn("label", F.last(F.when(key == "label", text), ignorenulls=True).over(w)).where(key == "sig")
    part = F.split(text, ":")
    fields = ["ver", "ittl", "olen", "mss", "window", "options", "quirks"]
    return rows.select("file", "n", "label", *[F.get(part, i).alias(f) for i, f in enumerate(fields)])


def hierarchy(items: DataFrame, depth: int = 10) -> DataFrame:
    """(id, parent, name) to id and its path from the root, at most ``depth`` levels."""
    up = items.select(F.col("id").alias("_id"), F.col("parent").alias("_parent"), F.col("name").alias("_name"))
    out = items.select("id", F.col("parent").alias("_at"), F.col("name").alias("path"))
    for _ in range(depth - 1):
        out = out.join(up, F.col("_at") == F.col("_id"), "left").select("id", F.col("_parent").alias("_at"), F.concat_ws(" > ", "_name", "path").alias("path"))
    return out.select("id", "path")


def enterprise_numbers(lines: DataFrame) -> DataFrame:
    """Records of a decimal line followed by an organisation line (value, n)."""
    w = Window.partitionBy("file").orderBy("n")
    return lines.withColumn("name", F.trim(F.lead("value").over(w))).where(F.col("value").rlike(r"^\d+$")).select(F.col("value").cast("int").alias("id"), "name")


def combinations(rows: DataFrame) -> DataFrame:
    """Option lists with all devices that send them (options, device)."""
    return rows.groupBy("options").agg(F.array_sort(F.collect_set("device")).alias("devices"))


def unpivoted_hashes(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row per non-empty fingerprint column: hash, kind, application."""
    return rows.unpivot(["application"], columns, "kind", "hash").where("hash IS NOT NULL AND hash <> ''").select("hash", "kind", "application")


def weighted_tests(rows: DataFrame) -> DataFrame:
    """Nested tests flattened; of equal match texts the heaviest stays."""
    t = rows.select("os", F.explode("tests").alias("t")).select("os", F.lower("t.match").alias("match"), F.col("t.weight").alias("weight"))
    return t.groupBy("match").agg(F.max_by("os", F.struct("weight", "os")).alias("os"), F.max("weight").alias("weight"))


def xml_patterns(spark: SparkSession, path: str) -> DataFrame:
    """Fingerprint XML files: pattern, description and parameters."""
    schema = "_pattern string, description string, param array<struct<_pos:int,_name:string,_value:string>>"
    return spark.read.schema(schema).option("rowTag", "fingerprint").xml(path).select(F.col("_pattern").alias("pattern"), "description", F.col("param").alias("params"))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; bad ones are dropped."""
    full = f"{schema}, _corrupt_record string"
    return spark.read.schema(full).option("mode", "PERMISSIVE").json(path).cache().where("_corrupt_record IS NULL").drop("_corrupt_record")


def dnsmasq_leases(lines: DataFrame) -> DataFrame:
    """``epoch mac ip hostname clientid`` lines; bad ones are skipped."""
    part = lambda i: F.regexp_extract("value", LEASE_LINE, i)
    out = lines.where(F.col("value").rlike(LEASE_LINE))
    return out.select(part(1).cast("long").alias("expires"), F.lower(part(2)).alias("hw_addr"), part(3).alias("ip_addr"), F.when(part(4) != "*", part(4)).alias("hostname"), F.lit(0.75).alias("certainty"))


def isc_leases(texts: DataFrame) -> DataFrame:
    """``lease IP { ... }`` blocks of whole files (value)."""
    block = r"lease\s+[0-9.]+\s*\{[^}]*\}"
    b = texts.select(F.explode(F.regexp_extract_all("value", F.lit(block), F.lit(0))).alias("b"))
    mac = F.lower(F.regexp_extract("b", r"hardware ethernet\s+([0-9A-Fa-f:]{17})", 1))
    name = F.regexp_extract("b", r'client-hostname\s+"([^"]*)"', 1)
    return b.where(mac != "").select(mac.alias("hw_addr"), F.regexp_extract("b", r"lease\s+([0-9.]+)", 1).alias("ip_addr"), F.nullif(name, F.lit("")).alias("hostname"), F.lit(0.75).alias("certainty"))


def guarded_sql(spark: SparkSession, statement: str, limit: int = 10_000) -> DataFrame:
    """One read-only SELECT over the session's views, at most ``limit`` rows."""
    import re

    text = statement.strip()
    banned = r"(?i)\b(insert|update|delete|drop|alter|create|attach|pragma|replace|truncate|merge|grant|set|cache|refresh|load)\b"
    if not re.match(r"(?i)^(select|with)\b", text) or ";" in text or re.search(banned, text):
        raise ValueError("only one read-only SELECT is allowed")
    return spark.sql(text).limit(limit)


def recog_rules(spark: SparkSession, path: str) -> DataFrame:
    """Fingerprint XML files as rules: priority (file, then order in it), pattern, description, params."""
    order = F.struct(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("n"))
    return xml_patterns(spark, path).where("pattern IS NOT NULL").withColumn("priority", order)
