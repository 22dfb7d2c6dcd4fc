"""Device inventory: the joined device list, its filters, sorts and pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ip

CRITICALITY_RANK = {"critical": 4, "high": 3, "medium": 2, "low": 1}

#: Sort keys that a caller may name.
SORTS = {
    "last_seen": "last_us", "discovered_at": "discovered_us", "mac": "hw_addr", "ip": "_ip", "hostname": "hostname", "vendor": "vendor",
    "category": "category", "platform": "platform", "certainty": "certainty", "disposition": "disposition", "owner": "owner",
    "location": "location", "criticality": "_criticality", "authorization": "authorization", "online": "is_online", "randomized": "randomized",
    "packets": "packets",
}


def criticality_rank(c: Column) -> Column:
    out = F.lit(0)
    for name, rank in CRITICALITY_RANK.items():
        out = F.when(c == name, rank).otherwise(out)
    return out


def joined(hosts: DataFrame, verdicts: DataFrame, devices: DataFrame) -> DataFrame:
    """Hosts with their verdict and device rows, where there are any."""
    v = verdicts.withColumnRenamed("hostname", "_v_hostname")
    d = devices.withColumnsRenamed({"mac": "hw_addr", "hostname": "_d_hostname"})
    out = hosts.join(v, "hw_addr", "left").join(d, "hw_addr", "left")
    return out.withColumn("hostname", F.coalesce("_v_hostname", "_d_hostname")).drop("_v_hostname", "_d_hostname")


def search(df: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """Rows where any column contains the text, whatever the case."""
    like = "%" + text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "%"
    return df.where(reduce(lambda a, b: a | b, [F.coalesce(F.col(c).ilike(like), F.lit(False)) for c in columns]))


def filtered(df: DataFrame, equal: dict | None = None, least_certainty: int | None = None, tag: str | None = None, authorization: str | None = None, online: bool | None = None) -> DataFrame:
    """Conjunction of the given conditions; absent ones do not count."""
    terms = [F.col(k) == v for k, v in (equal or {}).items()]
    if least_certainty is not None:
        terms.append(F.coalesce("certainty", F.lit(0)) >= least_certainty)
    if tag is not None:
        terms.append(F.coalesce(F.array_contains("tags", tag), F.lit(False)))
    if authorization is not None:
        terms.append(F.coalesce("authorization", F.lit("unapproved")) == authorization)
    if online is not None:
        terms.append(F.coalesce("is_online", F.lit(True)) == online)
    return reduce(DataFrame.where, terms, df)


def ordered(df: DataFrame, sort: str = "last_seen", descending: bool = True) -> list[Column]:
    """Sort columns of a whitelisted key, nulls last, ties by address."""
    name = SORTS.get(sort, "discovered_us")
    key = ip.to_number(F.col("ip_addr")) if name == "_ip" else criticality_rank(F.col("criticality")) if name == "_criticality" else F.col(name)
    return [key.desc_nulls_last() if descending else key.asc_nulls_last(), F.col("hw_addr").asc()]


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """One page (from 1) in the given order; size is kept within 1 and 500."""
    size = max(1, min(500, size))
    return df.orderBy(*order).offset((max(1, number) - 1) * size).limit(size)


def latest(df: DataFrame, keys: list[str], order: list[Column], keep: int = 1) -> DataFrame:
    """The first ``keep`` rows of each key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= keep).drop("_n")


def overridden(df: DataFrame, overrides: DataFrame, columns: list[str]) -> DataFrame:
    """Manual values win over computed ones where they are not empty."""
    o = overrides.select("hw_addr", *[F.col(c).alias(f"_o_{c}") for c in columns])
    out = df.join(o, "hw_addr", "left")
    for c in columns:
        out = out.withColumn(c, F.coalesce(F.nullif(F.col(f"_o_{c}"), F.lit("")), F.col(c)))
    return out.drop(*[f"_o_{c}" for c in columns])
