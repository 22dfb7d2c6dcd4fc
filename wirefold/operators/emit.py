"""Evidence emitters: typed packets to zero or more evidence rows.

Each emitter is a DataFrame function of one protocol; ``register`` adds more.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import mac, names

COLUMNS = ["packet_id", "hw_addr", "source", "method", "certainty", "category", "vendor", "platform", "hostname"]
EMITTERS: dict[str, list[Callable[[DataFrame], DataFrame]]] = {}


def register(*protocols: str):
    """Add an emitter: a function of the protocol's packets."""

    def put(fn):
        for p in protocols:
            EMITTERS.setdefault(p, []).append(fn)
        return fn

    return put


def row(df: DataFrame, source, method: str, certainty, **fields: Column) -> DataFrame:
    source = source if isinstance(source, Column) else F.lit(source)
    certainty = certainty if isinstance(certainty, Column) else F.lit(certainty)
    some = [fields.get(f, F.lit(None)).cast("string").alias(f) for f in COLUMNS[5:]]
    return df.select("packet_id", "hw_addr", source.alias("source"), F.lit(method).alias("method"), certainty.cast("double").alias("certainty"), *some)


@register("arp")
def _arp(p: DataFrame) -> DataFrame:
    return row(p, "arp", "observed", 0.3)


@register("dhcpv4")
def _dhcp(p: DataFrame) -> DataFrame:
    os = F.when(F.col("opt60").startswith("MSFT"), "Windows").when(F.col("opt60").startswith("android"), "Android").when(F.col("opt60").startswith("dhcpcd"), "Linux")
    return row(p, "dhcpv4", "pattern", 0.75, platform=os, hostname=F.col("hostname"))


@register("dns")
def _dns(p: DataFrame) -> DataFrame:
    return row(p, "dns", "query", 0.45)


# Service types, their category, vendor, and whether only the
# owner of the service announces it.
SERVICES = {
    "_googlecast._tcp": ("streaming_device", "Google", True), "_airplay._tcp": ("media_device", "Apple", False), "_ipp._tcp": ("printer", None, False),
    "_ssh._tcp": ("computer", None, False), "_hap._tcp": ("smart_home", None, True),
}


@register("mdns")
def _mdns(p: DataFrame) -> DataFrame:
    """Reflected announcements of randomized addresses say nothing about them."""
    p = p.where("service IS NOT NULL")
    reflected = mac.randomized(F.col("hw_addr"))
    category, vendor, exclusive = F.lit(None), F.lit(None), F.lit(False)
    for name, (c, v, own) in SERVICES.items():
        met = F.col("service") == name
        category, vendor, exclusive = F.when(met, F.lit(c)).otherwise(category), F.when(met, F.lit(v)).otherwise(vendor), F.when(met, F.lit(own)).otherwise(exclusive)
    source = F.when(exclusive, "mdns_exclusive").otherwise("mdns_service")
    return row(p, source, "pattern", F.when(reflected, 0.15).otherwise(0.65), category=F.when(~reflected, category), vendor=F.when(~reflected, vendor))


@register("tcp_syn")
def _syn(p: DataFrame) -> DataFrame:
    return row(p, "tcp_syn", "ttl", 0.4, platform=F.when(F.col("ttl") <= 64, "Linux").when(F.col("ttl") <= 128, "Windows"))


def emitted(packets: DataFrame) -> DataFrame:
    """All evidence of all packets, emitter by emitter."""
    out = None
    for protocol, functions in EMITTERS.items():
        for fn in functions:
            part = fn(packets.where(F.col("protocol") == protocol))
            out = part if out is None else out.unionByName(part)
    return out


def cross_validated(evidence: DataFrame, source: str = "mdns", reference: str = "oui") -> DataFrame:
    """Announcements that contradict the registry's vendor count almost nothing."""
    votes = evidence.where(F.col("source") == reference).groupBy("hw_addr", "vendor").agg(F.round(F.sum("certainty"), 6).alias("s"))
    ref = votes.groupBy("hw_addr").agg(F.max_by("vendor", F.struct("s", "vendor")).alias("_ref"))
    out = evidence.join(ref, "hw_addr", "left")
    conflict = (F.col("source") == source) & F.col("_ref").isNotNull() & ~names.same_vendor(F.col("vendor"), F.col("_ref"))
    out = out.withColumn("certainty", F.when(conflict, F.least("certainty", F.lit(0.15))).otherwise(F.col("certainty")))
    return out.withColumn("category", F.when(~conflict, F.col("category"))).drop("_ref")
