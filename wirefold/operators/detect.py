"""Detection rules over ARP, verdict history, DNS and presence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import mac
from ..sources.shared import written
from . import throttle

SECOND = 1_000_000
# Default windows and limits of the ARP rules.
CONFLICT_WINDOW = 120 * SECOND
BURST_WINDOW, BURST_LIMIT, BURST_LIMIT_INFRA = 60 * SECOND, 20, 50
CHANGE_WINDOW, CHANGE_LIMIT = 300 * SECOND, 3
RATE_LIMIT = 300 * SECOND
INFRASTRUCTURE = ["access_point", "firewall", "gateway", "load_balancer", "router", "switch"]

# Offline thresholds in seconds by category.
PRESENCE = {
    "phone": 1800, "tablet": 1800, "wearable": 3600, "media_device": 1800, "media_player": 1800, "smart_speaker": 1800, "streaming_device": 1800,
    "smart_tv": 1800, "game_console": 1800, "laptop": 1200, "robot_vacuum": 3600, "printer": 3600, "iot": 600, "smart_home": 600,
}
PRESENCE_DEFAULT, PRESENCE_RANDOMIZED = 300, 1800


def binding_violations(arp: DataFrame, bindings: DataFrame) -> DataFrame:
    """Claims of a pinned address by another hardware address."""
    pins = bindings.withColumnsRenamed({"mac": "_pinned"})
    return arp.join(F.broadcast(pins), "ip_addr").where("hw_addr <> _pinned").drop("_pinned")  # a small configuration table


def address_conflicts(arp: DataFrame, bindings: DataFrame, window: int = CONFLICT_WINDOW) -> DataFrame:
    """An address claimed by another hardware address within ``window``.

    Not for pinned addresses, nor if both addresses are randomized.
    """
    w = Window.partitionBy("ip_addr").orderBy("us", "packet_id")
    out = arp.withColumn("_prior", F.lag("hw_addr").over(w)).withColumn("_prior_us", F.lag("us").over(w))
    out = out.where("_prior <> hw_addr").where(F.col("us") - F.col("_prior_us") <= window)
    out = out.where(~(mac.local_bit(F.col("hw_addr")) & mac.local_bit(F.col("_prior"))))
    return out.join(F.broadcast(bindings.select("ip_addr")), "ip_addr", "left_anti")


def gratuitous_bursts(arp: DataFrame, infra: DataFrame, window: int = BURST_WINDOW, limit: int = BURST_LIMIT, limit_infra: int = BURST_LIMIT_INFRA) -> DataFrame:
    """Gratuitous claims beyond the limit in (t - window, t]."""
    own = arp.where((F.col("op") == 2) & (F.col("ip_addr") == F.col("target_ip")))
    out = throttle.sliding_count(own, ["hw_addr"], "us", window)
    out = out.join(infra.select("hw_addr", F.lit(True).alias("_infra")), "hw_addr", "left")
    return out.where(F.col("n") > F.when(F.col("_infra"), limit_infra).otherwise(limit)).drop("_infra")


def flip_flops(arp: DataFrame, infra: DataFrame, window: int = CHANGE_WINDOW, limit: int = CHANGE_LIMIT) -> DataFrame:
    """An address that moves between hardware addresses, not all randomized."""
    out = throttle.sliding_changes(arp, ["ip_addr"], "us", "packet_id", "hw_addr", window)
    w = Window.partitionBy("ip_addr").orderBy("us")  # the newest row that is not randomized lies within the window
    out = out.withColumn("_stable", F.max(F.when(~mac.local_bit(F.col("hw_addr")), F.col("us"))).over(w))
    out = out.where((F.col("changes") >= limit) & (F.col("us") - F.col("_stable") < window)).drop("_stable")
    return out.join(infra.select("hw_addr"), "hw_addr", "left_anti")


def limited(found: DataFrame, keys: list[str], interval: int = RATE_LIMIT) -> DataFrame:
    """One row per key and firing time: the throttle comes before suppression."""
    return throttle.fired(found.dropna(subset=keys), keys, "us", interval, ["packet_id"])


def arp_findings(arp: DataFrame, bindings: DataFrame, infra: DataFrame, suppressed: DataFrame, scale: int = 1) -> DataFrame:
    """All ARP rules with their severities; ``scale`` widens every window."""
    # Several rules read both: they are made once.
    arp = written(arp.select("packet_id", "us", "hw_addr", "ip_addr", "op", "target_ip"), "arp-rows")
    infra = written(infra.select("hw_addr"), "arp-infra")
    parts = [
        ("gateway_impersonation", "critical", binding_violations(arp, bindings), ["ip_addr", "hw_addr"]),
        ("addr_conflict", "warning", address_conflicts(arp, bindings, CONFLICT_WINDOW * scale), ["ip_addr"]),
        ("grat_flood", "high", gratuitous_bursts(arp, infra, BURST_WINDOW * scale), ["hw_addr"]),
        ("flip_flop", "high", flip_flops(arp, infra, CHANGE_WINDOW * scale), ["ip_addr"]),
    ]
    out = None
    for name, severity, found, keys in parts:
        part = limited(found.select("packet_id", "hw_addr", "ip_addr", "us"), keys, RATE_LIMIT * scale).select("*", F.lit(name).alias("rule"), F.lit(severity).alias("severity"))
        out = part if out is None else out.unionByName(part)
    s = F.broadcast(suppressed)  # a small configuration table
    met = (s["mac"].isNull() | (s["mac"] == out["hw_addr"])) & (s["ip"].isNull() | (s["ip"] == out["ip_addr"])) & (s["subtype"].isNull() | (s["subtype"] == out["rule"]))
    return out.join(s, met, "left_anti")


def identity_shifts(history: DataFrame, least: int = 50, evidence: int = 3) -> DataFrame:
    """Changes between neighbouring verdicts that are both sure enough."""
    w = Window.partitionBy("hw_addr").orderBy("us", "id")
    out = history
    for c in ("category", "vendor", "platform", "certainty"):
        out = out.withColumn(f"_{c}", F.lag(c).over(w))
    out = out.where((F.col("certainty") >= least) & (F.col("_certainty") >= least) & (F.col("evidence") >= evidence))
    moved = lambda c: F.col(c).isNotNull() & F.col(f"_{c}").isNotNull() & (F.col(c) != F.col(f"_{c}"))
    severity = F.when(moved("category") | moved("vendor"), "critical").when(moved("platform"), "high")
    return out.withColumn("severity", severity).where("severity IS NOT NULL").drop("_category", "_vendor", "_platform", "_certainty")


def offline_threshold(base: Column, device_type: Column, randomized: Column) -> Column:
    """Seconds without packets after which a device is offline."""
    own = F.coalesce(base, F.lit(PRESENCE_DEFAULT))
    by = own
    for name, seconds in PRESENCE.items():
        by = F.when(F.lower(device_type) == name, seconds).otherwise(by)
    by = F.when(F.coalesce(randomized, F.lit(False)), F.greatest(by, F.lit(PRESENCE_RANDOMIZED))).otherwise(by)
    return F.when(own != PRESENCE_DEFAULT, own).otherwise(by)


def presence_sweep(hosts: DataFrame, devices: DataFrame, now: Column, scale: int = 1) -> DataFrame:
    """Transitions between online and offline at one moment."""
    met = hosts.select("hw_addr", "last_us", "randomized").join(devices.select(F.col("mac").alias("hw_addr"), "is_online", "threshold", "device_type", "criticality"), "hw_addr", "full_outer")
    met = met.where("last_us IS NOT NULL")
    seconds = offline_threshold(F.col("threshold"), F.col("device_type"), F.col("randomized") == 1)
    out = met.withColumn("seconds", seconds).withColumn("online", F.coalesce("is_online", F.lit(True)))
    alive = now - F.col("last_us") <= F.col("seconds").cast("long") * SECOND * scale
    out = out.withColumn("alive", alive).where("alive <> online")
    name = lambda c: F.when(c, "online").otherwise("offline")
    severity = F.when(F.col("alive"), "info").when(F.col("criticality") == "critical", "critical").when(F.col("criticality") == "high", "high").when(F.col("criticality") == "medium", "warning").otherwise("low")
    return out.select("hw_addr", name(F.col("online")).alias("before"), name(F.col("alive")).alias("after"), "last_us", "seconds", severity.alias("severity"))


def affinity_drift(dns: DataFrame, learn: int, least: int = 20, displaced: float = 0.5, top: float = 0.4) -> DataFrame:
    """Addresses whose main vendor of DNS names has changed.

    ``dns``: hw_addr, us, vendor (classified queries).  The baseline is the
    main vendor of the queries within ``learn`` of the first, once there are
    ``least``; drift is judged over all queries.
    """
    w = Window.partitionBy("hw_addr")
    rows = dns.withColumn("_early", (F.col("us") - F.min("us").over(w) <= learn).cast("int"))
    n = rows.groupBy("hw_addr", "vendor").agg(F.count("*").alias("n"), F.sum("_early").alias("early"))
    per = n.groupBy("hw_addr").agg(
        F.sum("n").alias("total"), F.sum("early").alias("learned"), F.max_by("vendor", F.struct("early", "vendor")).alias("baseline"),
        F.max_by("vendor", F.struct("n", "vendor")).alias("current"), F.max("n").alias("top_n"), F.max_by("n", F.struct("early", "vendor")).alias("base_n"),
    )
    per = per.where((F.col("learned") >= least) & (F.col("current") != F.col("baseline")))
    per = per.withColumn("from_pct", F.round(F.col("base_n") * 100.0 / F.col("total"), 1)).withColumn("to_pct", F.round(F.col("top_n") * 100.0 / F.col("total"), 1))
    return per.where((1 - F.col("base_n") / F.col("total") >= displaced) & (F.col("top_n") / F.col("total") >= top)).select("hw_addr", F.col("baseline").alias("from_vendor"), "from_pct", F.col("current").alias("to_vendor"), "to_pct")
