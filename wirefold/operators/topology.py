"""Network graph as two DataFrames: nodes (tier) and edges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ip
from ..sources.shared import written
from .identity import numbered

INFRASTRUCTURE = ["access_point", "cable_modem", "firewall", "gateway", "load_balancer", "mesh_router", "network_device", "router", "switch", "wireless_bridge"]


def tiered(devices: DataFrame, bindings: DataFrame) -> DataFrame:
    """Adds ``rank``, the gateway tier a device is in: pinned, router types, low
    addresses (else null), in one pass."""
    pinned = bindings.select(F.col("mac").alias("hw_addr"), F.lit(True).alias("_pinned")).distinct()
    rank = F.when(F.col("_pinned"), 1).when(F.col("category").isin("router", "gateway", "firewall"), 2).when(F.col("ip_addr").rlike(r"\.[12]$"), 3)
    return devices.join(pinned, "hw_addr", "left").withColumn("rank", rank).drop("_pinned")


def gateways(devices: DataFrame, bindings: DataFrame) -> DataFrame:
    """Gateways by the best tier that has any.

    ``devices``: hw_addr, ip_addr, category.
    """
    every = written(tiered(devices, bindings), "tiers")  # its least rank is asked of it, too
    return every.where(F.col("rank") == every.select(F.min("rank")).scalar()).select("hw_addr", F.col("rank").alias("tier")).distinct()


def nodes(devices: DataFrame, bindings: DataFrame) -> DataFrame:
    """Devices with an address and their tier: gateway, infrastructure, client."""
    every = written(tiered(devices, bindings), "tiers")
    gate = F.col("rank") == every.select(F.min("rank")).scalar()
    tier = F.when(gate, "gateway").when(F.col("category").isin(INFRASTRUCTURE), "infrastructure").otherwise("client")
    return every.where("ip_addr IS NOT NULL").select("hw_addr", "ip_addr", tier.alias("tier"), ip.subnet(F.col("ip_addr")).alias("subnet"))


def edges(found: DataFrame, links: DataFrame, overrides: DataFrame) -> DataFrame:
    """Uplinks: each client to a gateway of its subnet or the smallest one,
    neighbour links beside them, manual parents instead of both.

    ``links``: a, b (neighbours); ``overrides``: hw_addr, parent.
    """
    gate = found.where("tier = 'gateway'")
    local = gate.groupBy("subnet").agg(F.min("hw_addr").alias("_local"))
    first = local.select(F.min("_local")).scalar()
    up = found.where("tier <> 'gateway'").join(local, "subnet", "left")
    up = up.select(F.coalesce("_local", first).alias("source"), F.col("hw_addr").alias("target"), F.when(F.col("tier") == "client", "client").otherwise("trunk").alias("kind"), F.lit(3).alias("rank"))
    near = links.select(F.least("a", "b").alias("source"), F.greatest("a", "b").alias("target"), F.lit("lldp").alias("kind"), F.lit(2).alias("rank")).where("source <> target").distinct()
    manual = overrides.select(F.col("parent").alias("source"), F.col("hw_addr").alias("target"), F.lit("manual").alias("kind"), F.lit(1).alias("rank"))
    plain = up.unionByName(near).join(manual.select("target"), "target", "left_anti")
    every = plain.unionByName(manual).where("source IS NOT NULL")
    w = Window.partitionBy(F.least("source", "target"), F.greatest("source", "target")).orderBy("rank", "source")
    return every.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("source", "target", "kind")


SWITCHES = ["switch", "unifi switch"]
# Makers of virtual network cards, and the types that host them.
VIRTUAL = ["00:0c:29", "00:50:56", "52:54:00", "00:16:3e", "08:00:27"]
COMPUTERS = ["workstation", "computer", "server", "desktop", "laptop"]
INTERNET = "internet"


def _dealt(mac: Column) -> Column:
    """A number that deals addresses evenly over any list."""
    return F.conv(F.substring(F.md5(mac), 1, 8), 16, 10).cast("long")


class Graph:
    """The whole graph: ``nodes`` (written once) and ``edges``.

    ``devices``: hw_addr, ip_addr, type, connection (wired, wireless, else
    unknown), volume (ARP packets); ``bindings``: mac; ``links``: a, b
    (neighbours); ``overrides``: hw_addr, parent (an address or ``internet``).

    Gateways are those of the best tier that has any (pinned, router types,
    low addresses); where some of them are no infrastructure and others are,
    those go and all routers are gateways.  The busiest switch is the core; it
    stands in for a missing gateway.  Lists that edges are dealt over are
    joined by place, so no list reaches one task or the driver; one row of
    sums does.
    """

    def __init__(self, devices: DataFrame, bindings: DataFrame, links: DataFrame, overrides: DataFrame) -> None:
        pinned = bindings.select(F.col("mac").alias("hw_addr"), F.lit(True).alias("_pinned")).distinct()
        known = devices.where("ip_addr IS NOT NULL AND hw_addr IS NOT NULL").join(pinned, "hw_addr", "left")
        router, kind = F.col("type").isin("router", "gateway", "firewall"), F.col("type")
        rank = F.when(F.col("_pinned"), 1).when(router, 2).when(F.col("ip_addr").rlike(r"\.[12]$"), 3)
        infra = F.coalesce(kind.isin(INFRASTRUCTURE), F.lit(False))
        raw = written(
            known.select("hw_addr", "ip_addr", "type", ip.subnet(F.col("ip_addr")).alias("subnet"), F.coalesce("connection", F.lit("unknown")).alias("connection"),
                         F.coalesce("volume", F.lit(0)).cast("long").alias("volume"), rank.alias("rank"), infra.alias("infra")), "nodes")
        best = raw.agg(F.min("rank").alias("rank"), F.coalesce(F.bool_or("infra"), F.lit(False)).alias("infra")).first()
        first = F.coalesce(F.col("rank") == F.lit(best.rank), F.lit(False)) if best.rank is not None else F.lit(False)
        wrong = raw.where(first & ~F.col("infra")).limit(1).count() > 0 and best.infra
        gate = (first & F.col("infra")) | F.coalesce(kind == "router", F.lit(False)) if wrong else first
        tier = F.when(gate, "gateway").when(F.col("infra"), "infrastructure").otherwise("client")
        tiers = raw.withColumn("tier", tier)
        switch = (F.col("tier") == "infrastructure") & kind.isin(SWITCHES)
        point = (F.col("tier") == "infrastructure") & (kind == "access_point")
        self.sums = tiers.agg(
            F.max(F.when(switch, F.struct("volume", _reversed(F.col("hw_addr")).alias("_order"), "hw_addr"))).getField("hw_addr").alias("core"), F.min(F.when(F.col("tier") == "gateway", F.col("hw_addr"))).alias("gate"),
            F.count_if(switch).alias("switches"), F.count_if(point).alias("points"), F.min(F.when(F.col("tier") != "client", F.col("hw_addr"))).alias("other"),
        ).first()
        core = F.col("hw_addr") == F.lit(self.sums.core) if self.sums.core else F.lit(False)
        shown = F.lit(self.sums.gate is None) & core
        self.tiers = tiers.withColumns({"core": core, "dealt": _dealt(F.col("hw_addr"))})
        self.nodes = self.tiers.withColumn("tier", F.when(shown, "gateway").otherwise(F.col("tier")))
        self.links, self.overrides = links, overrides

    def _numbered(self, rows: DataFrame) -> DataFrame:
        return numbered(rows, "hw_addr", first=0).withColumnsRenamed({"hw_addr": "_one", "number": "_place"})

    def edges(self) -> DataFrame:
        """source, target, kind: wan, trunk, lldp, client, wireless, vm, manual."""
        s, all_ = self.sums, self.tiers
        gate, infra = all_.where("tier = 'gateway'").select("hw_addr"), all_.where("tier = 'infrastructure'")
        clients = all_.where("tier = 'client'")
        edge = lambda df, source, target, kind: df.select(_text(source).alias("source"), _text(target).alias("target"), _text(kind, True).alias("kind"))
        out = [edge(gate, F.lit(INTERNET), "hw_addr", "wan")] if s.gate else [edge(infra.where("core"), F.lit(INTERNET), "hw_addr", "wan")]
        trunk = None
        if s.core:
            trunk = edge(gate, "hw_addr", F.lit(s.core), "trunk").unionByName(edge(infra.where("NOT core"), F.lit(s.core), "hw_addr", "trunk"))
            out.append(trunk)
        # Neighbours that both stand in the graph, once for each pair, unless a trunk joins them.
        ends = all_.select("hw_addr", "tier")
        near = self.links.select(F.least("a", "b").alias("source"), F.greatest("a", "b").alias("target")).where("source <> target").distinct()
        near = near.join(ends.select(F.col("hw_addr").alias("source"), F.col("tier").alias("_s")), "source").join(ends.select(F.col("hw_addr").alias("target"), F.col("tier").alias("_t")), "target")
        near = written(near.select("source", "target", "_s", "_t"), "neighbours")
        plain = near.select("source", "target")
        if trunk is not None:
            plain = plain.join(trunk.select(F.least("source", "target").alias("source"), F.greatest("source", "target").alias("target")), ["source", "target"], "left_anti")
        out.append(edge(plain, "source", "target", "lldp"))
        # A client beside infrastructure has its link already.
        beside = near.where("_t = 'infrastructure'").select(F.col("source").alias("hw_addr")).unionByName(near.where("_s = 'infrastructure'").select(F.col("target").alias("hw_addr"))).distinct()
        free = clients.join(beside, "hw_addr", "left_anti")
        virtual = F.substring("hw_addr", 1, 8).isin(VIRTUAL)
        host = clients.where(~virtual & F.col("type").isin(COMPUTERS)).groupBy("subnet").agg(F.min("hw_addr").alias("_host"))
        free = free.join(host, "subnet", "left").withColumn("_host", F.when(virtual, F.col("_host")))
        local = all_.where("tier = 'gateway'").groupBy("subnet").agg(F.min("hw_addr").alias("_gate"))
        free = free.join(local, "subnet", "left").withColumn("_gate", F.coalesce("_gate", F.lit(s.gate)))
        free = free.withColumns({"_point": F.lit(None).cast("string"), "_switch": F.lit(None).cast("string")})
        if s.points:
            mine = Window.partitionBy("subnet")
            points = infra.where("type = 'access_point'")
            near_by = points.select("subnet", F.col("hw_addr").alias("_near"), (F.row_number().over(mine.orderBy("hw_addr")) - 1).cast("long").alias("_place"), F.count("*").over(mine).alias("_of"))
            number = near_by.groupBy("subnet").agg(F.max("_of").alias("_of"))
            free = free.join(number, "subnet", "left").withColumn("_place", F.col("dealt") % F.col("_of")).drop("_of").join(near_by.drop("_of"), ["subnet", "_place"], "left").drop("_place")
            any_ = self._numbered(points)
            free = free.withColumn("_place", F.col("dealt") % s.points).join(any_, "_place", "left").withColumn("_point", F.coalesce("_near", "_one")).drop("_place", "_near", "_one")
        if s.switches:
            any_ = self._numbered(infra.where(F.col("type").isin(SWITCHES)))
            free = free.withColumn("_place", F.col("dealt") % s.switches).join(any_, "_place", "left").withColumn("_switch", F.col("_one")).drop("_place", "_one")
        wireless = F.col("connection") == "wireless" if not s.points else F.col("connection") != "wired"
        core, last = F.lit(s.core).cast("string"), F.lit(s.other or INTERNET)
        source = (
            F.when(F.col("_host").isNotNull(), F.col("_host")).when(wireless, F.coalesce("_point", core, "_gate", F.lit(INTERNET)))
            .when(F.col("connection") == "wired", F.coalesce("_switch", core, "_gate", last)).otherwise(F.coalesce(core, "_gate", last))
        )
        nothing = F.coalesce("_point", core, "_gate").isNull()
        kind = F.when(F.col("_host").isNotNull(), "vm").when(wireless & ~nothing, "wireless").otherwise("client")
        out.append(free.select(source.alias("source"), F.col("hw_addr").alias("target"), kind.alias("kind")))
        every = reduce(DataFrame.unionByName, out)
        child = self.overrides.join(all_.select("hw_addr"), "hw_addr", "left_semi")
        parent = all_.select(F.col("hw_addr").alias("parent")).unionByName(all_.sparkSession.createDataFrame([(INTERNET,)], "parent string"))
        manual = child.join(parent, "parent", "left_semi").select(F.col("parent").alias("source"), F.col("hw_addr").alias("target"), F.lit("manual").alias("kind"))
        return every.join(manual.select("target"), "target", "left_anti").select("source", "target", "kind").unionByName(manual)


def _text(value: Column | str, literal: bool = False) -> Column:
    return value if isinstance(value, Column) else F.lit(value) if literal else F.col(value)


def _reversed(mac: Column) -> Column:
    """Orders addresses downwards within a maximum."""
    return F.translate(mac, "0123456789abcdef", "fedcba9876543210")
