"""Exposure rules and chains over observations derived from packets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import exposure as X
from ..sources.adapters import pick
from . import oracle
from .base import query

# Stand-in predicates over the packet key, the data of the queries x00 to x08.
# Rule, severity, predicate, and the least devices and values.
PASSIVE = [
    ("NR-001", "high", "source = 'llmnr'", 1, 0), ("NR-002", "high", "source = 'netbios'", 1, 0), ("NR-003", "info", "source = 'mdns'", 1, 0),
    ("NR-004", "high", "source = 'dns' AND k % 5 = 1", 1, 0), ("L2-001", "medium", "source = 'arp'", 25, 0), ("L2-003", "medium", "source = 'arp' AND op = 2 AND ip_addr = target_ip", 1, 0),
    ("L2-005", "medium", "source IS NOT NULL", 100, 0), ("L2-006", "low", "source IN ('cdp', 'lldp')", 1, 0), ("L2-007", "high", "source = 'dtp' AND op = 1", 1, 0),
    ("L2-009", "high", "source = 'stp'", 1, 2), ("DH-001", "info", "source = 'dhcpv4'", 1, 0), ("DH-002", "medium", "source = 'dhcpv4' AND k > 80", 1, 0),
    ("DH-003", "high", "source = 'dhcp_server'", 2, 0), ("DH-004", "medium", "source = 'dhcpv6'", 1, 0), ("RT-001", "medium", "source = 'icmpv6_ra'", 1, 0),
    ("RT-002", "medium", "source = 'ospf'", 1, 0), ("RT-003", "info", "hw_addr LIKE '%0a'", 1, 0), ("TC-001", "medium", "source = 'tls' AND k < 40", 1, 0),
    ("TC-002", "medium", "source = 'http'", 1, 0), ("NI-001", "medium", "source = 'upnp'", 1, 0), ("NI-002", "low", "source = 'dns' AND query_name LIKE '%.org'", 1, 0),
    ("NI-003", "medium", "hw_addr LIKE '%0a' OR hw_addr LIKE '%14'", 2, 0), ("CRED-001", "high", "port IN (21, 23, 110, 143, 161)", 1, 0), ("CRED-002", "medium", "source = 'snmp'", 1, 0),
    ("L2-004", "medium", "source = 'ndp'", 1, 0),
]
SOURCES = ["llmnr", "netbios", "mdns", "dns", "arp", "cdp", "lldp", "dtp", "stp", "dhcpv4", "dhcp_server", "dhcpv6", "icmpv6_ra", "tls", "http", "upnp", "snmp", "ndp", None]

_PROBED = ["telnet", "ftp", "smb", "snmp", "modbus", "ssh", "ldap", "vnc", "ollama", "kerberos", "imap", "http"]
VIEWS = {
    "observations": f"SELECT *, {oracle.pick('k', SOURCES)} AS source, 'v' || (k % 4) AS val FROM packets",
    "x_passive": " UNION ALL ".join(
        f"SELECT '{r}' AS rule, '{s}' AS severity, count(DISTINCT hw_addr) AS devices, count(DISTINCT val) AS \"distinct\" FROM observations WHERE {p} HAVING count(DISTINCT hw_addr) >= {d} AND count(DISTINCT val) >= {v}" for r, s, p, d, v in PASSIVE
    ),
    "x_probes": f"SELECT DISTINCT hw_addr, {oracle.pick('k', _PROBED)} AS service FROM packets",
    "x_services": f"SELECT rule, severity, count(DISTINCT hw_addr) AS devices FROM x_probes JOIN {oracle.values([(r, n, s) for r, names, s in X.SERVICES for n in names], 's(rule, name, severity)')} ON name = service GROUP BY ALL",
    "x_all": "SELECT rule, severity FROM x_passive UNION ALL SELECT rule, severity FROM x_services",
}


def observations(t):
    k = F.col("k")
    return t.packets.withColumn("source", pick(k, SOURCES)).withColumn("value", F.concat(F.lit("v"), (k % 4).cast("string")))


def probes(t):
    return t.packets.select("hw_addr", pick(F.col("k"), _PROBED).alias("service")).distinct()


def everything(t):
    return X.passive(observations(t), PASSIVE).select("rule", "severity").unionByName(X.services(probes(t)).select("rule", "severity"))


@query("x00_context", "SELECT hw_addr, source, packet_id FROM (SELECT *, row_number() OVER (PARTITION BY hw_addr, source ORDER BY us DESC, packet_id DESC) AS n FROM observations WHERE source IS NOT NULL) WHERE n <= 5000", VIEWS)
def _(t):
    from ..operators.inventory import latest

    return latest(observations(t).where("source IS NOT NULL"), ["hw_addr", "source"], [F.col("us").desc(), F.col("packet_id").desc()], X.SCANNED).select("hw_addr", "source", "packet_id")


@query("x01_to_x08_passive_rules", 'SELECT rule, severity, devices, "distinct" FROM x_passive', VIEWS)
def _(t):
    return X.passive(observations(t), PASSIVE)


@query("x02_duplicate_ip", "SELECT ip_addr, count(DISTINCT hw_addr) AS macs FROM observations WHERE source = 'arp' GROUP BY ip_addr HAVING macs > 1", VIEWS)
def _(t):
    return observations(t).where("source = 'arp'").groupBy("ip_addr").agg(F.countDistinct("hw_addr").alias("macs")).where("macs > 1")


@query("x03_l2_visibility", "SELECT count(*) FILTER (source IN ('cdp', 'lldp', 'stp', 'dtp')) = 0 AS blind, count(DISTINCT hw_addr) FILTER (source = 'stp') AS roots FROM observations", VIEWS)
def _(t):
    l2 = F.col("source").isin("cdp", "lldp", "stp", "dtp")
    return observations(t).agg((F.sum(F.coalesce(l2, F.lit(False)).cast("int")) == 0).alias("blind"), F.countDistinct(F.when(F.col("source") == "stp", F.col("hw_addr"))).alias("roots"))


@query("x05_router_advertisers", "SELECT CASE WHEN count(DISTINCT hw_addr) > 1 THEN 'high' ELSE 'medium' END AS severity, count(DISTINCT hw_addr) AS senders FROM observations WHERE source = 'icmpv6_ra'", VIEWS)
def _(t):
    n = F.countDistinct("hw_addr")
    return observations(t).where("source = 'icmpv6_ra'").agg(F.when(n > 1, "high").otherwise("medium").alias("severity"), n.alias("senders"))


@query("x07_unknown_targets", "SELECT DISTINCT target_ip FROM packets WHERE protocol = 'arp' AND target_ip NOT IN (SELECT ip_addr FROM hosts)")
def _(t):
    known = t.hosts.select(F.col("ip_addr").alias("target_ip"))
    return t.packets.where("protocol = 'arp'").select("target_ip").distinct().join(known, "target_ip", "left_anti")


@query("x09_j21_service_rules", "SELECT rule, severity, devices FROM x_services", VIEWS)
def _(t):
    return X.services(probes(t))


@query("a25_exposure_summary", "SELECT severity, split_part(rule, '-', 1) AS category, count(*) AS n FROM x_all GROUP BY ALL", VIEWS)
def _(t):
    return everything(t).groupBy("severity", F.element_at(F.split("rule", "-"), 1).alias("category")).agg(F.count("*").alias("n"))


def _chain_sql() -> str:
    parts = []
    for chain, severity, needs, mode, env in X.CHAINS:
        arr = "[" + ", ".join(f"'{n}'" for n in needs) + "]"
        test = {"any": f"list_has_any(acting, {arr})", "all": f"list_has_all(acting, {arr})", "custom": f"list_contains(acting, '{needs[0]}') AND list_has_any(acting, {arr}[2:])"}[mode]
        names = {"windows": X.WINDOWS, "ics": X.ICS}.get(env)
        gate = f"list_has_any(every, [{', '.join(repr(n) for n in names)}])" if names else "true"
        parts.append(f"SELECT '{chain}' AS chain, '{severity}' AS severity, list_sort(list_intersect({arr}, acting)) AS triggers FROM ids WHERE {test} AND {gate}")
    return "WITH ids AS (SELECT list(rule) AS every, list(rule) FILTER (severity IN ('medium', 'high', 'critical')) AS acting FROM x_all) " + " UNION ALL ".join(parts)


@query("x10_chains", _chain_sql(), VIEWS)
def _(t):
    return X.chains(everything(t))


_KINDS = ["llmnr", "netbios", "mdns", "dns", "arp", "cdp", "dtp", "stp", "dhcpv4", "dhcp_anomaly", "dhcpv6", "icmpv6_ra", "icmpv6_na", "tls", "ssdp", "probe", None]
_ASKED = ["wpad.corp", "printer.Local.", "www.example.org", "WPAD", None]
FIELD_VIEW = {
    "seen": f"""SELECT hw_addr, user_id, ip_addr, target_ip, op, port, {oracle.pick("packet_id", _KINDS)} AS source, {oracle.pick("user_id", _ASKED)} AS query_name, CASE WHEN user_id % 2 = 0 THEN 769 ELSE 771 END AS version,
  user_id % 6 + 1 AS message, {oracle.pick("user_id", ["plc", "Smart Plug", "router", "phone", None])} AS category, {oracle.pick("user_id", ["bgp", "ssh"])} AS service FROM packets""",
    "routers": "SELECT * FROM seen WHERE category = 'router'",
}
_DEVICES = "count(DISTINCT hw_addr) AS devices FROM seen WHERE"


def field_observations(t):
    """Packets with the fields that the rules read, dealt out by their keys."""
    u = F.col("user_id")
    return t.packets.select(
        "hw_addr", "ip_addr", "target_ip", "op", "port", pick(F.col("packet_id"), _KINDS).alias("source"), pick(u, _ASKED).alias("query_name"),
        pick(u, [769, 771]).alias("tls_version"), (u % 6 + 1).cast("int").alias("message_type"), F.concat(F.lit("10.0.0."), (u % 3).cast("string")).alias("server_id"),
        (u % 8).isin(3, 4).alias("negotiating"), F.concat(F.lit("root-"), (u % 2).cast("string")).alias("root_mac"), (u % 4 == 0).alias("override"),
        pick(u, ["plc", "Smart Plug", "router", "phone", None]).alias("category"), pick(u, ["bgp", "ssh"]).alias("service"),
    )


@query("x01_to_x08_field_rules", f"""SELECT * FROM (
  SELECT 'NR-001' AS rule, 'high' AS severity, {_DEVICES} source = 'llmnr' UNION ALL SELECT 'NR-002', 'high', {_DEVICES} source = 'netbios' UNION ALL SELECT 'NR-003', 'info', {_DEVICES} source = 'mdns'
  UNION ALL SELECT 'NR-004', 'high', {_DEVICES} source IN ('dns', 'netbios') AND user_id % 5 IN (0, 3)
  UNION ALL SELECT 'L2-001', 'medium', {_DEVICES} source = 'arp' HAVING devices >= 25
  UNION ALL SELECT 'L2-003', 'medium', {_DEVICES} source = 'arp' AND op = 2 AND ip_addr = target_ip
  UNION ALL SELECT 'L2-004', 'low', {_DEVICES} source = 'icmpv6_na' AND user_id % 4 = 0 AND user_id % 5 <> 2
  UNION ALL SELECT 'L2-005', 'medium', {_DEVICES} true HAVING devices >= 100
  UNION ALL SELECT 'L2-006', 'info', {_DEVICES} source = 'cdp' UNION ALL SELECT 'L2-007', 'high', {_DEVICES} source = 'dtp' AND user_id % 8 IN (3, 4)
  UNION ALL SELECT 'L2-009', 'high', {_DEVICES} source = 'stp' HAVING count(DISTINCT user_id % 2) >= 2
  UNION ALL SELECT 'DH-001', 'info', {_DEVICES} source = 'dhcpv4' AND message IN (1, 3) UNION ALL SELECT 'DH-002', 'high', {_DEVICES} source = 'dhcp_anomaly'
  UNION ALL SELECT 'DH-003', 'high', {_DEVICES} source = 'dhcpv4' AND message IN (2, 5) HAVING count(DISTINCT user_id % 3) >= 2
  UNION ALL SELECT 'DH-004', 'info', {_DEVICES} source = 'dhcpv6'
  UNION ALL SELECT 'RT-001', CASE WHEN count(DISTINCT hw_addr) > 1 THEN 'high' ELSE 'info' END, {_DEVICES} source = 'icmpv6_ra'
  UNION ALL SELECT 'RT-002', 'high', {_DEVICES} source = 'probe' AND service = 'bgp' UNION ALL SELECT 'RT-003', 'low', count(DISTINCT hw_addr) FROM routers
  UNION ALL SELECT 'TC-001', 'medium', {_DEVICES} source = 'tls' AND version = 769 UNION ALL SELECT 'NI-001', 'low', {_DEVICES} source = 'ssdp'
  UNION ALL SELECT 'NI-002', 'low', {_DEVICES} source = 'dns' AND user_id % 5 IN (0, 1) UNION ALL SELECT 'NI-003', 'info', count(DISTINCT hw_addr) AS devices FROM routers HAVING devices >= 2
  UNION ALL SELECT 'CRED-001', 'high', {_DEVICES} port IN (21, 23, 110, 143, 161) UNION ALL SELECT 'CRED-002', 'info', {_DEVICES} user_id % 5 IN (0, 1)) WHERE devices > 0""", FIELD_VIEW)
def _(t):
    return X.observed(field_observations(t))


@query("x06_plain_http", """SELECT DISTINCT 'TC-002' AS rule, 'medium' AS severity, hw_addr, port FROM packets WHERE k % 3 = 0 AND port NOT IN (443, 8443, 4443) AND user_id % 4 <> 1 AND k % 11 > 0""")
def _(t):
    k = F.col("k")
    stated = F.to_json(F.struct(pick(k, ["http", "ssh", "https"]).alias("service"), F.when(F.col("user_id") % 4 < 2, F.col("user_id") % 4 == 1).alias("tls")))
    return X.plain_http(t.packets.select("hw_addr", "port", F.when(k % 11 > 0, stated).otherwise("{broken").alias("result")))


@query("x03_vlan_leakage", """SELECT 'L2-008' AS rule, 'medium' AS severity, hw_addr, list_sort(list(DISTINCT '10.0.' || (third // 16 * 16) || '.0/20')) AS subnets
  FROM (SELECT hw_addr, k % 4 * CASE WHEN user_id % 2 = 0 THEN 16 ELSE 3 END AS third FROM packets WHERE protocol = 'arp' AND k % 10 > 0) WHERE hw_addr NOT IN (SELECT hw_addr FROM verdicts WHERE category = 'router')
  GROUP BY hw_addr HAVING count(DISTINCT third // 16) > 1""")
def _(t):
    third = F.col("k") % 4 * F.when(F.col("user_id") % 2 == 0, 16).otherwise(3)
    place = F.when(F.col("k") % 10 > 0, F.concat(F.lit("10.0."), third.cast("string"), F.lit(".7"))).otherwise("0.0.0.0")
    return X.vlan_leakage(t.packets.where("protocol = 'arp'").select("hw_addr", place.alias("ip_addr")), t.verdicts.select("hw_addr", "category"))
