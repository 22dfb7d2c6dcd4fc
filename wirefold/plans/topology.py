"""Topology graph queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import topology as G
from ..sources.adapters import pick
from ..sources.shared import written
from . import oracle
from .base import query

_BIND = [("10.0.0.1", "00:1a:2b:00:00:04"), ("10.0.1.2", "00:1a:2b:00:00:06")]
_OVER = [("00:1a:2b:00:00:07", "00:1a:2b:00:00:06"), ("d2:1a:2b:00:00:05", "00:1a:2b:00:00:04")]
_INFRA = ", ".join(f"'{x}'" for x in G.INFRASTRUCTURE)
VIEWS = {
    "g_devices": "SELECT hw_addr, ip_addr, category FROM hosts LEFT JOIN verdicts USING (hw_addr)",
    "g_every": f"""SELECT hw_addr, 1 AS tier FROM g_devices WHERE hw_addr IN (SELECT mac FROM {oracle.values(_BIND, "b(ip, mac)")}) UNION ALL SELECT hw_addr, 2 FROM g_devices WHERE category IN ('router', 'gateway', 'firewall')
      UNION ALL SELECT hw_addr, 3 FROM g_devices WHERE regexp_matches(ip_addr, '\\.[12]$')""",
    "g_gates": "SELECT DISTINCT hw_addr, tier FROM g_every WHERE tier = (SELECT min(tier) FROM g_every)",
    "g_nodes": f"""SELECT d.hw_addr, d.ip_addr, CASE WHEN g.hw_addr IS NOT NULL THEN 'gateway' WHEN category IN ({_INFRA}) THEN 'infrastructure' ELSE 'client' END AS tier, regexp_replace(d.ip_addr, '[0-9]+$', '0/24') AS subnet
      FROM g_devices d LEFT JOIN g_gates g USING (hw_addr) WHERE d.ip_addr IS NOT NULL""",
    "g_links": "SELECT DISTINCT hw_addr AS a, before AS b FROM (SELECT *, lag(hw_addr) OVER (PARTITION BY ip_addr ORDER BY us, packet_id) AS before FROM packets WHERE protocol = 'arp' AND k < 20) WHERE before IS NOT NULL",
}
#: The same views with the links of every ARP packet.
EVERY = VIEWS | {"g_links": VIEWS["g_links"].replace(" AND k < 20", "")}


def devices(t):
    return t.hosts.select("hw_addr", "ip_addr").join(t.verdicts.select("hw_addr", "category"), "hw_addr", "left")


def bindings(t):
    return t.spark.createDataFrame(_BIND, "ip string, mac string")


def links(t, which="k < 20"):
    w = Window.partitionBy("ip_addr").orderBy("us", "packet_id")
    return t.packets.where("protocol = 'arp'").where(which).select(F.col("hw_addr").alias("a"), F.lag("hw_addr").over(w).alias("b")).where("b IS NOT NULL").distinct()


@query("g01_gateways", "SELECT hw_addr, tier FROM g_gates", VIEWS)
def _(t):
    return G.gateways(devices(t), bindings(t))


@query("g02_nodes", "SELECT hw_addr, ip_addr, tier, subnet FROM g_nodes", VIEWS)
def _(t):
    return G.nodes(devices(t), bindings(t))


_EDGES = f"""WITH up AS (SELECT coalesce(l.g, (SELECT min(hw_addr) FROM g_nodes WHERE tier = 'gateway')) AS source, n.hw_addr AS target, CASE WHEN tier = 'client' THEN 'client' ELSE 'trunk' END AS kind, 3 AS rank
    FROM g_nodes n LEFT JOIN (SELECT subnet, min(hw_addr) AS g FROM g_nodes WHERE tier = 'gateway' GROUP BY subnet) l USING (subnet) WHERE tier <> 'gateway'),
  near AS (SELECT DISTINCT least(a, b) AS source, greatest(a, b) AS target, 'lldp' AS kind, 2 AS rank FROM g_links WHERE a <> b),
  manual AS (SELECT parent AS source, mac AS target, 'manual' AS kind, 1 AS rank FROM {oracle.values(_OVER, "o(mac, parent)")}),
  every AS (SELECT * FROM (FROM up UNION ALL FROM near) WHERE target NOT IN (SELECT target FROM manual) UNION ALL FROM manual)
  SELECT source, target, kind FROM (SELECT *, row_number() OVER (PARTITION BY least(source, target), greatest(source, target) ORDER BY rank, source) AS n FROM every WHERE source IS NOT NULL) WHERE n = 1"""


@query("g03_edges", _EDGES, VIEWS)
def _(t):
    over = t.spark.createDataFrame(_OVER, "hw_addr string, parent string")
    return G.edges(G.nodes(devices(t), bindings(t)), links(t), over)


@query("g03_edges_all", _EDGES, EVERY)
def _(t):
    over = t.spark.createDataFrame(_OVER, "hw_addr string, parent string")
    return G.edges(G.nodes(devices(t), bindings(t)), links(t, "true"), over)


@query("g04_neighbours", "SELECT a, b, count(*) OVER (PARTITION BY a) AS degree FROM g_links", VIEWS)
def _(t):
    return links(t).withColumn("degree", F.count("*").over(Window.partitionBy("a")))


@query("g04_neighbours_all", "SELECT a, b, count(*) OVER (PARTITION BY a) AS degree FROM g_links", EVERY)
def _(t):
    return links(t, "true").withColumn("degree", F.count("*").over(Window.partitionBy("a")))


@query("j23_vm_host_pairs", """SELECT v.hw_addr AS vm, arg_min(h.hw_addr, h.hw_addr) AS host FROM g_nodes v JOIN g_nodes h ON v.subnet = h.subnet WHERE v.hw_addr LIKE 'd2%' AND h.hw_addr NOT LIKE 'd2%' GROUP BY v.hw_addr""", VIEWS)
def _(t):
    n = G.nodes(devices(t), bindings(t))
    host = n.where(~F.col("hw_addr").startswith("d2")).groupBy("subnet").agg(F.min("hw_addr").alias("host"))
    return n.where(F.col("hw_addr").startswith("d2")).join(host, "subnet").select(F.col("hw_addr").alias("vm"), "host")


# The devices table as a network: types, links and connections by the customer's key.
_KINDS = ["switch", "phone", "access_point", "computer", "printer", "nas", "server", "phone", "camera", "laptop", "tablet"]
_CONNECTED = ["wired", "wireless", None]
_GRAPH = {
    "n_devices": f"""SELECT CASE WHEN custkey % 13 = 0 THEN '00:0c:29' || substr(mac, 9) ELSE mac END AS hw_addr, custkey, '10.1.' || (custkey % 40) || '.' || (custkey % 150 + 3) AS ip_addr,
      CASE WHEN custkey % 41 = 7 THEN 'router' WHEN custkey % 7 < 2 THEN list_extract([{', '.join(map(oracle.literal, _KINDS))}], (custkey // 7 % 11 + 1)::INT) ELSE 'phone' END AS type,
      list_extract(['wired', 'wireless', NULL], (custkey // 3 % 3 + 1)::INT) AS connection, coalesce(h.packets, 0) + custkey % 5 AS volume FROM devices d LEFT JOIN (SELECT hw_addr, count(*) AS packets FROM packets GROUP BY hw_addr) h ON h.hw_addr = d.mac""",
    "n_every": """SELECT *, type IN ('access_point', 'router', 'switch') AS infra, regexp_replace(ip_addr, '[0-9]+$', '0/24') AS subnet, CASE WHEN hw_addr IN (SELECT hw_addr FROM n_devices WHERE custkey IN (5, 48)) THEN 1 WHEN type = 'router' THEN 2 WHEN regexp_matches(ip_addr, '\\.[12]$') THEN 3 END AS rank,
      ('0x' || substr(md5(hw_addr), 1, 8))::BIGINT AS dealt FROM n_devices""",
    "n_tiers": """SELECT *, CASE WHEN gate THEN 'gateway' WHEN infra THEN 'infrastructure' ELSE 'client' END AS tier FROM (SELECT *, CASE WHEN (SELECT bool_or(NOT infra) FROM n_every WHERE rank = (SELECT min(rank) FROM n_every)) AND (SELECT bool_or(infra) FROM n_every)
      THEN (coalesce(rank, 9) = (SELECT min(rank) FROM n_every) AND infra) OR type = 'router' ELSE coalesce(rank, 9) = (SELECT min(rank) FROM n_every) END AS gate FROM n_every)""",
    "n_core": "SELECT arg_max(hw_addr, (volume, translate(hw_addr, '0123456789abcdef', 'fedcba9876543210'))) AS core FROM n_tiers WHERE tier = 'infrastructure' AND type = 'switch'",
    "n_points": "SELECT hw_addr, subnet, row_number() OVER (ORDER BY hw_addr) - 1 AS i, row_number() OVER (PARTITION BY subnet ORDER BY hw_addr) - 1 AS j, count(*) OVER () AS n, count(*) OVER (PARTITION BY subnet) AS m FROM n_tiers WHERE tier = 'infrastructure' AND type = 'access_point'",
    "n_switches": "SELECT hw_addr, row_number() OVER (ORDER BY hw_addr) - 1 AS i, count(*) OVER () AS n FROM n_tiers WHERE tier = 'infrastructure' AND type = 'switch'",
    "n_links": "SELECT DISTINCT least(a.hw_addr, b.hw_addr) AS source, greatest(a.hw_addr, b.hw_addr) AS target, CASE WHEN a.hw_addr < b.hw_addr THEN a.tier ELSE b.tier END AS s, CASE WHEN a.hw_addr < b.hw_addr THEN b.tier ELSE a.tier END AS t FROM n_tiers a JOIN n_tiers b ON b.custkey = a.custkey + 7 WHERE a.custkey % 9 = 0",
    "n_trunk": "SELECT hw_addr AS source, core AS target FROM n_tiers, n_core WHERE tier = 'gateway' UNION ALL SELECT core, hw_addr FROM n_tiers, n_core WHERE tier = 'infrastructure' AND hw_addr <> core",
    "n_free": f"""SELECT c.hw_addr, c.subnet, c.dealt, coalesce(c.connection, 'unknown') AS connection, CASE WHEN substr(c.hw_addr, 1, 8) = '00:0c:29' THEN (SELECT min(h.hw_addr) FROM n_tiers h WHERE h.subnet = c.subnet AND h.tier = 'client' AND substr(h.hw_addr, 1, 8) <> '00:0c:29' AND h.type IN ({', '.join(map(oracle.literal, G.COMPUTERS))})) END AS host
      FROM n_tiers c WHERE tier = 'client' AND hw_addr NOT IN (SELECT source FROM n_links WHERE t = 'infrastructure' UNION ALL SELECT target FROM n_links WHERE s = 'infrastructure')""",
    "n_edges": """SELECT 'internet' AS source, hw_addr AS target, 'wan' AS kind FROM n_tiers WHERE tier = 'gateway' UNION ALL SELECT source, target, 'trunk' FROM n_trunk
      UNION ALL SELECT source, target, 'lldp' FROM n_links WHERE (source, target) NOT IN (SELECT least(source, target), greatest(source, target) FROM n_trunk)
      UNION ALL SELECT CASE WHEN f.host IS NOT NULL THEN f.host WHEN connection <> 'wired' THEN coalesce(p.hw_addr, q.hw_addr) ELSE w.hw_addr END, f.hw_addr, CASE WHEN f.host IS NOT NULL THEN 'vm' WHEN connection <> 'wired' THEN 'wireless' ELSE 'client' END
        FROM n_free f LEFT JOIN n_points p ON p.subnet = f.subnet AND p.j = f.dealt % p.m LEFT JOIN n_points q ON q.i = f.dealt % q.n LEFT JOIN n_switches w ON w.i = f.dealt % w.n""",
    "n_manual": "SELECT CASE WHEN a.custkey % 200 = 3 THEN 'internet' ELSE b.hw_addr END AS source, a.hw_addr AS target, 'manual' AS kind FROM n_devices a JOIN n_devices b ON b.custkey = a.custkey - 2 WHERE a.custkey % 100 = 3",
}


def _network(t) -> G.Graph:
    k = F.col("custkey")
    mac = F.when(k % 13 == 0, F.concat(F.lit("00:0c:29"), F.substring("mac", 9, 20))).otherwise(F.col("mac"))
    kind = F.when(k % 41 == 7, "router").when(k % 7 < 2, pick(F.floor(k / 7), _KINDS)).otherwise("phone")
    volume = t.packets.groupBy(F.col("hw_addr").alias("mac")).agg(F.count("*").alias("_n"))
    place = F.concat(F.lit("10.1."), (k % 40).cast("string"), F.lit("."), (k % 150 + 3).cast("string"))
    d = t.devices.select("mac", "custkey").join(volume, "mac", "left").select(mac.alias("hw_addr"), "custkey", place.alias("ip_addr"), kind.alias("type"), pick(F.floor(k / 3), _CONNECTED).alias("connection"), (F.coalesce("_n", F.lit(0)) + k % 5).alias("volume"))
    d = written(d, "devices")
    at = lambda step: d.select((k - step).alias("custkey"), F.col("hw_addr").alias("b"))
    links = d.where(k % 9 == 0).select("custkey", F.col("hw_addr").alias("a")).join(at(7), "custkey").select("a", "b")
    over = d.where(k % 100 == 3).select("custkey", "hw_addr").join(at(-2), "custkey").select("hw_addr", F.when(k % 200 == 3, G.INTERNET).otherwise(F.col("b")).alias("parent"))
    return G.Graph(d, d.where(k.isin(5, 48)).select(F.col("hw_addr").alias("mac")), links, over)


@query("g03_graph_edges", "SELECT * FROM n_edges WHERE target NOT IN (SELECT target FROM n_manual) UNION ALL SELECT source, target, kind FROM n_manual", _GRAPH)
def _(t):
    return _network(t).edges()


@query("g02_graph_nodes", "SELECT hw_addr, ip_addr, tier, subnet, hw_addr = core AS core FROM n_tiers, n_core", _GRAPH)
def _(t):
    return _network(t).nodes.select("hw_addr", "ip_addr", "tier", "subnet", "core")
