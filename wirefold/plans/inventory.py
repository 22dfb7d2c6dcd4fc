"""Filters, joins, sorts, pages and set operations over the inventory."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import ip, mac
from ..operators import fusion, identity, inventory, lookups, patterns
from ..sources import adapters as A
from . import oracle
from .base import DAY, HOUR, query

_LIST = ["hw_addr", "ip_addr", "last_us", "vendor", "category", "platform", "hostname", "certainty", "owner", "criticality"]
_JOINED = """
  SELECT h.*, v.vendor, v.category, v.platform, v.model, coalesce(v.certainty, NULL) AS certainty, coalesce(v.hostname, d.hostname) AS hostname,
         d.owner, d.location, d.criticality, d."authorization", d.tags, d.is_online
  FROM hosts h LEFT JOIN verdicts v USING (hw_addr) LEFT JOIN devices d ON d.mac = h.hw_addr"""
VIEWS = {"device_list": _JOINED}
_IPKEY = "list_aggregate([(split_part(ip_addr, '.', i)::BIGINT) * (256 ** (4 - i))::BIGINT for i in [1, 2, 3, 4]], 'sum')::BIGINT"
_RANK = "CASE criticality WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END"


def listing(t):
    v = t.verdicts.select("hw_addr", "vendor", "category", "platform", "model", "hostname", "certainty")
    return inventory.joined(t.hosts, v, t.devices)


@query("s04_table_scans", """SELECT 'devices' AS name, count(*) AS n FROM devices UNION ALL SELECT 'findings', count(*) FROM findings
  UNION ALL SELECT 'hosts', count(*) FROM hosts UNION ALL SELECT 'packets', count(*) FROM packets UNION ALL SELECT 'evidence', count(*) FROM evidence""")
def _(t):
    parts = [getattr(t, n).agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n") for n in ("devices", "findings", "hosts", "packets", "evidence")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("s05_point_lookup", "SELECT mac, owner, location FROM devices WHERE custkey = 7")
def _(t):
    return t.devices.where("custkey = 7").select("mac", "owner", "location")


@query("f01_unicast_filter", "SELECT packet_id, hw_addr FROM packets WHERE regexp_matches(hw_addr, '^[0-9a-f]{2}(:[0-9a-f]{2}){5}$') AND hw_addr NOT IN ('ff:ff:ff:ff:ff:ff', '00:00:00:00:00:00')")
def _(t):
    return t.packets.where(mac.unicast(F.col("hw_addr"))).select("packet_id", "hw_addr")


@query("f02_dynamic_filter", "SELECT hw_addr, vendor, category, certainty FROM device_list WHERE disposition = 'known' AND coalesce(certainty, 0) >= 40", VIEWS)
def _(t):
    return inventory.filtered(listing(t), {"disposition": "known"}, least_certainty=40).select("hw_addr", "vendor", "category", "certainty")


@query("f03_search", "SELECT hw_addr, vendor, hostname FROM device_list WHERE hw_addr ILIKE '%1a%' AND (vendor ILIKE '%APP%' OR hostname ILIKE '%APP%' OR ip_addr ILIKE '%APP%')", VIEWS)
def _(t):
    return inventory.search(listing(t).where(F.col("hw_addr").contains("1a")), "APP", ["vendor", "hostname", "ip_addr"]).select("hw_addr", "vendor", "hostname")


@query("f04_tag_filter", "SELECT mac, tags FROM devices WHERE list_contains(tags, 'prod')")
def _(t):
    return t.devices.where(F.array_contains("tags", "prod")).select("mac", "tags")


@query("f05_tristate_filter", """SELECT mac, is_online FROM devices WHERE coalesce("authorization", 'unapproved') = 'unapproved' AND coalesce(is_online, true)""")
def _(t):
    return inventory.filtered(t.devices, authorization="unapproved", online=True).select("mac", "is_online")


@query("f06_interface_semi_join", "SELECT hw_addr, ip_addr FROM hosts WHERE hw_addr IN (SELECT hw_addr FROM packets WHERE interface = 'eth1')")
def _(t):
    return t.hosts.join(t.packets.where("interface = 'eth1'").select("hw_addr"), "hw_addr", "left_semi").select("hw_addr", "ip_addr")


_ACTIVE = "NOT resolved AND (status <> 'snoozed' OR snoozed_until <= (SELECT max(us) FROM packets))"


def active(t):
    return t.findings.where(~F.col("resolved") & ((F.col("status") != "snoozed") | (F.col("snoozed_until") <= t.now)))


@query("f07_active_findings", f"SELECT id, rule, status FROM findings WHERE {_ACTIVE}")
def _(t):
    return active(t).select("id", "rule", "status")


_SUPPRESS = [("00:1a:2b:00:00:01", None, None), (None, "10.0.1.2", "arp"), (None, None, "tcp_syn"), ("d2:1a:2b:00:00:05", "10.0.0.1", None)]


@query("f08_suppression_rules", f"""SELECT packet_id FROM packets p WHERE NOT EXISTS (SELECT 1 FROM {oracle.values(_SUPPRESS, "r(mac, ip, subtype)")}
  WHERE (mac IS NULL OR mac = hw_addr) AND (ip IS NULL OR ip = ip_addr) AND (subtype IS NULL OR subtype = protocol))""")
def _(t):
    rules = F.broadcast(t.spark.createDataFrame(_SUPPRESS, "mac string, ip string, subtype string"))  # a fixed configuration table
    met = (F.col("mac").isNull() | (F.col("mac") == F.col("hw_addr"))) & (F.col("ip").isNull() | (F.col("ip") == F.col("ip_addr")))
    met = met & (F.col("subtype").isNull() | (F.col("subtype") == F.col("protocol")))
    return t.packets.join(rules, met, "left_anti").select("packet_id")


_EXCLUDE = [("10.0.1.2", None), (None, "d2:1a:2b:00:00:0a")]


@query("f09_exclusion_flag", f"""SELECT hw_addr, EXISTS (SELECT 1 FROM {oracle.values(_EXCLUDE, "x(ip, mac)")} WHERE ip = ip_addr OR mac = hw_addr) AS excluded FROM hosts""")
def _(t):
    x = F.broadcast(t.spark.createDataFrame(_EXCLUDE, "x_ip string, x_mac string"))  # a fixed configuration table
    met = t.hosts.join(x, (F.col("x_ip") == F.col("ip_addr")) | (F.col("x_mac") == F.col("hw_addr")), "left")
    return met.groupBy("hw_addr").agg(F.coalesce(F.bool_or(F.col("x_ip").isNotNull() | F.col("x_mac").isNotNull()), F.lit(False)).alias("excluded"))


@query("f10_rule_prefix_filter", "SELECT rule, count(*) AS n FROM findings WHERE NOT starts_with(rule, 'mac') GROUP BY rule")
def _(t):
    return t.findings.where(~F.col("rule").startswith("mac")).groupBy("rule").agg(F.count("*").alias("n"))


@query("f11_relative_time", f"SELECT packet_id, us FROM packets WHERE us > (SELECT max(us) FROM packets) - {24 * HOUR}")
def _(t):
    return t.packets.where(F.col("us") > t.now - F.lit(24 * HOUR)).select("packet_id", "us")


@query("f12_private_ip", "SELECT ip_addr, count(*) AS n, bool_and(ip_addr LIKE '10.%') AS private FROM packets GROUP BY ip_addr")
def _(t):
    return t.packets.groupBy("ip_addr").agg(F.count("*").alias("n"), F.bool_and(ip.private(F.col("ip_addr"))).alias("private"))


@query("f13_pushed_predicate", "SELECT event_id, event_type FROM events WHERE event_type IN ('click', 'error') AND user_id < 20")
def _(t):
    return t.raw("events").where(F.col("event_type").isin("click", "error") & (F.col("user_id") < 20)).select("event_id", "event_type")


_INDEX = [("os", 1, "Windows", "windows"), ("os", 2, "iPhone|Mac OS", "apple"), ("tool", 1, "curl", "curl"), ("os", 3, "Linux", "linux")]


@query("f14_category_regex", f"""SELECT k, arg_min(label, priority) AS label FROM (SELECT DISTINCT k, user_agent FROM packets) p
  JOIN {oracle.values(_INDEX, "i(category, priority, pattern, label)")} ON category = 'os' AND regexp_matches(user_agent, pattern) GROUP BY k""")
def _(t):
    rules = t.spark.createDataFrame(_INDEX, "category string, priority int, pattern string, label string").where("category = 'os'")
    met = patterns.matches(t.packets.select("k", "user_agent").distinct(), "user_agent", rules, lookups.bounded)
    return met.groupBy("k").agg(F.min_by("label", "priority").alias("label"))


@query("j01_device_list", f"SELECT {', '.join(_LIST)} FROM device_list", VIEWS)
def _(t):
    return listing(t).select(*_LIST)


@query("j02_hosts_full_devices", """SELECT coalesce(h.hw_addr, d.mac) AS mac, h.last_us AS last_us, coalesce(d.is_online, true) AS is_online, d.mac IS NULL AS missing
  FROM hosts h FULL JOIN devices d ON h.hw_addr = d.mac""")
def _(t):
    met = t.hosts.join(t.devices, F.col("hw_addr") == F.col("mac"), "full_outer")
    return met.select(F.coalesce("hw_addr", "mac").alias("mac"), "last_us", F.coalesce("is_online", F.lit(True)).alias("is_online"), F.col("mac").isNull().alias("missing"))


@query("j03_u02_union_of_left_joins", """SELECT coalesce(h.hw_addr, d.mac) AS mac, h.last_us AS last_us FROM hosts h LEFT JOIN devices d ON h.hw_addr = d.mac
  UNION SELECT d.mac, h.last_us FROM devices d LEFT JOIN hosts h ON h.hw_addr = d.mac""")
def _(t):
    a = t.hosts.join(t.devices, F.col("hw_addr") == F.col("mac"), "left").select(F.coalesce("hw_addr", "mac").alias("mac"), "last_us")
    b = t.devices.join(t.hosts, F.col("hw_addr") == F.col("mac"), "left").select("mac", "last_us")
    return a.union(b).distinct()


@query("j04_devices_on_interface", "SELECT DISTINCT d.mac, d.owner FROM devices d JOIN packets p ON p.hw_addr = d.mac WHERE p.interface = 'eth0'")
def _(t):
    return t.devices.join(t.packets.where("interface = 'eth0'").select(F.col("hw_addr").alias("mac")), "mac", "left_semi").select("mac", "owner").distinct()


@query("j05_only_passive_hosts", "SELECT hw_addr FROM hosts WHERE hw_addr NOT IN (SELECT hw_addr FROM packets WHERE protocol NOT IN ('arp', 'dns', 'mdns') AND k < 12)")
def _(t):
    seen = t.packets.where(~F.col("protocol").isin("arp", "dns", "mdns") & (F.col("k") < 12)).select("hw_addr")
    return t.hosts.join(seen, "hw_addr", "left_anti").select("hw_addr")


@query("j06_ip_conflicts", f"""SELECT a.hw_addr, a.ip_addr, count(*) AS others FROM hosts a JOIN hosts b ON a.ip_addr = b.ip_addr AND a.hw_addr <> b.hw_addr
  WHERE b.last_us > (SELECT max(us) FROM packets) - {DAY} GROUP BY ALL""")
def _(t):
    # Counts per address instead of the self join's pairs.
    fresh = (F.col("last_us") > t.now - F.lit(DAY)).cast("int")
    h = t.hosts.select("hw_addr", "ip_addr", fresh.alias("fresh"))
    per = h.groupBy("ip_addr").agg(F.sum("fresh").alias("all"))
    return h.join(per, "ip_addr").select("hw_addr", "ip_addr", (F.col("all") - F.col("fresh")).alias("others")).where("others > 0")


@query("j07_hostname_collisions", """SELECT hostname, hw_addr FROM (SELECT *, row_number() OVER (PARTITION BY hostname ORDER BY us DESC, hw_addr) AS n, count(*) OVER (PARTITION BY hostname) AS c
  FROM verdicts WHERE hostname IS NOT NULL) WHERE c > 1 AND n <= 5""")
def _(t):
    w = Window.partitionBy("hostname")
    v = t.verdicts.where("hostname IS NOT NULL").select("hostname", "hw_addr", F.row_number().over(w.orderBy(F.col("us").desc(), "hw_addr")).alias("n"), F.count("*").over(w).alias("c"))
    return v.where("c > 1 AND n <= 5").select("hostname", "hw_addr")


@query("j08_identity_rollup", """SELECT location, count(*) AS macs, string_agg(mac, ',' ORDER BY mac) FILTER (custkey < 60) AS some, arg_min(owner, custkey) AS first_owner FROM devices GROUP BY location""")
def _(t):
    d = t.devices.groupBy("location").agg(
        F.count("*").alias("macs"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("custkey") < 60, F.col("mac")))), ",").alias("some"),
        F.min_by("owner", "custkey").alias("first_owner"),
    )
    return d.withColumn("some", F.nullif("some", F.lit("")))


_SIGNALS = identity.SIGNALS


@query("j09_signal_similarity", f"""WITH s AS (SELECT hw_addr, last_us, hostname, opt60, opt55, query_name, service FROM (SELECT p.*, max(us) OVER (PARTITION BY hw_addr) AS last_us,
    row_number() OVER (PARTITION BY hw_addr ORDER BY us DESC, packet_id DESC) AS n FROM packets p) WHERE n = 1),
  x AS (SELECT a.hw_addr, b.hw_addr AS other, round({' + '.join(f"CASE WHEN a.{k} = b.{k} THEN {v} ELSE 0 END" for k, v in _SIGNALS.items())}, 6)::DOUBLE AS score
    FROM s a JOIN s b ON a.hw_addr <> b.hw_addr WHERE a.hw_addr LIKE 'd2%' AND b.hw_addr NOT LIKE 'd2%')
  SELECT hw_addr, arg_max(other, (score, other)) AS identity, max(score) AS score FROM x GROUP BY hw_addr HAVING max(score) >= 0.4""")
def _(t):
    s = inventory.latest(t.packets, ["hw_addr"], [F.col("us").desc(), F.col("packet_id").desc()]).select("hw_addr", *_SIGNALS)
    return identity.most_similar(s.where(mac.randomized(F.col("hw_addr"))), s.where(~mac.randomized(F.col("hw_addr"))))


_OVERRIDES = [("00:1a:2b:00:00:01", "Acme", ""), ("00:1a:2b:00:00:02", "", "camera"), ("d2:1a:2b:00:00:05", "Own", "plug")]


@query("j22_overrides", f"""SELECT v.hw_addr, coalesce(nullif(o.vendor, ''), v.vendor) AS vendor, coalesce(nullif(o.category, ''), v.category) AS category
  FROM verdicts v LEFT JOIN {oracle.values(_OVERRIDES, "o(hw_addr, vendor, category)")} USING (hw_addr)""")
def _(t):
    o = t.spark.createDataFrame(_OVERRIDES, "hw_addr string, vendor string, category string")
    return inventory.overridden(t.verdicts.select("hw_addr", "vendor", "category"), o, ["vendor", "category"])


_KNOWN = ["arp", "dhcpv4", "dns", "lldp", "mdns", "ssdp", "tcp_syn", "tls"]


@query("j24_capture_coverage", f"""SELECT name, count(p.packet_id) AS n, CASE WHEN count(p.packet_id) > 0 THEN 'observed' ELSE 'not_observed' END AS state
  FROM {oracle.values([(x,) for x in _KNOWN], "s(name)")} LEFT JOIN packets p ON p.protocol = name GROUP BY name""")
def _(t):
    s = t.spark.createDataFrame([(x,) for x in _KNOWN], "name string")
    n = t.packets.groupBy(F.col("protocol").alias("name")).agg(F.count("*").alias("n"))
    return s.join(n, "name", "left").select("name", F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("n") > 0, "observed").otherwise("not_observed").alias("state"))


@query("o01_sorted_page", "SELECT hw_addr, certainty FROM device_list ORDER BY certainty DESC NULLS LAST, hw_addr LIMIT 25", VIEWS)
def _(t):
    return inventory.page(listing(t), inventory.ordered(None, "certainty"), 1, 25).select("hw_addr", "certainty")


@query("o02_ip_sort", f"SELECT hw_addr, ip_addr, {_IPKEY} AS key FROM hosts ORDER BY key, hw_addr")
def _(t):
    return t.hosts.select("hw_addr", "ip_addr", ip.to_number(F.col("ip_addr")).alias("key")).orderBy("key", "hw_addr")


@query("o03_criticality_rank", f"SELECT mac, {_RANK} AS rank FROM devices ORDER BY rank DESC, mac")
def _(t):
    return t.devices.select("mac", inventory.criticality_rank(F.col("criticality")).alias("rank")).orderBy(F.col("rank").desc(), "mac")


@query("o04_offset_page", "SELECT hw_addr, last_us FROM device_list ORDER BY last_us DESC NULLS LAST, hw_addr LIMIT 20 OFFSET 40", VIEWS)
def _(t):
    return inventory.page(listing(t), inventory.ordered(None, "last_seen"), 3, 20).select("hw_addr", "last_us")


@query("o05_top_k", "SELECT query_name, count(*) AS n FROM packets WHERE protocol = 'dns' GROUP BY query_name ORDER BY n DESC, query_name LIMIT 5")
def _(t):
    return t.packets.where("protocol = 'dns'").groupBy("query_name").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "query_name").limit(5)


_CLASS = "CASE WHEN rule IN ('mac_spoofing', 'addr_conflict') THEN 'threat' WHEN rule IN ('identity_shift', 'low_certainty') THEN 'suspicious' ELSE 'informational' END"


@query("o06_severity_sort", f"""SELECT hw_addr, rule, n, class FROM (SELECT hw_addr, rule, count(*) AS n, {_CLASS} AS class FROM findings GROUP BY hw_addr, rule)
  ORDER BY CASE class WHEN 'threat' THEN 0 WHEN 'suspicious' THEN 1 ELSE 2 END, n DESC, hw_addr, rule LIMIT 50""")
def _(t):
    g = t.findings.groupBy("hw_addr", "rule").agg(F.count("*").alias("n")).withColumn("class", F.expr(_CLASS))
    rank = F.when(F.col("class") == "threat", 0).when(F.col("class") == "suspicious", 1).otherwise(2)
    return g.orderBy(rank, F.col("n").desc(), "hw_addr", "rule").limit(50)


@query("o07_small_first", "SELECT source, n, row_number() OVER (ORDER BY vendors > 1, n, source) AS place FROM (SELECT source, count(*) AS n, count(DISTINCT vendor) AS vendors FROM evidence GROUP BY source)")
def _(t):
    # One row a source: those of a single vendor first, then the smaller ones.
    f = t.evidence.groupBy("source").agg(F.count("*").alias("n"), F.countDistinct("vendor").alias("vendors"))
    return f.select("source", "n", F.row_number().over(Window.orderBy(F.col("vendors") > 1, "n", "source")).alias("place"))


_PLUGINS = [("http", 1, 80), ("ssh", 2, 22), ("tls", 3, 443), ("dns", 4, 53), ("generic", 5, 0)]


@query("o08_port_affinity", f"""SELECT p.port, name, row_number() OVER (PARTITION BY p.port ORDER BY (x.port = p.port) DESC, position) AS place
  FROM (SELECT DISTINCT port FROM packets) p, {oracle.values(_PLUGINS, "x(name, position, port)")}""")
def _(t):
    x = F.broadcast(t.spark.createDataFrame(_PLUGINS, "name string, position int, own int"))  # the fixed list of plug-ins
    p = t.packets.select("port").distinct().join(x, F.lit(True))
    return p.select("port", "name", F.row_number().over(Window.partitionBy("port").orderBy((F.col("own") == F.col("port")).desc(), "position")).alias("place"))


@query("u01_timeline", """SELECT * FROM (SELECT hw_addr, discovered_us AS us, 'first_seen' AS kind, ip_addr AS detail FROM hosts
  UNION ALL SELECT hw_addr, us, 'observation', protocol FROM packets UNION ALL SELECT hw_addr, us, 'classification', coalesce(category, 'unknown') FROM verdicts
  UNION ALL SELECT hw_addr, us, 'ip_change', ip_addr FROM (SELECT *, lag(ip_addr) OVER (PARTITION BY hw_addr ORDER BY us, packet_id) AS before FROM packets) WHERE before <> ip_addr
  UNION ALL SELECT hw_addr, us, 'finding', rule FROM findings) ORDER BY us DESC, hw_addr, kind, detail LIMIT 200""")
def _(t):
    w = Window.partitionBy("hw_addr").orderBy("us", "packet_id")
    moved = t.packets.withColumn("_before", F.lag("ip_addr").over(w)).where("_before <> ip_addr")
    parts = [
        t.hosts.select("hw_addr", F.col("discovered_us").alias("us"), F.lit("first_seen").alias("kind"), F.col("ip_addr").alias("detail")),
        t.packets.select("hw_addr", "us", F.lit("observation").alias("kind"), F.col("protocol").alias("detail")),
        t.verdicts.select("hw_addr", "us", F.lit("classification").alias("kind"), F.coalesce("category", F.lit("unknown")).alias("detail")),
        moved.select("hw_addr", "us", F.lit("ip_change").alias("kind"), F.col("ip_addr").alias("detail")),
        t.findings.select("hw_addr", "us", F.lit("finding").alias("kind"), F.col("rule").alias("detail")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy(F.col("us").desc(), "hw_addr", "kind", "detail").limit(200)


@query("u03_service_dedup", """SELECT hw_addr, service, packet_id FROM (SELECT *, row_number() OVER (PARTITION BY hw_addr, service ORDER BY us, packet_id) AS n FROM packets WHERE service IS NOT NULL) WHERE n = 1""")
def _(t):
    return inventory.latest(t.packets.where("service IS NOT NULL"), ["hw_addr", "service"], [F.col("us"), F.col("packet_id")]).select("hw_addr", "service", "packet_id")


@query("u04_rule_sets", """SELECT hw_addr, len(list_filter(rs, lambda x: x IN ('mac_spoofing', 'addr_conflict'))) = 2 AS every, len(list_filter(rs, lambda x: x IN ('mac_spoofing', 'addr_conflict'))) > 0 AS some,
  len(list_filter(rs, lambda x: x NOT IN ('mac_spoofing', 'addr_conflict'))) AS others FROM (SELECT hw_addr, list(DISTINCT rule) AS rs FROM findings GROUP BY hw_addr)""")
def _(t):
    want = F.array(F.lit("mac_spoofing"), F.lit("addr_conflict"))
    g = t.findings.groupBy("hw_addr").agg(F.collect_set("rule").alias("rs"))
    return g.select("hw_addr", (F.size(F.array_except(want, "rs")) == 0).alias("every"), F.arrays_overlap(want, "rs").alias("some"), F.size(F.array_except("rs", want)).alias("others"))


_V = ", ".join(["hw_addr", *fusion.FIELDS, "certainty", "evidence"])


@query("v05_verdict", f"SELECT {_V} FROM verdicts")
def _(t):
    return t.verdicts.select("hw_addr", *fusion.FIELDS, "certainty", "evidence")


@query("v01_evidence_cap", "SELECT id, hw_addr, source FROM ev_capped")
def _(t):
    return fusion.capped(t.evidence).select("id", "hw_addr", "source")


@query("v02_source_weight", "SELECT source, weight, count(*) AS n FROM ev_weighted GROUP BY ALL")
def _(t):
    return fusion.weighted(fusion.capped(t.evidence), fusion.weight_table(t.spark)).groupBy("source", "weight").agg(F.count("*").alias("n"))


@query("v03_field_fusion", "SELECT hw_addr, field, value, score FROM ev_plain")
def _(t):
    rows = fusion.weighted(fusion.capped(t.evidence), fusion.weight_table(t.spark))
    return fusion.winners(fusion.candidates(rows, [f for f in fusion.FIELDS if f != "category"]))


@query("v04_category_demotion", "SELECT hw_addr, value AS category, score FROM ev_category")
def _(t):
    rows = fusion.weighted(fusion.capped(t.evidence), fusion.weight_table(t.spark))
    return fusion.fused(rows).where("category IS NOT NULL").select("hw_addr", F.col("category.value").alias("category"), F.col("category.score").alias("score"))


_FALL = " ".join(f"WHEN lower(vendor) LIKE '%{v}%' THEN '{k}'" for v, k in fusion.VENDOR_DEFAULTS.items())


@query("v06_inference", f"""SELECT hw_addr, c AS category, coalesce(platform, CASE WHEN lower(vendor) LIKE '%apple%' AND c IN ('phone', 'smartphone') THEN 'iOS'
    WHEN lower(vendor) LIKE '%apple%' AND c IN ('laptop', 'computer', 'desktop') THEN 'macOS' WHEN lower(vendor) LIKE '%samsung%' AND c IN ('phone', 'tablet') THEN 'Android'
    WHEN lower(vendor) LIKE '%samsung%' AND c = 'smart_tv' THEN 'Tizen' WHEN lower(vendor) LIKE '%synology%' THEN 'DSM' END) AS platform
  FROM (SELECT hw_addr, vendor, CASE WHEN hw_addr LIKE '%7' THEN NULL ELSE platform END AS platform, coalesce(CASE WHEN hw_addr LIKE '%a' THEN NULL ELSE category END, CASE {_FALL} END) AS c FROM verdicts)""")
def _(t):
    # Some fields are blanked so that the fallbacks have work.
    v = t.verdicts.withColumn("platform", F.when(~F.col("hw_addr").endswith("7"), F.col("platform"))).withColumn("category", F.when(~F.col("hw_addr").endswith("a"), F.col("category")))
    return fusion.inferred(v).select("hw_addr", "category", "platform")


@query("v07_incremental", f"SELECT {_V} FROM verdicts WHERE hw_addr LIKE '%1'")
def _(t):
    old, new = t.evidence.where("id % 2 = 0"), t.evidence.where("id % 2 = 1")
    both = old.unionByName(new).where(F.col("hw_addr").endswith("1"))
    return fusion.verdicts(both, fusion.weight_table(t.spark)).select("hw_addr", *fusion.FIELDS, "certainty", "evidence")


@query("v08_ballot", """SELECT hw_addr, arg_max(vendor, (votes, vendor)) AS vendor, max(votes) AS votes FROM (
  SELECT hw_addr, vendor, round(sum(certainty * weight) + CASE WHEN bool_or(source = 'oui') THEN 2 ELSE 0 END, 6)::DOUBLE AS votes FROM ev_weighted WHERE vendor <> 'unknown' GROUP BY hw_addr, vendor) GROUP BY hw_addr""")
def _(t):
    rows = fusion.weighted(fusion.capped(t.evidence), fusion.weight_table(t.spark)).where("vendor <> 'unknown'")
    votes = F.round(F.sum(F.col("certainty") * F.col("weight")) + F.when(F.bool_or(F.col("source") == "oui"), 2).otherwise(0), 6)
    g = rows.groupBy("hw_addr", "vendor").agg(votes.alias("votes"))
    return g.groupBy("hw_addr").agg(F.max_by("vendor", F.struct("votes", "vendor")).alias("vendor"), F.max("votes").alias("votes"))


@query("v09_reevaluate_low", "SELECT hw_addr, certainty FROM verdicts WHERE certainty < 75")
def _(t):
    return t.verdicts.where("certainty < 75").select("hw_addr", "certainty")
