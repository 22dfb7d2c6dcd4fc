"""Fingerprint lookups and evidence emitters."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import mac
from ..operators import emit, inventory, lookups
from . import oracle
from .base import DAY, query

_OUI = [("00:1A:2B", "Acme"), ("00:1A:2B:00:00:0", "Acme Lab"), ("D2:1A:2B:0", "Private")]
_DOMAINS = [(1, "icloud.com", "Apple"), (2, "apple.com", "Apple"), (3, "microsoft.com", "Microsoft"), (4, "google.com", "Google"), (5, "com", "Any")]
_BANNER = [(1, "^SSH-2\\.0-OpenSSH_([0-9.]+)", "OpenSSH"), (2, "nginx/([0-9.]+)", "nginx"), (3, "^SSH-2\\.0-dropbear", "Dropbear"), (4, "^220 .*ProFTPD ([0-9.]+)", "ProFTPD"), (5, "^SSH", "SSH"), (6, "Dovecot", "Dovecot")]
_OPT55 = [(1, "1,3,6,15,31,33,43,44", 90, "Windows"), (2, "1,3,6,15,119,121", 85, "macOS"), (3, "1,3,6,12,15,28", 80, "Linux"), (4, "1,3,6,15,26,28,51,58,59", 88, "Android"), (5, "1,3,6,15,28,42", 60, "Generic")]
_OPT60 = [("MSFT", "Microsoft"), ("MSFT 5.0", "Windows"), ("dhcpcd", "dhcpcd"), ("android-dhcp", "Android"), ("dhcpcd-5", "dhcpcd 5")]
_SATORI = [("msft 5.0", 5, "Windows"), ("android", 3, "Android"), ("dhcp", 1, "Generic"), ("dhcpcd", 4, "Linux")]
_JA3 = [(f"{i}", f"app{i}") for i in range(0, 100, 7)]


def _table(t, rows, ddl):
    return t.spark.createDataFrame(rows, ddl)


@query("j10_longest_prefix", f"""SELECT hw_addr, arg_max(vendor, length(prefix)) AS vendor FROM hosts LEFT JOIN {oracle.values(_OUI, "o(prefix, vendor)")} ON starts_with(upper(hw_addr), prefix) GROUP BY hw_addr""")
def _(t):
    out = lookups.longest_prefix_join(t.hosts.select("hw_addr"), "hw_addr", _table(t, _OUI, "prefix string, vendor string"), [8, 10, 16])
    return out.select("hw_addr", "vendor")


def _subset_sql(column: str, rows: list, least: int) -> str:
    p = oracle.values(rows, "p(priority, options, confidence, os)")
    mine, theirs = f"string_split({column}, ',')", "string_split(options, ',')"
    return f"""SELECT packet_id, {column}, os, confidence, match FROM packets LEFT JOIN (
      SELECT {column} AS c, first(os ORDER BY r, priority) AS os, first(conf ORDER BY r, priority) AS confidence, first(match ORDER BY r, priority) AS match FROM (
        SELECT d.*, p.os, p.priority, CASE WHEN {column} = options THEN -1000 ELSE -len({theirs}) END AS r, CASE WHEN {column} = options THEN 'exact' ELSE 'subset' END AS match,
               CASE WHEN {column} = options THEN confidence ELSE greatest(20, confidence - 15 - 10 * (len({mine}) - len({theirs}))) END::INT AS conf
        FROM (SELECT DISTINCT {column} FROM packets) d JOIN {p} ON {column} = options
          OR (len({theirs}) >= {least} AND len({theirs}) < len({mine}) AND list_has_all({mine}, {theirs}))) GROUP BY {column}) ON c = {column}"""


@query("j11_option_subset", _subset_sql("opt55", _OPT55, 6))
def _(t):
    out = lookups.subset_join(t.packets.select("packet_id", "opt55"), "opt55", _table(t, _OPT55, "priority int, options string, confidence int, os string"))
    return out.select("packet_id", "opt55", "os", "confidence", "match")


_ORO = [(1, "1,3,6", 80, "small"), (2, "3,6,15", 70, "mid"), (3, "1,3,6,15", 75, "wide")]


@query("j12_oro_subset", _subset_sql("opt55", _ORO, 1))
def _(t):
    out = lookups.subset_join(t.packets.select("packet_id", "opt55"), "opt55", _table(t, _ORO, "priority int, options string, confidence int, os string"), least=1)
    return out.select("packet_id", "opt55", "os", "confidence", "match")


@query("j13_longest_substring", f"""SELECT packet_id, opt60, class FROM packets LEFT JOIN (SELECT opt60 AS o, first(class ORDER BY -length(text), text) AS class
  FROM (SELECT DISTINCT opt60 FROM packets) JOIN {oracle.values(_OPT60, "r(text, class)")} ON contains(lower(opt60), lower(text)) GROUP BY opt60) ON o = opt60""")
def _(t):
    return lookups.longest_substring_join(t.packets.select("packet_id", "opt60"), "opt60", _table(t, _OPT60, "text string, class string"))


@query("j14_domain_suffix", f"""SELECT packet_id, query_name, arg_min(owner, priority) AS owner FROM packets JOIN {oracle.values(_DOMAINS, "d(priority, suffix, owner)")}
  ON query_name = suffix OR ends_with(query_name, '.' || suffix) WHERE protocol = 'dns' GROUP BY ALL""")
def _(t):
    d = t.packets.where("protocol = 'dns'").select("packet_id", "query_name")
    return lookups.suffix_join(d, "query_name", _table(t, _DOMAINS, "priority int, suffix string, owner string"), ["packet_id"])


_HOSTS = [(1, "example.com", "example"), (2, "com", "commercial"), (3, "org", "other")]


@query("j14_url_suffix", f"""SELECT page_id, host, arg_min(label, priority) AS label FROM urls JOIN {oracle.values(_HOSTS, "d(priority, suffix, label)")} ON host = suffix OR ends_with(host, '.' || suffix) GROUP BY ALL""")
def _(t):
    return lookups.suffix_join(t.urls, "host", _table(t, _HOSTS, "priority int, suffix string, label string"), ["page_id"])


_CASE = " ".join(f"WHEN regexp_matches(banner, '{p}') THEN {{}}" for _, p, _ in _BANNER)


@query("j15_ordered_regex", f"""SELECT packet_id, CASE {_CASE.format(*(f"'{n}'" for *_, n in _BANNER))} END AS product,
  CASE {_CASE.format(*(f"regexp_extract(banner, '{p}', 1)" if "(" in p else "''" for _, p, _ in _BANNER))} END AS version FROM packets""")
def _(t):
    rules = _table(t, _BANNER, "priority int, pattern string, product string")
    return lookups.first_regex_join(t.packets.select("packet_id", "banner"), "banner", rules, ["packet_id"]).select("packet_id", "product", "version")


@query("j16_exact_hash", f"SELECT packet_id, app FROM packets LEFT JOIN (SELECT md5(a) AS h, app FROM {oracle.values(_JA3, 'j(a, app)')}) ON h = md5(k::VARCHAR)")
def _(t):
    dim = _table(t, _JA3, "a string, app string").select(F.md5("a").alias("h"), "app")
    return t.packets.withColumn("h", F.md5(F.col("k").cast("string"))).join(F.broadcast(dim), "h", "left").select("packet_id", "app")


@query("j17_exact_then_partial", f"""SELECT packet_id, opt60, os FROM packets LEFT JOIN (SELECT opt60 AS o, first(os ORDER BY lower(opt60) <> lower(text), -weight, text) AS os
  FROM (SELECT DISTINCT opt60 FROM packets) JOIN {oracle.values(_SATORI, "s(text, weight, os)")} ON contains(lower(opt60), lower(text)) GROUP BY opt60) ON o = opt60""")
def _(t):
    return lookups.exact_then_partial_join(t.packets.select("packet_id", "opt60"), "opt60", _table(t, _SATORI, "text string, weight int, os string"))


def _as_of_previous(t, packets):
    # As-of join by union: the newest evidence before each packet's moment.
    e = t.evidence.select("hw_addr", "us", F.lit(0).alias("side"), F.col("id"), F.struct("vendor").alias("v"), F.lit(None).cast("long").alias("packet_id"))
    p = packets.select("hw_addr", (F.col("us") - F.lit(8200 * DAY)).alias("us"), F.lit(1).alias("side"), F.lit(None).cast("long").alias("id"), F.lit(None).cast("struct<vendor:string>").alias("v"), "packet_id")
    w = Window.partitionBy("hw_addr").orderBy("us", "side", "id").rowsBetween(Window.unboundedPreceding, 0)
    both = e.unionByName(p).withColumn("last", F.last("v", ignorenulls=True).over(w))
    return both.where("side = 1").select("packet_id", F.col("last.vendor").alias("vendor"))


@query("j18_as_of_previous", f"""SELECT p.packet_id, (SELECT arg_max(e.vendor, (e.us, e.id)) FROM evidence e WHERE e.hw_addr = p.hw_addr AND e.us <= p.us - {8200 * DAY}) AS vendor FROM packets p WHERE k < 20""")
def _(t):
    return _as_of_previous(t, t.packets.where("k < 20"))


@query("j18_as_of_previous_all", f"""SELECT packet_id, vendor FROM (SELECT packet_id, hw_addr, us - {8200 * DAY} AS at FROM packets) p
  ASOF LEFT JOIN (SELECT hw_addr, us, arg_max(vendor, id) AS vendor FROM evidence GROUP BY hw_addr, us) e ON p.hw_addr = e.hw_addr AND p.at >= e.us""")
def _(t):
    return _as_of_previous(t, t.packets)


@query("l01_first_per_protocol", "SELECT packet_id, hw_addr, protocol FROM (SELECT *, row_number() OVER (PARTITION BY hw_addr, protocol ORDER BY us, packet_id) AS n FROM packets) WHERE n = 1")
def _(t):
    return inventory.latest(t.packets, ["hw_addr", "protocol"], [F.col("us"), F.col("packet_id")]).select("packet_id", "hw_addr", "protocol")


@query("l02_dhcp_bundle", f"""WITH m AS ({_subset_sql("opt55", _OPT55, 6)}), c AS (SELECT packet_id AS i, class FROM packets LEFT JOIN (SELECT opt60 AS o, first(class ORDER BY -length(text), text) AS class
    FROM (SELECT DISTINCT opt60 FROM packets) JOIN {oracle.values(_OPT60, "r(text, class)")} ON contains(lower(opt60), lower(text)) GROUP BY opt60) ON o = opt60)
  SELECT packet_id, 'dhcpv4_fingerprint' AS source, os AS value FROM m JOIN packets USING (packet_id) WHERE os IS NOT NULL AND protocol = 'dhcpv4'
  UNION ALL SELECT packet_id, 'dhcpv4_vendor', class FROM c JOIN packets ON packet_id = i WHERE class IS NOT NULL AND protocol = 'dhcpv4'""")
def _(t):
    d = t.packets.where("protocol = 'dhcpv4'").select("packet_id", "opt55", "opt60")
    a = lookups.subset_join(d, "opt55", _table(t, _OPT55, "priority int, options string, confidence int, os string")).where("os IS NOT NULL")
    b = lookups.longest_substring_join(d, "opt60", _table(t, _OPT60, "text string, class string")).where("class IS NOT NULL")
    return a.select("packet_id", F.lit("dhcpv4_fingerprint").alias("source"), F.col("os").alias("value")).unionByName(b.select("packet_id", F.lit("dhcpv4_vendor").alias("source"), F.col("class").alias("value")))


_ENTERPRISE = [(9, "Cisco"), (311, "Microsoft"), (2636, "Juniper")]
_IANA = [(9, "ciscoSystems"), (311, "Microsoft Corp"), (2636, "Juniper Networks"), (5, "ACC"), (11, "HP"), (63, "Apple")]


@query("l03_fallback_lookup", f"""SELECT k, coalesce(a.name, b.name) AS name, CASE WHEN a.name IS NOT NULL THEN 'feed' WHEN b.name IS NOT NULL THEN 'registry' END AS origin
  FROM (SELECT DISTINCT k FROM packets) LEFT JOIN {oracle.values(_ENTERPRISE, "a(id, name)")} ON a.id = k LEFT JOIN {oracle.values(_IANA, "b(id, name)")} ON b.id = k""")
def _(t):
    k = t.packets.select("k").distinct()
    feed = F.broadcast(_table(t, _ENTERPRISE, "k int, a string"))
    rest = F.broadcast(_table(t, _IANA, "k int, b string"))
    out = k.join(feed, "k", "left").join(rest, "k", "left")
    return out.select("k", F.coalesce("a", "b").alias("name"), F.when(F.col("a").isNotNull(), "feed").when(F.col("b").isNotNull(), "registry").alias("origin"))


_SERVICE = [("_googlecast._tcp", "streaming_device", "Google"), ("_airplay._tcp", "media_device", "Apple"), ("_ipp._tcp", "printer", None), ("_hap._tcp", "smart_home", None)]


@query("l04_service_map", f"SELECT packet_id, category, vendor FROM packets JOIN {oracle.values(_SERVICE, 's(name, category, vendor)')} ON name = service WHERE protocol = 'mdns'")
def _(t):
    s = F.broadcast(_table(t, _SERVICE, "service string, category string, vendor string"))
    return t.packets.where("protocol = 'mdns'").join(s, "service").select("packet_id", "category", "vendor")


@query("l05_l06_match_to_evidence", f"""SELECT packet_id, 'mdns_service_map' AS source, 0.7::DOUBLE AS certainty, category, coalesce(vendor, 'generic') AS vendor FROM packets JOIN {oracle.values(_SERVICE, 's(name, category, vendor)')} ON name = service
  UNION ALL SELECT packet_id, 'banner', 0.75::DOUBLE, 'server', CASE {_CASE.format(*(f"'{n}'" for *_, n in _BANNER))} END FROM packets WHERE protocol = 'tcp_syn' AND banner NOT LIKE 'RFB%'""")
def _(t):
    s = F.broadcast(_table(t, _SERVICE, "service string, category string, vendor string"))
    a = t.packets.join(s, "service").select("packet_id", F.lit("mdns_service_map").alias("source"), F.lit(0.7).alias("certainty"), "category", F.coalesce("vendor", F.lit("generic")).alias("vendor"))
    b = lookups.first_regex_join(t.packets.where("protocol = 'tcp_syn'").select("packet_id", "banner"), "banner", _table(t, _BANNER, "priority int, pattern string, vendor string"), ["packet_id"])
    b = b.where("vendor IS NOT NULL").select("packet_id", F.lit("banner").alias("source"), F.lit(0.75).alias("certainty"), F.lit("server").alias("category"), "vendor")
    return a.unionByName(b)


_LAA = "(hw_addr LIKE 'd2%')"
_EMIT_SQL = f"""
  SELECT packet_id, hw_addr, 'arp' AS source, 'observed' AS method, 0.3::DOUBLE AS certainty, NULL AS category, NULL AS vendor, NULL AS platform, NULL AS hostname FROM packets WHERE protocol = 'arp'
  UNION ALL SELECT packet_id, hw_addr, 'dhcpv4', 'pattern', 0.75, NULL, NULL, CASE WHEN opt60 LIKE 'MSFT%' THEN 'Windows' WHEN opt60 LIKE 'android%' THEN 'Android' WHEN opt60 LIKE 'dhcpcd%' THEN 'Linux' END, hostname FROM packets WHERE protocol = 'dhcpv4'
  UNION ALL SELECT packet_id, hw_addr, 'dns', 'query', 0.45, NULL, NULL, NULL, NULL FROM packets WHERE protocol = 'dns'
  UNION ALL SELECT packet_id, hw_addr, CASE WHEN service IN ('_googlecast._tcp', '_hap._tcp') THEN 'mdns_exclusive' ELSE 'mdns_service' END, 'pattern', CASE WHEN {_LAA} THEN 0.15 ELSE 0.65 END::DOUBLE,
    CASE WHEN {_LAA} THEN NULL ELSE CASE service WHEN '_googlecast._tcp' THEN 'streaming_device' WHEN '_airplay._tcp' THEN 'media_device' WHEN '_ipp._tcp' THEN 'printer' WHEN '_ssh._tcp' THEN 'computer' WHEN '_hap._tcp' THEN 'smart_home' END END,
    CASE WHEN {_LAA} THEN NULL WHEN service = '_airplay._tcp' THEN 'Apple' WHEN service = '_googlecast._tcp' THEN 'Google' END, NULL, NULL FROM packets WHERE protocol = 'mdns' AND service IS NOT NULL
  UNION ALL SELECT packet_id, hw_addr, 'tcp_syn', 'ttl', 0.4, NULL, NULL, CASE WHEN ttl <= 64 THEN 'Linux' WHEN ttl <= 128 THEN 'Windows' END, NULL FROM packets WHERE protocol = 'tcp_syn'"""


@query("e01_e02_e03_emitters", _EMIT_SQL)
def _(t):
    return emit.emitted(t.packets).select("packet_id", "hw_addr", "source", "method", "certainty", "category", "vendor", "platform", "hostname")


_PORT_HINT = [(22, "ssh"), (23, "telnet"), (21, "ftp"), (53, "dns"), (80, "http"), (443, "https"), (161, "snmp"), (502, "modbus"), (1883, "mqtt"), (3306, "mysql")]


def _infrastructure(p):
    """Stand-in data by the packet key; the operator is ``records.infrastructure``."""
    kind = F.element_at(F.array(*map(F.lit, ["router", "switch", "access_point", "phone"])), (F.col("k") % 4 + 1).cast("int"))
    vendor = F.when(F.lower("banner").contains("openssh"), "Cisco").when(F.lower("banner").contains("nginx"), "Ubiquiti")
    sure = F.when(F.col("k") < 33, 0.9).when(F.col("k") < 66, 0.7).otherwise(0.5)
    return p.select("packet_id", kind.alias("category"), vendor.alias("vendor"), sure.alias("certainty"))


def _industrial(p):
    """Stand-in data by the port; the operator is ``records.industrial``."""
    p = p.where(F.col("port").isin(502, 1883))
    return p.select("packet_id", F.when(F.col("port") == 502, "modbus").otherwise("s7comm").alias("source"), F.when(F.col("op") == 2, "plc").otherwise("hmi").alias("category"))


@query("e04_infrastructure", """SELECT packet_id, CASE WHEN k % 4 = 0 THEN 'router' WHEN k % 4 = 1 THEN 'switch' WHEN k % 4 = 2 THEN 'access_point' ELSE 'phone' END AS category,
  CASE WHEN contains(lower(banner), 'openssh') THEN 'Cisco' WHEN contains(lower(banner), 'nginx') THEN 'Ubiquiti' END AS vendor, CASE WHEN k < 33 THEN 0.9 WHEN k < 66 THEN 0.7 ELSE 0.5 END::DOUBLE AS certainty FROM packets WHERE protocol = 'tcp_syn'""")
def _(t):
    return _infrastructure(t.packets.where("protocol = 'tcp_syn'"))


@query("e05_industrial_role", """SELECT packet_id, CASE WHEN port = 502 THEN 'modbus' ELSE 's7comm' END AS source, CASE WHEN op = 2 THEN 'plc' ELSE 'hmi' END AS category FROM packets WHERE port IN (502, 1883)""")
def _(t):
    return _industrial(t.packets)


@query("e06_banner_identity", f"""SELECT packet_id, CASE {_CASE.format(*(f"'{n}'" for *_, n in _BANNER))} END AS product, CASE WHEN banner LIKE 'SSH%' THEN 0.8 WHEN banner LIKE '220%' THEN 0.7 ELSE 0.5 END::DOUBLE AS certainty FROM packets WHERE banner NOT LIKE 'RFB%'""")
def _(t):
    got = lookups.first_regex_join(t.packets.select("packet_id", "banner"), "banner", _table(t, _BANNER, "priority int, pattern string, product string"), ["packet_id"])
    sure = F.when(F.col("banner").startswith("SSH"), 0.8).when(F.col("banner").startswith("220"), 0.7).otherwise(0.5)
    return got.where("product IS NOT NULL").select("packet_id", "product", sure.alias("certainty"))


@query("e07_port_hint", f"SELECT packet_id, service FROM (SELECT packet_id, port FROM packets) LEFT JOIN {oracle.values(_PORT_HINT, 'h(p, service)')} ON p = port")
def _(t):
    h = F.broadcast(_table(t, _PORT_HINT, "port int, service string"))
    return t.packets.select("packet_id", "port").join(h, "port", "left").select("packet_id", "service")


@query("e08_server_roles", "SELECT hw_addr, bool_or(port = 53) AS dns_server, bool_or(port = 161) AS snmp_agent, bool_or(k % 50 = 7) AS ntp_server FROM packets GROUP BY hw_addr")
def _(t):
    return t.packets.groupBy("hw_addr").agg(F.bool_or(F.col("port") == 53).alias("dns_server"), F.bool_or(F.col("port") == 161).alias("snmp_agent"), F.bool_or(F.col("k") % 50 == 7).alias("ntp_server"))


@query("e09_probe_evidence", "SELECT packet_id, 'probe_' || split_part(lower(banner), '-', 1) AS source, certainty FROM packets WHERE banner LIKE 'SSH%'")
def _(t):
    return t.packets.where(F.col("banner").startswith("SSH")).select("packet_id", F.concat(F.lit("probe_"), F.element_at(F.split(F.lower("banner"), "-"), 1)).alias("source"), "certainty")


@query("e11_gateway_learning", "SELECT DISTINCT hw_addr, 'router' AS category, 0.95::DOUBLE AS certainty FROM packets WHERE protocol = 'dhcpv4' AND op = 2 AND k > 90")
def _(t):
    return t.packets.where("protocol = 'dhcpv4' AND op = 2 AND k > 90").select("hw_addr", F.lit("router").alias("category"), F.lit(0.95).alias("certainty")).distinct()


@query("e12_cross_validation", """SELECT id, CASE WHEN conflict THEN least(certainty, 0.15::DOUBLE) ELSE certainty END AS certainty, CASE WHEN conflict THEN NULL ELSE category END AS category FROM (
  SELECT e.*, source = 'mdns' AND ref IS NOT NULL AND NOT (contains(lower(vendor), lower(ref)) OR contains(lower(ref), lower(vendor))) AS conflict
  FROM evidence e LEFT JOIN (SELECT hw_addr, arg_max(vendor, (s, vendor)) AS ref FROM (SELECT hw_addr, vendor, round(sum(certainty), 6) AS s FROM evidence WHERE source = 'oui' GROUP BY ALL) GROUP BY hw_addr) USING (hw_addr))""")
def _(t):
    return emit.cross_validated(t.evidence).select("id", "certainty", "category")


@query("f15_randomized_mac", "SELECT DISTINCT hw_addr, (substr(hw_addr, 2, 1) IN ('2', '3', '6', '7', 'a', 'b', 'e', 'f')) AND NOT starts_with(hw_addr, '02:42') AS randomized FROM packets")
def _(t):
    return t.packets.select("hw_addr", mac.randomized(F.col("hw_addr")).alias("randomized")).distinct()
