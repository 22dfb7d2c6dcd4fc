"""Feed and lease parsers applied to text made of the tables' rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import feeds
from ..sources.adapters import mac_of
from . import oracle
from .base import query


@query("s06_oui_feed", "SELECT upper(printf('%02x:%02x:%02x', (s_suppkey // 65536) % 256, (s_suppkey // 256) % 256, s_suppkey % 256)) AS prefix, s_name AS vendor FROM supplier")
def _(t):
    hexed = F.lpad(F.hex("s_suppkey"), 6, "0")
    line = F.concat(F.regexp_replace(hexed, "(..)(?!$)", "$1-"), F.lit("   (hex)\t\t"), F.col("s_name"))
    return feeds.oui_lines(t.raw("supplier").select(line.alias("value")))


@query("s07_signature_file", "SELECT p_partkey AS n, p_brand AS label, '4' AS ver, p_size::VARCHAR AS ittl FROM part")
def _(t):
    p = t.raw("part")
    a = p.select(F.col("p_brand").alias("file"), (F.col("p_partkey") * 2).alias("n"), F.concat(F.lit("label = "), "p_brand").alias("value"))
    b = p.select(F.col("p_brand").alias("file"), (F.col("p_partkey") * 2 + 1).alias("n"), F.concat(F.lit("sig = 4:"), F.col("p_size").cast("string"), F.lit(":0:*:8192,0:mss,nop:df")).alias("value"))
    out = feeds.signature_lines(a.unionByName(b))
    return out.select(((F.col("n") - 1) / 2).cast("long").alias("n"), "label", "ver", "ittl")


@query("s08_device_hierarchy", "SELECT n_nationkey + 100 AS id, r_name || ' > ' || n_name AS path FROM nation JOIN region ON r_regionkey = n_regionkey UNION ALL SELECT r_regionkey, r_name FROM region")
def _(t):
    a = t.raw("nation").select((F.col("n_nationkey") + 100).alias("id"), F.col("n_regionkey").alias("parent"), F.col("n_name").alias("name"))
    b = t.raw("region").select(F.col("r_regionkey").alias("id"), F.lit(None).cast("int").alias("parent"), F.col("r_name").alias("name"))
    return feeds.hierarchy(a.unionByName(b), 3)


@query("s09_option_combinations", "SELECT opt55 AS options, list(DISTINCT opt60 ORDER BY opt60) AS devices FROM packets WHERE opt60 IS NOT NULL GROUP BY opt55")
def _(t):
    return feeds.combinations(t.packets.where("opt60 IS NOT NULL").select(F.col("opt55").alias("options"), F.col("opt60").alias("device")))


@query("s10_enterprise_numbers", "SELECT s_suppkey::INT AS id, s_name AS name FROM supplier")
def _(t):
    s = t.raw("supplier").select(F.col("s_suppkey").cast("string").alias("file"), "s_suppkey", "s_name")
    lines = s.select("file", F.posexplode(F.array(F.col("s_suppkey").cast("string"), F.concat(F.lit("  "), "s_name"), F.lit("    contact"), F.lit("      a&b.example"))).alias("n", "value"))
    return feeds.enterprise_numbers(lines)


@query("s11_hash_unpivot", "SELECT md5('a' || p_partkey) AS hash, 'ja4' AS kind, p_name AS application FROM part UNION ALL SELECT md5('b' || p_partkey), 'ja4s', p_name FROM part WHERE p_partkey % 2 = 0")
def _(t):
    key = F.col("p_partkey").cast("string")
    rows = t.raw("part").select(F.col("p_name").alias("application"), F.md5(F.concat(F.lit("a"), key)).alias("ja4"), F.when(F.col("p_partkey") % 2 == 0, F.md5(F.concat(F.lit("b"), key))).otherwise("").alias("ja4s"))
    return feeds.unpivoted_hashes(rows, ["ja4", "ja4s"])


@query("s12_weighted_tests", "SELECT lower(p_type) AS match, arg_max(p_brand, (p_size, p_brand)) AS os, max(p_size) AS weight FROM part GROUP BY 1")
def _(t):
    rows = t.raw("part").select(F.col("p_brand").alias("os"), F.array(F.struct(F.col("p_type").alias("match"), F.col("p_size").alias("weight"))).alias("tests"))
    return feeds.weighted_tests(rows)


@query("s14_json_lines", "SELECT event_id, (props::JSON->>'k')::INT AS k FROM events WHERE event_id % 10 <> 0")
def _(t):
    bad = F.when(F.col("event_id") % 10 == 0, "{broken").otherwise(F.col("props"))
    return t.raw("events").select("event_id", F.from_json(bad, "k int")["k"].alias("k")).where("k IS NOT NULL")


@query("s16_lease_import", f"SELECT {oracle.mac_of('c_custkey')} AS hw_addr, '10.1.' || (c_custkey // 250) || '.' || (c_custkey % 250) AS ip_addr, CASE WHEN c_custkey % 3 <> 0 THEN 'h' || c_custkey END AS hostname FROM customer WHERE c_custkey % 11 <> 0")
def _(t):
    c = F.col("c_custkey")
    ip = F.concat(F.lit("10.1."), F.floor(c / 250).cast("string"), F.lit("."), (c % 250).cast("string"))
    mac = F.when(c % 11 == 0, "zz:bad").otherwise(F.upper(mac_of(c)))
    line = F.concat_ws(" ", F.lit("1745064000"), mac, ip, F.when(c % 3 == 0, "*").otherwise(F.concat(F.lit("h"), c.cast("string"))), F.lit("*"))
    return feeds.dnsmasq_leases(t.raw("customer").select(line.alias("value"))).select("hw_addr", "ip_addr", "hostname")


_CUSTOM = [(0, "bobs", "mine"), (5, "alice", "builtin"), (6, "bobs", "builtin")]


@query("s17_s18_y05_pattern_tables", f"SELECT label, count(*) AS hits FROM (SELECT user_id, packet_id, arg_min(label, priority) AS label FROM packets JOIN {oracle.values(_CUSTOM, 'c(priority, word, label)')} ON contains(lower(hostname), word) GROUP BY ALL) GROUP BY label")
def _(t):
    rules = t.spark.createDataFrame(_CUSTOM, "priority int, word string, label string")
    own, builtin = rules.where("priority = 0"), rules.where("priority > 0")
    every = F.broadcast(own.unionByName(builtin))  # built-in and user patterns, a small table
    best = t.packets.select("hostname").distinct().join(every, F.lower("hostname").contains(F.col("word"))).groupBy("hostname").agg(F.min_by("label", "priority").alias("label"))
    return t.packets.join(best, "hostname").groupBy("label").agg(F.count("*").alias("hits"))


@query("s19_guarded_sql", "SELECT protocol, count(*) AS n FROM packets GROUP BY protocol")
def _(t):
    t.packets.createOrReplaceTempView("wirefold_packets")
    return feeds.guarded_sql(t.spark, "SELECT protocol, count(*) AS n FROM wirefold_packets GROUP BY protocol")


@query("s20_last_anomalies", "SELECT id, message FROM findings ORDER BY us DESC, id DESC LIMIT 50")
def _(t):
    line = t.findings.select("us", "id", F.to_json(F.struct("id", "message")).alias("value"))
    return line.orderBy(F.col("us").desc(), F.col("id").desc()).limit(50).select(F.from_json("value", "id long, message string").alias("x")).select("x.id", "x.message")


@query("k01_k04_k05_exports", "SELECT mac, owner, array_to_string(tags, ',') AS tags FROM devices")
def _(t):
    return t.devices.select("mac", "owner", F.array_join("tags", ",").alias("tags"))


@query("k06_table_info", "SELECT 'customer' AS name, count(*) AS n FROM customer UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'events', count(*) FROM events")
def _(t):
    out = None
    for name in ("customer", "orders", "events"):
        part = t.raw(name).agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = part if out is None else out.unionByName(part)
    return out


_AI = [("GET /v1/models", 1, "openai_api"), ("GET /api/tags", 2, "ollama"), ("GET /", 3, "web")]


@query("p23_path_prefix", f"SELECT DISTINCT k, arg_min(service, priority) AS service FROM (SELECT DISTINCT k, CASE k % 3 WHEN 0 THEN 'GET /v1/models?x=' || k WHEN 1 THEN 'GET /api/tags' ELSE 'POST /x' END AS line FROM packets) JOIN {oracle.values(_AI, 'a(prefix, priority, service)')} ON starts_with(line, prefix) GROUP BY k")
def _(t):
    k = F.col("k")
    line = F.when(k % 3 == 0, F.concat(F.lit("GET /v1/models?x="), k.cast("string"))).when(k % 3 == 1, "GET /api/tags").otherwise("POST /x")
    a = F.broadcast(t.spark.createDataFrame(_AI, "prefix string, priority int, service string"))  # a fixed table
    met = t.packets.select("k", line.alias("line")).distinct().join(a, F.col("line").startswith(F.col("prefix")))
    return met.groupBy("k").agg(F.min_by("service", "priority").alias("service"))


@query("p00_p01_first_match_parser", "SELECT packet_id, CASE WHEN protocol = 'arp' AND op IN (1, 2) THEN 'arp' WHEN protocol = 'tcp_syn' THEN 'tcp_syn' WHEN port = 53 THEN 'dns' ELSE 'unclassified' END AS record FROM packets")
def _(t):
    arp = F.when((F.col("protocol") == "arp") & F.col("op").isin(1, 2), "arp")
    syn, dns = F.when(F.col("protocol") == "tcp_syn", "tcp_syn"), F.when(F.col("port") == 53, "dns")
    return t.packets.select("packet_id", F.coalesce(arp, syn, dns, F.lit("unclassified")).alias("record"))


@query("p08_http_headers", "SELECT DISTINCT user_agent, 'h' || length(user_agent) AS host FROM packets")
def _(t):
    raw = F.concat(F.lit("GET / HTTP/1.1\r\nHost: h"), F.length("user_agent").cast("string"), F.lit("\r\nUser-Agent: "), F.col("user_agent"), F.lit("\r\n\r\n"))
    p = t.packets.select(raw.alias("p"))
    return p.select(F.regexp_extract("p", r"(?i)user-agent:\s*([^\r\n]+)", 1).alias("user_agent"), F.regexp_extract("p", r"(?i)host:\s*([^\r\n]+)", 1).alias("host")).distinct()


@query("p10_dns_answers", "SELECT packet_id, unnest(['10.0.0.1', ip_addr]) AS answer FROM packets WHERE protocol = 'dns'")
def _(t):
    return t.packets.where("protocol = 'dns'").select("packet_id", F.explode(F.array(F.lit("10.0.0.1"), F.col("ip_addr"))).alias("answer"))


@query("p12_ssdp_headers", "SELECT DISTINCT banner, upper(substr(banner, 1, 3)) AS st FROM packets")
def _(t):
    raw = F.concat(F.lit("SERVER: "), F.regexp_replace("banner", ":", ";"), F.lit("\r\nST: "), F.upper(F.substring("banner", 1, 3)))
    m = F.transform_values(F.str_to_map(raw, F.lit("\r\n"), F.lit(":")), lambda k, v: F.trim(v))
    return t.packets.select("banner", F.element_at(m, "ST").alias("st")).distinct()
