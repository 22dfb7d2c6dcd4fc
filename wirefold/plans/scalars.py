"""Scalar expressions over the views."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ip, mac, names, tls
from ..operators import detect, lifecycle
from ..sources.adapters import micros, pick
from . import oracle
from .base import query


@query("f16_local_bit", "SELECT DISTINCT hw_addr, hw_addr LIKE 'd2%' AS local FROM packets")
def _(t):
    return t.packets.select("hw_addr", mac.local_bit(F.col("hw_addr")).alias("local")).distinct()


@query("f17_mac_normalise", "SELECT DISTINCT hw_addr, upper(substr(hw_addr, 1, 8)) AS prefix, hw_addr AS normal FROM packets")
def _(t):
    messy = F.upper(F.regexp_replace("hw_addr", ":", "-"))
    return t.packets.select("hw_addr", mac.prefix(F.col("hw_addr")).alias("prefix"), mac.normalised(messy).alias("normal")).distinct()


_C, _E = [4865, 4866, 2570, 49195, 49199], [0, 23, 6682, 10, 11, 35]


def _hello(t):
    k = F.col("k")
    lits = lambda xs: F.array(*[F.lit(x) for x in xs])
    return (F.when(k % 2 == 0, 771).otherwise(772), F.concat(lits(_C), F.array(k)), F.concat(lits(_E), F.array(k * 3)), lits([29, 23, 10794]), lits([0]))


_CS, _ES = "4865-4866-49195-49199-' || k", "0-23-10-11-35-' || (k * 3)"


@query("f18_ja3", f"SELECT DISTINCT k, md5((CASE WHEN k % 2 = 0 THEN 771 ELSE 772 END) || ',{_CS} || ',{_ES} || ',29-23,0') AS ja3 FROM packets")
def _(t):
    return t.packets.select("k", tls.ja3(*_hello(t)).alias("ja3")).distinct()


@query("f19_ja4", """SELECT DISTINCT k, 't' || (CASE WHEN k % 2 = 0 THEN '12' ELSE '13' END) || (CASE WHEN k % 3 = 0 THEN 'i' ELSE 'd' END) || '0506' || (CASE k % 3 WHEN 0 THEN '00' WHEN 1 THEN 'h2' ELSE 'h1' END) || '_' ||
    substr(sha256(array_to_string(list_sort([4865, 4866, 49195, 49199, k]), ',')), 1, 12) || '_' || substr(sha256(array_to_string(list_sort([0, 23, 10, 11, 35, k * 3]), ',')), 1, 12) AS ja4 FROM packets""")
def _(t):
    v, c, e, *_rest = _hello(t)
    k = F.col("k")
    sni = F.when(k % 3 != 0, "x.example")
    alpn = F.when(k % 3 == 1, "h2").when(k % 3 == 2, "http/1.1")
    return t.packets.select("k", tls.ja4(v, c, e, sni, alpn).alias("ja4")).distinct()


@query("f20_option_digest", "SELECT DISTINCT opt55, md5(array_to_string(list_sort([x::INT for x in string_split(opt55, ',')]), ',')) AS by_number, md5(array_to_string(list_sort(string_split(opt55, ',')), ',')) AS by_text FROM packets")
def _(t):
    o = F.col("opt55")
    return t.packets.select("opt55", tls.option_digest(o).alias("by_number"), tls.option_digest(o, numeric=False).alias("by_text")).distinct()


# The rules written out by hand, not from the operator's lists.
HOSTNAME_SQL = r"""
SELECT DISTINCT hostname, coalesce(trim(hostname) <> '' AND NOT (
    starts_with(trim(hostname), '_') OR contains(lower(hostname), '._tcp') OR contains(lower(hostname), '._udp') OR contains(lower(hostname), '_dns-sd')
    OR regexp_matches(trim(hostname), '^(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])([.](25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])){3}$')
    OR regexp_matches(lower(trim(hostname)), '^[0-9a-f]*:[0-9a-f:]*:[0-9a-f:.]*$')
    OR (len(string_split(trim(hostname), '.')) >= 3 AND lower(string_split(trim(hostname), '.')[-1]) IN ('com', 'net', 'org', 'edu', 'gov', 'mil', 'io', 'co',
        'uk', 'de', 'fr', 'jp', 'cn', 'ru', 'br', 'au', 'in', 'ca', 'us', 'eu', 'info', 'biz', 'me', 'tv', 'cc', 'ws', 'app', 'dev', 'cloud', 'xyz'))
    OR (contains(hostname, '-') AND len(list_filter(string_split(lower(trim(hostname)), '-'), lambda x: NOT regexp_full_match(x, '[0-9a-f]+'))) = 0)
    OR (len(string_split(trim(hostname), '-')) >= 4 AND len(list_filter(string_split(lower(trim(hostname)), '-')[-3:], lambda x: NOT regexp_full_match(x, '[0-9a-f]+'))) = 0)
    OR regexp_full_match(lower(trim(hostname)), '[0-9a-f]{8,}')
    OR regexp_full_match(lower(trim(hostname)), '[a-z]{1,10}[-_][0-9a-f]{8,12}')
    OR regexp_full_match(lower(trim(hostname)), '(esdk|esp|tasmota|shelly|tuya|beken|ewelink|sonoff|hap|ble|wlan|wifi|smartlife|tplink|kasa|deco|meross).[0-9a-f]{6,}')
  ), false) AS valid FROM packets
"""


@query("f21_hostname_validity", HOSTNAME_SQL)
def _(t):
    return t.packets.select("hostname", names.valid_hostname(F.col("hostname")).alias("valid")).distinct()


@query("f22_hostname_cleaning", r"SELECT DISTINCT hostname, regexp_replace(split_part(hostname, '._', 1), '\.local$', '') AS clean FROM packets")
def _(t):
    return t.packets.select("hostname", names.clean_hostname(F.col("hostname")).alias("clean")).distinct()


#: Each keyword once, the vendors that own it, and one that owns none; written out for the SQL.
_KEYWORDS = [("lutron", "Lutron"), ("hue", "Philips"), ("hue", "Signify"), ("sonos", "Sonos"), ("roku", "Roku"), ("nest", "Google"), ("echo", "Amazon"), ("alexa", "Amazon"), ("homepod", "Apple"),
             ("chromecast", "Google"), ("firestick", "Amazon"), ("ring", "Amazon"), ("ring", "Ring"), ("roborock", "Roborock"), ("roomba", "iRobot"), ("ecobee", "ecobee"), ("dyson", "Dyson")]
_HOSTS = ["Living-Hue", "sonos-kitchen", "alice-pc", "Echo-Dot", "nest-cam", "spring", "HomePod", "roomba-7", "", None]


@query("f23_hostname_coherence", f"""WITH p AS (SELECT DISTINCT {oracle.pick("k", _HOSTS)} AS hostname, {oracle.pick("user_id", ["Philips Lighting", "Sonos", "Apple", "Amazon", "Google", "Ring", "irobot", "", None])} AS vendor FROM packets)
  SELECT hostname, vendor, coalesce(hostname = '' OR vendor = '', false) OR coalesce(NOT EXISTS (SELECT w FROM {oracle.values(_KEYWORDS, "o(w, v)")} WHERE contains(lower(hostname), w) GROUP BY w
    HAVING NOT bool_or(contains(lower(vendor), lower(v)) OR contains(lower(v), lower(vendor)))), true) AS coherent FROM p""")
def _(t):
    host, vendor = pick(F.col("k"), _HOSTS), pick(F.col("user_id"), ["Philips Lighting", "Sonos", "Apple", "Amazon", "Google", "Ring", "irobot", "", None])
    return t.packets.select(host.alias("hostname"), vendor.alias("vendor")).distinct().select("hostname", "vendor", names.coherent(F.col("hostname"), F.col("vendor")).alias("coherent"))


@query("f24_fuzzy_vendor", "SELECT id, contains(lower(vendor), lower(coalesce(before, ''))) AS same FROM (SELECT *, CASE WHEN id % 2 = 0 THEN upper(substr(vendor, 1, 3)) ELSE 'zz' END AS before FROM evidence)")
def _(t):
    other = F.when(F.col("id") % 2 == 0, F.upper(F.substring("vendor", 1, 3))).otherwise("zz")
    return t.evidence.select("id", names.same_vendor(F.col("vendor"), other).alias("same"))


@query("f25_subnets", "SELECT DISTINCT ip_addr, regexp_replace(ip_addr, '[0-9]+$', '0/24') AS net24, '10.0.' || ((split_part(ip_addr, '.', 3)::INT // 16) * 16) || '.0/20' AS net20 FROM packets")
def _(t):
    a = F.col("ip_addr")
    return t.packets.select("ip_addr", ip.subnet(a).alias("net24"), ip.subnet(a, 20).alias("net20")).distinct()


@query("f26_p22_ttl", "SELECT packet_id, CASE WHEN ttl <= 64 THEN 64 WHEN ttl <= 128 THEN 128 ELSE 255 END AS initial, CASE WHEN ttl <= 64 THEN 'unix-like' WHEN ttl <= 128 THEN 'windows' ELSE 'network' END AS class FROM packets")
def _(t):
    return t.packets.select("packet_id", ip.initial_ttl(F.col("ttl")).alias("initial"), ip.ttl_class(F.col("ttl")).alias("class"))


@query("f27_user_agent", """SELECT DISTINCT user_agent, CASE WHEN contains(user_agent, 'iPhone') THEN 'iOS' WHEN contains(user_agent, 'Android') THEN 'Android' WHEN contains(user_agent, 'Windows') THEN 'Windows' WHEN contains(user_agent, 'Mac OS X') THEN 'macOS' WHEN contains(user_agent, 'Linux') THEN 'Linux' END AS platform,
  replace(regexp_extract(user_agent, '(?:Android |Windows NT |iPhone OS |Mac OS X )([0-9_.]+)', 1), '_', '.') AS version FROM packets""")
def _(t):
    a = F.col("user_agent")
    platform = F.when(a.contains("iPhone"), "iOS").when(a.contains("Android"), "Android").when(a.contains("Windows"), "Windows").when(a.contains("Mac OS X"), "macOS").when(a.contains("Linux"), "Linux")
    version = F.replace(F.regexp_extract(a, "(?:Android |Windows NT |iPhone OS |Mac OS X )([0-9_.]+)", 1), F.lit("_"), F.lit("."))
    return t.packets.select("user_agent", platform.alias("platform"), version.alias("version")).distinct()


@query("f28_slaac", "SELECT DISTINCT hw_addr, CASE WHEN hw_addr LIKE 'd2%' THEN 'd0' ELSE '02' END || substr(replace(hw_addr, ':', ''), 3, 4) || 'fffe' || substr(replace(hw_addr, ':', ''), 7, 6) AS iid FROM packets")
def _(t):
    return t.packets.select("hw_addr", mac.eui64(F.col("hw_addr")).alias("iid")).distinct()


@query("f29_ra_fingerprint", "SELECT DISTINCT k, CASE WHEN ttl = 64 AND k % 2 = 0 THEN 'linux-router' WHEN ttl = 64 THEN 'generic-64' WHEN ttl = 255 THEN 'generic-255' END AS router FROM packets")
def _(t):
    exact = F.when((F.col("ttl") == 64) & (F.col("k") % 2 == 0), "linux-router")
    loose = F.when(F.col("ttl") == 64, "generic-64").when(F.col("ttl") == 255, "generic-255")
    return t.packets.select("k", F.coalesce(exact, loose).alias("router")).distinct()


_NORMAL = [("smart_tv", "tv"), ("phone", "mobile"), ("nas", "storage")]


@query("f30_type_normalise", f"SELECT mac, coalesce(n.kind, d.device_type, 'unknown') AS kind FROM devices d LEFT JOIN {oracle.values(_NORMAL, 'n(name, kind)')} ON name = d.device_type")
def _(t):
    n = F.broadcast(t.spark.createDataFrame(_NORMAL, "device_type string, kind string"))  # a fixed map
    return t.devices.join(n, "device_type", "left").select("mac", F.coalesce("kind", "device_type", F.lit("unknown")).alias("kind"))


@query("f31_connection_type", "SELECT mac, CASE WHEN device_type IN ('printer', 'router', 'server', 'nas') THEN 'wired' WHEN mac LIKE 'd2%' THEN 'wireless' WHEN device_type = 'phone' THEN 'wireless' ELSE 'unknown' END AS connection FROM devices")
def _(t):
    wired = F.col("device_type").isin("3d_printer", "access_point", "firewall", "gateway", "hypervisor", "load_balancer", "nas", "pbx", "pdu", "plc", "printer", "router", "server", "switch", "ups", "voip_phone")
    radio = F.col("device_type").isin("mobile", "phone", "smartphone", "tablet", "wearable", "iot", "camera", "thermostat")
    return t.devices.select("mac", F.when(wired, "wired").when(mac.randomized(F.col("mac")), "wireless").when(radio, "wireless").otherwise("unknown").alias("connection"))


@query("f32_confidence_scale", "SELECT packet_id, round(CASE WHEN value > 1 THEN value / 100 ELSE value END, 6) AS confidence FROM packets")
def _(t):
    return t.packets.select("packet_id", F.round(F.when(F.col("value") > 1, F.col("value") / 100).otherwise(F.col("value")), 6).alias("confidence"))


_RANGES = [("2.4", 0, 25, "old"), ("3.x", 26, 50, "mid"), ("5.x", 51, 99, "new")]


@query("f33_kernel_range", f"SELECT DISTINCT k, name, age FROM packets JOIN {oracle.values(_RANGES, 'r(name, low, high, age)')} ON k BETWEEN low AND high")
def _(t):
    r = F.broadcast(t.spark.createDataFrame(_RANGES, "name string, low int, high int, age string"))  # a fixed table
    return t.packets.select("k").distinct().join(r, F.col("k").between(F.col("low"), F.col("high"))).select("k", "name", "age")


@query("f35_json", "SELECT event_id, (props::JSON->>'k')::INT AS k FROM events")
def _(t):
    return t.raw("events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("f36_messages", "SELECT id, left(upper(severity) || ': ' || message, 40) AS title FROM findings")
def _(t):
    return t.findings.select("id", F.left(F.format_string("%s: %s", F.upper("severity"), F.col("message")), F.lit(40)).alias("title"))


@query("f37_incident_subtype", "SELECT id, CASE rule WHEN 'mac_spoofing' THEN 'spoofing' WHEN 'addr_conflict' THEN 'conflict' ELSE CASE WHEN contains(lower(message), 'shift') THEN 'identity' WHEN contains(lower(message), 'host') THEN 'inventory' ELSE 'other' END END AS subtype FROM findings")
def _(t):
    text = F.lower("message")
    by_word = F.when(text.contains("shift"), "identity").when(text.contains("host"), "inventory").otherwise("other")
    return t.findings.select("id", F.when(F.col("rule") == "mac_spoofing", "spoofing").when(F.col("rule") == "addr_conflict", "conflict").otherwise(by_word).alias("subtype"))


@query("f38_redaction", "SELECT DISTINCT k, 'user=u' || k || ' token=***; api_key: ***' AS line FROM packets")
def _(t):
    raw = F.concat(F.lit("user=u"), F.col("k").cast("string"), F.lit(" token="), F.md5(F.col("k").cast("string")), F.lit("; api_key: "), F.sha1(F.col("k").cast("string")))
    return t.packets.select("k", names.redacted(raw).alias("line")).distinct()


_LADDER = "list_extract([60, 120, 240, 480, 960, 1920, 3600], least(7, level)::INT)"


@query("f39_backoff", f"""WITH a AS (SELECT *, sum(CASE WHEN failed THEN 0 ELSE 1 END) OVER (PARTITION BY importer ORDER BY us, id) AS run FROM (SELECT o_custkey AS importer, epoch_us(o_orderdate) AS us, o_orderkey AS id, o_orderstatus = 'F' AS failed FROM orders)),
  b AS (SELECT *, CASE WHEN failed THEN row_number() OVER (PARTITION BY importer, run ORDER BY us, id) - (CASE WHEN run > 0 THEN 1 ELSE 0 END) ELSE 0 END AS level FROM a),
  c AS (SELECT *, CASE WHEN level > 0 THEN {_LADDER} ELSE 300 END AS base, ('0x' || substr(md5(importer || ':' || id), 1, 8))::BIGINT AS chance FROM b)
  SELECT id, least(7, level)::INT AS level, greatest(1, base + chance % (2 * (base // 5) + 1) - base // 5)::BIGINT AS seconds FROM c""")
def _(t):
    runs = t.raw("orders").select(F.col("o_custkey").alias("importer"), micros(F.col("o_orderdate")).alias("us"), F.col("o_orderkey").alias("id"), (F.col("o_orderstatus") == "F").alias("failed"))
    return lifecycle.backoff(runs, "importer", ["us", "id"], F.lit(300)).select("id", "level", "seconds")


_SUFFIX = [(0, "workstation"), (32, "server"), (27, "domain_master")]


@query("f40_code_maps", f"SELECT DISTINCT k, coalesce(name, 'unknown') AS name FROM packets LEFT JOIN {oracle.values(_SUFFIX, 's(code, name)')} ON code = k")
def _(t):
    code = F.create_map(*[F.lit(x) for row in _SUFFIX for x in row])
    return t.packets.select("k", F.coalesce(F.try_element_at(code, F.col("k")), F.lit("unknown")).alias("name")).distinct()


@query("t05_threshold", "SELECT mac, CASE WHEN threshold <> 300 THEN threshold WHEN device_type = 'printer' THEN 3600 WHEN device_type IN ('phone', 'smart_tv') OR mac LIKE 'd2%' THEN 1800 ELSE 300 END::INT AS seconds FROM devices")
def _(t):
    return t.devices.select("mac", detect.offline_threshold(F.col("threshold"), F.col("device_type"), mac.local_bit(F.col("mac"))).cast("int").alias("seconds"))
