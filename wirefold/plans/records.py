"""Payload decoders and record operators over payloads made of packet keys.

Spark builds each payload's bytes and decodes them; the SQL states the fields
straight from the keys, so no table of the decoders is on both sides.
"""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..operators import field_evidence
from ..operators import records as R
from ..sources.adapters import pick
from ..sources.decoders import decoded
from .base import query

K, U, NAME, HOST = "k", "user_id", "query_name", "concat('HOST-', k)"


def n(value: str, size: int = 1) -> str:
    """Big-endian bytes of a number, as hexadecimal text (a Spark expression)."""
    return f"lpad(hex(cast({value} AS bigint)), {2 * size}, '0')"


def size(text: str, more: int = 0, bytes_: int = 1) -> str:
    return n(f"length({text}) + {more}", bytes_)


def hexed(text: str) -> str:
    return f"hex({text})"


def labels(name: str) -> str:
    return f"concat(array_join(transform(split({name}, '[.]'), x -> concat({size('x')}, hex(x))), ''), '00')"


def zeros(count: int) -> str:
    return "00" * count


def _bootp(kind: str, server: str) -> list[str]:
    opt60 = f"CASE WHEN opt60 IS NOT NULL THEN concat('3c', {size('opt60')}, hex(opt60)) ELSE '' END"
    return ["01010600", zeros(12), "0a00", n("k % 4"), n("k % 20 + 1"), server, zeros(4), "001a2b", n(U, 3), zeros(202), "63825363", "3501", n(kind), "3703010306", opt60, "ff"]


_SWITCH, _CLIENT, _COMMUNITY = "concat('sw', k)", "concat('dev-', k)", "concat('c', k)"
_DESCRIPTION = "element_at(array('US-8-150W, 7.2.123, Linux 3.6.5', 'Cisco IOS Software', 'RouterOS 7', 'plain', 'UAP-AC-Pro, 6.5', 'Juniper Junos 21'), cast(user_id % 6 + 1 AS int))"
_SNI = f"concat('0000', {size(NAME, 5, 2)}, {size(NAME, 3, 2)}, '00', {size(NAME, 0, 2)}, hex({NAME}), '000a00040002001d', '000b00020100')"
_TARGET = [zeros(4), "fe80", zeros(12), n("user_id % 65536", 2)]

#: Hexadecimal parts of each record type's payload.
PAYLOADS: dict[str, list] = {
    "ntp": [n("user_id % 8 + 32"), n("k % 16"), "06", zeros(9), "47505330", zeros(32)],
    "igmp": ["16000000", "e000", n("k % 4"), n(K)],
    "eap": ["02", n(K), "000501"],
    "stun": ["0001", "0008", "2112a442", zeros(12)],
    "radius": ["01", n(K), "0014", zeros(16)],
    "modbus": [n(K, 2), "0000", "0006", n("user_id % 247"), "03", "0000"],
    "umas": ["00010000000a", n(K), "5a", n("user_id % 256"), "02"],
    "bacnet": ["810b", n(K, 2)],
    "coap": ["4001", n("user_id % 65536", 2)],
    "mqtt": ["1010", "0004", "4d515454", "0402003c", size(_CLIENT, 0, 2), hexed(_CLIENT)],
    "enip": ["63000400", n(K), zeros(3), zeros(16)],
    "dnp3": ["056405c0", n(K), "00", n("user_id % 256"), "00", "0000"],
    "s7comm": ["03000019", "02f080", "32", n("k % 7"), "00"],
    "opcua": ["48454c46", n(K), zeros(3)],
    "goose": [n(K, 2), "0050", zeros(4)],
    "profinet": ["fefe05", n("k % 2")],
    "icmpv6_ra": ["86000000", n(K), "c0", "0708", zeros(8)],
    "icmpv6_ns": ["87000000", *_TARGET],
    "icmpv6_na": ["88000000", "a0000000", *_TARGET[1:]],
    "icmpv6_rs": ["85", zeros(7)],
    "lldp": ["020704001a2b", n(U, 3), size(_SWITCH, 2560, 2), hexed(_SWITCH), size(_DESCRIPTION, 3072, 2), hexed(_DESCRIPTION), "0e04", "00ff", n("user_id % 256", 2), "0000"],
    "cdp": ["02b40000", "0001", size(_SWITCH, 4, 2), hexed(_SWITCH), "0006", "0012", hexed("'cisco WS-C2960'"), "000a0006", n(K, 2)],
    "stp": [zeros(5), n("user_id % 16 * 4096", 2), "001a2b", n(U, 3), n(K, 4), "8000", "001a2b", n(U, 3), zeros(12)],
    "dtp": ["01", "00020005", n("user_id % 8")],
    "dhcpv4": _bootp("k % 6 + 1", "0a000001"),
    "dhcpv6": ["01", n(U, 3), "00060004", "0017", n(K, 2), "00010004", n(U, 4), "0010000a", "00000137", "0004", "4d534654"],
    "tls": ["160301", size(NAME, 72, 2), "01", size(NAME, 68, 3), "0303", zeros(32), "00", "0004", "1301", n("k + 4866", 2), "0100", size(NAME, 23, 2), _SNI],
    "quic": ["c000000001", "00", hexed(NAME), "00"],
    "dns": [n("user_id % 65536", 2), n("k % 2 * 32768", 2), "0001000000000000", labels(NAME), "00010001"],
    "mdns": ["00008400", "0000000100000000", labels("'_ipp._tcp.local'"), "000c000100000078", size(_CLIENT, 3, 2), size(_CLIENT), hexed(_CLIENT), "c00c"],
    "llmnr": ["00010000", "0001000000000000", labels(HOST), "001c0001"],
    "netbios": [zeros(12), "20", hexed(f"translate(concat(hex(rpad({HOST}, 15, ' ')), {n('k % 2 * 32')}), '0123456789ABCDEF', 'ABCDEFGHIJKLMNOP')"), "00"],
    "snmp": ["30", size(_COMMUNITY, 6), "020101", "04", size(_COMMUNITY), hexed(_COMMUNITY), "a0"],
    "tcp_options": ["0204", n("k + 1400", 2), "0402", "080a", zeros(8), "01", "0303", n("k % 15")],
}


def built(t, kinds: list[str]):
    """Packets dealt over ``kinds`` by their key, with the bytes of a payload."""
    payload = F.lit(None).cast("string")
    protocol = pick(F.col("packet_id"), kinds)
    for kind in kinds:
        parts = ", ".join(p if re.search(r"[^0-9a-f]", p) else f"'{p}'" for p in PAYLOADS[kind])
        payload = F.when(protocol == kind, F.expr(f"concat({parts})")).otherwise(payload)
    return t.packets.select("packet_id", "us", "k", "user_id", "hw_addr", "ip_addr", F.expr("k % 2 = 0").alias("is_server"), protocol.alias("protocol"), F.unhex(payload).alias("payload"))


def made(t, kinds: list[str]):
    """``built`` packets with ``fields`` decoded from their bytes."""
    return decoded(built(t, kinds).drop("us", "k", "user_id")).drop("payload")


def rows(t, kinds: list[str]):
    return made(t, kinds).select("packet_id", "protocol", F.explode("fields").alias("name", "value"))


def fields_sql(kinds: dict[str, dict[str, str]]) -> str:
    parts = []
    for i, (kind, fields) in enumerate(kinds.items()):
        names, values = ", ".join(f"'{f}'" for f in fields), ", ".join(f"({v})::VARCHAR" for v in fields.values())
        parts.append(f"SELECT packet_id, '{kind}' AS protocol, unnest([{names}]) AS name, unnest([{values}]) AS value FROM packets WHERE packet_id % {len(kinds)} = {i}")
    return f"SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE value IS NOT NULL"


_MAC = "'00:1a:2b:' || printf('%02x', (user_id // 65536) % 256) || ':' || printf('%02x', (user_id // 256) % 256) || ':' || printf('%02x', user_id % 256)"
_V6 = "'fe80:0000:0000:0000:0000:0000:0000:' || printf('%04x', user_id % 65536)"
_DESCRIBED = "CASE user_id % 6 WHEN 0 THEN 'US-8-150W, 7.2.123, Linux 3.6.5' WHEN 1 THEN 'Cisco IOS Software' WHEN 2 THEN 'RouterOS 7' WHEN 3 THEN 'plain' WHEN 4 THEN 'UAP-AC-Pro, 6.5' ELSE 'Juniper Junos 21' END"
_MODE = "CASE user_id % 8 WHEN 1 THEN 'on' WHEN 2 THEN 'off' WHEN 3 THEN 'desirable' WHEN 4 THEN 'auto' WHEN 5 THEN 'nonegotiate' ELSE 'unknown' END"
_DHCP = {"client_mac": _MAC, "ip": "'10.0.' || (k % 4) || '.' || (k % 20 + 1)", "message_type": "k % 6 + 1", "opt55": "'1,3,6'", "opt60": "opt60", "offered_ip": "'10.0.' || (k % 4) || '.' || (k % 20 + 1)", "server_ip": "'10.0.0.1'"}

GROUPS: dict[str, dict[str, dict[str, str]]] = {
    "p02_dhcp_fields": {"dhcpv4": _DHCP},
    "p04_dhcpv6_fields": {"dhcpv6": {"message_type": "1", "oro": "'23,' || k", "duid": "printf('%08x', user_id)", "enterprise": "311", "vendor_class": "'MSFT'"}},
    "p05_syn_options": {"tcp_options": {"tcp_options": "'M,S,T,N,W'", "mss": "1400 + k", "window_scale": "k % 15"}},
    "p06_client_hello": {"tls": {
        "version": "771", "sni": "query_name", "ja3": "md5('771,4865-' || (4866 + k) || ',0-10-11,29,0')",
        "ja4": "'t12d020300_' || substr(sha256('4865,' || (4866 + k)), 1, 12) || '_' || substr(sha256('0,10,11'), 1, 12)",
    }},
    "p07_quic_name": {"quic": {"version": "'00000001'", "sni": "query_name"}},
    "p09_dns_question": {"dns": {"response": "k % 2", "query_name": "query_name", "query_type": "1"}},
    "p11_mdns_answers": {"mdns": {"response": "1", "answers": "'12 _ipp._tcp.local dev-' || k || '._ipp._tcp.local'"}},
    "p13_local_names": {"llmnr": {"response": "0", "query_name": "'HOST-' || k", "query_type": "28"}, "netbios": {"name": "'HOST-' || k", "suffix": "k % 2 * 32"}},
    "p16_link_layer": {
        "lldp": {"chassis": _MAC, "system_name": "'sw' || k", "system_description": _DESCRIBED, "capabilities": "user_id % 256"},
        "cdp": {"device_id": "'sw' || k", "platform": "'cisco WS-C2960'", "native_vlan": "k"},
        "stp": {"version": "0", "bpdu_type": "0", "root_priority": "user_id % 16 * 4096", "root_mac": _MAC, "root_cost": "k", "bridge_priority": "32768", "bridge_mac": _MAC},
        "dtp": {"mode": _MODE, "negotiating": "CASE WHEN user_id % 8 IN (3, 4) THEN 'true' ELSE 'false' END"},
    },
    "p17_snmp_community": {"snmp": {"version": "'2c'", "community": "'c' || k"}},
    "p18_neighbour_discovery": {"icmpv6_ra": {"hop_limit": "k", "flags": "192", "lifetime": "1800"}, "icmpv6_ns": {"target": _V6}, "icmpv6_na": {"flags": "160", "target": _V6}, "icmpv6_rs": {"type": "133"}},
    "p19_small_records": {
        "igmp": {"type": "22", "group": "'224.0.' || (k % 4) || '.' || k"}, "eap": {"code": "2", "identifier": "k", "length": "5", "type": "1"}, "stun": {"type": "1", "length": "8"},
        "radius": {"code": "1", "identifier": "k", "length": "20"}, "ntp": {"flags": "user_id % 8 + 32", "stratum": "k % 16", "poll": "6", "reference": "'GPS0'"},
    },
    "p20_control_protocols": {
        "modbus": {"transaction": "k", "length": "6", "unit_id": "user_id % 247", "function_code": "3"}, "umas": {"unit_id": "k", "session": "user_id % 256", "umas_code": "2"},
        "bacnet": {"function": "11", "length": "k"}, "coap": {"header": "64", "code": "1", "message_id": "user_id % 65536"}, "mqtt": {"packet_type": "1", "protocol": "'MQTT'", "client_id": "'dev-' || k"},
        "enip": {"command": "99", "length": "4", "session": "k", "status": "0"}, "dnp3": {"length": "5", "control": "192", "destination": "k", "source": "user_id % 256"},
        "s7comm": {"length": "25", "pdu_type": "k % 7"}, "opcua": {"message": "'HEL'", "size": "k"}, "goose": {"app_id": "k", "length": "80"},
        "profinet": {"frame_id": "65278", "service_id": "5", "service_type": "k % 2"},
    },
}

for _name, _kinds in GROUPS.items():
    query(_name, fields_sql(_kinds))(lambda t, kinds=list(_kinds): rows(t, kinds))


@query("p03_dhcp_server", f"SELECT packet_id, hw_addr, '10.0.0.1' AS server_ip, {_MAC} AS client_mac, {_DHCP['ip']} AS offered_ip FROM packets WHERE k % 6 + 1 IN (2, 5)")
def _(t):
    return R.dhcp_servers(made(t, ["dhcpv4"]))


@query("p14_upnp", """SELECT packet_id, hw_addr, CASE k % 3 WHEN 0 THEN 5000 WHEN 1 THEN 80 ELSE 8080 END AS dst_port, 'GET /' || k || ' HTTP/1.1 ST: upnp:RootDevice' AS payload_preview
  FROM packets WHERE k % 3 <> 1 AND user_id % 2 = 0""")
def _(t):
    line = F.concat(F.lit("GET /"), F.col("k").cast("string"), F.lit(" HTTP/1.1 "), F.when(F.col("user_id") % 2 == 0, "ST: upnp:RootDevice").otherwise("Host: x"))
    p = t.packets.select("packet_id", "hw_addr", pick(F.col("k"), [5000, 80, 8080]).alias("port"), F.lit(40000).alias("source_port"), line.alias("text"))
    return R.upnp(p)


@query("p15_ws_discovery", """SELECT packet_id, hw_addr, CASE WHEN k % 3 = 0 THEN 'hello' ELSE 'probe_match' END AS action, CASE WHEN k % 2 = 0 THEN ['printer', 'computer'] ELSE ['computer'] END AS device_types,
  CASE k % 4 WHEN 0 THEN 'Maker' || k WHEN 1 THEN 'HP' END AS manufacturer, CASE WHEN k % 5 = 0 THEN 'M1' END AS model, NULL::VARCHAR AS firmware, ['http://' || ip_addr || '/'] AS xaddrs
  FROM packets WHERE k % 3 <> 2 AND k % 7 <> 0""")
def _(t):
    k = F.col("k")
    action = pick(F.col("k"), ["Hello", "ProbeMatches", "Bye"])
    types = F.when(k % 2 == 0, "wsdp:Device wprt:PrinterServiceType wsdp:Device").otherwise("wsdp:Device")
    types = F.when(k % 2 == 0, F.concat(F.lit("wprt:PrinterServiceType "), types)).otherwise(types)
    maker = F.when(k % 4 == 0, F.concat(F.lit("<pnp:Manufacturer> Maker"), k.cast("string"), F.lit(" </pnp:Manufacturer>"))).when(k % 4 == 1, "<d:Scopes>ldap:x http://s/manufacturer/HP/</d:Scopes>").otherwise("")
    text = F.concat(
        F.lit('<?xml version="1.0"?><s:Envelope><s:Header><a:Action>http://x/'), action, F.lit('</a:Action></s:Header><s:Body><d:Types a="b">'), types, F.lit("</d:Types>"), maker,
        F.when(k % 5 == 0, "<pnp:ModelName>M1</pnp:ModelName>").otherwise(""), F.lit("<d:XAddrs>http://"), F.col("ip_addr"), F.lit("/</d:XAddrs></s:Body>"), F.when(k % 7 != 0, "</s:Envelope>").otherwise(""),
    )
    return R.ws_discovery(t.packets.select("packet_id", "hw_addr", text.alias("text")))


@query("p21_watched_banners", "SELECT packet_id, hw_addr, CASE port WHEN 22 THEN 'ssh' WHEN 21 THEN 'ftp' WHEN 23 THEN 'telnet' WHEN 1883 THEN 'mqtt' WHEN 3306 THEN 'mysql' END AS service, port AS server_port, banner AS raw_banner FROM packets WHERE port IN (22, 21, 23, 1883, 3306)")
def _(t):
    return R.watched_services(t.packets.select("packet_id", "hw_addr", F.col("port").alias("source_port"), F.col("banner").alias("text")))


_BITS = "CASE WHEN user_id & 16 <> 0 THEN 'router' WHEN user_id & 6 <> 0 THEN 'switch' WHEN user_id & 8 <> 0 THEN 'access_point' WHEN user_id & 32 <> 0 THEN 'voip_phone' WHEN user_id & 64 <> 0 THEN 'cable_modem' WHEN user_id & 128 <> 0 THEN 'endpoint' END"
_LINK = list(GROUPS["p16_link_layer"])


@query("e04_link_layer_evidence", f"""
  SELECT packet_id, hw_addr, 'lldp' AS source, CASE WHEN category = 'endpoint' THEN 0.6 ELSE 0.9 END::DOUBLE AS certainty, category,
         CASE user_id % 6 WHEN 0 THEN 'Ubiquiti' WHEN 1 THEN 'Cisco' WHEN 2 THEN 'MikroTik' WHEN 4 THEN 'Ubiquiti' WHEN 5 THEN 'Juniper' END AS vendor,
         CASE user_id % 6 WHEN 0 THEN 'Linux' WHEN 1 THEN 'IOS' WHEN 2 THEN 'RouterOS' WHEN 5 THEN 'Junos' END AS platform,
         CASE user_id % 6 WHEN 0 THEN 'US-8-150W' WHEN 4 THEN 'UAP-AC-Pro' ELSE 'sw' || k END AS model, 'sw' || k AS hostname
  FROM (SELECT *, CASE user_id % 6 WHEN 0 THEN 'switch' WHEN 4 THEN 'access_point' ELSE {_BITS} END AS category FROM packets WHERE packet_id % 4 = 0)
  UNION ALL SELECT packet_id, hw_addr, 'cdp', 0.92, NULL, 'Cisco', NULL, 'WS-C2960', NULL FROM packets WHERE packet_id % 4 = 1
  UNION ALL SELECT packet_id, hw_addr, 'stp', CASE WHEN user_id % 16 = 8 THEN 0.25 ELSE 0.2 END, 'switch', NULL, NULL, NULL, NULL FROM packets WHERE packet_id % 4 = 2
  UNION ALL SELECT packet_id, hw_addr, 'dtp', 0.9, 'switch', NULL, NULL, NULL, NULL FROM packets WHERE packet_id % 4 = 3""")
def _(t):
    return R.infrastructure(made(t, _LINK))


_CONTROL = list(GROUPS["p20_control_protocols"])


@query("e05_control_evidence", """SELECT packet_id, hw_addr, source, CASE source WHEN 'modbus' THEN 0.6 WHEN 'bacnet' THEN 0.65 WHEN 'coap' THEN 0.5 WHEN 'mqtt' THEN 0.55 WHEN 'enip' THEN 0.65 WHEN 'dnp3' THEN 0.75
    WHEN 's7comm' THEN 0.8 WHEN 'opcua' THEN CASE WHEN serves THEN 0.75 ELSE 0.5 END WHEN 'goose' THEN 0.85 WHEN 'profinet' THEN 0.8 WHEN 'umas' THEN 0.85 END::DOUBLE AS certainty,
    CASE WHEN source IN ('modbus', 'enip', 'goose') THEN 'ics_device' WHEN source = 'bacnet' THEN 'building_automation' WHEN source IN ('coap', 'mqtt') THEN 'iot_device' WHEN source = 'profinet' THEN 'plc'
      WHEN source = 'dnp3' THEN CASE WHEN serves THEN 'rtu' ELSE 'scada_server' END WHEN source = 'opcua' THEN CASE WHEN serves THEN 'scada_server' ELSE 'opcua_client' END
      WHEN serves THEN 'plc' ELSE 'scada_server' END AS category,
    CASE source WHEN 's7comm' THEN 'Siemens' WHEN 'umas' THEN 'Schneider Electric' END AS vendor, CASE WHEN source = 'umas' THEN 'Unity' END AS platform, NULL::VARCHAR AS model, NULL::VARCHAR AS hostname
  FROM (SELECT *, k % 2 = 0 AS serves, list_extract(['modbus', 'umas', 'bacnet', 'coap', 'mqtt', 'enip', 'dnp3', 's7comm', 'opcua', 'goose', 'profinet'], (packet_id % 11 + 1)::INT) AS source FROM packets)""")
def _(t):
    return R.industrial(made(t, _CONTROL))


@query("e08_server_evidence", """SELECT packet_id, hw_addr, 'dhcp_server' AS source, 0.55::DOUBLE AS certainty, 'infrastructure' AS category, NULL::VARCHAR AS vendor, NULL::VARCHAR AS platform, NULL::VARCHAR AS model, NULL::VARCHAR AS hostname
    FROM packets WHERE packet_id % 3 = 0 AND k % 6 IN (1, 4)
  UNION ALL SELECT packet_id, hw_addr, 'dns_server', 0.4, NULL, NULL, NULL, NULL, NULL FROM packets WHERE packet_id % 3 = 1 AND k % 2 = 1
  UNION ALL SELECT packet_id, hw_addr, 'ntp', 0.3, NULL, NULL, NULL, NULL, NULL FROM packets WHERE packet_id % 3 = 2 AND user_id % 8 IN (3, 4, 5)""")
def _(t):
    return R.server_roles(made(t, ["dhcpv4", "dns", "ntp"]))


@query("e11_learned_gateways", """SELECT DISTINCT hw_addr, CASE WHEN packet_id % 2 = 0 THEN 'dhcp_server' ELSE 'icmpv6' END AS source, 'router' AS category, 0.95::DOUBLE AS certainty
  FROM packets WHERE packet_id % 2 = 1 OR k % 6 IN (1, 4)""")
def _(t):
    return R.gateways_learned(made(t, ["dhcpv4", "icmpv6_ra"]))


_EVIDENT = ["dhcpv4", "dhcpv6", "icmpv6_ra", "igmp", "eap", "tls", "stun", "quic", "radius", "dns", "netbios", "http_useragent", "tcp_syn", "arp", "upnp", "ssdp"]
#: Record type: (condition, source, method, certainty, category, vendor, platform, hostname) in SQL.
_STATES = {
    "dhcpv4": [("opt60 IS NOT NULL", "dhcpv4_vendor", "pattern", 0.8), ("true", "dhcpv4_fingerprint", "pattern", 0.7)],
    "dhcpv6": [("true", "dhcpv6_vendor", "pattern", 0.8), ("true", "dhcpv6_oro", "pattern", 0.65), ("true", "dhcpv6", "exact", 0.7), ("true", "dhcpv6", "exact", 0.65)],
    "icmpv6_ra": [("true", "icmpv6_ra", "heuristic", 0.5, "'router'")], "igmp": [("true", "igmp", "heuristic", 0.4)], "eap": [("true", "eap", "exact", 0.6)],
    "tls": [("true", "tls_ja3", "pattern", 0.75), ("true", "tls_ja4", "pattern", 0.75), ("true", "tls_sni", "exact", 0.7)], "stun": [("true", "stun", "heuristic", 0.5)],
    "quic": [("true", "quic_sni", "exact", 0.65)], "radius": [("true", "radius", "exact", 0.7)], "dns": [("true", "dns_query", "pattern", 0.4)],
    "netbios": [("true", "netbios", "exact", 0.7, "NULL", "NULL", "NULL", "'HOST-' || k")],
    "http_useragent": [("true", "http_useragent", "pattern", 0.8, "NULL", "list_extract(['Microsoft', 'Apple', 'Samsung', NULL, 'Apple', NULL], (k % 6 + 1)::INT)", "list_extract(['Windows', 'macOS', 'Android', NULL, 'macOS', 'Linux'], (k % 6 + 1)::INT)"), ("k % 2 = 0", "http_host", "pattern", 0.4)],
    "tcp_syn": [("k % 3 > 0", "tcp_syn_sig", "pattern", 0.4)], "arp": [("true", "arp", "heuristic", 0.3)], "upnp": [("true", "upnp", "pattern", 0.6)], "ssdp": [("k % 4 > 0", "ssdp_server", "pattern", 0.65)],
}


def _states_sql() -> str:
    parts = []
    for i, kind in enumerate(_EVIDENT):
        for when, source, method, sure, *more in _STATES[kind]:
            category, vendor, platform, hostname = (more + ["NULL"] * 4)[:4]
            parts.append(f"SELECT packet_id, hw_addr, '{source}' AS source, '{method}' AS method, {sure}::DOUBLE AS certainty, {category}::VARCHAR AS category, {vendor}::VARCHAR AS vendor, {platform}::VARCHAR AS platform, {hostname}::VARCHAR AS hostname FROM packets WHERE packet_id % {len(_EVIDENT)} = {i} AND {when}")
    return " UNION ALL ".join(parts)


@query("e01_e02_e03_field_evidence", _states_sql())
def _(t):
    # Records with bytes are decoded; the others state their fields.
    stated = {
        "http_useragent": {"user_agent": "user_agent", "host": "if(k % 2 = 0, query_name, '')"}, "tcp_syn": {"window_size": "if(k % 3 > 0, cast(k AS string), null)"},
        "arp": {"op": "cast(op AS string)"}, "upnp": {"path": "'/'"}, "ssdp": {"server": "if(k % 4 > 0, banner, null)"},
    }
    kinds = [k for k in _EVIDENT if k not in stated]
    number = F.col("packet_id") % len(_EVIDENT)
    payload = protocol = None
    for i, kind in enumerate(kinds):
        parts = ", ".join(p if re.search(r"[^0-9a-f]", p) else f"'{p}'" for p in PAYLOADS[kind])
        payload, protocol = (F.when(number == i, F.expr(f"concat({parts})")), F.when(number == i, kind)) if payload is None else (payload.when(number == i, F.expr(f"concat({parts})")), protocol.when(number == i, kind))
    bytes_ = decoded(t.packets.where(number < len(kinds)).select("packet_id", "hw_addr", protocol.alias("protocol"), F.unhex(payload).alias("payload"))).drop("payload")
    fields = protocol = None
    for i, (kind, some) in enumerate(stated.items(), len(kinds)):
        made_ = F.create_map(*[x for name, value in some.items() for x in (F.lit(name), F.expr(value).cast("string"))])
        fields, protocol = (F.when(number == i, made_), F.when(number == i, kind)) if fields is None else (fields.when(number == i, made_), protocol.when(number == i, kind))
    plain = t.packets.where(number >= len(kinds)).select("packet_id", "hw_addr", protocol.alias("protocol"), fields.alias("fields"))
    return field_evidence.evidence(bytes_.unionByName(plain))
