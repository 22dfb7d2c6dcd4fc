"""Typed records of discovery, server and control protocols, and their evidence.

Inputs are packets with a text payload or the decoded ``fields`` map; all steps
are native column expressions.  Missing or broken fields give null, never an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Ports and words of device description requests.
UPNP_PORTS = [2869, 5000, 49152, 49153, 49154, 49155, 8008, 8443, 8080]
UPNP_WORDS = ["upnp", "urn:schemas-upnp-org", "rootdevice", "wanipconnection", "wanpppconnection", "internetgateway", "mediarenderer", "mediaserver", "contentdirectory"]

# Local names of announced types and the device type they mean.
ANNOUNCED = {"printerservicetype": "printer", "scannerservicetype": "scanner", "device": "computer", "computer": "computer", "networkdevice": "network_device"}
MAX_XML = 65536

# Services and the ports on which their greetings are watched.
WATCHED = {
    "ssh": [22], "ftp": [21], "telnet": [23], "smtp": [25, 587], "pop3": [110], "imap": [143], "vnc": [5900, 5901, 5902, 5903], "irc": [6667, 6697],
    "mysql": [3306], "postgresql": [5432], "mssql": [1433], "mongodb": [27017], "redis": [6379], "smb": [445, 139], "rdp": [3389],
    "ipp": [631], "jetdirect": [9100], "lpd": [515], "mqtt": [1883, 8883], "amqp": [5672], "sip": [5060, 5061], "rtsp": [554, 7447, 8554],
    "unifiprotect": [7443, 7444], "ldap": [389, 636], "cassandra": [9042], "elasticsearch": [9200], "dockerapi": [2375, 2376], "kubernetesapi": [6443],
    "socks": [1080, 1081], "bgp": [179], "pptp": [1723],
}
MAX_BANNER = 2048


def field(name: str) -> Column:
    return F.element_at("fields", name)


def dhcp_servers(packets: DataFrame) -> DataFrame:
    """Servers seen in OFFER and ACK messages; the sender's address if the message names none."""
    server = F.coalesce(field("server_ip"), F.when(F.col("ip_addr") != "0.0.0.0", F.col("ip_addr")))
    out = packets.where(field("message_type").isin("2", "5")).withColumn("server_ip", server).where("server_ip IS NOT NULL")
    return out.select("packet_id", "hw_addr", "server_ip", field("client_mac").alias("client_mac"), F.coalesce(field("offered_ip"), F.lit("0.0.0.0")).alias("offered_ip"))


def upnp(packets: DataFrame, text: str = "text") -> DataFrame:
    """Description requests and answers on the usual ports, by words in the first 500 characters."""
    start = F.lower(F.substring(text, 1, 500))
    named = F.lit(False)
    for word in UPNP_WORDS:
        named |= start.contains(word)
    ports = F.col("port").isin(UPNP_PORTS) | F.col("source_port").isin(UPNP_PORTS)
    return packets.where(ports & named).select("packet_id", "hw_addr", F.col("port").alias("dst_port"), F.substring(text, 1, 200).alias("payload_preview"))


def _element(text: str, name: str) -> Column:
    found = F.trim(F.regexp_extract(text, rf"<(?:[\w.-]+:)?{name}(?:\s[^>]*)?>([^<]*)</", 1))
    return F.when(found != "", found)


def ws_discovery(packets: DataFrame, text: str = "text") -> DataFrame:
    """Announcements (hello, probe_match) with types, maker, model, firmware and endpoints.

    Rows without an action, or with neither types nor maker nor model, are left
    out, and so are texts that are no closed envelope or exceed ``MAX_XML``.
    """
    closed = F.col(text).rlike(r"(?s)^\s*<.*</(?:[\w.-]+:)?Envelope>\s*$") & (F.length(text) <= MAX_XML)
    action = F.lower(_element(text, "Action"))
    named = F.split(F.lower(F.coalesce(_element(text, "Types"), F.lit(""))), r"\s+")
    kinds = F.transform(named, lambda x: F.array_compact(F.array(*[F.when(x.contains(part), F.lit(kind)) for part, kind in ANNOUNCED.items()])))
    first = F.array_distinct(F.flatten(F.transform(kinds, lambda x: F.slice(x, 1, 1))))
    scopes = F.split(F.coalesce(_element(text, "Scopes"), F.lit("")), r"\s+")
    maker = F.try_element_at(F.filter(scopes, lambda x: F.lower(x).contains("manufacturer")), F.lit(-1))
    maker = F.element_at(F.split(F.regexp_replace(maker, "/+$", ""), "/"), -1)
    out = packets.where(closed).select(
        "packet_id", "hw_addr", F.when(action.contains("hello"), "hello").when(action.contains("probematch"), "probe_match").alias("action"),
        first.alias("device_types"), F.coalesce(_element(text, "Manufacturer"), maker).alias("manufacturer"), _element(text, "ModelName").alias("model"),
        _element(text, "FirmwareVersion").alias("firmware"), F.filter(F.split(F.coalesce(_element(text, "XAddrs"), F.lit("")), r"\s+"), lambda x: x != "").alias("xaddrs"),
    )
    return out.where("action IS NOT NULL AND (size(device_types) > 0 OR manufacturer IS NOT NULL OR model IS NOT NULL)")


def watched_services(packets: DataFrame, text: str = "text") -> DataFrame:
    """Greetings that servers send from watched ports, with the port's service."""
    rows = [(p, s) for s, ports in WATCHED.items() for p in ports]
    ports = F.broadcast(packets.sparkSession.createDataFrame(rows, "source_port int, service string"))  # a fixed table
    seen = packets.where(F.length(text) > 0).join(ports, "source_port")
    return seen.select("packet_id", "hw_addr", "service", F.col("source_port").alias("server_port"), F.substring(text, 1, MAX_BANNER).alias("raw_banner"))


# Words of a system description (any of them), vendor and platform;
# the first line that fits counts.
DESCRIBED = [
    (["cisco nx-os"], "Cisco", "NX-OS"), (["cisco ios"], "Cisco", "IOS"), (["junos"], "Juniper", "Junos"), (["linux"], None, "Linux"), (["windows"], None, "Windows"),
    (["aruba"], "Aruba", "ArubaOS"), (["extreme"], "Extreme", None), (["fortinet", "fortigate"], "Fortinet", "FortiOS"), (["mikrotik", "routeros"], "MikroTik", "RouterOS"),
]
# Bits of the capability field by priority, and what they mean.
CAPABILITIES = [(16, "router"), (4 | 2, "switch"), (8, "access_point"), (32, "voip_phone"), (64, "cable_modem"), (128, "endpoint")]
# Model names at the start of a description and their device type.
UBIQUITI = [(r"^(usw?-|us8|us16|us24|us48)", "switch"), (r"^(uap|u6|u7|nanohd|flexhd|beaconhd)", "access_point"), (r"^(udm|ucg|udr|usg|edgerouter)", "router")]


def _first(cases: list[tuple[Column, str | None]], otherwise: Column | None = None) -> Column:
    out = F.lit(None).cast("string") if otherwise is None else otherwise
    for met, value in reversed(cases):
        out = F.when(met, F.lit(value).cast("string")).otherwise(out)
    return out


def _evidence(df: DataFrame, certainty: Column, **known: Column) -> DataFrame:
    some = [known.get(c, F.lit(None)).cast("string").alias(c) for c in ("category", "vendor", "platform", "model", "hostname")]
    return df.select("packet_id", "hw_addr", F.col("protocol").alias("source"), certainty.cast("double").alias("certainty"), *some)


def infrastructure(records: DataFrame) -> DataFrame:
    """Evidence of link-layer, spanning-tree and trunk records, one row each."""
    of = lambda name: F.col("protocol") == name
    bits, text = field("capabilities").try_cast("int"), F.lower(field("system_description"))
    model = F.trim(F.element_at(F.split(field("system_description"), ","), 1))
    unifi = _first([(F.lower(model).rlike(p), c) for p, c in UBIQUITI])
    hit = [(F.coalesce(F.exists(F.array(*map(F.lit, words)), lambda w: text.contains(w)), F.lit(False)), v, p) for words, v, p in DESCRIBED]
    kind = F.coalesce(unifi, _first([(bits.bitwiseAND(F.lit(b)) != 0, c) for b, c in CAPABILITIES]))
    name = F.when(field("system_name") != "", field("system_name"))
    version, device = F.lower(field("version")), F.lower(field("platform"))
    os = F.when(version.contains("ios-xe"), "IOS-XE").when(version.contains("ios") & version.contains("cisco"), "IOS").when(version.contains("nx-os"), "NX-OS").when(version.contains("asa") | version.contains("adaptive security"), "ASA")
    priority = field("bridge_priority").try_cast("int")
    root = (field("root_mac") == field("bridge_mac")) & (field("root_priority") == field("bridge_priority"))
    tier = F.when(priority < 8192, 0.45).when(priority < 32768, 0.35).otherwise(0.2)
    return _evidence(
        records.where(F.col("protocol").isin("lldp", "cdp", "stp", "dtp") & F.col("fields").isNotNull()),
        F.when(of("lldp"), F.when(kind == "endpoint", 0.6).otherwise(0.9)).when(of("cdp"), 0.92).when(of("dtp"), 0.9).otherwise(F.when(root, F.least(F.round(tier + 0.05, 2), F.lit(0.45))).otherwise(tier)),
        category=F.when(of("lldp"), kind).when(of("stp") | of("dtp"), "switch"),
        vendor=F.when(of("lldp"), F.when(unifi.isNotNull(), "Ubiquiti").otherwise(_first([(m, v) for m, v, _ in hit]))).when(of("cdp") & device.contains("cisco"), "Cisco"),
        platform=F.when(of("lldp"), _first([(m, p) for m, _, p in hit])).when(of("cdp"), os),
        model=F.when(of("lldp"), F.when(unifi.isNotNull(), model).otherwise(name)).when(of("cdp"), F.regexp_replace(field("platform"), "^[Cc]isco ", "")),
        hostname=F.when(of("lldp"), name),
    )


# Certainty, category of a server, category of a client, vendor and platform.
INDUSTRIAL = {
    "modbus": (0.6, "ics_device", "ics_device", None, None), "bacnet": (0.65, "building_automation", "building_automation", None, None), "coap": (0.5, "iot_device", "iot_device", None, None),
    "mqtt": (0.55, "iot_device", "iot_device", None, None), "enip": (0.65, "ics_device", "ics_device", None, None), "dnp3": (0.75, "rtu", "scada_server", None, None),
    "s7comm": (0.8, "plc", "scada_server", "Siemens", None), "opcua": (0.75, "scada_server", "opcua_client", None, None), "goose": (0.85, "ics_device", "ics_device", None, None),
    "profinet": (0.8, "plc", "plc", None, None), "umas": (0.85, "plc", "scada_server", "Schneider Electric", "Unity"),
}
OPCUA_CLIENT = 0.5


def industrial(records: DataFrame) -> DataFrame:
    """Evidence of the eleven control protocols; ``is_server`` tells listeners from askers."""
    kinds = records.sparkSession.createDataFrame([(k, *v) for k, v in INDUSTRIAL.items()], "protocol string, sure double, server string, client string, maker string, os string")
    r = records.where("fields IS NOT NULL").join(F.broadcast(kinds), "protocol")  # a fixed table
    server = F.coalesce("is_server", F.lit(False))
    sure = F.when((F.col("protocol") == "opcua") & ~server, OPCUA_CLIENT).otherwise(F.col("sure"))
    return _evidence(r, sure, category=F.when(server, F.col("server")).otherwise(F.col("client")), vendor=F.col("maker"), platform=F.col("os"))


def server_roles(records: DataFrame) -> DataFrame:
    """Weak evidence of serving addresses, names or time; only the first names a category."""
    mode = field("flags").try_cast("int").bitwiseAND(F.lit(7))
    serves = F.col("protocol")
    dhcp, dns, ntp = (serves == "dhcpv4") & field("message_type").isin("2", "5"), (serves == "dns") & (field("response") == "1"), (serves == "ntp") & mode.isin(3, 4, 5)
    out = records.withColumn("protocol", F.when(dhcp, "dhcp_server").when(dns, "dns_server").when(ntp, "ntp")).where("protocol IS NOT NULL")
    sure = F.when(F.col("protocol") == "dhcp_server", 0.55).when(F.col("protocol") == "dns_server", 0.4).otherwise(0.3)
    return _evidence(out, sure, category=F.when(F.col("protocol") == "dhcp_server", "infrastructure"))


def gateways_learned(records: DataFrame) -> DataFrame:
    """Addresses that offer leases or advertise routes are routers."""
    offer = (F.col("protocol") == "dhcpv4") & field("message_type").isin("2", "5")
    advert = (F.col("protocol") == "icmpv6_ra") & F.col("fields").isNotNull()
    source = F.when(offer, "dhcp_server").when(advert, "icmpv6")
    out = records.where(F.col("ip_addr").isNotNull()).select("hw_addr", source.alias("source")).where("source IS NOT NULL").distinct()
    return out.select("hw_addr", "source", F.lit("router").alias("category"), F.lit(0.95).alias("certainty"))
