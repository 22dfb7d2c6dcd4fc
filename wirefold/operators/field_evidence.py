"""Identity evidence from decoded fields: one pass over all record types.

A record gives zero or more evidence rows; each is a struct that is null where
it does not apply, and the structs of a record are exploded.  All native.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names

SHAPE = {"source": "string", "method": "string", "certainty": "double", "category": "string", "vendor": "string", "platform": "string", "hostname": "string"}
_MAC = r"^([0-9a-fA-F]{2}:){5}[0-9a-fA-F]{2}$"
# Vendor names that a client identifier may hold.
CLIENT_VENDORS = ["dell", "hp", "lenovo", "apple", "cisco", "huawei", "samsung", "intel", "broadcom"]
# What a User-Agent says, first match; and the makers of Android devices.
AGENTS = [(["windows"], "Windows", "Microsoft"), (["macintosh", "mac os"], "macOS", "Apple"), (["iphone", "ipad"], "iOS", "Apple"), (["android"], "Android", None), (["linux"], "Linux", None), (["cros"], "ChromeOS", "Google")]
ANDROID = [
    (["pixel", "nexus"], "Google"), (["sm-", "samsung"], "Samsung"), (["xiaomi", "redmi", "poco"], "Xiaomi"), (["oneplus"], "OnePlus"), (["motorola", "moto ", "moto/"], "Motorola"),
    (["huawei", "honor"], "Huawei"), (["oppo"], "OPPO"), (["vivo"], "Vivo"),
]


def _holds(text: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def user_agent(text: Column) -> tuple[Column, Column]:
    """Platform and vendor of a User-Agent."""
    low = F.lower(text)
    android = maker = None
    for words, name in ANDROID:
        maker = F.when(_holds(low, words), name) if maker is None else maker.when(_holds(low, words), name)
    platform = vendor = None
    for words, system, name in AGENTS:
        who = maker if system == "Android" else F.lit(name)
        android = _holds(low, words)
        platform = F.when(android, system) if platform is None else platform.when(android, system)
        vendor = F.when(android, who) if vendor is None else vendor.when(android, who)
    return platform, vendor


def _one(when: Column, source: str, method: str, certainty: Column | float, **stated: Column | str) -> Column:
    known = {"source": source, "method": method, "certainty": certainty} | stated
    value = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.when(when, F.struct(*[value(known.get(n)).cast(k).alias(n) for n, k in SHAPE.items()]))


def _records(f) -> dict[str, list[Column]]:
    """Evidence of each record type; ``f`` gives a field by name."""
    has = lambda name: f(name).isNotNull() & (f(name) != "")
    always = F.lit(True)
    valid = lambda name: has(name) & F.coalesce(names.valid_hostname(f(name)), F.lit(False))
    client = F.lower(f("client_id"))
    told = ~f("client_id").rlike(_MAC) & _holds(client, CLIENT_VENDORS)
    streams = f("group").startswith("239.") & ~f("group").startswith("239.255.255.")
    platform, vendor = user_agent(f("user_agent"))
    return {
        "arp": [_one(always, "arp", "heuristic", 0.3)],
        "dhcpv4": [
            _one(valid("hostname"), "dhcpv4", "exact", 0.75, hostname=f("hostname")), _one(has("opt60"), "dhcpv4_vendor", "pattern", 0.80), _one(has("opt55"), "dhcpv4_fingerprint", "pattern", 0.70),
            _one(has("client_id"), "dhcpv4", "exact", 0.70, vendor=F.when(told, f("client_id"))),
        ],
        "dhcpv6": [
            _one(has("vendor_class"), "dhcpv6_vendor", "pattern", 0.80), _one(has("oro"), "dhcpv6_oro", "pattern", 0.65), _one(has("fqdn"), "dhcpv6", "exact", 0.75, hostname=f("fqdn")),
            _one(has("enterprise"), "dhcpv6", "exact", 0.70), _one(has("duid"), "dhcpv6", "exact", 0.65),
        ],
        "icmpv6_ra": [_one(always, "icmpv6_ra", "heuristic", 0.50, category="router")],
        "igmp": [_one(always, "igmp", "heuristic", F.when(streams, 0.30).otherwise(0.40), category=F.when(streams, "media_device"))],
        "eap": [_one(always, "eap", "exact", 0.60, hostname=F.when(valid("identity"), f("identity")))],
        "tcp_syn": [_one(has("window_size"), "tcp_syn_sig", "pattern", 0.40)],
        "tls": [_one(has("ja3"), "tls_ja3", "pattern", 0.75), _one(has("ja4"), "tls_ja4", "pattern", 0.75), _one(has("sni"), "tls_sni", "exact", 0.70)],
        "http_useragent": [_one(has("user_agent"), "http_useragent", "pattern", 0.80, platform=platform, vendor=vendor), _one(has("host"), "http_host", "pattern", 0.40)],
        "stun": [_one(always, "stun", "heuristic", 0.50)],
        "quic": [_one(always, "quic_sni", "exact", 0.65)],
        "radius": [_one(always, "radius", "exact", 0.70, category=F.when(f("is_server") == "true", "server"))],
        "dns": [_one(has("query_name"), "dns_query", "pattern", 0.40)],
        "netbios": [_one(has("name"), "netbios", "exact", 0.70, hostname=f("name"))],
        "upnp": [_one(always, "upnp", "pattern", 0.60)],
        "ssdp": [_one(has("server"), "ssdp_server", "pattern", 0.65)],
    }


def evidence(records: DataFrame) -> DataFrame:
    """packet_id, hw_addr and SHAPE of all records with ``protocol`` and ``fields`` (a map).

    Unknown types, null fields and null addresses give nothing.
    """
    every = F.lit(None)
    known = _records(lambda name: F.col("fields")[name])
    for i, (protocol, some) in enumerate(known.items()):
        listed = F.filter(F.array(*some), lambda e: e.isNotNull())
        every = F.when(F.col("protocol") == protocol, listed) if i == 0 else every.when(F.col("protocol") == protocol, listed)
    rows = records.where("fields IS NOT NULL AND hw_addr IS NOT NULL")
    return rows.select("packet_id", "hw_addr", F.explode(every).alias("_e")).select("packet_id", "hw_addr", "_e.*")
