"""Hostname and vendor-name expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .ip import IPV4

# Last labels of public names, prefixes that firmware gives to its
# generated names.
PUBLIC_TLDS = [
    "com", "net", "org", "edu", "gov", "mil", "io", "co", "uk", "de", "fr", "jp", "cn", "ru", "br", "au", "in", "ca", "us", "eu", "info", "biz",
    "me", "tv", "cc", "ws", "app", "dev", "cloud", "xyz",
]
FIRMWARE_PREFIXES = ["esdk", "esp", "tasmota", "shelly", "tuya", "beken", "ewelink", "sonoff", "hap", "ble", "wlan", "wifi", "smartlife", "tplink", "kasa", "deco", "meross"]

#: Names that no person has given, by pattern (of the lower-case name).
GENERATED = [
    r"^_|\._tcp|\._udp|_dns-sd",  # service labels
    IPV4, r"^[0-9a-f]*:[0-9a-f:]*:[0-9a-f:.]*$",  # addresses
    rf"^.*\..*\.({'|'.join(PUBLIC_TLDS)})$",  # public names
    r"^[0-9a-f]+(-[0-9a-f]+)+$", r"^.+(-[0-9a-f]+){3}$",  # hexadecimal segments, identifiers among them
    r"^[0-9a-f]{8,}$",
    r"^[a-z]{1,10}[-_][0-9a-f]{8,12}$", rf"^({'|'.join(FIRMWARE_PREFIXES)}).[0-9a-f]{{6,}}$",  # firmware defaults
]

# Hostname keywords and the vendors they belong to.
HOSTNAME_VENDORS = {
    "lutron": ["Lutron"], "hue": ["Philips", "Signify"], "sonos": ["Sonos"], "roku": ["Roku"], "nest": ["Google"], "echo": ["Amazon"], "alexa": ["Amazon"], "homepod": ["Apple"],
    "chromecast": ["Google"], "firestick": ["Amazon"], "ring": ["Amazon", "Ring"], "roborock": ["Roborock"], "roomba": ["iRobot"], "ecobee": ["ecobee"], "dyson": ["Dyson"],
}


def valid_hostname(name: Column) -> Column:
    """Whether a name looks assigned by a person (false for null and blank ones)."""
    low = F.lower(F.trim(name))
    generated = low.rlike("|".join(f"(?:{p})" for p in GENERATED))
    return F.coalesce((low != "") & ~generated, F.lit(False))


def clean_hostname(name: Column) -> Column:
    """Without address prefix, service part, hex suffix and ``.local``."""
    out = F.regexp_replace(name, "^[0-9A-Fa-f]{6,12}@", "")
    out = F.when(out.contains("._"), F.element_at(F.split(out, r"\._"), 1)).otherwise(out)
    out = F.regexp_replace(out, "(?i)-[0-9a-f]{12,}$", "")
    out = F.regexp_replace(out, r"\.local$", "")
    return F.regexp_replace(out, r"^[.-]+|[.-]+$", "")


def coherent(hostname: Column, vendor: Column) -> Column:
    """False if a keyword of the hostname belongs to other vendors; null and empty ones are coherent."""
    out = F.lit(True)
    for word, owners in HOSTNAME_VENDORS.items():
        owned = F.lit(False)
        for owner in owners:
            owned = owned | same_vendor(vendor, F.lit(owner))
        out = out & (~F.lower(hostname).contains(word) | owned)
    return F.coalesce(out | (hostname == "") | (vendor == ""), F.lit(True))


def same_vendor(a: Column, b: Column) -> Column:
    """Equal, or one inside the other, whatever the case."""
    a, b = F.lower(a), F.lower(b)
    return F.coalesce((a == b) | a.contains(b) | b.contains(a), F.lit(False))


def redacted(text: Column) -> Column:
    """Secrets after key, token, password or secret replaced by stars."""
    return F.regexp_replace(text, r"(?i)((?:api[_-]?key|token|password|secret)\s*[=:]\s*)[^\s,;&]+", "$1***")
