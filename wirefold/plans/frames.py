"""From capture files to fields: frames around the payloads of every decoder."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import capture, capture_source
from ..sources.decoders import decoded
from ..sources.shared import fresh
from .base import query
from .records import _MAC, GROUPS, built, fields_sql, n, zeros

KINDS: dict[str, dict[str, str]] = {kind: fields for group in GROUPS.values() for kind, fields in group.items()}
_SIZE = "cast(length(payload) AS int)"
_ETHER = {name: f"{number:04x}" for number, name in capture.ETHERTYPES.items()}
_UDP = {name: port for port, name in reversed(capture.UDP_PORTS.items())}
_TCP = {name: port for port, name in capture.TCP_PORTS.items()} | {"umas": 502}


def _v4(carried: str, more: int) -> list[str]:
    return ["0800", "4600", n(f"{_SIZE} + {24 + more}", 2), zeros(4), "40", carried, "0000", "0a00", n("k % 4"), n("k % 20 + 1"), "0a000001", "01010100"]  # with four bytes of options


def _v6(carried: str, more: int) -> list[str]:
    return ["86dd", "60000000", n(f"{_SIZE} + {more}", 2), carried, "ff", "fe80", zeros(12), n("user_id % 65536", 2), "ff02", zeros(13), "01"]


def _around(kind: str) -> list[str]:
    """Hexadecimal parts of the headers before a payload."""
    if kind == "eap":
        return ["888e", "0100", n(_SIZE, 2)]
    if kind in _ETHER:
        return [_ETHER[kind]]
    if kind == "stp":
        return [n(f"{_SIZE} + 3", 2), "424203"]
    if kind in ("cdp", "dtp"):
        return [n(f"{_SIZE} + 8", 2), "aaaa0300000c", "2000" if kind == "cdp" else "2004"]
    if kind == "igmp":
        return _v4("02", 0)
    if kind.startswith("icmpv6"):
        return _v6("3a", 0)
    if kind in _UDP:
        head = ["c000", f"{_UDP[kind]:04x}", n(f"{_SIZE} + 8", 2), "0000"]
        return [*(_v6 if kind == "dhcpv6" else _v4)("11", 8), *head]
    flags, more = ("02", f"{_SIZE}") if kind == "tcp_options" else ("18", "0")
    port = "0050" if kind == "tcp_options" else f"{_TCP[kind]:04x}"
    return [*_v4("06", 20), "c000", port, zeros(8), n(f"(5 + {more} / 4) * 16"), flags, "ffff", zeros(4)]


def framed(t, kinds: list[str]):
    """(us, frame): each packet's payload in its headers, every third behind a VLAN tag, every fourth padded."""
    text = None
    for kind in kinds:
        parts = ", ".join(p if any(c not in "0123456789abcdef" for c in p) else f"'{p}'" for p in _around(kind))
        text = F.when(F.col("protocol") == kind, F.expr(f"concat({parts})")) if text is None else text.when(F.col("protocol") == kind, F.expr(f"concat({parts})"))
    tag = F.when((F.col("packet_id") % 3 == 0), F.lit("8100000a")).otherwise("")
    bare = F.col("protocol").isin("lldp", "eap", "goose", "profinet")  # their frames have no length of their own
    pad = F.when((F.col("packet_id") % 4 == 0) & ~bare, zeros(6)).otherwise("")
    head = F.concat(F.lit("ffffffffffff001a2b"), F.expr(n("user_id", 3)), tag, text)
    return built(t, kinds).select("us", F.unhex(F.concat(head, F.hex("payload"), pad)).alias("frame"))


@query("s02_capture_fields", f"SELECT p.us, p.mac AS hw_addr, f.protocol, f.name, f.value FROM ({fields_sql(KINDS)}) f JOIN (SELECT packet_id, us, {_MAC} AS mac FROM packets) p ON p.packet_id = f.packet_id")
def _(t):
    folder = fresh(t.spark, "captures")
    capture.write_captures(framed(t, list(KINDS)).repartition(4, "us"), folder).collect()  # a row a file
    capture_source.register(t.spark)
    frames = t.spark.read.format("capture").option("splitBytes", 1 << 19).load(folder).where("broken IS NULL").select("us", "frame")
    found = decoded(capture.payloads(frames).select("us", "hw_addr", "protocol", "payload"))
    return found.select("us", "hw_addr", "protocol", F.explode("fields").alias("name", "value"))
