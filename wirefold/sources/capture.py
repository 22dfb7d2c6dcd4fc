"""Packet captures and sensor frames: binary records to typed rows."""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FRAME = "file string, n long, us long, interface long, frame binary"


def pcap_records(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(microseconds, interface, frame) of a pcap or pcapng file; stops at a broken record."""
    if data[:4] == b"\x0a\x0d\x0d\x0a":
        yield from _pcapng(data)
        return
    magic = data[:4]
    order = {b"\xd4\xc3\xb2\xa1": "<", b"\x4d\x3c\xb2\xa1": "<", b"\xa1\xb2\xc3\xd4": ">", b"\xa1\xb2\x3c\x4d": ">"}.get(magic)
    if order is None:
        return
    nano, at = magic in (b"\x4d\x3c\xb2\xa1", b"\xa1\xb2\x3c\x4d"), 24
    while at + 16 <= len(data):
        sec, part, size, _ = struct.unpack_from(f"{order}IIII", data, at)
        if at + 16 + size > len(data):
            return
        yield sec * 1_000_000 + (part // 1000 if nano else part), 0, data[at + 16 : at + 16 + size]
        at += 16 + size


def _pcapng(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    at, order = 0, "<"
    while at + 12 <= len(data):
        kind = data[at : at + 4]
        if kind == b"\x0a\x0d\x0d\x0a":
            order = "<" if data[at + 8 : at + 12] == b"\x4d\x3c\x2b\x1a" else ">"
        size = struct.unpack_from(f"{order}I", data, at + 4)[0]
        if size < 12 or at + size > len(data):
            return
        if struct.unpack(f"{order}I", kind)[0] == 6:
            interface, high, low, length = struct.unpack_from(f"{order}IIII", data, at + 8)
            yield (high << 32) | low, interface, data[at + 28 : at + 28 + length]
        at += size


def read_pcap(spark: SparkSession, path: str) -> DataFrame:
    """All frames of all capture files under ``path``, with their event time."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{pcap,pcapng,cap}").load(path).select("path", "content")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = [(file, i, *r) for i, r in enumerate(pcap_records(data))]
                for a in range(0, len(rows), 10_000):
                    some = list(zip(*rows[a : a + 10_000]))
                    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(some, kinds)], ["file", "n", "us", "interface", "frame"])

    return files.mapInArrow(split, FRAME)


def write_pcap(frames: list[tuple[int, bytes]]) -> bytes:
    """A capture file of (microseconds, frame) rows, for exports of a bounded buffer."""
    out = [struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1)]
    for us, frame in frames:
        out += [struct.pack("<IIII", us // 1_000_000, us % 1_000_000, len(frame), len(frame)), frame]
    return b"".join(out)


def write_captures(frames: DataFrame, folder: str) -> DataFrame:
    """One capture file for each partition of (us, frame): file, frames.

    Rows are written as they come; a repeated task replaces its file by the same one.
    """

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        system, at = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        system.create_dir(at, recursive=True)
        name, total = f"part-{TaskContext.get().partitionId():05d}.pcap", 0
        part = f"{at}/.{name}-{uuid.uuid4().hex}"
        with system.open_output_stream(part) as out:
            out.write(write_pcap([]))
            for batch in batches:
                rows = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
                out.write(write_pcap(rows)[24:])
                total += len(rows)
        if total:
            system.move(part, f"{at}/{name}")
        else:
            system.delete_file(part)
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([total])], ["file", "frames"])

    return frames.select("us", "frame").mapInArrow(put, "file string, frames long")


def sensor_frames(messages: DataFrame) -> DataFrame:
    """Length-prefixed frames of a sensor's messages (sensor, seq, body), in order.

    A frame may span messages: each sensor's bytes are joined before cutting.
    Messages of one sensor come in files or windows of bounded size; ``batch``
    names them.
    """

    def cut(key, group):
        import pandas as pd

        data = b"".join(group.sort_values("seq")["body"])
        rows, at = [], 0
        while at + 16 <= len(data):
            size, ns, interface = struct.unpack_from(">IqI", data, at)
            if at + 16 + size > len(data):
                break
            rows.append((key[0], len(rows), ns // 1000, interface, bytes(data[at + 16 : at + 16 + size])))
            at += 16 + size
        return pd.DataFrame(rows, columns=["file", "n", "us", "interface", "frame"])

    return messages.groupBy("sensor", "batch").applyInPandas(cut, FRAME)


def ethernet(frames: DataFrame) -> DataFrame:
    """Addresses and type of each frame, by byte position."""
    h = F.hex("frame")
    pairs = lambda at: F.lower(F.regexp_replace(F.substring(h, at, 12), "(..)(?!$)", "$1:"))
    return frames.select("*", pairs(1).alias("dst_mac"), pairs(13).alias("src_mac"), F.conv(F.substring(h, 25, 4), 16, 10).cast("int").alias("ethertype"))


def _number(h, byte: int, width: int):
    return F.conv(F.substring(h, 2 * byte + 1, 2 * width), 16, 10).cast("long")


def _dotted(h, byte: int):
    return F.concat_ws(".", *[_number(h, byte + i, 1).cast("string") for i in range(4)])


def typed(frames: DataFrame) -> DataFrame:
    """First matching record type of each frame: arp, tcp_syn, dns, ip or unclassified.

    Untagged Ethernet and IPv4 headers without options; all native.
    """
    e = ethernet(frames)
    h = F.hex("frame")
    arp = (F.col("ethertype") == 0x0806) & _number(h, 20, 2).isin(1, 2)
    v4 = F.col("ethertype") == 0x0800
    proto = _number(h, 23, 1)
    flags = _number(h, 47, 1)
    syn = v4 & (proto == 6) & (flags.bitwiseAND(F.lit(0x12)) == 2)
    dns = v4 & (proto == 17) & ((_number(h, 34, 2) == 53) | (_number(h, 36, 2) == 53))
    kind = F.when(arp, "arp").when(syn, "tcp_syn").when(dns, F.when(_number(h, 44, 1).bitwiseAND(F.lit(0x80)) != 0, "dns_server").otherwise("dns")).when(v4, "ip_observed").otherwise("unclassified")
    source = F.when(arp, _dotted(h, 28)).when(v4, _dotted(h, 26))
    target = F.when(arp, _dotted(h, 38)).when(v4, _dotted(h, 30))
    return e.select(
        "file", "n", "us", "interface", F.col("src_mac").alias("hw_addr"), kind.alias("protocol"), source.alias("ip_addr"), target.alias("target_ip"),
        F.when(arp, _number(h, 20, 2)).cast("int").alias("op"), F.when(v4, _number(h, 22, 1)).cast("int").alias("ttl"),
        F.when(v4 & proto.isin(6, 17), _number(h, 36, 2)).cast("int").alias("port"), F.when(syn, _number(h, 48, 2)).cast("int").alias("window_size"),
    )


# Ethertypes, and ports of protocols that have a payload decoder.
ETHERTYPES = {0x88CC: "lldp", 0x888E: "eap", 0x88B8: "goose", 0x8892: "profinet"}
UDP_PORTS = {
    53: "dns", 5353: "mdns", 5355: "llmnr", 67: "dhcpv4", 68: "dhcpv4", 546: "dhcpv6", 547: "dhcpv6", 137: "netbios", 161: "snmp", 162: "snmp", 123: "ntp",
    443: "quic", 47808: "bacnet", 5683: "coap", 3478: "stun", 1812: "radius", 1813: "radius",
}
TCP_PORTS = {443: "tls", 502: "modbus", 1883: "mqtt", 44818: "enip", 20000: "dnp3", 102: "s7comm", 4840: "opcua"}
ICMPV6 = {133: "icmpv6_rs", 134: "icmpv6_ra", 135: "icmpv6_ns", 136: "icmpv6_na"}


def _named(number: Column, names: dict[int, str]) -> Column:
    out = F.lit(None).cast("string")
    for key, name in names.items():
        out = F.when(number == key, name).otherwise(out)
    return out


def payloads(frames: DataFrame) -> DataFrame:
    """Adds hw_addr, ip_addr, protocol (a record type) and payload, where a decoder fits.

    Ethernet with or without one VLAN tag, IPv4 with options, IPv6 without
    extension headers, UDP, TCP (the options of a SYN, else its data), link-layer
    control frames.  Ports decide, the destination's before the source's.
    Padding behind the packet is cut off.  Other and cut frames give nulls.
    All native.
    """
    h = F.hex("frame")
    number = lambda at, n: F.conv(h.substr(2 * at + 1, F.lit(2 * n)), 16, 10).cast("int")
    cut = lambda at, end: h.substr((2 * at + 1).cast("int"), F.greatest(2 * (end - at), F.lit(0)).cast("int"))
    size = F.length("frame")
    base = F.when(number(F.lit(12), 2) == 0x8100, 18).otherwise(14)
    kind = number(base - 2, 2)
    v4, v6 = kind == 0x0800, kind == 0x86DD
    inner = F.when(v4, base + number(base, 1).bitwiseAND(F.lit(15)) * 4).when(v6, base + 40)
    end = F.least(size, F.when(v4, base + number(base + 2, 2)).when(v6, base + 40 + number(base + 4, 2)))
    carried = F.when(v4, number(base + 9, 1)).when(v6, number(base + 6, 1))
    udp, tcp, flags = carried == 17, carried == 6, number(inner + 13, 1)
    syn = tcp & (flags.bitwiseAND(F.lit(0x12)) == 2)
    opened = inner + F.floor(number(inner + 12, 1) / 16) * 4
    by = lambda names: F.coalesce(_named(number(inner + 2, 2), names), _named(number(inner, 2), names))
    spoken = by(TCP_PORTS)
    spoken = F.when((spoken == "modbus") & (number(opened + 7, 1) == 90), "umas").otherwise(spoken)
    snap = (kind <= 1500) & (cut(base, base + 6) == "AAAA0300000C")
    protocol = (
        F.when(kind.isin(*ETHERTYPES), _named(kind, ETHERTYPES)).when((kind <= 1500) & (cut(base, base + 3) == "424203"), "stp")
        .when(snap, _named(number(base + 6, 2), {0x2000: "cdp", 0x2004: "dtp"})).when(syn, "tcp_options").when(tcp & (opened < end), spoken).when(udp, by(UDP_PORTS))
        .when(v4 & (carried == 2), "igmp").when(v6 & (carried == 58), _named(number(inner, 1), ICMPV6))
    )
    start = (
        F.when(kind == 0x888E, base + 4).when(kind.isin(*ETHERTYPES), base).when(protocol == "stp", base + 3).when(snap, base + 8).when(syn, inner + 20)
        .when(tcp, opened).when(udp, inner + 8).otherwise(inner)
    )
    stop = F.when(syn, F.least(opened, end)).when(kind <= 1500, F.least(size, base + kind)).otherwise(F.coalesce(end, size))
    found = F.when(protocol.isNotNull() & (start <= stop), F.unhex(cut(start, stop)))
    byte = lambda at: number(at, 1).cast("string")
    source = F.when(v4, F.concat_ws(".", *[byte(base + i) for i in (12, 13, 14, 15)])).when(v6, F.lower(F.regexp_replace(cut(base + 8, base + 24), "(....)(?!$)", "$1:")))
    mac = F.lower(F.regexp_replace(h.substr(F.lit(13), F.lit(12)), "(..)(?!$)", "$1:"))
    return frames.select("*", mac.alias("hw_addr"), source.alias("ip_addr"), F.when(found.isNotNull(), protocol).alias("protocol"), found.alias("payload"))
