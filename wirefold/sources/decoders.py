"""Binary payload decoders: one record type each, bytes to named fields.

Fixed layouts are described as data (name, offset, struct code); the few
variable ones are small functions.  ``decoded`` runs them over Arrow batches
and returns a map of text fields, null where the payload does not fit.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.tls import ALPN, VERSIONS

#: Record type: (check on the payload, fields as (name, offset, struct code)).
LAYOUTS: dict[str, tuple[Callable[[bytes], bool], list[tuple[str, int, str]]]] = {
    "ntp": (lambda b: len(b) >= 48, [("flags", 0, "B"), ("stratum", 1, "B"), ("poll", 2, "b"), ("reference", 12, "4s")]),
    "igmp": (lambda b: len(b) >= 8, [("type", 0, "B"), ("group", 4, "ip")]),
    "stp": (lambda b: len(b) >= 35 and b[:2] == b"\0\0", [("version", 2, "B"), ("bpdu_type", 3, "B"), ("root_priority", 5, ">H"), ("root_mac", 7, "mac"), ("root_cost", 13, ">I"), ("bridge_priority", 17, ">H"), ("bridge_mac", 19, "mac")]),
    "stun": (lambda b: len(b) >= 20 and b[4:8] == b"\x21\x12\xa4\x42", [("type", 0, ">H"), ("length", 2, ">H")]),
    "radius": (lambda b: len(b) >= 20, [("code", 0, "B"), ("identifier", 1, "B"), ("length", 2, ">H")]),
    "eap": (lambda b: len(b) >= 5, [("code", 0, "B"), ("identifier", 1, "B"), ("length", 2, ">H"), ("type", 4, "B")]),
    "modbus": (lambda b: len(b) >= 8 and b[2:4] == b"\0\0", [("transaction", 0, ">H"), ("length", 4, ">H"), ("unit_id", 6, "B"), ("function_code", 7, "B")]),
    "umas": (lambda b: len(b) >= 10 and b[2:4] == b"\0\0" and b[7] == 90, [("unit_id", 6, "B"), ("session", 8, "B"), ("umas_code", 9, "B")]),
    "bacnet": (lambda b: len(b) >= 4 and b[0] == 0x81, [("function", 1, "B"), ("length", 2, ">H")]),
    "coap": (lambda b: len(b) >= 4 and b[0] >> 6 == 1, [("header", 0, "B"), ("code", 1, "B"), ("message_id", 2, ">H")]),
    "enip": (lambda b: len(b) >= 24, [("command", 0, "<H"), ("length", 2, "<H"), ("session", 4, "<I"), ("status", 8, "<I")]),
    "dnp3": (lambda b: len(b) >= 10 and b[:2] == b"\x05\x64", [("length", 2, "B"), ("control", 3, "B"), ("destination", 4, "<H"), ("source", 6, "<H")]),
    "s7comm": (lambda b: len(b) >= 10 and b[:2] == b"\x03\0" and b[7] == 0x32, [("length", 2, ">H"), ("pdu_type", 8, "B")]),
    "opcua": (lambda b: len(b) >= 8 and b[:3] in (b"HEL", b"ACK", b"OPN", b"CLO", b"MSG", b"ERR"), [("message", 0, "3s"), ("size", 4, "<I")]),
    "goose": (lambda b: len(b) >= 8, [("app_id", 0, ">H"), ("length", 2, ">H")]),
    "profinet": (lambda b: len(b) >= 4, [("frame_id", 0, ">H"), ("service_id", 2, "B"), ("service_type", 3, "B")]),
    "icmpv6_ra": (lambda b: len(b) >= 16 and b[0] == 134, [("hop_limit", 4, "B"), ("flags", 5, "B"), ("lifetime", 6, ">H")]),
    "icmpv6_ns": (lambda b: len(b) >= 24 and b[0] == 135, [("target", 8, "ip6")]),
    "icmpv6_na": (lambda b: len(b) >= 24 and b[0] == 136, [("flags", 4, "B"), ("target", 8, "ip6")]),
    "icmpv6_rs": (lambda b: len(b) >= 8 and b[0] == 133, [("type", 0, "B")]),
}


def _text(raw: bytes) -> str:
    return raw.rstrip(b"\0").decode("utf-8", "replace")


def _field(data: bytes, at: int, code: str) -> str:
    if code == "mac":
        return data[at : at + 6].hex(":")
    if code == "ip":
        return ".".join(map(str, data[at : at + 4]))
    if code == "ip6":
        return data[at : at + 16].hex(":", 2)
    value = struct.unpack_from(code, data, at)[0]
    return _text(value) if isinstance(value, bytes) else str(value)


def _options(data: bytes, at: int) -> dict[int, bytes]:
    out: dict[int, bytes] = {}
    while at < len(data) and data[at] != 255:
        if data[at] == 0:
            at += 1
            continue
        if at + 2 > len(data):
            break
        out.setdefault(data[at], data[at + 2 : at + 2 + data[at + 1]])
        at += 2 + data[at + 1]
    return out


def dhcpv4(b: bytes) -> dict[str, str] | None:
    """A BOOTP message; the address is the first non-zero of the four places."""
    if len(b) < 240 or b[236:240] != b"\x63\x82\x53\x63":
        return None
    o = _options(b, 240)
    ip = lambda raw: ".".join(map(str, raw[:4]))
    address = next((a for a in (ip(b[16:20]), ip(b[12:16]), ip(o.get(50, b""))) if a not in ("", "0.0.0.0")), None)
    client = o.get(61, b"")
    out = {
        "client_mac": b[28:34].hex(":"), "ip": address, "message_type": str(o[53][0]) if o.get(53) else None, "opt55": ",".join(map(str, o[55])) if 55 in o else None,
        "opt60": _text(o[60]) if 60 in o else None, "hostname": _text(o[12]) if 12 in o else None, "server": ip(o[54]) if 54 in o else None,
        "offered_ip": ip(b[16:20]) if any(b[16:20]) else None, "server_ip": ip(b[20:24]) if any(b[20:24]) else None,
        "client_id": client[1:].hex(":") if len(client) == 7 and client[0] == 1 else client.hex() or None,
    }
    return {k: v for k, v in out.items() if v}


def dhcpv6(b: bytes) -> dict[str, str] | None:
    if len(b) < 4 or b[0] not in (1, 3, 5, 11):
        return None
    out, at = {"message_type": str(b[0])}, 4
    while at + 4 <= len(b):
        code, size = struct.unpack_from(">HH", b, at)
        body = b[at + 4 : at + 4 + size]
        if code == 1:
            out["duid"] = body.hex()
        elif code == 6:
            out["oro"] = ",".join(str(x) for (x,) in struct.iter_unpack(">H", body[: len(body) // 2 * 2]))
        elif code == 16 and len(body) >= 4:
            out["enterprise"] = str(struct.unpack_from(">I", body)[0])
            out["vendor_class"] = _text(body[6:])
        elif code == 39:
            out["fqdn"] = ".".join(_labels(body, 1)[0])
        at += 4 + size
    return out


def _labels(b: bytes, at: int) -> tuple[list[str], int]:
    """A DNS name and the position behind it; pointers are followed once each."""
    labels, end, seen = [], None, set()
    while at < len(b) and b[at]:
        if b[at] >= 192 and at + 1 < len(b):
            end = end or at + 2
            at = (b[at] & 63) << 8 | b[at + 1]
            if at in seen:
                break
            seen.add(at)
        else:
            labels.append(_text(b[at + 1 : at + 1 + b[at]]))
            at += 1 + b[at]
    return labels, end or at + 1


def dns(b: bytes) -> dict[str, str] | None:
    """Question, and answers as ``type name value`` lines."""
    if len(b) < 12:
        return None
    _, flags, questions, answers, _, _ = struct.unpack_from(">6H", b)
    out, at = {"response": str(flags >> 15)}, 12
    for i in range(questions):
        name, at = _labels(b, at)
        if at + 4 > len(b):
            return out
        if i == 0:
            out["query_name"], out["query_type"] = ".".join(name), str(struct.unpack_from(">H", b, at)[0])
        at += 4
    lines = []
    for _ in range(answers):
        name, at = _labels(b, at)
        if at + 10 > len(b):
            break
        kind, _, _, size = struct.unpack_from(">HHIH", b, at)
        at += 10
        value = _field(b, at, "ip") if kind == 1 else _field(b, at, "ip6") if kind == 28 else ".".join(_labels(b, at + 6 * (kind == 33))[0]) if kind in (5, 12, 33) else _text(b[at + 1 : at + size]) if kind == 16 else ""
        lines.append(f"{kind} {'.'.join(name)} {value}")
        at += size
    if lines:
        out["answers"] = "\n".join(lines)
    return out


def tls(b: bytes) -> dict[str, str] | None:
    """A ClientHello: name, version and the two fingerprints."""
    if len(b) < 43 or b[0] != 22 or b[5] != 1 or len(b) < 5 + struct.unpack_from(">H", b, 3)[0]:
        return None
    try:
        version = struct.unpack_from(">H", b, 9)[0]
        at = 43
        at += 1 + b[at]
        size = struct.unpack_from(">H", b, at)[0]
        ciphers = [x for (x,) in struct.iter_unpack(">H", b[at + 2 : at + 2 + size])]
        at += 2 + size
        at += 1 + b[at]
        at += 2
        extensions, curves, formats, sni, alpn = [], [], [], None, None
        while at + 4 <= len(b):
            kind, size = struct.unpack_from(">HH", b, at)
            body = b[at + 4 : at + 4 + size]
            extensions.append(kind)
            if kind == 0:
                sni = _text(body[5:])
            elif kind == 10:
                curves = [x for (x,) in struct.iter_unpack(">H", body[2:])]
            elif kind == 11:
                formats = list(body[1:])
            elif kind == 16 and len(body) > 3:
                alpn = _text(body[3 : 3 + body[2]])
            elif kind == 43:
                named = [x for (x,) in struct.iter_unpack(">H", body[1:])]
                version = max([v for v in named if v in VERSIONS], default=version)
            at += 4 + size
    except (IndexError, struct.error):
        return None
    clean = lambda xs: [x for x in xs if not (x & 0x0F0F == 0x0A0A and x >> 8 == x & 255)]
    text = ",".join([str(version), *("-".join(map(str, clean(x))) for x in (ciphers, extensions, curves)), "-".join(map(str, formats))])
    c, e = clean(ciphers), clean(extensions)
    digest = [hashlib.sha256(",".join(map(str, sorted(x))).encode()).hexdigest()[:12] for x in (c, e)]
    first = "00" if alpn is None else ALPN.get(alpn, alpn[:2].ljust(2, "0"))
    ja4 = f"t{VERSIONS.get(version, '00')}{'d' if sni else 'i'}{min(len(c), 99):02d}{min(len(e), 99):02d}{first}"
    out = {"version": str(version), "sni": sni, "alpn": alpn, "ja3": hashlib.md5(text.encode()).hexdigest(), "ja4": "_".join([ja4, *digest])}
    return {k: v for k, v in out.items() if v}


def lldp(b: bytes) -> dict[str, str] | None:
    names = {1: "chassis", 2: "port", 4: "port_description", 5: "system_name", 6: "system_description", 7: "capabilities"}
    out, at = {}, 0
    while at + 2 <= len(b):
        head = struct.unpack_from(">H", b, at)[0]
        kind, size = head >> 9, head & 511
        body = b[at + 2 : at + 2 + size]
        if kind == 0:
            break
        if kind in names:
            out[names[kind]] = body[1:].hex(":") if kind == 1 and body[:1] == b"\4" else _text(body[1:]) if kind in (1, 2) else str(struct.unpack_from(">H", body, 2)[0]) if kind == 7 and len(body) >= 4 else _text(body)
        at += 2 + size
    return out or None


def cdp(b: bytes) -> dict[str, str] | None:
    names = {1: "device_id", 3: "port", 5: "version", 6: "platform", 10: "native_vlan"}
    out, at = {}, 4
    while at + 4 <= len(b):
        kind, size = struct.unpack_from(">HH", b, at)
        if size < 4:
            break
        body = b[at + 4 : at + size]
        if kind in names:
            out[names[kind]] = str(struct.unpack_from(">H", body)[0]) if kind == 10 and len(body) >= 2 else _text(body)
        at += size
    return out or None


def dtp(b: bytes) -> dict[str, str] | None:
    """Trunk status; negotiating modes are those that would form a trunk."""
    at = 1
    while at + 4 <= len(b):
        kind, size = struct.unpack_from(">HH", b, at)
        if size < 4:
            break
        if kind == 2 and size >= 5 and at + 4 < len(b):
            mode = {1: "on", 2: "off", 3: "desirable", 4: "auto", 5: "nonegotiate"}.get(b[at + 4] & 7, "unknown")
            return {"mode": mode, "negotiating": str(mode in ("desirable", "auto")).lower()}
        at += size
    return None


def mqtt(b: bytes) -> dict[str, str] | None:
    if len(b) < 2 or not 1 <= b[0] >> 4 <= 14:
        return None
    out = {"packet_type": str(b[0] >> 4)}
    if b[0] >> 4 == 1 and len(b) >= 12:
        size = struct.unpack_from(">H", b, 2)[0]
        out["protocol"] = _text(b[4 : 4 + size])
        at = 4 + size + 4
        if at + 2 <= len(b):
            out["client_id"] = _text(b[at + 2 : at + 2 + struct.unpack_from(">H", b, at)[0]])
    return out


def quic(b: bytes) -> dict[str, str] | None:
    """Long-header packet: version and, if it is in the clear, a host name."""
    import re

    if len(b) < 7 or not b[0] & 0x80:
        return None
    found = re.search(rb"(?:[a-z0-9-]{1,63}\.)+[a-z]{2,10}", b[6:])
    return {"version": b[1:5].hex()} | ({"sni": found[0].decode()} if found else {})


def netbios(b: bytes) -> dict[str, str] | None:
    """Name query: first-level encoded name and its suffix byte."""
    if len(b) < 46 or b[12] != 32:
        return None
    raw = b[13:45]
    name = bytes(((raw[i] - 65) & 15) << 4 | ((raw[i + 1] - 65) & 15) for i in range(0, 32, 2))
    return {"name": _text(name[:15]).strip(), "suffix": str(name[15])}


def snmp(b: bytes) -> dict[str, str] | None:
    """Version and community of a message."""
    if len(b) < 8 or b[0] != 0x30:
        return None
    at = 2 + (b[1] & 127 if b[1] & 128 else 0)
    if b[at : at + 2] != b"\x02\x01":
        return None
    size = b[at + 4] if b[at + 3] == 4 else 0
    return {"version": {0: "1", 1: "2c", 3: "3"}.get(b[at + 2], "?"), "community": _text(b[at + 5 : at + 5 + size])}


def tcp_options(b: bytes) -> dict[str, str] | None:
    """Options of a SYN: their letters in order, segment size and window scale."""
    letters, out, at = [], {}, 0
    while at < len(b):
        kind = b[at]
        letters.append({0: "E", 1: "N", 2: "M", 3: "W", 4: "S", 8: "T"}.get(kind, "?"))
        if kind == 0:
            break
        if kind == 1:
            at += 1
            continue
        size = b[at + 1] if at + 1 < len(b) else 0
        if size < 2 or at + size > len(b):
            return None
        if kind == 2 and size == 4:
            out["mss"] = str(struct.unpack_from(">H", b, at + 2)[0])
        elif kind == 3 and size == 3:
            out["window_scale"] = str(b[at + 2])
        at += size
    return out | {"tcp_options": ",".join(letters)}


SPECIAL: dict[str, Callable[[bytes], dict[str, str] | None]] = {
    "dhcpv4": dhcpv4, "dhcpv6": dhcpv6, "dns": dns, "mdns": dns, "llmnr": dns, "tls": tls, "lldp": lldp, "cdp": cdp, "dtp": dtp, "mqtt": mqtt, "quic": quic,
    "netbios": netbios, "snmp": snmp, "tcp_options": tcp_options,
}


def decode(kind: str | None, data: bytes | None) -> dict[str, str] | None:
    """Fields of one payload; null for another format or a broken one."""
    if not data:
        return None
    try:
        if kind in SPECIAL:
            return SPECIAL[kind](data)
        if kind in LAYOUTS:
            fits, fields = LAYOUTS[kind]
            return {name: _field(data, at, code) for name, at, code in fields} if fits(data) else None
    except (IndexError, ValueError, struct.error):  # cut off where a field should be: anyone may send such frames
        return None
    return None


def decoded(df: DataFrame, kind: str = "protocol", payload: str = "payload") -> DataFrame:
    """Adds ``fields`` (a map) from each row's payload and record type."""
    from pyspark.sql.types import StructType

    schema = StructType([*df.schema.fields, *StructType.fromDDL("fields map<string,string>").fields])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [decode(k, v) for k, v in zip(batch.column(kind).to_pylist(), batch.column(payload).to_pylist())]
            new = pa.array([None if g is None else list(g.items()) for g in got], pa.map_(pa.string(), pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns, new], [*batch.schema.names, "fields"])

    return df.mapInArrow(rows, schema)
