"""Payload decoders on hand-made messages."""

import hashlib
import random
import struct

import pytest

from wirefold.sources.decoders import LAYOUTS, SPECIAL, decode, decoded


def bootp(options):
    body = b"".join(bytes([c, len(v)]) + v for c, v in options)
    return b"\1\1\6\0" + b"\0" * 24 + bytes.fromhex("001a2b000001") + b"\0" * 202 + b"\x63\x82\x53\x63" + body + b"\xff"


def test_dhcp():
    got = decode("dhcpv4", bootp([(53, b"\3"), (12, b"alice-pc"), (55, bytes([1, 3, 6])), (60, b"MSFT 5.0"), (50, bytes([10, 0, 0, 9])), (61, b"\1" + bytes.fromhex("001a2b000001"))]))
    assert got == {"client_mac": "00:1a:2b:00:00:01", "ip": "10.0.0.9", "message_type": "3", "opt55": "1,3,6", "opt60": "MSFT 5.0", "hostname": "alice-pc", "client_id": "00:1a:2b:00:00:01"}
    six = b"\1\0\0\1" + struct.pack(">HHHH", 6, 4, 23, 24) + struct.pack(">HH", 1, 2) + b"\xab\xcd"
    assert decode("dhcpv6", six) == {"message_type": "1", "oro": "23,24", "duid": "abcd"}


def test_dns_with_pointer():
    name = b"\3www\7example\3com\0"
    msg = struct.pack(">6H", 7, 0x8180, 1, 1, 0, 0) + name + struct.pack(">HH", 1, 1) + b"\xc0\x0c" + struct.pack(">HHIH", 1, 1, 60, 4) + bytes([10, 1, 2, 3])
    assert decode("dns", msg) == {"response": "1", "query_name": "www.example.com", "query_type": "1", "answers": "1 www.example.com 10.1.2.3"}
    loop = struct.pack(">6H", 7, 0, 1, 0, 0, 0) + b"\xc0\x0c" + b"\0\1\0\1"
    assert decode("dns", loop)["response"] == "0"


def test_client_hello():
    ext = lambda k, v: struct.pack(">HH", k, len(v)) + v
    host = b"x.example"
    exts = ext(0, struct.pack(">HBH", len(host) + 3, 0, len(host)) + host) + ext(10, struct.pack(">HHH", 4, 29, 0x1A1A)) + ext(11, b"\1\0") + ext(16, b"\0\3\2h2") + ext(0x2A2A, b"")
    ciphers = struct.pack(">HHH", 0x0A0A, 4865, 4866)
    body = b"\x03\x03" + b"\0" * 32 + b"\0" + struct.pack(">H", len(ciphers)) + ciphers + b"\1\0" + struct.pack(">H", len(exts)) + exts
    hello = b"\x16\x03\x01" + struct.pack(">H", len(body) + 4) + b"\1" + struct.pack(">I", len(body))[1:] + body
    got = decode("tls", hello)
    assert (got["sni"], got["alpn"], got["version"]) == ("x.example", "h2", "771")
    assert got["ja3"] == hashlib.md5(b"771,4865-4866,0-10-11-16,29,0").hexdigest()
    assert got["ja4"].startswith("t12d0204h2_") and decode("tls", hello[:60]) is None


def test_layer_two():
    tlv = lambda k, v: struct.pack(">H", k << 9 | len(v)) + v
    frame = tlv(1, b"\4" + bytes.fromhex("001a2b000001")) + tlv(5, b"sw1") + tlv(7, struct.pack(">HH", 4, 4)) + b"\0\0"
    assert decode("lldp", frame) == {"chassis": "00:1a:2b:00:00:01", "system_name": "sw1", "capabilities": "4"}
    assert decode("cdp", b"\2\xb4\0\0" + struct.pack(">HH", 1, 7) + b"sw2" + struct.pack(">HHH", 10, 6, 99)) == {"device_id": "sw2", "native_vlan": "99"}
    assert decode("dtp", b"\1" + struct.pack(">HH", 2, 5) + b"\3") == {"mode": "desirable", "negotiating": "true"}
    stp = b"\0\0\0\0\0" + struct.pack(">H", 32768) + bytes.fromhex("001a2b000001") + struct.pack(">IH", 4, 32768) + bytes.fromhex("001a2b000002") + b"\0" * 12
    assert decode("stp", stp)["root_mac"] == "00:1a:2b:00:00:01"


@pytest.mark.parametrize(("kind", "data", "field", "value"), [
    ("modbus", b"\0\1\0\0\0\6\x11\3\0\0", "function_code", "3"), ("umas", b"\0\1\0\0\0\6\1\x5a\0\2", "umas_code", "2"), ("bacnet", b"\x81\x0b\0\x0c", "function", "11"),
    ("dnp3", b"\5\x64\5\xc0\1\0\x0a\0\0\0", "source", "10"), ("s7comm", b"\3\0\0\x19\2\xf0\x80\x32\1\0", "pdu_type", "1"), ("opcua", b"HELF\x20\0\0\0", "message", "HEL"),
    ("coap", b"\x40\1\0\7", "message_id", "7"), ("mqtt", b"\x10\x10\0\4MQTT\4\2\0\x3c\0\2ab", "client_id", "ab"), ("icmpv6_ra", b"\x86\0\0\0\x40\xc0\7\x08" + b"\0" * 8, "hop_limit", "64"),
    ("snmp", b"\x30\x10\2\1\1\4\6public\0", "community", "public"), ("quic", b"\xc0\0\0\0\1\0..a.example.org..", "sni", "a.example.org"), ("radius", b"\1\7\0\x14" + b"\0" * 16, "identifier", "7"),
])
def test_fields(kind, data, field, value):
    assert decode(kind, data)[field] == value


@pytest.mark.parametrize("kind", [*LAYOUTS, *SPECIAL, "other", None])
def test_broken_payloads(kind):
    for data in (None, b"", b"\0", b"\xff" * 9, bytes(range(256))):
        got = decode(kind, data)
        assert got is None or all(isinstance(v, str) for v in got.values())


def test_over_rows(spark):
    rows = [(1, "modbus", bytearray(b"\0\1\0\0\0\6\x11\3\0\0")), (2, "modbus", None), (3, None, bytearray(b"x")), (4, "ntp", bytearray(48))]
    got = {r.i: r.fields for r in decoded(spark.createDataFrame(rows, "i int, protocol string, payload binary")).collect()}
    assert got[1]["unit_id"] == "17" and got[2] is None and got[3] is None and got[4]["stratum"] == "0"


BROKEN = {"lldp": ["0f1027", "0e02ffff", "0e0400"], "dtp": ["01000204c0", "0100020005"], "snmp": ["30060201", "300702010104"], "cdp": ["02b40000000a0005ff"], "dns": ["000000000001000100000000c0"]}


def test_broken_payloads_give_null_and_do_not_raise(spark):
    """Random and cut payloads of every kind; one raised in a job would end it."""
    rng = random.Random(11)
    kinds = [*SPECIAL, *LAYOUTS]
    heads = {"tls": "16030100300100002c0303", "dhcpv4": "01010600", "dns": "0001818000010002", "mqtt": "100c00044d515454", "lldp": "0e04", "dtp": "0100020005", "snmp": "302602010104", "cdp": "02b40000000a"}
    rows = [(k, bytes.fromhex(x)) for k, some in BROKEN.items() for x in some]
    for kind in kinds:
        for _ in range(400):
            head = bytes.fromhex(heads.get(kind, "")) if rng.random() < 0.6 else b""
            body = bytes(rng.choice([0, 1, 2, 4, 7, 192, 255, rng.randrange(256)]) for _ in range(rng.randrange(60)))
            rows.append((kind, (head + body)[: rng.randrange(1, 80)]))
            decode(*rows[-1])
    assert decode("lldp", bytes.fromhex("0f1027")) is None or decode("dtp", bytes.fromhex("01000204c0")) is None
    rows += [(None, b"x"), ("lldp", None), ("lldp", b""), ("nonsense", b"abc")]
    out = decoded(spark.createDataFrame(rows, "protocol string, payload binary")).collect()
    assert len(out) == len(rows) and [r.fields for r in out[-4:]] == [None] * 4
