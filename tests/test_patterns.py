"""Required literals and the pattern index against full scans; banner matchers on hand-made payloads."""

import random
import re
import struct

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wirefold.operators import lookups
from wirefold.operators.banners import FIELDS, MATCHERS, identified
from wirefold.operators import patterns
from wirefold.operators.patterns import indexed, matches, required_literals

KNOWN = [
    (r"^SSH-2\.0-OpenSSH_([\d.]+)", ["ssh-2.0-openssh_"]), (r"(?i)Dovecot|Cyrus", ["cyrus", "dovecot"]), (r"\d+\.\d+", ["."]), (r"[a-z]+", []), (r"ab?c", ["a"]), (r"(abc|def)+x?", ["abc", "def"]),
    (r"(?:abc)?longer", ["longer"]), (r"a{0,2}bcd{2}", ["bcd"]), (r"x|", []), (r"(?=abc)de", ["de"]), (r"[^]a-c]zz\]q", ["zz]q"]), (r"\QabcE", []), (r"ab+cd", ["ab"]), (r"(?<name>foo)bar(?!baz)", ["foo"]),
    (r"\x41bcd", ["bcd"]), (r"\p{Alpha}abc", ["abc"]), (r"Ünder", ["nder"]), ("", []), (r"(", []), (r"a.b\nc", ["b\nc"]),
]


@pytest.mark.parametrize("pattern, want", KNOWN)
def test_required_literals(pattern, want):
    assert required_literals(pattern) == want


PIECE = st.sampled_from(["a", "B", "c", "ab", r"\.", ".", r"\d", "[ab]", "[^c]", "x", "1", "-"])
PATTERN = st.recursive(
    PIECE,
    lambda p: st.one_of(
        st.lists(p, min_size=1, max_size=4).map("".join), st.lists(p, min_size=1, max_size=3).map(lambda x: "(" + "|".join(x) + ")"),
        st.tuples(p, st.sampled_from(["*", "+", "?", "{2}", "{0,1}", "+?", "{1,}"])).map(lambda x: f"(?:{x[0]}){x[1]}"), p.map(lambda x: f"(?i:{x})"),
    ),
    max_leaves=8,
)


@settings(max_examples=800, deadline=None)
@given(PATTERN, st.text(alphabet="aBbc.x1-AX", max_size=14))
def test_a_match_holds_a_required_literal(pattern, text):
    if re.search(pattern, text):
        found = required_literals(pattern)
        assert not found or any(x in text.lower() for x in found)


def test_a_thousand_rules_equal_a_full_scan(spark):
    rng = random.Random(1)
    names = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    forms = [r"^{}/([\d.]+)", r"(?i){} server", r"{}[-_](\d+)", r"(?:{}|{})\s+ready", r"^220.*{}", r"\b{}\b", r"{}?x"]
    rules = [(i, (f := rng.choice(forms)).replace("{}", "%s") % tuple(rng.choice(names) for _ in range(f.count("{}"))), f"p{i}") for i in range(1000)]
    rules += [(1000, r"^\d+$", "number"), (1001, r"^$", "empty"), (500, r"zzz", "tie")]
    texts = [rng.choice(["", "220 ", "x "]) + rng.choice(names).upper() * rng.randint(0, 1) + rng.choice(names) + rng.choice(["/1.2", " server", "-12 z", " ready", "", " " + "q" * 3000]) for _ in range(400)]
    texts += ["", "42", None, "é" * 10, texts[0]]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, banner string").repartition(3)
    table = spark.createDataFrame(rules, "priority int, pattern string, product string")
    plan = matches(frame, "banner", table, lookups.bounded)
    got = {(r.id, r.product) for r in plan.select("id", "product").collect()}
    want = {(r.id, r.product) for r in frame.join(F.broadcast(table), F.expr("banner rlike pattern")).collect()}
    assert got == want and len(want) > 300
    assert "NestedLoop" not in plan._jdf.queryExecution().executedPlan().toString()
    first = {r.id: (r.product, r.version) for r in lookups.first_regex_join(frame, "banner", table, ["id"]).collect()}
    by_rule = {name: (i, pattern) for i, pattern, name in rules}
    for i, text in enumerate(texts):
        mine = min((by_rule[p] + (p,) for j, p in want if j == i), default=None)
        assert first[i][0] == (mine[2] if mine else None)
        if mine:
            m = re.search(mine[1], text)
            assert first[i][1] == (m.group(1) if re.compile(mine[1]).groups else "")
    assert matches(frame, "banner", table.limit(0), lookups.bounded).collect() == []


def test_rules_share_a_key_only_if_they_share_a_literal(spark):
    rules = spark.range(5000).select(F.col("id").alias("priority"), F.concat(F.lit("^(?:server|SRV) item-"), F.col("id").cast("string"), F.lit("/?$")).alias("pattern"))
    index = indexed(rules)
    # By three characters up to 14 of these rules had the same key.
    assert index.groupBy(index.columns[-1]).count().agg(F.max("count")).first()[0] == 1
    texts = spark.range(0, 6000, 10).select(F.concat(F.lit("SRV item-"), F.col("id").cast("string")).alias("banner"))
    assert sorted(r.priority for r in matches(texts, "banner", rules, lookups.bounded).collect()) == list(range(0, 5000, 10))


@pytest.mark.parametrize("limit", [1, 40, 1 << 20])
def test_keys_of_texts(limit, monkeypatch):
    monkeypatch.setattr(patterns, "BYTES", limit)
    monkeypatch.setattr(patterns, "ROWS", min(limit, 50))
    grams = ["", "a", "bc", "-12", "part-1", "part-12", "é", "sixteen letters!"]
    sizes = sorted({len(g.encode()) for g in grams})
    key = {g: int(np.array([patterns._key.func(pd.Series([g]))[0]])[0]) for g in grams if g.isascii()}
    texts = ["part-12 part-1", None, "", "abc", "x" * 100 + "bc", "é-12", "sixteen letters!!", "b", "c", "bcbc"] * 3

    class Shared:
        value = np.full(1 << 10, (1 << 64) - 1, np.uint64)  # lets everything through

    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts) + 2)), pa.array(["q", *texts, "q"])], ["id", "_low"]).slice(1, len(texts))
    got = [(r["id"] - 1, r["_key"]) for part in patterns._keyed(sizes, Shared, 16)(iter([batch])) for r in part.to_pylist()]
    assert len(got) == len(set(got))
    for g, k in key.items():
        assert sorted(i for i, x in got if x == k) == [i for i, t in enumerate(texts) if t is not None and g in t]


def status(name, value):
    body = name + b"\0" + value + b"\0"
    return b"S" + struct.pack(">I", len(body) + 4) + body


HTTP = b"HTTP/1.1 200 OK\r\nServer: nginx/1.2 \r\nContent-Type: application/ipp\r\n\r\n"
CASES = [
    ("ssh", b"SSH-2.0-OpenSSH_9.2p1 Debian\r\n", {"software": "OpenSSH", "version": "9.2p1", "proto_version": "2.0", "raw_banner": "SSH-2.0-OpenSSH_9.2p1 Debian"}),
    ("SSH", b"SSH-1.99-Cisco-1.25", {"software": "1.25", "proto_version": "1.99-Cisco", "raw_banner": "SSH-1.99-Cisco-1.25"}),
    ("ssh", b"SSH-2.0-drop\xe9bear", {"software": "drop\N{REPLACEMENT CHARACTER}bear", "proto_version": "2.0", "raw_banner": "SSH-2.0-drop\N{REPLACEMENT CHARACTER}bear"}),
    ("ssh", b" SSH-2.0-x", None), ("ssh", b"SSH-2.0 x", None),
    ("ftp", b"220 ProFTPD 1.3.8 Server\r\n", {"software": "ProFTPD", "version": "1.3.8", "raw_banner": "220 ProFTPD 1.3.8 Server"}),
    ("ftp", b"220 (vsFTPd 3.0.5)", {"software": "vsFTPd", "version": "3.0.5)", "raw_banner": "220 (vsFTPd 3.0.5)"}),
    ("ftp", b"220-Welcome 2.0", {"raw_banner": "220-Welcome 2.0"}), ("ftp", b"220 FileZilla", {"software": "FileZilla", "raw_banner": "220 FileZilla"}), ("ftp", b"221 x", None),
    ("smtp", b"220 mx ESMTP Postfix\r\n", {"software": "Postfix", "raw_banner": "220 mx ESMTP Postfix"}), ("smtp", b"220 mx esmtp", {"raw_banner": "220 mx esmtp"}), ("smtp", b"220 mx", None),
    ("imap", b"* OK [CAP] Dovecot ready.", {"software": "Dovecot", "raw_banner": "* OK [CAP] Dovecot ready."}), ("imap", b"* NO", None),
    ("pop3", b"+OK Dovecot ready", {"software": "Dovecot", "raw_banner": "+OK Dovecot ready"}), ("pop3", b"-ERR", None),
    ("telnet", b"\xff\xfb\x01", {"raw_banner": "fffb01"}), ("telnet", b"Router Login: ", {"raw_banner": "router login:"}), ("telnet", b"\xff\xfa", None),
    ("vnc", b"RFB 003.008\n", {"version": "003.008", "raw_banner": "RFB 003.008"}), ("vnc", b"RFB 3.8", None),
    ("irc", b":irc.x 001 me :hi", {"raw_banner": ":irc.x 001 me :hi"}), ("irc", b"NOTICE AUTH", {"raw_banner": "NOTICE AUTH"}), ("irc", b"PING", None),
    ("mysql", b"\x4a\0\0\0\x0a8.0.33\0rest", {"software": "MySQL", "version": "8.0.33", "raw_banner": "8.0.33"}),
    ("mysql", b"\x4a\0\0\0\x0a5.5.5-10.11.4-MariaDB\0", {"software": "MariaDB", "version": "10.11.4", "raw_banner": "5.5.5-10.11.4-MariaDB"}),
    ("mysql", b"\x4a\0\0\0\x0a8.0", None), ("mysql", b"\x4a\0\0\0\x098.0\0", None),
    ("postgresql", b"R\0\0\0\x08\0\0\0\0" + status(b"client", b"x") + status(b"server_version", b"15.3"), {"software": "PostgreSQL", "version": "15.3", "raw_banner": "hex"}),
    ("postgresql", b"E" + b"\0" * 30, {"software": "PostgreSQL", "raw_banner": "hex"}), ("postgresql", b"S\0", {"software": "PostgreSQL", "raw_banner": "hex"}), ("postgresql", b"N", None),
    ("mssql", b"\x04\x01\0\x25", {"software": "MSSQL", "raw_banner": "hex"}), ("mssql", b"\x03", None),
    ("mongodb", b"\0" * 12 + b"\xdd\x07\0\0" + b'{"version" : "6.0.1"}', {"software": "MongoDB", "version": "6.0.1", "raw_banner": "hex"}), ("mongodb", b"\0" * 16, None), ("mongodb", b"\0" * 15, None),
    ("redis", b"$40\r\nredis_version:7.0.5\r\n", {"version": "7.0.5", "raw_banner": "$40\r\nredis_version:7.0.5"}), ("redis", b"OK", None),
    ("smb", b"\0\0\0\x40\xfeSMB" + b"\0" * 40, {"smb_version": "2", "raw_banner": (b"\0\0\0\x40\xfeSMB" + b"\0" * 24).hex()}), ("smb", b"\0\0\0\x40\xffSMB", {"smb_version": "1", "raw_banner": "hex"}), ("smb", b"\0\0\0\x40\xffSM", None),
    ("rdp", b"\x03\0\0\x13\x0e\xd0", {"raw_banner": "hex"}), ("rdp", b"\x03\0\0\x13\x0e", None),
    ("ipp", HTTP, {"software": "nginx/1.2", "raw_banner": HTTP.decode().strip()}), ("ipp", b"HTTP/1.1 200", None),
    ("jetdirect", b"@PJL INFO ID\r\n", {"raw_banner": "@PJL INFO ID"}), ("jetdirect", b"PJL", None), ("lpd", b"No QUEUE", {"raw_banner": "no queue"}), ("lpd", b"none", None),
    ("mqtt", b"\x20\x02\0\x05", {"connect_return_code": 5, "raw_banner": "20020005"}), ("mqtt", b"\x20\x02\0", None),
    ("sip", b"SIP/2.0 200 OK\r\nServer: Asterisk 18\r\n", {"software": "Asterisk 18", "raw_banner": "SIP/2.0 200 OK\r\nServer: Asterisk 18"}), ("sip", b"INVITE", None),
    ("rtsp", b"RTSP/1.0 200 OK", {"raw_banner": "RTSP/1.0 200 OK"}), ("rtsp", b"HTTP/1.0", None),
    ("ldap", b"\x30\x0c\x02\x01\x01\x61\x07", {"raw_banner": "hex"}), ("ldap", b"\x30" + b"\0" * 15 + b"\x61", None), ("ldap", b"\x30\0\0\0\x61", None),
    ("cassandra", b"\x84\0\0\x06", {"raw_banner": "84000006"}), ("cassandra", b"\x04\0\0\x06", None), ("cassandra", b"\x84\0\0", None),
    ("elasticsearch", b'HTTP/1.1 200\r\n{"cluster_name":"x","number" : "8.1.0"}', {"software": "Elasticsearch", "version": "8.1.0", "raw_banner": 'HTTP/1.1 200\r\n{"cluster_name":"x","number" : "8.1.0"}'}), ("elasticsearch", b"HTTP/", None),
    ("amqp", b"AMQP\0\0\x09\x01", {"proto_version": "0.9.1", "raw_banner": "hex"}), ("amqp", b"AMQP\0", {"raw_banner": "hex"}), ("amqp", b"\x01\0\0\0", {"raw_banner": "hex"}), ("amqp", b"\x02\0\0\0", None),
    ("docker_api", b'HTTP/1.1 200\r\n{"ApiVersion":"1.43"}', {"software": "Docker", "version": "1.43", "raw_banner": 'HTTP/1.1 200\r\n{"ApiVersion":"1.43"}'}), ("docker_api", b"HTTP/1.1", None),
    ("kubernetes_api", b'HTTP/1.1 200\r\n{"major":"1","minor":"27","gitVersion":"v1.27"}', {"software": "Kubernetes", "version": "v1.27", "raw_banner": 'HTTP/1.1 200\r\n{"major":"1","minor":"27","gitVersion":"v1.27"}'}),
    ("kubernetes_api", b'HTTP/1.1 403\r\n{"kind": "Status"}', {"software": "Kubernetes", "raw_banner": 'HTTP/1.1 403\r\n{"kind": "Status"}'}), ("kubernetes_api", b"HTTP/1.1", None),
    ("socks", b"\x05\0\x01", {"version": "5", "raw_banner": "0500"}), ("socks", b"\0\x5a" + b"\1" * 8, {"version": "4", "raw_banner": "005a010101010101"}), ("socks", b"\x05", None),
    ("bgp", b"\xff" * 16 + b"\0\x1d\x01\x04\xfd\xe8\0", {"version": "4", "as_number": 65000, "raw_banner": (b"\xff" * 16 + b"\0\x1d\x01\x04\xfd").hex()}), ("bgp", b"\xff" * 16 + b"\0\x1d\x02\x04\xfd", None),
    ("pptp", b"\0" * 8 + b"\0\x01\0\x02\x01", {"raw_banner": "hex"}), ("pptp", b"\0" * 12, None),
    ("unifiprotect", b"\x16\x03\x03\0\x40\x02\0\0\x3c", {"software": "UniFi Protect", "raw_banner": "160303004002 00003c".replace(" ", "")[:16]}), ("unifiprotect", HTTP, {"software": "nginx/1.2", "raw_banner": HTTP.decode().strip()}),
    ("unifiprotect", b"\x16\x03", None), ("nothing", b"SSH-2.0-x_1", None), (None, b"SSH-2.0-x_1", None), ("ssh", None, None), ("ssh", b"", None),
]


def test_banners(spark):
    frame = spark.createDataFrame([(i, s, p) for i, (s, p, _) in enumerate(CASES)], "i int, service string, payload binary")
    got = {r.i: r.banner for r in identified(frame).collect()}
    assert {s.lower() for s, _, w in CASES if s and w} == set(MATCHERS) and len(MATCHERS) == 31
    for i, (service, payload, want) in enumerate(CASES):
        if want is None:
            assert got[i] is None, (service, payload)
            continue
        want = {"service": service.lower()} | want
        if want["raw_banner"] == "hex":
            want["raw_banner"] = payload.hex()
        assert got[i].asDict() == {k: want.get(k) for k in FIELDS}, (service, payload)


def test_random_payloads_do_not_fail(spark):
    rng = random.Random(2)
    rows = [(s, bytes(rng.choice([0, 1, 3, 5, 10, 32, 48, 83, 255, rng.randrange(256)]) for _ in range(rng.choice([1, 2, 5, 21, 60, 3000])))) for s in MATCHERS for _ in range(30)]
    frame = spark.createDataFrame(rows, "service string, payload binary")
    assert identified(frame).where("banner IS NULL OR banner.service = service").count() == len(rows)
