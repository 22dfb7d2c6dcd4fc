"""Hand cases of the host-identification rules."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wirefold.functions import ip, mac, names
from wirefold.operators import detect, fusion, lookups, throttle
from wirefold.plans import catalog
from wirefold.sources import capture, feeds

EVIDENCE = "id long, hw_addr string, source string, certainty double, category string, vendor string, platform string, hostname string, model string, us long"


def verdict(spark, *rows):
    data = [(i, "m", r.get("source"), r.get("certainty"), r.get("category"), r.get("vendor"), r.get("platform"), None, None, i) for i, r in enumerate(rows)]
    return fusion.verdicts(spark.createDataFrame(data, EVIDENCE), fusion.weight_table(spark)).first()


def test_strong_registry_beats_kindred_databases(spark):
    rows = [dict(source="oui", certainty=0.95, vendor="Withings"), dict(source="satori_dhcp", certainty=0.85, vendor="EyeFi"), dict(source="huginn_device", certainty=0.9, vendor="EyeFi")]
    assert verdict(spark, *rows).vendor == "Withings"


def test_repeated_evidence_is_not_agreement(spark):
    rows = [dict(source="dhcpv4_vendor", certainty=0.85, platform="Windows 2000/XP")] * 2 + [dict(source="huginn_device", certainty=0.9, platform="Windows")]
    assert verdict(spark, *rows).platform == "Windows"


def test_multi_product_registry_category_yields(spark):
    rows = [dict(source="oui", certainty=0.95, vendor="Samsung", category="phone"), dict(source="ssdp_server", certainty=0.85, category="smart_tv")]
    assert verdict(spark, *rows).category == "smart_tv"
    assert verdict(spark, dict(source="oui", certainty=0.95, vendor="Apple")).category is None


def arp(spark, rows):
    return spark.createDataFrame([(i, m, a, "10.9.9.9", op, us * 1_000_000) for i, (m, a, op, us) in enumerate(rows)], "packet_id long, hw_addr string, ip_addr string, target_ip string, op int, us long")


NONE = "ip_addr string, mac string"


@pytest.mark.parametrize(("second", "gap", "n"), [("00:00:00:00:00:02", 5, 1), ("02:00:00:00:00:02", 5, 1), ("00:00:00:00:00:02", 121, 0)])
def test_address_conflict(spark, second, gap, n):
    rows = arp(spark, [("00:00:00:00:00:01", "10.0.0.5", 2, 0), (second, "10.0.0.5", 2, gap)])
    assert detect.address_conflicts(rows, spark.createDataFrame([], NONE)).count() == n


def test_randomized_pair_is_no_conflict(spark):
    rows = arp(spark, [("02:00:00:00:00:01", "10.0.0.5", 2, 0), ("06:00:00:00:00:02", "10.0.0.5", 2, 5)])
    assert detect.address_conflicts(rows, spark.createDataFrame([], NONE)).count() == 0


@pytest.mark.parametrize(("first", "infra", "n"), [("00", [], 1), ("02", [], 0), ("00", ["00:00:00:00:00:01"], 0)])
def test_flip_flop(spark, first, infra, n):
    macs = [f"{first}:00:00:00:00:0{i}" for i in (1, 2, 3)]
    rows = arp(spark, [(macs[i % 3], "10.0.0.7", 2, i) for i in range(4)])
    known = spark.createDataFrame([(x,) for x in infra], "hw_addr string")
    assert detect.flip_flops(rows, known).count() == n


def test_throttle_restarts_only_when_fired(spark):
    df = spark.createDataFrame([("a", t) for t in (0, 4, 9, 11, 19, 21, 40)], "k string, us long")
    assert sorted(r.us for r in throttle.throttled(df, ["k"], "us", 10).collect()) == [0, 11, 21, 40]


@pytest.mark.parametrize("size", [1, 3, 500])
def test_throttle_over_batches(size):
    rng = random.Random(size)
    rows = sorted((rng.choice(["a", "b", None]) or "", rng.randrange(200)) for _ in range(150))
    want, last = [], {}
    for k, us in rows:
        if k not in last or us - last[k] >= 7:
            want.append((k, us))
            last[k] = us
    table = pa.table({"k": [k or None for k, _ in rows], "us": [us for _, us in rows]})
    got = throttle._firing(["k"], "us", 7)(iter(table.to_batches(max_chunksize=size)))
    assert [(r["k"] or "", r["us"]) for part in got for r in part.to_pylist()] == want


def test_sliding_windows_without_a_frame_for_each_row(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice("ab"), rng.randrange(60), rng.choice("xyz")) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, k string, us long, v string")
    count = throttle.sliding_count(df, ["k"], "us", 10)
    changes = throttle.sliding_changes(df, ["k"], "us", "id", "v", 10)
    within = {i: sorted((t, j, w) for j, o, t, w in rows if o == k and us - 10 < t <= us) for i, k, us, _ in rows}
    assert {r.id: r.n for r in count.collect()} == {i: len(x) for i, x in within.items()}
    assert {r.id: r.changes for r in changes.collect()} == {i: sum(a[2] != b[2] for a, b in zip(x, x[1:])) for i, x in within.items()}
    arp_rows = arp(spark, [("00:00:00:00:00:01", "10.0.0.7", 2, 0)])
    known = spark.createDataFrame([], "hw_addr string")
    for out in (count, changes, detect.flip_flops(arp_rows, known), detect.gratuitous_bursts(arp_rows, known)):
        # A frame that is open behind is one running pass; a bounded one is gone through again for each row.
        assert "RangeFrame, -" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_hostnames(spark):
    good = ["alice-pc", "nas", "DESKTOP-4F2K", "my.home", "tv-2"]
    bad = ["", None, "10.0.0.1", "_airplay", "x._tcp.local", "a.b.example.com", "123e4567-e89b-12d3-a456-426614174000", "f80f-f9c5-49d2", "fuchsia-f80f-f9c5-49d2", "deadbeef01", "ESP_32AB12CD", "fe80::1"]
    got = {r.n: r.ok for r in spark.createDataFrame([(x,) for x in good + bad], "n string").select("n", names.valid_hostname(F.col("n")).alias("ok")).collect()}
    assert all(got[x] for x in good) and not any(got[x] for x in bad)


def test_mac_and_ip(spark):
    rows = [("02:42:ac:11:00:02", False), ("52:54:00:12:34:56", False), ("da:a1:19:00:00:01", True), ("00:1a:2b:00:00:01", False)]
    df = spark.createDataFrame(rows, "m string, want boolean").select("want", mac.randomized(F.col("m")).alias("got"))
    assert all(r.want == r.got for r in df.collect())
    r = spark.createDataFrame([("192.168.17.5", "x")], "a string, b string").select(ip.subnet(F.col("a"), 20).alias("n"), ip.private(F.col("a")).alias("p"), ip.to_number(F.col("b")).alias("x")).first()
    assert (r.n, r.p, r.x) == ("192.168.16.0/20", True, 4294967295)


def test_subset_join_penalty(spark):
    p = spark.createDataFrame([(1, "1,3,6,15,31,33", 90, "W"), (2, "1,3,6", 80, "S")], "priority int, options string, confidence int, os string")
    df = spark.createDataFrame([("1,3,6,15,31,33,43",), ("1,3,6,15,31,33",), ("1,3,6,9",), (None,)], "o string")
    got = {r.o: (r.os, r.confidence, r.match) for r in lookups.subset_join(df, "o", p).collect()}
    assert got == {"1,3,6,15,31,33,43": ("W", 65, "subset"), "1,3,6,15,31,33": ("W", 90, "exact"), "1,3,6,9": (None, None, None), None: (None, None, None)}


def test_leases(spark, tmp_path):
    lines = ["1745064000 AA:bb:cc:dd:ee:11 10.0.0.10 alice-pc 01:aa", "1745064000 zz:zz 10.0.0.2 x", "short", "0 aa:bb:cc:dd:ee:12 10.0.0.11 * *"]
    got = feeds.dnsmasq_leases(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert [(r.hw_addr, r.hostname) for r in got] == [("aa:bb:cc:dd:ee:11", "alice-pc"), ("aa:bb:cc:dd:ee:12", None)]
    isc = 'lease 10.0.0.5 {\n  hardware ethernet AA:bb:cc:00:00:01;\n  client-hostname "pc";\n}\nlease 10.0.0.6 {\n hardware ethernet aa:bb:cc:00:00:02;\n}\n'
    got = feeds.isc_leases(spark.createDataFrame([(isc,)], "value string")).collect()
    assert [(r.ip_addr, r.hostname) for r in got] == [("10.0.0.5", "pc"), ("10.0.0.6", None)]


def frame(kind, body=b""):
    return bytes.fromhex("ffffffffffff" + "001a2b000001") + kind + body


def test_captures(spark, tmp_path):
    a = frame(b"\x08\x06", bytes.fromhex("0001080006040002" + "001a2b000001" + "0a000005" + "000000000000" + "0a000001"))
    ipv4 = lambda proto, rest: bytes.fromhex("45000028000040004000") [:8] + b"\x40" + bytes([proto]) + b"\0\0" + bytes([10, 0, 0, 5]) + bytes([10, 0, 0, 9]) + rest
    syn = frame(b"\x08\x00", ipv4(6, bytes.fromhex("c3500050" + "00000000" + "00000000" + "50022000" + "00000000")))
    dns = frame(b"\x08\x00", ipv4(17, bytes.fromhex("c3500035" + "00200000" + "0001" + "0100") + b"\0" * 8))
    odd = frame(b"\x12\x34", b"zz")
    frames = [(1_700_000_000_000_001 + i, f) for i, f in enumerate((a, syn, dns, odd))]
    (tmp_path / "x.pcap").write_bytes(capture.write_pcap(frames) + b"\1\2")
    (tmp_path / "bad.pcap").write_bytes(b"nothing")
    raw = capture.read_pcap(spark, str(tmp_path))
    assert [(r.us, bytes(r.frame)) for r in raw.orderBy("n").collect()] == frames
    got = capture.typed(raw).orderBy("n").collect()
    assert [r.protocol for r in got] == ["arp", "tcp_syn", "dns", "unclassified"]
    assert (got[0].hw_addr, got[0].ip_addr, got[0].target_ip, got[0].op) == ("00:1a:2b:00:00:01", "10.0.0.5", "10.0.0.1", 2)
    assert (got[1].ttl, got[1].port, got[1].window_size) == (64, 80, 8192)


def test_sensor_frames_span_messages(spark):
    import struct

    data = b"".join(struct.pack(">IqI", len(f), 5000 * i, i) + f for i, f in enumerate((b"one", b"", b"three" * 9)))
    rows = [("s", 0, i, data[a : a + 7]) for i, a in enumerate(range(0, len(data), 7))]
    got = capture.sensor_frames(spark.createDataFrame(rows, "sensor string, batch long, seq long, body binary")).orderBy("n").collect()
    assert [(r.us, r.interface, bytes(r.frame)) for r in got] == [(0, 0, b"one"), (5, 1, b""), (10, 2, b"three" * 9)]


def test_xml_and_json_feeds(spark, tmp_path):
    (tmp_path / "f.xml").write_text('<fingerprints><fingerprint pattern="^Apache/(.*)$"><description>d</description><param pos="1" name="version" value=""/></fingerprint></fingerprints>')
    r = feeds.xml_patterns(spark, str(tmp_path / "f.xml")).first()
    assert r.pattern == "^Apache/(.*)$" and r.params[0]._name == "version"
    (tmp_path / "l.jsonl").write_text('{"a": 1}\n{bad\n{"a": 3}\n')
    assert sorted(x.a for x in feeds.json_lines(spark, str(tmp_path / "l.jsonl"), "a int").collect()) == [1, 3]


@pytest.mark.parametrize("text", ["DROP TABLE x", "SELECT 1; SELECT 2", "select * from x where drop", "update x set a=1"])
def test_sql_guard(spark, text):
    with pytest.raises(ValueError, match="read-only"):
        feeds.guarded_sql(spark, text)


def test_offline_threshold(spark):
    rows = [(300, "phone", False, 1800), (300, "router", True, 1800), (600, "printer", True, 600), (None, None, None, 300)]
    df = spark.createDataFrame(rows, "base int, kind string, rnd boolean, want int")
    assert all(r.got == r.want for r in df.select("want", detect.offline_threshold(F.col("base"), F.col("kind"), F.col("rnd")).alias("got")).collect())


def test_affinity_drift(spark):
    rows = [("m", i, "Apple") for i in range(25)] + [("m", 1000 + i, "Microsoft") for i in range(50)] + [("n", i, "Apple") for i in range(60)]
    got = detect.affinity_drift(spark.createDataFrame(rows, "hw_addr string, us long, vendor string"), 100).collect()
    assert [(r.hw_addr, r.from_vendor, r.to_vendor) for r in got] == [("m", "Apple", "Microsoft")]


def test_as_of_and_links_take_every_packet(spark):
    from types import SimpleNamespace

    from wirefold.plans import topology
    from wirefold.plans.base import DAY
    from wirefold.plans.lookups import _as_of_previous

    rng = random.Random(3)
    packets = [(i, f"h{rng.randint(0, 3)}", 8200 * DAY + rng.randint(0, 40), rng.randint(0, 99), "arp", f"ip{i % 2}") for i in range(120)]
    evidence = [(i, f"h{rng.randint(0, 2)}", rng.randint(0, 40), f"v{i}") for i in range(30)]
    t = SimpleNamespace(packets=spark.createDataFrame(packets, "packet_id long, hw_addr string, us long, k int, protocol string, ip_addr string"), evidence=spark.createDataFrame(evidence, "id long, hw_addr string, us long, vendor string"))
    got = {r.packet_id: r.vendor for r in _as_of_previous(t, t.packets).collect()}
    want = {}
    for i, h, us, *_ in packets:
        before = [(e[2], e[0], e[3]) for e in evidence if e[1] == h and e[2] <= us - 8200 * DAY]
        want[i] = max(before)[2] if before else None
    assert got == want
    pairs = set()
    for ip in ("ip0", "ip1"):
        mine = [h for _, h in sorted(((p[2], p[0]), p[1]) for p in packets if p[5] == ip)]
        pairs |= set(zip(mine[1:], mine))
    assert {tuple(r) for r in topology.links(t, "true").collect()} == pairs
    assert {"j18_as_of_previous_all", "g03_edges_all", "g04_neighbours_all"} <= set(catalog.queries())


def test_containment_by_anchor_is_whole(spark):
    """Short, long and equal rules against plain containment of every pair."""
    texts = ["", "a", "ab", "ABc", "xabcab", "dhcpcd-5.5", "zz", None]
    rules = [("a", 1), ("B", 2), ("bc", 3), ("abc", 4), ("ABCA", 5), ("cpcd-5", 6), ("q", 7)]
    df = spark.createDataFrame([(t,) for t in texts], "o string")
    out = lookups.longest_substring_join(df, "o", spark.createDataFrame(rules, "text string, n int"))
    met = {t: [r for r in rules if t is not None and r[0].lower() in t.lower()] for t in texts}
    want = {t: min(m, key=lambda r: (-len(r[0]), r[0]))[1] if m else None for t, m in met.items()}
    assert {r.o: r.n for r in out.collect()} == want


def test_large_pattern_tables_are_not_broadcast(spark):
    patterns = spark.createDataFrame([(str(i),) for i in range(5)], "text string")
    assert "ResolvedHint" in lookups.bounded(patterns, 5)._jdf.queryExecution().analyzed().toString()
    assert "ResolvedHint" not in lookups.bounded(patterns, 4)._jdf.queryExecution().analyzed().toString()


def test_subset_by_rarest_option(spark):
    """Against plain inclusion of every pair; the largest pattern, then the first."""
    texts = ["1,2,3,4,5,6,7", "7,6,5", "2", "1,1,2", None]
    rules = [(1, "1,2", 90, "a"), (2, "5,6,7", 80, "b"), (3, "2", 70, "c"), (4, "9,1", 60, "d"), (5, "1,2", 50, "e")]
    p = spark.createDataFrame(rules, "priority int, options string, confidence int, os string")
    out = lookups.subset_join(spark.createDataFrame([(t,) for t in texts], "o string"), "o", p, least=1)
    want = {}
    for t in texts:
        mine = t.split(",") if t else []
        equal = [r for r in rules if r[1] == t]
        part = [r for r in rules if t and set(r[1].split(",")) <= set(mine) and len(r[1].split(",")) < len(mine)]
        best = min(equal, key=lambda r: r[0]) if equal else min(part, key=lambda r: (-len(r[1].split(",")), r[0])) if part else None
        want[t] = best and best[3]
    assert {r.o: r.os for r in out.collect()} == want
