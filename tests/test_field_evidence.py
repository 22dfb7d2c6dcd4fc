"""Evidence from fields, exposure of plain HTTP and leaking VLANs, backoff: hand-made cases."""

from pyspark.sql import functions as F

from wirefold.functions import names
from wirefold.operators import exposure, field_evidence, lifecycle


def test_evidence(spark):
    rows = [
        ("dhcpv4", {"hostname": "alice-pc", "opt60": "MSFT 5.0", "client_id": "Cisco-1234"}), ("dhcpv4", {"hostname": "a1b2c3d4e5f6", "client_id": "00:1a:2b:00:00:01", "opt55": "1,3"}),
        ("igmp", {"group": "239.1.2.3"}), ("igmp", {"group": "239.255.255.250"}), ("igmp", {}), ("eap", {"identity": "bob"}), ("radius", {"is_server": "true"}), ("tls", {}), ("nonsense", {"a": "b"}),
        (None, {"a": "b"}), ("http_useragent", {"user_agent": "Mozilla (Linux; Android 13; SM-G998B)", "host": "x"}), ("http_useragent", {"user_agent": "curl"}), ("dns", None),
    ]
    frame = spark.createDataFrame([(i, "m", p, f) for i, (p, f) in enumerate(rows)] + [(99, None, "arp", {})], "packet_id long, hw_addr string, protocol string, fields map<string,string>")
    got = sorted((r.packet_id, r.source, r.certainty, r.category, r.vendor, r.platform, r.hostname) for r in field_evidence.evidence(frame).collect())
    none = None
    want = [
        (0, "dhcpv4", 0.7, none, "Cisco-1234", none, none), (0, "dhcpv4", 0.75, none, none, none, "alice-pc"), (0, "dhcpv4_vendor", 0.8, none, none, none, none),
        (1, "dhcpv4", 0.7, none, none, none, none), (1, "dhcpv4_fingerprint", 0.7, none, none, none, none), (2, "igmp", 0.3, "media_device", none, none, none),
        (3, "igmp", 0.4, none, none, none, none), (4, "igmp", 0.4, none, none, none, none), (5, "eap", 0.6, none, none, none, "bob"), (6, "radius", 0.7, "server", none, none, none),
        (10, "http_host", 0.4, none, none, none, none), (10, "http_useragent", 0.8, none, "Samsung", "Android", none), (11, "http_useragent", 0.8, none, none, none, none),
    ]
    assert got == want


def test_exposure(spark):
    probes = [("a", 80, '{"service": "http"}'), ("a", 80, '{"service": "http", "tls": false}'), ("b", 8443, '{"service": "http"}'), ("c", 81, '{"service": "http", "tls": true}'), ("d", 82, "{broken"), ("e", 83, None)]
    got = exposure.plain_http(spark.createDataFrame(probes, "hw_addr string, port int, result string")).collect()
    assert [tuple(r) for r in got] == [("TC-002", "medium", "a", 80)]
    arp = [("a", "10.0.0.1"), ("a", "10.0.15.1"), ("b", "10.0.0.1"), ("b", "10.0.16.1"), ("r", "10.0.0.1"), ("r", "10.9.0.1"), ("c", "0.0.0.0"), ("c", "10.0.0.1"), ("c", None), ("c", "fe80::1")]
    got = exposure.vlan_leakage(spark.createDataFrame(arp, "hw_addr string, ip_addr string"), spark.createDataFrame([("r", "router"), ("b", None)], "hw_addr string, category string")).collect()
    assert [(r.hw_addr, r.subnets) for r in got] == [("b", ["10.0.0.0/20", "10.0.16.0/20"])]


def test_backoff(spark):
    outcomes = [True, True, False, True, True, True, True, True, True, True, True, True, False]
    runs = spark.createDataFrame([("x", i, f) for i, f in enumerate(outcomes)] + [("y", 0, False)], "importer string, id long, failed boolean")
    got = {(r.importer, r.id): (r.level, r.seconds) for r in lifecycle.backoff(runs, "importer", ["id"], F.lit(300)).collect()}
    assert [got["x", i][0] for i in range(13)] == [1, 2, 0, 1, 2, 3, 4, 5, 6, 7, 7, 7, 0] and got["y", 0][0] == 0
    for (_, _), (level, seconds) in got.items():
        base = 300 if not level else lifecycle.LADDER[level - 1]
        assert abs(seconds - base) <= base // 5
    assert len({s for _, s in got.values()}) > 4


def test_hostname_keywords(spark):
    rows = [("Kitchen-Hue", "Signify", True), ("Kitchen-Hue", "Sonos", False), ("spring", "Apple", False), ("spring", "ring", True), ("alice", "x", True), (None, "x", True), ("echo", None, True), ("echo", "", True), ("my-echo", "Amazon Technologies", True)]
    frame = spark.createDataFrame(rows, "h string, v string, want boolean")
    assert frame.where(names.coherent(F.col("h"), F.col("v")) != F.col("want")).collect() == []
