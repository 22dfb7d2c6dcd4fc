"""Packet-domain views over the relational tables.

Every view is integer arithmetic on keys, so each has an exact SQL twin in
``wirefold.plans.oracle``.  Views are lazy; only what a query selects is read.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import mac as macs

# Fixed values the views deal out by an integer.
PROTOCOLS = {"click": "dns", "view": "mdns", "purchase": "arp", "signup": "dhcpv4", "error": "tcp_syn"}
DOMAINS = ["icloud.com", "update.microsoft.com", "clients.google.com", "api.amazon.com", "www.example.org", "time.apple.com"]
PORTS = [80, 443, 22, 53, 161, 21, 23, 1883, 502, 3306]
HOSTNAMES = ["alice-pc", "Bobs-iPhone", None, "DESKTOP-4F2K", "a1b2c3d4e5f6", "192.168.1.5", "printer._ipp._tcp", "www.mail.example.com", "galaxy-s9.local"]
OPT55 = ["1,3,6,15,31,33,43,44", "1,121,3,6,15,119,252", "1,3,6,15,26,28,51,58,59,43", "3,1,6", "1,3,6,12,15,28,42", "6,3,1,15,66,67"]
OPT60 = ["MSFT 5.0", "dhcpcd-5.5.6:Linux", "android-dhcp-9", None]
AGENTS = [
    "Mozilla/5.0 (Windows NT 10.0; Win64; x64)", "Mozilla/5.0 (iPhone; CPU iPhone OS 16_2 like Mac OS X)", "Mozilla/5.0 (Linux; Android 13; SM-G998B)",
    "curl/7.88.1", "Mozilla/5.0 (Macintosh; Intel Mac OS X 10_15_7)", "Mozilla/5.0 (X11; Linux x86_64)",
]
SERVICES = ["_googlecast._tcp", "_airplay._tcp", "_ipp._tcp", "_ssh._tcp", "_hap._tcp", None]
BANNERS = ["SSH-2.0-OpenSSH_8.9p1 Ubuntu-3", "220 ProFTPD 1.3.5 Server ready", "HTTP/1.1 200 OK Server: nginx/1.18.0", "* OK Dovecot ready", "SSH-2.0-dropbear_2019.78", "RFB 003.008"]
SOURCES = ["oui", "dhcpv4", "mdns", "lldp", "satori_dhcp", "huginn_device"]
VENDORS = ["Apple", "Samsung", "Cisco", "HP", "Sonos", "unknown", "Synology"]
CATEGORIES = ["phone", "printer", "router", None, "server", "smart_tv", "unknown", "nas"]
PLATFORMS = ["iOS", "Windows", None, "Linux", "Android"]
MODELS = ["m1", None, "m2", None]
RULES = ["mac_spoofing", "identity_shift", "addr_conflict", "low_certainty", "new_host"]
SEVERITIES = {"mac_spoofing": "high", "identity_shift": "critical", "addr_conflict": "warning", "low_certainty": "low", "new_host": "info"}
CRITICALITY = {"BUILDING": "critical", "AUTOMOBILE": "high", "MACHINERY": "medium", "HOUSEHOLD": "low"}
AUTHORIZATION = ["approved", "rejected", "unapproved"]


def pick(index: Column, values: list) -> Column:
    """The value at ``index`` modulo the list's length."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(index, F.lit(len(values))) + 1).cast("int"))


def mapped(key: Column, values: dict) -> Column:
    out = F.lit(None)
    for k, v in values.items():
        out = F.when(key == k, v).otherwise(out)
    return out


def mac_of(n: Column) -> Column:
    n = n.cast("long")
    byte = lambda x: F.lpad(F.lower(F.hex(F.pmod(x, F.lit(256)))), 2, "0")
    first = F.when(n % 5 == 0, "d2").otherwise("00")
    return F.concat(first, F.lit(":1a:2b:"), byte(F.shiftright(n, 16)), F.lit(":"), byte(F.shiftright(n, 8)), F.lit(":"), byte(n))


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


class Tables:
    """The views of one folder of tables."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def packets(self) -> DataFrame:
        k = F.get_json_object("props", "$.k").cast("int")
        e = self.raw("events").select(F.col("event_id").alias("packet_id"), micros(F.col("ts")).alias("us"), "user_id", "event_type", "value", k.alias("k"))
        k, u = F.col("k"), F.col("user_id")
        ip = F.concat(F.lit("10.0."), (k % 4).cast("string"), F.lit("."), (k % 20 + 1).cast("string"))
        return e.select(
            "packet_id", "us", "user_id", mac_of(u).alias("hw_addr"), "k", mapped(F.col("event_type"), PROTOCOLS).alias("protocol"), ip.alias("ip_addr"),
            (k % 2 + 1).alias("op"), F.when(k % 3 == 0, ip).otherwise("10.0.0.1").alias("target_ip"), pick(k, [64, 128, 255]).alias("ttl"),
            pick(k, DOMAINS).alias("query_name"), F.concat(F.lit("eth"), (u % 2).cast("string")).alias("interface"), ((k + 1) / 100).alias("certainty"),
            pick(k, PORTS).alias("port"), pick(u, HOSTNAMES).alias("hostname"), pick(k, OPT55).alias("opt55"), pick(k, OPT60).alias("opt60"),
            pick(k, AGENTS).alias("user_agent"), pick(k, SERVICES).alias("service"), pick(k, BANNERS).alias("banner"), "value",
        )

    @cached_property
    def devices(self) -> DataFrame:
        c = F.col("c_custkey")
        return self.raw("customer").select(
            mac_of(c).alias("mac"), F.col("c_name").alias("owner"), F.concat(F.lit("nation-"), F.col("c_nationkey").cast("string")).alias("location"),
            mapped(F.col("c_mktsegment"), CRITICALITY).alias("criticality"), pick(c, AUTHORIZATION).alias("authorization"),
            F.when(c % 4 == 0, F.array(F.lit("prod"), F.lit("core"))).when(c % 4 == 1, F.array(F.lit("lab"))).otherwise(F.array().cast("array<string>")).alias("tags"),
            F.when(c % 7 != 0, F.col("c_acctbal") > 0).alias("is_online"), pick(c, [300, 300, 600, 1200]).alias("threshold"),
            pick(c, CATEGORIES).alias("device_type"), F.when(c % 6 != 0, F.concat(F.lit("host-"), c.cast("string"))).alias("hostname"), c.alias("custkey"),
        )

    @cached_property
    def findings(self) -> DataFrame:
        digit = F.substring("o_orderpriority", 1, 1).cast("int")
        rule = pick(digit - 1, RULES)
        k = F.col("o_orderkey")
        return self.raw("orders").select(
            k.alias("id"), mac_of(F.col("o_custkey")).alias("hw_addr"), rule.alias("rule"), mapped(rule, SEVERITIES).alias("severity"),
            (F.col("o_orderstatus") == "F").alias("resolved"), micros(F.col("o_orderdate")).alias("us"),
            F.when(k % 9 == 0, "snoozed").when(k % 4 == 0, "acknowledged").otherwise("open").alias("status"),
            F.when(k % 9 == 0, micros(F.col("o_orderdate")) + (k % 5) * 86400000000 * 300).alias("snoozed_until"),
            F.concat(rule, F.lit(" on "), mac_of(F.col("o_custkey")), F.lit(" #"), (k % 50).cast("string")).alias("message"),
        )

    @cached_property
    def evidence(self) -> DataFrame:
        o, p, s, n = (F.col(f"l_{x}") for x in ("orderkey", "partkey", "suppkey", "linenumber"))
        rank = F.pmod(o * 31 + p * 7 + n, F.lit(97))
        return self.raw("lineitem").select(
            ((o * 8 + n) * 10_000_000 + p * 1000 + s % 1000).alias("id"), mac_of(o % 500).alias("hw_addr"), pick(n, SOURCES).alias("source"), F.least(F.col("l_discount") * 10, F.lit(1.0)).alias("certainty"),
            pick(s, VENDORS).alias("vendor"), pick(p, CATEGORIES).alias("category"), pick(p + s, PLATFORMS).alias("platform"),
            F.when(rank % 3 == 0, F.concat(F.lit("host-"), (o % 40).cast("string"))).alias("hostname"), pick(s, MODELS).alias("model"),
            micros(F.col("l_shipdate")).alias("us"),
        )

    @cached_property
    def hosts(self) -> DataFrame:
        """The newest state of each address (the merge rules of D01)."""
        at = F.struct("us", "packet_id")
        return self.packets.groupBy("hw_addr").agg(
            F.max_by("ip_addr", at).alias("ip_addr"), F.min("us").alias("discovered_us"), F.max("us").alias("last_us"),
            F.max(macs.randomized(F.col("hw_addr")).cast("int")).alias("randomized"), F.count("*").alias("packets"),
        ).withColumn("disposition", F.when(F.col("packets") > 60, "known").otherwise("new"))

    @cached_property
    def verdicts(self) -> DataFrame:
        from ..operators import fusion

        return fusion.verdicts(self.evidence, fusion.weight_table(self.spark))

    @cached_property
    def now(self) -> Column:
        """The newest packet's time, as a one-row subquery."""
        return self.packets.select(F.max("us")).scalar()

    @cached_property
    def urls(self) -> DataFrame:
        return self.raw("pages").select("page_id", F.lower(F.regexp_extract("url", "^[a-z]+://([^/:?#]+)", 1)).alias("host"))
