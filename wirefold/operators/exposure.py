"""Defensive exposure rules: which weaknesses the observed traffic shows.

A passive rule is a predicate over the fields of observations and a condition on
how many devices or values met it.  All predicates are evaluated in one pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ip

# Rule, severity, predicate over an observation's own fields, the
# value that is counted, and the least distinct values that make the rule hold.
RULES = [
    ("NR-001", "high", "source = 'llmnr'", "hw_addr", 1),
    ("NR-002", "high", "source = 'netbios'", "hw_addr", 1),
    ("NR-003", "info", "source = 'mdns'", "hw_addr", 1),
    ("NR-004", "high", "source IN ('dns', 'netbios') AND lower(query_name) LIKE '%wpad%'", "hw_addr", 1),
    ("L2-001", "medium", "source = 'arp'", "hw_addr", 25),
    ("L2-003", "medium", "source = 'arp' AND op = 2 AND ip_addr = target_ip", "hw_addr", 1),
    ("L2-004", "low", "source = 'icmpv6_na' AND override AND coalesce(category, '') NOT IN ('router', 'gateway', 'firewall')", "hw_addr", 1),
    ("L2-005", "medium", "true", "hw_addr", 100),
    ("L2-006", "info", "source IN ('cdp', 'lldp')", "hw_addr", 1),
    ("L2-007", "high", "source = 'dtp' AND negotiating", "hw_addr", 1),
    ("L2-009", "high", "source = 'stp'", "root_mac", 2),
    ("DH-001", "info", "source = 'dhcpv4' AND message_type IN (1, 3)", "hw_addr", 1),
    ("DH-002", "high", "source = 'dhcp_anomaly'", "hw_addr", 1),
    ("DH-003", "high", "source = 'dhcpv4' AND message_type IN (2, 5)", "server_id", 2),
    ("DH-004", "info", "source = 'dhcpv6'", "hw_addr", 1),
    ("RT-001", "info", "source = 'icmpv6_ra'", "hw_addr", 1),
    ("RT-002", "high", "source = 'probe' AND service IN ('hsrp', 'vrrp', 'bgp', 'ospf', 'eigrp', 'rip')", "hw_addr", 1),
    ("RT-003", "low", "category IN ('router', 'gateway', 'firewall') AND ip_addr IS NOT NULL", "hw_addr", 1),
    ("TC-001", "medium", "source = 'tls' AND tls_version < 771", "hw_addr", 1),
    ("NI-001", "low", "source = 'ssdp'", "hw_addr", 1),
    ("NI-002", "low", "source = 'dns' AND rtrim('.', lower(query_name)) RLIKE '[.](local|internal|corp|lan|home|intranet)$'", "hw_addr", 1),
    ("NI-003", "info", "category IN ('router', 'gateway', 'firewall')", "hw_addr", 2),
    ("CRED-001", "high", "port IN (21, 23, 110, 143, 161)", "hw_addr", 1),
    ("CRED-002", "info", "replace(lower(category), ' ', '_') IN ('ip_camera', 'camera', 'doorbell', 'smart_home', 'thermostat', 'smart_plug', 'smart_lock', 'printer', 'microcontroller', 'plc', 'hmi', 'robot_vacuum')", "hw_addr", 1),
]
#: Rules whose severity rises when more than one device met them.
CONTESTED = {"RT-001": "high"}

# Service rules, the service names they look for, severities.
SERVICES = [
    ("SE-001", ["telnet"], "high"), ("SE-002", ["ftp"], "high"), ("SE-003", ["smb", "cifs", "microsoft-ds"], "high"), ("SE-004", ["snmp"], "high"),
    ("SE-005", ["ssh"], "medium"), ("SE-006", ["rdp", "ms-wbt-server"], "high"), ("SE-007", ["mssql", "ms-sql-s"], "high"),
    ("SE-008", ["mysql", "mariadb", "postgresql", "postgres"], "high"), ("SE-009", ["modbus"], "critical"), ("SE-010", ["dnp3"], "critical"),
    ("SE-011", ["bacnet"], "critical"), ("SE-012", ["enip", "ethernet_ip"], "critical"), ("SE-013", ["iec61850"], "critical"), ("SE-014", ["ethercat"], "high"),
    ("SE-015", ["modbus_rtu"], "critical"), ("SE-016", ["ff_hse"], "high"), ("SE-017", ["canopen"], "high"), ("SE-018", ["ldap"], "high"),
    ("SE-019", ["kerberos"], "high"), ("SE-020", ["docker_api", "docker"], "critical"), ("SE-021", ["kubernetes_api", "kubernetes"], "critical"),
    ("SE-023", ["imap", "pop3"], "medium"), ("SE-024", ["iolink"], "medium"), ("SE-025", ["ollama"], "critical"),
    ("SE-026", ["vllm", "openai_compat", "sglang", "localai", "llamacpp", "lm_studio"], "high"), ("SE-027", ["gradio", "stable_diffusion", "comfyui", "fooocus"], "high"),
    ("SE-028", ["litellm", "openwebui", "anythingllm"], "high"), ("SE-029", ["triton", "nvidia_nim", "tensorrt_llm", "ray_serve", "bentoml"], "high"),
    ("SE-030", ["ipmi", "bmc"], "critical"), ("SE-031", ["vnc"], "high"), ("SE-032", ["winrm", "wsman"], "high"),
]

# Chains of rules, how they match, and what must be present.
CHAINS = [
    ("CHAIN-001", "critical", ["NR-001", "NR-002"], "any", "windows"), ("CHAIN-002", "critical", ["L2-007"], "any", None), ("CHAIN-003", "critical", ["DH-003", "NR-004"], "custom", None),
    ("CHAIN-004", "high", ["RT-001"], "any", "windows"), ("CHAIN-005", "critical", ["SE-009", "SE-010", "SE-011", "SE-012"], "any", "ics"), ("CHAIN-006", "critical", ["NR-001", "SE-003"], "all", "windows"),
    ("CHAIN-007", "critical", ["DH-004", "NR-004"], "custom", "windows"), ("CHAIN-008", "high", ["L2-001", "SE-001", "SE-002", "SE-004", "SE-023"], "custom", None), ("CHAIN-009", "critical", ["NR-001", "SE-018"], "all", "windows"),
    ("CHAIN-010", "high", ["L2-009"], "any", None),
]
WINDOWS = ["NR-002", "SE-003", "SE-018", "SE-019", "SE-032"]
ICS = ["SE-009", "SE-010", "SE-011", "SE-012", "SE-013", "SE-014", "SE-015", "SE-016", "SE-017", "SE-024"]
ACTIONABLE = ["medium", "high", "critical"]
# Fixed value: newest observations of a device and source that are looked at.
SCANNED = 5_000


def passive(observations: DataFrame, rules: list) -> DataFrame:
    """(rule, severity, devices, distinct) of all rules that hold.

    A rule is (name, severity, predicate, least devices, least values).
    """
    met = F.array_compact(F.array(*[F.when(F.expr(p), F.lit(r)) for r, _, p, _, _ in rules]))
    rows = observations.select("hw_addr", "value", F.explode(met).alias("rule")).distinct()
    n = rows.groupBy("rule").agg(F.countDistinct("hw_addr").alias("devices"), F.countDistinct("value").alias("distinct"))
    spec = rows.sparkSession.createDataFrame([(r, s, d, v) for r, s, _, d, v in rules], "rule string, severity string, _d int, _v int")
    out = n.join(F.broadcast(spec), "rule")  # the fixed list of rules
    return out.where((F.col("devices") >= F.col("_d")) & (F.col("distinct") >= F.col("_v"))).drop("_d", "_v")


def observed(observations: DataFrame, rules: list = RULES) -> DataFrame:
    """(rule, severity, devices) of the passive rules that the observations' fields meet.

    Null fields meet no predicate.  One pass marks all rules of a row; its rows are
    reduced to distinct (rule, device, value) before anything is counted.
    """
    marks = F.array_compact(F.array(*[F.when(F.expr(p), F.struct(F.lit(r).alias("rule"), F.expr(v).cast("string").alias("value"))) for r, _, p, v, _ in rules]))
    rows = observations.select("hw_addr", F.explode(marks).alias("m")).select("hw_addr", "m.*").distinct()
    n = rows.groupBy("rule").agg(F.countDistinct("hw_addr").alias("devices"), F.countDistinct("value").alias("_n"))
    spec = rows.sparkSession.createDataFrame([(r, s, CONTESTED.get(r, s), least) for r, s, _, _, least in rules], "rule string, one string, more string, least int")
    met = n.join(F.broadcast(spec), "rule").where("_n >= least")  # the fixed list of rules
    return met.select("rule", F.when(F.col("devices") > 1, F.col("more")).otherwise(F.col("one")).alias("severity"), "devices")


def services(probes: DataFrame) -> DataFrame:
    """(rule, severity, devices) from probe results (hw_addr, service)."""
    spec = probes.sparkSession.createDataFrame([(r, n, s) for r, names, s in SERVICES for n in names], "rule string, service string, severity string")
    return probes.join(F.broadcast(spec), "service").groupBy("rule", "severity").agg(F.countDistinct("hw_addr").alias("devices"))


def chains(found: DataFrame) -> DataFrame:
    """Chains whose rules and environment are all present in ``found`` (rule, severity)."""
    ids = found.agg(
        F.coalesce(F.collect_set("rule"), F.array().cast("array<string>")).alias("every"),
        F.coalesce(F.collect_set(F.when(F.col("severity").isin(ACTIONABLE), F.col("rule"))), F.array().cast("array<string>")).alias("acting"),
    )  # fmt: skip  # at most as many as there are rules
    spec = found.sparkSession.createDataFrame(CHAINS, "chain string, severity string, needs array<string>, mode string, environment string")
    met = F.broadcast(spec).crossJoin(ids)  # ten chains and one row
    has = lambda names: F.arrays_overlap("every", F.array(*map(F.lit, names)))
    env = F.when(F.col("environment") == "windows", has(WINDOWS)).when(F.col("environment") == "ics", has(ICS)).otherwise(True)
    first = F.array_contains("acting", F.col("needs")[0])
    rest = F.arrays_overlap(F.slice("needs", F.lit(2), F.size("needs")), F.col("acting"))
    match = F.when(F.col("mode") == "any", F.arrays_overlap("needs", "acting")).when(F.col("mode") == "custom", first & rest).otherwise(F.size(F.array_except("needs", "acting")) == 0)
    return met.where(env & match).select("chain", "severity", F.array_sort(F.array_intersect("needs", "acting")).alias("triggers"))


# Ports that speak TLS, and device types that join networks by design.
TLS_PORTS = [443, 8443, 4443]
BRIDGING = ["router", "gateway", "firewall", "switch", "access_point", "network_device", "mesh_router", "wireless_bridge", "load_balancer", "cable_modem"]


def plain_http(probes: DataFrame) -> DataFrame:
    """Rule TC-002: HTTP services that a probe found without TLS.

    ``probes``: hw_addr, port, result (JSON with service and tls).  Returns
    rule, severity, hw_addr, port of each; broken results count as no service.
    """
    found = probes.withColumn("_r", F.from_json("result", "service string, tls boolean"))
    bare = (F.col("_r.service") == "http") & ~F.col("port").isin(TLS_PORTS) & ~F.coalesce("_r.tls", F.lit(False))
    return found.where(bare).select(F.lit("TC-002").alias("rule"), F.lit("medium").alias("severity"), "hw_addr", "port").distinct()


def vlan_leakage(arp: DataFrame, types: DataFrame) -> DataFrame:
    """Rule L2-008: endpoints that announce addresses of several /20 networks.

    ``arp``: hw_addr, ip_addr; ``types``: hw_addr, category.  Devices that join
    networks by design are left out.  Returns rule, severity, hw_addr, subnets (sorted).
    """
    stated = arp.where("ip_addr IS NOT NULL AND ip_addr <> '0.0.0.0'").select("hw_addr", ip.subnet(F.col("ip_addr"), 20).alias("net"))
    by_design = types.where(F.col("category").isin(BRIDGING)).select("hw_addr")
    found = stated.join(by_design, "hw_addr", "left_anti").groupBy("hw_addr").agg(F.array_sort(F.collect_set("net")).alias("subnets"))
    return found.where(F.size("subnets") > 1).select(F.lit("L2-008").alias("rule"), F.lit("medium").alias("severity"), "hw_addr", "subnets")
