"""Detection rules, presence and drift as batch queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import mac, names
from ..operators import detect, identity, inventory, throttle
from ..sources import adapters as A
from . import oracle
from .base import DAY, HOUR, query

# Windows are widened: the tables' events are minutes apart.
_SCALE = 144
_BIND = [("10.0.1.2", "00:1a:2b:00:00:01"), ("10.0.2.3", "d2:1a:2b:00:00:05")]
_SUPPRESSED = [("00:1a:2b:00:00:02", None, None), (None, "10.0.3.4", "addr_conflict")]
_ARP = "SELECT * FROM packets WHERE protocol = 'arp'"
_INFRA_SQL = "SELECT hw_addr FROM hosts WHERE hw_addr LIKE '%3'"
_NOW = "(SELECT max(us) FROM packets)"


def arp(t):
    return t.packets.where("protocol = 'arp'")


def infra(t):
    return t.hosts.where(F.col("hw_addr").endswith("3")).select("hw_addr")


def bindings(t):
    return t.spark.createDataFrame(_BIND, "ip_addr string, mac string")


def suppressed(t):
    return t.spark.createDataFrame(_SUPPRESSED, "mac string, ip string, subtype string")


_PIN = oracle.values(_BIND, "b(ip, mac)")
VIEWS = {
    "r_arp": _ARP,
    "r_pin": f"SELECT a.*, 'gateway_impersonation' AS rule, a.ip_addr || '|' || hw_addr AS key FROM r_arp a JOIN {_PIN} ON ip = ip_addr WHERE hw_addr <> mac",
    "r_conflict": f"""SELECT * EXCLUDE (prior, prior_us), 'addr_conflict' AS rule, ip_addr AS key FROM (SELECT *, lag(hw_addr) OVER w AS prior, lag(us) OVER w AS prior_us FROM r_arp WINDOW w AS (PARTITION BY ip_addr ORDER BY us, packet_id))
      WHERE prior <> hw_addr AND us - prior_us <= {120_000_000 * _SCALE} AND NOT (hw_addr LIKE 'd2%' AND prior LIKE 'd2%') AND ip_addr NOT IN (SELECT ip FROM {_PIN})""",
    "r_flood": f"""SELECT * EXCLUDE (n), 'grat_flood' AS rule, hw_addr AS key FROM (SELECT *, count(*) OVER (PARTITION BY hw_addr ORDER BY us RANGE BETWEEN {60_000_000 * _SCALE - 1} PRECEDING AND CURRENT ROW) AS n FROM r_arp WHERE op = 2 AND ip_addr = target_ip)
      WHERE n > CASE WHEN hw_addr IN ({_INFRA_SQL}) THEN 2 ELSE 1 END""",
    "r_flip": f"""SELECT * EXCLUDE (flag, changes, stable), 'flip_flop' AS rule, ip_addr AS key FROM (SELECT *, sum(flag) OVER w - arg_min(flag, (us, packet_id)) OVER w AS changes, max(CASE WHEN hw_addr LIKE 'd2%' THEN 0 ELSE 1 END) OVER w AS stable FROM (
        SELECT *, CASE WHEN lag(hw_addr) OVER (PARTITION BY ip_addr ORDER BY us, packet_id) <> hw_addr THEN 1 ELSE 0 END AS flag FROM r_arp)
      WINDOW w AS (PARTITION BY ip_addr ORDER BY us RANGE BETWEEN {300_000_000 * _SCALE - 1} PRECEDING AND CURRENT ROW)) WHERE changes >= 3 AND stable = 1 AND hw_addr NOT IN ({_INFRA_SQL})""",
}


def _found(t):
    return t.spark, arp(t)


def _limits(t, found):
    return found.select("packet_id", "hw_addr", "ip_addr")


@query("j20_binding_violation", "SELECT packet_id, hw_addr, ip_addr FROM r_pin", VIEWS)
def _(t):
    return _limits(t, detect.binding_violations(arp(t), bindings(t)))


@query("j19_temporal_conflict", "SELECT packet_id, hw_addr, ip_addr FROM r_conflict", VIEWS)
def _(t):
    return _limits(t, detect.address_conflicts(arp(t), bindings(t), detect.CONFLICT_WINDOW * _SCALE))


@query("r08_gratuitous_burst", "SELECT packet_id, hw_addr, ip_addr FROM r_flood", VIEWS)
def _(t):
    return _limits(t, detect.gratuitous_bursts(arp(t), infra(t), detect.BURST_WINDOW * _SCALE, 1, 2))


@query("r08_flip_flop", "SELECT packet_id, hw_addr, ip_addr FROM r_flip", VIEWS)
def _(t):
    return _limits(t, detect.flip_flops(arp(t), infra(t), detect.CHANGE_WINDOW * _SCALE))


_RL = 300_000_000 * _SCALE


@query("r08_arp_rules", f"""WITH RECURSIVE every AS (SELECT packet_id, hw_addr, ip_addr, us, rule, key FROM r_pin UNION ALL SELECT packet_id, hw_addr, ip_addr, us, rule, key FROM r_conflict UNION ALL SELECT packet_id, hw_addr, ip_addr, us, rule, key FROM r_flip),
  f AS (SELECT rule, key, min(us) AS us FROM every GROUP BY rule, key UNION ALL SELECT f.rule, f.key, (SELECT min(e.us) FROM every e WHERE e.rule = f.rule AND e.key = f.key AND e.us >= f.us + {_RL}) FROM f WHERE f.us IS NOT NULL)
  SELECT min(e.packet_id) AS packet_id, e.rule, e.us FROM every e JOIN f ON f.rule = e.rule AND f.key = e.key AND f.us = e.us
  WHERE NOT EXISTS (SELECT 1 FROM {oracle.values(_SUPPRESSED, "s(mac, ip, subtype)")} WHERE (mac IS NULL OR mac = e.hw_addr) AND (ip IS NULL OR ip = e.ip_addr) AND (subtype IS NULL OR subtype = e.rule)) GROUP BY e.rule, e.key, e.us""", VIEWS)
def _(t):
    # No burst reaches the rule's own limit in these tables.
    return detect.arp_findings(arp(t), bindings(t), infra(t), suppressed(t), _SCALE).select("packet_id", "rule", "us")


@query("r01_new_host", """SELECT h.hw_addr, CASE WHEN d."authorization" = 'approved' THEN 'info' WHEN d."authorization" = 'rejected' THEN 'critical' WHEN (SELECT count(*) FROM devices WHERE "authorization" <> 'unapproved') = 0 THEN 'info' ELSE 'warning' END AS severity
  FROM hosts h LEFT JOIN devices d ON d.mac = h.hw_addr WHERE h.disposition = 'new'""")
def _(t):
    judged = t.devices.where("authorization <> 'unapproved'").agg(F.count("*")).scalar()
    d = t.devices.select(F.col("mac").alias("hw_addr"), "authorization")
    met = t.hosts.where("disposition = 'new'").join(d, "hw_addr", "left").withColumn("_judged", judged)
    severity = F.when(F.col("authorization") == "approved", "info").when(F.col("authorization") == "rejected", "critical").when(F.col("_judged") == 0, "info").otherwise("warning")
    return met.select("hw_addr", severity.alias("severity"))


@query("r02_low_certainty", "SELECT hw_addr, certainty FROM verdicts WHERE certainty < 80 AND hw_addr NOT IN (SELECT hw_addr FROM findings WHERE rule = 'low_certainty' AND NOT resolved)")
def _(t):
    open_ = t.findings.where("rule = 'low_certainty' AND NOT resolved").select("hw_addr")
    return t.verdicts.where("certainty < 80").join(open_, "hw_addr", "left_anti").select("hw_addr", "certainty")


_HIST = "SELECT id, hw_addr, us, category, vendor, platform, (round(certainty * 100, 0))::INT AS certainty, count(*) OVER (PARTITION BY hw_addr ORDER BY us, id) AS evidence FROM evidence"


@query("r03_identity_shift", f"""SELECT id, hw_addr, severity FROM (SELECT *, CASE WHEN category <> pc OR vendor <> pv THEN 'critical' WHEN platform <> pp THEN 'high' END AS severity FROM (
  SELECT *, lag(category) OVER w AS pc, lag(vendor) OVER w AS pv, lag(platform) OVER w AS pp, lag(certainty) OVER w AS py FROM ({_HIST}) WINDOW w AS (PARTITION BY hw_addr ORDER BY us, id))
  WHERE certainty >= 50 AND py >= 50 AND evidence >= 3) WHERE severity IS NOT NULL""")
def _(t):
    w = Window.partitionBy("hw_addr").orderBy("us", "id")
    history = t.evidence.withColumn("certainty", F.round(F.col("certainty") * 100, 0).cast("int")).withColumn("evidence", F.count("*").over(w))
    return detect.identity_shifts(history).select("id", "hw_addr", "severity")


@query("r04_open_conflicts", f"""SELECT hw_addr, ip_addr FROM hosts h WHERE last_us > {_NOW} - {DAY} AND EXISTS (SELECT 1 FROM hosts o WHERE o.ip_addr = h.ip_addr AND o.hw_addr <> h.hw_addr AND o.last_us > {_NOW} - {DAY})
  AND hw_addr NOT IN (SELECT hw_addr FROM findings WHERE rule = 'addr_conflict' AND NOT resolved)""")
def _(t):
    fresh = t.hosts.where(F.col("last_us") > t.now - F.lit(DAY)).select("hw_addr", "ip_addr")
    busy = fresh.groupBy("ip_addr").agg(F.count("*").alias("n")).where("n > 1")
    open_ = t.findings.where("rule = 'addr_conflict' AND NOT resolved").select("hw_addr")
    return fresh.join(busy, "ip_addr", "left_semi").join(open_, "hw_addr", "left_anti").select("hw_addr", "ip_addr")


@query("r05_randomized", "SELECT hw_addr FROM hosts WHERE randomized = 1 AND hw_addr NOT IN (SELECT hw_addr FROM findings WHERE rule = 'new_host' AND NOT resolved)")
def _(t):
    open_ = t.findings.where("rule = 'new_host' AND NOT resolved").select("hw_addr")
    return t.hosts.where("randomized = 1").join(open_, "hw_addr", "left_anti").select("hw_addr")


@query("r06_randomized_collision", f"""SELECT hw_addr, hostname, CASE WHEN newest > {_NOW} - {12 * HOUR} THEN 'addr_conflict' ELSE 'rotation' END AS rule FROM (
  SELECT a.hw_addr, a.hostname, max(b.us) AS newest FROM (SELECT hw_addr, hostname FROM packets WHERE hw_addr LIKE 'd2%' AND hostname IS NOT NULL GROUP BY ALL) a JOIN packets b ON a.hostname = b.hostname AND a.hw_addr <> b.hw_addr GROUP BY ALL)""")
def _(t):
    seen = t.packets.where("hostname IS NOT NULL").groupBy("hostname", "hw_addr").agg(F.max("us").alias("us"))
    # The newest of the others: the newest, or the second newest if that is one's own.
    top = seen.groupBy("hostname").agg(F.slice(F.sort_array(F.collect_list(F.struct("us", "hw_addr")), asc=False), 1, 2).alias("top"), F.count("*").alias("n"))
    met = seen.where(mac.local_bit(F.col("hw_addr"))).select("hostname", "hw_addr").join(top.where("n > 1"), "hostname")
    newest = F.when(F.col("top")[0]["hw_addr"] != F.col("hw_addr"), F.col("top")[0]["us"]).otherwise(F.col("top")[1]["us"])
    return met.select("hw_addr", "hostname", F.when(newest > t.now - F.lit(12 * HOUR), "addr_conflict").otherwise("rotation").alias("rule"))


_OWN = [("icloud.com", "Apple"), ("time.apple.com", "Apple"), ("update.microsoft.com", "Microsoft"), ("clients.google.com", "Google"), ("api.amazon.com", "Amazon")]
_DRIFT = f"""WITH d AS (SELECT hw_addr, us, vendor, us - min(us) OVER (PARTITION BY hw_addr) <= {12 * DAY} AS early FROM packets JOIN {oracle.values(_OWN, "o(name, vendor)")} ON name = query_name WHERE protocol = 'dns'),
  n AS (SELECT hw_addr, vendor, count(*) AS n, count(*) FILTER (early) AS early FROM d GROUP BY ALL),
  p AS (SELECT hw_addr, sum(n) AS total, sum(early) AS learned, arg_max(vendor, (early, vendor)) AS baseline, arg_max(vendor, (n, vendor)) AS current, max(n) AS top_n, arg_max(n, (early, vendor)) AS base_n FROM n GROUP BY hw_addr)
  SELECT hw_addr, baseline AS from_vendor, round(base_n * 100.0::DOUBLE / total, 1) AS from_pct, current AS to_vendor, round(top_n * 100.0::DOUBLE / total, 1) AS to_pct
  FROM p WHERE learned >= 3 AND current <> baseline AND 1 - base_n / total >= 0.5 AND top_n / total >= 0.4"""


@query("r07_t03_dns_drift", _DRIFT)
def _(t):
    own = F.broadcast(t.spark.createDataFrame(_OWN, "query_name string, vendor string"))
    d = t.packets.where("protocol = 'dns'").join(own, "query_name").select("hw_addr", "us", "vendor")
    return detect.affinity_drift(d, 12 * DAY, least=3)


@query("r09_fingerprint_drift", """SELECT id, hw_addr, CASE WHEN certainty >= 0.6 AND NOT (contains(lower(vendor), lower(before)) OR contains(lower(before), lower(vendor))) THEN 'oui_mismatch' ELSE 'fingerprint_drift' END AS rule FROM (
  SELECT *, lag(vendor) OVER (PARTITION BY hw_addr ORDER BY us, id) AS before FROM evidence WHERE source = 'dhcpv4') WHERE before <> vendor""")
def _(t):
    w = Window.partitionBy("hw_addr").orderBy("us", "id")
    d = t.evidence.where("source = 'dhcpv4'").withColumn("before", F.lag("vendor").over(w)).where("before <> vendor")
    far = (F.col("certainty") >= 0.6) & ~names.same_vendor(F.col("vendor"), F.col("before"))
    return d.select("id", "hw_addr", F.when(far, "oui_mismatch").otherwise("fingerprint_drift").alias("rule"))


@query("r10_f34_dhcp_options", """SELECT packet_id, opt, code FROM (SELECT packet_id, opt55, unnest(string_split(opt55, ',')) AS opt FROM packets WHERE protocol = 'dhcpv4') x
  JOIN (SELECT 'relay_from_client' AS code, 43 AS a, 44 AS b) c ON opt::INT BETWEEN a AND b""")
def _(t):
    d = t.packets.where("protocol = 'dhcpv4'").select("packet_id", F.explode(F.split("opt55", ",")).alias("opt"))
    return d.where(F.col("opt").cast("int").between(43, 44)).select("packet_id", "opt", F.lit("relay_from_client").alias("code"))


@query("r12_infra_offline", f"SELECT hw_addr, CASE WHEN hw_addr LIKE '%a' THEN 'critical' ELSE 'high' END AS severity FROM hosts JOIN verdicts v USING (hw_addr) WHERE category IN ('router', 'server') AND last_us < {_NOW} - {5 * HOUR}")
def _(t):
    v = t.verdicts.where(F.col("category").isin("router", "server")).select("hw_addr")
    old = t.hosts.where(F.col("last_us") < t.now - F.lit(5 * HOUR))
    return old.join(v, "hw_addr").select("hw_addr", F.when(F.col("hw_addr").endswith("a"), "critical").otherwise("high").alias("severity"))


_BY_TYPE = "CASE lower(device_type) " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in detect.PRESENCE.items()) + " ELSE 300 END"
_THRESH = f"CASE WHEN coalesce(threshold, 300) <> 300 THEN threshold ELSE greatest({_BY_TYPE}, CASE WHEN randomized = 1 THEN 1800 ELSE 0 END) END"


@query("t05_t06_r13_presence", f"""SELECT hw_addr, CASE WHEN online THEN 'online' ELSE 'offline' END AS before, CASE WHEN alive THEN 'online' ELSE 'offline' END AS after, last_us, seconds,
    CASE WHEN alive THEN 'info' WHEN criticality = 'critical' THEN 'critical' WHEN criticality = 'high' THEN 'high' WHEN criticality = 'medium' THEN 'warning' ELSE 'low' END AS severity
  FROM (SELECT *, {_NOW} - last_us <= seconds::BIGINT * 1000000 * 24 AS alive FROM (SELECT h.hw_addr, h.last_us, coalesce(d.is_online, true) AS online, d.criticality, ({_THRESH})::INT AS seconds
    FROM hosts h LEFT JOIN (SELECT *, 1 AS one FROM devices) d ON d.mac = h.hw_addr)) WHERE alive <> online""")
def _(t):
    return detect.presence_sweep(t.hosts, t.devices, t.now, 24)


@query("r15_legacy_alerts", "SELECT hw_addr, 'mac_randomized' AS alert FROM hosts WHERE randomized = 1 UNION ALL SELECT hw_addr, 'unclassified' FROM verdicts WHERE category IS NULL UNION ALL SELECT hw_addr, 'new_device' FROM hosts WHERE disposition = 'new'")
def _(t):
    a = t.hosts.where("randomized = 1").select("hw_addr", F.lit("mac_randomized").alias("alert"))
    b = t.verdicts.where("category IS NULL").select("hw_addr", F.lit("unclassified").alias("alert"))
    return a.unionByName(b).unionByName(t.hosts.where("disposition = 'new'").select("hw_addr", F.lit("new_device").alias("alert")))


@query("r16_learned_binding", f"""SELECT ip_addr, coalesce(any_value(m.mac), arg_max(hw_addr, (n, hw_addr))) AS mac FROM (SELECT ip_addr, hw_addr, count(*) AS n FROM packets WHERE protocol = 'arp' GROUP BY ALL) LEFT JOIN {oracle.values(_BIND, "m(ip, mac)")} ON ip = ip_addr GROUP BY ip_addr""")
def _(t):
    n = arp(t).groupBy("ip_addr", "hw_addr").agg(F.count("*").alias("n")).groupBy("ip_addr").agg(F.max_by("hw_addr", F.struct("n", "hw_addr")).alias("learned"))
    return n.join(F.broadcast(bindings(t)), "ip_addr", "left").select("ip_addr", F.coalesce("mac", "learned").alias("mac"))


@query("k09_notifications", f"""WITH RECURSIVE e AS (SELECT rule, hw_addr, us FROM findings WHERE severity IN ('warning', 'high', 'critical')), f AS (SELECT rule, hw_addr, min(us) AS us FROM e GROUP BY ALL
  UNION ALL SELECT f.rule, f.hw_addr, (SELECT min(e.us) FROM e WHERE e.rule = f.rule AND e.hw_addr = f.hw_addr AND e.us >= f.us + {300 * DAY}) FROM f WHERE f.us IS NOT NULL) SELECT rule, hw_addr, us FROM f WHERE us IS NOT NULL""")
def _(t):
    loud = t.findings.where(F.col("severity").isin("warning", "high", "critical"))
    return throttle.throttled(loud, ["rule", "hw_addr"], "us", 300 * DAY).select("rule", "hw_addr", "us")


@query("d10_alert_dedup", "SELECT hw_addr, rule, min(id) AS id FROM findings WHERE NOT resolved AND (hw_addr, rule) NOT IN (SELECT hw_addr, rule FROM findings WHERE status = 'acknowledged') GROUP BY ALL")
def _(t):
    done = t.findings.where("status = 'acknowledged'").select("hw_addr", "rule")
    return t.findings.where("NOT resolved").join(done, ["hw_addr", "rule"], "left_anti").groupBy("hw_addr", "rule").agg(F.min("id").alias("id"))


@query("d01_host_upsert", "SELECT hw_addr, ip_addr, discovered_us, last_us, randomized, disposition FROM hosts")
def _(t):
    return t.hosts.select("hw_addr", "ip_addr", "discovered_us", "last_us", "randomized", "disposition")


@query("d02_verdict_upsert", "SELECT hw_addr, arg_max(vendor, (us, id)) AS vendor, arg_max(hostname, (us, id)) FILTER (hostname IS NOT NULL) AS hostname FROM evidence GROUP BY hw_addr")
def _(t):
    at = F.struct("us", "id")
    return t.evidence.groupBy("hw_addr").agg(F.max_by("vendor", at).alias("vendor"), F.max_by("hostname", F.when(F.col("hostname").isNotNull(), at)).alias("hostname"))


@query("d03_device_upsert", "SELECT hw_addr, max(certainty) AS confidence, min(us) AS first_us, max(us) AS last_us, coalesce(nullif(min(l), 300), 600) AS threshold FROM (SELECT *, CASE WHEN id % 2 = 0 THEN 300 ELSE 900 END AS l FROM evidence) GROUP BY hw_addr")
def _(t):
    own = F.when(F.col("id") % 2 == 0, 300).otherwise(900)
    return t.evidence.groupBy("hw_addr").agg(F.max("certainty").alias("confidence"), F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.coalesce(F.nullif(F.min(own), F.lit(300)), F.lit(600)).alias("threshold"))


@query("d04_identity_backfill", "SELECT hw_addr, dense_rank() OVER (ORDER BY coalesce(hostname, hw_addr)) AS identity FROM verdicts")
def _(t):
    v = t.verdicts.select("hw_addr", F.coalesce("hostname", "hw_addr").alias("_key"))
    return v.join(identity.numbered(v, "_key"), "_key").select("hw_addr", F.col("number").alias("identity"))


_SCORE = " + ".join(f"CASE WHEN a.{k} = b.{k} THEN {w} ELSE 0 END" for k, w in identity.SIGNALS.items())


@query("d04_identity_passes", f"""WITH s AS (SELECT hw_addr, {", ".join(identity.SIGNALS)} FROM (SELECT p.*, row_number() OVER (PARTITION BY hw_addr ORDER BY us DESC, packet_id DESC) AS n FROM packets p)
    JOIN (SELECT hw_addr FROM verdicts) USING (hw_addr) WHERE n = 1),
  r AS (SELECT hw_addr, dense_rank() OVER (ORDER BY coalesce(hostname, hw_addr)) AS identity FROM verdicts WHERE hw_addr NOT LIKE 'd2%'),
  x AS (SELECT a.hw_addr, b.hw_addr AS other, round({_SCORE}, 6)::DOUBLE AS score FROM s a JOIN s b ON a.hw_addr <> b.hw_addr WHERE a.hw_addr LIKE 'd2%' AND b.hw_addr NOT LIKE 'd2%'),
  m AS (SELECT hw_addr, arg_max(other, (score, other)) AS other, max(score) AS score FROM x GROUP BY hw_addr HAVING max(score) >= 0.4)
  SELECT hw_addr, identity, NULL::DOUBLE AS score FROM r
  UNION ALL SELECT m.hw_addr, r.identity, m.score FROM m JOIN r ON r.hw_addr = m.other
  UNION ALL SELECT hw_addr, (SELECT coalesce(max(identity), 0) FROM r) + dense_rank() OVER (ORDER BY coalesce(hostname, hw_addr)), NULL::DOUBLE
    FROM verdicts WHERE hw_addr LIKE 'd2%' AND hw_addr NOT IN (SELECT hw_addr FROM m)""")
def _(t):
    signals = inventory.latest(t.packets, ["hw_addr"], [F.col("us").desc(), F.col("packet_id").desc()]).select("hw_addr", *identity.SIGNALS)
    return identity.identities(t.verdicts, signals, F.col("hw_addr").startswith("d2"))


@query("d05_authorization_state", """SELECT hw_addr, arg_max(status, (us, id)) AS state, count(*) FILTER (status <> before OR before IS NULL) AS transitions FROM (SELECT *, lag(status) OVER (PARTITION BY hw_addr ORDER BY us, id) AS before FROM findings) GROUP BY hw_addr""")
def _(t):
    w = Window.partitionBy("hw_addr").orderBy("us", "id")
    moved = (F.col("before").isNull() | (F.col("status") != F.col("before"))).cast("long")
    return t.findings.withColumn("before", F.lag("status").over(w)).groupBy("hw_addr").agg(F.max_by("status", F.struct("us", "id")).alias("state"), F.sum(moved).alias("transitions"))


@query("d06_bulk_baseline", """SELECT mac, CASE WHEN custkey < 100 AND "authorization" = 'unapproved' THEN 'approved' ELSE "authorization" END AS "authorization" FROM devices""")
def _(t):
    new = F.when((F.col("custkey") < 100) & (F.col("authorization") == "unapproved"), "approved").otherwise(F.col("authorization"))
    return t.devices.select("mac", new.alias("authorization"))


@query("d07_unsnooze", f"SELECT id, CASE WHEN status = 'snoozed' AND snoozed_until <= {_NOW} THEN 'open' ELSE status END AS status FROM findings")
def _(t):
    done = (F.col("status") == "snoozed") & (F.col("snoozed_until") <= t.now)
    return t.findings.select("id", F.when(done, "open").otherwise(F.col("status")).alias("status"))


@query("d08_retention", f"SELECT id FROM findings WHERE NOT (resolved AND us < (SELECT max(us) FROM findings) - {30 * DAY})")
def _(t):
    last = t.findings.select(F.max("us")).scalar()
    return t.findings.where(~(F.col("resolved") & (F.col("us") < last - F.lit(30 * DAY)))).select("id")
