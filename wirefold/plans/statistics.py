"""Counts, histograms, rollups and window analytics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import ip
from ..operators import inventory, throttle
from . import oracle
from .base import DAY, HOUR, MINUTE, query

_NOW = "(SELECT max(us) FROM packets)"


@query("a01_category_counts", "SELECT coalesce(category, 'unknown') AS category, count(*) AS n FROM verdicts GROUP BY 1")
def _(t):
    return t.verdicts.groupBy(F.coalesce("category", F.lit("unknown")).alias("category")).agg(F.count("*").alias("n"))


@query("a02_protocols_last_day", f"SELECT protocol, count(*) AS n FROM packets WHERE us > {_NOW} - {DAY} GROUP BY protocol ORDER BY n DESC, protocol LIMIT 15")
def _(t):
    return t.packets.where(F.col("us") > t.now - F.lit(DAY)).groupBy("protocol").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "protocol").limit(15)


@query("a03_rule_severity", "SELECT rule, severity, count(*) AS n FROM findings WHERE NOT resolved GROUP BY ALL")
def _(t):
    return t.findings.where(~F.col("resolved")).groupBy("rule", "severity").agg(F.count("*").alias("n"))


@query("a04_hourly_histogram", f"SELECT h::INT AS hour, count(p.us) AS n FROM range(24) r(h) LEFT JOIN packets p ON (p.us // {HOUR}) % 24 = h AND p.us > {_NOW} - {7 * DAY} GROUP BY h")
def _(t):
    hours = t.spark.range(24).select(F.col("id").cast("int").alias("hour"))
    n = t.packets.where(F.col("us") > t.now - F.lit(7 * DAY)).groupBy(F.floor(F.col("us") / HOUR).cast("long").alias("h")).agg(F.count("*").alias("n"))
    n = n.groupBy((F.col("h") % 24).cast("int").alias("hour")).agg(F.sum("n").alias("n"))
    return hours.join(n, "hour", "left").select("hour", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@query("a05_top_connections", "SELECT ip_addr AS src, coalesce(target_ip, '') AS dst, count(*) AS n FROM packets GROUP BY ALL ORDER BY n DESC, src, dst LIMIT 20")
def _(t):
    g = t.packets.groupBy(F.col("ip_addr").alias("src"), F.coalesce("target_ip", F.lit("")).alias("dst")).agg(F.count("*").alias("n"))
    return g.orderBy(F.col("n").desc(), "src", "dst").limit(20)


@query("a06_filter_lists", """SELECT 'vendor' AS field, vendor AS value FROM verdicts WHERE vendor IS NOT NULL UNION SELECT 'category', category FROM verdicts WHERE category IS NOT NULL
  UNION SELECT 'platform', platform FROM verdicts WHERE platform IS NOT NULL""")
def _(t):
    return t.verdicts.unpivot(["hw_addr"], ["vendor", "category", "platform"], "field", "value").where("value IS NOT NULL").select("field", "value").distinct()


@query("a07_visibility", "SELECT hw_addr, count(DISTINCT protocol) AS n, string_agg(DISTINCT protocol, ',' ORDER BY protocol) AS protocols FROM packets GROUP BY hw_addr")
def _(t):
    return t.packets.groupBy("hw_addr").agg(F.countDistinct("protocol").alias("n"), F.array_join(F.array_sort(F.collect_set("protocol")), ",").alias("protocols"))


@query("a08_rich_hosts", "SELECT hw_addr, count(DISTINCT source) AS n FROM evidence GROUP BY hw_addr HAVING count(DISTINCT source) >= 3")
def _(t):
    return t.evidence.groupBy("hw_addr").agg(F.countDistinct("source").alias("n")).where("n >= 3")


@query("a09_subnet_visibility", """SELECT subnet, count(*) AS hosts, count(*) FILTER (n >= 3) AS rich, count(*) FILTER (n BETWEEN 1 AND 2) AS limited, len(list_distinct(flatten(list(ps)))) AS score,
    CASE WHEN len(list_distinct(flatten(list(ps)))) >= 5 THEN 'excellent' WHEN len(list_distinct(flatten(list(ps)))) >= 3 THEN 'good' WHEN len(list_distinct(flatten(list(ps)))) >= 2 THEN 'partial' ELSE 'limited' END AS level
  FROM (SELECT hw_addr, regexp_replace(ip_addr, '[0-9]+$', '0/24') AS subnet, count(DISTINCT protocol) AS n, list(DISTINCT protocol) AS ps FROM packets GROUP BY ALL) GROUP BY subnet""")
def _(t):
    per = t.packets.groupBy("hw_addr", ip.subnet(F.col("ip_addr")).alias("subnet")).agg(F.collect_set("protocol").alias("ps"))
    out = per.withColumn("n", F.size("ps")).groupBy("subnet").agg(
        F.count("*").alias("hosts"), F.sum((F.col("n") >= 3).cast("long")).alias("rich"), F.sum(F.col("n").between(1, 2).cast("long")).alias("limited"),
        F.size(F.array_distinct(F.flatten(F.collect_set("ps")))).alias("score"),
    )
    level = F.when(F.col("score") >= 5, "excellent").when(F.col("score") >= 3, "good").when(F.col("score") >= 2, "partial").otherwise("limited")
    return out.withColumn("level", level)


@query("a10_evidence_quality", "SELECT hw_addr, CASE WHEN n >= 5 THEN 'excellent' WHEN n >= 3 THEN 'good' WHEN n >= 2 THEN 'limited' ELSE 'minimal' END AS quality FROM (SELECT hw_addr, count(DISTINCT source) AS n FROM evidence GROUP BY hw_addr)")
def _(t):
    n = F.countDistinct("source")
    return t.evidence.groupBy("hw_addr").agg(F.when(n >= 5, "excellent").when(n >= 3, "good").when(n >= 2, "limited").otherwise("minimal").alias("quality"))


@query("a11_incidents", """SELECT hw_addr, rule, count(*) AS n, min(us) AS first_us, max(us) AS last_us, left(arg_min(message, (us, id)), 120) AS message, list(id ORDER BY id) AS ids,
  CASE WHEN rule IN ('mac_spoofing', 'addr_conflict') THEN 'threat' WHEN rule IN ('identity_shift', 'low_certainty') THEN 'suspicious' ELSE 'informational' END AS class FROM findings GROUP BY hw_addr, rule""")
def _(t):
    kind = F.when(F.col("rule").isin("mac_spoofing", "addr_conflict"), "threat").when(F.col("rule").isin("identity_shift", "low_certainty"), "suspicious").otherwise("informational")
    g = t.findings.groupBy("hw_addr", "rule").agg(
        F.count("*").alias("n"), F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.left(F.min_by("message", F.struct("us", "id")), F.lit(120)).alias("message"),
        F.array_sort(F.collect_list("id")).alias("ids"),
    )
    return g.withColumn("class", kind)


@query("a12_rule_groups", """WITH g AS (SELECT rule, count(*) AS n, count(DISTINCT hw_addr) AS devices, list(DISTINCT hw_addr) AS members FROM findings GROUP BY rule),
  b AS (SELECT rule, (us // 86400000000) % 7 AS bin, count(*) AS c FROM findings GROUP BY ALL),
  s AS (SELECT rule, list(coalesce(c, 0) ORDER BY i) AS spark FROM (SELECT g.rule, i FROM g, range(7) r(i)) LEFT JOIN b ON b.rule = rule AND b.bin = i GROUP BY rule)
  SELECT g.rule, g.n, g.devices, (SELECT count(*) FROM g o WHERE o.rule <> g.rule AND list_has_any(o.members, g.members)) AS related FROM g""")
def _(t):
    n = t.findings.groupBy("rule").agg(F.count("*").alias("n"), F.countDistinct("hw_addr").alias("devices"))
    seen = t.findings.select("rule", "hw_addr").distinct()
    other = seen.withColumnRenamed("rule", "other")
    met = seen.join(other, "hw_addr").where("rule <> other").groupBy("rule").agg(F.countDistinct("other").alias("related"))
    return n.join(met, "rule", "left").withColumn("related", F.coalesce("related", F.lit(0)))


@query("a12_rule_sparkline", """SELECT rule, h::INT AS bin, count(us) AS n FROM (SELECT rule, h FROM (SELECT DISTINCT rule FROM findings), range(24) x(h)) g
  LEFT JOIN (SELECT rule AS r, (us // 86400000000) % 24 AS b, us FROM findings) f ON f.r = g.rule AND f.b = g.h GROUP BY ALL""")
def _(t):
    grid = t.findings.select("rule").distinct().select("rule", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("bin"))
    n = t.findings.groupBy("rule", (F.floor(F.col("us") / DAY) % 24).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    return grid.join(n, ["rule", "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


@query("a13_severity_trend", """SELECT severity, now_n, before_n, CASE WHEN before_n = 0 THEN NULL ELSE round((now_n - before_n) * 100.0::DOUBLE / before_n, 1) END AS pct, CASE WHEN now_n > before_n THEN 'up' WHEN now_n < before_n THEN 'down' ELSE 'flat' END AS direction
  FROM (SELECT severity, count(*) FILTER (NOT resolved) AS now_n, count(*) FILTER (NOT resolved AND us < (SELECT max(us) FROM findings) - 86400000000 * 400) AS before_n FROM findings GROUP BY severity)""")
def _(t):
    last = t.findings.select(F.max("us")).scalar()
    open_ = ~F.col("resolved")
    old = open_ & (F.col("us") < last - F.lit(400 * DAY))
    g = t.findings.groupBy("severity").agg(F.sum(open_.cast("long")).alias("now_n"), F.sum(old.cast("long")).alias("before_n"))
    pct = F.when(F.col("before_n") != 0, F.round((F.col("now_n") - F.col("before_n")) * 100.0 / F.col("before_n"), 1))
    return g.withColumn("pct", pct).withColumn("direction", F.when(F.col("now_n") > F.col("before_n"), "up").when(F.col("now_n") < F.col("before_n"), "down").otherwise("flat"))


@query("a14_daily_matrix", """WITH l AS (SELECT max(us // 86400000000) AS d FROM findings)
  SELECT i::INT AS days_ago, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'warning') AS warning, count(*) FILTER (severity = 'low') AS low, count(*) FILTER (severity = 'info') AS info
  FROM range(7) r(i) LEFT JOIN (SELECT severity, (SELECT d FROM l) - us // 86400000000 AS ago FROM findings) f ON f.ago = i GROUP BY i""")
def _(t):
    day = F.floor(F.col("us") / DAY)
    last = t.findings.select(F.max(day)).scalar()
    grid = t.spark.range(7).select(F.col("id").cast("int").alias("days_ago"))
    names = ["critical", "high", "warning", "low", "info"]
    n = t.findings.withColumn("days_ago", (last - day).cast("int")).where("days_ago < 7").groupBy("days_ago").pivot("severity", names).count()
    return grid.join(n, "days_ago", "left").na.fill(0, names)


@query("a15_top_devices", "SELECT hw_addr, n, round(n * 100.0::DOUBLE / max(n) OVER (), 0) AS width FROM (SELECT hw_addr, count(*) AS n FROM findings GROUP BY hw_addr ORDER BY n DESC, hw_addr LIMIT 10)")
def _(t):
    top = t.findings.groupBy("hw_addr").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "hw_addr").limit(10)
    return top.withColumn("width", F.round(F.col("n") * 100.0 / F.max("n").over(Window.partitionBy()), 0))


@query("a16_authorization_counts", """SELECT count(*) FILTER ("authorization" = 'approved') AS approved, count(*) FILTER ("authorization" = 'rejected') AS rejected, count(*) FILTER ("authorization" = 'unapproved') AS unapproved, max(custkey) FILTER ("authorization" = 'approved') AS last FROM devices""")
def _(t):
    is_ = lambda x: F.col("authorization") == x
    return t.devices.agg(*[F.sum(is_(x).cast("long")).alias(x) for x in ("approved", "rejected", "unapproved")], F.max(F.when(is_("approved"), F.col("custkey"))).alias("last"))


@query("a17_latest_interface", "SELECT hw_addr, arg_max(interface, packet_id) AS interface FROM packets GROUP BY hw_addr")
def _(t):
    return t.packets.groupBy("hw_addr").agg(F.max_by("interface", "packet_id").alias("interface"))


@query("a18_source_coverage", "SELECT hw_addr, source, count(*) AS n, max(us) AS last_us FROM evidence GROUP BY ALL")
def _(t):
    return t.evidence.groupBy("hw_addr", "source").agg(F.count("*").alias("n"), F.max("us").alias("last_us"))


@query("a19_arp_merge", "SELECT hw_addr, ip_addr, min(us) AS first_us, max(us) AS last_us FROM packets WHERE protocol = 'arp' GROUP BY ALL")
def _(t):
    return t.packets.where("protocol = 'arp'").groupBy("hw_addr", "ip_addr").agg(F.min("us").alias("first_us"), F.max("us").alias("last_us"))


@query("a20_arp_history", "SELECT hw_addr, ip_addr, interface, min(us) AS first_us, max(us) AS last_us, count(*) AS packets, bool_or(op = 2 AND ip_addr = target_ip) AS gratuitous FROM packets WHERE protocol = 'arp' GROUP BY ALL")
def _(t):
    own = (F.col("op") == 2) & (F.col("ip_addr") == F.col("target_ip"))
    return t.packets.where("protocol = 'arp'").groupBy("hw_addr", "ip_addr", "interface").agg(F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.count("*").alias("packets"), F.bool_or(own).alias("gratuitous"))


@query("a21_multi_subnet", "SELECT hw_addr, count(DISTINCT split_part(ip_addr, '.', 3)) AS nets FROM packets GROUP BY hw_addr HAVING nets > 1")
def _(t):
    return t.packets.groupBy("hw_addr").agg(F.countDistinct(ip.subnet(F.col("ip_addr"))).alias("nets")).where("nets > 1")


@query("a22_vendor_vote", "SELECT hw_addr, arg_max(vendor, (s, vendor)) AS vendor FROM (SELECT hw_addr, vendor, round(sum(certainty), 6) AS s FROM evidence WHERE source <> 'oui' GROUP BY ALL) GROUP BY hw_addr")
def _(t):
    g = t.evidence.where("source <> 'oui'").groupBy("hw_addr", "vendor").agg(F.round(F.sum("certainty"), 6).alias("s"))
    return g.groupBy("hw_addr").agg(F.max_by("vendor", F.struct("s", "vendor")).alias("vendor"))


_OWNER = [("icloud.com", "Apple"), ("apple.com", "Apple"), ("microsoft.com", "Microsoft"), ("google.com", "Google"), ("amazon.com", "Amazon")]


@query("a23_dns_affinity", f"""SELECT hw_addr, sum(n)::BIGINT AS classified, arg_max(vendor, (n, vendor)) AS top_vendor, round(max(n) * 100.0::DOUBLE / sum(n), 1) AS pct FROM (
  SELECT hw_addr, vendor, count(*) AS n FROM packets JOIN {oracle.values(_OWNER, "o(suffix, vendor)")} ON query_name = suffix OR query_name LIKE '%.' || suffix WHERE protocol = 'dns' GROUP BY ALL) GROUP BY hw_addr""")
def _(t):
    from ..operators.lookups import suffix_join

    d = t.packets.where("protocol = 'dns'").select("hw_addr", "packet_id", "query_name")
    n = suffix_join(d, "query_name", t.spark.createDataFrame([(i, s, v) for i, (s, v) in enumerate(_OWNER)], "priority int, suffix string, vendor string"), ["packet_id"]).groupBy("hw_addr", "vendor").agg(F.count("*").alias("n"))
    return n.groupBy("hw_addr").agg(F.sum("n").alias("classified"), F.max_by("vendor", F.struct("n", "vendor")).alias("top_vendor"), F.round(F.max("n") * 100.0 / F.sum("n"), 1).alias("pct"))


@query("a24_row_counts", "SELECT (SELECT count(*) FROM hosts) AS hosts, (SELECT count(*) FROM findings WHERE NOT resolved) AS open_findings")
def _(t):
    hosts = t.hosts.agg(F.count("*")).scalar()
    return t.findings.where(~F.col("resolved")).agg(F.count("*").alias("open_findings")).select(hosts.alias("hosts"), "open_findings")


@query("a26_validation_counts", "SELECT source, count(*) FILTER (certainty >= 0.5) AS passed, count(*) FILTER (certainty < 0.5) AS failed, list(DISTINCT vendor ORDER BY vendor) FILTER (certainty < 0.5) AS vendors FROM evidence GROUP BY source")
def _(t):
    ok = F.col("certainty") >= 0.5
    return t.evidence.groupBy("source").agg(F.sum(ok.cast("long")).alias("passed"), F.sum((~ok).cast("long")).alias("failed"), F.array_sort(F.collect_set(F.when(~ok, F.col("vendor")))).alias("vendors"))


@query("a27_weighted_mean", "SELECT hw_addr, round(sum(certainty * weight) / sum(weight), 6) AS confidence FROM ev_weighted GROUP BY hw_addr")
def _(t):
    from ..operators import fusion

    rows = fusion.weighted(fusion.capped(t.evidence), fusion.weight_table(t.spark))
    return rows.groupBy("hw_addr").agg(F.round(F.sum(F.col("certainty") * F.col("weight")) / F.sum("weight"), 6).alias("confidence"))


@query("a28_presence_counts", f"SELECT count(*) FILTER (last_us >= {_NOW} - {5 * HOUR}) AS online, count(*) FILTER (last_us < {_NOW} - {5 * HOUR}) AS offline FROM hosts")
def _(t):
    on = F.col("last_us") >= t.now - F.lit(5 * HOUR)
    return t.hosts.agg(F.sum(on.cast("long")).alias("online"), F.sum((~on).cast("long")).alias("offline"))


@query("k10_gauges", f"SELECT (SELECT count(*) FROM devices) AS devices, (SELECT count(*) FROM hosts WHERE last_us >= {_NOW} - {5 * HOUR}) AS online, (SELECT count(*) FROM findings WHERE NOT resolved) AS alerts")
def _(t):
    online = t.hosts.where(F.col("last_us") >= t.now - F.lit(5 * HOUR)).agg(F.count("*")).scalar()
    alerts = t.findings.where(~F.col("resolved")).agg(F.count("*")).scalar()
    return t.devices.agg(F.count("*").alias("devices")).select("devices", online.alias("online"), alerts.alias("alerts"))


@query("w01_keep_latest", "SELECT packet_id, hw_addr FROM (SELECT *, row_number() OVER (PARTITION BY hw_addr ORDER BY us DESC, packet_id DESC) AS n FROM packets) WHERE n <= 50")
def _(t):
    return inventory.latest(t.packets, ["hw_addr"], [F.col("us").desc(), F.col("packet_id").desc()], 50).select("packet_id", "hw_addr")


@query("w02_cap_per_source", "SELECT id, hw_addr, source FROM (SELECT *, row_number() OVER (PARTITION BY hw_addr, source ORDER BY us DESC, id DESC) AS n FROM evidence) WHERE n <= 5")
def _(t):
    return inventory.latest(t.evidence, ["hw_addr", "source"], [F.col("us").desc(), F.col("id").desc()], 5).select("id", "hw_addr", "source")


@query("w03_latest_snapshot", "SELECT hw_addr, arg_max(vendor, (us, id)) AS vendor, arg_max(coalesce(platform, '-'), (us, id)) AS platform FROM evidence GROUP BY hw_addr")
def _(t):
    at = F.struct("us", "id")
    return t.evidence.groupBy("hw_addr").agg(F.max_by("vendor", at).alias("vendor"), F.max_by(F.coalesce("platform", F.lit("-")), at).alias("platform"))


@query("w04_sliding_count", f"SELECT packet_id, hw_addr, count(*) OVER (PARTITION BY hw_addr ORDER BY us RANGE BETWEEN {6 * HOUR - 1} PRECEDING AND CURRENT ROW) AS n FROM packets WHERE protocol = 'arp'")
def _(t):
    return throttle.sliding_count(t.packets.where("protocol = 'arp'"), ["hw_addr"], "us", 6 * HOUR).select("packet_id", "hw_addr", "n")


@query("w05_sliding_changes", f"""SELECT packet_id, ip_addr, (sum(flag) OVER w - arg_min(flag, (us, packet_id)) OVER w)::BIGINT AS changes FROM (
    SELECT *, CASE WHEN lag(hw_addr) OVER (PARTITION BY ip_addr ORDER BY us, packet_id) <> hw_addr THEN 1 ELSE 0 END AS flag FROM packets WHERE protocol = 'arp')
  WINDOW w AS (PARTITION BY ip_addr ORDER BY us RANGE BETWEEN {12 * HOUR - 1} PRECEDING AND CURRENT ROW)""")
def _(t):
    return throttle.sliding_changes(t.packets.where("protocol = 'arp'"), ["ip_addr"], "us", "packet_id", "hw_addr", 12 * HOUR).select("packet_id", "ip_addr", "changes")


@query("w06_previous_value_drift", "SELECT id, hw_addr, before, vendor FROM (SELECT *, lag(vendor) OVER (PARTITION BY hw_addr ORDER BY us, id) AS before FROM evidence WHERE source = 'oui') WHERE before <> vendor")
def _(t):
    w = Window.partitionBy("hw_addr").orderBy("us", "id")
    return t.evidence.where("source = 'oui'").withColumn("before", F.lag("vendor").over(w)).where("before <> vendor").select("id", "hw_addr", "before", "vendor")


@query("w07_seen_before", f"""WITH d AS (SELECT * FROM (SELECT *, lag(vendor) OVER (PARTITION BY hw_addr ORDER BY us, id) AS before FROM evidence WHERE source = 'oui') WHERE before <> vendor)
  SELECT a.id, EXISTS (SELECT 1 FROM d b WHERE b.hw_addr = a.hw_addr AND b.us < a.us AND b.us >= a.us - {900 * DAY} AND b.vendor = a.vendor) AS seen FROM d a""")
def _(t):
    order = Window.partitionBy("hw_addr").orderBy("us", "id")
    d = t.evidence.where("source = 'oui'").withColumn("before", F.lag("vendor").over(order)).where("before <> vendor")
    w = Window.partitionBy("hw_addr").orderBy("us").rangeBetween(-900 * DAY, -1)
    return d.select("id", F.coalesce(F.array_contains(F.collect_set("vendor").over(w), F.col("vendor")), F.lit(False)).alias("seen"))


@query("w08_throttle", f"""WITH RECURSIVE e AS (SELECT hw_addr, us FROM packets WHERE protocol = 'arp'),
  f AS (SELECT hw_addr, min(us) AS us FROM e GROUP BY hw_addr UNION ALL SELECT f.hw_addr, (SELECT min(e.us) FROM e WHERE e.hw_addr = f.hw_addr AND e.us >= f.us + {12 * HOUR}) FROM f WHERE f.us IS NOT NULL)
  SELECT hw_addr, us FROM f WHERE us IS NOT NULL""")
def _(t):
    return throttle.throttled(t.packets.where("protocol = 'arp'"), ["hw_addr"], "us", 12 * HOUR)


@query("w09_core_switch", "SELECT interface, arg_max(hw_addr, (n, hw_addr)) AS hw_addr, max(n) AS n FROM (SELECT interface, hw_addr, count(*) AS n FROM packets WHERE protocol = 'arp' GROUP BY ALL) GROUP BY interface")
def _(t):
    n = t.packets.where("protocol = 'arp'").groupBy("interface", "hw_addr").agg(F.count("*").alias("n"))
    return n.groupBy("interface").agg(F.max_by("hw_addr", F.struct("n", "hw_addr")).alias("hw_addr"), F.max("n").alias("n"))


@query("w10_share_of_total", "SELECT protocol, n, round(n * 100.0::DOUBLE / sum(n) OVER (), 2) AS share, round(n * 100.0::DOUBLE / max(n) OVER (), 2) AS of_max FROM (SELECT protocol, count(*) AS n FROM packets GROUP BY protocol)")
def _(t):
    w = Window.partitionBy()  # over the few protocols
    g = t.packets.groupBy("protocol").agg(F.count("*").alias("n"))
    return g.select("protocol", "n", F.round(F.col("n") * 100.0 / F.sum("n").over(w), 2).alias("share"), F.round(F.col("n") * 100.0 / F.max("n").over(w), 2).alias("of_max"))


@query("w11_modulo_assignment", "SELECT hw_addr, (('0x' || substr(md5(hw_addr), 1, 8))::BIGINT % 3)::INT AS slot FROM hosts")
def _(t):
    return t.hosts.select("hw_addr", (F.conv(F.substring(F.md5("hw_addr"), 1, 8), 16, 10).cast("long") % 3).cast("int").alias("slot"))


@query("t12_hysteresis", f"""WITH RECURSIVE e AS (SELECT hw_addr, us FROM packets), f AS (SELECT hw_addr, min(us) AS us FROM e GROUP BY hw_addr
  UNION ALL SELECT f.hw_addr, (SELECT min(e.us) FROM e WHERE e.hw_addr = f.hw_addr AND e.us >= f.us + {30 * MINUTE}) FROM f WHERE f.us IS NOT NULL)
  SELECT hw_addr, max(us) AS last_active FROM f GROUP BY hw_addr""")
def _(t):
    return throttle.throttled(t.packets, ["hw_addr"], "us", 30 * MINUTE).groupBy("hw_addr").agg(F.max("us").alias("last_active"))
