"""Configuration merges, buffers, heartbeats and plug-ins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import lifecycle, plugins
from . import oracle
from .base import DAY, HOUR, query

_CHANGES = [("00:1a:2b:00:00:01", "x", 1, False), ("00:1a:2b:00:00:01", "y", 2, False), ("00:1a:2b:00:00:02", "z", 1, True), ("new", "n", 1, False)]
_NOW = "(SELECT max(us) FROM packets)"


@query("d09_config_upsert", f"""WITH c AS (SELECT * FROM {oracle.values([(a, b, c, str(d).lower()) for a, b, c, d in _CHANGES], "c(mac, owner, seq, deleted)")}), l AS (SELECT mac, arg_max(owner, seq) AS owner, arg_max(deleted, seq) AS deleted FROM c GROUP BY mac)
  SELECT mac, owner FROM devices WHERE mac NOT IN (SELECT mac FROM l) UNION ALL SELECT mac, owner FROM l WHERE deleted = 'false'""")
def _(t):
    changes = t.spark.createDataFrame(_CHANGES, "mac string, owner string, seq int, deleted boolean")
    return lifecycle.upserted(t.devices.select("mac", "owner"), changes, "mac", "seq")


@query("k07_k08_ring_buffer", "SELECT packet_id, interface FROM (SELECT *, row_number() OVER (PARTITION BY interface ORDER BY us DESC, packet_id DESC) AS n FROM packets) WHERE n <= 200")
def _(t):
    return lifecycle.ring(t.packets, ["interface"], "us", "packet_id", 200).select("packet_id", "interface")


@query("t08_sensor_heartbeat", f"SELECT hw_addr, max(us) AS last FROM packets GROUP BY hw_addr HAVING {_NOW} - max(us) > {6 * HOUR}")
def _(t):
    return lifecycle.stale(t.packets, "hw_addr", "us", t.now, 6 * HOUR)


@query("r11_stale_source", f"SELECT source, max(us) AS last FROM evidence GROUP BY source HAVING (SELECT max(us) FROM evidence) + {DAY} - max(us) > {4 * HOUR}")
def _(t):
    now = t.evidence.select(F.max("us") + F.lit(DAY)).scalar()
    return lifecycle.stale(t.evidence, "source", "us", now, 4 * HOUR)


@query("r14_sensor_events", f"SELECT packet_id, interface, CASE WHEN before IS NULL OR us - before > {HOUR} THEN 'sensor_connect' END AS event FROM (SELECT *, lag(us) OVER (PARTITION BY interface ORDER BY us, packet_id) AS before FROM packets) WHERE before IS NULL OR us - before > {HOUR}")
def _(t):
    w = Window.partitionBy("interface").orderBy("us", "packet_id")
    new = t.packets.withColumn("before", F.lag("us").over(w)).where(F.col("before").isNull() | (F.col("us") - F.col("before") > HOUR))
    return new.select("packet_id", "interface", F.lit("sensor_connect").alias("event"))


@query("y02_registered_rules", "SELECT hw_addr, 'unsure' AS rule, 'low' AS severity FROM hosts WHERE hw_addr IN (SELECT hw_addr FROM verdicts WHERE certainty < 80) UNION ALL SELECT hw_addr, 'busy', 'info' FROM hosts WHERE packets > 75")
def _(t):
    return plugins.evaluated(t.hosts, t.verdicts)


@query("e10_dns_affinity_evidence", """SELECT hw_addr, vendor, 0.65::DOUBLE AS certainty FROM (SELECT *, sum(n) OVER (PARTITION BY hw_addr) AS total FROM (
  SELECT hw_addr, split_part(query_name, '.', -2) AS vendor, count(*) AS n FROM packets WHERE protocol = 'dns' GROUP BY ALL)) WHERE n >= 0.4 * total""")
def _(t):
    label = F.element_at(F.split("query_name", r"\."), -2)
    n = t.packets.where("protocol = 'dns'").groupBy("hw_addr", label.alias("vendor")).agg(F.count("*").alias("n"))
    n = n.withColumn("total", F.sum("n").over(Window.partitionBy("hw_addr")))
    return n.where(F.col("n") >= 0.4 * F.col("total")).select("hw_addr", "vendor", F.lit(0.65).alias("certainty"))


@query("t04_connection_table", f"""SELECT hw_addr, min(us) AS start_us, max(us) AS end_us, count(*) AS n, CASE WHEN bool_or(banner LIKE 'SSH%') THEN 'banner_captured' ELSE 'syn_seen' END AS state FROM (
  SELECT *, sum(CASE WHEN before IS NULL OR us - before > {6 * HOUR} THEN 1 ELSE 0 END) OVER (PARTITION BY hw_addr ORDER BY us, packet_id) AS s FROM (SELECT *, lag(us) OVER (PARTITION BY hw_addr ORDER BY us, packet_id) AS before FROM packets WHERE protocol = 'tcp_syn')) GROUP BY hw_addr, s""")
def _(t):
    w = Window.partitionBy("hw_addr").orderBy("us", "packet_id")
    gap = F.col("us") - F.lag("us").over(w)
    new = F.coalesce((gap > 6 * HOUR).cast("int"), F.lit(1))
    s = t.packets.where("protocol = 'tcp_syn'").withColumn("_new", new).withColumn("s", F.sum("_new").over(w))
    state = F.when(F.bool_or(F.col("banner").startswith("SSH")), "banner_captured").otherwise("syn_seen")
    return s.groupBy("hw_addr", "s").agg(F.min("us").alias("start_us"), F.max("us").alias("end_us"), F.count("*").alias("n"), state.alias("state")).drop("s")


@query("t11_event_time_windows", f"SELECT protocol, us // {6 * HOUR} AS bucket, count(*) AS n FROM packets GROUP BY ALL")
def _(t):
    w = F.window(F.timestamp_micros("us"), "6 hours")
    g = t.packets.groupBy("protocol", w.alias("w")).agg(F.count("*").alias("n"))
    return g.select("protocol", F.floor(F.unix_micros("w.start") / (6 * HOUR)).cast("long").alias("bucket"), "n")
