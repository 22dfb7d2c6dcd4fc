"""Stored tables and stateful streams, fed with the given tables in several micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import fusion
from ..sources.bucketed import BucketedTable, merge_arp, merge_hosts
from ..sources.shared import fresh, written
from ..streaming import affinity, connections, evidence, sensors
from ..streaming.stateful import replayed
from . import oracle
from .base import DAY, HOUR, query
from .records import n

OWN_DOMAINS = [("icloud.com", "Apple"), ("time.apple.com", "Apple"), ("update.microsoft.com", "Microsoft"), ("clients.google.com", "Google"), ("api.amazon.com", "Amazon")]
_FIELDS = [*fusion.FIELDS, "certainty", "evidence"]


@query("t02_evidence_state", f"SELECT hw_addr, {', '.join(_FIELDS)}, us FROM verdicts")
def _(t):
    return evidence.replayed_verdicts(t.evidence).select("hw_addr", *_FIELDS, "us")


@query("k02_host_upsert", "SELECT hw_addr, ip_addr, discovered_us, last_us, randomized FROM (SELECT hw_addr, arg_max(ip_addr, (us, ip_addr)) AS ip_addr, min(us) AS discovered_us, max(us) AS last_us, max(CASE WHEN hw_addr LIKE 'd2%' THEN 1 ELSE 0 END) AS randomized FROM packets GROUP BY hw_addr)")
def _(t):
    rows = t.packets.select("hw_addr", "ip_addr", F.col("us").alias("discovered_us"), F.col("us").alias("last_us"), F.col("hw_addr").startswith("d2").cast("int").alias("randomized"), "packet_id")
    table = BucketedTable(t.spark, fresh(t.spark, "hosts"), "hw_addr", "hw_addr string, ip_addr string, discovered_us long, last_us long, randomized int", merge_hosts)
    for epoch in range(3):  # the last one once more: a replay
        table.upsert(rows.where(F.col("packet_id") % 3 == epoch), epoch)
    table.upsert(rows.where(F.col("packet_id") % 3 == 2), 2)
    return table.read()


@query("k02_arp_upsert", """SELECT hw_addr, ip_addr, min(us) AS first_us, max(us) AS last_us, count(*) AS packets, bool_or(ip_addr = target_ip) AS gratuitous
  FROM packets WHERE protocol = 'arp' GROUP BY hw_addr, ip_addr""")
def _(t):
    rows = t.packets.where("protocol = 'arp'").select(
        F.concat_ws("|", "hw_addr", "ip_addr").alias("pairing"), "hw_addr", "ip_addr", F.col("us").alias("first_us"), F.col("us").alias("last_us"),
        F.lit(1).cast("long").alias("packets"), (F.col("ip_addr") == F.col("target_ip")).alias("gratuitous"), "packet_id",
    )
    kind = "pairing string, hw_addr string, ip_addr string, first_us long, last_us long, packets long, gratuitous boolean"
    table = BucketedTable(t.spark, fresh(t.spark, "arp"), "pairing", kind, merge_arp)
    for epoch in (0, 1, 1):
        table.upsert(rows.where(F.col("packet_id") % 2 == epoch), epoch)
    return table.read().drop("pairing")


@query("s03_sensor_frames", """SELECT hw_addr AS sensor, row_number() OVER (PARTITION BY hw_addr ORDER BY packet_id) - 1 AS n, us, user_id % 2 AS interface,
  repeat(printf('%02x', k), (k % 5 + 1)::INT) || printf('%08x', packet_id) AS frame FROM packets""")
def _(t):
    # Each frame is cut in two messages at a place of its own; the three parts split a sensor's messages by number.
    w = Window.partitionBy("hw_addr")
    p = t.packets.select("hw_addr", "us", "k", "user_id", "packet_id", (F.row_number().over(w.orderBy("packet_id")) - 1).cast("long").alias("i"), F.count("*").over(w).alias("all"))
    body = f"concat(repeat({n('k')}, k % 5 + 1), {n('packet_id', 4)})"
    text = F.expr(f"concat({n(f'length({body}) / 2', 4)}, {n('us * 1000', 8)}, {n('user_id % 2', 4)}, {body})")
    at = 2 * (1 + F.col("k") % 15)
    halves = F.array(F.struct((F.col("i") * 2).alias("seq"), F.unhex(text.substr(F.lit(1), at)).alias("body")), F.struct((F.col("i") * 2 + 1).alias("seq"), F.unhex(text.substr(at + 1, F.length(text))).alias("body")))
    rows = p.select(F.col("hw_addr").alias("sensor"), F.floor(F.col("i") * 3 / F.col("all")).alias("part"), F.explode(halves).alias("m")).select("sensor", "part", "m.*")
    rows = written(rows, "messages-made")
    # The second message of every part comes in the part before: early, and once more in its own.
    parts = [rows.where(F.col("part") == i).unionByName(rows.where((F.col("part") == i + 1) & (F.col("seq") % 50 == 1)).limit(20)) for i in range(3)]
    found = sensors.replayed_frames(parts).where("broken IS NULL")
    return found.select("sensor", "n", "us", "interface", F.lower(F.hex("frame")).alias("frame"))


_LIMITS = affinity.Limits(least=6, learn=2 * DAY, young=4 * DAY, hold=DAY, early=0.60, stable=0.50, top=0.40, forget=5000 * DAY)
_VENDORS = sorted({v for _, v in OWN_DOMAINS})
#: Running counts of each vendor, baseline at the first row that may lock it, streaks of displaced rows.
_DRIFT = f"""WITH d AS (SELECT hw_addr, us, packet_id, vendor FROM packets JOIN {oracle.values(OWN_DOMAINS, "o(name, vendor)")} ON name = query_name WHERE protocol = 'dns'),
  c AS (SELECT d.hw_addr, d.us, d.packet_id, v.v, count(*) FILTER (d.vendor = v.v) OVER w AS n, min(CASE WHEN d.vendor = v.v THEN struct_pack(us := d.us, id := d.packet_id) END) OVER w AS seen,
      count(*) OVER w AS total, d.us - min(d.us) OVER w AS age FROM d CROSS JOIN (SELECT unnest([{", ".join(map(oracle.literal, _VENDORS))}]) AS v) v
      WINDOW w AS (PARTITION BY d.hw_addr, v.v ORDER BY d.us, d.packet_id ROWS UNBOUNDED PRECEDING)),
  r AS (SELECT *, row_number() OVER (PARTITION BY hw_addr, us, packet_id ORDER BY n DESC, seen.us, seen.id) AS place FROM c WHERE n > 0),
  t AS (SELECT hw_addr, us, packet_id, total, age, v AS top, n AS top_n FROM r WHERE place = 1),
  b AS (SELECT hw_addr, arg_min(top, (us, packet_id)) AS baseline, min((us, packet_id)) AS locked FROM t WHERE total >= {_LIMITS.least} AND age >= {_LIMITS.learn} GROUP BY hw_addr),
  j AS (SELECT t.*, b.baseline, r.n AS base_n, t.top <> b.baseline AND round(1 - r.n / t.total::DOUBLE, 12) >= CASE WHEN t.age < {_LIMITS.young} THEN 0.6 ELSE 0.5 END AND t.top_n / t.total::DOUBLE >= 0.4 AS out
      FROM t JOIN b ON b.hw_addr = t.hw_addr AND (t.us, t.packet_id) > b.locked JOIN r ON r.hw_addr = t.hw_addr AND r.us = t.us AND r.packet_id = t.packet_id AND r.v = b.baseline),
  g AS (SELECT *, count(*) FILTER (NOT out) OVER (PARTITION BY hw_addr ORDER BY us, packet_id) AS streak, lead(us) OVER (PARTITION BY hw_addr ORDER BY us, packet_id) AS next FROM j),
  s AS (SELECT hw_addr, streak, min(us) FILTER (age < {_LIMITS.young}) AS young, min(us) FILTER (age >= {_LIMITS.young}) + {_LIMITS.hold} AS due, max(next) AS last, bool_or(next IS NULL) AS open FROM g WHERE out GROUP BY ALL),
  f AS (SELECT hw_addr, streak, coalesce(young, due) AS at, young IS NOT NULL AS quick FROM s WHERE young IS NOT NULL OR open OR last >= due)
  SELECT f.hw_addr, f.at AS us, any_value(g.baseline) AS from_vendor, round(arg_max(g.base_n, (g.us, g.packet_id)) * 100.0::DOUBLE / max(g.total), 1) AS from_pct,
    arg_max(g.top, (g.us, g.packet_id)) AS to_vendor, round(arg_max(g.top_n, (g.us, g.packet_id)) * 100.0::DOUBLE / max(g.total), 1) AS to_pct
  FROM f JOIN g ON g.hw_addr = f.hw_addr AND g.streak = f.streak AND g.out AND (g.us < f.at OR quick AND g.us = f.at) GROUP BY f.hw_addr, f.at"""


@query("t03_dns_affinity_stream", _DRIFT)
def _(t):
    own = F.broadcast(t.spark.createDataFrame(OWN_DOMAINS, "query_name string, vendor string"))
    rows = written(t.packets.where("protocol = 'dns'").join(own, "query_name").select("hw_addr", "us", F.col("packet_id").alias("id"), "vendor"), "dns")
    # Two parts in time, mixed by up to the lateness, then a row far ahead that ends the time of all others.
    low, high = rows.agg(F.min("us"), F.max("us")).first()
    late = F.col("us") < (low + high) // 2 + (F.col("id") % 5) * DAY
    end = t.spark.createDataFrame([("end", high + 400 * DAY, 0, "end")], "hw_addr string, us long, id long, vendor string")
    return replayed([rows.where(late), rows.where(~late), end], lambda s: affinity.drift(s, _LIMITS, "8 days")).where("hw_addr <> 'end'")


def _in_two_parts(rows, time: str, number, end: DataFrame) -> list[DataFrame]:
    """Two parts in time, mixed by up to four days, then a row far ahead that ends the time of all others."""
    low, high = rows.agg(F.min(time), F.max(time)).first()
    late = F.col(time) < (low + high) // 2 + (number % 5) * DAY
    return [rows.where(late).drop("_n"), rows.where(~late).drop("_n"), end.withColumn(time, F.lit(high + 400 * DAY)).select(*rows.drop("_n").columns)]


@query("t04_connection_stream", f"""SELECT hw_addr AS server, ip_addr AS client, port AS server_port, min(us) AS first_us, max(us) AS last_us, CASE WHEN bool_or(banner LIKE 'SSH%') THEN 'banner_captured' ELSE 'syn_seen' END AS state,
    (sum(CASE WHEN banner LIKE 'SSH%' THEN 0 ELSE k END))::BIGINT AS bytes, 'expired' AS ended, max(us) + {2 * DAY} AS us FROM (
  SELECT *, sum(CASE WHEN before IS NULL OR us - before > {2 * DAY} THEN 1 ELSE 0 END) OVER (PARTITION BY hw_addr, ip_addr, port ORDER BY us, packet_id) AS s FROM (
    SELECT *, lag(us) OVER (PARTITION BY hw_addr, ip_addr, port ORDER BY us, packet_id) AS before FROM packets WHERE protocol = 'tcp_syn')) GROUP BY hw_addr, ip_addr, port, s""")
def _(t):
    # Each packet opens its connection, unless it is open, and then speaks.
    ssh = F.col("banner").startswith("SSH")
    events = F.array(F.struct(F.lit(0).alias("event"), F.lit(0).cast("long").alias("bytes")), F.struct(F.when(ssh, 2).otherwise(1).alias("event"), F.when(ssh, 0).otherwise(F.col("k")).cast("long").alias("bytes")))
    rows = t.packets.where("protocol = 'tcp_syn'").select(F.col("hw_addr").alias("server"), "us", F.explode(events).alias("e"), F.col("ip_addr").alias("client"), F.lit(1).alias("client_port"), F.col("port").alias("server_port"), F.col("packet_id").alias("_n"))
    rows = written(rows.select("server", "us", "e.event", "client", "client_port", "server_port", "e.bytes", "_n"), "events")
    end = rows.limit(1).withColumn("server", F.lit("end"))
    out = replayed(_in_two_parts(rows, "us", F.col("_n"), end), lambda s: connections.connections(s, 2 * DAY, 10_000, "8 days"))
    return out.where("server <> 'end'").drop("client_port")


@query("t08_sensor_sessions", f"""WITH b AS (SELECT hw_addr AS sensor, us, lag(us) OVER w AS before, lead(us) OVER w AS next FROM packets WINDOW w AS (PARTITION BY hw_addr ORDER BY us, packet_id))
  SELECT sensor, us, 'sensor_connect' AS event FROM b WHERE before IS NULL OR us > before + {8 * HOUR} UNION ALL SELECT sensor, us + {8 * HOUR}, 'sensor_disconnect' FROM b WHERE next IS NULL OR next > us + {8 * HOUR}""")
def _(t):
    rows = written(t.packets.select(F.col("hw_addr").alias("sensor"), "us", F.col("packet_id").alias("_n")), "beats")
    end = rows.limit(1).withColumn("sensor", F.lit("end"))
    out = replayed(_in_two_parts(rows, "us", F.col("_n"), end), lambda s: connections.sensor_events(s, 8 * HOUR, "8 days"))
    return out.where("sensor <> 'end'")
