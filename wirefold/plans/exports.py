"""Exports of devices, alerts and incidents, and the SQL dump."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import sinks
from .base import query


@query("k04_device_export", """SELECT mac, ip_addr AS ip_v4, NULL::VARCHAR AS ip_v6, NULL::VARCHAR AS manufacturer, device_type, NULL::VARCHAR AS os_family, NULL::VARCHAR AS os_version, hostname, NULL::VARCHAR AS confidence,
  discovered_us AS first_seen, last_us AS last_seen, NULL::VARCHAR AS alert_status, owner, location, criticality, array_to_string(tags, ',') AS tags, NULL::VARCHAR AS notes, "authorization", NULL::VARCHAR AS authorized_at,
  NULL::VARCHAR AS authorized_by, is_online, NULL::VARCHAR AS offline_since, threshold AS presence_threshold_seconds FROM devices LEFT JOIN hosts ON mac = hw_addr""")
def _(t):
    seen = t.hosts.select(F.col("hw_addr").alias("mac"), F.col("ip_addr").alias("ip_v4"), F.col("discovered_us").alias("first_seen"), F.col("last_us").alias("last_seen"))
    return sinks.device_export(t.devices.withColumnRenamed("threshold", "presence_threshold_seconds").join(seen, "mac", "left"))


@query("k05_alert_export", """SELECT id, hw_addr AS device_mac, rule AS alert_type, severity, message, us AS "timestamp", status = 'acknowledged' AS acknowledged, status, NULL::VARCHAR AS disposition
  FROM findings WHERE NOT resolved ORDER BY us DESC, id DESC LIMIT 10000""")
def _(t):
    return sinks.alert_export(t.findings)


@query("k05_incident_export", """SELECT id, rule, severity, status, NULL::VARCHAR AS disposition, hw_addr, message, us AS "timestamp", NULL::VARCHAR AS notes FROM findings ORDER BY us DESC, id DESC LIMIT 50000""")
def _(t):
    return sinks.incident_export(t.findings)


@query("k06_sql_dump", """SELECT 'INSERT INTO "devices" VALUES (''' || mac || ''',''' || replace(owner, '''', '''''') || ''',' || CASE WHEN hostname IS NULL THEN 'NULL' ELSE '''' || hostname || '''' END || ','
  || CASE WHEN is_online IS NULL THEN 'NULL' WHEN is_online THEN '1' ELSE '0' END || ',' || custkey || ');' AS value FROM devices""")
def _(t):
    return sinks.sql_dump(t.devices.select("mac", "owner", "hostname", "is_online", "custkey"), "devices")
