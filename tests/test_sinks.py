"""Exports and writers on small rows, and records with broken fields."""

import json

import pytest

from wirefold.operators import exposure, records
from wirefold.sources import sinks


def test_exports_round_trip(spark, tmp_path):
    df = sinks.device_export(spark.createDataFrame([("m1", ["a", "b"], 'say "hi", you'), ("m2", None, None)], "mac string, tags array<string>, notes string"))
    assert df.columns == sinks.DEVICE_COLUMNS and len(df.columns) == 23
    sinks.write_export(df, f"{tmp_path}/csv")
    back = {r.mac: r for r in spark.read.option("header", True).option("escape", '"').csv(f"{tmp_path}/csv").collect()}
    assert back["m1"].tags == "a,b" and back["m1"].notes == 'say "hi", you' and back["m2"].notes is None
    sinks.write_export(df, f"{tmp_path}/json", "json")
    assert {r.mac for r in spark.read.json(f"{tmp_path}/json").collect()} == {"m1", "m2"}
    with pytest.raises(ValueError, match="xml"):
        sinks.write_export(df, f"{tmp_path}/xml", "xml")


def test_sql_dump(spark):
    df = spark.createDataFrame([(1, "O'Neil", True, 1.5), (None, None, None, None)], "a int, b string, c boolean, d double")
    assert [r.value for r in sinks.sql_dump(df, "t").collect()] == ["INSERT INTO \"t\" VALUES (1,'O''Neil',1,1.5);", 'INSERT INTO "t" VALUES (NULL,NULL,NULL,NULL);']


def test_appended_tables(spark, tmp_path):
    p = spark.createDataFrame([(1, 0, {"x": "1"}), (2, 86_400_000_000, None)], "packet_id int, us long, fields map<string,string>")
    for _ in range(2):
        sinks.append_sightings(p, f"{tmp_path}/s")
        sinks.append_anomalies(p.select("packet_id"), f"{tmp_path}/a")
    got = spark.read.parquet(f"{tmp_path}/s")
    assert got.count() == 4 and got.select("date").distinct().count() == 2 and spark.read.json(f"{tmp_path}/a").count() == 4
    assert {json.loads(r.fields)["x"] for r in got.where("fields IS NOT NULL").collect()} == {"1"}


def test_batched_writer(spark, tmp_path):
    spark.range(10).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id long").parquet(f"{tmp_path}/in")
    q = sinks.batched(stream, lambda df, _: df.write.mode("append").parquet(f"{tmp_path}/out"), f"{tmp_path}/c")
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 10


def test_broken_records(spark):
    ddl = "packet_id int, hw_addr string, ip_addr string, protocol string, is_server boolean, fields map<string,string>, text string, port int, source_port int"
    rows = [(1, None, None, None, None, None, None, None, None), (2, "a", "0.0.0.0", "dhcpv4", None, {"message_type": "2"}, "<x", 5000, 22), (3, "a", "1.2.3.4", "stp", True, {"bridge_priority": "x"}, "", None, None)]
    df = spark.createDataFrame(rows, ddl)
    assert records.dhcp_servers(df).count() == 0 and records.ws_discovery(df).count() == 0 and records.upnp(df).count() == 0
    assert [(r.source, r.certainty) for r in records.infrastructure(df).collect()] == [("stp", 0.2)]
    assert [r.service for r in records.watched_services(df).collect()] == ["ssh"]
    assert records.industrial(df).count() == 0 and records.server_roles(df).count() == 1
    assert [r.source for r in records.gateways_learned(df).collect()] == ["dhcp_server"]


def test_rules_of_null_fields(spark):
    names = "source, ip_addr, target_ip, query_name, root_mac, server_id, category, service".split(", ")
    ddl = "hw_addr string, op int, port int, tls_version int, message_type int, negotiating boolean, override boolean, " + ", ".join(f"{n} string" for n in names)
    assert exposure.observed(spark.createDataFrame([(None,) * 15], ddl)).count() == 0 and exposure.observed(spark.createDataFrame([], ddl)).count() == 0
