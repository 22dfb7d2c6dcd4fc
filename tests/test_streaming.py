"""Streaming twins against the batch operators, over several micro-batches."""

import os

import pytest
from pyspark.sql import functions as F

from wirefold.operators import throttle
from wirefold.sources.adapters import Tables
from wirefold.streaming import stateful

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
HOUR = 3_600_000_000


@pytest.fixture(scope="module")
def feed(spark, tmp_path_factory):
    """Packets of one protocol in time order, three files: three micro-batches."""
    stateful.state_conf(spark)
    folder = str(tmp_path_factory.mktemp("feed") / "in")
    rows = Tables(spark, SF).packets.where("protocol = 'arp'").select("packet_id", "us", "hw_addr", "ip_addr", "protocol", "port")
    total = rows.count()
    ordered = rows.orderBy("us").toPandas()
    for i in range(3):
        part = ordered.iloc[i * total // 3 : (i + 1) * total // 3]
        spark.createDataFrame(part, rows.schema).coalesce(1).write.mode("append").parquet(folder)
    return folder, rows


def stream(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def run(df, tmp_path, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert q.exception() is None
    return df.sparkSession.table(name).collect()


def test_throttle_equals_batch(spark, feed, tmp_path):
    folder, rows = feed
    got = run(stateful.throttled(stream(spark, folder, rows.schema), 12 * HOUR), tmp_path, "throttle_out")
    want = throttle.throttled(rows, ["hw_addr"], "us", 12 * HOUR).collect()
    assert sorted((r.hw_addr, r.us) for r in got) == sorted((r.hw_addr, r.us) for r in want)


def test_windows_equal_batch(spark, feed, tmp_path):
    folder, rows = feed
    s = stateful.activity(stateful.timed(stream(spark, folder, rows.schema)), "1 day")
    got = run(s, tmp_path, "activity_out", "complete")
    want = rows.groupBy(F.window(F.timestamp_micros("us"), "1 day"), "protocol").agg(F.count("*").alias("n")).collect()
    assert sorted((r.window.start, r.n) for r in got) == sorted((r.window.start, r.n) for r in want)


def test_dedup_keeps_one_per_key(spark, feed, tmp_path):
    folder, rows = feed
    s = stateful.deduplicated(stream(spark, folder, rows.schema).withColumn("ts", F.timestamp_micros("us")), ["hw_addr", "port"], "60 days")
    got = run(s, tmp_path, "dedup_out")
    assert len(got) == rows.select("hw_addr", "port").distinct().count()


def test_affinity_reports_once(spark, tmp_path):
    stateful.state_conf(spark)
    folder = str(tmp_path / "dns")
    schema = "hw_addr string, us long, vendor string"
    for part in ([("m", i, "Apple") for i in range(25)], [("m", 100 + i, "Microsoft") for i in range(20)], [("m", 200 + i, "Microsoft") for i in range(30)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
    got = run(stateful.affinity(stream(spark, folder, schema)), tmp_path, "affinity_out")
    assert [(r.hw_addr, r.from_vendor, r.to_vendor) for r in got] == [("m", "Apple", "Microsoft")]


def test_host_merge_versions(spark, feed, tmp_path):
    folder, rows = feed
    store = str(tmp_path / "hosts")
    q = stream(spark, folder, rows.schema).writeStream.foreachBatch(lambda df, epoch: stateful.merged_hosts(df, store, epoch)).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    got = spark.read.parquet(f"{store}/v2").collect()
    want = rows.groupBy("hw_addr").agg(F.min("us").alias("a"), F.max("us").alias("b")).collect()
    assert sorted((r.hw_addr, r.discovered_us, r.last_us) for r in got) == sorted((r.hw_addr, r.a, r.b) for r in want)


def test_presence_transitions(spark, tmp_path):
    stateful.state_conf(spark)
    folder = str(tmp_path / "seen")
    schema = "hw_addr string, us long"
    minute = 60_000_000
    for part in ([("a", 0), ("b", 0), ("a", minute)], [("a", 20 * minute)], [("b", 21 * minute), ("a", 22 * minute)], [("a", 60 * minute)]):
        part = [(h, us + 1000 * minute) for h, us in part]  # rows at the first watermark, time 0, would be late
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
    s = stateful.presence(stateful.timed(stream(spark, folder, schema), "1 second"), 300)
    got = sorted((r.hw_addr, r.us // minute - 1000, r.state) for r in run(s, tmp_path, "presence_out"))
    assert {(h, st) for h, _, st in got} == {("a", "online"), ("a", "offline"), ("b", "online"), ("b", "offline")}
    assert ("b", 5, "offline") in got and ("b", 0, "online") in got
