"""Bucketed upserts, and verdicts from streams against the batch query."""

import json
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from wirefold.operators import fusion
from wirefold.sources.bucketed import BucketedTable, merge_hosts, newest
from wirefold.sources.shared import fresh
from wirefold.streaming import evidence, stateful

HOSTS = "hw_addr string, ip_addr string, discovered_us long, last_us long, randomized int"


def files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def host_rows(seed, n=300):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        us = rng.randrange(10_000)
        rows.append((f"m{rng.randrange(40)}", f"10.0.0.{rng.randrange(9)}", us, us, rng.randrange(2)))
    return rows + [(None, "10.0.0.1", 1, 1, 0), *rows[:5]]


def folded(rows):
    out = {}
    for mac, ip, a, b, r in rows:
        if mac is not None:
            old = out.get(mac)
            out[mac] = (ip, a, b, r) if old is None else (max((old[2], old[0]), (b, ip))[1], min(old[1], a), max(old[2], b), max(old[3], r))
    return sorted((k, *v) for k, v in out.items())


@pytest.mark.parametrize("cuts", [1, 2, 5])
def test_any_cut_into_epochs(spark, tmp_path, cuts):
    rows = host_rows(cuts)
    table = BucketedTable(spark, f"file://{tmp_path}/t", "hw_addr", HOSTS, merge_hosts, buckets=4)
    assert table.read().collect() == [] and table.lookup("m1").collect() == []
    for i in range(cuts):
        assert table.upsert(spark.createDataFrame(rows[i::cuts], HOSTS).withColumn("more", F.lit(1)), i)
    assert sorted(map(tuple, table.read().collect())) == folded(rows)
    one = folded(rows)[3]
    assert [tuple(r) for r in table.lookup(one[0]).collect()] == [one]


def test_a_repeated_epoch_and_untouched_buckets(spark, tmp_path):
    table = BucketedTable(spark, f"file://{tmp_path}/t", "hw_addr", HOSTS, merge_hosts, buckets=8)
    rows = host_rows(7)
    table.upsert(spark.createDataFrame(rows, HOSTS), 0)
    before, old = table.state(), table.read().inputFiles()
    some = spark.createDataFrame([("m3", "10.9.9.9", 99_999, 99_999, 0)], HOSTS)
    assert table.upsert(some, 1)
    after = table.state()
    changed = [b for b in after if after[b] != before.get(b)]
    assert len(changed) == 1 and len(set(old) & set(table.read().inputFiles())) == len({b for b in before if b not in changed})
    seen, got = files(tmp_path), sorted(map(tuple, table.read().collect()))
    assert not table.upsert(some, 1) and not table.upsert(some, 0)
    assert files(tmp_path) == seen and sorted(map(tuple, table.read().collect())) == got == folded([*rows, ("m3", "10.9.9.9", 99_999, 99_999, 0)])
    assert table.upsert(spark.createDataFrame([], HOSTS), 2) and table.state() == after
    assert table.vacuum(keep=1) == 0  # both folders are still named
    table.upsert(spark.createDataFrame(rows, HOSTS), 3)
    assert table.vacuum(keep=1) == 2 and sorted(map(tuple, table.read().collect())) == got


def test_an_attempt_that_died_leaves_no_trace(spark, tmp_path):
    table = BucketedTable(spark, f"file://{tmp_path}/t", "hw_addr", HOSTS, merge_hosts, buckets=2)
    rows = host_rows(1, 30)
    table.upsert(spark.createDataFrame(rows, HOSTS), 0)
    # Files of an attempt without a commit record, and a half-written record.
    spark.createDataFrame(host_rows(2), HOSTS).withColumn("bucket", F.lit(0)).write.partitionBy("bucket").parquet(f"file://{tmp_path}/t/data/1-dead")
    with open(tmp_path / "t" / "commits" / "1.part", "w") as f:
        f.write("{")
    assert sorted(map(tuple, table.read().collect())) == folded(rows)
    assert table.upsert(spark.createDataFrame(rows[:3], HOSTS), 1) and table.epochs() == [0, 1]
    assert json.loads((tmp_path / "t" / "commits" / "1").read_text())["buckets"] == 2
    with pytest.raises(ValueError):
        BucketedTable(spark, f"file://{tmp_path}/t", "hw_addr", HOSTS, merge_hosts, buckets=3).read()


def test_newest_wins_whole(spark, tmp_path):
    table = BucketedTable(spark, f"file://{tmp_path}/t", "k", "k string, v string, at long", newest("k", "at"), buckets=3)
    for epoch, rows in enumerate([[("a", "x", 5), ("b", "y", 1)], [("a", None, 4), ("b", None, 2)], [("c", "z", 0)]]):
        table.upsert(spark.createDataFrame(rows, "k string, v string, at long"), epoch)
    assert sorted(map(tuple, table.read().collect())) == [("a", "x", 5), ("b", None, 2), ("c", "z", 0)]


EVIDENCE = "hw_addr string, id long, source string, certainty double, vendor string, category string, platform string, hostname string, model string, us long"


def evidence_rows(seed, n=400):
    rng = random.Random(seed)
    some = lambda *v: rng.choice([*v, None])
    rows = []
    for i in range(n):
        mac = f"00:00:00:00:00:{min(int(rng.expovariate(0.3)), 15):02x}"
        rows.append((mac, i, rng.choice(["oui", "mdns", "satori_dhcp", "huginn_device", "lldp", "new_source"]), round(rng.random(), 2), some("Apple", "Cisco", "unknown"), some("phone", "router"),
                     some("iOS", "Linux"), some("h1", "h2"), some("m1"), rng.randrange(1000)))
    return rows


def wanted(spark, rows, total=100):
    out = fusion.verdicts(spark.createDataFrame(rows, EVIDENCE), fusion.weight_table(spark), total=total)
    return sorted(map(tuple, out.select("hw_addr", *fusion.FIELDS, "certainty", "evidence", "us").collect()))


@pytest.mark.parametrize("cuts, total", [(1, 100), (4, 100), (3, 7)])
def test_replay_in_any_batching(spark, tmp_path, cuts, total):
    rows = evidence_rows(cuts)
    random.Random(0).shuffle(rows)  # late and early rows mixed
    folder, table = str(tmp_path / "in"), evidence.verdict_table(spark, f"file://{tmp_path}/verdicts", buckets=4)
    with stateful.state_store(spark):
        for i in range(cuts):
            # The query ends and starts again from its checkpoint for each part.
            spark.createDataFrame(rows[i::cuts], EVIDENCE).coalesce(2).write.mode("append").parquet(folder)
            stream = spark.readStream.schema(EVIDENCE).option("maxFilesPerTrigger", 1).parquet(folder)
            query = evidence.stream_verdicts(stream, table, str(tmp_path / "checkpoint"), total=total)
            assert query.awaitTermination(240) and query.exception() is None
    got = sorted(map(tuple, table.read().select("hw_addr", *fusion.FIELDS, "certainty", "evidence", "us").collect()))
    assert got == wanted(spark, rows, total)


def test_kept_is_a_cap_by_source():
    rows = [(i, "s" if i % 2 else None, (i * 7 % 10) / 10 if i % 3 else None, *[None] * 5, i) for i in range(40)]
    once = sorted(evidence.kept(rows, 3))
    step = []
    for r in random.Random(1).sample(rows, len(rows)):
        step = evidence.kept([*step, r], 3)
    assert sorted(step) == once and len(once) == 6


def test_state_expires(spark, tmp_path):
    """With a time to live, an address that comes back starts anew."""
    folder, table = str(tmp_path / "in"), evidence.verdict_table(spark, f"file://{tmp_path}/verdicts", buckets=2, keep_hostname=True)
    put = lambda host, vendor: spark.createDataFrame([("m", 1, "oui", 1.0, vendor, None, None, host, None, 5)], EVIDENCE).coalesce(1).write.mode("append").parquet(folder)
    put("first", "Apple")
    with stateful.state_store(spark):
        stream = spark.readStream.schema(EVIDENCE).parquet(folder)
        query = evidence.stream_verdicts(stream, table, str(tmp_path / "checkpoint"), ttl_ms=500, trigger={"processingTime": "1 second"})
        try:
            for epochs in (1, 2):
                end = time.time() + 90
                while len(table.epochs()) < epochs and time.time() < end:
                    time.sleep(0.5)
                if epochs == 1:
                    time.sleep(2)
                    put(None, "Cisco")
        finally:
            query.stop()
    (row,) = table.read().collect()
    assert (row.vendor, row.evidence, row.hostname) == ("Cisco", 1, "first")


def test_shared_folder_is_one(spark):
    assert os.path.dirname(fresh(spark, "a")) == os.path.dirname(fresh(spark, "b"))
