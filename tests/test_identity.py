"""Similarity by signal sets and gapless numbers against plain definitions."""

import random

import pytest
from pyspark.sql import functions as F

from wirefold.operators.identity import LEAST, SIGNALS, identities, most_similar, numbered

NAMES = list(SIGNALS)
SCHEMA = "hw_addr string, " + ", ".join(f"{n} string" for n in NAMES)


def made(seed, n, prefix):
    rng = random.Random(seed)
    return [(f"{prefix}{i:04d}", *[rng.choice([None, *"abc"[: rng.randint(1, 3)]]) for _ in NAMES]) for i in range(n)]


def brute(rows, others):
    out = []
    for mac, *mine in rows:
        scored = [(round(sum(w for w, a, b in zip(SIGNALS.values(), mine, theirs) if a is not None and a == b), 6), other) for other, *theirs in others if other != mac]
        best = max(scored, default=(0, None))
        if best[0] >= LEAST:
            out.append((mac, best[1], best[0]))
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_similarity_by_brute_force(spark, seed):
    rows, others = made(seed, 120, "d2"), made(seed + 9, 90, "00")
    got = most_similar(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(others, SCHEMA)).collect()
    assert sorted(map(tuple, got)) == brute(rows, others)


def test_similarity_of_empty_and_null(spark):
    none = spark.createDataFrame([("d2", *[None] * 5)], SCHEMA)
    assert most_similar(none, none).collect() == []
    assert most_similar(none.limit(0), none).collect() == []


def test_a_hot_hostname_makes_no_pairs(spark):
    """20,000 by 20,000 addresses of one hostname: 4e8 pairs, but few rows in any stage."""
    one = lambda prefix: spark.range(20_000).select(F.concat(F.lit(prefix), F.lpad(F.col("id").cast("string"), 5, "0")).alias("hw_addr"), F.expr("if(id >= 0, 'hot', '')").alias("hostname"), F.expr("if(id >= 0, 'x', '')").alias("opt60"), *[F.expr("if(id < 0, 'y', null)").alias(n) for n in NAMES[2:]])
    got = most_similar(one("d2"), one("00"))
    assert got.agg(F.count("*"), F.min("identity"), F.max("identity"), F.min("score")).first() == (20_000, "0019999", "0019999", 0.6)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_numbers_are_dense(spark):
    rng = random.Random(3)
    values = [rng.choice(["é", "Z", "a", ""]) + str(rng.randrange(300)) for _ in range(2000)] + [None]
    frame = spark.createDataFrame([(v,) for v in values], "v string").repartition(5)
    got = {r.v: r.number for r in numbered(frame, "v", 7).collect()}
    assert got == {v: i for i, v in enumerate(sorted({v for v in values if v is not None}, key=str.encode), 7)}
    assert "SinglePartition" not in numbered(frame, "v")._jdf.queryExecution().executedPlan().toString()
    assert numbered(frame.limit(0), "v").collect() == []


def test_passes(spark):
    signals = [("00a", "h", "x", None, None, None), ("00b", "k", None, None, None, None), ("d2c", "h", "x", None, None, None), ("d2d", "h", None, "q", None, None), ("d2e", None, None, None, None, None)]
    verdicts = spark.createDataFrame([("00a", "h"), ("00b", None), ("00f", "h"), ("d2c", "h"), ("d2d", "z"), ("d2e", "z")], "hw_addr string, hostname string")
    got = identities(verdicts, spark.createDataFrame(signals, SCHEMA), F.col("hw_addr").startswith("d2")).collect()
    want = [("00a", 2, None), ("00b", 1, None), ("00f", 2, None), ("d2c", 2, 0.6), ("d2d", 3, None), ("d2e", 3, None)]
    assert sorted(map(tuple, got)) == want
