import random
from collections import Counter, defaultdict

from wirefold.llm.mixing import _halved, drawn, mix_sources

SCHEMA = "doc_id long, text string, source string, size string, shard string"


def made(spark, rows):
    return spark.createDataFrame([(i, t, s, "clash", "clash") for i, (t, s) in enumerate(rows)], SCHEMA)


def targets(sizes, weights=(1, 2, 3)):
    """Reshare by hand until no source is above three times its size."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while True:
        rest = total - sum(capped.values())
        free = [s for s in names if s not in capped]
        out = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s: 3 * sizes[s] for s in free if out[s] > 3 * sizes[s]}
        if not over:
            return out | capped
        capped |= over


def test_targets_and_draws(spark):
    rows = [("w " * (i % 40 + 1), f"s{i % 4}") for i in range(4000)] + [("a b", "tiny")] * 10 + [("x", None)] * 30 + [("", "void"), (None, "void")]
    out = mix_sources(made(spark, rows), blocks=16).collect()
    assert len(out) == len(rows)
    sizes, taken, target = Counter(), Counter(), {}
    for r in out:
        sizes[r.source] += r["size"]
        taken[r.source] += r["size"] * r.copies
        target[r.source] = r.target
        assert 0 <= r.copies <= 3 and r.copies == len(r.shards)
    want = targets({k: sizes[k] for k in target})
    for s in target:
        assert abs(target[s] - want[s]) < 1e-6 * max(1, want[s])
        assert abs(taken[s] - target[s]) <= 40
    again = mix_sources(made(spark, rows), blocks=16).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))


def test_shards_are_even_and_disjoint(spark):
    frame = mix_sources(made(spark, [("w w w", f"s{i % 3}") for i in range(3000)]), blocks=64)
    rows = drawn(frame).collect()
    per = Counter(r.shard for r in rows)
    assert len(per) == 16 and max(per.values()) < 2.2 * min(per.values())
    by = defaultdict(Counter)
    for r in rows:
        by[r.source][r.shard] += 1
    assert all(len(c) >= 12 for c in by.values())


def test_empty_and_ties(spark):
    assert mix_sources(made(spark, [])).collect() == []
    frame = made(spark, [("a b c", "s")] * 50).withColumn("doc_id", made(spark, []).doc_id * 0) if False else spark.createDataFrame([(1, "a b c", "s", "", "")] * 50, SCHEMA)
    out = mix_sources(frame).collect()
    assert {(r.copies, r.target) for r in out} == {(1, 150.0)}


def test_few_documents_come_near_the_target(spark):
    rng = random.Random(9)
    rows = [("w " * rng.randint(1, 900), f"s{i % 5}") for i in range(200)]
    out = mix_sources(made(spark, rows)).collect()
    sizes, taken, target = Counter(), Counter(), {}
    for r in out:
        sizes[r.source] += r["size"]
        taken[r.source] += r["size"] * len(r.shards)
        target[r.source] = r.target
        assert r.copies == len(r.shards) <= 3 and all(0 <= s < 16 for s in r.shards)
    assert all(abs(taken[s] - target[s]) <= max(0.02 * target[s], 5) for s in target)


def test_tree_halves_its_nodes(spark):
    units = spark.createDataFrame([(f"s{i % 3}", i, i % 16, 1) for i in range(1001)], "source string, unit int, block int, pass int").selectExpr("*", "0 AS node")
    for level in range(3):
        units = _halved(units, level, 7)
        sizes = Counter(r.node for r in units.collect())
        assert sum(sizes.values()) == 1001 and max(sizes.values()) - min(sizes.values()) <= 1 and len(sizes) == 2 << level
