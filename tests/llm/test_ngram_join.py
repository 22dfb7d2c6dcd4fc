import random

import numpy as np
import pyarrow as pa

from wirefold.llm.ngram_join import SKETCH, _judged, intersections, near_duplicates, runs_needed, similar, sketch_bound
from wirefold.llm.common import connected_components

SCHEMA = "doc_id long, text string, class_id string, size string"


def shingles(text, k=5):
    import re

    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c < "\x80" else c for c in text or ""))
    if not w:
        return set()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))}


def brute(rows, threshold=0.8):
    sets = [shingles(t) for _, t in rows]
    n = len(rows)
    label = list(range(n))
    links = [0] * n

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(n):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and len(a & b) >= threshold * len(a | b) - 1e-9:
                links[i] += 1
                links[j] += 1
                x, y = sorted((top(i), top(j)))
                label[y] = x
    low = {}
    for i in range(n):
        low.setdefault(top(i), []).append(rows[i][0])
    return [(rows[i][0], min(low[top(i)]), links[i]) for i in range(n)]


def corpus(seed, near=30):
    rng = random.Random(seed)
    word = lambda: rng.choice("ab cd ef gh ij kl mn op qr st uv wx yz été".split()) + str(rng.randint(0, 30))
    rows = []
    for _ in range(12):
        base = [word() for _ in range(rng.randint(6, 120))]
        rows.append(" ".join(base))
        for _ in range(rng.randint(0, 5)):
            other = list(base)
            for _ in range(rng.randint(0, 4)):
                other[rng.randrange(len(other))] = word()
            rows.append(rng.choice([" ", ", "]).join(other))
    hot = [word() for _ in range(200)]
    for _ in range(near):
        other = list(hot)
        other[rng.randrange(200)] = word()
        rows.append(" ".join(other).upper())
    rows += [rows[0]] * 4 + ["", None, "...", "one two", "One two!", "one two three", "a b c d e", "x " * 3000]
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_against_brute_force(spark):
    for seed, limit, block, alike in ((1, 64, 512, 0.6), (2, 4, 8, 0.6), (2, 4, 8, 2.0)):
        rows = corpus(seed)
        frame = spark.createDataFrame([(i, t, "clash", "s") for i, t in rows], SCHEMA).repartition(3)
        out = near_duplicates(frame, limit=limit, block=block, recall=0.9999, alike=alike).collect()
        assert sorted((r.doc_id, r.class_id, r.n_links) for r in out) == sorted(brute(rows))
        heads = [r for r in out if r.kept]
        assert sorted(r.doc_id for r in heads) == sorted({c for _, c, _ in brute(rows)})


def test_edges(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(1, "a b c d e f", "", "")] * 3 + [(2, None, None, None), (None, "a b c d e f", "", "")]
    out = near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(r.n_links for r in out) == [0, 3, 3, 3, 3]
    assert sum(r.kept for r in out if r.n_links) == 1
    assert runs_needed(0.9995, 1, 50.0) == 1 and runs_needed(0.9995) == 8


def test_components(spark):
    edges = [("b", "a"), ("c", "b"), ("d", "c"), ("x", "y"), ("z", "z"), (None, "a")] + [(f"p{i:03}", f"p{i + 1:03}") for i in range(60)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u string, v string")).collect()}
    assert got == {k: "a" for k in "abcd"} | {k: "x" for k in "xy"} | {f"p{i:03}": "p000" for i in range(61)}


def test_intersections():
    import numpy as np

    sets = [np.array([1, 2, 3], np.uint64), np.array([2, 3, 4], np.uint64), np.array([9], np.uint64)]
    assert intersections(sets)[0, 1] == 2 and intersections(sets)[1, 2] == 0


def test_recall_at_the_threshold(spark):
    """Default recall, every level forced to split: pairs barely above 0.8 are found."""
    rng = random.Random(12)
    rows, near = [], 0
    while near < 150:
        base = [f"w{rng.randint(0, 10**6)}" for _ in range(rng.randint(60, 200))]
        other = list(base)
        for _ in range(max(1, len(base) // 55)):
            other[rng.randrange(len(base))] = f"v{rng.randint(0, 10**6)}"
        a, b = shingles(" ".join(base)), shingles(" ".join(other))
        if 0.8 <= len(a & b) / len(a | b) < 0.86:
            near += 1
            rows += [" ".join(base), " ".join(other)]
    frame = spark.createDataFrame([(i, t, "", "") for i, t in enumerate(rows)], SCHEMA)
    for options in ({}, {"limit": 1, "alike": 2.0}):
        out = near_duplicates(frame, **options).collect()
        assert sum(r.n_links for r in out) >= 2 * 0.98 * near and sum(r.n_links for r in out) <= 2 * near


def test_sketches_lose_little():
    rng = np.random.default_rng(4)
    bound = sketch_bound(SKETCH, 0.8, 1e-4)
    assert 30 < bound < 45
    a, b = [], []
    for _ in range(2000):
        every = rng.integers(-(1 << 31), 1 << 31, 200)
        shared, left, right = every[:160], every[160:180], every[180:]
        a.append(np.sort(np.concatenate((shared, left)))[:SKETCH])
        b.append(np.sort(np.concatenate((shared, right)))[:SKETCH])
    rows = np.arange(2000)
    assert similar(np.array(a + b), rows, rows + 2000, 0.8, 1e-4).mean() > 0.998
    assert not similar(np.array(a + b), rows[1:], rows[:-1] + 2000, 0.8, 1e-4).any()


def test_a_pair_is_judged_once():
    """In the smallest leaf it shares, whichever way its group is handled."""
    rng = random.Random(3)
    for n in (6, 60):
        lists = [sorted({rng.randint(0, 9) for _ in range(rng.randint(1, 5))}) for _ in range(n)]
        rows = sorted((leaf, i) for i, x in enumerate(lists) for leaf in x)
        table = pa.table({
            "leaf": pa.array([r[0] for r in rows], pa.int64()), "low": [0] * len(rows), "high": [0] * len(rows), "block": [0] * len(rows),
            "leaves": pa.array([lists[i] for _, i in rows], pa.list_(pa.int64())),
        })
        group = np.cumsum(np.diff(table["leaf"].to_numpy(), prepend=rows[0][0]) != 0)
        got = sorted(tuple(sorted((rows[x][1], rows[y][1]))) for a, b in _judged(table, group) for x, y in zip(a, b))
        assert got == sorted((i, j) for i in range(n) for j in range(i + 1, n) if set(lists[i]) & set(lists[j]))
