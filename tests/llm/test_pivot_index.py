import random

import numpy as np

from wirefold.llm.pivot_index import near_vectors

SCHEMA = "vec_id long, embedding array<float>, label int, kept string"


def brute(rows, threshold=0.98):
    n = len(rows)
    ok = [r[2] is not None and r[1] is not None and len(r[1]) > 0 and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1]) for r in rows]
    label, links = list(range(n)), [0] * n

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    unit = [np.array(r[1], np.float32).astype(float) / np.linalg.norm(np.array(r[1], np.float32).astype(float)) if g else None for r, g in zip(rows, ok)]
    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold:
                links[i] += 1
                links[j] += 1
                label[top(i)] = top(j)
    low = {}
    for i in range(n):
        low.setdefault(top(i), []).append(rows[i][0])
    return [(rows[i][0], links[i], min(low[top(i)])) for i in range(n)]


def test_recall_and_precision(spark):
    rng = np.random.default_rng(3)
    rows = []
    for _ in range(60):
        base = rng.normal(size=16)
        label = int(rng.integers(0, 3))
        for _ in range(int(rng.integers(1, 6))):
            rows.append(((base + rng.normal(size=16) * rng.choice([0.02, 0.05, 0.2])).astype(np.float32).tolist(), label))
    hot = rng.normal(size=16)
    rows += [((hot + rng.normal(size=16) * 0.03).astype(np.float32).tolist(), 1) for _ in range(60)]
    rows += [(hot.astype(np.float32).tolist(), 1)] * 20 + [(hot.astype(np.float32).tolist(), None), (None, 1), ([0.0] * 16, 1), ([float("nan")] * 16, 1), ([None] + [1.0] * 15, 1), ([], 1), ([1.0, 2.0], 1), ([float("inf")] * 16, 1)]
    random.Random(1).shuffle(rows)
    rows = [(i, v, c, "clash") for i, (v, c) in enumerate(rows)]
    want = brute(rows)
    for block in (1024, 16):
        got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in near_vectors(spark.createDataFrame(rows, SCHEMA), block=block).collect())
        assert len(got) == len(rows)
        assert all(g[1] <= w[1] for g, w in zip(got, want))
        assert sum(g[1] for g in got) >= 0.99 * sum(w[1] for w in want)
        assert sum(g[2] == w[2] for g, w in zip(got, want)) >= 0.98 * len(want)
        assert all(k == (i == c) for i, _, c, k in got)


def test_empty(spark):
    assert near_vectors(spark.createDataFrame([], SCHEMA)).collect() == []
