import random
import time

import numpy as np

from wirefold.llm.decontaminate import decontaminate, tile

SCHEMA = "doc_id long, text string, items string, n_tiles string"


def brute_tiles(item, text, k):
    """Greedy string tiling by its definition."""
    a, b, total = [False] * len(item), [False] * len(text), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(text)):
                n = 0
                while i + n < len(item) and j + n < len(text) and item[i + n] == text[j + n] and not a[i + n] and not b[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < k:
            return total
        total += n
        a[i : i + n] = b[j : j + n] = [True] * n


def tiles(item, text, k):
    code = lambda w: np.uint64(hash(tuple(w)) % (1 << 63))
    mine = [code(item[i : i + k]) for i in range(len(item) - k + 1)]
    theirs = [(j, code(text[j : j + k])) for j in range(len(text) - k + 1) if code(text[j : j + k]) in mine]
    return tile(np.array([j for j, _ in theirs], np.int64), np.array([c for _, c in theirs], np.uint64), np.array(mine, np.uint64), k)


def test_tiles_against_definition():
    rng = random.Random(5)
    for _ in range(400):
        letters, k = rng.randint(1, 3), rng.randint(1, 4)
        item = [rng.randint(0, letters) for _ in range(rng.randint(k, 16))]
        text = [rng.randint(0, letters) for _ in range(rng.randint(0, 30))]
        got = tiles(item, text, k)
        assert all(item[i : i + n] == text[t : t + n] and n >= k for i, t, n in got)
        assert len({i + x for i, _, n in got for x in range(n)}) == sum(n for _, _, n in got)
        assert len({t + x for _, t, n in got for x in range(n)}) == sum(n for _, _, n in got)
        # Ties go to the first place in the item, then in the text, on both sides.
        assert sum(n for _, _, n in got) == brute_tiles(item, text, k)


def test_repeated_words_take_linear_space():
    start = time.time()
    assert sum(n for _, _, n in tiles(["a"] * 1000, ["a"] * 8000, 5)) == 1000
    assert sum(n for _, _, n in tiles(["a", "b"] * 500, ["a", "b", "c"] * 3000, 2)) == 2 * 500
    assert time.time() - start < 20


def test_coverage_against_definition(spark):
    rng = random.Random(7)
    text = lambda n: [rng.choice("abcde") + rng.choice("xyz") for _ in range(n)]
    items = [text(rng.randint(3, 25)) for _ in range(8)]
    docs = []
    for i in range(60):
        body = text(rng.randint(0, 30))
        for item in rng.sample(items, 2):
            a = rng.randrange(len(item))
            body[rng.randint(0, len(body)) : 0] = item[a : a + rng.randint(3, 20)]
        docs.append(body)
    docs += [docs[0]] * 5 + [text(4000) + items[2] + text(4000)]
    frame = spark.createDataFrame([(i, " ".join(d), "", "") for i, d in enumerate(docs)], SCHEMA).repartition(4)
    marks = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    for got in decontaminate(frame, marks, k=3).collect():
        share = [brute_tiles(x, docs[got.doc_id], 3) / len(x) if len(docs[got.doc_id]) < 500 else None for x in items]
        if None in share:
            assert got.coverage == 1.0 and 2 in got["items"]
            continue
        assert got.coverage == max(share) and got["items"] == [i for i, s in enumerate(share) if s >= 0.5] and got.contaminated == (max(share) >= 0.5)
        assert got.item_id == (share.index(max(share)) if max(share) else None)


def test_shuffled_joins_give_the_same(spark, monkeypatch):
    from wirefold.llm import common, decontaminate as module

    rows = [(i, f"w{i} one two three four five six seven tail{i}", "", "") for i in range(40)] + [(50, None, "", ""), (51, "one two three", "", "")]
    docs, marks = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(1, "one two three four five six seven"), (2, "w3 one two three four five")], "item_id long, text string")
    want = sorted(map(str, decontaminate(docs, marks).collect()))
    monkeypatch.setattr(module, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(module, "bounded_broadcast", lambda df, rows=None: common.bounded_broadcast(df, rows, limit=0))
    assert sorted(map(str, decontaminate(docs, marks).collect())) == want and sum("contaminated=True" in w for w in want) == 40


def test_reordered_and_clean(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    items = [[word() for _ in range(30)] for _ in range(6)]
    clean = " ".join(word() for _ in range(400))
    moved = " ".join(items[1][15:] + ["zzz"] + items[1][:15])
    rows = [
        (0, clean, "x", "y"), (1, clean + " " + " ".join(items[0]).upper() + ", end", "", ""), (2, "pre " + moved, "", ""),
        (3, " ".join(items[2][:10]), "", ""), (4, None, None, None), (5, "", "", ""), (6, " ".join(items[3] + items[4]), "", ""),
        (1, clean, "", ""), (7, "one two three", "", ""), (8, "one two", "", ""),
    ]
    bench = [(i, " ".join(x)) for i, x in enumerate(items)] + [(90, None), (91, ""), (92, "One two three"), (None, "x")]
    docs, marks = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(bench, "item_id long, text string")
    got = [(r.doc_id, r.contaminated, r["items"], round(r.coverage, 3)) for r in decontaminate(docs, marks).collect()]
    assert sorted(got) == sorted([
        (0, False, [], 0.0), (1, True, [0], 1.0), (2, True, [1], 1.0), (3, False, [], 0.333), (4, False, [], 0.0), (5, False, [], 0.0),
        (6, True, [3, 4], 1.0), (1, False, [], 0.0), (7, True, [92], 1.0), (8, False, [], 0.0),
    ])
    none = spark.createDataFrame([], SCHEMA)
    assert decontaminate(none, marks).collect() == [] and decontaminate(docs, marks.limit(0)).where("contaminated").collect() == []


def test_items_without_an_id(spark):
    bench = [(None, "one two three four five six"), (None, "red green blue white black grey"), (5, "one two three four five six"), (-3, "a b c d e f")]
    rows = [(1, "x one two three four five six y", "", ""), (2, "red green blue white black grey", "", ""), (3, "a b c d e f red green blue white black grey", "", ""), (4, "clean text", "", "")]
    out = decontaminate(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(bench, "item_id long, text string"))
    got = sorted((r.doc_id, r.contaminated, r.item_id, r["items"], r.coverage) for r in out.collect())
    assert got == [(1, True, 5, [5, None], 1.0), (2, True, None, [None], 1.0), (3, True, -3, [-3, None], 1.0), (4, False, None, [], 0.0)]
