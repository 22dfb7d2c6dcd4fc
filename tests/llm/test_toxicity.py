import os
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wirefold.llm.toxicity import FEATURES, INSULTS, SECOND_PERSON, Trees, features, isotonic, learn_lexicon, parts, predict, train

SCHEMA = "doc_id long, text string, score string"


def auc(score, label):
    order = np.argsort(score)
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    _, inverse, count = np.unique(score, return_inverse=True, return_counts=True)
    rank = (np.bincount(inverse, weights=rank) / count)[inverse]
    good = label == 1
    return (rank[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())


def corpus(n, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijk") for _ in range(rng.randint(2, 7)))
    texts, label = [], []
    for i in range(n):
        w = [word() for _ in range(rng.randint(1, 80))]
        bad = i % 5 == 0
        for _ in range(2 * bad):
            w.insert(rng.randint(0, len(w)), rng.choice([rng.choice(INSULTS[:12]), "grump" + word()]))
        texts.append(" ".join(w))
        label.append(bad)
    return texts, np.array(label)


def test_learns_and_calibrates(spark):
    texts, label = corpus(1500, 1)
    docs = spark.createDataFrame([(i, t, "") for i, t in enumerate(texts)], SCHEMA).repartition(3)
    labels = spark.createDataFrame([(i, int(x)) for i, x in enumerate(label)], "doc_id long, toxic int")
    model = train(docs, labels)
    other, truth = corpus(600, 2)
    score = model.score(pa.array(other))
    assert auc(score, truth) > 0.97 and ((score >= 0) & (score <= 1)).all()
    assert abs(score.mean() - truth.mean()) < 0.05
    assert model.score(pa.array(["", "..."])).max() < 0.5
    again = train(docs.repartition(7), labels)  # the partitioning does not matter
    assert (again.score(pa.array(other)) == score).all()


def test_held_out_labels_change_nothing(spark):
    texts, label = corpus(400, 8)
    docs = spark.createDataFrame([(i, t, "") for i, t in enumerate(texts)], SCHEMA)
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    known = docs.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)
    table = lambda rows: spark.createDataFrame(rows, "doc_id long, toxic int")
    rows = [(i, int(x)) for i, x in enumerate(label)]
    score = None
    for some in (rows, [(i, 1 if held(i) else x) for i, x in rows], [r for r in rows if not held(r[0])]):
        got = train(known, table(some), train_docs=200).score(pa.array(texts))
        assert score is None or (got == score).all()
        score = got


def test_features_are_named_and_finite():
    odd = pa.array(["", None, "A", "!!!", "YOU IDIOT!!", "1d10t @$$ s.t.u.p.i.d", "é" * 3, "aaa bbb " * 4000])
    p = parts(odd)
    code, doc = p.unique(0)
    known = code[doc == 4]
    lexicon = learn_lexicon(np.zeros(len(known), int), known, np.full(len(known), 20.0), np.zeros(len(known)), 20, 20)
    x = features(p, lexicon)
    assert x.shape == (8, len(FEATURES)) and np.isfinite(x).all()
    named = dict(zip(FEATURES, x[4]))
    assert named["shouted"] == 1 and named["insults"] == 0.5 and named["second_person"] == 0.5 and named["exclamations"] > 0
    assert named["word_density"] == 1 and named["near_second_person"] == 1


def test_rates_against_plain_python():
    rng = random.Random(6)
    signs = ["you", "YOU", "idiot", "IDIOT!!", "a", "b1", "what??", "#$", "c0ld", "soooo", "Du", "7", "né", "X!"]
    texts = [" ".join(rng.choice(signs) for _ in range(rng.randint(0, 30))) for _ in range(80)]
    rates = parts(pa.array(texts)).rates
    second = set(SECOND_PERSON)
    for text, got in zip(texts, rates):
        raw = text.encode()
        words = [m.group() for m in re.finditer(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", raw.lower())]
        n, size = max(1, len(words)), max(1, len(raw))
        upper = [m.group() for m in re.finditer(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", raw)]
        want = [
            np.log1p(len(words)), np.log1p(len(raw)), sum(w.decode() in INSULTS for w in words) / n, sum(w.decode() in second for w in words) / n,
            sum(65 <= c <= 90 for c in raw) / size, sum(len(w) > 1 and all(65 <= c <= 90 for c in w) for w in upper) / n, raw.count(b"!") / size, raw.count(b"?") / size,
            sum(a == b and a in b"!?" for a, b in zip(raw, raw[1:])) / size, sum(c in b"#$%&*@^~_+=<>" for c in raw) / size, sum(48 <= c <= 57 for c in raw) / size,
        ]
        assert np.allclose(got[: len(want)], want)
        assert np.isclose(got[13], sum(len(w) == 1 for w in words) / n)


def test_texts_of_a_batch_do_not_see_each_other():
    rng = random.Random(9)
    texts = ["idiot", "you!", "hey!", "!x", "aa", "a", "ab", "0", "c", "", None, "you", "idiot you", "!", "!", "so", "oo", "é", "é"]
    signs = ["you", "idiot", "!", "oo", "0", "b", "-", "É", "1d10t", " "]
    texts += ["".join(rng.choice(signs) + rng.choice(["", " "]) for _ in range(rng.randint(0, 9))) for _ in range(300)]
    together = parts(pa.array(texts))
    known = np.unique(np.concatenate([code for code, _ in together.items]))
    full = np.full(len(known), 20.0)
    lexicon = learn_lexicon(np.arange(len(known)) % 6, known, full, full * 0, 20, 20)
    x = features(together, lexicon)
    alone = np.concatenate([features(parts(pa.array([t], pa.string())), lexicon) for t in texts])
    assert (x == alone).all()


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="needs the test tables")
def test_scores_do_not_depend_on_the_partitioning(spark):
    base = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    known = docs.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)
    score = None
    for n in (1, 3, 7):
        got = {r.doc_id: r.score for r in predict(docs.repartition(n), train(known.repartition(n), labels)).select("doc_id", "score").collect()}
        assert score is None or got == score
        score = got


def test_isotonic_is_monotone():
    rng = np.random.default_rng(0)
    x = rng.normal(size=300)
    y = (rng.random(300) < 1 / (1 + np.exp(-2 * x))).astype(float)
    knots, value = isotonic(x, y, np.ones(300))
    assert (np.diff(value) >= 0).all() and (np.diff(knots) >= 0).all()
    fitted = np.interp(x, knots, value)
    assert abs(fitted.mean() - y.mean()) < 0.02


def test_isotonic_against_min_max():
    rng = np.random.default_rng(3)
    x, y, w = np.sort(rng.normal(size=40)), rng.random(40), rng.integers(1, 4, 40).astype(float)
    mean = lambda a, b: np.average(y[a:b], weights=w[a:b])
    want = [max(min(mean(a, b) for b in range(i + 1, 41)) for a in range(i + 1)) for i in range(40)]
    knots, value = isotonic(x, y, w)
    assert np.allclose(np.interp(x, knots, value), want)


def test_trees_against_the_definition():
    rng = np.random.default_rng(5)
    x, y, w = rng.integers(0, 9, (90, 3)).astype(float), (rng.random(90) < 0.4).astype(float), rng.random(90) + 0.5
    t = Trees(rounds=3, depth=2, least=5.0).fit(x, y, w)
    p0 = np.average(y, weights=w)
    margin = np.full(90, np.log(p0 / (1 - p0)))
    for feature, cut, value in t.trees:
        p = 1 / (1 + np.exp(-margin))
        g, h = (p - y) * w, np.maximum(p * (1 - p), 1e-6) * w
        part = lambda m: g[m].sum() ** 2 / (h[m].sum() + t.ridge)  # noqa: B023, E731
        node = np.zeros(90, int)
        for level in range(2):
            for k in range((1 << level) - 1, (1 << (level + 1)) - 1):
                mine, best = node == k, 0.0
                for j in range(3):
                    for edge in t.edges[j]:
                        left = mine & (x[:, j] <= edge)
                        right = mine & ~left
                        if min(left.sum(), right.sum()) >= 5:
                            best = max(best, part(left) + part(right) - part(mine))
                chosen = mine & (t._binned(x)[:, feature[k]] > cut[k])
                rest = mine & ~chosen
                got = part(chosen) + part(rest) - part(mine) if chosen.any() and rest.any() else 0.0
                assert np.isclose(got, best)
                node[mine] = 2 * k + 1 + chosen[mine]
        for leaf in range(4):
            mine = node == 3 + leaf
            assert np.isclose(value[leaf], -t.rate * g[mine].sum() / (h[mine].sum() + t.ridge))
        margin = margin + value[node - 3]
    assert np.allclose(margin, t.margin(x))


def test_trees_fit_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    assert auc(Trees(rounds=60).fit(x, y, np.ones(2000)).margin(x), y) > 0.99


def test_labels_of_other_documents_do_not_count(spark, monkeypatch):
    from wirefold.llm import toxicity

    docs = spark.createDataFrame([(i, f"text {i}", "") for i in range(0, 300, 3)] + [(1, None, "")], SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 3 > 0 or i % 5 == 0)) for i in range(300)], "doc_id long, toxic int")
    monkeypatch.setattr(toxicity, "fit", lambda x, toxic, weight, fold, lexicon: (x, toxic, weight))
    x, toxic, weight = train(docs, labels, train_docs=30)
    assert len(x) == 30 and toxic.sum() == 15
    assert np.isclose(weight[toxic == 1].sum() / weight.sum(), 20 / 100)


def test_edges(spark):
    texts, label = corpus(300, 3)
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)] + [(1000, None, ""), (None, "x", ""), (1001, "", ""), (1001, "", "")], SCHEMA)
    labels = spark.createDataFrame([(i, int(b)) for i, b in enumerate(label)] + [(1000, 1), (None, 1), (5, None)], "doc_id long, toxic int")
    model = train(docs, labels)
    out = predict(docs, model).collect()
    assert len(out) == 304 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in out)
    assert train(docs, labels.where("toxic = 0")) is None
    assert predict(docs.limit(0), model).collect() == [] and {r.score for r in predict(docs, None).collect()} == {0.0}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="needs the test tables")
def test_held_out(spark):
    base = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{base}/documents.parquet").withColumn("held", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1)
    labels = spark.read.parquet(f"{base}/labels.parquet")
    model = train(docs.where("NOT held"), labels)
    rows = predict(docs.where("held").join(labels, "doc_id").select("doc_id", "text", "toxic"), model).select("score", "toxic").toPandas()
    assert auc(rows.score.to_numpy(), rows.toxic.to_numpy()) > 0.97


def test_sample_rounds_and_folds_are_whole():
    import inspect

    from wirefold.llm import toxicity

    assert toxicity.TRAIN_DOCS >= 16_000 and Trees().rounds >= 120 and inspect.signature(train).parameters["folds"].default >= 4
