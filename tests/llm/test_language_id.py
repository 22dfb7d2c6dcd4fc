import os
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wirefold.llm import language_id
from wirefold.llm.language_id import BORDER, GAP, ORDER, UNKNOWN, coded, grams_of, predict, symbols, train
from wirefold.llm.textvec import view

SCHEMA = "doc_id long, text string, lang string, score string"
TEXTS = {
    "en": ["the cat and the dog", "this is the house that they have", "a man with the other one", "there is nothing more than that"],
    "de": ["der hund und die katze", "das ist ein haus mit garten", "ich habe nicht die zeit", "schöne grüße aus der stadt"],
    "zh": ["這是一個很好的日子", "我們 沒有時間", "𠀀𠀁 日子 😀 時間"],
}


def of(text):
    """The 5-grams of a text as strings, straight from the definition."""
    out = [chr(BORDER)]
    for c in text:
        if c.isalpha():
            out.append(c.lower()[0])
        elif out[-1] not in (chr(GAP), chr(BORDER)):
            out.append(chr(GAP))
    return ["".join([chr(BORDER)] * max(0, ORDER - 1 - i) + out[max(0, i - ORDER + 1) : i + 1]) for i in range(1, len(out))]


def codes(text):
    return coded(*symbols(*view(pa.array([text], pa.large_string()))))


def brute(texts):
    """Interpolated Kneser-Ney over strings of symbols, straight from its formula."""
    counts = {ORDER: Counter(g for t in texts for g in of(t))}
    for n in range(ORDER - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    discount = {}
    for n, c in counts.items():
        ones, twos = (sum(v == x for v in c.values()) for x in (1, 2))
        discount[n] = min(0.95, max(0.1, ones / max(1, ones + 2 * twos)))
    total, kinds = {n: Counter() for n in counts}, {n: Counter() for n in counts}
    for n, c in counts.items():
        for g, v in c.items():
            total[n][g[:-1]] += v
            kinds[n][g[:-1]] += 1
    return counts, discount, total, kinds


def prob(parts, gram, vocabulary):
    counts, discount, total, kinds = parts
    n = len(gram)
    if n == 0:
        return 1 / vocabulary
    below = prob(parts, gram[1:], vocabulary)
    if not total[n][gram[:-1]]:
        return below
    here = max(counts[n][gram] - discount[n], 0) / total[n][gram[:-1]]
    return here + discount[n] * kinds[n][gram[:-1]] / total[n][gram[:-1]] * below


@pytest.mark.parametrize("cells", [1 << 21, 64])
def test_model_against_formula(spark, monkeypatch, cells):
    monkeypatch.setattr(language_id, "PART_CELLS", cells)
    docs = spark.createDataFrame([(i, t, name, "") for name, ts in TEXTS.items() for i, t in enumerate(ts)] + [(9, "...", "zz", "")], SCHEMA)
    model = train(docs)
    assert model.langs == sorted([*TEXTS, "zz"]) and (len(model.sizes) > 1) == (cells == 64)
    parts = {name: brute(ts) for name, ts in TEXTS.items()}
    # Every n-gram, and every ending and context of one, is in the model.
    union = {ORDER: {g for p in parts.values() for g in p[0][ORDER]}}
    for n in range(ORDER - 1, 0, -1):
        union[n] = {g[1:] for g in union[n + 1]} | {g[:-1] for g in union[n + 1]}
    assert sum(model.sizes.values()) == sum(map(len, union.values())) and model.vocabulary == len(union[1]) + 1
    for n, grams in union.items():
        assert model.look(grams_of(pa.array(sorted(grams)), n))[0].all()
    for text in ("the garden of katze", "zzz unseen ñ", TEXTS["de"][0], "日本の日子 𠀁", "K"):
        want = [[prob(parts[name], g, model.vocabulary) if name in parts else 1 / model.vocabulary for name in model.langs] for g in of(text)]
        assert np.allclose(np.exp(model.score(codes(text))), want, rtol=2e-3)


def test_hashes_of_strings_and_texts_agree():
    for text in ("The Cat, and 日本 ñ𠀁", "a", "... b"):
        got = codes(text)
        for n in range(1, ORDER + 1):
            assert (got.ends[n] == grams_of(pa.array([g[-n:] for g in of(text)]), n)).all()


def test_many_singletons_stay(spark):
    # Neither language has a count above 1 that could stand for the rest.
    letters = [chr(c) for c in range(0x4E00, 0x4E00 + 20_000)]
    texts = {"xa": "".join(letters[i * 7 % 20_000] for i in range(102_000)), "xb": "".join(letters[i * 11 % 20_000] for i in range(3_000))}
    texts["xa"] = "".join(c + chr(0x61 + i // 4_000) for i, c in enumerate(texts["xa"]))
    keys = {name: np.unique(codes(t).ends[ORDER], return_counts=True) for name, t in texts.items()}
    assert np.sum(keys["xa"][1] == 1) > 100_000
    model = train(spark.createDataFrame([(i, t, name, "") for i, (name, t) in enumerate(texts.items())], SCHEMA))
    assert model.look(keys["xa"][0])[0].all() and model.look(keys["xb"][0])[0].all()
    part = spark.createDataFrame([(1, texts["xa"][5000:5400], "", ""), (2, texts["xb"][500:900], "", "")], SCHEMA)
    assert [r.lang_pred for r in predict(part, model).orderBy("doc_id").collect()] == ["xa", "xb"]


def test_ties_go_to_the_first_language(spark):
    rows = [(i, t, name, "") for name in ("yb", "ya") for i, t in enumerate(TEXTS["en"])]
    model = train(spark.createDataFrame(rows, SCHEMA))
    got = predict(spark.createDataFrame([(1, "the house", None, "")], SCHEMA), model).first()
    assert got.lang_pred == "ya" and 0 <= got.score <= 0.6


def test_partitioning_does_not_matter(spark):
    docs = spark.createDataFrame([(i, f"{t} {chr(97 + i % 26)}{t[::-1]}", name, "") for name, ts in TEXTS.items() for i, t in enumerate(ts * 20)], SCHEMA)
    seen = {tuple((r.doc_id, r.lang_pred, r.score, r.rejected) for r in predict(docs, train(docs.repartition(n))).orderBy("doc_id", "text").collect()) for n in (1, 3, 7)}
    assert len(seen) == 1


def test_calibration_sample(spark):
    # One language at the table's end, a hot copied text, and one long text.
    rows = [(i, f"the dog {i} and {chr(97 + i % 26)}{chr(97 + i // 26)} cat", "en", "") for i in range(200)]
    rows += [(0, "the same words again", "en", "")] * 300 + [(1, "katze und hund " * 2000, "de", ""), (2, "die katze", "de", "")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(7)
    texts = docs.select("text", "lang")
    model = train(docs, calibration_docs=20)
    lang, entropy, count, weight = language_id._sample(model, texts, 20)
    assert Counter(lang.tolist()) == {0: 2, 1: 20} and count.max() > 20_000
    hashes = {(r.h & ((1 << 30) - 1), r.h): r.text for r in texts.where("lang = 'en'").select("text", F.xxhash64("text").alias("h")).collect()}
    want = [hashes[h] for h in sorted(hashes)[:20]]
    got = model.entropies(*view(pa.array(want, pa.large_string())))
    assert np.allclose(entropy[lang == 1], got[0], atol=1e-6) and np.array_equal(count[lang == 1], got[1])
    again = language_id._sample(model, texts.orderBy("lang", "text"), 20)
    assert np.allclose(again[1], entropy)


def test_edges(spark):
    rows = [(i, t, name, "clash") for i, (name, ts) in enumerate(TEXTS.items()) for t in ts] + [(9, "no label", None, ""), (10, None, "en", "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    model = train(docs)
    odd = [(1, None, None, ""), (2, "", None, ""), (3, "123 !?", None, ""), (4, "the house and the man", None, ""), (5, "die katze und der garten " * 3000, None, ""), (4, "the house and the man", None, ""), (6, "x", None, "")]
    out = sorted((r.doc_id, r.lang_pred, r.rejected, r.score) for r in predict(spark.createDataFrame(odd, SCHEMA), model).collect())
    assert [(d, p) for d, p, _, _ in out] == [(1, UNKNOWN), (2, UNKNOWN), (3, UNKNOWN), (4, "en"), (4, "en"), (5, "de"), (6, out[-1][1])]
    assert out[-1][1] in TEXTS and all(r for _, p, r, _ in out if p == UNKNOWN) and all(0 <= s <= 1 for *_, s in out)
    none = docs.limit(0)
    assert train(none) is None and predict(none, model).collect() == []
    # Nothing to learn from: texts with letters stay.
    assert {(r.lang_pred, r.rejected) for r in predict(docs.where("text IS NOT NULL"), None).collect()} == {(UNKNOWN, False)}
    assert {r.rejected for r in predict(spark.createDataFrame(odd[:3], SCHEMA), None).collect()} == {True}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="needs the test tables")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("held", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2)
    model = train(docs.where("NOT held"))
    got = predict(docs.where("held"), model)
    row = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("right"), F.avg(F.col("rejected").cast("int")).alias("out"), F.avg("score").alias("score")).first()
    assert row.right > 0.97 and row.out < 0.02 and row.score > 0.9


def test_remembered_scores_are_the_models(spark, monkeypatch):
    docs = spark.createDataFrame([(i, t, name, "") for name, ts in TEXTS.items() for i, t in enumerate(ts)], SCHEMA)
    model = train(docs)
    texts = ["", "...", "the garden of katze", "a", "zzz unseen ñ", "日本の日子 𠀁", "", "the garden of katze"] * 3
    want = [(-model.score(codes(t)).sum(0, dtype=np.float64) / max(1, len(of(t))), len(of(t)) if any(map(str.isalpha, t)) else 0) for t in texts]
    column = view(pa.array(texts, pa.large_string()))
    for step, cells in ((1 << 16, 1 << 20), (7, 1)):  # in one go; in bits, with a few slots that collide
        monkeypatch.setattr(language_id, "STEP", step)
        monkeypatch.setattr(language_id, "MEMO_CELLS", cells)
        model.forget()
        entropy, count = model.entropies(*column)
        assert count.tolist() == [n for _, n in want]
        assert np.allclose(entropy[count > 0], [e for e, n in want if n], rtol=1e-6)
    monkeypatch.undo()
    model.forget()
    entropy, count = model.entropies(*column)
    monkeypatch.setattr(model, "look", None)  # the second time the model's files are not asked
    assert (model.entropies(*column)[0] == entropy)[count > 0].all()


@pytest.mark.parametrize(("limit", "bits"), [(1 << 18, 12), (40, 12), (1 << 18, 6), (40, 3)])
def test_tally_counts_every_gram(monkeypatch, limit, bits):
    monkeypatch.setattr(language_id, "NUMBER_BITS", bits)
    tally, got, want, sent = language_id.Tally(limit), Counter(), Counter(), 0
    batches = [["the cat and the dog", "der hund, die katze"], ["", "..."], ["這是一個很好的日子"], ["the cat and the dog", "schöne grüße"], ["𠀀𠀁 日子 😀 時間 a"]] * 2
    for texts in [*batches, None]:
        if texts is None:
            found = tally.flush()
        else:
            lang = np.arange(len(texts))
            want.update((i, g) for i, t in enumerate(texts) for g in of(t))
            found = tally.add(lang, *symbols(*view(pa.array(texts, pa.large_string()))))
        for i, window, number in found:
            sent += len(number)
            for row, n in zip(window.tolist(), number.tolist()):
                got[i, "".join(map(chr, row))] += n
    assert got == want
    if limit > 40 and bits == 12:  # a task gives each n-gram once, not once a batch
        assert sent == len(want)
