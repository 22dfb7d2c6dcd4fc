import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from wirefold.llm import registry, repeat_index
from wirefold.llm.repeat_index import remove_repeats, repeated_words

SCHEMA = "doc_id long, text string, n_bytes string, pos string"


def brute(texts, window):
    raws = [(t or "").encode() for t in texts]
    count = Counter(r[i : i + window] for r in raws for i in range(len(r) - window + 1))
    out = []
    for r in raws:
        gone = [False] * len(r)
        for i in range(len(r) - window + 1):
            if count[r[i : i + window]] > 1:
                gone[i : i + window] = [True] * window
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(b for b, g in zip(r, gone) if not g)
        out.append((len(r), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def made_texts(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passages = [prose(rng.randint(8, 60)) for _ in range(4)]
    texts = []
    for _ in range(40):
        parts = [prose(rng.randint(0, 30))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randint(0, len(p) // 3)
            parts += [p[a : len(p) - rng.randint(0, len(p) // 3)], prose(rng.randint(0, 12))]
        texts.append(rng.choice(["", " "]).join(parts))
    texts += [texts[3]] * 5 + [texts[7] + " x"] + ["", None, "short", "a" * 300, "ab" * 120, "xyz " * 90, "a" * 61, "é" * 100]
    return texts


@pytest.mark.parametrize(("seed", "limit"), [(1, 40_000), (2, 40_000), (3, 3), (4, 2)])
def test_against_brute_force(spark, seed, limit):
    texts = made_texts(seed)
    frame = spark.createDataFrame([(i, t, "clash", "kept") for i, t in enumerate(texts)], SCHEMA).repartition(3)
    got = {r.doc_id: r for r in remove_repeats(frame, window=60, gram=8, limit=limit).collect()}
    want = brute(texts, 60)
    assert len(got) == len(texts)
    for i, w in enumerate(want):
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == w, (i, texts[i])
        assert r.pos == "kept"


def test_empty_and_repeated_rows(spark):
    assert remove_repeats(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(1, "word " * 200, "", "")] * 3 + [(None, None, None, None)]
    got = remove_repeats(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(r.n_removed for r in got) == [0, 1000, 1000, 1000]


def test_anchors_beyond_the_position_bits(monkeypatch):
    """Texts longer than ``_POS`` (here 10 bits) keep their anchors."""
    texts = [(t or "").encode() for t in made_texts(5)]
    texts.insert(20, b" ".join(texts))
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.cumsum([0, *map(len, texts)])
    whole = repeat_index.anchors(data, offsets, 60, 8)
    monkeypatch.setattr(repeat_index, "_POS", np.uint64((1 << 10) - 1))
    for block in (1, 7, 900):
        monkeypatch.setattr(repeat_index, "BLOCK", block, raising=False)
        for got, want in zip(repeat_index.anchors(data, offsets, 60, 8), whole):
            assert got.tolist() == want.tolist()
    at, row, _ = whole
    for i, text in enumerate(texts):
        inside = at[row == i] - offsets[i]
        starts = np.arange(len(text) - 60 + 1)
        assert (np.searchsorted(inside, starts + 60 - 8, side="right") > np.searchsorted(inside, starts)).all()


def brute_words(texts, passage):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    count = Counter(tuple(w[i : i + passage]) for w in words for i in range(len(w) - passage + 1))
    out = []
    for w in words:
        hit = [i for i in range(len(w) - passage + 1) if count[tuple(w[i : i + passage])] > 1]
        out.append(len({j for i in hit for j in range(i, i + passage)}))
    return out


@pytest.mark.parametrize(("seed", "limit"), [(1, 40_000), (3, 3)])
def test_repeated_words_against_brute_force(spark, seed, limit):
    texts = [*made_texts(seed), "a b " * 20, "x\n" * 9 + " y z", "x " * 8]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    k0, k1 = repeat_index._keys()
    found = {(r.k0, r.k1): r.n_repeat_words for r in repeated_words(frame, passage=9, gram=8, limit=limit).collect()}
    got = {r.doc_id: found.get((r.k0, r.k1), 0) for r in frame.select("doc_id", k0.alias("k0"), k1.alias("k1")).collect()}
    assert [got[i] for i in range(len(texts))] == brute_words(texts, 9)


def test_short_passage_of_many_words(spark, tmp_path):
    """52 words in under 400 bytes lose nothing, but are counted, repeated rows and nulls included."""
    rng = random.Random(7)
    prose = lambda n: " ".join("".join(rng.choices("abcdefgh", k=rng.randint(3, 6))) for _ in range(n))
    passage = prose(52)
    assert len(passage) < 400
    texts = [f"{prose(90)} {passage} {prose(80)}", f"{passage}\n{prose(100)}", prose(200), None, "", prose(50)]
    rows = [*enumerate(texts), (6, texts[5]), (None, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in registry.op10_repeat_index(spark, str(tmp_path)).collect()}
    assert {i: r.n_repeat_words for i, r in got.items()} == {0: 52, 1: 52, 2: 0, 3: 0, 4: 0, 5: 0, 6: 0, None: 0}
    assert [got[i].n_removed for i in range(7)] == [0] * 7
    assert got[0].n_bytes == len(texts[0])
