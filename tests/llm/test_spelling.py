import random
import re
from collections import Counter

import pytest

from wirefold.llm.spelling import occurrences, spelling_variants, vocabulary

SCHEMA = "doc_id long, text string, word string, n int"


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) < len(b):
        a, b = b, a
    return any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def brute(words, min_length, min_count, ratio):
    count = Counter(w for w in words if w is not None and len(w) >= min_length)
    count = {w: n for w, n in count.items() if n >= min_count}
    out, forms = {}, {}
    for w, n in count.items():
        found = [v for v in count if near(w, v)]
        best = min(found, key=lambda v: (-count[v], v), default=None)
        forms[w] = best if best is not None and count[best] >= ratio * n else None
        out[w] = [n, len(found)]
    rows = []
    for w, (n, number) in out.items():
        root = w
        while forms[root]:
            root = forms[root]
        rows.append((w, n, number, forms[w], count[forms[w]] if forms[w] else None, root))
    return sorted(rows)


def made(seed):
    rng = random.Random(seed)
    words = []
    for _ in range(60):
        w = "".join(rng.choice("abcé") for _ in range(rng.randint(2, 7)))
        for _ in range(rng.randint(1, 4)):
            words += [w] * rng.randint(1, 40)
            i = rng.randrange(len(w))
            w = rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("abÿ") + w[i:], w[:i] + rng.choice("abc") + w[i + 1 :]]) or "a"
    # A chain of forms, a tie, doubled letters.
    for i in range(7):
        words += ["abcdefgh"[: 8 - i] + "z" * i] * (3 << i)
    return words + ["aabbcc"] * 8 + ["abbcc"] * 4 + ["aabcc"] * 4 + [None, ""]


@pytest.mark.parametrize("seed, least, count, ratio", [(1, 5, 3, 2), (2, 1, 1, 2), (3, 3, 2, 3)])
def test_brute_force(spark, seed, least, count, ratio):
    words = made(seed)
    frame = spark.createDataFrame([(w, i) for i, w in enumerate(words)], "word string, n int").repartition(3)
    got = spelling_variants(frame, least, count, ratio).select("word", "n", "n_near", "form", "form_n", "root").collect()
    assert sorted(map(tuple, got)) == brute(words, least, count, ratio)


def test_occurrences(spark):
    texts = ["Ärger ärger ABC-def a1b", "", None, "日本 x×y ÿĀ", "z" * 70_000]
    rows = [(i, t, "w", 1) for i, t in enumerate(texts)] + [(None, "Null Id", None, None), (0, texts[0], None, None)]
    got = sorted((r.run for r in occurrences(spark.createDataFrame(rows, SCHEMA)).collect()))
    lower = lambda w: re.sub("[A-Z]", lambda m: m[0].lower(), w)
    assert got == sorted(lower(w) for _, t, _, _ in rows for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""))


def test_hot_word_and_empty(spark):
    words = spark.range(60_000).selectExpr("if(id % 3 = 0, 'common', concat('word', lpad(conv(id % 20000, 10, 26), 4, 'q'))) AS word")
    out = spelling_variants(words)
    assert out.where("word = 'common'").first().n == 20_000
    assert out.count() == vocabulary(words).count()
    empty = spark.createDataFrame([], "word string")
    assert spelling_variants(empty).collect() == []
    with pytest.raises(ValueError):
        spelling_variants(empty, ratio=1)
