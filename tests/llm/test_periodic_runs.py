import hashlib
import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wirefold.llm.periodic_runs import batch_runs, least_overlap, periodic_runs
from wirefold.llm.word_queries import repeated_tail

SCHEMA = "doc_id long, text string, start string, runs int"


def brute(words, min_length=6, min_exponent=4):
    """Maximal stretches of equal words q apart, the smallest q of each."""
    n, found = len(words), {}
    for q in range(1, n // min_exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(min_length, min_exponent * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, e, q) for (s, e), q in found.items())


def made(rng):
    words = []
    while rng.random() < 0.85 and len(words) < 120:
        block = [b"abc"[x : x + 1] for x in (rng.randrange(rng.choice([1, 2, 3])) for _ in range(rng.randint(1, 9)))]
        words += (block * rng.randint(1, 7))[: rng.randint(1, 60)]
    return words


@pytest.mark.parametrize("min_length, min_exponent", [(6, 4), (1, 3), (12, 5), (3, 4)])
def test_runs_by_definition(min_length, min_exponent):
    rng = random.Random(min_length)
    for _ in range(300):
        texts = [made(rng) for _ in range(rng.randint(1, 5))]
        rows, offsets = batch_runs(texts, min_length, min_exponent)
        want = [(s + offsets[i], e + offsets[i], q) for i, w in enumerate(texts) for s, e, q in brute(w, min_length, min_exponent)]
        assert sorted(map(tuple, rows.tolist())) == sorted(want)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=60), max_size=4))
def test_runs_of_random_words(texts):
    rows, offsets = batch_runs(texts, 6, 4)
    assert sorted(map(tuple, rows.tolist())) == sorted((s + offsets[i], e + offsets[i], q) for i, w in enumerate(texts) for s, e, q in brute(w))


def test_overlap():
    assert least_overlap(6, 4) == 5
    assert least_overlap(100, 4) == 75


def test_long_text_of_one_word():
    rows, _ = batch_runs([[b"a"] * 60_000], 6, 4)
    assert rows.tolist() == [[0, 60_000, 1]]


def test_documents(spark):
    rng = random.Random(5)
    texts = [" ".join(w.decode() for w in made(rng)) for _ in range(200)]
    texts += ["", None, " \t\n", "x " * 6, "x " * 5, "é a " * 9, "a\x1cb " * 8, "a b\n" * 3 + "a", "q" * 5000, "z " * 20_000]
    rows = [(i, t, "s", 1) for i, t in enumerate(texts)] + [(3, texts[3], "t", 2), (None, "u " * 8, None, None)]
    out = periodic_runs(spark.createDataFrame(rows, SCHEMA).repartition(3), rewrite=repeated_tail, texts=True).collect()
    assert len(out) == len(rows)

    def wanted(doc_id, text):
        words = (text or "").encode().split()
        h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
        if h % 10 == 0 and words:
            n, g = len(words), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs = sorted(((s, e - s, q) for s, e, q in brute(words) if len(words) < 1000), key=lambda r: (r[0], r[2]))
        if len(words) >= 1000:
            runs = [(0, len(words), 1)]
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        kept = " ".join(w.decode() for i, w in enumerate(words) if i not in gone)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest(), runs, kept)

    got = [(*r[:8], [tuple(x) for x in r.runs], r.collapsed) for r in out]
    assert sorted(got, key=repr) == sorted((wanted(i, t) for i, t, _, _ in rows), key=repr)


def test_empty(spark):
    assert periodic_runs(spark.createDataFrame([], SCHEMA)).collect() == []
    with pytest.raises(ValueError):
        periodic_runs(spark.createDataFrame([], SCHEMA), min_exponent=2)
