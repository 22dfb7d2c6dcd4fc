import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from wirefold.llm import packing
from wirefold.llm.packing import Windows, cuts_of, pack, packed, sentence_ids
from wirefold.llm.token_binary import Encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, start string, offset string"
plain, encoder = Tokenizer.from_file(PATH), Encoder(PATH)


def least(cuts, penalties, width):
    at, cost = [0, *cuts], [0] + [10**9] * len(cuts)
    for j in range(1, len(at)):
        for i in range(j):
            n = at[j] - at[i]
            if n <= width:
                cost[j] = min(cost[j], cost[i] + (0 if n & (n - 1) == 0 else width - n) + penalties[j - 1] + packing.WINDOW)
    return cost[-1]


def cost_of(ends, cuts, penalties, width):
    penalty, at, total = dict(zip(cuts, penalties)), 0, 0
    for end in ends:
        n = end - at
        assert 0 < n <= width
        total, at = total + (0 if n & (n - 1) == 0 else width - n) + penalty[end] + packing.WINDOW, end
    return total


def stream(rng, width, n):
    cuts, penalties, last = [], [], 0
    while last < n:
        last += rng.randint(1, rng.choice([2, 5, width]))
        cuts.append(last)
        penalties.append(rng.choice([0, 4, 64]))
    return cuts, penalties


def fed(cuts, penalties, width, rng):
    windows, ends, i = Windows(width), [], 0
    while i < len(cuts):
        k = rng.randint(1, 60)
        windows.add(cuts[i : i + k], penalties[i : i + k])
        i += k
        if i < len(cuts):
            ends += windows.settled()
    return ends + windows.settled(end=True)


def test_least_cost_however_the_stream_is_cut():
    rng = random.Random(2)
    for _ in range(400):
        width = rng.choice([8, 16, 32, 64])
        cuts, penalties = stream(rng, width, rng.randint(1, 300))
        ends = fed(cuts, penalties, width, rng)
        assert ends[-1] == cuts[-1]
        assert cost_of(ends, cuts, penalties, width) == least(cuts, penalties, width)


def test_settled_after_the_horizon(monkeypatch):
    monkeypatch.setattr(packing, "HORIZON", 128)
    rng = random.Random(3)
    for _ in range(100):
        cuts = list(range(1, rng.randint(400, 900)))  # documents of one token: chains that never meet
        ends = fed(cuts, [0] * len(cuts), 16, rng)
        best = least(cuts, [0] * len(cuts), 16)
        assert best <= cost_of(ends, cuts, [0] * len(cuts), 16) <= best * 1.5


def test_long_sentences_may_be_cut_inside():
    cuts, penalties = cuts_of(100, [10, 10 + 5000, 5011, 5011, 5011 + packing.LONG])
    inside = list(range(110 + packing.SPACING, 5110, packing.SPACING))
    assert cuts == [110, *inside, 5110, 5111, 5111 + packing.LONG]
    assert penalties == [packing.SENTENCE, *[packing.INSIDE] * len(inside), packing.SENTENCE, packing.SENTENCE, packing.DOCUMENT]


ODD = ["a. b! c? d", "It is. ", ". . .", "  a.  b", "x.\ty. z", "one.two. three", "a\x1c. b c  d. e", "e. <|endoftext|> f", "日本。 x. y", "no end"]


@pytest.mark.parametrize("text", ODD)
def test_sentences(text):
    ids, ends = sentence_ids(encoder, text)
    found = plain.encode(text, add_special_tokens=False)
    assert np.frombuffer(ids, encoder.dtype).tolist() == found.ids
    assert ends[-1] == len(found.ids) and ends == sorted(ends)
    cut = packing._SENTENCE.findall(text)
    assert len(ends) == len(cut) + 1
    encoder.by_piece = False  # the same by character offsets
    try:
        assert sentence_ids(encoder, text) == (ids, ends)
    finally:
        encoder.by_piece = True


def test_batches_equal_single_texts():
    import pyarrow as pa

    texts = [*ODD, "", None, "a", "a. a. a", " x", "x ", "Is it. Is it! Is", *(ODD * 3)]
    for limit in (1, 300, 1 << 20):
        words = packing.Words(encoder, limit)
        for _ in range(2):
            assert list(packing.batch_ids(encoder, pa.array(texts), words)) == [sentence_ids(encoder, t) if t else (b"", [0]) for t in texts]
    assert list(packing.batch_ids(encoder, pa.array([], pa.string()), words)) == []


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(alphabet="aé Z'st\n\t.,!1<|>ñ 日", max_size=40), max_size=4))
def test_batches_of_random_texts(texts):
    import pyarrow as pa

    got = list(packing.batch_ids(encoder, pa.array(texts, pa.string()), packing.Words(encoder, 1000)))
    for text, (ids, ends) in zip(texts, got):
        assert np.frombuffer(ids, encoder.dtype).tolist() == plain.encode(text, add_special_tokens=False).ids
        assert (ids, ends) == (sentence_ids(encoder, text) if text else (b"", [0]))


def check(rows, out, width):
    """Exact cover of every document, gapless sequences, order; returns the share of padding."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in out:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    want = defaultdict(list)
    for doc_id, text, *_ in rows:
        want[doc_id].append([*plain.encode(text or "", add_special_tokens=False).ids, 1])
    for doc_id, texts in want.items():
        pieces = sorted(by_doc.pop(doc_id), key=lambda r: (r.sequence_id, r.offset))
        sums = []
        while pieces:  # repeated ids: one document after another
            n, at = pieces[0].doc_tokens, 0
            while at < n:
                r = pieces.pop(0)
                assert (r.start, r.doc_tokens) == (at, n) and r.length > 0
                sums.append((n, at, r.length, r.ids_crc32))
                at += r.length
            assert at == n
        texts = sorted(texts, key=len)
        for n in {len(t) for t in texts}:
            cuts = [s for s in sums if s[0] == n]
            alike = [t for t in texts if len(t) == n]
            for _, at, length, crc in cuts:
                assert any(zlib.crc32(np.array(t[at : at + length], "<u4").tobytes()) == crc for t in alike)
            assert sum(s[2] for s in cuts) == n * len(alike)
    assert not by_doc
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    padding = total = 0
    for number in range(len(by_sequence)):
        at = 0
        for r in sorted(by_sequence[number], key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= width
        total += at
        padding += 0 if at & (at - 1) == 0 else width - at
    order = [-1 if r.doc_id is None else r.doc_id for r in sorted(out, key=lambda r: (r.sequence_id, r.offset))]
    assert order == sorted(order)
    return padding / max(1, total)


def test_documents(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("aeionrst") for _ in range(rng.randint(1, 9)))
    prose = lambda n: " ".join(word() + rng.choice(["", "", "", ".", "?"]) for _ in range(n))
    rows = [(i, prose(rng.choice([1, 40, 300, 1500])), "x", "y") for i in range(120)]
    rows += [(500 + i, t, None, None) for i, t in enumerate([*ODD, "", None, "long " * 9000])]
    rows += [(7, "again", "x", "y"), (7, "again", "x", "y"), (None, "no id. None", None, None), (None, None, None, None)]
    out = pack(spark.createDataFrame(rows, SCHEMA).repartition(5), PATH, 1, partitions=3).collect()
    assert check(rows, out, 2048) < 0.01


def test_many_empty_texts_and_empty_table(spark):
    rows = [(i, None, None, None) for i in range(5000)]
    out = pack(spark.createDataFrame(rows, SCHEMA), PATH, 1, partitions=2).collect()
    assert check(rows, out, 2048) < 0.001
    assert pack(spark.createDataFrame([], SCHEMA), PATH, 1).collect() == []


def test_wide_end_id():
    got = list(packed(iter([(1, np.array([5, 70_000], "<u4").tobytes(), [2])]), np.dtype("<u4"), 2048))
    assert got == [(1, 0, 2, zlib.crc32(np.array([5, 70_000], "<u4").tobytes()), 2, 0, 0)]
