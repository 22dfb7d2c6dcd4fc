import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from wirefold.llm.token_binary import Encoder, token_binary

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, start string"
plain, encoder = Tokenizer.from_file(PATH), Encoder(PATH)

ODD = ["", " ", "  a", "a  b ", "x \n y", "x.\ny", "it's we're I'LL", " don't", "a  b", "a  b", "\t\ta b\r\n c",
       "<|endoftext|> a <|endoftext|>, b", "été Straße, ñandú.", "日本 語。 123,456 a1b2", "a\n\nb \n\n c", "x\x1c y", "word,'s", "a... b!!! c?!", "퟿ \U0001f600 b"]


def ids(text):
    return np.array(plain.encode(text, add_special_tokens=False).ids, "<u4")


@pytest.mark.parametrize("text", ODD)
def test_pieces_match_the_tokenizer(text):
    assert np.frombuffer(encoder.encode(text), encoder.dtype).astype("<u4").tolist() == ids(text).tolist()


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="aé Z'st\n\t.,!1<|>ñ 日", max_size=40))
def test_pieces_match_on_random_texts(text):
    assert np.frombuffer(encoder.encode(text), encoder.dtype).astype("<u4").tolist() == ids(text).tolist()


def test_round_trip(spark):
    rows = [(i, t, "x") for i, t in enumerate(ODD)] + [(5, "again", "y"), (7, None, None), (None, "no id", None), (100, "long word " * 5000, None)]
    got = sorted(token_binary(spark.createDataFrame(rows, SCHEMA), PATH, 2, partitions=3).collect(), key=lambda r: r.start)
    want = sorted(rows, key=lambda r: (-1 if r[0] is None else r[0], r[1] or ""))
    assert [r.doc_id for r in got] == [r[0] for r in want]
    at = 0
    for r, (_, text, _) in zip(got, want):
        full = np.append(ids(text or ""), np.uint32(2)).astype("<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(full), zlib.crc32(full.tobytes()))
        at += len(full)


def test_empty(spark):
    assert token_binary(spark.createDataFrame([], SCHEMA), PATH, 2).collect() == []


def test_words_match_on_every_letter():
    for lead in ("", "x "):
        for code in [*range(65, 91), *range(97, 123), *range(0xAA, 0x250)]:
            for text in (lead + chr(code), lead + "ab" + chr(code) + "cd,"):
                assert np.frombuffer(encoder.encode(text), encoder.dtype).astype("<u4").tolist() == ids(text).tolist()


def test_forgotten_pieces_are_encoded_again():
    small = Encoder(PATH)
    for units in (small.first, small.rest):
        units.LIMIT = 2000
    text = " ".join(f"word{i % 37} again {'x' * (i % 9)}!\n{i}" for i in range(600))
    for _ in range(2):
        assert np.frombuffer(small.encode(text), small.dtype).astype("<u4").tolist() == ids(text).tolist()
    assert small.rest.held <= 2600 and small.rest.old


def test_tied_and_null_ids_span_partitions(spark):
    rows = [(None, f"text {i % 7} {i}", "x") for i in range(60)] + [(4, f"b{i}", "x") for i in range(60)]
    got = sorted(token_binary(spark.createDataFrame(rows, SCHEMA).repartition(5), PATH, 2, partitions=4).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None] * 60 + [4] * 60
    at = 0
    for r, text in zip(got, [*sorted(t for d, t, _ in rows if d is None), *sorted(t for d, t, _ in rows if d == 4)]):
        full = np.append(ids(text), np.uint32(2)).astype("<u4")
        assert (r.start, r.ids_crc32) == (at, zlib.crc32(full.tobytes()))
        at += len(full)


def test_ranges_read_slices(tmp_path):
    from pyarrow import fs

    from wirefold.llm.token_binary import _Ranges

    np.arange(50, dtype="<u2").tofile(tmp_path / "x")
    got = _Ranges(fs.LocalFileSystem().open_input_file(str(tmp_path / "x")), "<u2")
    assert len(got) == 50 and got[3:7].tolist() == [3, 4, 5, 6] and got[48:99].tolist() == [48, 49] and got[5:5].tolist() == [] and got[:].sum() == 1225


def test_tasks_of_other_uses_drop_the_encoders():
    from wirefold.llm import textvec
    from wirefold.llm.token_binary import KEEP, encoder_of

    same = encoder_of(PATH)
    assert list(textvec.trimmed(iter([1]), KEEP)) == [1] and encoder_of(PATH) is same  # kept from task to task
    task = textvec.trimmed(iter([1, 2]))
    next(task)  # before another operator's task works
    assert not textvec._kept and encoder_of(PATH) is not same


def test_each_distinct_piece_is_looked_up_once(monkeypatch):
    import pyarrow as pa

    from wirefold.llm import token_binary as module

    texts = [*ODD, None, "été Straße, the cat!\nThe dog; ñandú.", "", "  ", "plain words, plain words.", None]
    words = module.Words(encoder, 1000)
    for column in (pa.array(texts), pa.array(texts[::-1]), pa.array(texts[-2:]), pa.array([], pa.string())):
        found, counts = module.column_ids(encoder, column, words)
        want = [ids(t or "").tolist() for t in column.to_pylist()]
        assert counts.tolist() == [len(x) for x in want] and found.tolist() == [i for x in want for i in x]
    asked = []
    monkeypatch.setattr(module, "_piece_ids", lambda e, w, pieces, real=module._piece_ids: asked.append(len(pieces)) or real(e, w, pieces))
    monkeypatch.setattr(Encoder, "encode", None)  # no text goes piece by piece
    module.column_ids(encoder, pa.array(["the cat and the dog"] * 500), words)
    assert asked == [4]


def test_the_driver_loads_no_tokenizer(spark, monkeypatch):
    import tokenizers

    rows = [(i, f"text {i} été", "x") for i in range(9)]
    docs = spark.createDataFrame(rows, SCHEMA)
    monkeypatch.setattr(tokenizers, "Tokenizer", None)  # here; the tasks' workers have their own
    for end in (2, 70_000):  # two bytes an id, and four
        at = 0
        for r, (i, text, _) in zip(sorted(token_binary(docs, PATH, end, partitions=2).collect(), key=lambda r: r.start), rows):
            full = np.append(ids(text), np.uint32(end)).astype("<u4")
            assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, at, len(full), zlib.crc32(full.tobytes()))
            at += len(full)
