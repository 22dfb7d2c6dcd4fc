import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_mixing import targets
from tests.llm.test_ngram_join import brute as near_brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(seed=4):
    rng = random.Random(seed)
    en = "the of and house water people there which about their would these other".split()
    de = "der die und haus wasser leute nicht welche über ihre würde diese andere".split()
    prose = lambda w, n: " ".join(rng.choice(w) + rng.choice(["", "", "s", "en"]) for _ in range(n))
    rows = []
    for i in range(160):
        lang = rng.choice(["en", "de"])
        rows.append([prose(en if lang == "en" else de, rng.randint(60, 120)), lang, f"s{i % 3}" if i % 9 else None])
    items = [prose(en, 30) for _ in range(3)]
    for i in range(12):
        rows.append([rows[i][0] + (" end" if i % 2 else ""), rows[i][1], "s0"])
    leaks = []
    for i in range(6):
        leaks.append(len(rows))
        rows.append([prose(en, 20) + " " + items[i % 3] + " " + prose(en, 20), "en", "s1"])
    rejected = []
    for text in (None, "", "12345 !!", "..."):
        rejected.append(len(rows))
        rows.append([text, "en", "s2"])
    return [(i, *r, len(r[0] or "")) for i, r in enumerate(rows)], items, set(rejected), set(leaks)


def test_against_brute_force(spark, tmp_path):
    rows, items, rejected, leaks = corpus()
    folder = str(tmp_path / "sf")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    got = corpus_pipeline.run(spark, folder).collect()
    kept = [(r[0], r[1]) for r in rows if r[0] not in rejected]
    heads = {c for _, c, _ in near_brute(kept)}
    clean = {d for d in heads if d not in leaks}
    numbers = Counter(r.doc_id for r in got)
    by = {r[0]: r for r in rows}
    assert set(numbers) <= clean and max(numbers.values()) <= 3
    size = {d: len(re.findall(r"[^\x20\x09-\x0D]+", by[d][1])) for d in clean}
    sources, taken = Counter(), Counter()
    for d in clean:
        sources[by[d][3]] += size[d]
        taken[by[d][3]] += size[d] * numbers[d]
    for source, want in targets(sources).items():
        assert abs(taken[source] - want) <= 120
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        ids = np.array([*plain.encode(by[r.doc_id][1], add_special_tokens=False).ids, 2], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert [r.doc_id for r in sorted(got, key=lambda r: r.start)] == sorted(r.doc_id for r in got)


def test_stages_return_document_columns(spark, tmp_path):
    rows, items, *_ = corpus(5)
    folder = str(tmp_path / "sf")
    docs = spark.createDataFrame(rows, SCHEMA)
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns


def test_token_output_encodes_and_remembers_little_at_a_time(spark, monkeypatch):
    import pyarrow as pa
    import pyspark

    from wirefold.llm import textvec, token_binary

    class Collected(list):
        collect = lambda self: list(self)

    texts = [" ".join(f"word{(i * 977 + j) % 60000:x}" for j in range(2000)) for i in range(240)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(240)), pa.array(texts)], ["doc_id", "text"])
    sizes, tasks, real = [], [], token_binary.column_ids
    monkeypatch.setattr(token_binary, "column_ids", lambda e, column, w: sizes.append((column.nbytes, e, w)) or real(e, column, w))
    monkeypatch.setattr(token_binary, "mapped", lambda rows, step, schema, keep: tasks.append(step) or Collected())
    monkeypatch.setattr(token_binary, "read_tokens", lambda *a: None)
    monkeypatch.setattr(pyspark.TaskContext, "get", staticmethod(lambda: type("Task", (), {"partitionId": lambda self: 0})()))
    corpus_pipeline.token_output(spark, spark.createDataFrame([(0, "a")], "doc_id long, text string"), "")
    try:
        (made,) = tasks[0](iter([batch]))
        assert made["docs"].to_pylist() == [240] and made["ids"].to_pylist() == [240 + sum(len(e) for e in Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode_batch(texts, add_special_tokens=False))]
        assert sum(n for n, *_ in sizes) >= 4_000_000 and max(n for n, *_ in sizes) <= 600_000
        _, encoder, words = sizes[-1]
        held = [words, encoder.first, encoder.rest]
        assert any(x.old for x in held)  # more came than a generation holds
        assert all(x.held <= 9 << 20 for x in held)
    finally:
        textvec._kept.clear()
