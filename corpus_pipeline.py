"""The corpus pipeline: five stages from raw documents to token files.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor
kept; its output is written as Parquet and reread as the next one's input.
All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from wirefold.llm.common import made, release, written
from wirefold.llm.decontaminate import decontaminate
from wirefold.llm.language_id import predict, train
from wirefold.llm.mixing import drawn, mix_sources
from wirefold.llm.ngram_join import near_duplicates
from wirefold.llm.token_binary import token_binary

END_ID = 2
#: Rows of an Arrow batch between Spark and Python.  Texts are long: Spark's
#: 10,000 rows would hold tens of MB, several times over, in each task.
BATCH_ROWS = 1_000
#: Bytes of text that a task of ``token_output`` encodes at once, and of a generation
#: of remembered pieces: less than ``token_binary``'s own, as the executors come here
#: with their heaps grown by the stages before.
TOKEN_BATCH, TOKEN_MEMORY = 1 << 19, 8 << 20


def _small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the character models accept."""
    _small_batches(spark)
    return predict(docs, train(docs)).where("NOT rejected").select(*docs.columns)


def near_duplicate_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    _small_batches(spark)
    return near_duplicates(docs).where("kept").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    _small_batches(spark)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate(docs, benchmark).where("NOT contaminated").select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn to the sources' target weights, a row for each copy."""
    _small_batches(spark)
    return drawn(mix_sources(docs)).select(*docs.columns)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in ascending doc_id order, read back document by document."""
    _small_batches(spark)
    return token_binary(docs, public_tokenizers.path("byte_bpe_50k.json"), END_ID, batch_bytes=TOKEN_BATCH, memory=TOKEN_MEMORY)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicate_removal),
    ("decontamination", decontamination),
    ("source_mix", source_mix),
    ("token_output", token_output),
]

#: Trained models and similarity search have no SQL form; tests/llm/test_pipeline.py
#: holds the result against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the whole table ``documents``."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), made()
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        release(spark, since=before, keep=1)  # all but this stage's output
    return STAGES[-1][1](spark, docs, sf_dir)
