"""Corpus pipeline: language ID, near-duplicates, benchmark decontamination, personal data, packing.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that its predecessor kept; its result is written
as Parquet to the shared folder and read again as the next one's docs.  All but the last return the
columns of ``documents``; the last returns pieces with their places in sequences.

Rows are decided on one by one, so repeated rows, null ids, null texts and further columns are fine;
an empty table passes through.  ``ORACLE_SQL`` is None: SQL expresses neither the networks nor the
tokenizer; ``tests/llm/test_pipeline.py`` holds every stage against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantfold.llm import langid, packing, pii, simhash, tiling
from quantfold.llm.common import read, scratch
from quantfold.llm.queries import tokenizer_path

ORACLE_SQL = None

#: A text whose best language has a smaller share than this is in none of the learned languages.
LEAST_LANGUAGE_SCORE = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter or text, and those that are in no learned language."""
    model = langid.train(langid.labelled_sample(docs))
    return langid.accepted(docs, model, LEAST_LANGUAGE_SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each group of near-duplicates."""
    return simhash.first_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes documents that hold a benchmark item."""
    return tiling.clean(docs, read(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks personal data in the texts; every document stays."""
    return pii.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences of at most 2048 tokens."""
    return packing.pack(docs, tokenizer_path(), digests=True)


STAGES = [("language_id", language), ("simhash_near_dedup", near_duplicates), ("benchmark_decontamination", decontamination), ("pii", personal_data), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read(spark, sf_dir, "documents")
    folder = scratch(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
