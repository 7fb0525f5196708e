"""The training-data pipeline: quality rules, language, near-duplicates, personal data, packing.

``STAGES`` are (name, function) in order; a function takes (spark, docs, sf_dir) and returns the next stage's documents,
the last one the packed pieces. Every stage takes null, empty and very long texts, null ids, repeated rows, empty tables and
columns of any further name: quality and language reject texts that are null or have no words or letters, the
near-duplicate stage keeps one of repeated rows, personal_data leaves a null text null, and packing counts it as empty;
the further columns stay as they are up to the last stage. ``run`` writes each stage as Parquet to the shared folder and reads it again, so a lost
executor never costs more than the stage at hand.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from staylens.llm import language_id, packing, pii, quality_rules, simhash
from staylens.llm.catalog import WORD_VOCABULARY
from staylens.llm.common import table
from staylens.session import ensure_checkpoint_dir


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the current rule policy."""
    return quality_rules.keep_documents(docs)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose whole text some learned language explains."""
    return language_id.keep_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash near-duplicates (four-word shingles, at most four bits)."""
    return simhash.keep_one_of_each(docs, words=4, max_bits=4)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data in their texts masked."""
    return pii.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per token piece with its sequence and offset."""
    return packing.pack_documents(docs, WORD_VOCABULARY)


STAGES = [("quality", quality), ("language", language), ("near_duplicates", near_duplicates),
          ("personal_data", personal_data), ("packing", pack)]

# The language model, XXH64 fingerprints and the tokenizer are beyond SQL; tests/llm holds run() against plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``: the packed pieces."""
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
