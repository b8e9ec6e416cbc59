"""Corpus pipeline: five stages from raw documents to packed token sequences.

Each stage takes (spark, docs, sf_dir), with docs in the columns of ``documents``, and works on all
rows its predecessor kept. All stages but the last return those columns again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framesift.llm import langid, minhash, mixing, packing, privacy
from framesift.llm.common import prepare
from framesift.session import scratch_root

BATCH_BYTES = "4m"  # smaller Arrow batches: workers of one stage still hold memory while the next runs
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a language (null or without a letter); fills in missing languages.

    Profiles are learned from all rows that have a language. If no row has one, nothing can be
    learned: then texts that are null or without a letter are rejected, and languages stay null.
    """
    prepare(spark, BATCH_BYTES)
    profiles = langid.language_profiles(docs)
    if not profiles:
        return docs.select(*COLUMNS).filter(F.col("text").rlike(r"\p{L}"))
    found = langid.identify_language(docs.select(*COLUMNS), profiles)
    kept = found.filter(F.col("lang_pred") != langid.UNKNOWN)
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group linked by 80 % of five-word shingles."""
    prepare(spark, BATCH_BYTES)
    return minhash.first_of_each_group(docs.select(*COLUMNS))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks personal data and the terms that reveal it; keeps every document."""
    prepare(spark, BATCH_BYTES)
    docs = docs.select(*COLUMNS)
    return privacy.masked(docs, privacy.private_spans(docs))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixes the sources to their targets; a document has a row for each epoch it is taken in."""
    prepare(spark, BATCH_BYTES)
    return mixing.mixed_documents(docs.select(*COLUMNS))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all documents in sequences of 1024: see ``packing.packed_pieces``."""
    prepare(spark, BATCH_BYTES)
    return packing.packed_pieces(docs)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixture", mixture),
    ("packed", packed),
]

# Hypervector cosines, tokenisation and the packing rule are beyond SQL; the tests compare the
# stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written as Parquet and read again by the next."""
    prepare(spark, BATCH_BYTES)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    root = f"{scratch_root(spark)}/framesift-pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{name}")
        docs = spark.read.parquet(f"{root}/{name}")
    return docs
