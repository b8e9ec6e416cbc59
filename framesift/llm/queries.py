"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from framesift.llm import (
    fingerprints, itq, langid, minhash, mixing, packing, periodic, preference, privacy, rabitq, urlfilter, variants, warc,
)
from framesift.llm.common import table
from framesift.session import scratch_root


def op1_warc_archive(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    archive = f"{scratch_root(spark)}/framesift-warc-{uuid.uuid4().hex}"
    if not warc.write_archives(pages, archive).head(1):
        return warc.page_records(spark.createDataFrame([], warc.RECORD))
    return warc.page_records(warc.read_archives(spark, archive, with_payload=False))


def op2_preference_pairs(spark: SparkSession, folder: str) -> DataFrame:
    chosen, rejected = preference.stale_answers(table(spark, folder, "conversations"))
    return preference.preference_segments(chosen, rejected)


def op3_private_data(spark: SparkSession, folder: str) -> DataFrame:
    return privacy.privacy_report(table(spark, folder, "documents"))


def op4_vector_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return itq.near_vectors(table(spark, folder, "embeddings"))


def op5_nearest_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return rabitq.nearest_vectors(table(spark, folder, "embeddings"), lambda vec_id: vec_id % 100 == 0)


def op6_url_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    pages, labels = table(spark, folder, "pages"), table(spark, folder, "labels")
    return urlfilter.url_verdicts(pages, urlfilter.toxic_page_keys(pages, labels))


def op7_text_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.duplicate_groups(table(spark, folder, "documents"), words=2)


def op8_language(spark: SparkSession, folder: str) -> DataFrame:
    return langid.language_report(table(spark, folder, "documents"))


def op9_mixture(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mixture_report(table(spark, folder, "documents"))


def op10_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packing_report(table(spark, folder, "documents"))


def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    return periodic.runs_report(table(spark, folder, "documents"))


def op12_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.fingerprint_report(table(spark, folder, "documents"))


def op13_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return variants.variants_report(table(spark, folder, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_warc_archive, op2_preference_pairs, op3_private_data, op4_vector_duplicates, op5_nearest_vectors,
    op6_url_verdicts, op7_text_duplicates, op8_language, op9_mixture, op10_packing,
    op11_periodic_runs, op12_fingerprints, op13_spelling_variants,
)}

ORACLES = {"op2_preference_pairs": preference.PREFERENCE_SQL, "op6_url_verdicts": urlfilter.VERDICT_SQL}
