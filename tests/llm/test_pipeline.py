"""The corpus pipeline over the driver tables, and the registered queries against SQL."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from check import compare, connect
from framesift.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables are not here")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    text = compare(spark, connect(FOLDER), FOLDER, name, QUERIES[name], ORACLES[name])
    assert text.startswith("ok"), text


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    start = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, FOLDER)
        assert tuple(out.columns) == corpus_pipeline.COLUMNS
        out = out.cache()
        if name == "language":  # keeps every document with a letter
            assert out.count() == docs.filter(F.col("text").rlike(r"\p{L}")).count()
        if name == "near_duplicates":
            assert out.select("doc_id").distinct().count() == out.count() < docs.count()
        if name == "personal_data":
            assert out.count() == docs.count() and out.filter("text LIKE '%@%.example.com%'").count() == 0
        docs = out
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    ids = docs.select("doc_id").distinct()
    assert packed.select("doc_id").distinct().count() == ids.count() <= start.count()


def test_language_stage_without_labels(spark):
    rows = [(1, "A text", None, "a", 6), (2, "", None, "a", 0), (3, None, None, "b", None), (4, "12 45", None, "b", 5), (5, "漢字", None, "b", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.language(spark, docs, "")
    assert tuple(out.columns) == corpus_pipeline.COLUMNS and {r["doc_id"] for r in out.collect()} == {1, 5}


def test_pipeline_with_edge_rows(spark, tmp_path):
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "word " * 3000, None, "a", 15000), (3, "word " * 3000, None, "a", 15000),
            (None, "A text without an id", "en", None, 20), (4, "12345", "en", "b", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumn("size", F.lit("clash"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == {3, None}
    empty = f"{tmp_path}/empty"
    docs.limit(0).write.parquet(f"{empty}/documents.parquet")
    assert corpus_pipeline.run(spark, empty).count() == 0
