"""Skew-safe joins and ranks give the same rows as the plain forms."""

from __future__ import annotations

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from framesift.operators.duplicates import hash_duplicates, hash_stats
from framesift.operators.skew import join_to_unique, ordered_rank


def skewed(spark, n=3000):
    return spark.range(n).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("k"))


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("weight", [None, "n"])
def test_join(spark, how, weight):
    rows = skewed(spark)
    lookup = rows.groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("top")).filter("k < 40")
    got = join_to_unique(rows, lookup, ["k"], how, weight=weight, hot_rows=100, salts=8)
    want = rows.join(lookup, "k", how)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


@pytest.mark.parametrize("by", [(), ("k",)])
def test_rank(spark, by):
    rows = skewed(spark)
    got = ordered_rank(rows, ["id"], by, n_slices=5)
    window = Window.partitionBy(*by).orderBy("id")
    want = rows.withColumn("rank", F.row_number().over(window))
    assert {r.id: r["rank"] for r in got.collect()} == {r.id: r["rank"] for r in want.collect()}


def test_weighted_rank(spark):
    rows = skewed(spark, 200)
    got = ordered_rank(rows, ["id"], ["k"], "load", F.col("id") % 4, n_slices=3)
    window = Window.partitionBy("k").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    want = rows.withColumn("load", F.sum(F.col("id") % 4).over(window))
    assert {r.id: r.load for r in got.collect()} == {r.id: r.load for r in want.collect()}


def test_duplicates_with_a_hot_hash(spark):
    rows = skewed(spark).withColumn("hash", F.when(F.col("k") < 45, F.col("k").cast("string")))
    got = {r.id: r.kept for r in hash_duplicates(rows, "id").collect()}
    first: dict = {}
    want = {}
    for r in sorted(rows.collect(), key=lambda r: r.id):
        if r.hash is None:
            continue
        if r.hash in first:
            want[r.id] = first[r.hash]
        else:
            first[r.hash] = r.id
    assert got == want
    stats = hash_stats(rows).first()
    assert (stats.total_images, stats.duplicates_found) == (3000, len(want))
