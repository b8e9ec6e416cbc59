"""Exact-hash duplicates: the first image of each hash stays, later ones are duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framesift.operators.skew import join_to_unique
from framesift.session import save_table


def hash_duplicates(hashes: DataFrame, id_col: str, hash_col: str = "hash") -> DataFrame:
    """(id, hash, kept): one row per duplicate with the id of the image that stays.

    ``hashes`` is read twice, so it should be a stored table and not the hashing itself.

    The first id per hash comes from an aggregation with map-side combine, so a hash shared
    by a large part of the set costs one row per task; only hashes that occur twice or more
    take part in the join back.
    """
    rows = hashes.select(F.col(id_col), F.col(hash_col)).filter(F.col(hash_col).isNotNull())
    firsts = save_table(
        rows.groupBy(hash_col)
        .agg(F.min(id_col).alias("kept"), F.count(F.lit(1)).alias("_copies"))
        .filter(F.col("_copies") > 1),
        "firsts",
    )
    return (
        join_to_unique(rows, firsts, [hash_col], weight="_copies")
        .filter(F.col(id_col) != F.col("kept"))
        .select(id_col, hash_col, "kept")
    )


def hash_stats(hashes: DataFrame, hash_col: str = "hash") -> DataFrame:
    """One row: total_images, duplicates_found. Needs no join: copies beyond the first per hash."""
    per_hash = hashes.groupBy(hash_col).agg(F.count(F.lit(1)).alias("n"))
    extra = F.when(F.col(hash_col).isNotNull(), F.col("n") - 1).otherwise(F.lit(0))
    return per_hash.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_images"),
        F.coalesce(F.sum(extra), F.lit(0)).alias("duplicates_found"),
    )
