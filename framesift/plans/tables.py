"""Driver tables in the roles of image tables.

The driver tables hold no pictures; each function maps one of them, whole, to the columns an
operator reads. ``orders`` are images and ``lineitem`` their detections, ``embeddings`` are
grey grids, feature vectors and face embeddings, ``documents`` are files, ``conversations``
are captions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framesift.functions.hashing import average_hash_grid, box_mean_grid

THRESHOLD = 0.35  # the vectors of the driver table have no pair above the usual 0.85
FIXED_K = 10  # values of the label column
PROMPT_TABLE = "region"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select("vec_id", "embedding")


def labelled(spark: SparkSession, folder: str) -> DataFrame:
    """Face embeddings with a given cluster."""
    return table(spark, folder, "embeddings").select(
        "vec_id", "embedding", F.col("label").alias("cluster")
    )


def face_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Every seventh image has no face."""
    return vectors(spark, folder).select(
        "vec_id", F.when(F.col("vec_id") % 7 != 0, F.col("embedding")).alias("embedding")
    )


def coarse_hashes(spark: SparkSession, folder: str) -> DataFrame:
    """Hash of each grid shrunk to 2 x 4 cells, so that real duplicates occur."""
    grid = box_mean_grid(F.col("embedding"), 8, 2, 4)
    return vectors(spark, folder).withColumn("grid", grid).select(
        "vec_id", average_hash_grid(F.col("grid"), 8).alias("hash")
    )


def files(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, path, filename."""
    suffixes = F.array(*[F.lit(x) for x in (".png", ".JPG", ".jpeg", ".gif", ".txt", ".PNG")])
    docs = table(spark, folder, "documents").select("doc_id", "source")
    name = F.concat(
        F.lit("IMG_"), F.col("doc_id").cast("string"), F.get(suffixes, (F.col("doc_id") % 6).cast("int"))
    )
    return docs.withColumn("filename", name).select(
        "doc_id", F.concat(F.lit("/set/"), "source", F.lit("/"), "filename").alias("path"), "filename"
    )


def sizes(spark: SparkSession, folder: str, source: str = "documents", key: str = "doc_id") -> DataFrame:
    at = F.col(key)
    return table(spark, folder, source).select(
        key,
        (F.lit(100) + (at * 37) % 5000).cast("int").alias("width"),
        (F.lit(100) + (at * 91) % 4000).cast("int").alias("height"),
    )


def captions(spark: SparkSession, folder: str) -> DataFrame:
    """Assistant turns as captions: conv_id, filename, pos, caption."""
    said = table(spark, folder, "conversations").filter(F.col("role") == "assistant")
    return said.select(
        "conv_id",
        F.concat(F.lit("IMG_"), F.col("conv_id").cast("string"), F.lit(".png")).alias("filename"),
        F.col("turn").alias("pos"),
        F.col("text").alias("caption"),
    )


def identifiers(spark: SparkSession, folder: str) -> DataFrame:
    parts = table(spark, folder, "part").select(
        F.lit("part").alias("kind"), F.col("p_partkey").alias("id"), F.col("p_name").alias("name")
    )
    makers = table(spark, folder, "supplier").select(
        F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")
    )
    return parts.unionByName(makers)


def images_with_faces(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    images = table(spark, folder, "orders").select(F.col("o_orderkey").alias("image_id"))
    faces = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("image_id"))
    return images, faces
