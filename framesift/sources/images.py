"""Image folders, ordered uploads and file metadata as DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framesift.functions.names import basename, extension, stem

# Fixed value: the accepted suffixes in any case, as a file name glob.
IMAGE_GLOB = "*.{[pP][nN][gG],[jJ][pP][gG],[jJ][pP][eE][gG]}"


def with_identity(df: DataFrame, path: str = "path") -> DataFrame:
    """Add ``filename`` and ``image_id``, which sorts by (filename, path) and is unique."""
    name = basename(F.col(path))
    return df.withColumn("filename", name).withColumn(
        "image_id", F.concat(name, F.lit("\u0000"), F.col(path))
    )


def read_images(spark: SparkSession, folder: str | Sequence[str]) -> DataFrame:
    """Decoded pictures of flat folders: image_id, filename, path, error, image.

    Subfolders are not entered. A file that cannot be decoded keeps its row with
    ``error`` set, so every later stage can apply its own rule to it.
    """
    folders = [folder] if isinstance(folder, str) else list(folder)
    pictures = (
        spark.read.format("image")
        .option("dropInvalid", "false")
        .option("pathGlobFilter", IMAGE_GLOB)
        .load(folders)
        .withColumn("path", F.col("image.origin"))
    )
    return with_identity(pictures).select(
        "image_id", "filename", "path", (F.col("image.height") < 0).alias("error"), "image"
    )


def file_parts(df: DataFrame, path: str = "path") -> DataFrame:
    """Add filename, stem and ext columns derived from a path."""
    df = df.withColumn("filename", basename(F.col(path)))
    return df.withColumn("stem", stem(F.col("filename"))).withColumn("ext", extension(F.col("filename")))


def read_file_meta(spark: SparkSession, folder: str | Sequence[str], glob: str = IMAGE_GLOB) -> DataFrame:
    """path, filename, stem, ext, mtime, length; file contents are not read."""
    folders = [folder] if isinstance(folder, str) else list(folder)
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folders)
    return file_parts(files).select(
        "path", "filename", "stem", "ext", F.col("modificationTime").alias("mtime"), "length"
    )


LISTED = 100_000  # names of a driver's list that are broadcast


def _wanted(spark: SparkSession, paths: Sequence[str] | DataFrame, folder: str | Sequence[str] | None):
    """(pos, _key) of the listed files, and what to scan for them."""
    if isinstance(paths, DataFrame):
        if folder is None:
            raise ValueError("a table of paths needs the folders to scan")
        return paths.select("pos", plain_path(F.col("path")).alias("_key")), folder
    listed = spark.createDataFrame([(pos, path) for pos, path in enumerate(paths)], "pos int, listed string")
    listed = listed.select("pos", plain_path(F.col("listed")).alias("_key"))
    return F.broadcast(listed) if len(paths) <= LISTED else listed, sorted(set(paths))


def read_uploads(
    spark: SparkSession, paths: Sequence[str] | DataFrame, folder: str | Sequence[str] | None = None
) -> DataFrame:
    """Files of an ordered upload, any suffix, any folders: pos, path, filename, mtime, content.

    ``pos`` is the place in the list; a file listed twice gives two rows. A long list comes
    as a table (pos, path) with the folders to scan, so it does not pass through the driver.
    """
    wanted, source = _wanted(spark, paths, folder)
    files = spark.read.format("binaryFile").load(source)
    return files.withColumn("_key", plain_path(F.col("path"))).join(wanted, "_key").select(
        "pos", "path", basename(F.col("path")).alias("filename"),
        F.col("modificationTime").alias("mtime"), "length", "content",
    )


def read_upload_images(
    spark: SparkSession, paths: Sequence[str] | DataFrame, folder: str | Sequence[str] | None = None
) -> DataFrame:
    """Decoded pictures of an ordered upload, as captioning reads them: pos, path, filename, mtime, error, image.

    Names and times are joined with the list first, without the bytes of the files.
    """
    wanted, source = _wanted(spark, paths, folder)
    times = spark.read.format("binaryFile").load(source).select(
        plain_path(F.col("path")).alias("_key"), F.col("modificationTime").alias("mtime")
    )
    pictures = spark.read.format("image").option("dropInvalid", "false").load(source)
    pictures = pictures.withColumn("path", F.col("image.origin")).withColumn("_key", plain_path(F.col("path")))
    # a file listed twice is scanned once and joined twice
    return pictures.join(times.dropDuplicates(["_key"]).join(wanted, "_key"), "_key").select(
        "pos", "path", basename(F.col("path")).alias("filename"), "mtime",
        (F.col("image.height") < 0).alias("error"), "image",
    )


def plain_path(path):
    """Path without a local-file scheme, so listed and scanned names compare equal."""
    return F.regexp_replace(path, "^file:/+", "/")
