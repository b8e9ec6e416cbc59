"""Writers: route manifests, file copies, caption texts. All can be re-run after a lost task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framesift.file_sink import write_files
from framesift.functions.names import basename, extension, stem
from framesift.operators.skew import join_to_unique
from framesift.session import save_table

DIGEST = 12  # hex digits of the path in a name that would clash


def write_routes(routes: DataFrame, path: str) -> None:
    """Manifest of all images, one folder per route."""
    routes.write.mode("overwrite").partitionBy("route").parquet(path)


def unique_names(plan: DataFrame, name: str = "dest_name", path: str = "path") -> DataFrame:
    """``plan`` with names that differ for different paths.

    Of paths that ask for one name the first in order keeps it; the others get digits of the MD5 of their
    path before the suffix, so a name depends on the files only, not on the run. A name asked for by a
    large share of the files is counted with map-side combine and joined with salts.
    """
    wanted = plan.groupBy(name).agg(
        F.min(path).alias("_first"), F.max(path).alias("_last"), F.count(F.lit(1)).alias("_n")
    )
    clashes = save_table(wanted.filter(F.col("_first") != F.col("_last")).drop("_last"), "clashes")
    joined = join_to_unique(plan, clashes, [name], "left", weight="_n")
    base = basename(F.col(name))
    folder = F.substring(F.col(name), F.lit(1), F.length(name) - F.length(base))
    digits = F.substring(F.md5(F.encode(path, "UTF-8")), 1, DIGEST)
    other = F.concat(folder, stem(base), F.lit("-"), digits, extension(base))
    told = F.when(F.col(path) > F.col("_first"), other).otherwise(F.col(name))
    return joined.withColumn(name, told).select(*plan.columns)


def route_files(routes: DataFrame, images: DataFrame, id_col: str) -> DataFrame:
    """(id, path, dest_name) of the images that leave the set: their route is the folder, names do not clash."""
    moved = routes.filter(F.col("route") != "keep").select(id_col, "route")
    plan = images.select(id_col, "filename", "path").join(moved, id_col)
    return unique_names(plan.select(id_col, "path", F.concat_ws("/", "route", "filename").alias("dest_name")))


def copy_files(plan: DataFrame, out_dir: str, source: str = "path", dest: str = "dest_name") -> None:
    """Copy each ``source`` file to ``out_dir``/``dest`` from the executors. Originals stay where they are.

    Both can lie on any file system that pyarrow opens. Equal ``dest`` names overwrite each
    other: see ``unique_names``.
    """
    write_files(plan.select(F.col(dest).alias("dest"), F.col(source).alias("source")), out_dir)


def write_caption_files(files: DataFrame, out_dir: str) -> None:
    """One UTF-8 text per row of (txt_name, content), below ``folder`` if there is such a column."""
    dest = F.concat_ws("/", "folder", "txt_name") if "folder" in files.columns else F.col("txt_name")
    write_files(files.select(dest.alias("dest"), "content"), out_dir)
