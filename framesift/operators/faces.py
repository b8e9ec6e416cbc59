"""Face counts per image and the routes that follow from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def faces_per_image(images: DataFrame, detections: DataFrame, id_col: str) -> DataFrame:
    """(id, n_faces). Detections are counted before the join, so an image with very many
    faces is combined map-side; images without any keep a zero."""
    counts = detections.groupBy(id_col).agg(F.count(F.lit(1)).alias("n_faces"))
    return images.select(id_col).join(counts, id_col, "left").select(
        id_col, F.coalesce("n_faces", F.lit(0)).alias("n_faces")
    )


def face_route(n_faces: Column) -> Column:
    """No face (or a failed detector, null) and several faces are moved; one face stays."""
    n = F.coalesce(n_faces, F.lit(0))
    return F.when(n == 0, "no_faces").when(n > 1, "multiple_faces").otherwise("keep")


def face_stats(counts: DataFrame) -> DataFrame:
    """One row: total_images, no_faces, multiple_faces, single_face."""
    n = F.coalesce(F.col("n_faces"), F.lit(0))
    return counts.agg(
        F.count(F.lit(1)).alias("total_images"),
        F.count_if(n == 0).alias("no_faces"),
        F.count_if(n > 1).alias("multiple_faces"),
        F.count_if(n == 1).alias("single_face"),
    )
