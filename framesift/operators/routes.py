"""Routes of moved images, chaining of stages, reports and manifests.

Input is never changed: a stage says where each image goes, the next stage reads what stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framesift.functions.geometry import PAIR_HEIGHT, pair_width
from framesift.functions.names import result_label


def route_of(moved: DataFrame, id_col: str, route: str, source: str | None = None) -> DataFrame:
    return moved.select(F.col(source or id_col).alias(id_col), F.lit(route).alias("route"))


def remaining(images: DataFrame, moved: DataFrame, id_col: str) -> DataFrame:
    """Images no earlier stage has moved. ``id_col`` is unique in both, so no key is hot."""
    return images.join(moved.select(id_col), id_col, "left_anti")


def all_routes(images: DataFrame, moved: DataFrame, id_col: str) -> DataFrame:
    """(id, route) for every image; those not moved are 'keep'."""
    return images.select(id_col).join(moved.select(id_col, "route"), id_col, "left").select(
        id_col, F.coalesce("route", F.lit("keep")).alias("route")
    )


def moved_images(*parts: DataFrame) -> DataFrame:
    """Ids moved by any stage, each once."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.distinct()


def result_labels(routes: DataFrame, name: Column) -> DataFrame:
    """(route, label) of moved images; similar pairs have labels of their own."""
    return routes.filter(~F.col("route").isin("keep", "similar_images")).select(
        "route", result_label(F.col("route"), name).alias("label")
    )


def picture_name(pair_no: Column) -> Column:
    return F.concat(F.lit("similar_"), pair_no.cast("string"), F.lit(".jpg"))


def pair_labels(numbered: DataFrame) -> DataFrame:
    """(route, label) per similar pair; the label names the comparison picture."""
    return numbered.select(
        F.lit("similar_images").alias("route"),
        result_label(F.lit("similar_images"), picture_name(F.col("pair_no"))).alias("label"),
    )


def pair_report(numbered: DataFrame, sizes: DataFrame, id_col: str) -> DataFrame:
    """One row per pair: picture name, texts and geometry of the side-by-side picture."""
    def side(prefix: str) -> DataFrame:
        return sizes.select(
            F.col(id_col).alias(prefix),
            pair_width(F.col("width"), F.col("height")).alias(f"{prefix}_width"),
        )

    return (
        numbered.join(side("moved"), "moved").join(side("kept"), "kept").select(
            "pair_no", "moved", "kept", F.round("similarity", 6).alias("similarity"),
            F.format_string("Similarity: %.2f", "similarity").alias("text"),
            picture_name(F.col("pair_no")).alias("picture"),
            F.lit(PAIR_HEIGHT).alias("height"), "moved_width", "kept_width",
            (F.col("moved_width") + F.col("kept_width")).alias("total_width"),
        )
    )


def similarity_status(
    stats: DataFrame, threshold: float, out_dir: str, methods: tuple[str, ...]
) -> DataFrame:
    """One row of text from a row with duplicates_found and similar_pairs."""
    # The texts of the status box. A % in the path is text, not a pattern.
    out_dir = out_dir.replace("%", "%%")
    duplicates = F.when(
        F.col("duplicates_found") > 0,
        F.format_string(f"Found and moved %d duplicate images to {out_dir}/duplicate_images", "duplicates_found"),
    ).otherwise("No duplicate images found with perceptual hash")
    similar = F.when(
        F.col("similar_pairs") > 0,
        F.format_string(
            f"Found %d similar image pairs with VGG16 (threshold: {threshold})\n"
            f"One image from each pair moved to {out_dir}/similar_images\n"
            f"Comparison images created in {out_dir}/similar_images/similar_pairs",
            "similar_pairs",
        ),
    ).otherwise(f"No similar images found with VGG16 (threshold: {threshold})")
    texts = [t for m, t in (("perceptual_hash", duplicates), ("vgg16_similarity", similar)) if m in methods]
    return stats.select(F.concat_ws("\n", *texts).alias("status"))


def face_status(stats: DataFrame, out_dir: str) -> DataFrame:
    # The texts of the status box. A % in the path is text, not a pattern.
    out_dir = out_dir.replace("%", "%%")
    return stats.select(
        F.format_string(
            "Processed %d images:\n"
            f"• %d images with no faces moved to {out_dir}/no_faces\n"
            f"• %d images with multiple faces moved to {out_dir}/multiple_faces\n"
            "• %d images with single faces remained in the input directory",
            "total_images", "no_faces", "multiple_faces", "single_face",
        ).alias("status")
    )


def cluster_status(stats: DataFrame, method: str, out_dir: str) -> DataFrame:
    # The texts of the status box. A % in the path is text, not a pattern.
    out_dir = out_dir.replace("%", "%%")
    return stats.select(
        F.format_string(
            "Successfully clustered images into %d groups.\n"
            f"Selected %d representative images using '{method}' method.\n"
            f"Images saved to: {out_dir}/{method}_cluster\n"
            "Files are named with their cluster number for reference.\n"
            f"Interactive visualization available at: {out_dir}/visualization/cluster_visualization.html",
            "groups_formed", "images_selected",
        ).alias("status")
    )
