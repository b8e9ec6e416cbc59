"""Size plans as column expressions over width and height."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
MAX_DIMENSION = 2048
THUMBNAIL = (256, 256)
PAIR_HEIGHT = 300


def needs_resize(width: Column, height: Column, limit: int = MAX_DIMENSION) -> Column:
    return (width > limit) | (height > limit)


def resize_plan(width: Column, height: Column, limit: int = MAX_DIMENSION) -> Column:
    """struct(width, height) after shrinking to ``limit``; unchanged when it already fits."""
    ratio = F.least(F.lit(float(limit)) / width, F.lit(float(limit)) / height)
    over = needs_resize(width, height, limit)
    return F.struct(
        F.when(over, F.floor(width * ratio)).otherwise(width).cast("int").alias("width"),
        F.when(over, F.floor(height * ratio)).otherwise(height).cast("int").alias("height"),
    )


def thumbnail_plan(width: Column, height: Column, box: tuple[int, int] = THUMBNAIL) -> Column:
    """struct(width, height) that fills ``box`` keeping the ratio; also enlarges.

    ``rint`` rounds halves to even, as the rule asks.
    """
    wide, high = box
    w, h = width.cast("double"), height.cast("double")
    flatter = (w / h) > F.lit(wide / high)
    return F.struct(
        F.when(flatter, F.lit(wide)).otherwise(F.rint(w / h * high)).cast("int").alias("width"),
        F.when(flatter, F.rint(h / w * wide)).otherwise(F.lit(high)).cast("int").alias("height"),
    )


def pair_width(width: Column, height: Column, target: int = PAIR_HEIGHT) -> Column:
    """Width of one half of a side-by-side picture scaled to the common height."""
    return F.floor(width * F.lit(target) / height).cast("int")
