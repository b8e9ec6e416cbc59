"""Plot of any number of points as tiles: per zoom level a grid of tiles, each of bounded size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TILE_CELLS = 32  # cells along a side of a tile, so at most 1,024 entries per tile
ZOOMS = 6


def _place(value: str, low: str, high: str, cells: int):
    """Cell of a value on an axis cut into ``cells``; everything is cell 0 where the axis has no length."""
    share = F.when(F.col(high) > F.col(low), (F.col(value) - F.col(low)) / (F.col(high) - F.col(low))).otherwise(F.lit(0.0))
    return F.least(F.floor(share * cells), F.lit(cells - 1)).cast("int")


def plot_cells(points: DataFrame, id_col: str, zooms: int = ZOOMS, cells: int = TILE_CELLS) -> DataFrame:
    """(zoom, tx, ty, cx, cy, n, n_selected, cluster, first_id): occupied cells of all tiles at each zoom.

    ``points`` as from ``plot_data``: id, x, y, cluster, is_selected; points without a finite place
    are not drawn. Zoom z has 2^z x 2^z tiles. ``cluster`` is the most frequent one (ties: the lowest).
    Points are counted once, at the finest zoom; coarser zooms sum up those counts. A crowded
    cell is pre-aggregated in each task, so it costs one row per task and cluster.
    """
    bounds = points.filter(F.abs(F.col("x")) + F.abs(F.col("y")) < float("inf"))
    edge = bounds.agg(*[f(c).alias(f"_{n}{c}") for c in ("x", "y") for n, f in (("low", F.min), ("high", F.max))])
    finest = cells << (zooms - 1)
    spots = bounds.crossJoin(F.broadcast(edge)).select(  # one row of four numbers
        id_col, "cluster", F.col("is_selected").cast("long").alias("_sel"),
        _place("x", "_lowx", "_highx", finest).alias("_x"), _place("y", "_lowy", "_highy", finest).alias("_y"),
    )
    counted = spots.groupBy("_x", "_y", "cluster").agg(
        F.count(F.lit(1)).alias("n"), F.sum("_sel").alias("n_selected"), F.min(id_col).alias("first_id")
    )
    step = F.lit(zooms - 1) - F.col("zoom")
    levels = counted.withColumn("zoom", F.explode(F.sequence(F.lit(0), F.lit(zooms - 1))))
    coarse = levels.select(
        "zoom", *[F.floor(F.col(c) / F.pow(F.lit(2), step)).cast("int").alias(c) for c in ("_x", "_y")], "cluster", "n", "n_selected", "first_id"
    )
    per_cluster = coarse.groupBy("zoom", "_x", "_y", "cluster").agg(
        F.sum("n").alias("n"), F.sum("n_selected").alias("n_selected"), F.min("first_id").alias("first_id")
    )
    merged = per_cluster.groupBy("zoom", "_x", "_y").agg(
        F.sum("n").alias("n"), F.sum("n_selected").alias("n_selected"),
        F.min_by("cluster", F.struct(-F.col("n"), F.col("cluster"))).alias("cluster"), F.min("first_id").alias("first_id"),
    )
    return merged.select(
        "zoom", *[F.floor(F.col(f"_{c}") / cells).cast("int").alias(f"t{c}") for c in ("x", "y")],
        *[(F.col(f"_{c}") % cells).cast("int").alias(f"c{c}") for c in ("x", "y")],
        "n", "n_selected", "cluster", "first_id",
    )


def plot_tiles(points: DataFrame, id_col: str, zooms: int = ZOOMS, cells: int = TILE_CELLS) -> DataFrame:
    """(zoom, tx, ty, n_points, n_selected, n_cells, cells): one row per tile that holds points.

    ``cells`` is a JSON list of its occupied cells in order of (cx, cy), at most ``cells`` squared
    entries whatever the number of points; null clusters are left out of an entry.
    """
    entry = F.struct("cx", "cy", "n", "n_selected", "cluster", "first_id")
    return plot_cells(points, id_col, zooms, cells).groupBy("zoom", "tx", "ty").agg(
        F.sum("n").alias("n_points"), F.sum("n_selected").alias("n_selected"), F.count(F.lit(1)).alias("n_cells"),
        F.to_json(F.array_sort(F.collect_list(entry))).alias("cells"),
    )
