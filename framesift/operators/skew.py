"""Joins and ranks that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framesift.session import save_table

# A key is hot from this many rows on. At most total/HOT_ROWS keys can be hot, which bounds
# the broadcast list of hot keys (50,000 keys in a table of 50 billion rows).
HOT_ROWS = 1_000_000
SALTS = 256


def join_to_unique(
    rows: DataFrame,
    lookup: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    weight: str | None = None,
    n_rows: int | None = None,
    hot_rows: int = HOT_ROWS,
    salts: int = SALTS,
) -> DataFrame:
    """Equi join of ``rows`` (any number per key) with ``lookup`` (one or a few rows per key).

    Rows of hot keys are spread over ``salts`` sub-keys and the lookup row of a hot key is
    repeated once per sub-key, so no single task receives a whole hot key. Without hot keys
    this is the plain join.

    ``weight`` names a column of a stored one-row-per-key ``lookup`` with the number of rows; else
    the keys of ``rows`` are counted with map-side combine, unless ``n_rows``, the size of
    ``rows``, is known to be below ``hot_rows``. ``weight`` stays in the result.
    """
    on = list(on)
    if n_rows is not None and n_rows < hot_rows:
        return rows.join(lookup, on, how)
    if weight:
        hot = lookup.filter(F.col(weight) >= hot_rows).select(*on)
    else:
        counts = rows.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"))
        hot = save_table(counts.filter(F.col("_n") >= hot_rows).select(*on), "hot")
    if not hot.head(1):
        return rows.join(lookup, on, how)
    hot = F.broadcast(hot.withColumn("_hot", F.lit(True)))
    # a hash of the row, not rand(): a re-run of a lost task must give the same salts
    spread = F.pmod(F.xxhash64(*rows.columns), F.lit(salts)).cast("int")
    salted = rows.join(hot, on, "left").withColumn("_salt", F.when(F.col("_hot"), spread).otherwise(F.lit(0)))
    repeat = F.sequence(F.lit(0), F.when(F.col("_hot"), F.lit(salts - 1)).otherwise(F.lit(0)))
    repeated = lookup.join(hot, on, "left").withColumn("_salt", F.explode(repeat)).drop("_hot")
    return salted.drop("_hot").join(repeated, [*on, "_salt"], how).drop("_salt")


def ordered_slices(df: DataFrame, columns: Sequence[str], n_slices: int | None = None) -> DataFrame:
    """Range-partition on ``columns`` and store with the slice number in ``_slice``.

    Slices are ordered: every row of a lower slice sorts before every row of a higher one.
    The order columns are part of the range key, so a hot leading key is cut into several
    slices. The result is stored because range bounds are sampled anew on each execution.
    """
    n_slices = n_slices or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = df.repartitionByRange(n_slices, *columns)
    return save_table(cut.withColumn("_slice", F.spark_partition_id()), "slices")


def ordered_rank(
    df: DataFrame,
    order: Sequence[str],
    by: Sequence[str] = (),
    name: str = "rank",
    weight: Column | None = None,
    n_slices: int | None = None,
) -> DataFrame:
    """Running total of ``weight`` (default 1: the row number) within ``by`` along ``order``.

    A plain window would sort a whole key, or the whole table when ``by`` is empty, in one
    task. Here each slice ranks its own rows and adds the total of the slices before it;
    those totals are one row per (key, slice).
    """
    by, order = list(by), list(order)
    weight = F.lit(1) if weight is None else weight
    sliced = ordered_slices(df.withColumn("_w", weight.cast("long")), [*by, *order], n_slices)
    per_slice = sliced.groupBy(*by, "_slice").agg(F.sum("_w").alias("_total"))
    before = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_slice.select(
        *by, "_slice", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_before")
    )
    if not by:
        offsets = F.broadcast(offsets)  # one row per slice
    local = (
        Window.partitionBy(*by, "_slice")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    ranked = sliced.withColumn("_local", F.sum("_w").over(local))
    return ranked.join(offsets, [*by, "_slice"]).withColumn(
        name, F.col("_before") + F.col("_local")
    ).drop("_slice", "_w", "_local", "_before")
