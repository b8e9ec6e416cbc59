"""Average hash: of a grid column as a codegen expression, of image files as a batch UDF."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from framesift.functions.pixels import average_hash_hex, decode


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body``."""
    return F.get(F.transform(F.array(value), body), 0)


def average_hash_grid(grid: Column, cells: int = 64) -> Column:
    """Hex hash of a row-major grey grid: one bit per cell, set when above the mean.

    The bits are folded into one long in the JVM. ``cells`` is a multiple of 4, at most 64.
    (Written out cell by cell the generated code outgrows the compiler and runs slower.)
    """
    if cells % 4 or not 4 <= cells <= 64:
        raise ValueError("cells must be a multiple of 4 between 4 and 64")

    def word(g: Column) -> Column:
        mean = F.aggregate(g, F.lit(0.0), lambda acc, v: acc + v) / F.lit(float(cells))
        return _let(
            mean,
            lambda m: F.aggregate(
                g, F.lit(0).cast("long"), lambda acc, v: F.shiftleft(acc, 1).bitwiseOR((v > m).cast("long"))
            ),
        )

    return F.lpad(F.lower(F.hex(_let(grid.cast("array<double>"), word))), cells // 4, "0")


def box_mean_grid(grid: Column, size: int, rows: int, cols: int) -> Column:
    """Shrink a ``size`` x ``size`` row-major grid to ``rows`` x ``cols`` by block means."""
    high, wide = size // rows, size // cols
    cells = []
    for r in range(rows):
        for c in range(cols):
            members = [
                F.get(grid, (r * high + y) * size + c * wide + x).cast("double")
                for y in range(high)
                for x in range(wide)
            ]
            cells.append(reduce(lambda a, b: a + b, members) / F.lit(float(high * wide)))
    return F.array(*cells)


@F.pandas_udf(StringType())
def average_hash_image(image: pd.DataFrame) -> pd.Series:
    """Hash of an ``image`` struct column (Spark's image source); null if not decodable."""
    return pd.Series(
        [
            None if row.height <= 0 else average_hash_hex(decode(row))
            for row in image.itertuples(index=False)
        ],
        dtype=object,
    )
