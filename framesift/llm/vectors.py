"""Vector columns of the embedding operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE_ROWS = 16_384
SAMPLE_BYTES = 64 << 20


def usable(vec: Column) -> Column:
    """Neither null nor zero, all components finite."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(vec.isNotNull() & finite & F.exists(vec, lambda x: x != 0), F.lit(False))


def same_length(rows: DataFrame, column: str = "vec") -> tuple[DataFrame, int]:
    """Vectors filled up with zeros to the longest one, and that length (0 without rows)."""
    dims = rows.agg(F.max(F.size(column))).first()[0] or 0
    fill = F.array_repeat(F.lit(0.0).cast("double"), F.lit(dims) - F.size(column))
    return rows.withColumn(column, F.concat(F.col(column).cast("array<double>"), fill)), dims


def matrix(column, dims: int) -> np.ndarray:
    """Arrow list column -> rows x dims of doubles."""
    import pyarrow as pa

    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dims)


def fitting_sample(rows: DataFrame, dims: int) -> np.ndarray:
    """The SAMPLE_ROWS vectors with the lowest hash (fewer if SAMPLE_BYTES are reached)."""
    n = max(2, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * max(1, dims))))
    sample = rows.orderBy(F.xxhash64("vec", F.lit("fit")), "id").limit(n).select("vec")
    return matrix(sample.toArrow().column("vec"), dims)
