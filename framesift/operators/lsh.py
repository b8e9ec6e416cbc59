"""Approximate cosine join: hash tables of random planes, every hit checked on the vectors.

The exact join (``similarity.cosine_pairs``) loses no pair but compares most of them when the
vectors have no structure. Here a pair is compared where all planes of a table see both
vectors on the same side. The number of tables follows from the threshold, the planes per
table and the share of pairs that may be missed.

Up to some millions of vectors a vector is not carried once per table but once per part of the vectors: a
task holds two parts and looks for the pairs of all tables between them. The pairs are the same either way.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from framesift.operators.similarity import check_threshold, equal_groups, unit_rows, vectors_of, with_copies
from framesift.session import save_table

MISS = 0.01  # largest expected share of missed pairs, reached at the threshold itself
MIN_PLANES = 4
BUCKET_ROWS = 2048  # aimed at vectors per bucket
BLOCK_ROWS = 1024  # rows per block of a bucket; a task holds two blocks
PLANE_BYTES = 64 << 20  # bound on the planes shipped with the tasks
PARTS = 12  # parts of the vectors, where there are enough of them
PART_ROWS = 65_536  # most vectors in a part; a task holds two parts
PART_BYTES = 128 << 20  # bound on a part's vectors and codes
STRIP = 1 << 22  # similarities computed at a time
SEED = 11


def tables_needed(threshold: float, planes: int, miss: float = MISS) -> int:
    """Tables after which a pair at the threshold is missed with a chance of at most ``miss``.

    A random plane has both vectors on one side with the chance 1 - angle / pi.
    """
    alike = (1.0 - math.acos(threshold) / math.pi) ** planes
    return max(1, math.ceil(math.log(miss) / math.log1p(-alike)))


def _codes_udf(normals: np.ndarray, n_tables: int, planes: int):
    powers = 1 << np.arange(planes, dtype=np.int64)

    @F.pandas_udf("array<bigint>")
    def codes(vec: pd.Series) -> pd.Series:
        sides = np.stack(vec.to_numpy()).astype(np.float64) @ normals > 0
        return pd.Series(list(sides.reshape(len(vec), n_tables, planes) @ powers))

    return codes


def _bucket_kernel(threshold: float, id_type: pa.DataType):
    schema = pa.schema([("earlier", id_type), ("later", id_type), ("similarity", pa.float64())])

    def pairs(table: pa.Table) -> pa.Table:
        n = table.num_rows
        ids = table.column("id").combine_chunks()
        unit, codes = (
            table.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(n, -1) for c in ("vec", "codes")
        )
        unit = unit_rows(unit)
        rank = np.empty(n, dtype=np.int64)
        rank[np.argsort(ids.to_numpy(zero_copy_only=False), kind="stable")] = np.arange(n)
        block = table.column("block").to_numpy()
        at, one, two = (table.column(c)[0].as_py() for c in ("table_no", "low", "high"))
        low, high = np.flatnonzero(block == one), np.flatnonzero(block == two)
        sims = unit[low] @ unit[high].T
        keep = sims > threshold
        if one == two:
            keep &= rank[low][:, None] < rank[high][None, :]
        r, c = np.nonzero(keep)
        left, right, value = low[r], high[c], sims[r, c]
        # a pair that met in an earlier table was given out there
        new = ~(codes[left, :at] == codes[right, :at]).any(axis=1)
        left, right, value = left[new], right[new], value[new]
        swap = rank[left] > rank[right]
        left, right = np.where(swap, right, left), np.where(swap, left, right)
        return pa.Table.from_arrays([ids.take(pa.array(left)), ids.take(pa.array(right)), pa.array(value)], schema=schema)

    return pairs


def _candidates(codes: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(table, rows of low, rows of high) that share a bucket; all of both as table -1 if buckets would compare more."""
    def sizes(rows: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
        return np.unique(codes[rows, t], return_counts=True)

    work = 0
    for t in range(codes.shape[1]):
        (a, n), (b, m) = sizes(low, t), sizes(high, t)
        _, x, y = np.intersect1d(a, b, assume_unique=True, return_indices=True)
        work += int(n[x] @ m[y])
    if work >= len(low) * len(high):
        yield -1, low, high
        return
    for t in range(codes.shape[1]):
        left, right = (rows[np.argsort(codes[rows, t], kind="stable")] for rows in (low, high))
        a, b = codes[left, t], codes[right, t]
        for code in np.intersect1d(a, b):
            yield t, *(
                rows[np.searchsorted(c, code) : np.searchsorted(c, code, side="right")] for rows, c in ((left, a), (right, b))
            )


def _part_kernel(normals: np.ndarray, n_tables: int, planes: int, threshold: float, id_type: pa.DataType):
    schema = pa.schema([("earlier", id_type), ("later", id_type), ("similarity", pa.float64())])
    kind = np.uint16 if planes <= 16 else np.int64
    powers = 1 << np.arange(planes, dtype=np.int64)

    def coded(rows: np.ndarray) -> np.ndarray:
        sides = rows.astype(np.float64) @ normals > 0
        return (sides.reshape(len(rows), n_tables, planes) @ powers).astype(kind)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        ids = table.column("id").combine_chunks()
        vecs = vectors_of(table.column("vec"))
        step = max(1, STRIP // normals.shape[1])
        codes = np.concatenate([coded(vecs[at : at + step]) for at in range(0, len(vecs), step)])
        unit = unit_rows(vecs)
        rank = np.empty(len(ids), dtype=np.int64)
        rank[np.argsort(ids.to_numpy(zero_copy_only=False), kind="stable")] = np.arange(len(ids))
        part = table.column("part").to_numpy()
        one, two = (table.column(c)[0].as_py() for c in ("low", "high"))
        for at, low, high in _candidates(codes, np.flatnonzero(part == one), np.flatnonzero(part == two)):
            step = max(1, STRIP // len(high))
            for some in (low[i : i + step] for i in range(0, len(low), step)):
                sims = unit[some] @ unit[high].T
                keep = sims > threshold
                if one == two:
                    keep &= rank[some][:, None] < rank[high][None, :]
                r, c = np.nonzero(keep)
                for i in range(0, len(r), 1 << 16):
                    left, right = some[r[i : i + (1 << 16)]], high[c[i : i + (1 << 16)]]
                    value = sims[r[i : i + (1 << 16)], c[i : i + (1 << 16)]]
                    # bucket by bucket, a pair that met in an earlier table was given out there
                    met = (codes[left, : None if at < 0 else at] == codes[right, : None if at < 0 else at]).any(axis=1)
                    new = met if at < 0 else ~met
                    left, right, value = left[new], right[new], value[new]
                    swap = rank[left] > rank[right]
                    left, right = np.where(swap, right, left), np.where(swap, left, right)
                    if len(left):
                        yield pa.RecordBatch.from_arrays(
                            [ids.take(pa.array(left)), ids.take(pa.array(right)), pa.array(value)], schema=schema
                        )

    return pairs


def _pairs_of_parts(vectors: DataFrame, n_parts: int, kernel) -> DataFrame:
    """Every part of the vectors meets every part, itself included; a vector is carried ``n_parts`` times."""
    meets = F.explode(F.sequence(F.lit(0), F.lit(n_parts - 1))).alias("_other")
    spread = vectors.select("id", "vec", F.pmod(F.xxhash64("id"), F.lit(n_parts)).cast("int").alias("part"), meets)
    tasks = spread.select("id", "vec", "part", F.least("part", "_other").alias("low"), F.greatest("part", "_other").alias("high"))
    kind = vectors.schema["id"].dataType.simpleString()
    return tasks.groupBy("low", "high").applyInArrow(kernel, f"earlier {kind}, later {kind}, similarity double")


def bucket_pairs(
    vectors: DataFrame, threshold: float, n_rows: int, miss: float = MISS, bucket_rows: int = BUCKET_ROWS,
    block_rows: int = BLOCK_ROWS, part_rows: int = PART_ROWS, seed: int = SEED,
) -> DataFrame:
    """(earlier, later, similarity) over ``vectors`` (id, vec), which hold no equal vectors; each pair once.

    A vector is carried once per part or once per table, whichever is less. Buckets have ``bucket_rows`` vectors where directions are
    spread evenly; a larger one is compared in full, as pairs of blocks in tasks of their own.
    """
    threshold = check_threshold(threshold)
    first = vectors.first()
    width = len(first["vec"]) if first else 1
    planes = max(MIN_PLANES, math.ceil(math.log2(max(1, n_rows) / bucket_rows)))
    n_tables = tables_needed(threshold, planes, miss)
    if 8 * width * planes * n_tables > PLANE_BYTES:
        raise ValueError(f"{n_tables} tables of {planes} planes at {width} dimensions: raise the threshold, the miss or bucket_rows")
    normals = np.random.default_rng(seed).standard_normal((width, n_tables * planes))
    id_type = vectors.schema["id"].dataType
    part_rows = max(1, min(part_rows, PART_BYTES // (12 * width + (2 if planes <= 16 else 8) * n_tables)))
    n_parts = max(1, -(-n_rows // part_rows), min(PARTS, n_rows // block_rows))
    if n_parts <= n_tables:
        return _pairs_of_parts(vectors, n_parts, _part_kernel(normals, n_tables, planes, threshold, to_arrow_type(id_type)))
    coded = save_table(vectors.withColumn("codes", _codes_udf(normals, n_tables, planes)("vec")), "codes")
    spots = coded.select("id", F.posexplode("codes").alias("table_no", "code"))
    # the number of blocks comes from the counts of narrow rows; small buckets need no entry
    large = spots.groupBy("table_no", "code").agg(F.count(F.lit(1)).alias("_size")).filter(F.col("_size") > block_rows)
    blocks = save_table(large.select("table_no", "code", F.ceil(F.col("_size") / block_rows).cast("int").alias("_n")), "buckets")
    # at most n_tables * n_rows / block_rows rows, so no hint: the optimizer sees the stored size
    placed = coded.select("id", "vec", "codes", F.posexplode("codes").alias("table_no", "code")).join(blocks, ["table_no", "code"], "left")
    placed = placed.withColumn("_n", F.coalesce("_n", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("id"), F.col("_n")).cast("int"))
    meets = F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_other")
    tasks = placed.select("id", "vec", "codes", "table_no", "code", "block", meets).select(
        "id", "vec", "codes", "table_no", "code", "block", F.least("block", "_other").alias("low"), F.greatest("block", "_other").alias("high"),
    )
    return tasks.groupBy("table_no", "code", "low", "high").applyInArrow(
        _bucket_kernel(threshold, to_arrow_type(id_type)),
        f"earlier {id_type.simpleString()}, later {id_type.simpleString()}, similarity double",
    )


def lsh_pairs(df: DataFrame, id_col: str, vec_col: str, threshold: float, **options) -> DataFrame:
    """Similar pairs by distinct vector, as ``cosine_pairs``: (earlier, later, similarity, n_pairs).

    No pair at or below the threshold; of those above, each is missed with a chance of at most ``miss``. Copies
    of a vector are never missed. Zero, missing and non-finite vectors match nothing.
    """
    _, groups, distinct, n_distinct = equal_groups(df, id_col, vec_col)
    return with_copies(bucket_pairs(distinct, threshold, n_distinct, **options), groups)
