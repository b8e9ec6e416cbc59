"""Session set-up, shared-folder file access and block splitting of hot buckets."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framesift.session import ship_package

WORDS = r"[^\x20\x09-\x0D]+"
BATCH_BYTES = "8m"  # Arrow batches are cut by bytes, so long texts cannot pile up in a task
BATCH_ROWS = "2000"


def prepare(spark: SparkSession, batch_bytes: str = BATCH_BYTES) -> None:
    """Give the workers the package and bound the Arrow batches unless the user has done so."""
    ship_package(spark)
    for key, value in (
        ("spark.sql.execution.arrow.maxBytesPerBatch", batch_bytes),
        ("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS),
    ):
        if not spark.conf.get(f"framesift.set.{key}", None):
            spark.conf.set(f"framesift.set.{key}", "1")
            spark.conf.set(key, value)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def arrow_schema(ddl: str):
    """Arrow schema of a DDL string; made on the driver and shipped with the function that uses it."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def giving_back(fn: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``fn`` over the batches of a task, whose worker gives freed memory back to the system at the end.

    Python workers wait for further tasks, more of them than there are cores; what the C library keeps
    for them would count against the memory of the executor all the while.
    """

    def run(batches: Iterator) -> Iterator:
        yield from fn(batches)
        give_back()

    return run


def give_back() -> None:
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only the GNU C library has it
    if trim is not None:
        trim(0)


def open_folder(uri: str):
    """(file system, path) of a folder or file that all machines see (file:, hdfs:, s3:, gs:)."""
    from pyarrow import fs

    if match := re.match(r"file:/+(.*)", uri):
        return fs.LocalFileSystem(), "/" + match[1]
    if uri.startswith("/"):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z; all other characters stay."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def in_blocks(rows: DataFrame, keys: Sequence[str], by: Column, block_rows: int) -> DataFrame:
    """Rows of buckets with at least two rows, so that every two rows of a bucket meet once.

    A bucket of more than ``block_rows`` rows is cut into blocks; each row goes to every pair of
    blocks it belongs to. ``_i``, ``_j`` name the pair of blocks and ``_at`` the row's own one:
    rows meet where ``_i = _j`` or their ``_at`` differ. No task ever holds a whole hot bucket.
    """
    keys = list(keys)
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    counts = counts.select(*keys, F.ceil(F.col("_n") / F.lit(block_rows)).cast("int").alias("_b"))
    cut = rows.join(counts, keys).withColumn("_at", F.pmod(F.xxhash64(by), F.col("_b")).cast("int"))
    cut = cut.withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_b") - 1)))
    return cut.select(
        "*", F.least("_at", "_k").alias("_i"), F.greatest("_at", "_k").alias("_j")
    ).drop("_k", "_b")


def runs(batches: Iterator, keys: Sequence[str]) -> Iterator:
    """Arrow batches of rows sorted by ``keys`` -> Arrow tables that hold whole key groups."""
    import pyarrow as pa

    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = pa.Table.from_batches([batch])
        now = pa.concat_tables([held, now]) if held is not None else now
        change = group_starts(now, keys)
        last = int(change[-1])
        if last:
            yield now.slice(0, last)
        held = now.slice(last)
    if held is not None and held.num_rows:
        yield held


def group_starts(rows, keys: Sequence[str]) -> np.ndarray:
    """First row of each key group of a sorted Arrow table."""
    new = np.zeros(rows.num_rows, bool)
    new[:1] = True
    for key in keys:
        values = rows.column(key).to_numpy()
        new[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(new)


def pairs_in_runs(starts: np.ndarray, n: int, most: int = 1_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (i, j), i < j, of all pairs inside each group, in slices of bounded size."""
    ends = np.append(starts[1:], n)
    end = np.repeat(ends, ends - starts)
    left = np.arange(n)
    step = 1
    out_i, out_j, size = [], [], 0
    while True:
        left = left[left + step < end[left]]
        if not len(left):
            break
        for at in range(0, len(left), most):
            part = left[at : at + most]
            out_i.append(part)
            out_j.append(part + step)
            size += len(part)
            if size >= most:
                yield np.concatenate(out_i), np.concatenate(out_j)
                out_i, out_j, size = [], [], 0
        step += 1
    if size:
        yield np.concatenate(out_i), np.concatenate(out_j)
