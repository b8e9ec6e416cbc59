"""Exact cosine join: all pairs of distinct vectors with similarity above a threshold.

Vectors are divided into cells around pivots. Two vectors on different sides of the plane
between two pivots are at least as far apart as either is from that plane, so a vector has
to visit only the cells whose plane is nearer than the distance that belongs to the
threshold. A cell that is still too large is divided again around pivots of its own, so the
pivots form a tree as deep as the data asks for. Pairs are compared inside cells, block
against block, with one matrix product per pair of bounded blocks. Equal vectors are joined
once, not copy by copy.
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

from framesift.operators.skew import join_to_unique
from framesift.session import save_table

BLOCK_ROWS = 4096  # rows per block of a cell; a task holds two blocks
CELL_ROWS = 50_000  # aimed at vectors per cell
PIVOT_BYTES = 64 << 20  # bound on the pivot matrix shipped with the tasks
MAX_PIVOTS = 1024  # pivots of the first level
FANOUT = 32  # pivots of a cell that is divided again
MAX_LEVELS = 11  # keeps cell numbers below 2^63: MAX_PIVOTS * 2 * FANOUT^10
SPLIT_ROWS = 1024  # vectors placed at a time
WORTH = 0.9  # a division is kept if it leaves at most this share of the pairs to compare
SLACK = 1e-6  # keeps rounding from pruning a pair at the very border


def check_threshold(threshold: float) -> float:
    if not -1.0 < threshold < 1.0:
        raise ValueError("the similarity threshold must lie between -1 and 1")
    return float(threshold)


def usable_vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec) of rows whose vector has a length; a zero or missing vector matches nothing."""
    vec = F.col(vec_col)
    return df.select(F.col(id_col).alias("id"), vec.alias("vec")).filter(
        vec.isNotNull() & F.exists(vec, lambda v: v != 0) & ~F.exists(vec, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    )


def vector_groups(vectors: DataFrame) -> DataFrame:
    """(id, rep, copies): rep is the first id among equal vectors.

    Vectors are compared by two independent hashes, 96 bits together, so only the narrow
    keys are shuffled; only keys that occur twice or more are joined back.
    """
    keyed = save_table(vectors.select("id", F.xxhash64("vec").alias("k1"), F.hash("vec").alias("k2")), "keys")
    equal = save_table(
        keyed.groupBy("k1", "k2")
        .agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"))
        .filter(F.col("copies") > 1),
        "equal",
    )
    return join_to_unique(keyed, equal, ["k1", "k2"], "left", weight="copies").select(
        "id", F.coalesce("rep", "id").alias("rep"), F.coalesce("copies", F.lit(1)).alias("copies")
    )


def unit_rows(rows: np.ndarray) -> np.ndarray:
    rows = rows.astype(np.float64)
    return rows / np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]


def choose_pivots(vectors: DataFrame, n_rows: int, cell_rows: int = CELL_ROWS) -> np.ndarray | None:
    """Pivots from a bounded sample of ids with the lowest hashes; None when one cell is enough.

    Sample vectors close to a chosen pivot are left out, so a large group of near copies
    gets one pivot and not many.
    """
    if n_rows <= cell_rows:
        return None
    width = len(vectors.first()["vec"])
    wanted = min(MAX_PIVOTS, -(-n_rows // cell_rows), max(2, PIVOT_BYTES // (8 * width)))
    share = min(1.0, 8.0 * wanted / n_rows)
    spot = F.pmod(F.xxhash64("id"), F.lit(1 << 30))
    sample = vectors.filter(spot < int(share * (1 << 30)) + 1).orderBy(spot, "id").limit(4 * wanted)
    rows = sample.select("vec").toPandas()["vec"]  # at most 4 * MAX_PIVOTS rows
    if len(rows) < 2:
        return None
    units = unit_rows(np.stack(rows.to_numpy()))
    return units[spread_out(units, wanted)]


def spread_out(units: np.ndarray, wanted: int) -> list[int]:
    """Farthest-first: each next pivot is the vector least similar to those chosen."""
    chosen = [0]
    nearest = units @ units[0]
    while len(chosen) < wanted:
        far = int(np.argmin(nearest))
        if nearest[far] > 1 - 1e-9:
            break
        chosen.append(far)
        nearest = np.maximum(nearest, units @ units[far])
    return chosen


def visited_cells(units: np.ndarray, pivots: np.ndarray, threshold: float) -> tuple[np.ndarray, list[np.ndarray]]:
    """The home of each vector, and the other cells it has to visit."""
    radius = math.sqrt(2.0 - 2.0 * threshold) + SLACK
    apart = np.sqrt(np.maximum(2.0 - 2.0 * (pivots @ pivots.T), 0.0))
    scores = units @ pivots.T
    home = scores.argmax(axis=1)
    lead = scores[np.arange(len(home)), home][:, None] - scores
    visit = lead <= radius * apart[home]
    # a pair across two cells meets in the higher one
    visit &= np.arange(len(pivots))[None, :] > home[:, None]
    return home.astype("int32"), [np.flatnonzero(v).astype("int32") for v in visit]


def _cells_udf(pivots: np.ndarray, threshold: float):
    @F.pandas_udf("struct<home int, visits array<int>>")
    def cells(vec: pd.Series) -> pd.DataFrame:
        home, visits = visited_cells(unit_rows(np.stack(vec.to_numpy())), pivots, threshold)
        return pd.DataFrame({"home": home, "visits": visits})

    return cells


def vectors_of(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def cell_pivots(placed: DataFrame, big: DataFrame) -> DataFrame:
    """(cell, flat, n_pivots): pivots of each cell in ``big`` (cell, _size, _wanted), from about 8 * FANOUT of its vectors."""
    spot = F.pmod(F.xxhash64("id", "cell"), F.lit(1 << 30))
    sample = placed.join(big, "cell").filter(spot <= F.lit(8.0 * FANOUT * (1 << 30)) / F.col("_size"))

    def choose(key: tuple, table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("_spot").to_numpy(), kind="stable")
        units = unit_rows(vectors_of(table.column("vec")))[order]
        chosen = spread_out(units, table.column("_wanted")[0].as_py())
        names, types = ["cell", "flat", "n_pivots"], [pa.int64(), pa.list_(pa.float64()), pa.int32()]
        made = [[key[0].as_py()], [units[chosen].ravel()], [len(chosen)]]
        return pa.Table.from_arrays([pa.array(v, t) for v, t in zip(made, types)], names=names)

    chosen = sample.select("cell", "_wanted", spot.alias("_spot"), "vec").groupBy("cell")
    return chosen.applyInArrow(choose, "cell long, flat array<double>, n_pivots int").filter(F.col("n_pivots") > 1)


def divide_cells(placed: DataFrame, pivots: DataFrame, threshold: float, level: int) -> DataFrame:
    """(id, vec, parent, cell, native): the members of cells with pivots (cell, flat, n_pivots, _size), in the cells below."""
    chunks = F.ceil(F.col("_size") / SPLIT_ROWS).cast("int")
    counts = pivots.select("cell", chunks.alias("_n"))
    left = placed.join(counts, "cell").withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("_n")).cast("int")).drop("_n")
    right = pivots.select("cell", "flat", "n_pivots", F.explode(F.sequence(F.lit(0), chunks - 1)).alias("chunk"))
    id_type = placed.schema["id"].dataType
    vec_type = placed.schema["vec"].dataType
    schema = pa.schema([
        ("id", to_arrow_type(id_type)), ("vec", to_arrow_type(vec_type)), ("parent", pa.int64()), ("native", pa.int32()),
        ("home", pa.int32()), ("visits", pa.list_(pa.int32())),
    ])

    def place(rows: pa.Table, chosen: pa.Table) -> pa.Table:
        if not rows.num_rows or not chosen.num_rows:
            return schema.empty_table()
        points = np.asarray(chosen.column("flat")[0].values).reshape(chosen.column("n_pivots")[0].as_py(), -1)
        home, visits = visited_cells(unit_rows(vectors_of(rows.column("vec"))), points, threshold)
        return pa.Table.from_arrays(
            [rows.column("id"), rows.column("vec"), rows.column("cell"), rows.column("native"), pa.array(home),
             pa.array(visits, pa.list_(pa.int32()))], schema=schema,
        )

    spots = left.groupBy("cell", "chunk").cogroup(right.groupBy("cell", "chunk")).applyInArrow(
        place, f"id {id_type.simpleString()}, vec {vec_type.simpleString()}, parent long, native int, home int, visits array<int>"
    )
    below = spots.select("id", "vec", "parent", "native", "home", F.explode(F.concat(F.array("home"), "visits")).alias("at"))
    native = F.col("native") + F.when(F.col("at") == F.col("home"), 1 << level).otherwise(0)
    return below.select("id", "vec", "parent", (F.col("parent") * FANOUT + F.col("at")).alias("cell"), native.alias("native"))


def small_cells(placed: DataFrame, threshold: float, cell_rows: int) -> DataFrame:
    """(id, vec, cell, native, whole, _size) with cells of at most ``cell_rows``, where dividing helps.

    ``native`` has a bit for each level at which the vector is at home in its cell. Two members of
    a cell are a pair of that cell if at each level one of them is at home: ``whole`` has all these
    bits. Levels are divided one after the other, all large cells of a level at once. A cell whose
    division would leave more than WORTH of its pairs stays whole and is compared in blocks.
    """
    done = None
    for level in range(1, MAX_LEVELS + 1):
        sizes = save_table(placed.groupBy("cell").agg(F.count(F.lit(1)).alias("_size")), "sizes")
        wanted = F.least(F.lit(FANOUT), F.ceil(F.col("_size") / cell_rows) + 1).cast("int").alias("_wanted")
        big = sizes.filter(F.col("_size") > cell_rows).select("cell", "_size", wanted)
        rest = placed.join(sizes, "cell").withColumn("whole", F.lit((1 << level) - 1))
        if level == MAX_LEVELS or not big.head(1):
            return rest if done is None else done.unionByName(rest)
        pivots = save_table(cell_pivots(placed, big).join(big.select("cell", "_size"), "cell"), "pivots")
        below = save_table(divide_cells(placed, pivots, threshold, level), "cells")
        pairs = below.groupBy("parent", "cell").agg(F.count(F.lit(1)).alias("n")).groupBy("parent").agg(
            F.sum(F.col("n").cast("double") * F.col("n")).alias("_left")
        )
        better = F.col("_left") <= F.lit(WORTH) * F.col("_size").cast("double") * F.col("_size")
        split = save_table(pairs.join(big, pairs["parent"] == big["cell"]).filter(better).select("parent"), "split")
        stay = rest.join(split.withColumnRenamed("parent", "cell"), "cell", "left_anti")
        done = stay if done is None else done.unionByName(stay)
        placed = below.join(split, "parent", "left_semi").drop("parent")
    raise AssertionError("the last level returns")


def _pair_kernel(threshold: float, id_type: pa.DataType):
    schema = pa.schema([("earlier", id_type), ("later", id_type), ("similarity", pa.float64())])

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        n = table.num_rows
        ids = table.column("id").combine_chunks()
        unit = unit_rows(vectors_of(table.column("vec")))
        native = table.column("native").to_numpy()
        whole = table.column("whole")[0].as_py()
        block = table.column("block").to_numpy()
        key = ids.to_numpy(zero_copy_only=False)
        rank = np.empty(n, dtype=np.int64)
        rank[np.argsort(key, kind="stable")] = np.arange(n)
        low = np.flatnonzero(block == table.column("low")[0].as_py())
        high = np.flatnonzero(block == table.column("high")[0].as_py())
        same = table.column("low")[0] == table.column("high")[0]
        for at in range(0, len(low), 1024):
            part = low[at : at + 1024]
            sims = unit[part] @ unit[high].T
            keep = sims > threshold
            keep &= (native[part][:, None] | native[high][None, :]) == whole
            if same:
                keep &= rank[part][:, None] < rank[high][None, :]
            r, c = np.nonzero(keep)
            left, right = part[r], high[c]
            swap = rank[left] > rank[right]
            left, right = np.where(swap, right, left), np.where(swap, left, right)
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(left)), ids.take(pa.array(right)), pa.array(sims[r, c])], schema=schema
            )

    return pairs


def distinct_pairs(
    vectors: DataFrame,
    threshold: float,
    n_rows: int,
    block_rows: int = BLOCK_ROWS,
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """(earlier, later, similarity) over ``vectors`` (id, vec), which hold no equal vectors.

    The work is a product of blocks, so it grows with the pairs of vectors that share a
    cell; the result grows with the pairs above the threshold.
    """
    threshold = check_threshold(threshold)
    pivots = choose_pivots(vectors, n_rows, cell_rows)
    if pivots is None:
        first = [F.lit(v).alias(c) for c, v in (("cell", 0), ("native", 1), ("whole", 1))]
        placed = vectors.select("id", "vec", *first)
        n_blocks = F.lit(max(1, -(-n_rows // block_rows)))
    else:
        spot = vectors.withColumn("_at", _cells_udf(pivots, threshold)("vec"))
        cells = F.explode(F.concat(F.array("_at.home"), F.col("_at.visits")))
        placed = spot.select("id", "vec", F.col("_at.home").alias("_home"), cells.alias("_cell")).select(
            "id", "vec", (F.col("_cell") + F.lit(MAX_PIVOTS)).cast("long").alias("cell"),
            (F.col("_cell") == F.col("_home")).cast("int").alias("native"),
        )
        placed = small_cells(save_table(placed, "cells"), threshold, cell_rows)
        n_blocks = F.ceil(F.col("_size") / F.lit(block_rows))
    blocked = placed.withColumn("_n", n_blocks.cast("int")).withColumn(
        "block", F.pmod(F.xxhash64("id"), F.col("_n")).cast("int")
    )
    meets = F.explode(F.sequence(F.lit(0), F.col("_n") - 1))
    tasks = blocked.select("id", "vec", "cell", "native", "whole", "block", meets.alias("_other")).select(
        "id", "vec", "cell", "native", "whole", "block",
        F.least("block", "_other").alias("low"), F.greatest("block", "_other").alias("high"),
    )
    id_type = vectors.schema["id"].dataType
    kernel = _pair_kernel(threshold, to_arrow_type(id_type))
    return tasks.groupBy("cell", "low", "high").applyInArrow(
        kernel, f"earlier {id_type.simpleString()}, later {id_type.simpleString()}, similarity double"
    )


def equal_groups(df: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """Vectors (id, vec), stored groups of equal ones (id, rep, copies), stored distinct
    vectors (the first of each group), and their number."""
    vectors = usable_vectors(df, id_col, vec_col)
    groups = save_table(vector_groups(vectors), "groups")
    firsts = groups.filter(F.col("id") == F.col("rep")).select("id")
    distinct = save_table(vectors.join(firsts, "id", "left_semi"), "vectors")
    return vectors, groups, distinct, distinct.count()


def cosine_pairs(df: DataFrame, id_col: str, vec_col: str, threshold: float, **sizes: int) -> DataFrame:
    """Similar pairs by distinct vector: (earlier, later, similarity, n_pairs).

    ``n_pairs`` counts the pairs of copies a row stands for; a group of equal vectors gives
    one row with both ends equal. Copies are thus never written out pair by pair.
    """
    _, groups, distinct, n_distinct = equal_groups(df, id_col, vec_col)
    return with_copies(save_table(distinct_pairs(distinct, threshold, n_distinct, **sizes), "edges"), groups)


def with_copies(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """Pairs of distinct vectors with the pairs of copies they stand for, and a row per group of copies."""
    firsts = groups.filter(F.col("id") == F.col("rep")).select("rep", "copies")
    # stored, so that the optimizer sees their size: without many copies the pairs are not shuffled
    copied = save_table(firsts.filter(F.col("copies") > 1), "copied")
    left = copied.select(F.col("rep").alias("earlier"), F.col("copies").alias("_a"))
    right = copied.select(F.col("rep").alias("later"), F.col("copies").alias("_b"))
    one = F.lit(1).cast("long")
    across = edges.join(left, "earlier", "left").join(right, "later", "left").select(
        "earlier", "later", "similarity", (F.coalesce("_a", one) * F.coalesce("_b", one)).alias("n_pairs")
    )
    within = copied.select(
        F.col("rep").alias("earlier"), F.col("rep").alias("later"), F.lit(1.0).alias("similarity"),
        (F.col("copies") * (F.col("copies") - 1) / 2).cast("long").alias("n_pairs"),
    )
    return across.unionByName(within)
