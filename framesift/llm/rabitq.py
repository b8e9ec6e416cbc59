"""Nearest vectors by randomly rotated one-bit codes with error bounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framesift.llm.vectors import fitting_sample, matrix, same_length, usable
from framesift.session import save_table

K = 10
BOUND = 3.0  # standard errors of an estimate that its bound allows for
QUERIES_PER_PASS = 8192  # queries sent to the tasks at a time: 4 MB at 64 dimensions
BLOCK_ROWS = 512
SEED = 3

INDEX = "id long, code binary, length double, fit double, vec array<double>"
FOUND = "query_id long, vec_id long, score double"


def rotation(dims: int) -> np.ndarray:
    turn, _ = np.linalg.qr(np.random.default_rng(SEED).standard_normal((dims, dims)))
    return turn


def build_index(vectors: DataFrame, centre: np.ndarray, turn: np.ndarray) -> DataFrame:
    """Packed signs of each centred and rotated vector, its length, and its product with its code."""
    dims = len(centre)

    def encode(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column(1), dims) - centre
            length = np.linalg.norm(x, axis=1)
            turned = (x / np.maximum(length, 1e-300)[:, None]) @ turn
            packed = np.packbits(turned >= 0, axis=1)
            fit = np.abs(turned).sum(axis=1) / np.sqrt(dims)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([r.tobytes() for r in packed]), pa.array(length), pa.array(fit), batch.column(1)],
                names=["id", "code", "length", "fit", "vec"],
            )

    return save_table(vectors.select("id", "vec").mapInArrow(encode, INDEX), "rabitq-index")


def best(query: np.ndarray, vec: np.ndarray, squared: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The k nearest entries of each query, ties to the smaller id."""
    order = np.lexsort((vec, squared, query))
    query, vec, squared = query[order], vec[order], squared[order]
    first = np.flatnonzero(np.append(True, query[1:] != query[:-1])) if len(query) else np.empty(0, int)
    place = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query))))
    keep = place < k
    return query[keep], vec[keep], squared[keep]


def scan(index: DataFrame, query_ids: np.ndarray, queries: np.ndarray, centre: np.ndarray, turn: np.ndarray, k: int) -> DataFrame:
    """query_id, vec_id, score: up to k rows for each query and task of the index."""
    dims = len(centre)
    moved = queries - centre
    reach = np.linalg.norm(moved, axis=1)
    turned = ((moved / np.maximum(reach, 1e-300)[:, None]) @ turn / np.sqrt(dims)).astype(np.float32).T.copy()

    def search(batches: Iterator) -> Iterator:
        import pyarrow as pa

        n = len(query_ids)
        top = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        worst = np.full(n, np.inf)  # squared distance of a query's k-th nearest so far
        for batch in batches:
            for low in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(low, BLOCK_ROWS)
                ids, x = part.column(0).to_numpy(), matrix(part.column(4), dims)
                bits = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint8).reshape(len(ids), -1)
                signs = np.unpackbits(bits, axis=1, count=dims).astype(np.float32) * 2 - 1
                length, fit = part.column(2).to_numpy(), np.maximum(part.column(3).to_numpy(), 1e-12)
                product = (signs @ turned) / fit[:, None]
                error = BOUND * np.sqrt(np.maximum(0.0, 1 - fit * fit)) / (fit * np.sqrt(max(1, dims - 1)))
                base = length[:, None] ** 2 + reach**2
                scale = 2 * length[:, None] * reach
                own = ids[:, None] == query_ids
                upper = np.where(own, np.inf, base - scale * (product - error[:, None]))
                if len(ids) > k:
                    limit = np.minimum(worst, np.partition(upper, k - 1, axis=0)[k - 1])
                else:
                    limit = worst
                lower = base - scale * (product + error[:, None])
                row, col = np.nonzero((lower <= limit * (1 + 1e-6) + 1e-9) & ~own)
                squared = np.empty(len(row))
                for at in range(0, len(row), 100_000):
                    r, c = row[at : at + 100_000], col[at : at + 100_000]
                    squared[at : at + 100_000] = ((x[r] - queries[c]) ** 2).sum(axis=1)
                top = best(
                    np.concatenate([top[0], col]), np.concatenate([top[1], ids[row]]), np.concatenate([top[2], squared]), k
                )
                count = np.bincount(top[0], minlength=n)
                last = np.cumsum(count) - 1
                full = count == k
                worst[full] = top[2][last[full]]
        if len(top[0]):
            yield pa.RecordBatch.from_arrays(
                [pa.array(query_ids[top[0]]), pa.array(top[1]), pa.array(np.sqrt(top[2]))], names=["query_id", "vec_id", "score"]
            )

    return index.mapInArrow(search, FOUND)


def nearest_vectors(
    embeddings: DataFrame, is_query, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows by Euclidean distance of each query row.

    ``is_query`` maps the id column to a condition. All rows are indexed: vectors are centred on
    the mean of a bounded sample, rotated at random and reduced to their signs. A task estimates
    the distances between its codes and the queries, and takes the exact distance, in double
    precision, of every vector whose lower bound reaches the k-th nearest found so far. Queries
    are sent to the tasks in passes of about QUERIES_PER_PASS, whatever their number.

    Null, zero and non-finite vectors and rows without id take no part. Shorter vectors are filled up
    with zeros. Ties go to the smaller id; a query never finds a row with its own id. Of rows
    repeated under one id each may be found, and the least vector (component by component) asks. Further
    columns are ignored.
    """
    rows = embeddings.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"))
    rows, dims = same_length(rows.filter(usable(F.col("vec")) & F.col("id").isNotNull()))
    spark = embeddings.sparkSession
    if not dims:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    centre, turn = fitting_sample(rows, dims).mean(axis=0), rotation(dims)
    index = build_index(rows, centre, turn)
    queries = index.filter(is_query(F.col("id"))).groupBy("id").agg(F.min("vec").alias("vec"))
    asked = save_table(queries, "rabitq-queries")
    passes = max(1, -(-asked.count() // QUERIES_PER_PASS))
    found = spark.createDataFrame([], FOUND)
    for number in range(passes):
        mine = asked.filter(F.pmod(F.xxhash64("id"), F.lit(passes)) == number).toArrow()
        ids = mine.column("id").to_numpy()
        if len(ids):
            found = found.unionByName(scan(index, ids, matrix(mine.column("vec"), dims), centre, turn, k))
    nearest = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(nearest)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
