"""Greedy matching where most images have many partners: arrivals chunk by chunk, without a list of links.

Images that are free at the same time are never similar to each other, so where links are many, few images
are free. An image therefore is compared with the free ones only, and not with all that came before it.
Chunks of bounded size follow one another in id order:

1. The vectors of a chunk are compared with those free before it, block against block, side by side.
2. One task visits the images of the chunk in order; it holds their vectors and the hits of step 1, and compares
   an image only with those that the chunk itself left free.
3. What is free then goes to the next chunk.

Near copies and equal vectors need no care: at most one of a group is free at any time.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from framesift.functions.vectors import cosine
from framesift.operators.similarity import BLOCK_ROWS, unit_rows, vectors_of
from framesift.session import save_table

CHUNK_ROWS = 32_768  # images that one task visits in order
CHUNK_BYTES = 256 << 20  # bound on their vectors
PART_ROWS = 512  # images compared with the free ones at a time
DENSE_LINKS = 20.0  # mean number of partners from which on chunks are the better way
LISTED_LINKS = 200.0  # the same for the pairs that a list of links starts from
SAMPLE_ROWS = 512
SAMPLE_BYTES = 16 << 20  # bound on the sample shipped with the tasks


def mean_links(vectors: DataFrame, thresholds: Sequence[float], n_rows: int) -> list[float]:
    """About the mean number of partners of a vector at each threshold: those of a bounded sample, counted among all rows."""
    first = vectors.first()
    none = [0.0] * len(thresholds)
    if first is None:
        return none
    wanted = max(1, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * len(first["vec"]))))
    spot = F.pmod(F.xxhash64("id"), F.lit(1 << 30))
    share = min(1.0, 4.0 * wanted / n_rows)
    few = vectors.filter(spot < int(share * (1 << 30)) + 1).orderBy(spot, "id").limit(wanted)
    rows = few.select("vec").toPandas()["vec"]  # at most SAMPLE_ROWS rows
    if not len(rows):
        return none
    sample = unit_rows(np.stack(rows.to_numpy()))

    def count(batches):
        for batch in batches:
            if batch.num_rows:
                unit = unit_rows(vectors_of(pa.chunked_array([batch.column(0)])))
                sims = unit @ sample.T
                yield pa.RecordBatch.from_arrays([pa.array([int((sims > t).sum())]) for t in thresholds], names=names)

    names = [f"hits{i}" for i in range(len(thresholds))]
    counted = vectors.select("vec").mapInArrow(count, ", ".join(f"{x} long" for x in names))
    hits = counted.agg(*[F.coalesce(F.sum(x), F.lit(0)) for x in names]).first()
    return [max(0.0, n / len(sample) - 1.0) for n in hits]  # each vector meets itself


def hits_of_free(now: DataFrame, free: DataFrame, threshold: float, n_now: int, block_rows: int) -> DataFrame:
    """(row, kept): the free images that an image of the chunk is similar to."""
    n_free = free.count()
    blocks = [max(1, -(-n // block_rows)) for n in (n_now, n_free)]

    def dealt(df: DataFrame, own: str, other: str, n_own: int, n_other: int) -> DataFrame:
        meets = F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))).alias(other)
        return df.select("row", "vec", F.pmod(F.xxhash64("row"), F.lit(n_own)).cast("int").alias(own), meets)

    left, right = dealt(now, "low", "high", *blocks), dealt(free, "high", "low", *blocks[::-1])
    schema = pa.schema([("row", pa.int64()), ("kept", pa.int64())])

    def compare(chunk: pa.Table, others: pa.Table) -> pa.Table:
        if not chunk.num_rows or not others.num_rows:
            return schema.empty_table()
        rows, kept = chunk.column("row").to_numpy(), others.column("row").to_numpy()
        unit, against = unit_rows(vectors_of(chunk.column("vec"))), unit_rows(vectors_of(others.column("vec")))
        found = [np.nonzero(unit[at : at + 1024] @ against.T > threshold) for at in range(0, len(rows), 1024)]
        r = np.concatenate([r + 1024 * i for i, (r, _) in enumerate(found)])
        c = np.concatenate([c for _, c in found])
        return pa.Table.from_arrays([pa.array(rows[r]), pa.array(kept[c])], schema=schema)

    return left.groupBy("low", "high").cogroup(right.groupBy("low", "high")).applyInArrow(compare, "row long, kept long")


def visit(unit: np.ndarray, before: list[list[int]], threshold: float) -> tuple[list[tuple[int, int, bool]], np.ndarray]:
    """Visits the rows of ``unit`` in order: (moved, kept, whether kept was free before), and the rows left free.

    ``before`` has the images free before the chunk that a row is similar to, first ones first; they
    come before any row of the chunk.
    """
    pairs: list[tuple[int, int, bool]] = []
    taken: set[int] = set()
    left = np.zeros(0, dtype=np.int64)  # rows of the chunk that are free, in order
    for at in range(0, len(unit), PART_ROWS):
        part = np.arange(at, min(at + PART_ROWS, len(unit)))
        seen = np.concatenate([left, part])
        alike = unit[part] @ unit[seen].T > threshold
        free = np.zeros(len(seen), dtype=bool)
        free[: len(left)] = True
        for i, own in enumerate(part.tolist()):
            old = next((k for k in before[own] if k not in taken), None)
            if old is not None:
                taken.add(old)
                pairs.append((own, old, True))
                continue
            open_ = alike[i] & free
            first = int(open_.argmax())
            if open_[first]:
                free[first] = False
                pairs.append((own, int(seen[first]), False))
            else:
                free[len(left) + i] = True
        left = seen[free]
    return pairs, left


def visit_chunk(now: DataFrame, hits: DataFrame, threshold: float) -> DataFrame:
    """(moved, kept, vec): a row per pair, and with its vector and without kept a row per image left free."""
    vec_type = now.schema["vec"].dataType
    schema = pa.schema([("moved", pa.int64()), ("kept", pa.int64()), ("vec", to_arrow_type(vec_type))])

    def run(chunk: pa.Table, near: pa.Table) -> pa.Table:
        if not chunk.num_rows:
            return schema.empty_table()
        chunk = chunk.sort_by("row")
        rows = chunk.column("row").to_numpy()
        near = near.sort_by([("row", "ascending"), ("kept", "ascending")])
        ends = np.searchsorted(near.column("row").to_numpy(), rows, side="right")
        starts = np.searchsorted(near.column("row").to_numpy(), rows, side="left")
        kept = near.column("kept").to_numpy()
        before = [kept[a:b].tolist() for a, b in zip(starts, ends)]
        vecs = chunk.column("vec").combine_chunks()
        pairs, left = visit(unit_rows(vectors_of(chunk.column("vec"))), before, threshold)
        moved = [int(rows[m]) for m, _, _ in pairs]
        other = [k if old else int(rows[k]) for _, k, old in pairs]
        made = pa.Table.from_arrays(
            [pa.array(moved, pa.int64()), pa.array(other, pa.int64()), pa.nulls(len(pairs), schema.field("vec").type)], schema=schema
        )
        free = pa.Table.from_arrays(
            [pa.array(rows[left]), pa.nulls(len(left), pa.int64()), vecs.take(pa.array(left)).cast(schema.field("vec").type)], schema=schema
        )
        return pa.concat_tables([made, free])

    one = F.lit(0).alias("chunk")  # a chunk is bounded
    return now.select("row", "vec", one).groupBy("chunk").cogroup(hits.select("row", "kept", one).groupBy("chunk")).applyInArrow(
        run, f"moved long, kept long, vec {vec_type.simpleString()}"
    )


def match_arrivals(
    vectors: DataFrame, threshold: float, n_rows: int, chunk_rows: int = CHUNK_ROWS, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Stored (moved, kept, similarity) over ``vectors`` (id, vec) of ``n_rows`` rows; rows without id take no part."""
    first = vectors.first()
    width = len(first["vec"]) if first else 1
    chunk_rows = max(1, min(chunk_rows, max(1024, CHUNK_BYTES // (8 * width))))
    n_chunks = max(1, -(-n_rows // chunk_rows))
    cut = vectors.filter("id IS NOT NULL").repartitionByRange(n_chunks, "id").sortWithinPartitions("id")
    # numbers follow the id, the partition is their upper part
    rows = save_table(cut.withColumn("row", F.monotonically_increasing_id()), "arrivals")
    free = rows.limit(0).select("row", "vec")
    sizes = {r["number"]: r["count"] for r in rows.groupBy(F.shiftright("row", 33).alias("number")).count().collect()}  # a row per chunk
    found = None
    for number in range(n_chunks):
        now = rows.filter((F.col("row") >= number << 33) & (F.col("row") < (number + 1) << 33)).select("row", "vec")
        hits = save_table(hits_of_free(now, free, threshold, sizes.get(number, 0), block_rows), "hits")
        swept = save_table(visit_chunk(now, hits, threshold), "swept")
        pairs = swept.filter("kept IS NOT NULL").select("moved", "kept")
        found = pairs if found is None else found.unionByName(pairs)
        if number + 1 < n_chunks:
            left = free.join(pairs.select(F.col("kept").alias("row")), "row", "left_anti")
            fresh = swept.filter("kept IS NULL").select(F.col("moved").alias("row"), "vec")
            free = save_table(left.select("row", "vec").unionByName(fresh), "free")
    left = rows.select(F.col("row").alias("moved"), F.col("id").alias("mid"), F.col("vec").alias("mv"))
    right = rows.select(F.col("row").alias("kept"), F.col("id").alias("kid"), F.col("vec").alias("kv"))
    both = found.join(left, "moved").join(right, "kept")
    return save_table(
        both.select(F.col("mid").alias("moved"), F.col("kid").alias("kept"), cosine(F.col("mv"), F.col("kv")).alias("similarity")), "pairs"
    )
