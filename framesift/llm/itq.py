"""Near-duplicate vectors: iterative quantisation, multi-index Hamming tables, exact reranking."""

from __future__ import annotations

from collections.abc import Iterator
from math import acos, comb, pi, sqrt

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framesift.llm.common import group_starts, in_blocks, pairs_in_runs, runs
from framesift.llm.components import connected_components
from framesift.llm.vectors import fitting_sample, matrix, same_length, usable
from framesift.session import save_table

COSINE = 0.9
BITS = 64  # of a word of a code, at every width of the vectors
MOST_WORDS = 12  # words of a code
CHUNKS = (2, 3, 4, 5, 6, 8, 10, 12, 16, 32)  # that a word may be cut into
ERRORS = 2  # differing bits up to which two chunks share a key
MISS = 0.03  # expected share of pairs at the threshold without a shared key, at most
SPREAD = 4.6  # standard deviations that the differing bits of a linked pair may lie above their mean
MEETING_COST, SURVIVOR_COST = 0.02, 3.0  # of two codes compared, of a vector carried; a key stored and sorted is 1
TRIAL_ROWS = 256  # vectors of the sample whose pairs give the share that meets by chance
BLOCK_ROWS = 1024
SPREAD_ROWS = 1024  # vectors whose keys a task lays out at a time
ITERATIONS = 50
SEED = 5


def fit_rotation(sample: np.ndarray, iterations: int = ITERATIONS, words: int = 1) -> np.ndarray:
    """Projection dims x (BITS * words): rotations turned so that the signs of the vectors lose least.

    Alternates between the codes nearest to the turned points and the rotation nearest to the codes.
    The vectors are not centred: the signs are to tell the angle between the vectors themselves,
    which is acos(cosine) / pi of the bits. With fewer dims than BITS random rotations give the
    bits that are missing; with more, random directions keep the angles, which principal axes do not.
    Each word has a rotation of its own, from another start.
    """
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    dims = unit.shape[1]
    rng = np.random.default_rng(SEED)
    parts = []
    for _ in range(words):
        axes = np.linalg.qr(rng.standard_normal((dims, min(BITS, dims))))[0]
        points = unit @ axes
        turn, _ = np.linalg.qr(rng.standard_normal((points.shape[1], points.shape[1])))
        for _ in range(iterations):
            left, _, right = np.linalg.svd(np.where(points @ turn >= 0, 1.0, -1.0).T @ points)
            turn = (left @ right).T
        word = [axes @ turn]
        word += [np.linalg.qr(rng.standard_normal((dims, dims)))[0] for _ in range(-(-BITS // dims) - 1)]
        parts.append(np.concatenate(word, axis=1)[:, :BITS])
    return np.concatenate(parts, axis=1)


def codes_of(x: np.ndarray, projection: np.ndarray) -> np.ndarray:
    """The code of each row, in words of 64 bits: rows x words."""
    place = np.uint64(1) << np.arange(BITS, dtype=np.uint64)
    return np.stack([
        (x @ projection[:, at : at + BITS] >= 0).astype(np.uint64) @ place for at in range(0, projection.shape[1], BITS)
    ], axis=1)


def at_most(errors: int, bits: int, cosine: float) -> float:
    """Chance that at most so many of the bits differ in two vectors of that cosine."""
    flip = acos(max(-1.0, min(1.0, cosine))) / pi
    return sum(comb(bits, k) * flip**k * (1 - flip) ** (bits - k) for k in range(min(errors, bits) + 1))


def word_sizes(n: int) -> list[int]:
    """Bits of the chunks of a word cut into n."""
    return [BITS // n + (i < BITS % n) for i in range(n)]


def layouts(cosine: float) -> list[list[int]]:
    """Chunk sizes of every way to cut codes that leaves an expected miss of at most MISS at the threshold."""
    out = []
    for n in CHUNKS:
        miss = np.prod([1 - at_most(ERRORS, size, cosine) for size in word_sizes(n)])
        words = next((w for w in range(1, MOST_WORDS + 1) if miss**w <= MISS), None)
        if words:
            out += [word_sizes(n) * w for w in range(words, min(words + 2, MOST_WORDS) + 1)]
    return out


def n_keys(sizes: list[int]) -> int:
    return sum(size + 1 for size in sizes)


def chunk_sizes(cosine: float, n_rows: int = 0, sample: np.ndarray | None = None, code: np.ndarray | None = None) -> list[int]:
    """Bits of the chunks: of all layouts the cheapest one for so many vectors.

    Longer chunks need more tables to keep the miss and let fewer unrelated vectors meet, more words let
    fewer of them pass as close. Both shares are counted on pairs of the sample that are no links, but
    taken as no less than for codes of independent bits, as a sample cannot show small shares. So the
    work per vector grows with a small power of their number and not with the number itself.
    """
    ways = layouts(cosine)
    if not n_rows:
        return min(ways, key=n_keys)
    if sample is None:
        return min(ways, key=lambda sizes: table_cost(sizes, n_rows, *shares_by_chance(sizes, cosine)))
    ways = [sizes for sizes in ways if sum(sizes) <= BITS * code.shape[1]]
    unit = sample[:TRIAL_ROWS] / np.linalg.norm(sample[:TRIAL_ROWS], axis=1, keepdims=True)
    i, j = np.nonzero(np.triu(unit @ unit.T < cosine, 1))
    code = code[:TRIAL_ROWS]
    total = max(1, len(i))

    def cost(sizes: list[int]) -> float:
        words = sum(sizes) // BITS
        differ = np.bitwise_count(code[i, :words] ^ code[j, :words]).sum(axis=1, dtype=np.int64)
        close = differ <= allowed_distance(cosine, words)
        met, passed, at = 0.0, 0.0, 0
        for size in sizes:
            word, shift = divmod(at, BITS)
            mask = np.uint64(((1 << size) - 1) << shift)
            near = np.bitwise_count((code[i, word] ^ code[j, word]) & mask) <= ERRORS
            met, passed, at = met + near.sum() / total, passed + (near & close).sum() / total, at + size
        by_chance = shares_by_chance(sizes, cosine)
        return table_cost(sizes, n_rows, max(met, by_chance[0]), max(passed, by_chance[1]))

    return min(ways, key=cost)


def shares_by_chance(sizes: list[int], cosine: float) -> tuple[float, float]:
    """Mean number of chunks at which codes of independent bits meet, and meet and pass as close."""
    words = sum(sizes) // BITS
    met = sum(at_most(ERRORS, size, 0.0) for size in sizes)
    return met, met * at_most(allowed_distance(cosine, words), BITS * words, 0.0)


def table_cost(sizes: list[int], n_rows: int, met: float, passed: float) -> float:
    """Work per vector; two codes that differ in two bits of a chunk share two keys."""
    carried = SURVIVOR_COST * min(n_keys(sizes), n_rows * passed)  # once a key, at most
    return n_keys(sizes) * (1 + sum(sizes) / BITS / 4) + 2 * n_rows * met * MEETING_COST + carried


def allowed_distance(cosine: float, words: int = 1) -> int:
    """Differing bits of a code beyond which hardly a pair at the threshold lies."""
    flip, bits = acos(max(-1.0, min(1.0, cosine))) / pi, BITS * words
    return min(bits, int(bits * flip + SPREAD * sqrt(bits * flip * (1 - flip))))


def canonical_keys(a: np.ndarray, b: np.ndarray, sizes: list[int]) -> np.ndarray:
    """The one table key at which two codes are compared, or -1 if no chunk is within two bits.

    It is in the first chunk within two bits: the chunk itself, the smaller of two neighbours, or the
    smaller of the two values between them.
    """
    out, at = np.full(len(a), -1, np.int64), 0
    for c, size in enumerate(sizes):
        word, shift = divmod(at, BITS)
        mask = np.uint64((1 << size) - 1)
        x, y = (a[:, word] >> np.uint64(shift)) & mask, (b[:, word] >> np.uint64(shift)) & mask
        differ = x ^ y
        n = np.bitwise_count(differ)
        low_bit = differ & (~differ + np.uint64(1))
        between = np.minimum(x ^ low_bit, y ^ low_bit)
        key = np.where(n == 2, between, np.minimum(x, y)).astype(np.int64) | (c << 32)
        out = np.where((out < 0) & (n <= 2), key, out)
        at += size
    return out


def table_rows(vectors: DataFrame, projection: np.ndarray, sizes: list[int]) -> DataFrame:
    """id, code, key: every key of every table within one bit of the vector's chunk."""
    dims, words = projection.shape[0], projection.shape[1] // BITS

    def spread(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for whole in batches:
            for low in range(0, whole.num_rows, SPREAD_ROWS):
                batch = whole.slice(low, SPREAD_ROWS)
                code = codes_of(matrix(batch.column(1), dims), projection)
                keys, at = [], 0
                for c, size in enumerate(sizes):
                    word, shift = divmod(at, BITS)
                    value = ((code[:, word] >> np.uint64(shift)) & np.uint64((1 << size) - 1)).astype(np.int64) | (c << 32)
                    keys += [value, *[value ^ (1 << i) for i in range(size)]]
                    at += size
                ids = batch.column(0).to_numpy()
                n = len(keys) * len(ids)
                lists = pa.ListArray.from_arrays(
                    pa.array(np.arange(0, (n + 1) * words, words, dtype=np.int32)),
                    pa.array(np.tile(code.astype(np.int64), (len(keys), 1)).ravel()),
                )
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.tile(ids, len(keys))), lists, pa.array(np.concatenate(keys))], names=["id", "code", "key"]
                )

    return vectors.select("id", "vec").mapInArrow(spread, "id long, code array<long>, key long")


ORDER = ["key", "_i", "_j"]


def meetings(part, sizes: list[int], code_distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of an Arrow table that are to be compared here and nowhere else."""
    flat = part.column("code").combine_chunks().flatten().to_numpy()
    code = flat.astype(np.uint64).reshape(part.num_rows, -1)
    key, own = part.column("key").to_numpy(), part.column("_at").to_numpy()
    diag = part.column("_i").to_numpy() == part.column("_j").to_numpy()
    for i, j in pairs_in_runs(group_starts(part, ORDER), part.num_rows):
        meet = diag[i] | (own[i] != own[j])
        for word in range(code.shape[1]):  # a single word already rules out most
            i, j = i[meet], j[meet]
            far = np.bitwise_count(code[i, word] ^ code[j, word]).astype(np.int64)
            differ = far if word == 0 else differ[meet] + far
            meet = differ <= code_distance
        i, j = i[meet], j[meet]
        here = canonical_keys(code[i], code[j], sizes) == key[i]
        yield i[here], j[here]


def settle(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Gives both ends of every pair the smallest label reachable over the pairs."""
    while True:
        low = np.minimum(label[i], label[j])
        if (low == label[i]).all() and (low == label[j]).all():
            return
        np.minimum.at(label, label[i], low)
        np.minimum.at(label, label[j], low)
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label[:] = label[label]


def linked_vectors(vectors: DataFrame, dims: int, cosine: float, block_rows: int) -> DataFrame:
    """id, n, root per distinct vector (id, vec, copies) and block in which it has links.

    First the codes alone meet in the tables; only rows with a partner left are then joined with
    their vectors and compared again. n sums the copies of linked vectors, root is the smallest
    id reachable in the block: what leaves a task grows with its rows, not with its pairs.
    """
    sample = fitting_sample(vectors, dims)
    n_rows = vectors.count()
    # one word more than independent bits would need
    projection = fit_rotation(sample, words=sum(chunk_sizes(cosine, n_rows)) // BITS + 1)
    sizes = chunk_sizes(cosine, n_rows, sample, codes_of(sample[:TRIAL_ROWS], projection))
    words = sum(sizes) // BITS
    projection, code_distance = projection[:, : BITS * words], allowed_distance(cosine, words)

    def survivors(batches: Iterator) -> Iterator:
        for part in runs(batches, ORDER):
            alive = set()
            for i, j in meetings(part, sizes, code_distance):
                alive.update(np.union1d(i, j).tolist())
            if alive:
                yield from part.take(sorted(alive)).to_batches()

    def compare(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for part in runs(batches, ORDER):
            x = matrix(part.column("vec"), dims)
            norm = np.sqrt((x * x).sum(axis=1))
            copies, ids = part.column("copies").to_numpy(), part.column("id").to_numpy()
            n, label = np.zeros(len(ids), np.int64), np.arange(len(ids))
            for i, j in meetings(part, sizes, code_distance):
                for at in range(0, len(i), 50_000):
                    a, b = i[at : at + 50_000], j[at : at + 50_000]
                    good = (x[a] * x[b]).sum(axis=1) / (norm[a] * norm[b]) >= cosine
                    a, b = a[good], b[good]
                    np.add.at(n, a, copies[b])
                    np.add.at(n, b, copies[a])
                    settle(label, a, b)
            some = n > 0
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[some]), pa.array(n[some]), pa.array(ids[label[some]])], names=["id", "n", "root"]
            )

    rows = save_table(table_rows(vectors, projection, sizes), "itq-keys")
    blocks = in_blocks(rows, ["key"], F.col("id"), block_rows).select("key", "_i", "_j", "_at", "id", "code")
    alive = blocks.repartition(*ORDER).sortWithinPartitions(*ORDER).mapInArrow(
        survivors, "key long, _i int, _j int, _at int, id long, code array<long>"
    )
    alive = save_table(alive, "itq-alive").join(vectors, "id")
    alive = alive.select(*ORDER, "_at", "id", "code", "copies", "vec").repartition(*ORDER).sortWithinPartitions(*ORDER)
    return save_table(alive.mapInArrow(compare, "id long, n long, root long"), "itq-links")


def near_vectors(
    embeddings: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", cosine: float = COSINE,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of ``embeddings``.

    Vectors with a cosine of at least ``cosine`` are linked. A rotation learned on a bounded
    sample (one for each word of 64 bits) gives each vector a code, cut into chunks; two vectors
    meet if some chunk differs in at most two bits (both are entered under all values within one
    bit), their codes must be within ``allowed_distance``, and their cosine is taken from the
    original vectors in double precision. Number and length of the chunks follow from ``cosine``
    and the number of vectors, see ``chunk_sizes``: at the threshold about 97 % of the pairs are
    expected to meet at every size, more above. Vectors with a large common
    part are compared in almost all pairs. Buckets are compared in blocks of ``block_rows``; equal
    vectors are entered once.

    Null, zero and non-finite vectors, and rows with a null id, have no links and are kept, with
    their id as component. Shorter vectors are filled up with zeros. n_links counts other rows,
    also those repeated under one id. Further columns are ignored.
    """
    rows = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("vec"))
    good = usable(F.col("vec")) & F.col("vec_id").isNotNull()
    marks = [F.xxhash64("vec").alias("h1"), F.xxhash64("vec", F.lit("second")).alias("h2")]
    some = rows.filter(good).select("vec_id", "vec", *marks)
    distinct = some.groupBy("h1", "h2").agg(
        F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("copies"), F.first("vec").alias("vec")
    )
    distinct, dims = same_length(save_table(distinct, "itq-distinct"))
    names = rows.filter(~good).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept")
    )
    if not dims:
        return names
    links = linked_vectors(distinct.select("id", "vec", "copies"), dims, cosine, block_rows)
    found = connected_components(links.select(F.col("id").alias("a"), F.col("root").alias("b")))
    per = links.groupBy("id").agg(F.sum("n").alias("n")).join(found.withColumnRenamed("node", "id"), "id", "left")
    per = distinct.select("h1", "h2", "id", "copies").join(per, "id", "left")
    out = some.select("vec_id", "h1", "h2").join(per, ["h1", "h2"])
    component = F.coalesce("component", "id")
    return out.select(
        "vec_id", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).cast("long").alias("n_links"),
        component.alias("component_id"), (F.col("vec_id") == component).alias("kept"),
    ).unionByName(names)
