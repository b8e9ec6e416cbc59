"""Near-duplicate documents: b-bit MinHash signatures joined within a Hamming distance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framesift.llm.common import giving_back, group_starts, in_blocks, n_partitions, pairs_in_runs, runs
from framesift.llm.components import merged
from framesift.operators.skew import ordered_rank
from framesift.session import save_table

VALUES = 70  # components of a signature
BITS = 16  # bits kept of each
CHUNKS = 14  # chunks of VALUES / CHUNKS components
ERRORS = 1  # differing components allowed in a chunk: guarantees distances up to CHUNKS * 2 - 1
MAX_DISTANCE = 27
SHINGLE_WORDS = 5
PERCENT = 80
BLOCK_ROWS = 2048  # rows of a block that holds signatures only
SET_ROWS = 256  # rows of a block that holds full sets
SLICE_PAIRS = 25_000  # pairs compared at once; a task holds less than 20 MB for them
STAR_ROUNDS = 3
SAMPLE_OF = 64  # one class of so many is looked at for hot keys
HOT_SHARE = 1e-4
HOT_ROWS = 16  # rows of the sample that a hot key has at least
SLOTS = 127  # lowest bits of a key: the place left out
SEED = 7

_words: dict[bytes, int] = {}


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``words``-word shingles; fewer words are one shingle."""
    from xxhash import xxh64_intdigest

    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z, only ASCII blanks
    if not parts:
        return np.empty(0, np.uint64)
    if len(_words) > 100_000:
        _words.clear()
    codes = []
    for p in parts:
        h = _words.get(p)
        if h is None:
            h = xxh64_intdigest(p)
            if len(p) <= 32:
                _words[p] = h
        codes.append(h)
    code = np.array(codes, np.uint64)
    n = min(words, len(code))
    out = np.full(len(code) - n + 1, n, np.uint64)
    for i in range(n):
        out = mixed((out + code[i : len(code) - n + 1 + i]) * np.uint64(0x9E3779B97F4A7C15))
    return np.unique(out)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def signature(shingles: np.ndarray, factors: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """BITS low bits of the minimum of each of VALUES hash functions over the set."""
    low = None
    for at in range(0, len(shingles), 4096):
        part = (shingles[at : at + 4096, None] * factors + shifts) >> np.uint64(8)
        part = part.min(axis=0)
        low = part if low is None else np.minimum(low, part)
    return (mixed(low * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype("<u2")


SIGNED = "doc_id long, n_shingles long, set_hash long, sig binary"


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles, set_hash and sig (null for an empty set) of every row of ``docs``."""

    def sign(batches: Iterator) -> Iterator:
        import pyarrow as pa

        rng = np.random.default_rng(SEED)
        factors = rng.integers(0, 1 << 63, VALUES, np.uint64) * np.uint64(2) + np.uint64(1)
        shifts = rng.integers(0, 1 << 63, VALUES, np.uint64)
        weights = np.uint64(0xD6E8FEB86659FD93)
        for batch in batches:
            n, mark, sig = [], [], []
            for text in batch.column(1).to_pylist():
                s = shingle_hashes(text, words)
                n.append(len(s))
                # order-free mark of the set; sets with equal marks are confirmed as links, too
                mark.append(int((mixed(s * weights).sum(dtype=np.uint64) + np.uint64(len(s))).astype(np.int64)))
                sig.append(signature(s, factors, shifts).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(mark, pa.int64()), pa.array(sig, pa.binary())],
                names=["doc_id", "n_shingles", "set_hash", "sig"],
            )
        _words.clear()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(giving_back(sign), SIGNED)


def chunk_keys(sigs: DataFrame) -> DataFrame:
    """rep, key: for each chunk the keys it shares with every chunk that differs in one component.

    Two chunks differ in at most one component exactly if they agree after one and the same place
    has been left out, so each place left out gives one key. Its lowest bits name that place.
    """
    width = VALUES // CHUNKS
    keys = []
    for c in range(CHUNKS):
        for gone in range(width):
            parts = [F.substring("sig", 2 * (c * width + i) + 1, 2) for i in range(width) if i != gone]
            slot = c * width + gone
            keys.append(F.xxhash64(F.concat(*parts)).bitwiseAND(F.lit(~SLOTS)).bitwiseOR(F.lit(slot)))
    return sigs.select("rep", F.explode(F.array(*keys)).alias("key"))


def shared_keys(classes: DataFrame) -> DataFrame:
    """key, rep: the chunk keys that two or more classes hold, stored.

    The keys are dealt and sorted once; a pass over the sorted rows keeps those with a neighbour of the
    same key. A key that holds more than HOT_SHARE of a sample of the classes is known to be shared,
    so its rows stay and are dealt over all tasks. There are at most
    VALUES / HOT_SHARE such keys, whatever the table.
    """
    sample = classes.filter(F.pmod(F.xxhash64("rep", F.lit(SEED)), F.lit(SAMPLE_OF)) == 0).select("rep", "sig")
    n = sample.count()
    hot = chunk_keys(sample).groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= F.lit(max(HOT_ROWS, int(n * HOT_SHARE))))
    hot = F.broadcast(save_table(hot.select("key", F.lit(True).alias("hot")), "minhash-hot"))
    parts = n_partitions(classes.sparkSession)
    keys = chunk_keys(classes).join(hot, "key", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    spread = F.when(F.col("hot"), F.pmod(F.xxhash64("rep"), F.lit(parts))).otherwise(F.lit(0))

    def shared(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def rows(key, rep, keep):
            return pa.RecordBatch.from_arrays([pa.array(key[keep]), pa.array(rep[keep])], names=["key", "rep"])

        key, rep, keep = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)
        for batch in batches:
            # the last row waits for the first of the next batch
            key = np.concatenate([key[-1:], batch.column(0).to_numpy()])
            rep = np.concatenate([rep[-1:], batch.column(1).to_numpy()])
            keep = np.concatenate([keep[-1:], batch.column(2).to_numpy(zero_copy_only=False)])
            same = key[1:] == key[:-1]
            keep[1:] |= same
            keep[:-1] |= same
            yield rows(key[:-1], rep[:-1], keep[:-1])
        yield rows(key[-1:], rep[-1:], keep[-1:])

    dealt = keys.select("key", "rep", "hot").repartition(parts, "key", spread).sortWithinPartitions("key")
    return save_table(dealt.mapInArrow(giving_back(shared), "key long, rep long"), "minhash-shared")


ORDER = ["key", "_diag", "_i", "_j"]


def apart_blocks(rows: DataFrame, block_rows: int) -> DataFrame:
    """Rows (key, rep, component) of keys that hold several components, dealt to blocks that meet.

    Rows of the most frequent component of a key need no comparison with each other: they only meet the
    other rows, block by block. The other rows also meet among themselves.
    """
    per = rows.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    per = per.groupBy("key").agg(
        F.max(F.struct("n", "component")).alias("most"), F.sum("n").alias("total"), F.count(F.lit(1)).alias("parts")
    ).filter("parts > 1")
    per = per.select(
        "key", F.col("most.component").alias("major"),
        F.ceil((F.col("total") - F.col("most.n")) / block_rows).cast("int").alias("few"),
        F.ceil(F.col("most.n") / F.lit(block_rows)).cast("int").alias("many"),
    )
    met = save_table(rows.join(per, "key"), "minhash-apart")
    side = F.col("component") == F.col("major")
    mine, other = F.when(side, F.col("many")).otherwise(F.col("few")), F.when(side, F.col("few")).otherwise(F.col("many"))
    cross = met.withColumn("_own", F.pmod(F.xxhash64("rep"), mine).cast("int")).withColumn(
        "_other", F.explode(F.sequence(F.lit(0), other - 1))
    )
    cross = cross.select(
        "key", "rep", "component", F.lit(False).alias("_diag"), side.cast("int").alias("_at"),
        F.when(side, F.col("_other")).otherwise(F.col("_own")).alias("_i"),
        F.when(side, F.col("_own")).otherwise(F.col("_other")).alias("_j"),
    )
    few = in_blocks(met.filter(~side).select("key", "rep", "component"), ["key"], F.col("rep"), block_rows)
    few = few.select("key", "rep", "component", (F.col("_i") == F.col("_j")).alias("_diag"), "_at", "_i", "_j")
    # blocks of the two kinds must not be taken for one another
    few = few.withColumn("_i", -F.col("_i") - 1)
    return cross.unionByName(few)


def first_slots(differ: np.ndarray) -> np.ndarray:
    """The first key two signatures share, as its place left out; -1 if they share none."""
    width = VALUES // CHUNKS
    per_chunk = differ.reshape(len(differ), CHUNKS, width)
    n = per_chunk.sum(axis=2)
    chunk = (n <= ERRORS).argmax(axis=1)
    at = np.arange(len(differ))
    slot = chunk * width + per_chunk[at, chunk].argmax(axis=1)
    return np.where(n[at, chunk] <= ERRORS, slot, -1)


def close_pairs(part, max_distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of an Arrow table that lie in different components and whose signatures are close.

    Of the keys a pair shares only the first one reports it.
    """
    sig = np.stack([np.frombuffer(x, "<u2") for x in part.column("sig").to_pylist()])
    comp, slot = part.column("component").to_numpy(), part.column("key").to_numpy() & SLOTS
    own, diag = part.column("_at").to_numpy(), part.column("_diag").to_numpy()
    for i, j in pairs_in_runs(group_starts(part, ORDER), part.num_rows, SLICE_PAIRS):
        meet = (comp[i] != comp[j]) & (diag[i] | (own[i] != own[j]))
        i, j = i[meet], j[meet]
        differ = sig[i] != sig[j]
        good = np.flatnonzero(differ.sum(axis=1) <= max_distance)
        good = good[first_slots(differ[good]) == slot[i[good]]]
        yield i[good], j[good]


def block_candidates(rows: DataFrame, max_distance: int) -> DataFrame:
    """key, rep, component: the rows that have a close partner under their key, each once."""

    def survivors(batches: Iterator) -> Iterator:
        for part in runs(batches, ORDER):
            alive = np.zeros(part.num_rows, bool)
            for i, j in close_pairs(part, max_distance):
                alive[i] = alive[j] = True
            if alive.any():
                yield from part.select(["key", "rep", "component"]).take(np.flatnonzero(alive)).to_batches()

    rows = rows.select(*ORDER, "_at", "rep", "component", "sig").repartition(*ORDER).sortWithinPartitions(*ORDER)
    return rows.mapInArrow(giving_back(survivors), "key long, rep long, component long").distinct()


def block_links(rows: DataFrame, max_distance: int, percent: int) -> DataFrame:
    """a, b: links between different components, confirmed on full sets inside the blocks.

    Rows carry signatures and sets, so what leaves a task does not grow with the pairs it has compared. A
    pair of components that a block has linked once is not compared there again.
    """

    def confirm(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for part in runs(batches, ORDER):
            rep, comp = part.column("rep").to_numpy(), part.column("component").to_pylist()
            held = [np.frombuffer(x, np.uint64) for x in part.column("set").to_pylist()]
            linked, a, b = set(), [], []
            for i, j in close_pairs(part, max_distance):
                for x, y in zip(i.tolist(), j.tolist()):
                    both = (min(comp[x], comp[y]), max(comp[x], comp[y]))
                    if both not in linked and similar(held[x], held[y], percent):
                        linked.add(both)
                        a.append(rep[x])
                        b.append(rep[y])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    rows = rows.select(*ORDER, "_at", "rep", "component", "sig", "set")
    return rows.repartition(*ORDER).sortWithinPartitions(*ORDER).mapInArrow(giving_back(confirm), "a long, b long")


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union of two sorted sets."""
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    at = np.minimum(np.searchsorted(x, y), len(x) - 1)
    both = int((x[at] == y).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def shingle_sets(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """rep, set: the sorted shingle hashes of the texts of ``ids`` (rep), stored."""

    def sets(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            found = [shingle_hashes(t, words).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["rep", "set"])
        _words.clear()

    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").filter("text IS NOT NULL")
    texts = texts.join(save_table(ids, "minhash-used"), "rep", "left_semi")
    return save_table(texts.mapInArrow(giving_back(sets), "rep long, set binary"), "minhash-sets")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets have 100 * intersection >= percent * union, stored."""

    def check(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                keep.append(similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    joined = pairs.join(sets.select(F.col("rep").alias("a"), F.col("set").alias("sa")), "a").join(
        sets.select(F.col("rep").alias("b"), F.col("set").alias("sb")), "b"
    )
    return save_table(joined.select("a", "b", "sa", "sb").mapInArrow(giving_back(check), "a long, b long"), "minhash-links")


def labelled(shared: DataFrame, found: DataFrame | None) -> DataFrame:
    """``shared`` (key, rep) with the component of each class, from (node, component) or itself."""
    if found is None:
        return shared.withColumn("component", F.col("rep"))
    labels = found.withColumnRenamed("node", "rep")
    return shared.join(labels, "rep", "left").withColumn("component", F.coalesce("component", "rep"))


def star_pairs(rows: DataFrame, number: int) -> DataFrame:
    """a, b: each class with the hub of another component that it shares most keys with.

    The hub of a key is its class with the lowest hash, another one in each round; the classes
    of a group of copies mostly agree on it, so one pair per class joins most of the group.
    """
    rank = F.struct(F.xxhash64("rep", F.lit(number)).alias("h"), "rep", "component")
    hubs = rows.groupBy("key").agg(
        F.min(rank).alias("hub"), F.min("component").alias("low"), F.max("component").alias("high")
    ).filter("low < high")
    met = rows.join(hubs.select("key", F.col("hub.rep").alias("hub"), F.col("hub.component").alias("of")), "key")
    met = met.filter("component <> of").groupBy("rep", "hub").agg(F.count(F.lit(1)).alias("n"))
    chosen = met.groupBy("rep").agg(F.max(F.struct("n", (-F.col("hub")).alias("hub")))["hub"].alias("hub"))
    hub = -F.col("hub")
    return chosen.select(F.greatest("rep", hub).alias("a"), F.least("rep", hub).alias("b")).distinct()


def duplicate_groups(
    docs: DataFrame, words: int = SHINGLE_WORDS, percent: int = PERCENT, max_distance: int = MAX_DISTANCE,
    block_rows: int = BLOCK_ROWS, set_rows: int = SET_ROWS,
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of ``docs`` (doc_id, text).

    Two documents are linked if ``percent`` % of the union of their sets of ``words``-word
    shingles is shared; component_id is the smallest doc_id reachable. Rows with equal sets are
    one class. Signatures of the classes are joined by chunk keys, which finds every pair of
    signatures within ``max_distance`` (at most CHUNKS * (ERRORS + 1) - 1 by pigeonhole; 27 of 70
    misses a pair at 80 % once in 10,150, more similar ones far more seldom). STAR_ROUNDS rounds
    compare each class with one hub, which joins groups of copies of any size without listing
    their pairs. After them all classes that share a key and are still in different
    components are compared, first by signature in blocks of ``block_rows``; rows with a close
    partner then meet again in blocks of ``set_rows`` with their sets. All links are confirmed
    on full sets.

    Texts that are null or without words have an empty set and are linked with nothing; their
    component is their own id. Rows repeated under one doc_id are one class if equal; a null
    doc_id takes part in nothing and keeps component null and kept true. Documents that share a
    doc_id count as one. Further columns are ignored.
    """
    assert max_distance <= CHUNKS * (ERRORS + 1) - 1
    signed = save_table(signatures(docs, words), "minhash-signed")
    some = signed.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = some.groupBy("set_hash", "n_shingles").agg(F.min("doc_id").alias("rep"), F.min("sig").alias("sig"))
    classes = save_table(classes, "minhash-classes")
    shared = shared_keys(classes)
    sets = shingle_sets(docs, shared.select("rep").distinct(), words)

    found = None
    for number in range(STAR_ROUNDS):
        pairs = save_table(star_pairs(labelled(shared, found), number), "minhash-stars")
        found = merged(found, confirmed(pairs, sets, percent))
    # what meets in a key and is still apart
    signs = classes.select("rep", "sig")
    blocks = apart_blocks(labelled(shared, found), block_rows).join(signs, "rep")
    alive = save_table(block_candidates(blocks, max_distance), "minhash-alive")
    blocks = apart_blocks(alive, set_rows).join(sets.join(signs, "rep"), "rep")
    found = merged(found, save_table(block_links(blocks, max_distance, percent), "minhash-links"))

    reps = classes.select("set_hash", "n_shingles", "rep")
    out = signed.join(reps, ["set_hash", "n_shingles"], "left").join(
        found.select(F.col("node").alias("rep"), "component"), "rep", "left"
    )
    alone = F.col("n_shingles") == 0
    component = F.when(alone | F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.coalesce("component", "rep"))
    return out.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept")
    )


def first_of_each_group(docs: DataFrame, **options) -> DataFrame:
    """Rows of ``docs`` that stay when one document of each group of near copies is kept, that with the smallest doc_id.

    Rows without an id stay. Rows that agree in id and text are one document: of them the first in
    the order of a hash of all columns stays. Rows of one id with different texts are documents of their own,
    ordered by a hash of the text: each stays unless it is a copy of one before it.
    """
    mark = F.coalesce(F.xxhash64("text"), F.lit(0))
    ids = docs.filter("doc_id IS NOT NULL").select("doc_id", mark.alias("_mark"))
    if not ids.groupBy("doc_id").count().filter("count > 1").head(1):
        kept = duplicate_groups(docs, **options).filter("kept AND doc_id IS NOT NULL").select("doc_id")
        return docs.join(save_table(kept, "minhash-kept"), "doc_id", "left_semi").unionByName(docs.filter("doc_id IS NULL"))
    numbers = save_table(ordered_rank(ids.distinct(), ["doc_id", "_mark"], name="_node"), "minhash-numbers")
    rows = docs.filter("doc_id IS NOT NULL").withColumn("_mark", mark).join(numbers, ["doc_id", "_mark"])
    kept = duplicate_groups(rows.select(F.col("_node").alias("doc_id"), "text"), **options).filter("kept").select(F.col("doc_id").alias("_node")).distinct()
    rows = rows.join(save_table(kept, "minhash-kept"), "_node", "left_semi")
    first = F.row_number().over(Window.partitionBy("_node").orderBy(F.xxhash64(*docs.columns), *docs.columns))
    chosen = rows.withColumn("_first", first).filter("_first = 1").select(*docs.columns)
    return chosen.unionByName(docs.filter("doc_id IS NULL"))
