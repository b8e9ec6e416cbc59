"""Document fingerprints: sums of wide vectors hashed from paragraphs, modulo a power of two (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framesift.llm.common import n_partitions

HASHES = 4  # 64-bit hashes of a paragraph
LANE = 15  # bits of a component; four stand in one number, 60 bits of a hash are used
LANES = 4
MODULUS = 1 << (LANE * LANES)  # of each of the HASHES * LANE numbers of a vector
ONES = sum(1 << (LANE * i) for i in range(LANES))
CHUNK_BITS = 17  # paragraphs summed before the modulus is taken, far from the limit of a long
SLICES_A_PARTITION = 4
MAX_SLICES = 4096  # bounds of the id ranges that stand in the plan


def paragraphs(text: Column) -> Column:
    """Parts of a text: its lines, cut further after a sentence end (. ! ?) with a blank. Blank parts count for nothing."""
    for end in (". ", "! ", "? "):
        text = F.replace(text, F.lit(end), F.lit(end[0] + "\n"))
    return F.split(text, "\n")


def fingerprints(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys``, fingerprint (array of long) and signs (array of double) of each text; ``keys`` tell the rows apart.

    Each paragraph is hashed to a vector of HASHES * LANE numbers that hold one bit in each of
    LANES places. The fingerprint is the number of paragraphs and the sum of their vectors, each number
    modulo MODULUS: it does not depend on the order of paragraphs, equal texts have equal
    fingerprints, and ``combined`` and ``removed`` follow an insertion or deletion without the
    other paragraphs. ``signs`` see there, for ``likeness``. A null or
    empty text has the fingerprint of no paragraph: zeros.

    A text of any length is summed in chunks of 2 ** CHUNK_BITS paragraphs. Rows that are dealt by
    some of ``keys`` are not shuffled again.
    """
    parts = rows.select(*keys, F.posexplode(paragraphs(F.coalesce(text, F.lit("")))).alias("_at", "_part"))
    part = F.trim("_part")
    some = part != ""
    hashes = [F.when(some, F.xxhash64(part, F.lit(i))).otherwise(F.lit(0)).alias(f"_h{i}") for i in range(HASHES)]
    chunk = F.shiftright("_at", CHUNK_BITS).alias("_chunk")
    parts = parts.select(*keys, chunk, some.cast("long").alias("_some"), *hashes)
    sums = [F.sum("_some").alias("_n")]
    for i in range(HASHES):
        for place in range(LANE):
            bits = F.shiftrightunsigned(f"_h{i}", place).bitwiseAND(F.lit(ONES))
            sums.append(F.sum(bits).alias(f"_s{i * LANE + place}"))
    names = ["_n", *[f"_s{i}" for i in range(HASHES * LANE)]]
    chunks = parts.groupBy(*keys, "_chunk").agg(*sums).select(*keys, F.array(*names).alias("_sums"))
    whole = chunks.groupBy(*keys).agg(F.collect_list("_sums").alias("_sums"))  # one row for each chunk of a text
    first = F.transform(F.get("_sums", F.lit(0)), modulo)
    more = F.aggregate(F.slice("_sums", 2, F.size("_sums")), first, combined)
    whole = whole.select(*keys, F.when(F.size("_sums") == 1, first).otherwise(more).alias("fingerprint"))
    return whole.select("*", signs(F.col("fingerprint")).alias("signs"))


def signs(fingerprint: Column) -> Column:
    """2 * bits - paragraphs of each place of a fingerprint, in the middle of its modulus."""
    middle, lane = 1 << (LANE - 1), (1 << LANE) - 1

    def places(f: Column) -> Column:
        shift = F.lit(middle) - F.get(f, F.lit(0))
        each = lambda x: F.array(*[
            ((F.shiftright(x, LANE * i - 1) if i else F.shiftleft(x, 1)).bitwiseAND(F.lit(2 * lane)) + shift).bitwiseAND(F.lit(lane)) - F.lit(middle)
            for i in range(LANES)])
        return F.flatten(F.transform(F.slice(f, 2, F.size(f)), each))

    return F.get(F.transform(F.array(fingerprint), places), F.lit(0)).cast("array<double>")


def modulo(x: Column) -> Column:
    return x.bitwiseAND(F.lit(MODULUS - 1))


def combined(a: Column, b: Column) -> Column:
    """Fingerprint of the paragraphs of both: insertion of those of ``b`` into ``a``."""
    return F.zip_with(a, b, lambda x, y: modulo(x + y))


def removed(a: Column, b: Column) -> Column:
    """Fingerprint ``a`` after deletion of the paragraphs of ``b``, which it holds."""
    return F.zip_with(a, b, lambda x, y: modulo(x - y))


def as_text(fingerprint: Column) -> Column:
    """Hexadecimal digits, 15 for each number."""
    return F.array_join(F.transform(fingerprint, lambda x: F.lpad(F.lower(F.hex(x)), LANE * LANES // 4, "0")), "")


def product(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def likeness(ab: Column, aa: Column, bb: Column) -> Column:
    """0 to 1 from the products of two ``signs`` with each other and with themselves.

    The product of a sum of random signs with itself estimates the number of its paragraphs (copies
    squared), that of two sums the common ones. The result is twice the common ones by the sum of
    both, its error about 1 / sqrt(240). It holds while no paragraph stands more than
    2 ** 14 times in a text. Texts without a paragraph are like one another and unlike others.
    """
    share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 2 * ab / F.nullif(aa + bb, F.lit(0.0))))
    return F.coalesce(share, F.lit(1.0))


def with_next(rows: DataFrame, ids: DataFrame, order: list[str], columns: list[str]) -> DataFrame:
    """``rows`` with ``next_`` + each of ``columns`` of the row that follows in doc_id order; the first follows the last.

    Added are _slice and _number, the range and the place in it, and _guest, 0 for the rows themselves.

    Rows are cut into ranges of doc_id with about equal row counts (bounds are percentiles of
    ``ids``, the same doc_ids by a cheap scan), so the rows are shuffled once and no task sorts the table. The first id of a
    range is also sent to the range before it, where its first row is the next one of the last row;
    the first id of all goes to the last range. Rows of one doc_id follow one another by ``order``;
    a null doc_id stands before all others.
    """
    n = min(MAX_SLICES, SLICES_A_PARTITION * n_partitions(rows.sparkSession))
    least = -(1 << 63)
    key = F.coalesce("doc_id", F.lit(least))
    shares = [i / n for i in range(1, n)]
    bounds = ids.select(key.alias("k")).agg(F.percentile_approx("k", shares, 10 * n)).first()[0]
    if bounds is None:  # no row
        none = [F.lit(0).alias(c) for c in ("_slice", "_guest", "_number")]
        return rows.select("*", *none, *[F.col(c).alias(f"next_{c}") for c in columns])
    bounds = sorted(set(bounds))
    width = len(bounds).bit_length()
    limits = F.array(*[F.lit(b).cast("long") for b in bounds])

    def slice_of(k: Column) -> Column:  # how many bounds lie below: a binary search
        def step(low: Column, bit: Column) -> Column:
            to = low + bit
            return F.when((to <= F.lit(len(bounds))) & (F.get(limits, to - 1) < k), to).otherwise(low)

        return F.aggregate(F.array(*[F.lit(1 << i) for i in reversed(range(width))]), F.lit(0), step)

    firsts = {r["s"]: r["first"] for r in ids.select(key.alias("k")).groupBy(slice_of(F.col("k")).alias("s")).agg(F.min("k").alias("first")).collect()}
    used = sorted(firsts)
    before = {s: used[i - 1] for i, s in enumerate(used) if i}
    numbers = range(len(bounds) + 1)
    first = F.get(F.array(*[F.lit(firsts.get(s)).cast("long") for s in numbers]), F.col("_at"))
    one_back = F.get(F.array(*[F.lit(before.get(s)).cast("int") for s in numbers]), F.col("_at"))
    back = F.when(F.col("_key") == first, one_back)
    last = F.when(F.col("_key") == F.lit(firsts[used[0]]), F.lit(used[-1]))
    places = F.array(
        F.struct(F.col("_at").alias("slice"), F.lit(0).alias("guest")), F.struct(back.alias("slice"), F.lit(1).alias("guest")),
        F.struct(last.alias("slice"), F.lit(2).alias("guest")),
    )
    dealt = rows.withColumn("_key", key).withColumn("_at", slice_of(F.col("_key"))).withColumn("_place", F.explode(F.filter(places, lambda p: p["slice"].isNotNull())))
    dealt = dealt.withColumn("_slice", F.col("_place.slice")).withColumn("_guest", F.col("_place.guest"))
    along = Window.partitionBy("_slice").orderBy("_guest", "_key", *order)
    place = F.row_number().over(along).alias("_number")
    return dealt.select(*rows.columns, "_slice", "_guest", place, *[F.lead(c).over(along).alias(f"next_{c}") for c in columns])


def fingerprint_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next per row of ``docs``.

    The edited text has the last n_chars / 2 code points replaced by the first as many of the next
    document's text. near_edited and near_next are the likeness to the edited text and to the next
    document. A null text counts as empty. Rows of one doc_id follow one another by text; a null
    doc_id stands before all others; the only row of a table is its own next one. An empty table gives
    no row. Further columns are ignored. Very long texts stay whole: a task sorts the texts of one id
    range, on disk where memory is short.

    The texts are shuffled once, by id range; all further steps stay in the same tasks.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(rows, rows.select("doc_id"), ["text"], ["text"])
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    rows = rows.withColumn("edited", F.when(F.col("_guest") == 0, edited))
    rows = rows.select(
        "_slice", "_number", "_guest", "doc_id", n.cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("text")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("text")))).alias("_v"),
    )
    keys = ["_slice", "_number", "_guest", "doc_id", "n_chars", "edited_sha256", "kind"]
    rows = fingerprints(rows.select(*keys[:-1], "_v.*"), keys, "text").withColumn("_self", product(F.col("signs"), F.col("signs")))
    # in this order a document is followed by its edited text, that by the next document
    along = Window.partitionBy("_slice").orderBy("_number", "kind")
    later = [F.lead(c, i).over(along).alias(f"{c}{i}") for i in (1, 2) for c in ("fingerprint", "signs", "_self") if (i, c) != (2, "fingerprint")]
    rows = rows.select("*", *later).filter("_guest = 0 AND kind = 0")
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("fingerprint")).alias("fingerprint"), as_text(F.col("fingerprint1")).alias("edited_fingerprint"),
        likeness(product(F.col("signs"), F.col("signs1")), F.col("_self"), F.col("_self1")).alias("near_edited"),
        likeness(product(F.col("signs"), F.col("signs2")), F.col("_self"), F.col("_self2")).alias("near_next"),
    )
