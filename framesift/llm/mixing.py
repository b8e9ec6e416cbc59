"""Mixing sources to target weights: block draws per output shard (DataFrame only)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framesift.llm.common import WORDS, n_partitions
from framesift.operators.skew import ordered_rank
from framesift.session import save_table

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_TIMES = 2
BLOCK_WORDS = 64
SHARD_BLOCKS = 4096
SEED = 20_240
WALK = 32  # steps after which a walk of the permutation is back inside: see ``permuted``


def hashed(*parts: Column) -> Column:
    """Pseudorandom integer below 2^60 of integers, the same in every SQL engine with MD5."""
    text = F.concat_ws(",", F.lit(str(SEED)), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def bound(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once however often the body names it."""
    return F.transform(F.array(value), body)[0]


def permuted(rank: Column, epoch: Column, n: Column, a: Column, b: Column, at: Column) -> Column:
    """Image of ``at`` (0 <= at < n) under the permutation of [0, n) of a source and epoch.

    Four alternating additions on the two digits of a grid of a x b >= n places permute the grid;
    an image outside [0, n) is mapped again until it falls inside, which keeps it a permutation
    of [0, n). With a and b about sqrt(n) fewer than sqrt(n) + 1 places are outside, so below
    1,000 places 32 steps visit all of them, and above a walk of 32 steps has a chance of n^-16.
    """

    def step(x: Column) -> Column:
        digits = F.struct((x % a).alias("l"), F.floor(x / a).cast("long").alias("r"))
        for turn in range(2):
            digits = bound(digits, lambda d, t=turn: F.struct(
                ((d["l"] + hashed(rank, epoch, F.lit(2 * t), d["r"])) % a).alias("l"), d["r"].alias("r")))
            digits = bound(digits, lambda d, t=turn: F.struct(
                d["l"].alias("l"), ((d["r"] + hashed(rank, epoch, F.lit(2 * t + 1), d["l"])) % b).alias("r")))
        return bound(digits, lambda d: d["r"] * a + d["l"])

    walk = F.sequence(F.lit(1), F.lit(WALK))
    return F.aggregate(walk, step(at), lambda x, _: F.when(x < n, x).otherwise(step(x)))


def source_targets(sizes: DataFrame, weights: Sequence[int], share: float, most: int) -> DataFrame:
    """source, source_size, weight, rank and target per source of ``sizes`` (source, size).

    Sources rank by code point, null last; weights repeat in that order. Targets share ``share``
    of all words by weight, none above ``most`` times its source: target = min(level * weight,
    most * size), where the level is the largest of (wanted - capped words) / (weight left)
    over the sources in order of their cap per weight.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = ordered_rank(
        per_source.withColumn("_last", F.col("source").isNull()), ["_last", "source"], name="rank"
    ).drop("_last").withColumn("rank", F.col("rank") - 1)
    weight = F.get(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights)).cast("int"))
    rows = ranked.withColumn("weight", weight.cast("long")).withColumn("cap", F.col("source_size") * most)
    rows = save_table(rows.withColumn("ratio", F.col("cap") / F.col("weight")), "mix-sources")
    totals = rows.agg(F.sum("source_size").alias("all_words"), F.sum("weight").alias("all_weight"))
    capped = ordered_rank(rows, ["ratio", "rank"], name="caps", weight=F.col("cap"))
    capped = ordered_rank(capped, ["ratio", "rank"], name="weights", weight=F.col("weight"))
    before = capped.crossJoin(F.broadcast(totals))  # one row
    wanted = F.lit(share) * F.col("all_words")
    # levels with the sources up to this one capped, and with none capped
    level = F.greatest(
        F.max(F.when(F.col("weights") < F.col("all_weight"), (wanted - F.col("caps")) / (F.col("all_weight") - F.col("weights")))),
        F.max(wanted / F.col("all_weight")),
    )
    level = before.agg(level.alias("level"))
    return rows.crossJoin(F.broadcast(level)).select(  # one row
        "source", "source_size", "weight", "rank",
        F.least(F.col("level") * F.col("weight"), F.col("cap").cast("double")).alias("target"),
    )


def mixture(
    docs: DataFrame,
    columns: Sequence[str] = (),
    weights: Sequence[int] = WEIGHTS,
    share: float = SHARE,
    most: int = MOST_TIMES,
    block_words: int = BLOCK_WORDS,
    shard_blocks: int = SHARD_BLOCKS,
) -> tuple[DataFrame, DataFrame]:
    """(placed, draws) of a mixture of ``docs`` (doc_id, text, source and ``columns``).

    placed: one row per document with size, source_size, target, rank and its words' place
    [start, end) in the line of its source. draws: rank, block and how many output slots take
    this block. The words of each source, ordered by doc_id, are packed into blocks of
    ``block_words``. Output slots come in shards of ``shard_blocks``; each shard draws its source
    counts from the multinomial distribution of the targets. A source's draws are numbered
    over all shards, mapped through its permutation of block indices, a new one for each epoch,
    and joined with the blocks by index. Draws beyond a source's quota (its target in blocks)
    go to the sources that are short of theirs, so quotas are met and no block is taken more
    than ``most`` times.

    Null texts have size 0 and are never taken; null sources form one source; repeated rows are
    documents of their own. An empty table gives empty results. All draws follow from hashes.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long")
    rows = docs.select("doc_id", "text", "source", *columns, size.alias("size"))
    key = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))  # joins by source meet nulls too
    narrow = save_table(
        rows.select("doc_id", "source", "size", key.alias("line"), F.xxhash64("text", *columns).alias("mark")), "mix-sizes"
    )
    sources = source_targets(narrow, weights, share, most).withColumn("line", key)
    blocks = F.ceil(F.col("source_size") / block_words).cast("long")
    # in blocks of the source's mean length: the last block of a source is shorter
    mean = F.col("source_size") / blocks
    quota = F.when(blocks > 0, F.least(F.round(F.col("target") / mean).cast("long"), blocks * most)).otherwise(0)
    width = F.ceil(F.sqrt(blocks.cast("double"))).cast("long")
    sources = sources.select("*", blocks.alias("blocks"), quota.alias("quota"), width.alias("grid_a"))
    sources = sources.withColumn("grid_b", F.ceil(F.col("blocks") / F.col("grid_a")).cast("long"))
    sources = ordered_rank(sources, ["rank"], name="quota_end", weight=F.col("quota"))
    sources = save_table(sources, "mix-targets")

    placed = ordered_rank(narrow, ["doc_id", "mark"], by=["line"], name="end", weight=F.col("size"))
    placed = placed.join(sources.drop("source"), "line").withColumn("start", F.col("end") - F.col("size"))
    return placed, block_draws(sources, shard_blocks)


def block_draws(sources: DataFrame, shard_blocks: int) -> DataFrame:
    """rank, block, times: the draws of all output shards after the permutations."""
    spark = sources.sparkSession
    n_slots = sources.agg(F.sum("quota")).first()[0] or 0
    # the multinomial draw of a slot: a uniform place on the line of all quotas, found by
    # way of equal pieces of that line, so that neither side is compared with all of the other
    piece = max(1, -(-n_slots // 4096))
    place = hashed(F.col("shard"), F.col("slot")) % F.lit(max(1, n_slots))
    slots = spark.range(n_slots).select(
        F.floor(F.col("id") / shard_blocks).cast("long").alias("shard"), (F.col("id") % shard_blocks).alias("slot")
    ).withColumn("place", place).withColumn("piece", F.floor(F.col("place") / piece))
    first = F.floor((F.col("quota_end") - F.col("quota")) / piece)
    last = F.floor((F.col("quota_end") - 1) / piece)
    spans = sources.filter("quota > 0").select(
        "rank", "quota", "quota_end", F.explode(F.sequence(first, last)).alias("piece")
    )
    drawn = slots.join(spans, "piece").filter("place < quota_end AND place >= quota_end - quota")
    counts = save_table(drawn.groupBy("shard", "rank").agg(F.count(F.lit(1)).alias("n")), "mix-counts")
    # draws of a source before this shard; what goes beyond the quota is free for other sources
    grid = ["blocks", "grid_a", "grid_b"]
    counts = ordered_rank(counts, ["shard"], by=["rank"], name="upto", weight=F.col("n"))
    counts = counts.join(sources.select("rank", "quota", *grid), "rank")
    had = F.least(F.col("upto") - F.col("n"), F.col("quota"))
    kept = counts.select("rank", *grid, had.alias("start"), F.least("upto", "quota").alias("stop"))
    got = counts.groupBy("rank").agg(F.least(F.max("upto"), F.max("quota")).alias("got"))
    short = sources.join(got, "rank", "left").select(
        "rank", *grid, F.coalesce("got", F.lit(0)).alias("start"), F.col("quota").alias("stop")
    )
    ranges = kept.unionByName(short).filter("start < stop")
    # long runs are cut before they are spread out, so that a rare source costs no large row
    cuts = F.sequence(F.col("start"), F.col("stop") - 1, F.lit(shard_blocks).cast("long"))
    ranges = ranges.select("rank", *grid, "stop", F.explode(cuts).alias("start"))
    ranges = ranges.withColumn("stop", F.least("stop", F.col("start") + shard_blocks))
    # a range is a small row but much work: dealt to a fixed number of tasks before it is spread out
    ranges = ranges.repartition(max(n_partitions(spark), spark.sparkContext.defaultParallelism), "rank", "start")
    draws = ranges.select("rank", *grid, F.explode(F.sequence(F.col("start"), F.col("stop") - 1)).alias("draw"))
    draws = draws.withColumn("epoch", F.floor(F.col("draw") / F.col("blocks")).cast("long"))
    at = F.col("draw") - F.col("epoch") * F.col("blocks")
    block = permuted(F.col("rank"), F.col("epoch"), F.col("blocks"), F.col("grid_a"), F.col("grid_b"), at)
    draws = draws.select("rank", block.alias("block"))
    return draws.groupBy("rank", "block").agg(F.count(F.lit(1)).cast("long").alias("times"))


def taken_pieces(placed: DataFrame, draws: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per document and block of it that is taken: its words [first, last) and the times."""
    spread = placed.filter("size > 0").select(
        "line", "doc_id", "mark", "start", "end", "rank",
        F.explode(
            F.sequence(F.floor(F.col("start") / block_words), F.floor((F.col("end") - 1) / block_words))
        ).alias("block"),
    )
    met = spread.join(draws, ["rank", "block"])
    return met.select(
        "line", "doc_id", "mark", "start", "times", "block",
        (F.greatest(F.col("block") * block_words, "start") - F.col("start")).alias("first"),
        (F.least((F.col("block") + 1) * block_words, "end") - F.col("start")).alias("last"),
    )


def mixture_report(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken words per document (see ``mixture``)."""
    placed, draws = mixture(docs)
    placed = save_table(placed, "mix-placed")
    taken = taken_pieces(placed, draws).groupBy("line", "start").agg(
        F.sum((F.col("last") - F.col("first")) * F.col("times")).alias("taken")
    )
    # a place on its source's line belongs to one document that has words
    full = placed.filter("size > 0").join(taken, ["line", "start"], "left")
    empty = placed.filter("size = 0").withColumn("taken", F.lit(0).cast("long"))
    return full.unionByName(empty, allowMissingColumns=True).select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")
    )


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mixture as rows of ``docs`` (documents columns): one per document and epoch it is taken in.

    A document all of whose words are taken keeps its text as it is; of others the taken words
    are joined by blanks. n_chars follows the text. Documents that are not taken have no row.
    """
    others = [c for c in ("lang", "n_chars") if c in docs.columns]
    placed, draws = mixture(docs, columns=others)
    epochs = taken_pieces(placed, draws).select("*", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("epoch"))
    span = F.struct("first", "last")
    spans = epochs.groupBy("doc_id", "mark", "line", "start", "epoch").agg(
        F.array_sort(F.collect_list(span)).alias("spans"),  # the blocks of one document
        F.sum(F.col("last") - F.col("first")).alias("words"),
    )
    # rows repeated in every column are one text here and several places in the line above
    texts = docs.withColumn("mark", F.xxhash64("text", *others)).filter("text IS NOT NULL")
    texts = texts.withColumn("line", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))).withColumn(
        "known", F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))
    )
    # by the keys of the join below, so that texts are shuffled once
    texts = texts.dropDuplicates(["known", "mark", "line"])
    spans = spans.withColumn("known", F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).drop("doc_id")
    words = F.regexp_extract_all("text", F.lit(WORDS), F.lit(0))
    cut = F.transform("spans", lambda s: F.array_join(F.slice("words", s["first"] + 1, s["last"] - s["first"]), " "))
    joined = texts.join(spans, ["known", "mark", "line"]).withColumn("words_all", F.regexp_count("text", F.lit(WORDS)))
    whole = joined.filter("words = words_all")
    part = joined.filter("words <> words_all").withColumn("words", words).withColumn("text", F.array_join(cut, " "))
    out = whole.select(*docs.columns).unionByName(part.select(*docs.columns))
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out
