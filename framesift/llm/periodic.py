"""Periodic runs of words: recursive frequency splitting, then a lag scan of the segments that survive."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framesift.llm.common import WORDS, arrow_schema

MIN_WORDS = 6
MIN_PERIODS = 4

RUNS = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
BASE = np.uint64(0x9E3779B97F4A7C15)


def stable_segments(codes: np.ndarray, owner: np.ndarray, min_words: int, min_periods: int) -> list[np.ndarray]:
    """Positions of the segments that no word splits any more, as arrays of consecutive positions.

    A word of a run of period q and at least max(min_words, min_periods * q) words stands at least
    ``min_periods`` times in it. So a word that is rarer than that in its segment is in no run
    there, and the segment falls apart at it. Parts are counted anew until nothing changes; parts
    of fewer than ``min_words`` words go. Only parts that came out of a split are looked at again.
    """
    at, done = np.arange(len(codes)), []
    segment = owner
    while len(at):
        _, word, n = np.unique(segment * (int(codes.max()) + 1) + codes[at], return_inverse=True, return_counts=True)
        stays = n[word] >= min_periods
        split = np.zeros(int(segment.max()) + 1, bool)
        split[segment[~stays]] = True
        whole = ~split[segment]
        if whole.any():
            starts = np.flatnonzero(np.diff(segment[whole], prepend=-1))
            done += [s for s in np.split(at[whole], starts[1:]) if len(s) >= min_words]
        stays &= ~whole
        at, segment = at[stays], segment[stays]
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1] + 1) | (segment[1:] != segment[:-1])
        segment = np.cumsum(new) - 1
        long = np.bincount(segment, minlength=1)[segment] >= min_words if len(at) else new
        at, segment = at[long], segment[long]
    return done


def agreeing(values: np.ndarray, at: int, lag: int, step: int) -> int:
    """How far from ``at`` on, in direction ``step``, words equal those ``lag`` words after them."""
    n, size = 0, 64
    while True:
        if step > 0:
            low, high = at + n, min(at + n + size, len(values) - lag)
        else:
            low, high = max(at - n - size + 1, 0), at - n + 1
        if low >= high:
            return n
        differ = values[low:high] != values[low + lag : high + lag]
        if differ.any():
            return n + int(differ.argmax() if step > 0 else differ[::-1].argmax())
        n, size = n + high - low, size * 2


def scan_lags(segments: list[np.ndarray], codes: np.ndarray, min_words: int, min_periods: int) -> list[tuple[int, int, int]]:
    """(first position, length, smallest period) of every run inside the segments.

    Segments stand one after the other, long ones first, each closed by a code of its own. For each
    lag q the hashes of the blocks that start at multiples of q are compared: a run of period q has
    at least ``min_periods - 1`` equal blocks in a row. Each such row is extended word by word to
    the full run, so hashes decide nothing. A row inside a known run whose period divides q is that
    run again. The work is n log n for n words, however long the segment.
    """
    segments = sorted(segments, key=len, reverse=True)
    lengths = np.array([len(s) for s in segments])
    ends = np.cumsum(lengths + 1)
    values = np.concatenate([np.append(codes[s], -1 - i) for i, s in enumerate(segments)])
    origin = np.concatenate([np.append(s, -1) for s in segments])
    hashed = (values.astype(np.uint64) ^ (values.astype(np.uint64) >> np.uint64(7))) * np.uint64(0xBF58476D1CE4E5B9)
    hashed ^= hashed >> np.uint64(31)
    power = np.full(len(values), BASE, np.uint64)
    power[0] = 1
    back = np.full(len(values), pow(int(BASE), -1, 1 << 64), np.uint64)
    back[0] = 1
    power, back = np.cumprod(power), np.cumprod(back)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashed * power)])

    found: list[tuple[int, int, int]] = []  # start, end and period in ``values``
    seen: set[tuple[int, int]] = set()
    cover = np.full(len(values), -1, np.int64)  # a run found at each place
    lag = 0
    while True:
        lag += 1
        n_long = int(np.searchsorted(-lengths, -max(min_words, min_periods * lag), side="right"))
        if not n_long:
            break
        blocks = int(ends[n_long - 1]) // lag
        block = (sums[lag : blocks * lag + 1 : lag] - sums[0 : (blocks - 1) * lag + 1 : lag]) * back[0 : (blocks - 1) * lag + 1 : lag]
        same = block[1:] == block[:-1]
        row = same[: len(same) - min_periods + 3].copy()
        for i in range(1, min_periods - 2):
            row &= same[i : len(same) - min_periods + 3 + i]
        first = row.copy()
        first[1:] &= ~row[:-1]
        for k in np.flatnonzero(first).tolist():
            at = k * lag
            known = int(cover[at])
            if known >= 0 and lag % found[known][2] == 0 and found[known][1] >= at + (min_periods - 1) * lag:
                continue
            start = at - agreeing(values, at - 1, lag, -1)
            end = at + agreeing(values, at, lag, 1) + lag
            if end - start >= max(min_words, min_periods * lag) and (start, end) not in seen:
                seen.add((start, end))
                cover[start:end] = len(found)
                found.append((start, end, lag))
    return [(int(origin[s]), e - s, q) for s, e, q in found]


def word_runs(texts: list[list], min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS) -> list[list[tuple[int, int, int]]]:
    """For each list of words its runs (start, length, period), sorted by start and period."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    known: defaultdict = defaultdict(count().__next__)
    sizes = np.array([len(t) for t in texts], np.int64)
    codes = np.empty(int(sizes.sum()), np.int64)
    ends = np.cumsum(sizes)
    for words, end in zip(texts, ends.tolist()):
        codes[end - len(words) : end] = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
    owner = np.repeat(np.arange(len(texts)), sizes)
    segments = stable_segments(codes, owner, min_words, min_periods)
    if segments:
        for at, length, period in scan_lags(segments, codes, min_words, min_periods):
            doc = int(owner[at])
            out[doc].append((at - int(ends[doc] - sizes[doc]), length, period))
    return [sorted(runs, key=lambda r: (r[0], r[2])) for runs in out]


def collapsed_words(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words without those that any run contains after its first period."""
    if not runs:
        return words
    kept = np.ones(len(words), bool)
    for start, length, period in runs:
        kept[start + period : start + length] = False
    return [words[i] for i in np.flatnonzero(kept).tolist()]


def periodic_runs(docs: DataFrame, min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS) -> DataFrame:
    """doc_id, n_words, runs, collapsed of every row of ``docs`` (doc_id, text), over whole texts.

    A run is a stretch of at least max(min_words, min_periods * q) consecutive words with smallest
    period q that no neighbouring word extends; runs have start (word number), length and period,
    sorted by start and period. ``collapsed`` are the words left when each run keeps its first
    period, joined by one blank. Words are what stands between ASCII blanks, compared as they are.

    A null or empty text has no word, no run and the collapsed text "". Repeated rows have a row
    each, also those without an id; an empty table gives none; further columns are ignored. Every
    row is judged by itself in a task: no shuffle. A task holds the words of one Arrow batch, so a
    very long text needs some 100 bytes a word there.
    """
    assert min_periods >= 3
    schema = arrow_schema(RUNS)

    def find(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            texts = [(t or "").encode("utf-8", "surrogatepass").split() for t in batch.column(1).to_pylist()]  # ASCII blanks
            runs = word_runs(texts, min_words, min_periods)
            columns = [
                batch.column(0), pa.array([len(t) for t in texts], pa.int64()),
                pa.array([[{"start": s, "length": n, "period": q} for s, n, q in r] for r in runs], schema.field(2).type),
                pa.array([b" ".join(collapsed_words(t, r)).decode("utf-8", "surrogatepass") for t, r in zip(texts, runs)], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(find, RUNS)


def id_hash() -> Column:
    """crc32 of the decimal doc_id; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))


def with_planted_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, text; with h = crc32 of the id, every text with h % 10 = 0 is periodic from word a on.

    With g = h / 10 and n words, a = g % n and the period is 1 + (n - a) / (3 + g % 8), whole numbers.
    These texts become their words joined by one blank; the others, and texts without words, stay.
    """
    h = id_hash()
    g = F.floor(h / 10)

    def repeated(words: Column) -> Column:
        n = F.size(words)
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (F.lit(3) + g % 8))
        source = lambda i: F.when(i < a, i).otherwise(a + F.pmod(i - a, p)).cast("int")
        return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(words, source(i))), " ")

    # the words are an argument of a lambda, so they are found once and not once per word
    words = F.regexp_extract_all("text", F.lit(f"({WORDS})"), F.lit(1))
    planted = F.get(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, repeated(w)).otherwise(F.lit(""))), F.lit(0))
    return docs.select("doc_id", F.when(F.col("text").isNotNull() & (h % 10 == 0), planted).otherwise(F.col("text")).alias("text"))


def runs_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256 of the planted texts.

    The four after n_runs are those of the longest run (ties: smallest start, then period), null without
    a run.
    """
    rows = periodic_runs(with_planted_repeats(docs))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    rows = rows.select("doc_id", "n_words", "runs", "collapsed", best.alias("best"))
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.s")).alias("start"),
        F.col("best.length").alias("length"), (-F.col("best.p")).alias("period"),
        F.floor(F.col("best.length") * 1000 / -F.col("best.p")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"), "n_words",
    )
