"""Spelling variants: a trie of letter-group counts, searched with one surplus and one deficit; leaf words are verified."""

from __future__ import annotations

import itertools
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framesift.llm.common import arrow_schema, group_starts, n_partitions, runs
from framesift.session import save_table

MIN_LETTERS = 7
MIN_COUNT = 2
FORM_TIMES = 10  # how much more frequent the form of a word is
GROUPS = 16  # letter groups, the levels of the trie
LEAST_DEPTH = 3  # levels that name a branch
BRANCH_WORDS = 16_384  # words of a branch in one task
GROUP_WORDS = 256  # words of equal counts in one row
VISIT_WORDS = 2_000  # words whose visits are held at a time
COUNTER_ROWS = 300_000  # distinct words counted in a task before they are passed on
BY_FREQUENCY = "etaoinshrdlucmfwypvbgkqjxz"  # dealt to the groups in turn, so that they are of like weight

GROUP_OF = [code % GROUPS for code in range(256)]
for _i, _c in enumerate(BY_FREQUENCY):
    GROUP_OF[ord(_c)] = _i % GROUPS


def word_counts(
    docs: DataFrame, min_letters: int = MIN_LETTERS, edit: Callable[[bytes, dict[bytes, int]], dict[bytes, int]] | None = None
) -> DataFrame:
    """word, n: how often each word of at least ``min_letters`` code points stands in the texts (text).

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased. ``edit`` maps (doc_id as text, counts of
    the words of the text in Latin-1) to the counts to be taken; it must not make words longer. Counts are combined
    in the task; null texts have no word; a null doc_id is an empty text.
    """
    word = re.compile(rb"[a-z\xc0-\xff]{%d,}" % min_letters)

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def rows(counter: dict):
            words = [w.decode("latin-1") for w in counter]
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(list(counter.values()), pa.int64())], names=["word", "n"])

        seen: dict[bytes, int] = defaultdict(int)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                # one byte a code point; what Latin-1 lacks becomes "?", no letter; bytes.lower() knows A-Z only
                found = Counter(word.findall(text.encode("latin-1", "replace").lower()))
                for w, n in (edit(doc_id.encode(), found) if edit else found).items():
                    if len(w) >= min_letters:
                        seen[w] += n
                if len(seen) > COUNTER_ROWS:
                    yield rows(seen)
                    seen.clear()
        if seen:
            yield rows(seen)

    texts = docs.filter("text IS NOT NULL").select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), "text")
    return texts.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def planted_deletions(doc_id: bytes, found: dict[bytes, int]) -> dict[bytes, int]:
    """The counts with words cut: where 31 divides h, the crc32 of ``<doc_id>:<word>`` in UTF-8, letter h % length goes."""
    start, out = zlib.crc32(doc_id + b":"), defaultdict(int)
    for word, n in found.items():
        h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), start)
        if h % 31 == 0:
            at = h % len(word)
            word = word[:at] + word[at + 1 :]
        out[word] += n
    return out


def group_counts(word: str) -> bytes:
    """Letters of each group, at most 255 of one: the way of a word through the trie."""
    counts = [0] * GROUPS
    for c in word.encode("latin-1"):
        counts[GROUP_OF[c]] += 1
    return bytes(min(c, 255) for c in counts)


def branches(counts: bytes, depth: int) -> list[tuple[bytes, int]]:
    """(branch, spent) of every branch in which a near word of larger or equal counts may stand.

    One edit raises one group by one (surplus), lowers one (deficit), or both. Of two near words that
    with the smaller counts, in the order of the levels, searches: its surplus comes before its
    deficit. spent: 0 nothing, 1 the surplus, 2 both.
    """
    top = list(counts[:depth])
    out = [(bytes(top), 0)]
    for i in range(depth):
        if top[i] == 255:  # counts end here: a surplus does not show
            out.append((bytes(top), 1))
            for j in range(i + 1, depth):
                if top[j]:
                    out.append((bytes([*top[:j], top[j] - 1, *top[j + 1 :]]), 2))
            continue
        up = [*top[:i], top[i] + 1, *top[i + 1 :]]
        out.append((bytes(up), 1))
        for j in range(i + 1, depth):
            if top[j]:
                out.append((bytes([*up[:j], top[j] - 1, *up[j + 1 :]]), 2))
    return list(dict.fromkeys(out))


def add_to_trie(root: dict, counts: bytes, depth: int, words: list) -> None:
    """Nested dicts from ``depth`` on, a level for each group; the leaves are lists of words."""
    node = root
    for c in counts[depth:]:
        node = node.setdefault(c, {})
    node.setdefault(None, []).extend(words)


def leaves(root: dict, counts: bytes, depth: int, spent: int) -> list[list]:
    """Depth-first search for the counts from ``depth`` on, with what is left of the surplus and the deficit."""
    out, open_nodes = [], [(root, depth, spent)]
    while open_nodes:
        node, at, spent = open_nodes.pop()
        while at < GROUPS:
            c = counts[at]
            at += 1
            if spent == 0:
                if c + 1 in node:
                    open_nodes.append((node[c + 1], at, 1))
                elif c == 255 and c in node:
                    open_nodes.append((node[c], at, 1))
            elif spent == 1 and c and c - 1 in node:
                open_nodes.append((node[c - 1], at, 2))
            if c not in node:
                break
            node = node[c]
        else:
            out.append(node[None])
    return out


def one_edit(a: str, b: str) -> bool:
    """Exactly one letter inserted, deleted or replaced."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def with_ends(words: str, n: bytes) -> list[tuple[str, int, str, str]]:
    """(word, n, first three letters, last three); one edit leaves either end of six letters or more as it is."""
    return [(w, k, w[:3], w[-3:]) if len(w) > 6 else (w, k, "", "") for w, k in zip(words.split(" "), np.frombuffer(n, "<i8").tolist())]


def pairs_of_branch(rows: list[tuple], depth: int) -> Iterator[tuple]:
    """(a, n_a, b, n_b), a < b, of the near words of a branch; rows are (home, spent, counts, words, n) of groups of equal counts."""
    root: dict = {}
    for home, _, counts, words, n in rows:
        if home:
            add_to_trie(root, counts, depth, with_ends(words, n))
    if not root:
        return
    for home, spent, counts, words, n in rows:
        if home:
            continue
        found = leaves(root, counts, depth, spent)
        if not found:
            continue
        for a, n_a, head, tail in with_ends(words, n):
            for leaf in found:
                for b, n_b, first, last in leaf:
                    if (head == first or tail == last or not head or not first) and one_edit(a, b):
                        yield (a, n_a, b, n_b) if a < b else (b, n_b, a, n_a)


VISITS = "branch binary, block int, home boolean, spent int, counts binary, words string, n binary"
LINKS = "a string, n_a long, b string, n_b long"


def near_words(words: DataFrame, branch_words: int = BRANCH_WORDS, group_words: int = GROUP_WORDS) -> DataFrame:
    """a, n_a, b, n_b: all pairs of the distinct words (word, n) that differ by exactly one edit, each once, stored.

    A word's counts of GROUPS letter groups are its way through a trie. The trie is cut at the least depth
    at which no branch has more than ``branch_words`` words; each task gets whole branches.
    Words of equal counts travel together, up to ``group_words`` of them: they are at home in one branch
    and search the branches their budget reaches. Below the cut the task searches its trie depth first
    and verifies the words at the leaves. Where even words of equal counts are more than
    ``branch_words``, their branch is cut into blocks that each searching group visits.
    """

    def walk(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            counts = [group_counts(w) for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts, pa.binary())], names=["word", "n", "counts"])

    spark = words.sparkSession
    placed = words.select("word", F.col("n").cast("long").alias("n"))
    placed = save_table(placed.mapInArrow(walk, "word string, n long, counts binary"), "variant-words")
    depths = F.explode(F.sequence(F.lit(LEAST_DEPTH), F.lit(GROUPS))).alias("depth")
    sizes = placed.groupBy("counts").count().select(depths, "counts", "count")
    sizes = sizes.groupBy("depth", F.expr("substring(counts, 1, depth)").alias("branch")).agg(F.sum("count").alias("count"))
    most = {r["depth"]: r["most"] for r in sizes.groupBy("depth").agg(F.max("count").alias("most")).collect()}
    depth = next((d for d in range(LEAST_DEPTH, GROUPS) if most.get(d, 0) <= branch_words), GROUPS)

    schema = arrow_schema(VISITS)

    def visit(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def rows_of(held: list[tuple[bytes, list, list]]):
            rows = []
            for counts, group, n in held:
                text, numbers = " ".join(group), np.array(n, "<i8").tobytes()
                rows.append((counts[:depth], 0, True, 0, counts, text, numbers))
                rows += [(branch, 0, False, spent, counts, text, numbers) for branch, spent in branches(counts, depth)]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        held: list[tuple[bytes, list, list]] = []
        size = 0
        for batch in batches:
            for word, n, counts in zip(*(c.to_pylist() for c in batch.columns)):
                if not held or held[-1][0] != counts or len(held[-1][1]) >= group_words:
                    if size > VISIT_WORDS:
                        yield rows_of(held)
                        held, size = [], 0
                    held.append((counts, [], []))
                held[-1][1].append(word)
                held[-1][2].append(n)
                size += 1
        if held:
            yield rows_of(held)

    sorted_words = placed.repartitionByRange(n_partitions(spark), "counts", F.xxhash64("word")).sortWithinPartitions("counts")
    visits = sorted_words.mapInArrow(visit, VISITS)
    if most.get(depth, 0) > branch_words:
        blocks = placed.groupBy(F.substring("counts", 1, depth).alias("branch")).agg(F.ceil(F.count(F.lit(1)) / F.lit(branch_words)).cast("int").alias("_n"))
        cut = F.when(F.col("home"), F.array(F.pmod(F.xxhash64("words"), F.col("_n")).cast("int"))).otherwise(F.sequence(F.lit(0), F.col("_n") - 1))
        visits = visits.join(save_table(blocks, "variant-blocks"), "branch").withColumn("block", F.explode(cut)).drop("_n")

    def search(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for part in runs(batches, ["block", "branch"]):
            for at, to in itertools.pairwise([*group_starts(part, ["block", "branch"]).tolist(), part.num_rows]):
                mine = part.slice(at, to - at)
                found = pairs_of_branch(list(zip(*(mine.column(c).to_pylist() for c in ("home", "spent", "counts", "words", "n")))), depth)
                for some in itertools.batched(found, 50_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*some)], names=["a", "n_a", "b", "n_b"])

    dealt = visits.repartition(n_partitions(spark), "branch", "block").sortWithinPartitions("block", "branch")
    return save_table(dealt.mapInArrow(search, LINKS).distinct(), "variant-links")


def spelling_forms(words: DataFrame, times: int = FORM_TIMES) -> DataFrame:
    """word, form, root, n, n_near, form_n of distinct words (word, n).

    n_near counts the words one edit away (``near_words``). The form of a word is the most frequent of
    them (ties: the smallest in code-point order) if it is at least ``times`` as frequent; root follows
    the forms to the last, at most log(n) / log(times) steps, found by joining the steps with themselves.
    """
    words = save_table(words.select("word", "n"), "variant-counted")
    links = near_words(words)
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("n_b").alias("n_a"), F.col("a").alias("b"), F.col("n_a").alias("n_b")))
    near = both.groupBy("a", "n_a").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("n_b")).alias("less"), "b")).alias("best"))
    strong = -F.col("best.less") >= times * F.col("n_a")
    near = save_table(near.select(
        F.col("a").alias("word"), "n_near", F.when(strong, F.col("best.b")).alias("form"), F.when(strong, -F.col("best.less")).alias("form_n")
    ), "variant-near")
    steps = near.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        further = steps.select(F.col("word").alias("root"), F.col("root").alias("_to"))
        joined = save_table(steps.join(further, "root", "left").select("word", F.coalesce("_to", "root").alias("root"), F.col("_to").isNotNull().alias("_moved")), "variant-roots")
        steps = joined.select("word", "root")
        if not joined.filter("_moved").head(1):
            break
    out = words.join(near, "word", "left").join(steps, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


def variants_report(docs: DataFrame) -> DataFrame:
    """``spelling_forms`` of all words of ``docs`` (doc_id, text) with the planted deletions.

    Words have at least MIN_LETTERS code points and stand at least MIN_COUNT times in all texts. Null
    and empty texts have no word, repeated rows count as often as they stand there, a null doc_id counts as an empty
    text, an empty table gives no row, further columns are ignored. Texts and words may have any length.
    """
    return spelling_forms(word_counts(docs, edit=planted_deletions).filter(F.col("n") >= MIN_COUNT))
