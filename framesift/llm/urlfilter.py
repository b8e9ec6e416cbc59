"""URL verdicts from rules and from a Bloom filter cascade over the corpus's keys (DataFrame only)."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framesift.llm.common import lower_ascii
from framesift.session import save_table

# (action, host, path)
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
KEYS_PER_FILTER = 4_000_000  # listed keys of one cascade: its arrays stay below about 20 MB
LATER_HASHES = 4  # hashes of the levels after the first: one key in 16 passes wrongly


def host_of(url: Column) -> Column:
    return lower_ascii(F.regexp_extract(rest_of(url), r"^([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(rest_of(url), r"^[^/?#]*([^?#]*)", 1)


def rest_of(url: Column) -> Column:
    """What follows the first ``://``; empty for null or without it."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def longest_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """struct(rule, action) of the longest rule that fits host and path, else null."""
    chain = []
    for action, rule_host, rule_path in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        chain.append(F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(action).alias("action"))))
    none = F.lit(None).cast("struct<rule:string,action:string>")
    return F.coalesce(*chain, none)


def key_hashes(key: Column) -> tuple[Column, Column]:
    """Two 64-bit hashes that stand for a key."""
    return F.xxhash64(key).alias("x1"), F.xxhash64(key, F.lit("second")).alias("x2")


def positions(level: int, n_hashes: int, n_bits: int) -> list[Column]:
    """Bit places of a key at one level."""
    return [F.pmod(F.xxhash64("x1", "x2", F.lit(level), F.lit(i)), F.lit(n_bits)) for i in range(n_hashes)]


def one_bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int"))


class Level:
    """One Bloom filter: its stored words as a one-row table, and the test of a key."""

    def __init__(self, number: int, keys: DataFrame, n_keys: int, n_hashes: int):
        self.number, self.n_hashes = number, n_hashes
        words = max(1, math.ceil(n_keys * n_hashes / math.log(2) / 64))
        self.n_bits = 64 * words
        bits = keys.select(F.explode(F.array(*positions(number, n_hashes, self.n_bits))).alias("bit")).select(
            F.shiftright("bit", 6).alias("word"),
            one_bit(F.col("bit")).alias("mask"),
        )
        filled = keys.sparkSession.range(words).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("mask"))
        # one row of bounded size: KEYS_PER_FILTER keys at most
        row = bits.unionByName(filled).groupBy("word").agg(F.bit_or("mask").alias("mask")).agg(
            F.transform(F.array_sort(F.collect_list(F.struct("word", "mask"))), lambda s: s["mask"]).alias("words")
        )
        self.words = save_table(row, f"cascade-{number}")

    def passes(self) -> Column:
        """True if the key may be in the filter; always true for keys that were put in."""
        words = self.words.scalar()
        ok = F.lit(True)
        for at in positions(self.number, self.n_hashes, self.n_bits):
            ok = ok & (F.get(words, F.shiftright(at, 6).cast("int")).bitwiseAND(one_bit(at)) != 0)
        return ok


def build_cascade(universe: DataFrame) -> list[Level]:
    """Levels for distinct keys (x1, x2, listed): odd ones hold listed keys, even ones the others.

    The first level holds the listed keys; each next one the keys of the other kind that pass
    the level before it wrongly. It ends when none passes, so every key of the universe is
    judged exactly.
    """
    kept = save_table(universe.filter("listed").select("x1", "x2"), "cascade-keys")
    others = save_table(universe.filter("NOT listed").select("x1", "x2"), "cascade-others")
    n_kept, n_others = kept.count(), others.count()
    levels: list[Level] = []
    while n_kept:
        # the first level lets through about as many others as there are listed keys
        hashes = LATER_HASHES if levels else max(1, math.ceil(math.log2(max(2.0, n_others / n_kept))))
        level = Level(len(levels) + 1, kept, n_kept, hashes)
        levels.append(level)
        wrong = save_table(others.filter(level.passes()), "cascade-keys")
        kept, others, n_kept = wrong, kept, wrong.count()
    return levels


def is_listed(levels: Sequence[Level]) -> Column:
    """Exact membership for keys (x1, x2) of the universe the cascade was built from."""
    listed = F.lit(len(levels) % 2 == 1)
    for level in reversed(levels):
        listed = F.when(level.passes(), listed).otherwise(F.lit(level.number % 2 == 0))
    return listed


def url_verdicts(
    pages: DataFrame,
    listed: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    rules: Sequence[tuple[str, str, str]] = RULES,
    keys_per_filter: int = KEYS_PER_FILTER,
) -> DataFrame:
    """page_id, host, path, rule, verdict, listed per row; ``listed`` has the column ``key`` (host + path).

    The longest fitting rule decides. Where none fits, a page is blocked if host + path is a listed
    key. Membership is tested with a filter cascade over the keys of ``pages`` and is exact. Keys
    are split by hash into groups, so that a cascade holds about ``keys_per_filter`` listed keys;
    the rows of each group are judged with its own cascade, which is sent to the tasks as a
    scalar value of bounded size. Null urls and urls without ``://`` have an empty host and path,
    no rule, and are allowed. Repeated rows are judged each; further columns are ignored.
    """
    url = F.col(url_col)
    rows = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    rows = rows.withColumn("key", F.concat("host", "path"))
    keys = rows.filter("key <> ''").select("key", F.lit(0).alias("l")).unionByName(
        listed.filter("key IS NOT NULL AND key <> ''").select("key", F.lit(1).alias("l"))
    )
    # listed keys that no page has need no place in a filter
    universe = keys.groupBy("key").agg(F.max("l").alias("l"), F.min("l").alias("m")).filter("m = 0")
    universe = save_table(
        universe.select(*key_hashes(F.col("key")), (F.col("l") == 1).alias("listed")), "url-keys"
    )
    groups = max(1, math.ceil(universe.filter("listed").count() / keys_per_filter))
    fit = longest_rule(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", *key_hashes(F.col("key")), fit.alias("fit"))
    judged = None
    for group in range(groups):
        mine = F.pmod(F.col("x1"), F.lit(groups)) == group
        levels = build_cascade(universe.filter(mine))
        listed_now = F.when(F.col("key") == "", F.lit(False)).otherwise(is_listed(levels))
        part = rows.filter(mine).withColumn("listed", listed_now)
        judged = part if judged is None else judged.unionByName(part)
    block = F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))
    return judged.select(
        "page_id", "host", "path", F.col("fit.rule").alias("rule"),
        F.coalesce(F.col("fit.action"), block).alias("verdict"), "listed",
    )


def toxic_page_keys(pages: DataFrame, labels: DataFrame, url_col: str = "url") -> DataFrame:
    """Block list of the query: keys of pages whose path names a document labelled toxic."""
    url = F.col(url_col)
    named = F.regexp_extract(path_of(url), r"/([0-9]+)", 1).try_cast("long")
    keys = pages.select(F.concat(host_of(url), path_of(url)).alias("key"), named.alias("doc_id"))
    bad = labels.filter("toxic = 1 AND doc_id IS NOT NULL").select("doc_id").distinct()
    return keys.join(bad, "doc_id", "left_semi").select("key").distinct()


VERDICT_SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (
  SELECT page_id,
    translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
bad AS (
  SELECT DISTINCT host || path AS key FROM p
  WHERE try_cast(regexp_extract(path, '/([0-9]+)', 1) AS BIGINT) IN (SELECT doc_id FROM labels WHERE toxic = 1)),
rules(action, rhost, rpath) AS (VALUES
  ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
  ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
fit AS (
  SELECT host, path, arg_max(rhost || rpath, length(rhost || rpath)) AS rule,
    arg_max(action, length(rhost || rpath)) AS action
  FROM (SELECT DISTINCT host, path FROM p) JOIN rules
    ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY 1, 2)
SELECT page_id, host, path, rule,
  coalesce(action, CASE WHEN host || path <> '' AND host || path IN (SELECT key FROM bad) THEN 'block' ELSE 'allow' END) AS verdict,
  host || path <> '' AND host || path IN (SELECT key FROM bad) AS listed
FROM p LEFT JOIN fit USING (host, path)
"""
