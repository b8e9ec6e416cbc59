"""Periodic runs, fingerprints and spelling variants against brute-force versions, and their edge cases."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from framesift.llm import fingerprints, periodic, variants
from framesift.llm.common import prepare

RNG = random.Random(5)
SCHEMA = "doc_id long, text string, word string, n long, start string, _slice string, runs string, fingerprint string, block string"
SYLLABLES = ["ka", "lo", "mi", "ten", "ér", "su", "ba", "rin", "ö"]


def sentence() -> str:
    return " ".join("".join(RNG.choices(SYLLABLES, k=RNG.randint(1, 5))) for _ in range(RNG.randint(1, 9))).capitalize() + "."


def prose(n: int) -> str:
    return "".join(sentence() + RNG.choice([" ", " ", "\n"]) for _ in range(n))


def rows() -> list[tuple]:
    texts = [None, "", " \t\n", "One", prose(40), prose(3), "a b " * 40 + "c " * 9, prose(400), "x" * 70_000, "é ß 漢字 \U0001f600. " * 8, "Zz z \x0b y " * 9]
    texts += [prose(RNG.randint(1, 30)) for _ in range(60)]
    out = [(i, t) for i, t in enumerate(texts)]
    out += [out[4], out[4], (4, "another text of the same id"), (None, prose(9)), (None, None), (-7, prose(6)), (1 << 60, texts[4])]
    return [(*r, *["x"] * 1, 3, *["y"] * 5) for r in out]


ROWS = rows()


@pytest.fixture(scope="module")
def docs(spark):
    prepare(spark)
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def runs_of(w: list) -> list[tuple[int, int, int]]:
    """All maximal runs, every period tried word by word, smallest first."""
    found = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            start = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i > start and i - start + q >= max(6, 4 * q):
                found.setdefault((start, i - start + q), q)
            i += i == start
    return sorted((s, n, q) for (s, n), q in found.items())


def test_word_runs():
    texts = []
    for _ in range(800):
        w = [RNG.choice("abcdefghijklmnop"[: RNG.choice([1, 2, 3, 16])]) for _ in range(RNG.randint(0, 50))]
        for _ in range(RNG.randint(0, 3)):
            unit = [RNG.choice("abcxyz") for _ in range(RNG.randint(1, 6))]
            at = RNG.randint(0, len(w))
            w[at:at] = (unit * 40)[: RNG.randint(1, 40)]
        texts.append(w)
    want = [runs_of(w) for w in texts]
    assert periodic.word_runs(texts) == want and sum(map(len, want)) > 500
    for text, runs in zip(texts[:200], want):  # a text by itself gives what it gives among others
        assert periodic.word_runs([text]) == [runs]
        for start, n, q in runs:
            part = text[start : start + n]
            assert all(any(a != b for a, b in zip(part, part[p:])) for p in range(1, q))


def test_long_runs():
    text = ["a"] * 30_000 + [str(i) for i in range(500)] * 20 + [str(i) for i in range(9_000)]
    assert periodic.word_runs([text]) == [[(0, 30_000, 1), (30_000, 10_500, 500)]]  # the last 500 are the start of the plain count


def planted(doc_id, text):
    w = words(text)
    h = zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    g = h // 10
    if h % 10 == 0 and w:
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
    return w


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def test_runs_report(docs, nothing):
    many = docs.unionByName(docs.withColumn("doc_id", F.pmod("doc_id", F.lit(1000)) * 977 + 3))
    want = []
    for doc_id, text in [(r["doc_id"], r["text"]) for r in many.collect()]:
        w = planted(doc_id, text)
        runs = sorted(runs_of(w), key=lambda r: (r[0], r[2]))
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        told = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        want.append((doc_id, len(runs), *told, sha(lines), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    got = periodic.runs_report(many).select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got.collect())
    assert sum(r[1] > 0 for r in want) > 5
    assert periodic.runs_report(nothing).count() == 0


def test_fingerprint_report(spark, docs, nothing):
    order = sorted(((r[0], r[1] or "") for r in ROWS), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    want = collections.Counter()
    for i, (doc_id, text) in enumerate(order):
        half = len(text) // 2
        following = order[(i + 1) % len(order)][1]
        want[(doc_id, len(text), sha(text[: len(text) - half] + following[:half]))] += 1
    for partitions in (1, 8):
        spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
        try:
            got = fingerprints.fingerprint_report(docs.repartition(5)).collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "8")
        assert collections.Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == want
        assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    by_text = collections.defaultdict(set)
    for r in docs.join(fingerprints.fingerprints(docs.select("doc_id", "text").withColumn("key", F.monotonically_increasing_id()), ["key", "text"], "text"), "text").collect():
        by_text[r["text"]].add(str(r["fingerprint"]))
    assert all(len(v) == 1 for v in by_text.values())
    assert fingerprints.fingerprint_report(nothing).count() == 0
    alone = fingerprints.fingerprint_report(docs.filter("doc_id = 7")).collect()
    assert len(alone) == 1 and alone[0]["near_next"] == 1.0


def test_fingerprints_are_homomorphic(spark):
    lines = [sentence() for _ in range(40)]
    texts = {"ab": lines, "ba": lines[::-1], "a": lines[:15], "b": lines[15:], "twice": lines + lines[:15], "many": ["Same."] * 300_000, "few": ["Same."] * 100_000}
    table = spark.createDataFrame([(k, "\n".join(v)) for k, v in texts.items()], "key string, text string")
    prints = fingerprints.fingerprints(table, ["key"], "text")
    found = {r["key"]: r["fingerprint"] for r in prints.collect()}
    assert found["ab"] == found["ba"] != found["a"]
    assert found["many"][0] == 300_000 and found["few"][0] == 100_000  # summed in chunks
    one = spark.createDataFrame([tuple(found[k] for k in ("ab", "a", "b", "twice", "few", "many"))], "ab array<long>, a array<long>, b array<long>, twice array<long>, few array<long>, many array<long>")
    got = one.select(
        fingerprints.combined(F.col("a"), F.col("b")).alias("ab"), fingerprints.removed(F.col("ab"), F.col("b")).alias("a"),
        fingerprints.combined(F.col("ab"), F.col("a")).alias("twice"), fingerprints.removed(F.col("twice"), F.col("ab")).alias("again"),
        fingerprints.combined(fingerprints.combined(F.col("few"), F.col("few")), F.col("few")).alias("many"),
    ).first()
    assert (got["ab"], got["a"], got["twice"], got["again"], got["many"]) == (found["ab"], found["a"], found["twice"], found["a"], found["many"])


def test_likeness_follows_common_paragraphs(spark):
    lines = [f"line {i} of {RNG.random()}" for i in range(600)]
    cases = [(i, "\n".join(lines[:200]), "\n".join(lines[200 - i * 20 : 400 - i * 20])) for i in range(11)]
    table = spark.createDataFrame(cases, "key long, a string, b string")
    a, b = (fingerprints.fingerprints(table, ["key"], c).select("key", F.col("signs").alias(c)) for c in "ab")
    p = fingerprints.product
    got = a.join(b, "key").select("key", fingerprints.likeness(p(F.col("a"), F.col("b")), p(F.col("a"), F.col("a")), p(F.col("b"), F.col("b"))).alias("near"))
    for r in got.collect():
        assert abs(r["near"] - r["key"] / 10) < 0.2
    assert {r["key"]: r["near"] for r in got.collect()}[10] == 1.0


def counted(rows) -> dict:
    n = collections.Counter()
    upper = {c: c + 32 for c in range(65, 91)}
    for r in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", r[1] or ""):
            w = w.translate(upper)
            h = zlib.crc32(f"{'' if r[0] is None else r[0]}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= 7:
                n[w] += 1
    return {w: k for w, k in n.items() if k >= 2}


def near(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(a == b[:i] + b[i + 1 :] for i in range(len(b)))


def forms(n: dict) -> set[tuple]:
    form, near_n = {}, {}
    for w in n:
        others = [x for x in n if near(w, x)]
        near_n[w] = len(others)
        best = min(others, key=lambda x: (-n[x], x), default=None)
        if best is not None and n[best] >= 10 * n[w]:
            form[w] = best
    out = set()
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n[w], near_n[w], n.get(form.get(w))))
    return out


COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def test_variants_report(spark, docs, nothing):
    base = ["kalominten", "érsubarin", "tenkaloba", "minrinten"]
    more = [(1000 + i, " ".join(RNG.choices(base, k=400)) + " " + RNG.choice(base)[:-1] + "x É" + RNG.choice(base)) for i in range(40)]
    rows = [(r[0], r[1]) for r in ROWS] + more + more[:2]
    table = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more + more[:2], "doc_id long, text string"))
    want = forms(counted(rows))
    got = variants.variants_report(table.withColumn("word", F.lit("clash")).withColumn("n", F.lit(1)))
    assert {tuple(r) for r in got.select(*COLUMNS).collect()} == want
    assert sum(w[1] is not None for w in want) > 10
    assert variants.variants_report(nothing).count() == 0


def test_near_words_in_small_branches(spark):
    """Tiny branches, blocks of words of equal counts, long words and counts beyond 255 give the same links."""
    found = {"".join(RNG.choices("etao", k=RNG.randint(1, 8))) for _ in range(500)}
    found |= {"".join(RNG.choices("eylz", k=9)) for _ in range(300)}
    found |= {"e" * k + "t" * j + "ÿ" * i for k in (253, 254, 255, 256, 300, 301) for j in (0, 1, 2) for i in (0, 1)}
    table = spark.createDataFrame([(w, len(w)) for w in found], "word string, n long")
    want = {(a, b) for a in found for b in found if a < b and near(a, b)}
    for most, group in ((16_384, 256), (40, 3), (5, 1)):
        got = [(r["a"], r["b"]) for r in variants.near_words(table, branch_words=most, group_words=group).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_roots_follow_chains(spark):
    chain = [("abcdefgh" + "i" * k, 10**k) for k in range(1, 10)]
    got = {r["word"]: r for r in variants.spelling_forms(spark.createDataFrame(chain, "word string, n long")).collect()}
    assert {r["root"] for r in got.values()} == {chain[-1][0]}
    assert got[chain[0][0]]["form"] == chain[1][0] and got[chain[-1][0]]["form"] is None
