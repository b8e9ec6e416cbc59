"""Cases that once crashed or lost data, against brute-force versions."""

from __future__ import annotations

import collections
import ctypes
import math
import random
import re
import tracemalloc
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from framesift.llm import common, components, langid, minhash, mixing, packing, privacy
from framesift.llm.common import prepare

RNG = random.Random(11)
VOCABULARY = ["".join(RNG.choices("abcdefghijklmnop", k=RNG.randint(1, 9))) for _ in range(500)]


def prose(n: int) -> str:
    return " ".join(RNG.choices(VOCABULARY, k=n))


@pytest.fixture(scope="module")
def tokenizer():
    import tokenizers

    return tokenizers.Tokenizer.from_file(packing.tokenizer_path())


def test_long_runs_of_blanks_have_the_ids_of_the_library(spark, tokenizer):
    prepare(spark)
    encode = packing.encoder(packing.TOKENIZER_FILE)
    texts = [" " * 1_200_000, "a" + " " * 1_200_000 + "b", "\t" * 30_000 + "　" * 30_000 + " x", "q" + " \n" * 9_000 + "'s", " " * 12_000 + "<|endoftext|>" + "\n" * 12_000, "\x1c" * 11_000 + " a"]
    for text in texts:
        assert packing.encoded(encode, text) == tokenizer.encode(text, add_special_tokens=False).ids
    docs = spark.createDataFrame([(1, texts[1]), (2, "short")], "doc_id long, text string")
    got = packing.packing_report(docs).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r["doc_id"]: r["n"] for r in got} == {i: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for i, t in ((1, texts[1]), (2, "short"))}


def test_other_tokenizer_files_are_refused():
    import json

    with open(packing.tokenizer_path(), encoding="utf-8") as f:
        spec = json.load(f)
    added = {x["content"]: x["id"] for x in spec["added_tokens"]}
    packing.check_tokenizer(spec, added)
    merges = spec["model"]["merges"]
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"model": spec["model"] | {"ignore_merges": True}},
                   {"model": spec["model"] | {"merges": [merges[1], merges[0], *merges[2:]]}}):
        with pytest.raises(ValueError):
            packing.check_tokenizer(spec | change, added)


def test_long_runs_of_zeros(spark):
    texts = ["0" * 5000 + ".1.1.1", "1." + "0" * 6000 + "255.2.3 x", "0" * 5000 + "256.1.1.1", "0" * 9000]
    got = {r["doc_id"]: r for r in privacy.privacy_report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i]["n_ip"] for i in range(4)] == [1, 1, 0, 0] and got[0]["spans"].startswith("ip:0:5006")


def expected_terms(rows):
    """(doc_id, text) -> places and what is shown, PMI of every entity and term of all rows recomputed."""
    seen = [(set(privacy.entities_of(t or "", privacy.base_spans(t or ""))), privacy.terms_and_prefixes(t or "")) for _, t in rows]
    n_e, n_t, n_et = (collections.Counter() for _ in range(3))
    for entities, terms in seen:
        n_e.update(entities)
        n_t.update(terms)
        n_et.update((e, t) for e in entities for t in terms)
    out = []
    for (_, text), (entities, terms) in zip(rows, seen):
        def telling(t):
            return any(n_e[e] < len(rows) and math.log(len(rows) * n_et[e, t] / (n_e[e] * n_t[t])) >= privacy.DISCLOSURE * math.log(len(rows) / n_e[e]) - 1e-12 for e in entities)

        over = {t: telling(t) for t in terms}
        spans = privacy.base_spans(text or "")
        found = [(k, s, e, f"[{privacy.KINDS[k].upper()}]") for k, s, e in spans]
        for m in re.finditer(r"\w+", text or ""):
            term = m[0].lower()
            if over.get(term) and not any(s < m.end() and m.start() < e for _, s, e in spans):
                short = term[: min(3, len(term) // 2)] + "~"
                found.append((4, m.start(), m.end(), privacy.REMOVED if short == "~" or over[short] else short))
        out.append(sorted(found))
    return out


def test_terms_are_those_of_a_plain_count(spark):
    people = [(f"u{i}@mail{i % 7}.org", f"Qx{i} zeb{i} {VOCABULARY[i]}{i} k-{i:03d}") for i in range(40)]
    rows = []
    for i in range(300):
        text = prose(RNG.randint(3, 60))
        for address, told in RNG.sample(people, RNG.choice([0, 0, 1, 1, 2, 5])):
            text += f" {address} {told if RNG.random() < 0.7 else ''} {prose(4)}"
        rows.append((i, text))
    rows += [(900, None), (901, ""), rows[0], rows[0], (None, rows[5][1]), (5, "other text of the id, +49 170 1234567 zq al"), (902, " ".join(f"p{i}@x.org" for i in range(400)) + " zeb long"), (903, "z " * 20_000 + "last@one.org")]
    docs = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], "doc_id long, text string, term string, grp string, mark string")
    got = privacy.private_spans(docs.repartition(7)).collect()
    want = collections.Counter((r[0], str(s)) for r, s in zip(rows, expected_terms(rows)))
    assert collections.Counter((r["doc_id"], str([tuple(s) for s in r["spans"]])) for r in got) == want
    shown = {s["shown"] for r in got for s in r["spans"]}
    assert privacy.REMOVED in shown and any(s.endswith("~") for s in shown)
    masked = privacy.masked(docs, privacy.private_spans(docs))
    assert masked.count() == len(rows) and masked.filter("text IS NULL").count() == 1
    empty = docs.limit(0)
    assert privacy.private_spans(empty).count() == 0 and privacy.masked(empty, privacy.private_spans(empty)).count() == 0


def test_generalised_terms_never_show_the_whole():
    for term in ("a", "ab", "zeb", "1234", "user_42", "é"):
        kept = privacy.generalised(term)[:-1]
        assert len(kept) <= len(term) / 2 and len(kept) <= 3


def test_rows_of_one_id_with_other_texts_stay(spark):
    a, b, c = prose(80), prose(80), prose(80)
    rows = [(1, a, "p"), (2, b, "q"), (2, a, "q"), (3, c, "r"), (3, c, "s"), (3, c, "s"), (None, a, "t"), (4, None, "u"), (4, "", "u")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = {tuple(sorted(map(str, minhash.first_of_each_group(docs.repartition(n)).collect()))) for n in (1, 3, 8)}
    assert len(found) == 1
    kept = [(r["doc_id"], r["text"]) for r in minhash.first_of_each_group(docs).collect()]
    assert sorted(kept, key=str) == sorted([(1, a), (2, b), (3, c), (None, a), (4, None), (4, "")], key=str)


def test_shared_keys(spark, monkeypatch):
    monkeypatch.setattr(minhash, "SAMPLE_OF", 2)
    monkeypatch.setattr(minhash, "HOT_ROWS", 3)
    rows = []
    for i in range(300):
        values = [RNG.randrange(1 << 16) for _ in range(minhash.VALUES)] if i % 3 else [7] * minhash.VALUES
        values[i % minhash.VALUES] = i
        rows.append((i, b"".join(v.to_bytes(2, "little") for v in values)))
    classes = spark.createDataFrame(rows, "rep long, sig binary")
    keys = [(r["key"], r["rep"]) for r in minhash.chunk_keys(classes).collect()]
    n = collections.Counter(k for k, _ in keys)
    for rows_a_batch in (10, 2000):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows_a_batch))
        got = [(r["key"], r["rep"]) for r in minhash.shared_keys(classes.repartition(5)).collect()]
        assert sorted(got) == sorted(k for k in keys if n[k[0]] > 1) and max(n.values()) > 50


def test_language_of_nothing_and_too_many_labels(spark, monkeypatch):
    docs = spark.createDataFrame([(i, prose(30), f"l{i}") for i in range(40)], "doc_id long, text string, lang string")
    assert langid.language_report(docs.limit(0)).count() == 0
    monkeypatch.setattr(langid, "PROFILE_BYTES", 8 * langid.DIMENSIONS * 10)
    with pytest.raises(ValueError):
        langid.language_profiles(docs)


def test_mixture_shuffles_texts_once(spark):
    """The keys that drop repeated rows are those of the join, so no exchange of texts by other keys is left."""
    docs = spark.createDataFrame([(i, f"word{i} and more of it " * 9, "ab"[i % 2]) for i in range(60)], "doc_id long, text string, source string")
    plan = mixing.mixed_documents(docs)._jdf.queryExecution().executedPlan().toString()
    by = re.findall(r"hashpartitioning\(([^)]*)\)", plan)
    keys = [re.findall(r"(\w+)#", one) for one in by]
    assert ["doc_id", "mark", "source"] not in keys and ["known", "mark", "line"] in keys


def test_grams_are_counted_in_small_lots(monkeypatch):
    monkeypatch.setattr(langid, "HELD_GRAMS", 500)
    lots = [langid.grams(prose(RNG.randint(1, 60))) for _ in range(200)]
    counts, most = langid.GramCounts(), 0
    for keys in lots:
        counts.add(keys)
        most = max(most, counts.size)
    gram, n = counts.counted()
    want = collections.Counter(np.concatenate(lots).tolist())
    assert dict(zip(gram.tolist(), n.tolist())) == want and most < 500
    assert (np.diff(gram) > 0).all() and not langid.GramCounts().counted()[0].size


def test_workers_give_freed_memory_back():
    if not hasattr(ctypes.CDLL(None), "malloc_trim"):
        pytest.skip("not the GNU C library")
    kept = []

    def held_mb() -> float:
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * 4096 / 1e6

    def work(batches):
        for n in batches:
            blocks = [bytes(1000) for _ in range(n)]
            kept.append(bytes(1000))  # stands above the freed blocks, so nothing is given back by itself
            del blocks
            yield n

    assert list(work(iter([100_000]))) == [100_000]
    before = held_mb()
    assert list(common.giving_back(work)(iter([1, 100_000, 2]))) == [1, 100_000, 2]
    assert before - held_mb() > 50


def test_ids_are_kept_short_until_they_are_packed(spark):
    """Token ids below 65,536 take two bytes where they are stored and shuffled, four in the result."""
    docs = spark.createDataFrame([(i, f"text number {i} " * (300 * i)) for i in range(5)] + [(9, None)], "doc_id long, text string")
    stored = {(r["doc_id"], r["piece"]): r for r in packing.tokenised_pieces(docs).collect()}
    assert all(len(r["ids"]) == 2 * r["length"] for r in stored.values())
    packed = packing.packed_pieces(docs).collect()
    assert len(packed) == len(stored) > 6
    for r in packed:
        short = stored[r["doc_id"], r["piece"]]
        assert bytes(r["ids"]) == np.frombuffer(short["ids"], "<u2").astype("<u4").tobytes() and len(r["ids"]) == 4 * r["length"]
        assert zlib.crc32(r["ids"]) == short["ids_crc32"]


def test_long_ids_stay_as_they_are(spark):
    rows = [(1, 2, np.array([1, 65535], "<u2").tobytes()), (2, 2, np.array([1, 65536], "<u4").tobytes()), (3, 1, np.array([7], "<u2").tobytes())]
    pieces = spark.createDataFrame(rows, "item long, length long, ids binary").coalesce(1)
    got = {r["item"]: np.frombuffer(r["ids"], "<u4").tolist() for r in packing.widened(pieces).collect()}
    assert got == {1: [1, 65535], 2: [1, 65536], 3: [7]}


def test_star_forest_is_told_in_one_query(spark, monkeypatch):
    heads = []
    frame = type(spark.range(0))
    head = frame.head
    monkeypatch.setattr(frame, "head", lambda self, *a: (heads.append(1), head(self, *a))[1])
    for edges, forest in (([(2, 1), (3, 1), (9, 5)], True), ([], True), ([(2, 1), (3, 2)], False), ([(3, 1), (3, 2)], False)):
        heads.clear()
        assert components.is_star_forest(spark.createDataFrame(edges, "a long, b long")) == forest
        assert len(heads) == 1


def test_pairs_of_a_large_block_are_compared_in_small_slices():
    """700 equal signatures in different components and 300 others: all pairs of the former, in little memory."""
    import pyarrow as pa

    rng = np.random.default_rng(3)
    same = rng.integers(0, 1 << 16, minhash.VALUES, np.uint16).astype("<u2").tobytes()
    sigs = [same] * 700 + [rng.integers(0, 1 << 16, minhash.VALUES, np.uint16).astype("<u2").tobytes() for _ in range(300)]
    zero = pa.array([0] * 1000, pa.int64())
    part = pa.table({
        "key": pa.array([minhash.SLOTS + 1] * 1000, pa.int64()), "_diag": pa.array([True] * 1000), "_i": zero, "_j": zero, "_at": zero,
        "component": pa.array(range(1000), pa.int64()), "sig": pa.array(sigs, pa.binary()),
    })
    tracemalloc.start()
    found = sum(len(i) for i, _ in minhash.close_pairs(part, minhash.MAX_DISTANCE))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == 700 * 699 // 2
    assert peak < 40e6
