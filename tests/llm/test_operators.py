"""Training-data operators against brute-force versions on small tables, and their edge cases."""

from __future__ import annotations

import collections
import gzip
import hashlib
import io
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from framesift.llm import itq, langid, minhash, mixing, packing, preference, privacy, rabitq, urlfilter, warc
from framesift.llm.common import prepare
from framesift.llm.components import connected_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, mark string, size string, rep string, id string"
RNG = np.random.default_rng(1)
VOCABULARY = ["".join(RNG.choice(list("abcdefghijklmnoprstu"), RNG.integers(2, 8))) for _ in range(400)]


def prose(n: int) -> str:
    return " ".join(RNG.choice(VOCABULARY, n))


def edge_rows() -> list[tuple]:
    twin = prose(60)
    texts = [None, "", " \t\n", "One", "ONE", "12345 !!", prose(30_000), twin, twin, twin + " more", prose(5), "é ß 漢字"]
    rows = [(i, t, None if i % 3 == 0 else "en", [None, "a", "B"][i % 3], len(t or ""), "x", "y", "z", "w") for i, t in enumerate(texts)]
    return [*rows, rows[7], rows[7], (None, prose(20), None, "a", 1, "x", "y", "z", "w")]


EDGES = edge_rows()


@pytest.fixture(scope="module")
def edges(spark):
    prepare(spark)
    return spark.createDataFrame(EDGES, DOCS)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def groups(n_or_ids, links):
    root = {i: i for i in n_or_ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in root}


def test_components(spark):
    links = [(int(a), int(b)) for a, b in RNG.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(400, 460)]
    got = connected_components(spark.createDataFrame(links, "a long, b long")).collect()
    want = groups({x for p in links for x in p}, links)
    seen = {x for a, b in links if a != b for x in (a, b)}
    assert {r[0]: r[1] for r in got} == {i: want[i] for i in seen}


def test_warc_round_trip(spark, tmp_path):
    body = "x" * 200
    rows = [(1, "http://a/1", body), (2, None, body), (3, "u\r\nv", "short"), (4, "u", "short"), (5, "u", None),
            (6, "u", "é" * 60), (None, "u", body), (7, "u", prose(30_000)), (1, "http://a/1", body)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.write_archives(pages.repartition(3), f"file://{tmp_path}/w").count()
    for split in (97, 4096, 1 << 24):  # any cut of the files gives the same records
        got = warc.read_archives(spark, f"file://{tmp_path}/w", split_bytes=split)
        seen = sorted((str(warc_id), r["record_type"], r["payload_bytes"], r["payload_digest"], r["digest_ok"], str(r["refers_to"]))
                      for r in warc.page_records(got).collect() for warc_id in [r["page_id"]])
        want = []
        for page_id, _, html in rows:
            data = (html or "").encode()
            revisit = html == body and page_id == 2
            want.append((str(page_id), "revisit" if revisit else "response", len(data), hashlib.sha256(data).hexdigest(), True, "1" if revisit else "None"))
        assert seen == sorted(want)
    empty = spark.createDataFrame([], pages.schema)
    assert warc.write_archives(empty, f"file://{tmp_path}/none").count() == 0


def test_warc_passes_over_damage_and_false_magic():
    good = [warc.gzip_member(warc.record_bytes(i, "u", prose(50).encode(), "d", None, warc.DATE)) for i in range(4)]
    noise = warc.MAGIC + b"\0" * 20
    other = gzip.compress(b"not an archive")
    data = good[0] + good[1][:40] + noise + good[2] + other + good[3]
    for cut in (10, 64, 1 << 20):
        seen = [d for s in range(0, len(data), cut) for d in warc.members(io.BytesIO(data), s, min(s + cut, len(data)), len(data))]
        ids = [warc.parse_record(d)["record_id"] for _, d in seen]
        assert ids == ["<urn:page:0>", "<urn:page:2>", "<urn:page:3>"]
    # an archive kept inside a record is not read as records of its own
    inner = warc.record_bytes(9, "u", good[1] + b"tail", "d", None, warc.DATE)
    packer = zlib.compressobj(0, zlib.DEFLATED, 31)
    outer = packer.compress(inner) + packer.flush()
    seen = list(warc.members(io.BytesIO(outer), 5, len(outer), len(outer)))
    assert seen == []


def test_preference(spark):
    c = [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 1, "assistant", "a"), (1, 2, "user", None), (1, 3, "assistant", "b"),
         (2, 0, "user", "same"), (3, 0, "user", "only chosen"), (None, 0, "user", "x"), (4, None, "user", "x")]
    r = [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 2, "user", None), (1, 3, "assistant", "c" * 50_000), (2, 0, "user", "same")]
    schema = "pair_id long, turn long, role string, text string"
    segments = preference.preference_segments(spark.createDataFrame(c, schema), spark.createDataFrame(r, schema))
    got = {x["pair_id"]: x for x in preference.preference_rows(segments).collect()}
    assert set(got) == {1, 2, 3}
    assert got[1]["prompt"] == "<|im_start|>user\nq<|im_end|>\n<|im_start|>assistant\na<|im_end|>\n<|im_start|>user\n<|im_end|>\n"
    for side, text in (("chosen", "b"), ("rejected", "c" * 50_000)):
        (span,) = got[1][f"{side}_mask"]
        assert got[1][side][span["start"] : span["end"]] == text + "<|im_end|>\n"
    assert (got[2]["chosen"], got[2]["rejected"]) == ("", "") and got[3]["prompt"] == "" and got[3]["chosen_mask"] == []
    assert preference.preference_segments(spark.createDataFrame([], schema), spark.createDataFrame([], schema)).count() == 0


BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def test_base_spans_follow_the_patterns():
    parts = ["a@b.c", "a@b.c_d@e.f", "@x.y", "u@v", "1.2.3.4.5", "256.1.1.1", "001.2.3.4", "4111 1111 1111 1111", "4111111111111112",
             "+1 (202) 555-0199", "+12", "+1.....2", "9" * 40, "..", "-", "é", "漢", "x.y@z-1.org.", "1.2.3.4"]
    for _ in range(400):
        text = "".join(str(RNG.choice(parts)) + str(RNG.choice(["", " ", ", ", "\n"])) for _ in range(8))
        want = []
        for kind, pattern in BASE.items():
            for m in pattern.finditer(text):
                digits = re.sub("[^0-9]", "", m[0])
                if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                    continue
                if kind == "card" and not (16 <= len(digits) <= 19 and privacy.luhn(digits)):
                    continue
                if kind == "phone" and not 8 <= len(digits) <= 15:
                    continue
                want.append((privacy.KINDS.index(kind), m.start(), m.end()))
        assert privacy.base_spans(text) == want, text
    assert privacy.base_spans("7" * 200_000 + "@" * 1000) == []


def test_telling_terms_are_masked(spark):
    rows = [(i, f"{prose(6)} zebrafish {prose(4)} jo@example.org {prose(5)}") for i in range(6)]
    rows += [(i, prose(40)) for i in range(10, 60)] + [(100, None), (101, ""), (102, rows[0][1]), (0, rows[0][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.length("text").cast("long"))
    spans = privacy.private_spans(docs)
    out = privacy.masked(docs, spans)
    assert out.count() == len(rows)
    for r in out.collect():
        assert "jo@" not in (r["text"] or "") and "zebrafish" not in (r["text"] or "")
        if 10 <= r["doc_id"] < 60:
            assert r["text"] == dict(rows)[r["doc_id"]]
    report = privacy.privacy_report(docs).filter("doc_id = 1").first()
    assert report["n_email"] == 1 and report["n_term"] >= 1 and report["spans"].startswith("email:")
    base = report["spans"].split(",")[0]
    assert report["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()


def test_term_beside_one_rare_entity_is_masked(spark):
    rows = [(i, "common words of every text follow here") for i in range(200)]
    rows += [(300, "common words by quokka jo@example.org follow here"), (301, "common words by words +1 202 555 0199 quail follow")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r["doc_id"]: r["text"] for r in privacy.masked(docs, privacy.private_spans(docs)).collect()}
    assert out[300] == "common words by [TERM] [EMAIL] follow here"
    assert out[301] == "common words by words [PHONE] [TERM] follow"
    assert all(out[i] == t for i, t in rows if i < 300)


def test_telling_terms_of_the_whole_document_are_masked(spark):
    filler = " ".join(["common words of every text"] * 100)
    rows = [(i, filler) for i in range(200)] + [(300, f"Quokka first. {filler} jo@example.org {filler} quokka"), (301, f"{filler} quokka")]
    # two entities in one text: for one the term is to be removed, so its first letters do not stay
    rows += [(i, f"{filler} one@example.org zebra") for i in range(310, 320)] + [(320, f"{filler} two@example.org one@example.org zebra")]
    rows += [(i, f"{filler} zebu") for i in range(330, 335)]
    many = " ".join(f"p{i}@example.org" for i in range(300))
    rows += [(400, f"{many} {filler} numbat"), (400, f"{many} {filler} numbat"), (None, f"+1 202 555 0199 {filler} wombat")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {}
    for r in privacy.masked(docs, privacy.private_spans(docs)).collect():
        out[r["doc_id"]] = r["text"]
    assert out[300] == f"[TERM] first. {filler} [EMAIL] {filler} [TERM]".replace("first", "[TERM]")
    assert out[301] == f"{filler} quokka"
    assert out[400] == f"{' '.join(['[EMAIL]'] * 300)} {filler} [TERM]" and out[None] == f"[PHONE] {filler} [TERM]"
    assert "zeb" not in out[310] and "zeb" not in out[320] and "zebu" in out[330]
    groups = privacy.document_groups(privacy.found_entities(docs))
    assert groups.filter("doc_id = 400").count() == 1  # not one per entity


def planted_vectors(n=400, dims=32):
    base = RNG.standard_normal((n, dims))
    near = base[:80] + 0.25 * RNG.standard_normal((80, dims))
    hot = base[5] + 0.05 * RNG.standard_normal((60, dims))
    x = np.concatenate([base, near, hot, base[:10], np.zeros((1, dims))]).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    return x, rows + [(9001, None), (9002, [float("nan")] * dims), (9003, [None] * dims), (None, x[0].tolist())]


def test_near_vectors(spark):
    x, rows = planted_vectors()
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit("clash"))
    unit = x.astype(float) / np.maximum(np.linalg.norm(x.astype(float), axis=1, keepdims=True), 1e-300)
    linked = unit @ unit.T >= 0.9
    np.fill_diagonal(linked, False)
    want = groups(range(len(x)), list(zip(*map(lambda a: a.tolist(), np.nonzero(linked)))))
    for block_rows in (16, 1024):
        got = itq.near_vectors(table, block_rows=block_rows).collect()
        assert len(got) == len(rows)
        by = {r["vec_id"]: r for r in got}
        n = sum(by[i]["n_links"] for i in range(len(x)))
        assert 0.97 * linked.sum() <= n <= linked.sum()
        assert all(by[i]["n_links"] <= linked[i].sum() for i in range(len(x)))
        assert np.mean([by[i]["component_id"] == want[i] for i in range(len(x))]) > 0.98
        assert by[9001]["kept"] and by[9002]["n_links"] == 0 and by[None]["kept"] and by[len(x) - 1]["kept"]
    assert itq.near_vectors(spark.createDataFrame([], table.schema)).count() == 0


def groups_of_ten(dims, offset, n=60):
    """Groups with pair cosines of about 0.92 after a common offset; (vectors, linked pairs)."""
    rng = np.random.default_rng(dims)

    def unit(*shape):
        x = rng.standard_normal(shape)
        return x / np.linalg.norm(x, axis=-1, keepdims=True)

    x = unit(n, 1, dims) + 0.29 * np.hypot(1, offset) * unit(n, 10, dims) + offset * unit(dims)
    x = x.reshape(-1, dims)
    to = x / np.linalg.norm(x, axis=1, keepdims=True)
    return x, np.nonzero(np.triu(to @ to.T >= 0.9, 1))


def test_vector_codes_find_links_at_every_width():
    sizes, most = itq.chunk_sizes(0.9), itq.allowed_distance(0.9)
    assert sizes == [16] * 4 and most == 22 and len(itq.chunk_sizes(0.8)) > 4
    for dims, offset in [(3, 0), (8, 0), (16, 0), (24, 0), (32, 0), (64, 0), (100, 0), (128, 0), (24, 2), (64, 1.5), (64, 2), (128, 2)]:
        x, (i, j) = groups_of_ten(dims, offset)
        code = itq.codes_of(x, itq.fit_rotation(x))
        met = (itq.canonical_keys(code[i], code[j], sizes) >= 0) & (np.bitwise_count(code[i] ^ code[j]) <= most)
        assert len(i) > 1000 and met.mean() >= 0.95, (dims, offset, met.mean())


def test_near_vectors_of_few_dimensions_or_with_an_offset(spark):
    for dims, offset in ((24, 0), (64, 2)):
        x, (i, _) = groups_of_ten(dims, offset, 30)
        table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
        n = itq.near_vectors(table).agg(F.sum("n_links")).first()[0]
        assert 0.95 * 2 * len(i) <= n <= 2 * len(i)


def test_nearest_vectors(spark):
    x, rows = planted_vectors()
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1))
    got = rabitq.nearest_vectors(table, lambda i: i % 10 == 0).collect()
    by = collections.defaultdict(list)
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        by[r["query_id"]].append(r)
    x = x.astype(float)[:-1]
    hits = total = 0
    for q in range(0, len(x), 10):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        best = np.lexsort((np.arange(len(x)), d))[:10]
        hits += len(set(best.tolist()) & {r["vec_id"] for r in by[q]})
        total += 10
        assert [r["rank"] for r in by[q]] == list(range(1, 11))
        assert all(abs(r["score"] - d[r["vec_id"]]) < 1e-9 for r in by[q])
    assert hits >= 0.97 * total and set(by) == set(range(0, len(x), 10))
    few = table.filter("vec_id < 3")
    assert rabitq.nearest_vectors(few, lambda i: i == 0).count() == 2
    assert rabitq.nearest_vectors(table.filter("vec_id > 9000"), lambda i: i > 0).count() == 0


def test_url_cascade_is_exact(spark):
    rows = [(i, f"https://H{i % 7}.example.{['org', 'com', 'net'][i % 3]}/{['en', 'es', 'fr'][i % 3]}/{i}?q#f") for i in range(3000)]
    rows += [(9000, None), (9001, "no scheme"), (9002, "x://HOST"), (9003, rows[0][1]), (None, "ftp://a.net/p")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("key", F.lit("clash"))
    keys = [f"h{i % 7}.example.{['org', 'com', 'net'][i % 3]}/{['en', 'es', 'fr'][i % 3]}/{i}" for i in range(0, 3000, 11)] + ["unseen/x"]
    listed = spark.createDataFrame([(k,) for k in keys], "key string")
    for per_filter in (100, 10_000):
        got = urlfilter.url_verdicts(pages, listed, keys_per_filter=per_filter).collect()
        assert len(got) == len(rows)
        assert all(r["listed"] == (r["host"] + r["path"] in set(keys)) for r in got)
    by = {r["page_id"]: r for r in got}
    assert (by[9000]["host"], by[9001]["path"], by[9002]["host"], by[9002]["path"]) == ("", "", "host", "")
    assert by[11]["verdict"] == "block" and by[11]["rule"] is None
    assert by[0]["rule"] == "org/" and by[0]["verdict"] == "allow" and by[3]["rule"] == "org/"
    none = urlfilter.url_verdicts(pages, listed.limit(0)).filter("rule IS NULL AND verdict = 'block'")
    assert none.count() == 0 and urlfilter.url_verdicts(pages.limit(0), listed).count() == 0


def brute_groups(rows, k, percent=80):
    sets = {}
    for doc_id, text in rows:
        w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        n = min(k, len(w))
        sets[doc_id] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
    ids = sorted(sets)
    links = [(a, b) for x, a in enumerate(ids) for b in ids[:x] if sets[a] and sets[b]
             and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return sets, groups(ids, links)


def test_duplicate_groups(spark, edges):
    texts = [prose(80) for _ in range(40)]
    for i in range(60):  # copies of copies with a few words changed, and a hot group
        w = texts[i % 40 if i < 40 else 3].split()
        for at in RNG.integers(0, len(w), RNG.integers(0, 6)):
            w[at] = str(RNG.choice(VOCABULARY))
        texts.append(" ".join(w))
    rows = list(enumerate(texts))
    sets, want = brute_groups(rows, 2)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for block_rows in (4, 256):
        got = {r["doc_id"]: r for r in minhash.duplicate_groups(docs, words=2, block_rows=block_rows).collect()}
        assert {i: r["component_id"] for i, r in got.items()} == want
        assert all(got[i]["n_shingles"] == len(sets[i]) and got[i]["kept"] == (want[i] == i) for i in got)
    sets, want = brute_groups([r[:2] for r in EDGES if r[0] is not None], 5)
    got = minhash.duplicate_groups(edges).collect()
    assert len(got) == edges.count()
    assert all(r["component_id"] == want[r["doc_id"]] for r in got if r["doc_id"] is not None)
    kept = minhash.first_of_each_group(edges)
    assert kept.columns == edges.columns
    assert kept.filter("doc_id IS NOT NULL").count() == len(set(want.values())) and kept.filter("doc_id IS NULL").count() == 1


def test_minhash_blocks_find_all_close_signatures(spark):
    sig = RNG.integers(0, 4, (60, minhash.VALUES)).astype("<u2")
    for i in range(1, 60):  # a chain of near signatures
        sig[i] = sig[i - 1]
        sig[i, RNG.permutation(minhash.VALUES)[:14]] = RNG.integers(10, 60_000, 14)
    rows = [(i, s.tobytes()) for i, s in enumerate(sig)]
    classes = spark.createDataFrame([(i, bytearray(s)) for i, s in rows], "rep long, sig binary")
    keys = minhash.chunk_keys(classes).withColumn("component", F.col("rep"))
    blocks = minhash.apart_blocks(keys, 8).join(classes, "rep")
    sets = spark.createDataFrame([(i, bytearray(np.array([1], np.uint64).tobytes())) for i in range(60)], "rep long, set binary")
    alive = minhash.block_candidates(blocks, 27)
    held = minhash.apart_blocks(alive, 4).join(classes, "rep").join(sets, "rep")
    got = sorted((max(r), min(r)) for r in minhash.block_links(held, 27, 80).collect())
    assert got == [(i, j) for i in range(60) for j in range(i) if (sig[i] != sig[j]).sum() <= 27]


def test_language(spark, edges):
    letters = {"aa": "aeioul", "bb": "bdgkrz", "cc": "aemnst"}
    rows = [(i, " ".join("".join(RNG.choice(list(letters[x]), 5)) for _ in range(30)), x) for i, x in enumerate(sorted(letters) * 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.language_report(docs).collect()
    held = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0}
    truth = {i: x for i, _, x in rows}
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got)
    profiles = langid.language_profiles(docs)
    found = langid.identify_language(edges.withColumn("score", F.lit("old")), profiles).collect()
    by = {r["doc_id"]: r for r in found}
    assert len(found) == edges.count() and all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (0, 1, 2, 5))
    # a document's cosine is that of the bundle of its bound letter vectors
    text = "ab c"
    bundle = sum(
        np.roll(langid.letter_vector(a, 1024, langid.SEED), 2).astype(float) * np.roll(langid.letter_vector(b, 1024, langid.SEED), 1)
        * langid.letter_vector(c, 1024, langid.SEED)
        for a, b, c in ((0, 97, 98), (97, 98, 0), (98, 0, 99), (0, 99, 0))
    )
    cosine = max(p @ bundle / np.linalg.norm(p) / np.linalg.norm(bundle) for p in profiles.values())
    (one,) = langid.identify_language(spark.createDataFrame([(text,)], "text string"), profiles).collect()
    assert abs(one["score"] - max(0, cosine)) < 1e-4
    assert langid.identify_language(edges, {}).filter("lang_pred <> 'und'").count() == 0


def fair_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    wanted, capped = 1.5 * sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        level = (wanted - sum(2 * sizes[s] for s in capped)) / max(1, sum(weight[s] for s in free))
        over = {s for s in free if level * weight[s] > 2 * sizes[s]}
        if not over:
            return {s: 2 * sizes[s] if s in capped else level * weight[s] for s in names}
        capped |= over


def test_mixture(spark, edges, nothing):
    rows = [(i, prose(int(RNG.integers(1, 300))), ["a", "b", "Z", "é", None, "tiny"][i % 6 if i % 50 else 5]) for i in range(300)]
    rows = [r for r in rows if r[2] != "tiny" or r[0] % 50 == 0]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mixture_report(docs).collect()
    again = mixing.mixture_report(docs.repartition(5)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    sizes = collections.Counter()
    for _, text, source in rows:
        sizes[source] += len(words(text))
    want, source = fair_targets(sizes), {i: s for i, _, s in rows}
    taken = collections.Counter()
    for r in got:
        s = source[r["doc_id"]]
        assert r["source_size"] == sizes[s] and abs(r["target"] - want[s]) < 1e-6 * want[s] and 0 <= r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 0.02 * want[s] + 2 * mixing.BLOCK_WORDS for s in want)
    mixed = mixing.mixed_documents(docs.withColumn("lang", F.lit("en")).withColumn("n_chars", F.lit(0).cast("long")))
    report = {r["doc_id"]: r["taken"] for r in got}
    out = collections.Counter()
    for r in mixed.collect():
        out[r["doc_id"]] += len(words(r["text"]))
        assert r["n_chars"] == len(r["text"]) and set(words(r["text"])) <= set(words(dict((i, t) for i, t, _ in rows)[r["doc_id"]]))
    assert {i: n for i, n in report.items() if n} == dict(out)
    assert mixing.mixture_report(edges).count() == edges.count()
    assert mixing.mixture_report(nothing).count() == 0 and mixing.mixed_documents(nothing).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 997, 1000, 4097])
def test_permutation(spark, n):
    a = int(np.ceil(np.sqrt(n)))
    at = spark.range(n).select(mixing.permuted(*map(F.lit, (3, 1, n, a, -(-n // a))), F.col("id")).alias("to"))
    assert sorted(r["to"] for r in at.collect()) == list(range(n))


def test_packing(spark, edges, nothing):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    packed = packing.packed_pieces(edges)
    got = packed.collect()
    ids = collections.defaultdict(dict)
    for r in got:
        if r["doc_id"] is not None:
            ids[r["doc_id"]][r["piece"]] = np.frombuffer(r["ids"], "<u4").tolist()
            assert r["length"] == len(r["ids"]) // 4 <= 1024
    for doc_id, text, *_ in EDGES:
        if doc_id is not None:
            want = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
            pieces = [ids[doc_id][i] for i in range(len(ids[doc_id]))]
            assert sum(pieces, []) == want and all(len(p) == 1024 for p in pieces[1:])
    by = collections.defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 1024
    assert packing.sequences(packed).count() == len(by)
    assert packing.packing_report(nothing).count() == 0
    sizes = [(i, int(n)) for i, n in enumerate(RNG.integers(1, 1025, 3000))]
    items = spark.createDataFrame(sizes, "item long, length int")
    for per_task in (200, 5000):
        places = packing.packed_places(items, items_per_task=per_task)
        assert places.select("item").distinct().count() == len(sizes) == places.count()
        bins = places.select("sequence_id").distinct().count()
        assert bins <= 1.04 * sum(n for _, n in sizes) / 1024 + 2


def test_packing_of_pieces_over_half_a_sequence(spark, monkeypatch):
    sizes = [(i, int(n)) for i, n in enumerate(RNG.integers(520, 1001, 3000))]  # no bin takes two
    rounds, pack_round = [], packing.pack_round
    monkeypatch.setattr(packing, "pack_round", lambda left, n, room: (rounds.append((left.count(), n)), pack_round(left, n, room))[1])
    places = packing.packed_places(spark.createDataFrame(sizes, "item long, length int"), items_per_task=200).collect()
    assert sorted(p["item"] for p in places) == list(range(3000)) and len({p["sequence_id"] for p in places}) == 3000
    assert all(n <= 200 * tasks for n, tasks in rounds)


def test_sum_of_squares_rule():
    bins, room = packing.OpenBins(12), 12
    counts = collections.Counter()
    for size in RNG.integers(1, 12, 300).tolist():
        def cost(gap):
            after = counts.copy()
            if gap < room:
                after[gap] -= 1
            if gap - size:
                after[gap - size] += 1
            return sum(v * v for v in after.values())

        options = [g for g in range(size, room) if counts[g] > 0] + [room]
        best = min(cost(g) for g in options)
        before = list(bins.fill)
        number, offset = bins.place(size)
        gap = room - before[number] if number < len(before) else room
        assert offset == room - gap and cost(gap) == best
        if gap < room:
            counts[gap] -= 1
        if gap - size:
            counts[gap - size] += 1
