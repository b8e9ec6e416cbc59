"""Caption cache: versions, files chosen by key, merges, other writers, clean-up."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from framesift import caption_cache
from framesift.caption_cache import CACHE_SCHEMA, CaptionCache, any_between


def key(i: int) -> str:
    return hashlib.md5(str(i).encode()).hexdigest()


def rows(spark, version: int, ids, per: int = 2):
    made = [(key(i), version, pos, f"{pos}.png", f"{i}-{pos}-v{version}") for i in ids for pos in range(per)]
    return spark.createDataFrame(made, CACHE_SCHEMA)


def newest(cache: CaptionCache, keys=None) -> set:
    got = cache.read(keys)
    last = caption_cache.newest_versions(got).drop("n")
    return {(r.request_key, r.caption) for r in got.join(last, ["request_key", "version"]).collect()}


def test_lookup_reads_matching_files_only(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(caption_cache, "FILE_ROWS", 20)
    cache = CaptionCache(spark, str(tmp_path / "c"))
    assert cache.parts() == (0, []) and cache.read().count() == 0
    cache.append(rows(spark, 1, range(200)))
    parts = cache.parts()[1]
    assert len(parts) >= 15 and sum(p.n for p in parts) == 400
    wanted = rows(spark, 1, [7, 90], 1).select("request_key")
    met = cache.matching(wanted, parts)
    assert 1 <= len(met) <= 2
    read = cache.read(wanted)
    assert len(read.inputFiles()) == len(met)
    got = read.join(wanted, "request_key", "left_semi").collect()
    assert {r.caption for r in got} == {"7-0-v1", "7-1-v1", "90-0-v1", "90-1-v1"}
    nothing = spark.createDataFrame([(None,)], "request_key string")
    assert cache.matching(nothing, parts) == []


def test_merge_keeps_the_latest(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(caption_cache, "MERGE", 3)
    cache = CaptionCache(spark, str(tmp_path / "c"))
    for version, ids in enumerate([range(5), range(3, 8), range(4)], start=1):
        cache.append(rows(spark, version, ids, per=3))
    assert len({p.segment for p in cache.parts()[1]}) == 1  # the third segment started a merge
    want = {i: 3 if i < 4 else 2 for i in range(8)}
    assert cache.read().count() == 3 * 8
    assert newest(cache) == {(key(i), f"{i}-{pos}-v{v}") for i, v in want.items() for pos in range(3)}


def test_one_request_spreads_over_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(caption_cache, "FILE_ROWS", 50)
    cache = CaptionCache(spark, str(tmp_path / "c"))
    cache.append(rows(spark, 1, [1], per=400))
    assert len(cache.parts()[1]) >= 6 and max(p.n for p in cache.parts()[1]) < 150
    assert len(newest(cache)) == 400


def test_other_writers_and_fixed_versions(spark, tmp_path):
    """A writer whose version was taken starts from the newer one; a reader stays on its own."""
    one, two = CaptionCache(spark, str(tmp_path / "c")), CaptionCache(spark, str(tmp_path / "c"))
    one.append(rows(spark, 1, [1]))
    reader = one.read()
    first, at_once = one._store(rows(spark, 2, [2])), two._store(rows(spark, 3, [3]))
    calls = []

    def change(parts):
        if not calls:
            two._commit(lambda now: now + at_once)  # the other one is quicker
        calls.append(len(parts))
        return parts + first

    assert one._commit(change) == 3 and calls == [1, 2]
    assert {k for k, _ in newest(one)} == {key(1), key(2), key(3)}
    assert {r.request_key for r in reader.collect()} == {key(1)}
    assert one.read(version=2).count() == 4


def test_clear_and_clean_up(spark, tmp_path):
    cache = CaptionCache(spark, str(tmp_path / "c"))
    cache.append(rows(spark, 1, range(4)))
    cache.append(rows(spark, 2, range(2)))
    assert cache.remove_old() == (0, 0)  # too young
    assert cache.merge(everything=True) == 3
    assert cache.remove_old(older_than=-5) == (2, 2)
    assert cache.versions() == [3] and cache.read().count() == 8
    cache.clear()
    assert cache.read().count() == 0 and cache.read(version=3).count() == 8
    assert cache.remove_old(older_than=-5) == (1, 1)
    assert list((tmp_path / "c" / "data").iterdir()) == []
    assert cache.merge(everything=True) is None
    with pytest.raises(ValueError):
        cache.remove_old(keep=0)


def test_empty_append_and_null_texts(spark, tmp_path):
    cache = CaptionCache(spark, str(tmp_path / "c"))
    assert cache.append(rows(spark, 1, [])) == 0
    cache.append(rows(spark, 1, [1]).withColumn("caption", F.lit(None).cast("string")))
    assert [r.caption for r in cache.read().collect()] == [None, None]


def test_any_between():
    assert any_between(["0a", "5f"], "10", "60") and not any_between(["0a", "5f"], "10", "5e") and not any_between([], "0", "f")
