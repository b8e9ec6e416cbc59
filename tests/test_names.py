from __future__ import annotations

import hashlib
import re
from os.path import splitext
from pathlib import PurePath

import pytest
from pyspark.sql import functions as F

from framesift.functions import geometry, names
from framesift.operators import captions as cap

NAMES = [
    "Laura Rose", "  Jonathan  Doe ", "R2 D2", "élan vital", "ßig Ära", "x　y z", "a\x1cb c", "", "   ",
    "O'Brien Smith", "名前 さん", "snake_case Name", "one\ntwo\tThree", "Ⅷ numeral",
]


def key(name):
    first = "".join(w[0].upper() for w in name.split() if w.isalpha())
    return first + "_" + hashlib.sha1(name.encode()).hexdigest()[:5]


def values(spark, items, column, kind="string"):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(items)], f"n int, v {kind}")
    return [r[0] for r in rows.orderBy("n").select(column(F.col("v"))).collect()]


def test_identifier(spark):
    assert values(spark, NAMES, names.fluxkey) == [key(n) for n in NAMES]
    assert values(spark, NAMES, lambda c: names.fluxkey(c, False)) == [n.strip() for n in NAMES]


FILES = ["a.png", "a.b.JPG", ".png", "noext", "dir.d.jpeg", "two..png", "ünï.png", "a b.png"]


def test_text_names_and_suffixes(spark):
    assert values(spark, FILES, names.text_name) == [str(PurePath(f).with_suffix(".txt")) for f in FILES]
    assert values(spark, FILES, names.extension) == [splitext(f)[1] for f in FILES]
    got = values(spark, FILES, lambda c: names.cluster_dest_name(c, F.lit(3), "diversity"))
    assert got == ["diversity_cluster/" + "_cluster3".join(splitext(f)) for f in FILES]


def test_image_suffix(spark):
    items = ["a.png", "b.JPG", "c.jpeg", "d.gif", "e.png.txt", "png", "f.PnG"]
    assert values(spark, items, names.is_image_name) == [bool(re.search(r"\.(png|jpe?g)$", x.lower())) for x in items]


def test_export_name(spark):
    got = values(spark, ["JD_12345", "plain", "under_score"], names.export_name)
    assert got == ["JD_12345_captions.zip", "captions.zip", "under_score_captions.zip"]


@pytest.mark.parametrize("w,h", [(100, 100), (2048, 2048), (3000, 10), (10, 3000), (5000, 4000), (2049, 1)])
def test_sizes(spark, w, h):
    row = spark.range(1).select(
        geometry.resize_plan(F.lit(w), F.lit(h)).alias("r"), geometry.thumbnail_plan(F.lit(w), F.lit(h)).alias("t")
    ).first()
    ratio = min(2048 / w, 2048 / h)
    assert tuple(row.r) == ((int(w * ratio), int(h * ratio)) if max(w, h) > 2048 else (w, h))
    assert tuple(row.t) == ((256, round(h / w * 256)) if w / h > 1 else (round(w / h * 256), 256))


def test_request_key(spark, monkeypatch):
    monkeypatch.setattr(cap, "KEY_CHUNK", 4)
    rows = [("r1", p, f"f{p}", f"t{p}") for p in range(3)] + [("r2", p, f"f{p}", f"t{p}") for p in range(4)]
    rows += [("r3", p, f"f{p}", f"t{p}") for p in range(11)]
    df = spark.createDataFrame(rows[::-1], "request string, pos int, name string, mtime string")
    got = {r.request: (r.n_files, r.request_key) for r in cap.request_keys(df, ["request"], [F.lit("p"), F.lit("True")]).collect()}

    def md5(text):
        return hashlib.md5(text.encode()).hexdigest()

    def files(part):
        return "|".join(f"f{p}:t{p}" for p in part)

    assert got["r1"] == (3, md5(md5(files(range(3))) + "|p|True"))
    assert got["r2"] == (4, md5(md5(files(range(4))) + "|p|True"))
    chunks = "|".join(md5(files(range(a, min(a + 4, 11)))) for a in (0, 4, 8))
    assert got["r3"] == (11, md5(chunks + "|p|True"))


def test_caption_order_and_last_wins(spark):
    df = spark.createDataFrame(
        [("r", 2, "a.png", "third"), ("r", 0, "a.jpg", "first"), ("r", 1, "b.png", "second")],
        "request string, pos int, filename string, caption string",
    )
    assert [r.caption for r in cap.caption_list(df, "request").collect()] == ["first", "second", "third"]
    files = {r.txt_name: r.content for r in cap.caption_files(df).collect()}
    assert files == {"a.txt": "third", "b.txt": "second"}
    requests = df.select("request").distinct()
    for index, want in ((0, "first"), (2, "third"), (3, ""), (-1, "")):
        assert cap.caption_at(requests, df, "request", index).first().caption == want


def test_prompts_have_no_bound(spark):
    prompts = spark.range(1500).select(F.col("id").alias("prompt_no"), F.lit("p").alias("prompt"))
    assert cap.with_prompts(spark.range(3), prompts).count() == 4500


def test_key_in_any_time_zone_and_odd_names(spark):
    stamp = spark.sql("SELECT timestamp'2024-11-03 05:30:00Z' AS t UNION ALL SELECT timestamp'2024-11-03 06:30:00Z'")
    seen = []
    for zone in ("America/New_York", "UTC"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        seen.append(sorted(r[0] for r in stamp.select(names.mtime_text(F.col("t"))).collect()))
    assert seen[0] == seen[1] and len(set(seen[0])) == 2
    df = spark.createDataFrame([("a.",), ("...png",), ("a.b.png",), (".png",)], "n string")
    parts = df.select("n", names.stem(F.col("n")).alias("s"), names.extension(F.col("n")).alias("e")).collect()
    assert all(r.s + r.e == r.n for r in parts)


def test_detector_must_be_given():
    from framesift.functions.models import count_faces_udf

    with pytest.raises(ValueError):
        count_faces_udf("mtcnn")
