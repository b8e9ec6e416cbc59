"""File sink, names without clashes, prompts asked at once, plot tiles, approximate pairs."""

from __future__ import annotations

import hashlib
import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import noise, write_png
from framesift import sinks
from framesift.file_sink import write_files
from framesift.functions import models
from framesift.operators import captions as cap
from framesift.operators.lsh import _candidates, bucket_pairs, lsh_pairs, tables_needed
from framesift.operators.similarity import cosine_pairs
from framesift.operators.tiles import plot_cells, plot_tiles
from framesift.plans import stages
from framesift.sources.images import read_images


def tree(root) -> set[str]:
    return {os.path.relpath(os.path.join(d, f), root) for d, _, files in os.walk(root) for f in files if not f.endswith(".crc")}


def test_files_by_address(spark, tmp_path):
    """Copies and texts go to a file: address; a second run and several tasks leave one file each."""
    (tmp_path / "in").mkdir()
    for i in range(20):
        (tmp_path / "in" / f"{i}.bin").write_bytes(os.urandom(3000) + bytes([i]))
    rows = [(f"a/{i}.bin", f"file:{tmp_path}/in/{i}.bin", None) for i in range(20)] + [("t/ä.txt", None, "zwölf\n"), ("t/none.txt", None, None)]
    files = spark.createDataFrame(rows, "dest string, source string, content string").repartition(5)
    for _ in range(2):
        write_files(files, f"file:{tmp_path}/out")
    out = tmp_path / "out"
    assert tree(out) == {r[0] for r in rows}
    assert [p.name for p in out.iterdir() if p.name.startswith("_parts")] == []
    assert all((out / "a" / f"{i}.bin").read_bytes() == (tmp_path / "in" / f"{i}.bin").read_bytes() for i in range(20))
    assert (out / "t" / "ä.txt").read_text("utf-8") == "zwölf\n" and (out / "t" / "none.txt").read_bytes() == b""


def test_failed_job_leaves_no_parts(spark, tmp_path):
    """The task that fails leaves nothing, not even the files it had filled before."""
    rows = [("x/good.txt", None, "good"), ("x/bad.bin", str(tmp_path / "missing.bin"), None)]
    files = spark.createDataFrame(rows, "dest string, source string, content string").coalesce(1)
    with pytest.raises(Exception, match="missing.bin"):
        write_files(files, str(tmp_path / "out"))
    assert not (tmp_path / "out").exists() or tree(tmp_path / "out") == set()


@pytest.mark.parametrize("dest", ["../up.txt", "/abs.txt", "a//b.txt", "a/../../b.txt", "", None])
def test_no_file_outside_the_folder(spark, tmp_path, dest):
    files = spark.createDataFrame([(dest, "x")], "dest string, content string")
    with pytest.raises(Exception, match="below the target folder"):
        write_files(files, str(tmp_path / "out" / "deep"))
    assert tree(tmp_path) == set()


def test_empty_table_of_files(spark, tmp_path):
    write_files(spark.createDataFrame([], "dest string, content string"), str(tmp_path / "out"))
    assert tree(tmp_path / "out") == set() and (tmp_path / "out").is_dir()


@pytest.mark.parametrize("parts", [1, 4])
def test_unique_names(spark, parts):
    rows = [("/b/x.png", "r.d/x.png"), ("/a/x.png", "r.d/x.png"), ("/c/x", "r.d/x"), ("/d/x", "r.d/x"), ("/a/x.png", "r.d/x.png"), ("/e/y.png", "y.png"), ("/f/z", None)]
    plan = spark.createDataFrame(rows, "path string, dest_name string").repartition(parts)
    mark = {p: hashlib.md5(p.encode()).hexdigest()[:12] for p, _ in rows}
    want = [
        ("/a/x.png", "r.d/x.png"), ("/a/x.png", "r.d/x.png"), ("/b/x.png", f"r.d/x-{mark['/b/x.png']}.png"),
        ("/c/x", "r.d/x"), ("/d/x", f"r.d/x-{mark['/d/x']}"), ("/e/y.png", "y.png"), ("/f/z", None),
    ]
    assert sorted(map(tuple, sinks.unique_names(plan).collect()), key=lambda r: r[0]) == want


def test_routes_of_two_folders(spark, tmp_path):
    """Pictures of one name from two folders, both moved: both arrive."""
    for folder, seed in (("a", 1), ("b", 2)):
        (tmp_path / folder).mkdir()
        write_png(tmp_path / folder / "keep.png", noise(seed))
        write_png(tmp_path / folder / "zz.png", noise(seed))
    images = read_images(spark, [str(tmp_path / "a"), str(tmp_path / "b")])
    routes = stages.similarity_of_images(images).routes
    sinks.copy_files(sinks.route_files(routes, images, "image_id"), str(tmp_path / "out"))
    found = sorted(tree(tmp_path / "out"))
    assert len(found) == 2 and all(f.startswith("duplicate_images/zz") and f.endswith(".png") for f in found)
    assert {(tmp_path / "out" / f).read_bytes() for f in found} == {(tmp_path / d / "zz.png").read_bytes() for d in "ab"}


def test_export_name_is_the_folder(spark, tmp_path):
    done = spark.createDataFrame(
        [("r1", "Jane Doe", True, 0, "p.png", "first"), ("r1", "Jane Doe", True, 1, "p.png", "last"), ("r2", "plain", False, 0, "p.png", "other")],
        "request string, identifier string, use_hash boolean, pos int, filename string, caption string",
    )
    sinks.write_caption_files(cap.export_files(done), str(tmp_path))
    key = "JD_" + hashlib.sha1(b"Jane Doe").hexdigest()[:5]
    assert tree(tmp_path) == {f"r1/{key}_captions/p.txt", "r2/captions/p.txt"}
    assert (tmp_path / "r1" / f"{key}_captions" / "p.txt").read_text() == "last"


def test_prompts_decode_a_picture_once(spark, picture_dir, tmp_path, monkeypatch):
    """All prompts of a chunk are asked of one decoded picture; the answers equal those asked one by one."""
    log = str(tmp_path / "pictures")

    def noted():
        model = models.plain_describer()

        def run(pictures, prompts, max_new_tokens):
            with open(log, "a") as out:
                out.write("".join(f"{id(p)}\n" for p in {id(p): p for p in pictures}.values()))
            return model(pictures, prompts, max_new_tokens)

        return run

    images = read_images(spark, str(picture_dir))
    prompts = spark.createDataFrame([(i, f"prompt {i}") for i in range(5)], "prompt_no int, prompt string")
    rows = stages.captions_of_prompts(images, prompts, noted).collect()
    assert len(open(log).read().split()) == 8  # one call per picture that can be decoded
    one = cap.with_prompts(images.select("image_id", "image"), prompts)
    one = one.select("image_id", "prompt_no", stages.model_caption(models.caption_udf(models.plain_describer))).collect()
    assert {(r.image_id, r.prompt_no): r.answer for r in rows} == {(r[0], r[1]): r[2] for r in one}
    assert len(rows) == 45 and sum(r.answer is None for r in rows) == 5
    assert any("2048x" in r.answer for r in rows if r.filename == "wide.png")


@pytest.mark.parametrize("size", [1, 2, 256])
def test_prompt_chunks(spark, size):
    prompts = spark.createDataFrame([(i, f"p{i}") for i in (0, 1, 2, 7)], "prompt_no int, prompt string")
    rows = spark.createDataFrame([(1, "x"), (2, None)], "id int, text string")
    got = cap.answer_prompts(rows, prompts, lambda a: F.transform(a, lambda p: F.concat(p, F.col("text"))), ["text"], size)
    assert got.columns == ["id", "prompt_no", "prompt", "answer"]
    assert sorted(map(tuple, got.collect()), key=lambda r: r[:2]) == [
        (i, n, f"p{n}", f"p{n}x" if i == 1 else None) for i in (1, 2) for n in (0, 1, 2, 7)
    ]
    assert cap.answer_prompts(rows, prompts.limit(0), lambda a: a, ["text"], size).count() == 0


def test_tiles(spark):
    rng = np.random.default_rng(4)
    n, cells, zooms = 3000, 8, 4
    x, y = rng.normal(size=n), np.round(rng.normal(size=n), 1)
    x[:1000], y[:1000] = 0.25, 0.5  # a third of the points on one place
    cluster, chosen = rng.integers(0, 5, n), rng.random(n) < 0.1
    rows = [(i, float(x[i]), float(y[i]), int(cluster[i]), bool(chosen[i])) for i in range(n)] + [(n, float("nan"), 0.0, 0, True), (n + 1, None, 0.0, 0, True)]
    points = spark.createDataFrame(rows, "id int, x double, y double, cluster int, is_selected boolean")
    got = {(r.zoom, r.tx, r.ty): r for r in plot_tiles(points, "id", zooms, cells).collect()}
    finest = cells << (zooms - 1)
    gx, gy = (np.minimum(np.floor((v - v.min()) / (v.max() - v.min()) * finest), finest - 1).astype(int) for v in (x, y))
    want: dict = {}
    for z in range(zooms):
        for i in range(n):
            a, b = gx[i] >> (zooms - 1 - z), gy[i] >> (zooms - 1 - z)
            want.setdefault((z, a // cells, b // cells), {}).setdefault((a % cells, b % cells), []).append(i)
    assert set(got) == set(want)
    for key, tile in want.items():
        entries = json.loads(got[key].cells)
        assert [(e["cx"], e["cy"]) for e in entries] == sorted(tile) and len(entries) <= cells * cells == 64
        for e in entries:
            at = tile[e["cx"], e["cy"]]
            counts = np.bincount(cluster[at])
            assert (e["n"], e["n_selected"], e["first_id"], e["cluster"]) == (len(at), chosen[at].sum(), min(at), int(counts.argmax()))
        assert got[key].n_points == sum(map(len, tile.values())) and got[key].n_cells == len(tile)
    flat = points.withColumn("x", F.lit(1.0)).filter("id < 10")
    assert {(r.tx, r.cx) for r in plot_cells(flat, "id").collect()} == {(0, 0)}
    assert plot_tiles(points.limit(0), "id").count() == 0


@pytest.mark.parametrize("sizes", [{}, {"bucket_rows": 32, "block_rows": 16}])
@pytest.mark.parametrize("width, offset", [(16, 0.0), (64, 0.0), (64, 1.5)])
def test_approximate_pairs(spark, sizes, width, offset):
    """Recall of 0.97 and more, each pair once, none below the threshold, copies never missed."""
    rng = np.random.default_rng(width)
    base = np.repeat(rng.normal(size=(120, width)), 5, axis=0)
    vectors = base + 0.35 * rng.normal(size=base.shape) + offset
    vectors[7] = vectors[300]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(900, [0.0] * width), (901, None), (902, [float("nan")] * width)]
    df = spark.createDataFrame(rows, "id int, vec array<double>")
    exact = {(r.earlier, r.later): r for r in cosine_pairs(df, "id", "vec", 0.85).collect()}
    found = lsh_pairs(df, "id", "vec", 0.85, **sizes).collect()
    got = {(r.earlier, r.later): r for r in found}
    assert len(got) == len(found) and set(got) <= set(exact) and len(exact) > 500
    assert len(got) >= 0.97 * len(exact) and (7, 7) in got
    assert all(abs(r.similarity - exact[k].similarity) < 1e-9 and r.n_pairs == exact[k].n_pairs for k, r in got.items())


def test_approximate_pairs_of_nothing(spark):
    assert lsh_pairs(spark.createDataFrame([], "id int, vec array<double>"), "id", "vec", 0.9).count() == 0
    assert tables_needed(0.85, 4) < tables_needed(0.85, 8) < tables_needed(0.5, 8)


def test_parts_and_tables_give_the_same_pairs_and_carry_vectors_once_per_part(spark):
    """Vectors are carried once per part, however many tables there are; pairs are those of the tables."""
    rng = np.random.default_rng(5)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(700, 16)))] + [(800, [1.0] * 16), (801, [1.0] * 16)]
    df = spark.createDataFrame(rows, "id int, vec array<double>")

    def found(**sizes):
        return {(r.earlier, r.later, r.n_pairs) for r in lsh_pairs(df, "id", "vec", 0.5, bucket_rows=64, **sizes).collect()}

    tables = found(part_rows=2)
    assert len(tables) > 500 and (800, 801, 1) not in tables and (800, 800, 1) in tables
    assert tables == found() == found(part_rows=200)
    one, two = (bucket_pairs(df, 0.5, 702, bucket_rows=64, **s)._jdf.queryExecution().analyzed().toString() for s in ({}, {"part_rows": 2}))
    assert "table_no" not in one and "table_no" in two


@pytest.mark.parametrize("offset", [0.0, 3.0])
def test_buckets_and_whole_parts_give_each_pair_once(offset):
    rng = np.random.default_rng(3)
    vecs, normals = rng.normal(size=(300, 8)) + offset, rng.standard_normal((8, 12))
    codes = (vecs @ normals > 0).reshape(300, 3, 4) @ (1 << np.arange(4))
    wanted = {(a, b) for a in range(150) for b in range(150, 300) if (codes[a] == codes[b]).any()}
    met = [(int(a), int(b)) for _, low, high in _candidates(codes, np.arange(150), np.arange(150, 300)) for a in low for b in high]
    assert wanted <= set(met) and len(met) <= 150 * 150
