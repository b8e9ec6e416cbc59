"""Stages over generated picture files."""

from __future__ import annotations

import os

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import noise, write_png
from framesift import sinks
from framesift.functions import hashing, models, pixels
from framesift.operators import captions as cap
from framesift.plans import stages
from framesift.sources.images import read_file_meta, read_images, read_upload_images, read_uploads


@pytest.fixture(scope="module")
def images(spark, picture_dir):
    return read_images(spark, str(picture_dir)).cache()


def short(routes):
    return {r.image_id.split("\0")[0]: r.route for r in routes.collect()}


def test_scan(images):
    found = {r.filename: r.error for r in images.select("filename", "error").collect()}
    assert set(found) == {"a.png", "a_copy.png", "a_big.png", "b.PNG", "grey.png", "alpha.png", "flat.png", "wide.png", "bad.jpg"}
    assert [n for n, e in found.items() if e] == ["bad.jpg"]


def test_meta(spark, picture_dir):
    rows = {r.filename: r for r in read_file_meta(spark, str(picture_dir)).collect()}
    assert rows["b.PNG"].ext == ".PNG" and rows["a_big.png"].stem == "a_big"
    assert rows["bad.jpg"].length == len(b"not a picture")
    plan = read_file_meta(spark, str(picture_dir))._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan


def test_uploads_keep_order(spark, picture_dir):
    listed = [str(picture_dir / n) for n in ("note.txt", "b.PNG", "a.png", "b.PNG")]
    rows = read_uploads(spark, listed).orderBy("pos").collect()
    assert [r.filename for r in rows] == ["note.txt", "b.PNG", "a.png", "b.PNG"]
    assert [r.pos for r in rows] == [0, 1, 2, 3]
    table = spark.createDataFrame([(i, p) for i, p in enumerate(listed)], "pos int, path string")
    same = read_uploads(spark, table, str(picture_dir)).orderBy("pos").collect()
    assert [(r.pos, r.path) for r in same] == [(r.pos, r.path) for r in rows]


def test_decode_and_resize(images, picture_dir):
    row = images.filter("filename = 'a.png'").first()
    assert np.array_equal(pixels.decode(row.image), noise(1))
    flat = np.full((40, 30, 3), 77, dtype=np.uint8)
    assert (pixels.resize(flat, 8, 8) == 77).all() and pixels.resize(flat, 13, 50).shape == (50, 13, 3)
    ramp = np.tile(np.arange(64, dtype=np.uint8) * 4, (64, 1))
    small = pixels.resize(ramp, 8, 8)
    assert (np.diff(small[0].astype(int)) > 0).all() and (small == small[0]).all()


def test_hash_of_known_picture():
    halves = np.zeros((64, 64, 3), dtype=np.uint8)
    halves[:, 32:] = 255
    assert pixels.average_hash_hex(halves) == "0f" * 8
    assert pixels.average_hash_hex(np.full((9, 9, 3), 90, dtype=np.uint8)) == "0" * 16


def test_oversize_is_shrunk(images):
    row = images.filter("filename = 'wide.png'").select(models.resize_udf(2048)("image").alias("i")).first().i
    assert (row.width, row.height, row.nChannels) == (2048, 6, 3)
    assert len(row.data) == 2048 * 6 * 3


def test_similarity_stage(images):
    done = stages.similarity_of_images(images)
    routes = short(done.routes)
    assert routes["a.png"] == "keep" and routes["a_copy.png"] == "duplicate_images"
    assert routes["a_big.png"] == "duplicate_images" and routes["bad.jpg"] == "keep"
    assert done.stats.first().total_images == 9
    both = stages.similarity_of_images(images, models.pooled_pixels, methods=stages.METHODS, threshold=0.8)
    assert len(both.routes.collect()) == 9
    kept = {n for n, r in short(both.routes).items() if r == "duplicate_images"}
    assert kept == {"a_copy.png", "a_big.png"}
    only = stages.similarity_of_images(images, models.pooled_pixels, methods=("vgg16_similarity",), threshold=0.99)
    assert short(only.routes)["a_big.png"] == "similar_images"
    with pytest.raises(ValueError):
        stages.similarity_of_images(images, methods=("other",))


def test_model_does_not_see_duplicates(spark, images, tmp_path):
    seen = tmp_path / "seen"
    seen.mkdir()

    def make():
        def run(batch):
            for p in batch:
                with open(seen / f"{os.getpid()}-{np.random.default_rng().integers(1 << 60)}", "w") as out:
                    out.write(str(p.shape))
            return [p.astype(float).mean(axis=(0, 1)) for p in batch]

        return run

    stages.similarity_of_images(images, make, methods=stages.METHODS)
    assert len(list(seen.iterdir())) == 6  # nine files less one bad and two duplicates


def test_face_stage(images):
    victim = noise(2)

    def by_channel():
        def detect(rgb, align):
            if np.array_equal(rgb, victim):
                raise RuntimeError("detector failed")
            return [1] * (2 if rgb.shape[1] > 1000 else 1)

        return detect

    done = stages.faces_of_images(images, "yunet", detectors={"yunet": by_channel})
    routes = short(done.routes)
    assert routes["b.PNG"] == "no_faces" and routes["bad.jpg"] == "no_faces"
    assert routes["wide.png"] == "multiple_faces" and routes["a.png"] == "keep"
    assert tuple(done.stats.first()) == (9, 2, 1, 6)
    with pytest.raises(ValueError):
        stages.faces_of_images(images, "nobody")


def test_refine_stage(images, picture_dir, tmp_path):
    with pytest.raises(ValueError):
        stages.refine_images(images, models.pooled_face)
    done = stages.refine_images(images, models.pooled_face, on_error="skip", k=3, method="consistency")
    assert done.selected.count() == 3
    assert done.assigned.count() == 7  # the bad file and the flat picture have no face
    plan = stages.export_plan(done.selected, images, "image_id", "consistency")
    sinks.copy_files(plan, str(tmp_path))
    sinks.copy_files(plan, str(tmp_path))
    out = sorted(p.name for p in (tmp_path / "consistency_cluster").iterdir())
    assert len(out) == 3 and all("_cluster" in n for n in out)
    assert (picture_dir / "a.png").exists()
    with pytest.raises(ValueError):
        stages.refine_images(images, models.pooled_face, on_error="skip", method="best")


DESCRIBER = {models.CAPTION_MODELS[0]: models.plain_describer}


def uploads(images, prompt="describe", identifier="Jane Doe", use_hash=True):
    return images.filter("not error").select(
        F.lit("u1").alias("request"),
        (F.rank().over(Window.orderBy("image_id")) - 1).alias("pos"),
        "filename", "path", "image", F.lit(0).cast("timestamp").alias("mtime"), F.lit(prompt).alias("prompt"),
        F.lit(identifier).alias("identifier"), F.lit(use_hash).alias("use_hash"),
        F.lit(models.CAPTION_MODELS[0]).alias("model_key"),
    )


def test_caption_stage_and_cache(spark, images, tmp_path):
    cache = str(tmp_path / "cache")
    first = stages.caption_stage(uploads(images), cache, models=DESCRIBER).collect()
    assert len(first) == 8 and all(r.caption.startswith("JD_") and ", describe: " in r.caption for r in first)
    hit = stages.caption_stage(uploads(images), cache, F.lit("never computed")).collect()
    assert sorted(hit) == sorted(first)
    fresh = stages.caption_stage(uploads(images), cache, F.lit("new"), force_refresh=True).collect()
    assert all(r.caption.endswith(", new") for r in fresh) and len(fresh) == 8
    again = stages.caption_stage(uploads(images), cache, F.lit("never computed")).collect()
    assert sorted(again) == sorted(fresh)
    unread = stages.caption_stage(uploads(images), cache, F.lit("third"), use_cache=False).collect()
    assert all(r.caption.endswith(", third") for r in unread)
    other = stages.caption_stage(uploads(images, identifier=" Jane ", use_hash=False), cache, F.lit("x")).collect()
    assert {r.caption for r in other} == {"Jane, x"}


def test_caption_files(spark, images, tmp_path):
    done = stages.caption_stage(uploads(images), str(tmp_path / "cache"), F.lit("Grüße"))
    sinks.write_caption_files(cap.caption_files(done), str(tmp_path / "texts"))
    names = sorted(p.name for p in (tmp_path / "texts").iterdir())
    assert "a_big.txt" in names and len(names) == 8
    assert (tmp_path / "texts" / "b.txt").read_text(encoding="utf-8").endswith(", Grüße")


def test_each_request_has_its_model(images, tmp_path):
    def namer(name):
        return lambda: lambda pictures, prompts, most: [name] * len(pictures)

    one, two = models.CAPTION_MODELS
    first = uploads(images)
    second = first.withColumn("request", F.lit("u2")).withColumn("model_key", F.lit(two))
    third = first.withColumn("request", F.lit("u3"))  # equal to the first
    files = first.unionByName(second).unionByName(third)
    both = {one: namer("small"), two: namer("large")}
    done = stages.caption_stage(files, str(tmp_path / "cache"), models=both).collect()
    told = {(r.request, r.caption.split(", ")[1]) for r in done}
    assert told == {("u1", "small"), ("u2", "large"), ("u3", "small")} and len(done) == 24
    with pytest.raises(ValueError, match="no caption model"):
        stages.caption_stage(files, str(tmp_path / "other"), models={one: namer("small")})
    assert not (tmp_path / "other").exists()


def test_models_must_be_given(images, tmp_path):
    for ask in (
        lambda: stages.similarity_of_images(images, methods=stages.METHODS),
        lambda: stages.refine_images(images, on_error="skip"),
        lambda: stages.caption_stage(uploads(images), str(tmp_path / "cache")),
        lambda: models.feature_udf(), lambda: models.face_embedding_udf(), lambda: models.caption_udf(),
    ):
        with pytest.raises(ValueError, match="given"):
            ask()


def test_uploads_to_captions(spark, picture_dir, tmp_path):
    listed = [str(picture_dir / n) for n in ("wide.png", "a.png", "bad.jpg", "a.png")]
    got = read_upload_images(spark, listed)
    table = spark.createDataFrame(list(enumerate(listed)), "pos int, path string")
    same = read_upload_images(spark, table, str(picture_dir)).drop("image").orderBy("pos").collect()
    assert same == got.drop("image").orderBy("pos").collect()
    assert [(r.pos, r.filename, r.error) for r in same] == [
        (0, "wide.png", False), (1, "a.png", False), (2, "bad.jpg", True), (3, "a.png", False)]
    files = got.filter("not error").select(
        "*", F.lit(1).alias("request"), F.lit("say").alias("prompt"), F.lit("Jo").alias("identifier"),
        F.lit(False).alias("use_hash"), F.lit(models.CAPTION_MODELS[0]).alias("model_key"),
    )
    done = stages.caption_stage(files, str(tmp_path / "cache"), models=DESCRIBER).orderBy("pos").collect()
    assert [r.caption.rsplit(", ", 1)[0] for r in done] == ["Jo, say: 2048x6", "Jo, say: 64x64", "Jo, say: 64x64"]


def test_recommended_order(spark, images, picture_dir, tmp_path):
    def one_face():
        return lambda rgb, align: [0] if rgb.shape[1] == 64 else []

    out = stages.refine_set(
        images, k=2,
        similarity={"methods": stages.METHODS, "threshold": 0.99, "make_features": models.pooled_pixels},
        faces={"backend": "mtcnn", "detectors": {"mtcnn": one_face}},
        refine={"make_embedder": models.pooled_face},
        captions={
            "mtimes": read_file_meta(spark, str(picture_dir)), "cache_path": str(tmp_path / "cache"),
            "prompt": "say", "identifier": "Jane Doe", "models": DESCRIBER,
        },
    )
    assert out["export"].count() == 2
    chosen = {r.image_id.split("\0")[0] for r in out["selected"].collect()}
    assert chosen <= {"a.png", "b.PNG", "grey.png", "alpha.png"}
    told = out["captions"].orderBy("pos").collect()
    assert [r.filename for r in told] == sorted(chosen) and [r.pos for r in told] == [0, 1]
    assert all(r.caption.startswith("JD_") and ", say: 64x64" in r.caption for r in told)


def test_one_pass_decodes_each_picture_once(spark, images, tmp_path):
    """Every model gets each decodable picture exactly once, and nothing that is stored holds pixels."""
    log = str(tmp_path / "seen")

    def noted(kind, make):
        def factory():
            model = make()

            def run(pictures, *rest):
                with open(f"{log}-{kind}", "a") as out:
                    out.write("x" * (len(pictures) if isinstance(pictures, list) else 1))
                return model(pictures, *rest)

            return run

        return factory

    known = models.measured_images(
        images, noted("feature", models.pooled_pixels), noted("faces", models.bright_blobs), noted("face", models.pooled_face), batch_size=2
    )
    rows = {r.filename: r for r in known.collect()}
    assert [len(open(f"{log}-{kind}").read()) for kind in ("feature", "faces", "face")] == [8, 8, 8]
    assert "image" not in known.columns and len(rows) == 9
    apart = images.filter("not error").select(
        "filename", hashing.average_hash_image("image").alias("hash"), models.feature_udf(models.pooled_pixels)("image").alias("feature"),
        models.count_faces_udf("mtcnn", True, {"mtcnn": models.bright_blobs})("image").alias("n_faces"),
        models.face_embedding_udf(models.pooled_face)("image").alias("embedding"),
    )
    for r in apart.collect():
        assert (rows[r.filename].hash, rows[r.filename].feature, rows[r.filename].n_faces, rows[r.filename].embedding) == (r.hash, r.feature, r.n_faces, r.embedding)
    bad = rows["bad.jpg"]
    assert bad.error and (bad.hash, bad.feature, bad.n_faces, bad.embedding) == (None, None, None, None)


def test_manifest(spark, images, tmp_path):
    routes = stages.similarity_of_images(images).routes
    sinks.write_routes(routes, str(tmp_path / "m"))
    assert {p.name for p in (tmp_path / "m").iterdir() if p.is_dir()} == {"route=keep", "route=duplicate_images"}
    assert spark.read.parquet(str(tmp_path / "m")).count() == 9


def test_every_prompt_on_every_image(images):
    prompts = images.sparkSession.createDataFrame([(0, "colours"), (1, "mood")], "prompt_no int, prompt string")
    asked = cap.with_prompts(images.select("image_id", "image"), prompts)
    rows = asked.select("image_id", "prompt", models.caption_udf(models.plain_describer)("image", "prompt").alias("c")).collect()
    assert len(rows) == 18
    assert all(r.c.startswith(r.prompt + ": ") for r in rows if "bad.jpg" not in r.image_id)


def test_nearest_resize():
    small = np.arange(12, dtype=np.uint8).reshape(2, 2, 3)
    big = pixels.resize_nearest(small, 4, 6)
    assert big.shape == (6, 4, 3) and (big[:3, :2] == small[0, 0]).all() and (big[3:, 2:] == small[1, 1]).all()
    assert np.array_equal(pixels.resize_nearest(big, 2, 2), small)


def test_unknown_caption_model():
    with pytest.raises(ValueError):
        models.caption_udf(model_key="other")


def test_empty_folder(spark, tmp_path):
    write_png(tmp_path / "x.png", noise(1))
    images = read_images(spark, str(tmp_path)).filter("filename = 'none'")
    assert stages.similarity_of_images(images, models.pooled_pixels, methods=stages.METHODS).stats.first().total_images == 0
