"""Registered queries: each runs one operator or stage over whole driver tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framesift.functions import geometry, names
from framesift.functions.hashing import average_hash_grid as grid_hash
from framesift.operators import captions as cap
from framesift.operators import clusters as cl
from framesift.operators import duplicates as dup
from framesift.operators import faces as fc
from framesift.operators import routes as rt
from framesift.operators.matching import greedy_similar_pairs as greedy
from framesift.operators.matching import number_pairs
from framesift.operators.lsh import lsh_pairs as near_pairs
from framesift.operators.similarity import cosine_pairs as all_pairs
from framesift.operators.skew import ordered_rank
from framesift.operators.tiles import plot_tiles as tiles_of
from framesift.plans import stages
from framesift.plans import tables as tb
from framesift.session import save_table, scratch_root, ship_package
from framesift.sinks import unique_names, write_caption_files, write_routes
from framesift.sources.images import file_parts

OUT = "/out"
BOTH = stages.METHODS
KM = {"init": "first", "tol": 0.0}  # until nothing moves; SQL follows from the same start
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        ship_package(spark)
        return fn(spark, folder)

    QUERIES[fn.__name__] = run
    return fn


def vec_name(col: str = "vec_id"):
    return F.concat(F.lit("IMG_"), F.col(col).cast("string"), F.lit(".png"))


# sources and scalar functions


@query
def file_meta(spark, folder):
    return file_parts(tb.files(spark, folder)).select("path", "filename", "stem", "ext")


@query
def filter_image_ext(spark, folder):
    return tb.files(spark, folder).filter(names.is_image_name(F.col("filename"))).select("doc_id", "filename")


@query
def average_hash_grid(spark, folder):
    return tb.vectors(spark, folder).select("vec_id", grid_hash(F.col("embedding")).alias("hash"))


@query
def resize_plan(spark, folder):
    w, h = F.col("width"), F.col("height")
    return tb.sizes(spark, folder).withColumn("new", geometry.resize_plan(w, h)).select(
        "doc_id", "width", "height", F.col("new.width").alias("new_width"),
        F.col("new.height").alias("new_height"), geometry.needs_resize(w, h).alias("resized"),
    )


@query
def thumbnail_plan(spark, folder):
    new = geometry.thumbnail_plan(F.col("width"), F.col("height"))
    return tb.sizes(spark, folder).withColumn("new", new).select(
        "doc_id", F.col("new.width").alias("thumb_width"), F.col("new.height").alias("thumb_height")
    )


@query
def fluxkey(spark, folder):
    return tb.identifiers(spark, folder).select(
        "kind", "id", names.fluxkey(F.col("name")).alias("hashed"),
        names.fluxkey(F.col("name"), False).alias("plain"),
    )


@query
def export_name(spark, folder):
    return tb.identifiers(spark, folder).select(
        "kind", "id", names.export_name(names.fluxkey(F.col("name"))).alias("hashed_export"),
        names.export_name(names.fluxkey(F.col("name"), False)).alias("plain_export"),
    )


def prefixed(spark, folder) -> DataFrame:
    name = F.concat(F.lit("Photo Set "), (F.col("conv_id") % 5).cast("string"))
    return tb.captions(spark, folder).withColumn("caption", names.caption_prefix(names.fluxkey(name), F.col("caption")))


@query
def caption_prefix(spark, folder):
    return prefixed(spark, folder).select("conv_id", "pos", "caption")


@query
def request_key(spark, folder):
    events = tb.table(spark, folder, "events").select(
        F.col("user_id").alias("request"), "ts", "event_id"
    )
    # a user may hold a large share of the events, so the upload position is ranked in slices
    ranked = ordered_rank(events, ["ts", "event_id"], ["request"], "nth")
    files = ranked.select(
        "request", (F.col("nth") - 1).alias("pos"), F.col("event_id").cast("string").alias("name"),
        names.mtime_text(F.col("ts")).alias("mtime"),
    )
    keys = cap.request_keys(
        files, ["request"],
        [F.lit("describe"), F.concat(F.lit("user "), F.col("request").cast("string")),
         cap.truth_text(F.col("request") % 2 == 0), F.lit("model-a")],
    )
    return keys.select("request", "n_files", "request_key")


# duplicates


def stored_hashes(spark, folder) -> DataFrame:
    """Hashing reads the wide vectors once; everything after it reads (id, hash)."""
    return save_table(tb.coarse_hashes(spark, folder), "hashes")


@query
def hash_duplicates(spark, folder):
    return dup.hash_duplicates(stored_hashes(spark, folder), "vec_id")


@query
def hash_stats(spark, folder):
    return dup.hash_stats(tb.coarse_hashes(spark, folder))


@query
def remaining_after_hash(spark, folder):
    hashes = stored_hashes(spark, folder)
    return rt.remaining(hashes, dup.hash_duplicates(hashes, "vec_id"), "vec_id")


# similar pairs


@query
def cosine_pairs(spark, folder):
    pairs = all_pairs(tb.vectors(spark, folder), "vec_id", "embedding", tb.THRESHOLD)
    return pairs.withColumn("similarity", F.round("similarity", 6))


@query
def lsh_pairs(spark, folder):
    """No SQL: a pair may be missed; tests measure the recall against the exact join."""
    pairs = near_pairs(tb.vectors(spark, folder), "vec_id", "embedding", tb.THRESHOLD)
    return pairs.withColumn("similarity", F.round("similarity", 6))


@query
def greedy_similar_pairs(spark, folder):
    pairs = greedy(tb.vectors(spark, folder), "vec_id", "embedding", tb.THRESHOLD)
    return pairs.withColumn("similarity", F.round("similarity", 6))


@query
def pair_report(spark, folder):
    pairs = number_pairs(greedy(tb.vectors(spark, folder), "vec_id", "embedding", tb.THRESHOLD))
    return rt.pair_report(pairs, tb.sizes(spark, folder, "embeddings", "vec_id"), "vec_id")


def two_step(spark, folder, methods=BOTH) -> stages.Similarity:
    return stages.similarity_stage(
        stored_hashes(spark, folder), tb.vectors(spark, folder), "vec_id", "embedding", tb.THRESHOLD, methods
    )


@query
def similarity_stats(spark, folder):
    return two_step(spark, folder).stats


@query
def stage_similarity(spark, folder):
    return two_step(spark, folder).routes


@query
def moved_images(spark, folder):
    done = two_step(spark, folder)
    return rt.moved_images(
        done.duplicates.select("vec_id"), done.pairs.select(F.col("moved").alias("vec_id"))
    )


@query
def result_labels(spark, folder):
    images, faces = tb.images_with_faces(spark, folder)
    by_face = stages.face_stage(fc.faces_per_image(images, faces, "image_id"), "image_id").routes
    done = two_step(spark, folder)
    first = rt.result_labels(done.routes, vec_name()).unionByName(rt.pair_labels(number_pairs(done.pairs)))
    return first.unionByName(rt.result_labels(by_face, vec_name("image_id")))


@query
def stage_status(spark, folder):
    first = rt.similarity_status(two_step(spark, folder).stats, tb.THRESHOLD, OUT, BOTH)
    images, faces = tb.images_with_faces(spark, folder)
    second = rt.face_status(fc.face_stats(fc.faces_per_image(images, faces, "image_id")), OUT)
    third = rt.cluster_status(cluster_stats(spark, folder), "diversity", OUT)
    parts = [("similarity", first), ("faces", second), ("refinement", third)]
    named = [df.select(F.lit(stage).alias("stage"), "status") for stage, df in parts]
    return named[0].unionByName(named[1]).unionByName(named[2])


@query
def route_manifest(spark, folder):
    """Written as a partitioned manifest and read back, per route."""
    path = f"{out_root(spark)}/manifest"
    write_routes(two_step(spark, folder).routes, path)
    return spark.read.parquet(path).select("vec_id", F.col("route").cast("string").alias("route"))


def out_root(spark) -> str:
    return f"{scratch_root(spark)}/framesift-out-{uuid.uuid4().hex}"


# faces


@query
def faces_per_image(spark, folder):
    return fc.faces_per_image(*tb.images_with_faces(spark, folder), "image_id")


@query
def face_route(spark, folder):
    counts = fc.faces_per_image(*tb.images_with_faces(spark, folder), "image_id")
    return counts.select("image_id", "n_faces", fc.face_route(F.col("n_faces")).alias("route"))


@query
def face_stats(spark, folder):
    return fc.face_stats(fc.faces_per_image(*tb.images_with_faces(spark, folder), "image_id"))


# refinement


@query
def valid_embeddings(spark, folder):
    return cl.valid_embeddings(tb.face_vectors(spark, folder), "embedding").select("vec_id")


def fixed_clusters(spark, folder):
    rows = tb.labelled(spark, folder)
    return rows, cl.centers_matrix(cl.cluster_means(rows, "embedding"), tb.FIXED_K)


@query
def distance_to_center(spark, folder):
    rows, centers = fixed_clusters(spark, folder)
    gap = cl.own_center_udf(centers)("embedding", "cluster")
    return rows.select("vec_id", "cluster", F.round(gap, 6).alias("distance"))


@query
def min_other_center_distance(spark, folder):
    rows, centers = fixed_clusters(spark, folder)
    gap = cl.other_center_udf(centers)("embedding", "cluster")
    return rows.select("vec_id", "cluster", F.round(gap, 6).alias("distance"))


def picked(spark, folder, method: str) -> DataFrame:
    rows, centers = fixed_clusters(spark, folder)
    return cl.select_images(rows, "vec_id", "embedding", centers, method).withColumn(
        "distance", F.round("distance", 6)
    )


@query
def select_consistency(spark, folder):
    return picked(spark, folder, "consistency")


@query
def select_diversity(spark, folder):
    return picked(spark, folder, "diversity")


@query
def cluster_dest_name(spark, folder):
    return picked(spark, folder, "diversity").select(
        "vec_id", names.cluster_dest_name(vec_name(), F.col("cluster"), "diversity").alias("dest_name"),
        names.cluster_label(F.col("cluster"), vec_name()).alias("label"),
    )


@query
def cluster_stats(spark, folder):
    rows, centers = fixed_clusters(spark, folder)
    selected = cl.select_images(rows, "vec_id", "embedding", centers, "diversity")
    return cl.cluster_stats(rows, selected, len(centers))


@query
def lloyd_step(spark, folder):
    rows = tb.vectors(spark, folder)
    step = cl.lloyd_step(rows, "embedding", cl.first_centers(rows, "vec_id", "embedding", tb.FIXED_K))
    return step.select("cluster", "n", F.posexplode("center").alias("dim", "value")).select(
        F.col("cluster").cast("long").alias("cluster"), "n", F.col("dim").cast("long").alias("dim"),
        F.round("value", 6).alias("value"),
    )


@query
def kmeans_assign(spark, folder):
    assigned, _ = cl.kmeans(tb.vectors(spark, folder), "vec_id", "embedding", tb.FIXED_K, **KM)
    return assigned.select(
        "vec_id", F.col("cluster").cast("long").alias("cluster"), F.round("distance", 6).alias("distance")
    )


@query
def cluster_plot_data(spark, folder):
    done = stages.refine_stage(
        tb.face_vectors(spark, folder), "vec_id", "embedding", tb.FIXED_K, "diversity", **KM
    )
    return cl.plot_data(done.assigned, done.selected, "vec_id", "embedding").select(
        "vec_id", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"),
        F.col("cluster").cast("long").alias("cluster"), "is_selected",
    )


@query
def plot_tiles(spark, folder):
    """Tiles of the given clusters: first two components of every vector as its place."""
    rows = tb.labelled(spark, folder)
    points = rows.select(
        "vec_id", F.get("embedding", F.lit(0)).cast("double").alias("x"), F.get("embedding", F.lit(1)).cast("double").alias("y"),
        "cluster", (F.col("vec_id") % 10 == 0).alias("is_selected"),
    )
    return tiles_of(points, "vec_id", zooms=4, cells=8)


@query
def stage_refine(spark, folder):
    done = stages.refine_stage(
        tb.face_vectors(spark, folder), "vec_id", "embedding", tb.FIXED_K, "diversity", **KM
    )
    return done.selected.select(
        "vec_id", F.col("cluster").cast("long").alias("cluster"), F.round("distance", 6).alias("distance"),
        names.cluster_dest_name(vec_name(), F.col("cluster"), "diversity").alias("dest_name"),
    )


# captions


@query
def prompt_cross(spark, folder):
    prompts = tb.table(spark, folder, tb.PROMPT_TABLE).select(
        F.col("r_regionkey").alias("prompt_no"), F.col("r_name").alias("prompt")
    )
    files = tb.captions(spark, folder).select("conv_id", "pos")
    return cap.with_prompts(files, prompts).select("conv_id", "pos", "prompt")


@query
def prompt_answers(spark, folder):
    """All prompts asked of a row at once, in chunks of two; the captions stand for the answers."""
    prompts = tb.table(spark, folder, tb.PROMPT_TABLE).select(
        F.col("r_regionkey").alias("prompt_no"), F.col("r_name").alias("prompt")
    )
    said = tb.captions(spark, folder).select("conv_id", "pos", "caption")

    def answer(asked):
        return F.transform(asked, lambda p: F.concat(p, F.lit(": "), F.col("caption")))

    return cap.answer_prompts(said, prompts, answer, ["caption"], 2)


@query
def cache_hits(spark, folder):
    wanted = tb.table(spark, folder, "documents").select("doc_id")
    return cap.cache_hits(wanted, tb.table(spark, folder, "labels"), "doc_id")


@query
def cache_misses(spark, folder):
    wanted = tb.table(spark, folder, "documents").select("doc_id")
    return cap.cache_misses(wanted, tb.table(spark, folder, "labels"), "doc_id")


@query
def caption_list(spark, folder):
    return cap.caption_list(tb.captions(spark, folder), "conv_id")


@query
def caption_at(spark, folder):
    requests = tb.table(spark, folder, "conversations").select("conv_id").distinct()
    return cap.caption_at(requests, tb.captions(spark, folder), "conv_id", 2)


@query
def caption_export(spark, folder):
    return cap.caption_files(tb.captions(spark, folder))


@query
def caption_export_files(spark, folder):
    """Captions written as files below their export folders, then read back."""
    named = tb.captions(spark, folder).select(
        F.col("conv_id").alias("request"), "pos", "filename", "caption",
        F.concat(F.lit("Photo Set "), (F.col("conv_id") % 5).cast("string")).alias("identifier"),
        (F.col("conv_id") % 2 == 0).alias("use_hash"),
    )
    out = f"{out_root(spark)}/captions"
    write_caption_files(cap.export_files(named), out)
    texts = spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True)
    texts = texts.option("pathGlobFilter", "*.txt").load(out)
    parts = F.split(F.col("_metadata.file_path"), "/")
    return texts.select(
        F.element_at(parts, -3).cast("long").alias("request"), F.element_at(parts, -2).alias("folder"),
        F.element_at(parts, -1).alias("txt_name"), F.col("value").alias("content"),
    )


@query
def unique_copy_names(spark, folder):
    """Export names of files from many folders: of equal names one stays as it is."""
    docs = tb.table(spark, folder, "documents").select(
        F.col("doc_id"), F.concat(F.lit("/set/"), F.col("doc_id").cast("string"), F.lit(".png")).alias("path"),
        F.concat(F.lit("out.d/IMG_"), (F.col("doc_id") % 300).cast("string"), F.lit(".png")).alias("dest_name"),
    )
    return unique_names(docs)


@query
def stage_caption(spark, folder):
    """Whole captioning stage with a cache: the texts come from the table, not from a model."""
    rows = tb.captions(spark, folder).select(
        F.col("conv_id").alias("request"), "pos", "filename",
        F.concat(F.lit("/set/"), "filename").alias("path"),
        F.timestamp_seconds(F.col("conv_id") * 60).alias("mtime"),
        F.lit("describe").alias("prompt"),
        F.concat(F.lit("Photo Set "), (F.col("conv_id") % 5).cast("string")).alias("identifier"),
        (F.col("conv_id") % 2 == 0).alias("use_hash"), F.lit("model-a").alias("model_key"),
        F.col("caption").alias("text"),
    )
    # conversations with equal files and texts are equal requests; a second call finds all in the cache
    cache = f"{out_root(spark)}/cache"
    first = stages.caption_stage(rows, cache, F.col("text"))
    again = stages.caption_stage(rows, cache, F.lit("not asked again"))
    parts = [
        cap.caption_files(done, ["request", "request_key"]).withColumn("call", F.lit(call))
        for call, done in ((1, first), (2, again))
    ]
    return parts[0].unionByName(parts[1])


@query
def full_flow(spark, folder):
    """Similarity, face filter, refinement and captions in the recommended order."""
    ids = tb.vectors(spark, folder)
    first = two_step(spark, folder).routes.filter(F.col("route") != "keep")
    stay = save_table(rt.remaining(ids, first, "vec_id"), "stay")
    faces = tb.table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("vec_id"))
    counts = fc.faces_per_image(stay.select("vec_id"), faces.join(stay.select("vec_id"), "vec_id", "left_semi"), "vec_id")
    second = stages.face_stage(counts, "vec_id").routes.filter(F.col("route") != "keep")
    single = save_table(rt.remaining(stay, second, "vec_id"), "single")
    third = stages.refine_stage(single, "vec_id", "embedding", 5, "consistency", **KM)
    texts = tb.table(spark, folder, "documents").select(F.col("doc_id").alias("vec_id"), "text")
    chosen = save_table(third.selected.select("vec_id", "cluster").join(texts, "vec_id"), "chosen")
    files = chosen.select(
        F.lit("set").alias("request"), F.col("vec_id").alias("pos"), vec_name().alias("filename"),
        F.concat(F.lit("/set/"), vec_name()).alias("path"), F.timestamp_seconds("vec_id").alias("mtime"),
        F.lit("describe").alias("prompt"), F.lit("Photo Set").alias("identifier"),
        F.lit(True).alias("use_hash"), F.lit("model-a").alias("model_key"), "text",
    )
    done = stages.caption_stage(files, f"{out_root(spark)}/cache", F.col("text"))
    told = done.select(F.col("pos").cast("long").alias("vec_id"), names.text_name(F.col("filename")).alias("txt_name"), F.col("caption").alias("content"))
    return chosen.select("vec_id", F.col("cluster").cast("long").alias("cluster")).join(told, "vec_id")
