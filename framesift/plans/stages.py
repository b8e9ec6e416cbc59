"""The four stages of refining an image set, and the order they are recommended in."""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framesift.caption_cache import CaptionCache, newest_versions
from framesift.functions.hashing import average_hash_image
from framesift.functions.models import (
    CAPTION_MODELS,
    DEFAULT_DETECTOR,
    FACE_BATCH,
    caption_udf,
    count_faces_udf,
    detector_of,
    face_embedding_udf,
    feature_udf,
    given,
    measured_images,
    model_input_udf,
    prompts_udf,
    resize_udf,
)
from framesift.functions.geometry import MAX_DIMENSION
from framesift.functions.names import caption_prefix, cluster_dest_name, fluxkey, mtime_text
from framesift.operators import captions as cap
from framesift.operators import clusters as cl
from framesift.operators import routes as rt
from framesift.operators.duplicates import hash_duplicates
from framesift.operators.faces import face_route, face_stats
from framesift.operators.matching import greedy_similar_pairs
from framesift.operators.similarity import check_threshold
from framesift.operators.skew import join_to_unique
from framesift.session import save_table
from framesift.sources.images import plain_path

# Method names and the default threshold with its range on screen.
METHODS = ("perceptual_hash", "vgg16_similarity")
DEFAULT_METHODS = ("perceptual_hash",)
DEFAULT_THRESHOLD = 0.85


UNREADABLE = "cannot decode "


class Similarity(NamedTuple):
    routes: DataFrame  # (id, route) of every image
    duplicates: DataFrame | None  # (id, hash, kept)
    pairs: DataFrame | None  # (moved, kept, similarity)
    stats: DataFrame  # one row


def similarity_stage(
    hashes: DataFrame,
    vectors: Callable[[DataFrame], DataFrame] | DataFrame,
    id_col: str,
    vec_col: str,
    threshold: float = DEFAULT_THRESHOLD,
    methods: tuple[str, ...] = DEFAULT_METHODS,
    **sizes: int,
) -> Similarity:
    """Duplicates by hash first, then similar pairs among what stays.

    ``hashes`` (id, hash) lists every image; a null hash marks one that cannot be decoded,
    which stays. ``vectors`` is a table, or a function from the ids that stay to a table,
    so the costly model never sees a duplicate.
    """
    check_threshold(threshold)
    unknown = set(methods) - set(METHODS)
    if unknown:
        raise ValueError(f"unknown methods: {sorted(unknown)}")
    moved, duplicates, pairs = [], None, None
    if "perceptual_hash" in methods:
        duplicates = save_table(hash_duplicates(hashes, id_col), "duplicates")
        moved.append(rt.route_of(duplicates, id_col, "duplicate_images"))
    if "vgg16_similarity" in methods:
        rest = vectors(duplicates) if callable(vectors) else vectors
        if duplicates is not None and not callable(vectors):
            rest = rt.remaining(rest, duplicates, id_col)
        pairs = greedy_similar_pairs(rest, id_col, vec_col, threshold, **sizes)
        moved.append(rt.route_of(pairs, id_col, "similar_images", "moved"))
    if moved:
        gone = moved[0] if len(moved) == 1 else moved[0].unionByName(moved[1])
        routes = rt.all_routes(hashes, gone, id_col)
    else:
        routes = hashes.select(id_col, F.lit("keep").alias("route"))
    stats = routes.agg(
        F.count(F.lit(1)).alias("total_images"),
        F.count_if(F.col("route") == "duplicate_images").alias("duplicates_found"),
        F.count_if(F.col("route") == "similar_images").alias("similar_pairs"),
    )
    return Similarity(routes, duplicates, pairs, stats)


def similarity_of_images(
    images: DataFrame, make_features: Callable | None = None, **options
) -> Similarity:
    """Similarity stage over decoded pictures (``read_images``)."""
    if "vgg16_similarity" in options.get("methods", DEFAULT_METHODS):
        given(make_features, "feature model")
    hashes = save_table(
        images.select("image_id", F.when(~F.col("error"), average_hash_image("image")).alias("hash")), "hashes"
    )

    def features(duplicates: DataFrame | None) -> DataFrame:
        rest = images.filter(~F.col("error"))
        if duplicates is not None:
            # the anti join comes before the model, which thus sees no duplicate; if the
            # join has to shuffle, it moves model inputs and not whole decoded pictures
            rest = rest.select("image_id", model_input_udf()("image").alias("image"))
            rest = rt.remaining(rest, duplicates, "image_id")
        return save_table(rest.select("image_id", feature_udf(make_features)("image").alias("feature")), "features")

    return similarity_stage(hashes, features, "image_id", "feature", **options)


class Faces(NamedTuple):
    routes: DataFrame
    stats: DataFrame


def face_stage(counts: DataFrame, id_col: str) -> Faces:
    """Routes by face count from (id, n_faces)."""
    return Faces(counts.select(id_col, face_route(F.col("n_faces")).alias("route")), face_stats(counts))


def faces_of_images(
    images: DataFrame, backend: str = DEFAULT_DETECTOR, align: bool = True, detectors: dict | None = None
) -> Faces:
    """Face stage over decoded pictures; an undecodable one counts as having no face."""
    n = F.when(~F.col("error"), count_faces_udf(backend, align, detectors)("image")).otherwise(F.lit(0))
    return face_stage(save_table(images.select("image_id", n.alias("n_faces")), "faces"), "image_id")


class Refinement(NamedTuple):
    assigned: DataFrame  # (id, vector, cluster, distance)
    selected: DataFrame  # (id, cluster, distance)
    centers: np.ndarray
    stats: DataFrame


def refine_stage(
    embeddings: DataFrame,
    id_col: str,
    vec_col: str,
    k: int = cl.SCREEN_K,
    method: str = "diversity",
    **kmeans_options,
) -> Refinement:
    """Cluster the images that have a face embedding and pick one per cluster."""
    valid = cl.valid_embeddings(embeddings, vec_col)
    assigned, centers = cl.kmeans(valid, id_col, vec_col, k, **kmeans_options)
    assigned = save_table(assigned, "assigned")
    selected = save_table(cl.select_images(assigned, id_col, vec_col, centers, method), "selected")
    return Refinement(assigned, selected, centers, cl.cluster_stats(assigned, selected, len(centers)))


def refine_images(
    images: DataFrame,
    make_embedder: Callable | None = None,
    on_error: str = "fail",
    batch_size: int = 32,
    method: str = "diversity",
    **options,
) -> Refinement:
    """Refinement over decoded pictures. One undecodable picture stops the stage, unless
    ``on_error='skip'``."""
    if on_error not in ("fail", "skip"):
        raise ValueError("on_error is 'fail' or 'skip'")
    embedding = face_embedding_udf(make_embedder, batch_size)("image")
    if on_error == "fail":
        # the check rides on the pass that runs the model, so pictures are decoded once; it
        # is not a filter, which could be moved below the join that drops earlier stages' images
        stop = F.raise_error(F.concat(F.lit(UNREADABLE), F.col("path")))
        embedding = F.when(F.col("error"), stop.cast("array<float>")).otherwise(embedding)
    else:
        images = images.filter(~F.col("error"))
    embedded = images.select("image_id", "filename", "path", embedding.alias("embedding"))
    try:
        embedded = save_table(embedded, "embeddings")
    except Exception as e:
        if UNREADABLE in str(e):
            raise ValueError("the set holds files that cannot be decoded") from e
        raise
    return refine_stage(embedded, "image_id", "embedding", method=method, **options)


def export_plan(selected: DataFrame, images: DataFrame, id_col: str, method: str | None) -> DataFrame:
    """(id, path, dest_name) of selected images; without a method the name is kept."""
    chosen = F.broadcast(selected.select(id_col, "cluster"))  # one row per cluster
    dest = cluster_dest_name(F.col("filename"), F.col("cluster"), method) if method else F.col("filename")
    return images.select(id_col, "filename", "path").join(chosen, id_col).select(id_col, "path", dest.alias("dest_name"))


def known_requests(cache: DataFrame, keys: DataFrame) -> DataFrame:
    """Stored (request_key, version, n): the latest version of each wanted key in the cache.

    Only two narrow columns are read, and only wanted keys reach the aggregation.
    """
    versions = cache.select("request_key", "version").join(keys.select("request_key"), "request_key", "left_semi")
    return save_table(newest_versions(versions), "known")


def caption_stage(
    files: DataFrame,
    cache_path: str,
    caption=None,
    use_cache: bool = True,
    force_refresh: bool = False,
    models: dict[str, Callable] | None = None,
) -> DataFrame:
    """(request_key, request, identifier, pos, filename, caption) for all requests in ``files``.

    ``files``: request, pos, filename, path, mtime, prompt, identifier, use_hash, model_key
    and whatever ``caption`` (a column) needs. The last four are the same in all rows of a
    request. Requests found in the cache are not computed; all others are, and are stored.
    Without ``caption`` the texts come from ``models``, which maps the model_key of a request to
    the factory of its model; these read the columns image and prompt. A key without a model raises.
    """
    if caption is None:
        asked = {key: caption_udf(factory, key) for key, factory in (models or {}).items()}
        known_key = F.coalesce(F.col("model_key").isin(*asked), F.lit(False))
        other = files.filter(~known_key).select("model_key").head(1)
        if other:
            raise ValueError(f"no caption model given for {other[0][0]!r}: pass models={{model_key: factory}}")
    params = ["prompt", "identifier", "use_hash", "model_key"]
    named = files.select(
        "request", "pos", F.col("path").alias("name"), mtime_text(F.col("mtime")).alias("mtime"), *params
    )
    keyed = cap.request_keys(
        named, ["request", *params],
        ["prompt", "identifier", cap.truth_text(F.col("use_hash")), "model_key"],
    )
    keyed = save_table(keyed, "keyed")
    # equal requests have equal keys; the first one is computed for all of them
    keys = save_table(
        keyed.groupBy("request_key", "identifier", "use_hash", "n_files").agg(F.min("request").alias("request")),
        "keys",
    )
    store = CaptionCache(files.sparkSession, cache_path)
    cache = store.read(keys)
    known = known_requests(cache, keys)
    switches = {"use_cache": use_cache, "force_refresh": force_refresh}
    hits = cap.cache_hits(known, keys, "request_key", **switches)
    misses = cap.cache_misses(keys, known, "request_key", **switches)
    todo = join_to_unique(
        files, misses.select("request", "request_key", "n_files"), ["request"], weight="n_files"
    )
    if caption is not None:
        told = todo.withColumn("_text", caption)
    else:  # a filter per model, as a UDF inside CASE would run on the rows of all others too
        told = reduce(DataFrame.unionByName, [
            todo.filter(F.col("model_key") == key).withColumn("_text", model_caption(udf)) for key, udf in asked.items()
        ])
    label = F.when(F.col("use_hash"), fluxkey(F.col("identifier"))).otherwise(fluxkey(F.col("identifier"), False))
    done = save_table(
        told.select(
            "request_key", F.col("pos").cast("int").alias("pos"), "filename",
            caption_prefix(label, F.col("_text")).alias("caption"),
        ),
        "captions",
    )
    old = join_to_unique(cache, hits, ["request_key", "version"], weight="n").select(*done.columns)
    result = save_table(old.unionByName(done), "captions")
    if done.head(1):
        store.append(done.withColumn("version", F.lit(time.time_ns())))
    # every request gets the rows of its key, also those that asked for the same
    return result.join(keyed.select("request_key", "request", "identifier", "use_hash"), "request_key").select(
        "request_key", "request", "identifier", "use_hash", "pos", "filename", "caption"
    )


def model_caption(model: Callable) -> Column:
    """Text of a ``caption_udf`` for pictures shrunk to its limit."""
    return model(resize_udf(MAX_DIMENSION)("image"), F.col("prompt"))


def captions_of_prompts(images: DataFrame, prompts: DataFrame, make_model: Callable | None = None, model_key: str = CAPTION_MODELS[0]) -> DataFrame:
    """(image_id, filename, path, prompt_no, prompt, answer): every prompt (prompt_no, prompt) asked of every picture.

    A picture that cannot be decoded has rows without answers. See ``captions.answer_prompts``.
    """
    # a deterministic UDF would be run twice: the optimizer repeats it in a filter of empty arrays
    model = prompts_udf(make_model, model_key).asNondeterministic()

    def answer(asked: Column) -> Column:
        # arrays of different lengths would be padded: an undecodable picture answers null to each
        return F.coalesce(model("image", asked), F.transform(asked, lambda _: F.lit(None).cast("string")))

    rows = images.select("image_id", "filename", "path", "image")
    return cap.answer_prompts(rows, prompts, answer, ["image"])


def caption_selected(
    images: DataFrame,
    selected: DataFrame,
    mtimes: DataFrame,
    cache_path: str,
    prompt: str,
    identifier: str,
    use_hash: bool = True,
    model_key: str = CAPTION_MODELS[0],
    **options,
) -> DataFrame:
    """Captions of the selected images (image_id), as one request in the order of their ids.

    ``mtimes`` (path, mtime) goes into the request key (``read_file_meta``); ``options`` go to ``caption_stage``.
    """
    # one row per cluster, so ranked in one task and broadcast
    rank = F.row_number().over(Window.orderBy("image_id")) - 1
    chosen = F.broadcast(selected.select("image_id", rank.alias("pos")))
    times = mtimes.select(plain_path(F.col("path")).alias("_key"), "mtime")
    times = images.select("image_id", plain_path(F.col("path")).alias("_key")).join(chosen, "image_id").join(times, "_key", "left")
    times = F.broadcast(save_table(times.select("image_id", "pos", "mtime"), "chosen"))
    files = images.join(times, "image_id").select(
        F.lit("selected").alias("request"), "pos", "filename", "path", "mtime", F.lit(prompt).alias("prompt"),
        F.lit(identifier).alias("identifier"), F.lit(use_hash).alias("use_hash"), F.lit(model_key).alias("model_key"), "image",
    )
    return caption_stage(files, cache_path, **options)


def refine_set(
    images: DataFrame,
    k: int = cl.SCREEN_K,
    method: str = "diversity",
    similarity: dict | None = None,
    faces: dict | None = None,
    refine: dict | None = None,
    captions: dict | None = None,
) -> dict[str, DataFrame]:
    """Recommended order over decoded pictures: similarity, faces, refinement, captions.

    The pictures are read and decoded in one pass (``measured_images``), which runs the feature model, the
    detector and the embedder on every decodable one; all that follows joins narrow tables. Only the
    selected pictures, one per cluster, are read once more for their captions. Options are those of
    ``similarity_of_images``, ``faces_of_images``, ``refine_images`` and ``caption_selected``.

    Gives the routes of both filters, the selected images and, with ``captions``, their captions.
    """
    similarity, faces, refine = dict(similarity or {}), dict(faces or {}), dict(refine or {})
    features = similarity.pop("make_features", None)
    compared = "vgg16_similarity" in similarity.get("methods", DEFAULT_METHODS)
    detector = detector_of(faces.pop("backend", DEFAULT_DETECTOR), faces.pop("detectors", None))
    on_error = refine.pop("on_error", "fail")
    if on_error not in ("fail", "skip"):
        raise ValueError("on_error is 'fail' or 'skip'")
    known = save_table(
        measured_images(
            images, given(features, "feature model") if compared else None, detector,
            given(refine.pop("make_embedder", None), "face embedder"), faces.pop("align", True),
            "perceptual_hash" in similarity.get("methods", DEFAULT_METHODS), refine.pop("batch_size", FACE_BATCH),
        ),
        "measured",
    )

    def vectors(duplicates: DataFrame | None) -> DataFrame:
        rest = known.filter(~F.col("error")).select("image_id", "feature")
        return rest if duplicates is None else rt.remaining(rest, duplicates, "image_id")

    first = similarity_stage(known.select("image_id", "hash"), vectors, "image_id", "feature", **similarity)
    gone = first.routes.filter(F.col("route") != "keep")
    stay = rt.remaining(known, gone, "image_id")
    second = face_stage(stay.select("image_id", F.coalesce("n_faces", F.lit(0)).alias("n_faces")), "image_id", **faces)
    single = rt.remaining(stay, second.routes.filter(F.col("route") != "keep"), "image_id")
    if on_error == "fail" and single.filter("error").head(1):
        raise ValueError("the set holds files that cannot be decoded")
    embedded = single.filter(~F.col("error")).select("image_id", "filename", "path", "embedding")
    third = refine_stage(embedded, "image_id", "embedding", k=k, method=method, **refine)
    out = {
        "similarity_routes": first.routes,
        "face_routes": second.routes,
        "assigned": third.assigned,
        "selected": third.selected,
        "export": export_plan(third.selected, known, "image_id", method),
    }
    if captions:
        out["captions"] = caption_selected(images, third.selected, **captions)
    return out
