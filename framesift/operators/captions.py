"""Caption requests: keys, prompts, cache, ordering and export."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framesift.functions.names import export_name, fluxkey, text_name

KEY_CHUNK = 10_000  # files per digest of a request key
PROMPT_CHUNK = 256  # prompts asked of a picture at a time


def truth_text(flag: Column) -> Column:
    return F.when(flag, "True").otherwise("False")


def request_keys(files: DataFrame, request: Sequence[str], params: Sequence[Column]) -> DataFrame:
    """(request..., n_files, request_key) from (request..., pos, name, mtime text).

    Files are taken in chunks of consecutive positions, so that no task gathers a whole huge
    request: a chunk's digest is the MD5 of its ``name:mtime`` in order, joined by ``|``. The key
    is the MD5 of the chunk digests and the parameters, joined by ``|``; nulls count as empty
    texts. ``pos`` counts from 0 within a request.
    """
    request = list(request)
    chunk = F.floor(F.col("pos") / KEY_CHUNK).alias("_chunk")
    entry = F.struct("pos", F.concat_ws(":", *[F.coalesce(c, F.lit("")) for c in ("name", "mtime")]).alias("text"))
    joined = files.groupBy(*request, chunk).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["text"]), "|").alias("text"),
        F.count(F.lit(1)).alias("_n"),
    )
    parts = joined.select(
        *request, "_chunk", "_n", F.md5(F.encode("text", "UTF-8")).alias("_digest"),
    )
    digests = F.array_sort(F.collect_list(F.struct("_chunk", "_digest")))
    whole = parts.groupBy(*request).agg(
        F.array_join(F.transform(digests, lambda e: e["_digest"]), "|").alias("_files"),
        F.sum("_n").alias("n_files"),
    )
    given = [F.coalesce(F.col(p) if isinstance(p, str) else p, F.lit("")) for p in params]
    text = F.concat_ws("|", "_files", *given)
    return whole.select(*request, "n_files", F.md5(F.encode(text, "UTF-8")).alias("request_key"))


def with_prompts(images: DataFrame, prompts: DataFrame) -> DataFrame:
    """Every prompt (prompt_no, prompt) on every image; the result is that product, whatever the sizes."""
    return images.crossJoin(prompts.select("prompt_no", "prompt"))


def prompt_chunks(prompts: DataFrame, size: int = PROMPT_CHUNK) -> DataFrame:
    """(chunk, asked): the prompts (prompt_no, prompt) as arrays of at most ``size``, numbers being unique and not negative."""
    asked = F.array_sort(F.collect_list(F.struct("prompt_no", "prompt"))).alias("asked")
    return prompts.groupBy(F.floor(F.col("prompt_no") / size).alias("chunk")).agg(asked)


def answer_prompts(
    rows: DataFrame, prompts: DataFrame, answer: Callable[[Column], Column], dropped: Sequence[str] = (), size: int = PROMPT_CHUNK
) -> DataFrame:
    """``rows`` without ``dropped``, with prompt_no, prompt and answer: every prompt asked of every row.

    ``answer`` maps an array of prompts to the array of their answers. A row meets one array per ``size``
    prompts, so a picture travels and is decoded once for all of them; pictures are dropped before the
    answers are laid out as rows.
    """
    met = rows.crossJoin(prompt_chunks(prompts, size))
    kept = [c for c in rows.columns if c not in dropped]
    told = met.select(*kept, F.arrays_zip("asked", answer(F.col("asked.prompt")).alias("answer")).alias("_told"))
    return told.select(*kept, F.explode("_told").alias("_t")).select(*kept, "_t.asked.prompt_no", "_t.asked.prompt", "_t.answer")


def cache_hits(wanted: DataFrame, cache: DataFrame, key: str, use_cache: bool = True, force_refresh: bool = False) -> DataFrame:
    """Requests answered by the cache. Either switch bypasses the read."""
    if force_refresh or not use_cache:
        return wanted.limit(0)
    return wanted.join(cache.select(key), key, "left_semi")


def cache_misses(wanted: DataFrame, cache: DataFrame, key: str, use_cache: bool = True, force_refresh: bool = False) -> DataFrame:
    """Requests to compute. Their results are written to the cache in any case."""
    if force_refresh or not use_cache:
        return wanted
    return wanted.join(cache.select(key), key, "left_anti")


def caption_list(captions: DataFrame, request: str) -> DataFrame:
    """(request, pos, caption), sorted by upload order within a request: one shape at any size."""
    return captions.select(request, "pos", "caption").orderBy(request, "pos")


def caption_at(requests: DataFrame, captions: DataFrame, request: str, index: int) -> DataFrame:
    """(request, caption) of the caption with this index; empty text when out of range.

    The rank filter keeps at most index + 1 rows per request and task before the shuffle.
    """
    if index < 0:
        return requests.select(request, F.lit("").alias("caption"))
    rank = F.row_number().over(Window.partitionBy(request).orderBy("pos"))
    found = captions.select(request, "pos", "caption").withColumn("_r", rank).filter(F.col("_r") == index + 1)
    return requests.select(request).join(found.select(request, "caption"), request, "left").select(
        request, F.coalesce("caption", F.lit("")).alias("caption")
    )


def caption_files(captions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., txt_name, content): one text per image name, the last caption wins."""
    return (
        captions.groupBy(*by, text_name(F.col("filename")).alias("txt_name"))
        .agg(F.max_by("caption", "pos").alias("content"))
    )


def export_folder(request: Column, identifier: Column, use_hash: Column) -> Column:
    """Folder of a caption export: the request, so that exports do not mix, and the export name."""
    label = F.when(use_hash, fluxkey(identifier)).otherwise(fluxkey(identifier, False))
    return F.concat_ws("/", request.cast("string"), export_name(label, ""))


def export_files(captions: DataFrame) -> DataFrame:
    """(folder, txt_name, content) of captions as ``caption_stage`` gives them, for ``write_caption_files``."""
    placed = captions.withColumn("folder", export_folder(F.col("request"), F.col("identifier"), F.col("use_hash")))
    return caption_files(placed, ["folder"])
