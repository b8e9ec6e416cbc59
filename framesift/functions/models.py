"""Pluggable vision models as batch UDFs over image structs.

A model is given as a zero-argument factory that returns ``fn(list_of_rgb_arrays, ...)``.
The factory runs once per Python worker and task, never on the driver; Spark partitions
the images. The stand-ins below need no weights; they exist for tests and dry runs and are
used only where they are passed by name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framesift.functions.geometry import MAX_DIMENSION
from framesift.functions.pixels import average_hash_hex, decode, grey, resize, resize_nearest

# Detector names, caption models, input sizes and batch limits.
DETECTORS = (
    "opencv", "ssd", "dlib", "mtcnn", "fastmtcnn",
    "retinaface", "mediapipe", "yolov8", "yunet", "centerface",
)
DEFAULT_DETECTOR = "retinaface"
CAPTION_MODELS = ("Qwen2.5-VL-3B-Instruct", "Qwen2.5-VL-7B-Instruct")
FEATURE_SIDE = 224
FACE_BATCH = 32
MAX_NEW_TOKENS = 128


def _batches(n: int, size: int) -> Iterator[slice]:
    return (slice(at, at + size) for at in range(0, n, size))


def _rgb_rows(images: pd.DataFrame) -> list[np.ndarray | None]:
    return [
        decode(row) if row.height and row.height > 0 else None
        for row in images.itertuples(index=False)
    ]


def vector_udf(make_model: Callable, batch_size: int = FACE_BATCH, side: int | None = None):
    """UDF image -> array<float>: feature extraction (fixed ``side``) or face embedding.

    The model returns one vector, or None where it finds nothing, per image. An image that
    cannot be decoded gets null.
    """

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        model = make_model()
        for images in batches:
            out: list = []
            for part in _batches(len(images), batch_size):
                pixels = _rgb_rows(images.iloc[part])
                ready = [p for p in pixels if p is not None]
                if side:
                    ready = [resize_nearest(p, side, side) for p in ready]
                vectors = iter(model(ready) if ready else [])
                for p in pixels:
                    v = next(vectors) if p is not None else None
                    out.append(None if v is None else np.asarray(v, dtype=np.float32))
            yield pd.Series(out, dtype=object)

    return run


def given(make_model: Callable | None, what: str) -> Callable:
    """The factory; raises on the driver, before any job, if there is none."""
    if make_model is None:
        raise ValueError(f"no {what} given: pass a factory")
    return make_model


def feature_udf(make_model: Callable | None = None, batch_size: int = FACE_BATCH):
    """Global feature vector of an image resized to the fixed input side."""
    return vector_udf(given(make_model, "feature model"), batch_size, FEATURE_SIDE)


def face_embedding_udf(make_model: Callable | None = None, batch_size: int = FACE_BATCH):
    """Embedding of the face in an image; null where there is no face."""
    return vector_udf(given(make_model, "face embedder"), batch_size)


def detector_of(backend: str, detectors: dict[str, Callable] | None) -> Callable:
    """The factory of a detector; raises on the driver, before any job, if the name is unknown or nothing is given."""
    if backend not in DETECTORS:
        raise ValueError(f"unknown detector {backend!r}; use one of {', '.join(DETECTORS)}")
    if backend not in (detectors or {}):
        raise ValueError(f"no detector given for {backend!r}: pass detectors={{{backend!r}: factory}}")
    return detectors[backend]


def count_faces_udf(
    backend: str = DEFAULT_DETECTOR, align: bool = True, detectors: dict[str, Callable] | None = None
):
    """UDF image -> number of faces. A detector that fails on an image counts as zero.

    ``detectors`` maps a backend name to a factory of ``fn(rgb, align) -> list of faces``.
    The name is checked here, on the driver, before any job runs.
    """
    make_detector = detector_of(backend, detectors)

    @F.pandas_udf("int")
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        detect = make_detector()

        def count(row) -> int:
            try:
                return len(detect(decode(row), align))
            except Exception:
                return 0

        for images in batches:
            yield pd.Series([count(row) for row in images.itertuples(index=False)], dtype="int32")

    return run


class Picture(NamedTuple):
    """One row of the image source."""

    height: int
    width: int
    nChannels: int
    data: bytes


MEASURED = "image_id string, filename string, path string, error boolean, hash string, feature array<float>, n_faces int, embedding array<float>"


def measured_images(
    images: DataFrame,
    make_features: Callable | None = None,
    make_detector: Callable | None = None,
    make_embedder: Callable | None = None,
    align: bool = True,
    with_hash: bool = True,
    batch_size: int = FACE_BATCH,
) -> DataFrame:
    """All that the stages need to know of each picture, from one pass that decodes it once; see MEASURED.

    Pictures never leave the task that read them: hash, model input, face count and face embedding are
    taken side by side, and only these narrow columns go on. A model that is not given leaves its
    column null, as does a picture that cannot be decoded; a detector that fails on a picture counts
    no face. The models see every decodable picture, also those that a later stage drops.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(MEASURED))

    def vectors(model, pixels: list) -> list:
        ready = [p for p in pixels if p is not None]
        found = iter(model(ready) if ready else [])
        out = [None if p is None else next(found) for p in pixels]
        return [None if v is None else np.asarray(v, dtype=np.float32) for v in out]

    def faces(detect, pixels) -> int | None:
        if pixels is None:
            return None
        try:
            return len(detect(pixels, align))
        except Exception:
            return 0

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        features, detect, embed = (make() if make else None for make in (make_features, make_detector, make_embedder))
        for batch in batches:
            for part in _batches(batch.num_rows, batch_size):
                rows = batch.slice(part.start, batch_size)
                found = [Picture(*(x[c] for c in Picture._fields)) for x in rows.column(4).to_pylist()]
                pixels = [decode(p) if p.height and p.height > 0 else None for p in found]
                none = [None] * len(pixels)
                inputs = [None if p is None else resize_nearest(p, FEATURE_SIDE, FEATURE_SIDE) for p in pixels] if features else none
                columns = [
                    [average_hash_hex(p) if with_hash and p is not None else None for p in pixels],
                    vectors(features, inputs) if features else none,
                    [faces(detect, p) for p in pixels] if detect else none,
                    vectors(embed, pixels) if embed else none,
                ]
                arrays = [*rows.columns[:4], *(pa.array(c, schema.field(i).type) for i, c in enumerate(columns, 4))]
                yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    return images.select("image_id", "filename", "path", "error", "image").mapInArrow(run, MEASURED)


def caption_udf(make_model: Callable | None = None, model_key: str = CAPTION_MODELS[0], batch_size: int = 8):
    """UDF (image, prompt) -> caption. ``fn(images, prompts, max_new_tokens) -> texts``."""
    if model_key not in CAPTION_MODELS:
        raise ValueError(f"unknown caption model {model_key!r}; use one of {', '.join(CAPTION_MODELS)}")
    factory = given(make_model, "caption model")

    @F.pandas_udf("string")
    def run(batches: Iterator[tuple[pd.DataFrame, pd.Series]]) -> Iterator[pd.Series]:
        model = factory()
        for images, prompts in batches:
            out: list = []
            for part in _batches(len(images), batch_size):
                pixels = _rgb_rows(images.iloc[part])
                asked = [(p, q) for p, q in zip(pixels, prompts.iloc[part]) if p is not None]
                texts = iter(model([p for p, _ in asked], [q for _, q in asked], MAX_NEW_TOKENS) if asked else [])
                out += [None if p is None else next(texts) for p in pixels]
            yield pd.Series(out, dtype=object)

    return run


def prompts_udf(make_model: Callable | None = None, model_key: str = CAPTION_MODELS[0], batch_size: int = 8, limit: int = MAX_DIMENSION):
    """UDF (image, array of prompts) -> array of captions, null for a picture that cannot be decoded.

    A picture is decoded and shrunk to ``limit`` once, then asked all its prompts. The model is
    that of ``caption_udf``; a call gets at most ``batch_size`` questions.
    """
    if model_key not in CAPTION_MODELS:
        raise ValueError(f"unknown caption model {model_key!r}; use one of {', '.join(CAPTION_MODELS)}")
    factory = given(make_model, "caption model")

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[tuple[pd.DataFrame, pd.Series]]) -> Iterator[pd.Series]:
        model = factory()
        for images, prompts in batches:
            out: list = []
            for image, asked in zip(images.itertuples(index=False), prompts):
                if not image.height or image.height <= 0:
                    out.append(None)
                    continue
                picture = decode(image)
                side = max(picture.shape[:2])
                if side > limit:
                    h, w = (int(n * (limit / side)) for n in picture.shape[:2])
                    picture = resize(picture, w, h)
                texts: list = []
                for part in _batches(len(asked), batch_size):
                    questions = list(asked[part])
                    texts += model([picture] * len(questions), questions, MAX_NEW_TOKENS)
                out.append(texts)
            yield pd.Series(out, dtype=object)

    return run


def resize_udf(limit: int):
    """UDF image -> image shrunk so that no side exceeds ``limit`` (BGR bytes, 3 channels)."""

    @F.pandas_udf("struct<origin string, height int, width int, nChannels int, mode int, data binary>")
    def run(images: pd.DataFrame) -> pd.DataFrame:
        images = images.copy()
        for at, row in enumerate(images.itertuples(index=False)):
            if row.height <= 0 or max(row.width, row.height) <= limit:
                continue
            ratio = min(limit / row.width, limit / row.height)
            w, h = int(row.width * ratio), int(row.height * ratio)
            small = resize(decode(row), w, h)
            for name, value in zip(
                ("height", "width", "nChannels", "mode", "data"), (h, w, 3, 16, small[:, :, ::-1].tobytes())
            ):
                images.iat[at, images.columns.get_loc(name)] = value
        return images

    return run


def model_input_udf(side: int = FEATURE_SIDE):
    """UDF image -> image of ``side`` x ``side`` pixels, the size the feature model reads.

    Far smaller than the decoded picture, so it is what should travel through a join. An
    image that cannot be decoded is passed on as it is.
    """

    @F.pandas_udf("struct<origin string, height int, width int, nChannels int, mode int, data binary>")
    def run(images: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for row in images.itertuples(index=False):
            if row.height > 0:
                small = resize_nearest(decode(row), side, side)[:, :, ::-1].tobytes()
                rows.append((row.origin, side, side, 3, 16, small))
            else:
                rows.append(tuple(row))
        return pd.DataFrame(rows, columns=images.columns)

    return run


# Stand-ins without weights.

def pooled_pixels():
    """8 x 8 block means of each colour: a 192-d feature vector."""
    return lambda images: [resize(p, 8, 8).astype(np.float32).ravel() / 255 for p in images]


def pooled_face():
    """Grey 8 x 8 means; a flat picture has no face."""

    def run(images):
        small = [resize(grey(p), 8, 8).astype(np.float32).ravel() / 255 for p in images]
        return [v if float(v.std()) > 1e-3 else None for v in small]

    return run


def bright_blobs():
    """Counts separate runs of bright columns as faces."""

    def run(rgb, align):
        bright = grey(rgb).mean(axis=0) > 200
        return list(np.flatnonzero(bright & ~np.r_[False, bright[:-1]]))

    return run


def plain_describer():
    """Describes size and brightness; repeats the prompt."""

    def run(images, prompts, max_new_tokens):
        return [
            f"{q}: {p.shape[1]}x{p.shape[0]}, brightness {int(grey(p).mean())}"
            for p, q in zip(images, prompts)
        ]

    return run
