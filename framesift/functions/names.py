"""File names, identifiers, request keys and labels as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted suffixes, blanks a name is split on, texts shown to the user.
IMAGE_SUFFIX = r"\.(png|jpg|jpeg)$"
BLANK = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
LETTERS_ONLY = r"^\p{L}+$"
KEY_HASH_DIGITS = 5
CAPTION_TEXT_SUFFIX = ".txt"
LABELS = {
    "duplicate_images": "Duplicate: ",
    "similar_images": "Similar pair: ",
    "no_faces": "No face: ",
    "multiple_faces": "Multiple faces: ",
}


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def is_image_name(name: Column) -> Column:
    return F.lower(name).rlike(IMAGE_SUFFIX)


def stem(name: Column) -> Column:
    """Name without its ``extension``."""
    return F.substring(name, F.lit(1), F.length(name) - F.length(extension(name)))


def extension(name: Column) -> Column:
    """Last suffix with its dot, empty when there is none or only leading dots."""
    return F.regexp_extract(name, r"(?s)^\.*[^.].*?(\.[^.]*)$", 1)


def text_name(name: Column) -> Column:
    """Name of the caption text of an image."""
    return F.concat(stem(name), F.lit(CAPTION_TEXT_SUFFIX))


def cluster_dest_name(name: Column, cluster: Column, method: str) -> Column:
    """Export path of a selected image: method folder, cluster number before the suffix."""
    ext = extension(name)
    base = F.substring(name, F.lit(1), F.length(name) - F.length(ext))
    return F.concat(F.lit(f"{method}_cluster/"), base, F.lit("_cluster"), cluster.cast("string"), ext)


def fluxkey(name: Column, use_hash: bool = True) -> Column:
    """Identifier put in front of captions.

    Hashed form: first letters, upper-cased, of the words made of letters only, then
    ``_`` and the first digits of the SHA-1 of the name as given. Plain form: the name
    without outer blanks.
    """
    if not use_hash:
        return F.regexp_replace(name, f"^{BLANK}|{BLANK}$", "")
    words = F.filter(F.split(name, BLANK), lambda w: w.rlike(LETTERS_ONLY))
    initials = F.array_join(F.transform(words, lambda w: F.upper(F.substring(w, 1, 1))), "")
    digest = F.substring(F.sha1(F.encode(name, "UTF-8")), 1, KEY_HASH_DIGITS)
    return F.concat(initials, F.lit("_"), digest)


def caption_prefix(identifier: Column, caption: Column) -> Column:
    return F.concat(identifier, F.lit(", "), caption)


def export_name(identifier: Column, suffix: str = ".zip") -> Column:
    """Name of a caption export. An underscore in the identifier marks it as hashed."""
    return F.when(
        F.contains(identifier, F.lit("_")), F.concat(identifier, F.lit(f"_captions{suffix}"))
    ).otherwise(F.lit(f"captions{suffix}"))


def result_label(route: Column, name: Column) -> Column:
    """Gallery text of a moved image; null for images that stay."""
    prefix = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])
    return F.concat(prefix[route], name)


def cluster_label(cluster: Column, name: Column) -> Column:
    return F.concat(F.lit("Cluster "), cluster.cast("string"), F.lit(": "), name)


def mtime_text(mtime: Column) -> Column:
    """Modification time in microseconds: the text in request keys, the same in every time zone."""
    return F.unix_micros(mtime.cast("timestamp")).cast("string")
