"""Language identification with hyperdimensional profiles of letter trigrams."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framesift.llm.common import giving_back
from framesift.session import save_table

DIMENSIONS = 1024
ORDER = 3
SEED = 11
UNKNOWN = "und"
GRAM_ROWS = 2048  # gram vectors held at a time
HELD_GRAMS = 1 << 18  # grams of texts held before they are counted
PROFILE_BYTES = 256 << 20  # bound on the prototypes that reach the driver and every task

_CODES = 0x110000


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Code point -> lower-case letter, 0 for what is no letter, -1 where not yet looked up."""
    return np.full(_CODES, -1, np.int32)


def letter_codes(text: str) -> np.ndarray:
    """Lower-case letters of ``text`` as code points; runs of other characters are one 0."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    known = _letters()
    got = known[codes]
    if (got < 0).any():
        for c in np.unique(codes[got < 0]).tolist():
            char = chr(c)
            low = char.lower()
            known[c] = ord(low[0]) if char.isalpha() else 0
        got = known[codes]
    gap = got == 0
    keep = ~gap
    keep[1:] |= gap[1:] & ~gap[:-1]
    got = got[keep]
    if len(got) and got[0] == 0:
        got = got[1:]
    if len(got) and got[-1] == 0:
        got = got[:-1]
    return got


def grams(text: str | None) -> np.ndarray:
    """Trigram keys (21 bits a letter) of the letters with a gap at either end; empty without a letter."""
    codes = letter_codes(text or "")
    if not len(codes):
        return np.empty(0, np.int64)
    codes = np.concatenate([[0], codes, [0]]).astype(np.int64)
    return (codes[:-2] << 42) | (codes[1:-1] << 21) | codes[2:]


@lru_cache(maxsize=4096)
def letter_vector(code: int, dimensions: int, seed: int) -> np.ndarray:
    """Random vector of +1 and -1 of a letter, made from its code alone."""
    return (np.random.default_rng([seed, code]).integers(0, 2, dimensions, np.int8) * 2 - 1).astype(np.int8)


def gram_vectors(keys: np.ndarray, dimensions: int, seed: int) -> np.ndarray:
    """Letter vectors permuted by place (rotated) and bound by multiplication, a row per gram."""
    out = None
    for place in range(ORDER):
        codes = (keys >> (21 * (ORDER - 1 - place))) & 0x1FFFFF
        letters, at = np.unique(codes, return_inverse=True)
        vectors = np.stack([np.roll(letter_vector(int(c), dimensions, seed), ORDER - 1 - place) for c in letters])
        out = vectors[at] if out is None else out * vectors[at]
    return out


class GramCounts:
    """Counts of grams; at most HELD_GRAMS, or those of one text, wait to be counted."""

    def __init__(self):
        self.gram, self.n = np.empty(0, np.int64), np.empty(0, np.int64)
        self.held: list[np.ndarray] = []
        self.size = 0

    def add(self, keys: np.ndarray) -> None:
        self.held.append(keys)
        self.size += len(keys)
        if self.size >= HELD_GRAMS:
            self.counted()

    def counted(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct grams, sorted, and how often each was added."""
        if self.held:
            fresh, n = np.unique(np.concatenate(self.held), return_counts=True)
            self.held, self.size = [], 0
            self.gram, at = np.unique(np.concatenate([self.gram, fresh]), return_inverse=True)
            n = np.concatenate([self.n, n])
            self.n = np.zeros(len(self.gram), np.int64)
            np.add.at(self.n, at, n)
        return self.gram, self.n


def language_profiles(
    docs: DataFrame, dimensions: int = DIMENSIONS, seed: int = SEED
) -> dict[str, np.ndarray]:
    """Prototype of each non-null lang of ``docs`` (text, lang): the bundle of all its gram vectors.

    Grams are counted over all rows and whole texts, the counts combined before the shuffle; each task
    sums the vectors of its grams. Only languages x dimensions sums reach the driver; more than
    PROFILE_BYTES of them raise ValueError before. An empty table has no prototype.
    """

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            per_lang: dict[str, GramCounts] = {}
            for text, lang in zip(batch.column(0), batch.column(1)):
                keys = grams(text.as_py())
                if len(keys):
                    per_lang.setdefault(lang.as_py(), GramCounts()).add(keys)
            for lang, counts in per_lang.items():
                gram, n = counts.counted()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(gram)), pa.array(gram), pa.array(n)], names=["lang", "gram", "n"]
                )

    def bundle(batches: Iterator) -> Iterator:
        import pyarrow as pa

        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            gram, n = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for lang in set(langs.tolist()):
                mine = langs == lang
                total = sums.setdefault(lang, np.zeros(dimensions))
                keys, weight = gram[mine], n[mine].astype(np.float64)
                for at in range(0, len(keys), GRAM_ROWS):
                    total += weight[at : at + GRAM_ROWS] @ gram_vectors(keys[at : at + GRAM_ROWS], dimensions, seed).astype(np.float64)
        for lang, total in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * dimensions), pa.array(range(dimensions), pa.int32()), pa.array(total)],
                names=["lang", "place", "value"],
            )

    known = docs.filter("lang IS NOT NULL AND text IS NOT NULL").select("text", "lang")
    counts = known.mapInArrow(giving_back(count), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    sums = counts.mapInArrow(giving_back(bundle), "lang string, place int, value double")
    sums = sums.groupBy("lang", "place").agg(F.sum("value").alias("value")).groupBy("lang").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("place", "value"))), lambda x: x["value"]).alias("profile")
    )
    sums = save_table(sums, "language-profiles")
    n = sums.count()
    if n * dimensions * 8 > PROFILE_BYTES:
        raise ValueError(f"{n} languages of {dimensions} numbers exceed the bound of {PROFILE_BYTES} bytes: clean the lang column first")
    return {r["lang"]: np.array(r["profile"]) for r in sums.collect()}


def identify_language(
    docs: DataFrame, profiles: dict[str, np.ndarray], seed: int = SEED
) -> DataFrame:
    """Rows of ``docs`` with lang_pred and score, the cosine with the nearest profile (0 to 1).

    A document's vector is the bundle of its gram vectors. Ties go to the smaller language name.
    Null texts, texts without a letter, and every text when nothing was learned are ``und`` with
    score 0. All columns of ``docs`` stay; columns named lang_pred or score are replaced.
    """
    names = sorted(profiles)
    dimensions = len(profiles[names[0]]) if names else 0
    proto = np.stack([profiles[x] / max(np.linalg.norm(profiles[x]), 1e-12) for x in names]) if names else None
    proto = proto.astype(np.float32) if names else None

    def predict(texts: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in texts:
            pred, score = [UNKNOWN] * len(batch), np.zeros(len(batch))
            at = 0 if names else len(batch)
            while at < len(batch):  # so many texts at a time that their gram vectors stay few
                found, size = [], 0
                while at + len(found) < len(batch) and size < 16 * GRAM_ROWS:
                    found.append(np.unique(grams(batch[at + len(found)].as_py()), return_counts=True))
                    size += len(found[-1][0])
                vocabulary = np.unique(np.concatenate([f[0] for f in found]))
                totals = np.zeros((len(found), dimensions), np.float32)
                for low in range(0, len(vocabulary), GRAM_ROWS):
                    part = vocabulary[low : low + GRAM_ROWS]
                    vectors = gram_vectors(part, dimensions, seed).astype(np.float32)
                    for i, (keys, n) in enumerate(found):
                        a, b = np.searchsorted(keys, [part[0], part[-1] + 1])
                        if b > a:
                            totals[i] += n[a:b].astype(np.float32) @ vectors[np.searchsorted(part, keys[a:b])]
                norm = np.maximum(np.linalg.norm(totals, axis=1), 1e-12)
                cosine = (totals @ proto.T) / norm[:, None]
                for i, (keys, _) in enumerate(found):
                    if len(keys):
                        best = int(np.argmax(cosine[i]))
                        pred[at + i], score[at + i] = names[best], min(1.0, max(0.0, float(cosine[i, best])))
                at += len(found)
            yield pa.StructArray.from_arrays([pa.array(pred, pa.string()), pa.array(score)], names=["lang_pred", "score"])

    guess = F.arrow_udf(predict_typed(giving_back(predict)), "lang_pred string, score double")
    kept = [c for c in docs.columns if c.lower() not in ("lang_pred", "score", "_guess")]
    return docs.select(*kept, guess("text").alias("_guess")).select(*kept, "_guess.lang_pred", "_guess.score")


def predict_typed(fn):
    """``fn`` with the type hints of an iterator of Arrow arrays; no pandas in the workers."""
    import pyarrow as pa

    def predict(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from fn(texts)

    predict.__annotations__ = {"texts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return predict


def fold(doc_id: str) -> Column:
    """crc32 of the id as text, modulo 5; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 5


def language_report(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned from the labelled documents not held out."""
    profiles = language_profiles(docs.filter(fold("doc_id") != 0))
    found = identify_language(docs.select("doc_id", "text"), profiles)
    return found.select("doc_id", (fold("doc_id") == 0).alias("held_out"), "lang_pred", "score")
