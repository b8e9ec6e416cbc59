"""Sum-of-squares packing of tokenised documents into sequences of fixed length."""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framesift.llm.common import arrow_schema, giving_back
from framesift.session import save_table

MAX_TOKENS = 1024
END_ID = 2
ITEMS_PER_TASK = 50_000  # pieces packed by one task; open bins left by the tasks are packed again
FULL_SHARE = 0.97
TOKENIZER_FILE = "byte_bpe_50k.json"
# Fixed value: the published split pattern of byte-level BPE vocabularies of this family.
SPLIT_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

# Fixed value: the blanks that the pattern's \s stands for.
BLANKS = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LONG_BLANKS = re.compile(f"[{BLANKS}]{{10000,}}")  # the encoder's pattern cannot step back over much longer runs

PIECES = "doc_id long, item long, piece int, start long, length long, ids_crc32 long, ids binary"


def tokenizer_path(name: str = TOKENIZER_FILE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


_encoders: dict = {}


def encoder(name: str):
    """Byte-level BPE of a tokenizer file; gives the ids the file's own library gives.

    The vocabulary and the added tokens are read from the file. The encoder is the faster of
    the two installed ones (about 5 MB a second and core against 1); tests compare both.
    """
    if name not in _encoders:
        import tiktoken

        with open(tokenizer_path(name), encoding="utf-8") as f:
            spec = json.load(f)
        # byte-level vocabularies write the bytes without a visible form as characters from 256 on
        seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in seen}
        byte_of |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(seen))}
        added = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        check_tokenizer(spec, added)
        ranks = {bytes(byte_of[c] for c in word): i for word, i in spec["model"]["vocab"].items() if word not in added}
        _encoders[name] = tiktoken.Encoding(name, pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens=added)
    return _encoders[name]


def check_tokenizer(spec: dict, added: dict[str, int]) -> None:
    """Raises ValueError for a file whose ids the encoder would not give.

    It takes byte-level BPE with the published split pattern, without normalizer, whose merges are
    in the order of the ids they make and whose added tokens are found as they are written.
    """
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    plain = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
    wrong = [name for name, bad in (
        ("model", model.get("type") != "BPE" or model.get("ignore_merges") or model.get("dropout") or model.get("byte_fallback")),
        ("affixes", model.get("continuing_subword_prefix") or model.get("end_of_word_suffix")),
        ("normalizer", spec.get("normalizer")),
        ("pre_tokenizer", any(split.get(k, True) != v for k, v in plain.items())),
        ("added_tokens", any(x.get("lstrip") or x.get("rstrip") or x.get("single_word") or x.get("normalized") for x in spec.get("added_tokens", []))),
    ) if bad]
    vocab = model["vocab"]
    made = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    single = max((i for word, i in vocab.items() if len(word) == 1 and word not in added), default=-1)
    if made != sorted(made) or len(set(made)) < len(made) or (made and made[0] <= single):
        wrong.append("merges")
    if wrong:
        raise ValueError(f"the tokenizer file is not of the supported kind: {', '.join(wrong)}")


def encoded(encode, text: str) -> list[int]:
    """Ids of a text of any kind; long runs of blanks are given to the encoder apart.

    The split pattern takes a run of blanks as one piece, up to the last blank if a character follows; that blank
    goes with what follows. So a cut before it, and one before the run, change no piece.
    """
    options = {"allowed_special": "all", "disallowed_special": ()}
    if len(text) < 10_000 or not LONG_BLANKS.search(text):
        return encode.encode(text, **options)
    added = tuple(encode.special_tokens_set)
    out, at = [], 0
    for run in LONG_BLANKS.finditer(text):
        start, end = run.span()
        if end < len(text) and not text.startswith(added, end):
            end -= 1
        out += encode.encode(text[at:start], **options)
        out += encode._encode_single_piece(text[start:end])
        at = end
    return out + encode.encode(text[at:], **options)


def tokenised_pieces(
    docs: DataFrame, max_tokens: int = MAX_TOKENS, end_id: int = END_ID, tokenizer: str = TOKENIZER_FILE
) -> DataFrame:
    """doc_id, item, piece, start, length, ids_crc32, ids of every document (doc_id, text), stored.

    ids are those of the whole text and ``end_id``, little-endian: of 16 bits each in pieces whose ids are all
    below 65,536, else of 32 (see ``widened``); ids_crc32 is of those of 32 bits. A null text is
    empty. Longer documents are cut into pieces of ``max_tokens``; what remains is their first
    piece. ``item`` numbers the pieces, also those of repeated rows; further columns are ignored;
    an empty table gives no piece. A text is encoded whole: a task holds its ids, some 40 bytes each.
    """
    schema = arrow_schema(PIECES)

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext
        encode = encoder(tokenizer)
        item = TaskContext.get().partitionId() << 40
        for batch in batches:
            held, size = [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = encoded(encode, text or "")
                ids.append(end_id)
                ids = np.array(ids, "<u4")
                first = (len(ids) - 1) % max_tokens + 1
                start, piece = 0, 0
                while start < len(ids):
                    n = max_tokens if piece else first
                    part = ids[start : start + n]
                    small = part.astype("<u2") if part.max() < 1 << 16 else part
                    held.append((doc_id, item, piece, start, n, zlib.crc32(part.tobytes()), small.tobytes()))
                    start, piece, item = start + n, piece + 1, item + 1
                size += ids.nbytes
                if size >= 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
                    held, size = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)

    return save_table(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(giving_back(cut), PIECES), "pieces")


def widened(pieces: DataFrame) -> DataFrame:
    """``pieces`` (length, ids and any other columns) with all ids of 32 bits."""

    def widen(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            at = batch.schema.get_field_index("ids")
            rows = zip(batch.column("length").to_pylist(), batch.column(at).to_pylist())
            ids = [x if len(x) == 4 * n else np.frombuffer(x, "<u2").astype("<u4").tobytes() for n, x in rows]
            yield batch.set_column(at, batch.schema.field(at), pa.array(ids, batch.schema.field(at).type))

    return pieces.mapInArrow(giving_back(widen), pieces.schema)


class OpenBins:
    """Bins of one task. ``count[g]`` is the number of open bins with gap g."""

    def __init__(self, room: int):
        self.room = room
        self.count = np.zeros(room + 1, np.int64)
        self.open: list[list[int]] = [[] for _ in range(room + 1)]
        self.fill: list[int] = []

    def place(self, size: int) -> tuple[int, int]:
        """(bin, offset) of the place that leaves the smallest sum of squared counts.

        Taking a bin of gap g adds 1 - 2 count[g] and, unless it gets full, 1 + 2 count[g - size].
        A new bin only adds the latter. Of equal choices the smallest gap wins, a new bin last.
        """
        room, count = self.room, self.count
        change = 2 * (np.concatenate([[0], count[1 : room - size]]) - count[size:room]) + 1
        change[1:] += 1
        change[0] = 1 - 2 * count[size]
        change = np.where(count[size:room] > 0, change, np.iinfo(np.int64).max)
        fresh = 2 * count[room - size] + 1
        best = int(np.argmin(change)) if len(change) else 0
        if len(change) and change[best] <= fresh:
            gap = size + best
            number = self.open[gap].pop()
            count[gap] -= 1
        else:
            gap, number = room, len(self.fill)
            self.fill.append(0)
        offset = self.fill[number]
        self.fill[number] += size
        left = gap - size
        if left:
            count[left] += 1
            self.open[left].append(number)
        return number, offset


def pack_sizes(sizes: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset, fill of the bin) of each size, placed in the order given.

    Pieces of bins that are less than FULL_SHARE filled are placed once more among themselves, as long as
    that saves bins.
    """

    def place(which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        bins = OpenBins(room)
        number = np.array([bins.place(int(s))[0] for s in sizes[which]], np.int64)
        return number, np.array(bins.fill, np.int64)

    number, fill = place(np.arange(len(sizes)))
    while True:
        loose = fill < FULL_SHARE * room
        again = np.flatnonzero(loose[number])
        if not len(again):
            break
        fresh, filled = place(again)
        if len(filled) >= loose.sum():
            break
        renamed = np.cumsum(~loose) - 1
        number = renamed[number]
        number[again] = fresh + (~loose).sum()
        fill = np.concatenate([fill[~loose], filled])
    order = np.argsort(number, kind="stable")
    ends = np.cumsum(sizes[order])
    first = np.cumsum(fill) - fill
    offset = np.empty(len(sizes), np.int64)
    offset[order] = ends - sizes[order] - first[number[order]]
    return number, offset, fill[number]


PLACED = "item long, bin long, at int, fill int"


def pack_round(items: DataFrame, n_tasks: int, room: int) -> DataFrame:
    """item, bin, at, fill: each of ``n_tasks`` groups of items (item, size) packed by itself."""

    def pack(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        # fixed order, large before small: a repeated task gives the same bins
        rows = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if not rows:
            return
        item, size = (np.concatenate(c) for c in zip(*rows))
        order = np.lexsort((item, -size))
        item, size = item[order], size[order]
        number, offset, fill = pack_sizes(size.astype(np.int64), room)
        base = TaskContext.get().partitionId() << 36
        yield pa.RecordBatch.from_arrays(
            [pa.array(item), pa.array(number + base), pa.array(offset.astype(np.int32)), pa.array(fill.astype(np.int32))],
            names=["item", "bin", "at", "fill"],
        )

    # dealt by a hash of the item: groups of even size whatever the documents are
    dealt = items.select("item", F.col("size").cast("int").alias("size"))
    return dealt.repartition(n_tasks, F.xxhash64("item")).mapInArrow(giving_back(pack), PLACED)


def packed_places(
    pieces: DataFrame, room: int = MAX_TOKENS, items_per_task: int = ITEMS_PER_TASK
) -> DataFrame:
    """item, sequence_id, offset of all pieces (item, length), 1 <= length <= room.

    Full pieces are sequences of their own. The others are dealt to tasks of about
    ``items_per_task`` pieces, each of which packs its own by the sum-of-squares rule. Bins with
    room left then go as items to a sixteenth of the tasks, but to so many that none gets more than
    ``items_per_task``, until one task has packed the last of them. If that takes more than half
    the tasks of the round before (most pieces fill over half a sequence, say), no further round
    is made: the bins that are still open are sequences as they are.
    """
    narrow = pieces.select("item", "length")
    places = narrow.filter(F.col("length") == room).select(
        "item", (-F.col("item") - 1).alias("sequence_id"), F.lit(0).alias("offset")
    )
    left = narrow.filter(F.col("length") < room).select("item", F.col("length").alias("size"))
    n_tasks = max(1, -(-left.count() // items_per_task))
    trail = left.select("item", F.col("item").alias("unit"), F.lit(0).alias("at"))  # pieces of the units left
    number = 0
    while True:
        number += 1
        packed = save_table(pack_round(left, n_tasks, room), "packed")
        bins = packed.select(F.col("item").alias("unit"), "bin", F.col("at").alias("moved"), "fill")
        trail = save_table(
            trail.join(bins, "unit").select("item", "bin", (F.col("at") + F.col("moved")).alias("at"), "fill"), "trail"
        )
        n_open = packed.filter(F.col("fill") < room).select("bin").distinct().count() if n_tasks > 1 else 0
        fewer = max(1, n_tasks // 16, -(-n_open // items_per_task))
        last = n_tasks == 1 or 2 * fewer > max(2, n_tasks)
        # the last round keeps all bins, others those that nothing fits into any more
        done = F.lit(True) if last else F.col("fill") == room
        places = places.unionByName(
            trail.filter(done).select("item", (F.col("bin") * 64 + number).alias("sequence_id"), F.col("at").alias("offset"))
        )
        if last:
            return places
        left = packed.filter(~done).groupBy("bin").agg(F.first("fill").alias("size")).select(F.col("bin").alias("item"), "size")
        trail = trail.filter(~done).select("item", F.col("bin").alias("unit"), "at")
        n_tasks = fewer


def packed_pieces(docs: DataFrame, tokenizer: str = TOKENIZER_FILE) -> DataFrame:
    """doc_id, piece, start, length, ids, sequence_id, offset of all documents (see the parts).

    ids are little-endian unsigned 32-bit ids; they are stored and shuffled in the shorter form of ``tokenised_pieces``.
    """
    pieces = tokenised_pieces(docs, tokenizer=tokenizer)
    told = pieces.select("item", "doc_id", "piece", "start", "length", "ids")
    return widened(told.join(packed_places(pieces), "item").drop("item"))


def packing_report(docs: DataFrame) -> DataFrame:
    """``packed_pieces`` with the CRC-32 of the ids in their place."""
    pieces = tokenised_pieces(docs)
    told = pieces.select("item", "doc_id", "piece", "start", "length", "ids_crc32")
    return told.join(packed_places(pieces), "item").drop("item")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids, lengths: the token ids of each sequence and the lengths of its pieces."""
    part = F.struct("offset", "ids", "length")
    rows = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(part)).alias("parts"))  # one sequence
    return rows.select(
        "sequence_id",
        F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids"),
        F.transform("parts", lambda p: p["length"]).alias("lengths"),
    )
