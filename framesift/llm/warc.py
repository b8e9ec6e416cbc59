"""WARC archives: a writer of one gzip member per record and a splittable reader."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framesift.llm.common import arrow_schema, open_folder
from framesift.session import save_table

MAGIC = b"\x1f\x8b\x08"
HEADER_BYTES = 1 << 20  # a record header longer than this is no header
READ_BYTES = 1 << 20
SPLIT_BYTES = 16 << 20
MIN_REVISIT_BYTES = 100
DATE = "2024-01-01T00:00:00Z"

MANIFEST = "path string, bytes long, records long"
RECORD = (
    "path string, offset long, record_type string, record_id string, target_uri string, date string, "
    "refers_to string, payload_digest string, payload_bytes long, digest_ok boolean, payload binary"
)


def write_archives(
    pages: DataFrame,
    folder: str,
    id_col: str = "page_id",
    url_col: str = "url",
    body_col: str = "html",
    min_bytes: int = MIN_REVISIT_BYTES,
    date: str = DATE,
) -> DataFrame:
    """Write every row of ``pages`` as a WARC record below ``folder``; returns (path, bytes, records).

    Of rows with equal payloads of at least ``min_bytes`` bytes the smallest id is a response, the
    others are revisits of it without a body; shorter ones are all responses. A null body is an
    empty payload, a null url leaves the target out, a row without id is always a response with
    an id made of its digest. Rows repeated under the smallest id are all responses. An empty
    table writes no record. Further columns of ``pages`` are ignored.

    Each task writes one file under a name of its own attempt and renames it when complete, so a
    repeated task replaces the file as a whole.
    """
    payload = F.encode(F.coalesce(F.col(body_col), F.lit("")), "UTF-8")
    rows = pages.select(
        F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload")
    ).select("*", F.sha2("payload", 256).alias("digest"))
    first = rows.filter(F.octet_length("payload") >= min_bytes).groupBy("digest").agg(
        F.min("id").alias("first"), F.count(F.lit(1)).alias("n")
    )
    # only payloads seen twice; stored, so that Spark knows the size and broadcasts it when small
    first = save_table(first.filter("n > 1").drop("n"), "warc-first")
    rows = rows.join(first, "digest", "left").withColumn(
        "refers", F.when(F.col("id") != F.col("first"), F.col("first"))
    )

    def write(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        fs, root = open_folder(folder)
        task = TaskContext.get()
        final = f"{root}/part-{task.partitionId():06d}.warc.gz"
        trial = f"{root}/.trial-{task.partitionId():06d}-{task.taskAttemptId()}"
        fs.create_dir(root, recursive=True)
        size = count = 0
        with fs.open_output_stream(trial) as out:
            for batch in batches:
                for row in batch.to_pylist():
                    member = gzip_member(record_bytes(row["id"], row["url"], row["payload"], row["digest"], row["refers"], date))
                    out.write(member)
                    size += len(member)
                    count += 1
        if count:
            fs.move(trial, final)
            yield pa.RecordBatch.from_pylist([{"path": final, "bytes": size, "records": count}])
        else:
            fs.delete_file(trial)

    wanted = rows.select("id", "url", "payload", "digest", "refers")
    return save_table(wanted.mapInArrow(write, MANIFEST), "warc-manifest")


def page_urn(page_id: int | None, digest: str) -> str:
    return f"<urn:page:{page_id}>" if page_id is not None else f"<urn:sha256:{digest}>"


def record_bytes(page_id, url, payload: bytes, digest: str, refers, date: str) -> bytes:
    """One uncompressed record; a revisit keeps the HTTP header with the length of the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = http.encode() + (payload if refers is None else b"")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers is None else 'revisit'}",
        f"WARC-Record-ID: {page_urn(page_id, digest)}",
        f"WARC-Date: {date}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
        f"WARC-Payload-Digest: sha256:{digest}",
    ]
    if url is not None:  # a line end in an url would end the header line
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers is not None:
        lines.append(f"WARC-Refers-To: {page_urn(refers, digest)}")
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def read_archives(
    spark: SparkSession, folder: str, split_bytes: int = SPLIT_BYTES, with_payload: bool = True
) -> DataFrame:
    """Records of all ``*.warc.gz`` files below ``folder``, read in byte ranges of ``split_bytes``.

    A task owns the records that start inside its range and reads past its end to finish the
    last one. Where it has no known record border it looks for the gzip magic and accepts a
    place only if the member unpacks to a WARC header, is whole, and another member or the end
    of the file follows. Damaged members are passed over to the next valid one. Digests and
    lengths are taken from the payload read; for a revisit, which has none, from its headers.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).select("path", "length")
    ranges = files.filter("length > 0").withColumn(
        "start", F.explode(F.sequence(F.lit(0), F.col("length") - 1, F.lit(split_bytes).cast("long")))
    )
    n = max(1, ranges.count())
    schema = arrow_schema(RECORD)

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa
        held, size = [], 0
        for batch in batches:
            for piece in batch.to_pylist():
                fs, path = open_folder(piece["path"])
                with fs.open_input_file(path) as source:
                    end = min(piece["start"] + split_bytes, piece["length"])
                    for offset, data in members(source, piece["start"], end, piece["length"]):
                        row = parse_record(data)
                        if not with_payload:
                            row["payload"] = None
                        held.append({"path": piece["path"], "offset": offset, **row})
                        size += len(row["payload"] or b"") + 500
                        if size >= 8 << 20:
                            yield pa.RecordBatch.from_pylist(held, schema=schema)
                            held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=schema)

    return ranges.repartition(n).mapInArrow(read, RECORD)


def members(source, start: int, end: int, length: int) -> Iterator[tuple[int, bytes]]:
    """(offset, unpacked bytes) of the WARC members that start in [start, end)."""
    at, known = start, start == 0
    while at < end:
        if not known:
            at = find_magic(source, at, end)
            if at < 0:
                return
        found = unpack(source, at, length)
        if found is not None:
            data, after = found
            follows = after >= length or read_at(source, after, 3) == MAGIC
            if known or follows:
                yield at, data
                at, known = after, follows
                continue
        at, known = at + 1, False


def read_at(source, at: int, n: int) -> bytes:
    source.seek(at)
    return source.read(n)


def find_magic(source, at: int, end: int) -> int:
    """First place in [at, end) with the magic, or -1; the magic may reach past ``end``."""
    while at < end:
        chunk = read_at(source, at, min(READ_BYTES, end - at) + len(MAGIC) - 1)
        found = chunk.find(MAGIC)
        if found >= 0:
            return at + found
        at += max(1, len(chunk) - len(MAGIC) + 1)
    return -1


def unpack(source, at: int, length: int) -> tuple[bytes, int] | None:
    """(unpacked WARC record, place after its member), or None if there is no whole record."""
    packer = zlib.decompressobj(31)
    out, size, checked = [], 0, False
    source.seek(at)
    place, step = at, 1 << 14
    while not packer.eof:
        chunk = source.read(step)
        if not chunk:
            return None
        place += len(chunk)
        step = READ_BYTES
        try:
            data = packer.decompress(chunk)
        except zlib.error:
            return None
        out.append(data)
        size += len(data)
        if not checked and (size >= 7 or packer.eof):
            head = b"".join(out)
            out = [head]
            if not head.startswith(b"WARC/1."):
                return None
            checked = b"\r\n\r\n" in head
            if not checked and size > HEADER_BYTES:
                return None
    data = b"".join(out)
    return (data, place - len(packer.unused_data)) if checked else None


def parse_record(data: bytes) -> dict:
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    size = fields.get("content-length", "")
    block = rest[: int(size)] if size.isdigit() else rest
    http = {}
    payload = block
    if fields.get("content-type", "").startswith("application/http"):
        top, _, payload = block.partition(b"\r\n\r\n")
        for line in top.decode("latin-1").split("\r\n")[1:]:
            name, _, value = line.partition(":")
            http[name.strip().lower()] = value.strip()
    stated = fields.get("warc-payload-digest", "").removeprefix("sha256:") or None
    revisit = fields.get("warc-type") == "revisit"
    digest = stated if revisit else hashlib.sha256(payload).hexdigest()
    told = http.get("content-length", "")
    return {
        "record_type": fields.get("warc-type"),
        "record_id": fields.get("warc-record-id"),
        "target_uri": fields.get("warc-target-uri"),
        "date": fields.get("warc-date"),
        "refers_to": fields.get("warc-refers-to"),
        "payload_digest": digest,
        "payload_bytes": int(told) if revisit and told.isdigit() else len(payload),
        "digest_ok": stated is None or stated == digest,
        "payload": payload,
    }


def page_of(urn):
    """The page id in a record id written by ``write_archives``, else null."""
    return F.regexp_extract(urn, r"^<urn:page:(-?[0-9]+)>$", 1).try_cast("long")


def page_records(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of archived pages."""
    return records.select(
        page_of(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        page_of(F.col("refers_to")).alias("refers_to"), "digest_ok",
    )


