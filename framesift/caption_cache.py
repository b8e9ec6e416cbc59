"""Caption cache: an append-only table in versions, sorted by request key, with merges and a clean-up.

Below the cache folder ``data/<segment>/`` holds Parquet files that never change, ``versions/<n>.json``
lists the files of a version with the range of request keys in each. A version appears by renaming
a finished file, which fails if the number is taken (needs a file system whose rename does not
replace, such as HDFS or a local disk); the writer then starts again from the newer version. Readers stay on the
version they opened. The list of files is held by the driver, as Spark does with the files of any table.
"""

from __future__ import annotations

import json
import time
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterable
from typing import NamedTuple

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framesift.operators.skew import join_to_unique
from framesift.session import save_table

CACHE_SCHEMA = "request_key string, version long, pos int, filename string, caption string"
PREFIX = 4  # hex digits of a request key by which files are chosen: at most 65,536 values reach the driver
FILE_ROWS = 1_000_000  # aimed at rows per file
MERGE = 8  # segments of one size class that are merged into one
TRIES = 50  # versions lost to other writers before giving up


class Part(NamedTuple):
    """A file of the cache, with its lowest and highest request key."""

    segment: str
    file: str
    low: str
    high: str
    n: int


def newest_versions(rows: DataFrame) -> DataFrame:
    """(request_key, version, n): the latest version of each key and its rows."""
    counts = rows.groupBy("request_key", "version").agg(F.count(F.lit(1)).alias("n"))
    newest = counts.groupBy("request_key").agg(F.max(F.struct("version", "n")).alias("v"))
    return newest.select("request_key", "v.version", "v.n")


class CaptionCache:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path(self.path).getFileSystem(conf)
        self._files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), conf)

    def _listed(self, folder: str) -> list:
        place = self._path(f"{self.path}/{folder}")
        return list(self._fs.listStatus(place)) if self._fs.exists(place) else []

    def versions(self) -> list[int]:
        names = [s.getPath().getName() for s in self._listed("versions")]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and not n.startswith((".", "_")))

    def parts(self, version: int | None = None) -> tuple[int, list[Part]]:
        """A version, by default the latest, and its files; 0 and none before the first write."""
        if version is None:
            version = max(self.versions(), default=0)
        if not version:
            return 0, []
        stream = self._fs.open(self._path(f"{self.path}/versions/{version:012d}.json"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return version, [Part(*p) for p in json.loads(text)]

    def matching(self, keys: DataFrame, parts: Iterable[Part]) -> list[Part]:
        """Files whose range holds the first digits of a wanted key."""
        parts = list(parts)
        if not parts:
            return []
        head = F.substring("request_key", 1, PREFIX)
        wanted = sorted(r[0] for r in keys.select(head.alias("p")).filter("p IS NOT NULL").distinct().collect())
        return [p for p in parts if any_between(wanted, p.low[:PREFIX], p.high[:PREFIX])]

    def read(self, keys: DataFrame | None = None, version: int | None = None) -> DataFrame:
        """Rows of a version; with ``keys`` (request_key) only of files that can hold one of them."""
        parts = self.parts(version)[1]
        return self._rows(parts if keys is None else self.matching(keys, parts))

    def _rows(self, parts: list[Part]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], CACHE_SCHEMA)
        paths = [f"{self.path}/data/{p.segment}/{p.file}" for p in parts]
        return self.spark.read.schema(CACHE_SCHEMA).parquet(*paths)

    def _store(self, rows: DataFrame) -> list[Part]:
        """Write ``rows``, a stored table, as a segment. A request of any size is cut between its rows."""
        segment = f"{time.time_ns()}-{uuid.uuid4().hex[:12]}"
        n_files = -(-rows.count() // FILE_ROWS)
        if not n_files:
            return []
        by = ["request_key", "pos"]
        columns = [c.split()[0] for c in CACHE_SCHEMA.split(", ")]
        folder = f"{self.path}/data/{segment}"
        rows.select(*columns).repartitionByRange(n_files, *by).sortWithinPartitions(*by).write.parquet(folder)
        stats = self.spark.read.schema(CACHE_SCHEMA).parquet(folder).groupBy(F.col("_metadata.file_name").alias("file")).agg(
            F.min("request_key").alias("low"), F.max("request_key").alias("high"), F.count(F.lit(1)).alias("n")
        )
        return [Part(segment, r.file, r.low, r.high, r.n) for r in stats.orderBy("low", "high", "file").collect()]

    def _commit(self, change: Callable[[list[Part]], list[Part] | None]) -> int:
        """Make ``change`` of the latest files the next version; None from it leaves all as it is."""
        jvm = self.spark._jvm
        as_new = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        for _ in range(TRIES):
            latest, parts = self.parts()
            new = change(parts)
            if new is None:
                return latest
            draft = self._path(f"{self.path}/versions/_draft-{uuid.uuid4().hex}")
            stream = self._fs.create(draft, False)
            try:
                stream.write(bytearray(json.dumps(new).encode()))
            finally:
                stream.close()
            try:
                self._files.rename(draft, self._path(f"{self.path}/versions/{latest + 1:012d}.json"), as_new)
                return latest + 1
            except Py4JJavaError as e:
                self._fs.delete(draft, False)
                if "FileAlreadyExistsException" not in str(e.java_exception):
                    raise
        raise RuntimeError(f"other writers took {TRIES} versions of {self.path} in a row")

    def append(self, rows: DataFrame) -> int:
        """Add ``rows``, a stored table in the columns of the cache; merge what is due; the new version."""
        new = self._store(rows)
        version = self._commit(lambda parts: parts + new if new else None)
        return self.merge() or version

    def merge(self, everything: bool = False) -> int | None:
        """Merge MERGE or more segments of one size class into one, where the latest version of a request stays.

        Each row is thus rewritten about once per size class, a class being MERGE times the one
        below. ``everything`` merges all segments. None if nothing is due.
        """
        done = None
        while True:
            sizes, classes = defaultdict(int), defaultdict(list)
            parts = self.parts()[1]
            for p in parts:
                sizes[p.segment] += p.n
            for segment, n in sizes.items():
                size_class = 0
                while n >= FILE_ROWS / 100 * MERGE ** (size_class + 1):
                    size_class += 1
                classes[0 if everything else size_class].append(segment)
            due = next((set(s) for s in classes.values() if len(s) >= (2 if everything else MERGE)), None)
            if due is None:
                return done
            old = self._rows([p for p in parts if p.segment in due])
            newest = save_table(newest_versions(old), "newest")
            new = self._store(save_table(join_to_unique(old, newest, ["request_key", "version"], weight="n"), "merged"))

            def swap(parts: list[Part]) -> list[Part] | None:
                if not due <= {p.segment for p in parts}:
                    return None  # another writer merged some of them
                return [p for p in parts if p.segment not in due] + new

            done = self._commit(swap)

    def clear(self) -> int:
        """Make the next version an empty one."""
        return self._commit(lambda parts: [])

    def remove_old(self, keep: int = 1, older_than: float = 86_400) -> tuple[int, int]:
        """Delete all but the last ``keep`` versions, and segments that none of those lists.

        Only what was written more than ``older_than`` seconds ago goes, so that running readers
        and writers are spared. Returns the numbers of versions and segments deleted.
        """
        if keep < 1:
            raise ValueError("the latest version stays")
        limit = (time.time() - older_than) * 1000
        versions = self.versions()
        stay = versions[-keep:]
        old = [
            s for s in self._listed("versions")
            if s.getPath().getName() not in {f"{v:012d}.json" for v in stay} and s.getModificationTime() <= limit
        ]
        n_versions = sum(s.getPath().getName().endswith(".json") for s in old)
        for s in old:
            self._fs.delete(s.getPath(), False)
        used = {p.segment for v in self.versions() for p in self.parts(v)[1]}
        idle = [s for s in self._listed("data") if s.getPath().getName() not in used and s.getModificationTime() <= limit]
        for s in idle:
            self._fs.delete(s.getPath(), True)
        return n_versions, len(idle)


def any_between(ordered: list[str], low: str, high: str) -> bool:
    from bisect import bisect_left

    at = bisect_left(ordered, low)
    return at < len(ordered) and ordered[at] <= high
