"""Writer of single files from a table: a Spark data source with task and job commit.

Rows are (dest, source, content): ``dest`` is a path below the target folder, filled with the
bytes of the file ``source`` or, where that is null, with the text ``content`` in UTF-8.
Target and sources can lie on any file system that pyarrow opens by its address.
"""

from __future__ import annotations

import os
import re
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

FORMAT = "framesift_files"
SCHEMA = "dest string, source string, content string"
COPY_BYTES = 1 << 20  # held at a time while a file is copied


def open_place(address: str):
    """(file system, path on it) of an address or a plain path."""
    from pyarrow import fs

    local = re.sub("^file:/+", "/", address)
    if "://" not in local:
        return fs.LocalFileSystem(), os.path.abspath(local)
    return fs.FileSystem.from_uri(address)


def checked(dest: str | None) -> str:
    """``dest``, if it stays below the target folder."""
    parts = (dest or "").split("/")
    if not all(parts) or "." in parts or ".." in parts or "\0" in (dest or ""):
        raise ValueError(f"not a path below the target folder: {dest!r}")
    return dest


@dataclass
class Written(WriterCommitMessage):
    n_files: int


class FileWriter(DataSourceWriter):
    """A task fills files in a folder of its attempt and moves them to their places when all are whole.

    So a lost or repeated task leaves no part of a file, and two attempts leave the same ones. Files of
    finished tasks stay if the job fails; running it again replaces them. Commit and abort of the
    job drop the attempt folders; the folder holds the files of the table and no marker.
    """

    def __init__(self, folder: str):
        self.folder = folder.rstrip("/")
        self.run = f"_parts-{uuid.uuid4().hex}"

    def write(self, rows: Iterator) -> Written:
        from pyspark import TaskContext

        fs, root = open_place(self.folder)
        task = TaskContext.get()
        part = f"{root}/{self.run}/{task.partitionId()}-{task.taskAttemptId()}"
        names: dict[str, None] = {}
        for dest, source, content in rows:
            names[checked(dest)] = None
            self.fill(fs, f"{part}/{dest}", source, content)
        folders = {os.path.dirname(f"{root}/{dest}") for dest in names}
        for folder in folders:
            fs.create_dir(folder, recursive=True)
        for dest in names:
            fs.move(f"{part}/{dest}", f"{root}/{dest}")
        return Written(len(names))

    @staticmethod
    def fill(fs, place: str, source: str | None, content: str | None) -> None:
        fs.create_dir(os.path.dirname(place), recursive=True)
        if source is None:
            with fs.open_output_stream(place) as out:
                out.write((content or "").encode("utf-8"))
            return
        where, path = open_place(source)
        if fs.type_name == where.type_name == "local":
            shutil.copy2(path, place)  # keeps the times, too
            return
        with where.open_input_stream(path) as data, fs.open_output_stream(place) as out:
            shutil.copyfileobj(data, out, COPY_BYTES)

    def commit(self, messages: list) -> None:
        fs, root = self.drop_parts()
        fs.create_dir(root, recursive=True)  # also of an empty table

    def abort(self, messages: list) -> None:
        self.drop_parts()

    def drop_parts(self):
        from pyarrow.fs import FileType

        fs, root = open_place(self.folder)
        if fs.get_file_info(f"{root}/{self.run}").type == FileType.Directory:
            fs.delete_dir(f"{root}/{self.run}")
        return fs, root


class FileSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> FileWriter:
        return FileWriter(self.options["path"])


def write_files(files: DataFrame, folder: str) -> None:
    """Write rows with ``dest`` and ``source`` or ``content`` below ``folder``; see ``FileWriter``."""
    columns = [F.col(c) if c in files.columns else F.lit(None).cast("string").alias(c) for c in ("dest", "source", "content")]
    files.sparkSession.dataSource.register(FileSink)
    files.select(*columns).write.format(FORMAT).mode("append").save(folder)
