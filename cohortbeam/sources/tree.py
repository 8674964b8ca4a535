"""Listing of very large file trees by tasks, as a batch and a streaming source.

``spark.read.format("file_tree")``: the driver names folders down to ``levels``
levels below the root and never holds their files; every folder is listed in a
task, with all that is below the last level. Rows are those of ``binaryFile``:
path, modificationTime, length and, on request, content.

As a stream, a micro-batch holds the files modified since the one before.
Offsets are times, so neither the driver nor the checkpoint keeps a list of
files already seen, however many there are. ``settle`` seconds must cover the
time between the last write to a file and its appearance under its name.

Options: ``pattern`` (file name globs, comma-separated), ``levels`` (1),
``tasks`` (at most, 1024), ``content`` (false), ``settle`` (0).
"""
from __future__ import annotations

import fnmatch
import os
import time
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..operators.file_scoring import FileReader, file_reader

LISTED = 4096  # files a record batch holds at most
CONTENTS = 64  # files with their contents a record batch holds at most


def _hidden(name: str) -> bool:
    """Names that Spark's own file sources pass over."""
    return name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_")


def _folders(reader, path: str) -> Iterator[str]:
    """Names of the folders in a folder."""
    from pyarrow import fs as pafs
    system, base = reader.find(path)
    if isinstance(system, pafs.LocalFileSystem):  # entry by entry, files are not kept
        with os.scandir(base) as entries:
            yield from (e.name for e in entries if e.is_dir())
    else:
        yield from (i.base_name for i in system.get_file_info(pafs.FileSelector(base)) if i.type == pafs.FileType.Directory)


class Folders(InputPartition):
    """Folders to list: (path, with all below), and the times of a micro-batch."""

    def __init__(self, folders: list[tuple[str, bool]], since: int | None = None, until: int | None = None):
        super().__init__(0)
        self.folders, self.since, self.until = folders, since, until


class _Tree:
    def __init__(self, options):
        self.files = FileReader(options.get("default", "file:"))
        self.root = options["path"].rstrip("/")
        if self.root.startswith("/"):
            self.root = self.files.default + self.root
        elif self.root.startswith("file:"):
            self.root = "file:/" + self.root[len("file:"):].lstrip("/")
        self.patterns = [p.strip() for p in options.get("pattern", "*").split(",")]
        self.levels, self.tasks = int(options.get("levels", 1)), int(options.get("tasks", 1024))
        self.content = options.get("content", "false").lower() == "true"
        self.settle = int(float(options.get("settle", 0)) * 1e6)

    def split(self, since: int | None = None, until: int | None = None) -> list[Folders]:
        found, level = [], [self.root]
        for _ in range(self.levels):
            found += [(p, False) for p in level]
            level = [f"{p}/{name}" for p in level for name in _folders(self.files, p) if not _hidden(name)]
        found += [(p, True) for p in level]
        n = max(1, min(self.tasks, len(found)))
        return [Folders(found[i::n], since, until) for i in range(n)]

    def read(self, part: Folders) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs as pafs
        rows: list[tuple] = []
        size = CONTENTS if self.content else LISTED
        todo = list(reversed(part.folders))
        while todo:
            folder, deep = todo.pop()
            system, base = self.files.find(folder)
            for info in sorted(system.get_file_info(pafs.FileSelector(base)), key=lambda i: i.base_name):
                if _hidden(info.base_name):
                    continue
                if info.type == pafs.FileType.Directory:
                    if deep:
                        todo.append((f"{folder}/{info.base_name}", True))
                    continue
                at = info.mtime_ns // 1000
                if info.type != pafs.FileType.File or not any(fnmatch.fnmatchcase(info.base_name, p) for p in self.patterns) or (
                        part.until is not None and not part.since <= at < part.until):
                    continue
                content = (system.open_input_stream(info.path).read(),) if self.content else ()
                rows.append((folder + info.path[len(base):], at // 1000 * 1000, info.size, *content))
                if len(rows) == size:
                    yield self._batch(rows)
                    rows = []
        if rows:
            yield self._batch(rows)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        kinds = [("path", pa.string()), ("modificationTime", pa.timestamp("us", "UTC")), ("length", pa.int64()), ("content", pa.binary())]
        kinds = kinds[:len(rows[0])]
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, (_, t) in zip(zip(*rows), kinds)], names=[n for n, _ in kinds])


class TreeReader(_Tree, DataSourceReader):
    def partitions(self):
        return self.split()


class TreeStreamReader(_Tree, DataSourceStreamReader):
    def initialOffset(self):
        return {"until": 0}

    def latestOffset(self):
        return {"until": time.time_ns() // 1000 - self.settle}

    def partitions(self, start, end):
        return self.split(start["until"], end["until"])

    def commit(self, end):
        pass


class FileTree(DataSource):
    @classmethod
    def name(cls):
        return "file_tree"

    def schema(self):
        more = ", content binary" if self.options.get("content", "false").lower() == "true" else ""
        return f"path string, modificationTime timestamp, length bigint{more}"

    def reader(self, schema):
        return TreeReader(self.options)

    def streamReader(self, schema):
        return TreeStreamReader(self.options)


def _source(spark: SparkSession, reader, options: dict):
    spark.dataSource.register(FileTree)
    for k, v in {"default": file_reader(spark).default, **options}.items():
        reader = reader.option(k, str(v).lower() if isinstance(v, bool) else str(v))
    return reader.format("file_tree")


def tree_files(spark: SparkSession, root: str, pattern: str = "*.png", **options) -> DataFrame:
    """All matching files below ``root``, listed in tasks."""
    return _source(spark, spark.read, {"pattern": pattern, **options}).load(root)


def tree_stream(spark: SparkSession, root: str, pattern: str = "*.png", **options) -> DataFrame:
    """The same as a stream: each micro-batch holds the files modified since the
    one before."""
    return _source(spark, spark.readStream, {"pattern": pattern, **options}).load(root)
