"""A data source of files: every name counts, hidden ones too, and folders that are never scanned are never entered.

    spark.dataSource.register(FolderSource)
    spark.read.format("idlens_files").load("/repos").where("length <= 2097152 AND path LIKE '%.env'")

``root`` may be any address that pyarrow's file systems know (local paths, ``file:``, ``hdfs:``, ``s3:``, ``gs:``). The
driver lists only as many folders as there are to be partitions; what lies below them is listed and read by the tasks.
Filters on path and length are pushed into the source (``spark.sql.python.filterPushdown.enabled``), so that files they
refuse are not opened.
"""

from __future__ import annotations

import fnmatch
import json
import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    StringContains,
    StringEndsWith,
    StringStartsWith,
)

NAME = "idlens_files"
SCHEMA = "path string, length long, modified timestamp, content binary"
#: Partitions that the driver's listing aims at, and bytes of contents a batch holds at most (one file more may go over).
PARTITIONS, BATCH_BYTES = 64, 8 << 20

_TESTS: dict[type, Callable] = {
    EqualTo: lambda v, x: v == x,
    LessThan: lambda v, x: v < x,
    LessThanOrEqual: lambda v, x: v <= x,
    GreaterThan: lambda v, x: v > x,
    GreaterThanOrEqual: lambda v, x: v >= x,
    In: lambda v, x: v in x,
    StringStartsWith: lambda v, x: v.startswith(x),
    StringEndsWith: lambda v, x: v.endswith(x),
    StringContains: lambda v, x: x in v,
}


@dataclass
class Part(InputPartition):
    """Whole folders (``deep``) and folders of which only the files themselves are read, relative to the root."""

    deep: list[str]
    flat: list[str]


@dataclass
class File:
    path: str
    length: int
    modified: object


class Tree:
    """Files and folders below a root, links not followed."""

    def __init__(self, root: str, pruned: list[str]):
        if "://" in root or root.startswith("file:"):
            self.fs, self.base = pafs.FileSystem.from_uri(root)
        else:
            self.fs, self.base = pafs.LocalFileSystem(), os.path.abspath(root)
        self.base = self.base.rstrip("/")
        self.local = isinstance(self.fs, pafs.LocalFileSystem)
        self.pruned = pruned

    def full(self, path: str) -> str:
        return f"{self.base}/{path}" if path else self.base

    def children(self, folder: str) -> tuple[list[File], list[str]]:
        """A folder's files and folders, in order of their names."""
        files, folders = [], []
        for i in sorted(self.fs.get_file_info(pafs.FileSelector(self.full(folder))), key=lambda i: i.base_name):
            path = f"{folder}/{i.base_name}" if folder else i.base_name
            if self.local and os.path.islink(self.full(path)):
                continue
            if i.type == pafs.FileType.Directory:
                if not any(fnmatch.fnmatchcase(i.base_name, p) for p in self.pruned):
                    folders.append(path)
            elif i.type == pafs.FileType.File:
                files.append(File(path, i.size, i.mtime))
        return files, folders

    def walk(self, folder: str) -> Iterator[File]:
        open_ = [folder]
        while open_:
            files, folders = self.children(open_.pop())
            yield from files
            open_ += reversed(folders)

    def read(self, path: str) -> bytes:
        with self.fs.open_input_stream(self.full(path)) as f:
            return f.read()


class FolderReader(DataSourceReader):
    def __init__(self, root: str, pruned: list[str], partitions: int):
        self.root, self.pruned, self.wanted = root, pruned, partitions
        self.tests: list[tuple[str, type, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = getattr(f, "attribute", ())
            if type(f) in _TESTS and tuple(column) in (("path",), ("length",)):
                self.tests.append((column[0], type(f), f.value))
            else:
                yield f

    def partitions(self) -> list[Part]:
        """Folders level by level until there are enough, then dealt out; their parents give their own files only."""
        tree = Tree(self.root, self.pruned)
        deep, flat = [""], []
        while deep and len(deep) < self.wanted:
            below = [(f, tree.children(f)[1]) for f in deep]
            if not any(folders for _, folders in below):
                break
            flat += [f for f, _ in below]
            deep = [g for _, folders in below for g in folders]
        n = max(1, min(self.wanted, len(deep) + len(flat)))
        parts = [Part([], []) for _ in range(n)]
        for i, f in enumerate(deep):
            parts[i % n].deep.append(f)
        for i, f in enumerate(flat):
            parts[-1 - i % n].flat.append(f)
        return parts

    def keeps(self, file: File) -> bool:
        return all(_TESTS[kind](file.path if column == "path" else file.length, value) for column, kind, value in self.tests)

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        tree = Tree(self.root, self.pruned)
        rows: list[tuple] = []
        held = 0
        for file in self.files(tree, partition):
            if not self.keeps(file):
                continue
            content = tree.read(file.path)
            rows.append((file.path, file.length, file.modified, content))
            held += len(content)
            if held >= BATCH_BYTES:
                yield self.batch(rows)
                rows, held = [], 0
        if rows:
            yield self.batch(rows)

    @staticmethod
    def files(tree: Tree, partition: Part) -> Iterator[File]:
        for folder in partition.flat:
            yield from tree.children(folder)[0]
        for folder in partition.deep:
            yield from tree.walk(folder)

    @staticmethod
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.timestamp("us", tz="UTC"), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows), kinds)], names=["path", "length", "modified", "content"])


class FolderSource(DataSource):
    """Options: ``path``; ``prune``, a JSON list of folder names (globs) that are not entered; ``partitions``."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FolderReader:
        return FolderReader(self.options["path"], json.loads(self.options.get("prune", "[]")), int(self.options.get("partitions", PARTITIONS)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FolderSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
