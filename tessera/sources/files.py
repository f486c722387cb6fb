"""Directory trees as a Spark data source, and as a listing DataFrame."""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tessera.errors import FolderNotFound
from tessera.schemas import LISTING


class _Subtree(InputPartition):
    def __init__(self, directory: str, deep: bool):
        super().__init__(directory)
        self.directory, self.deep = directory, deep


class ListingReader(DataSourceReader):
    """One partition for the root's own entries and one for each of its directories."""

    def __init__(self, root: str):
        self.root = os.path.abspath(root)

    def partitions(self) -> list[InputPartition]:
        if not os.path.isdir(self.root):
            raise FolderNotFound(self.root)
        below = [e.name for e in os.scandir(self.root) if e.is_dir(follow_symlinks=False)]
        return [_Subtree("", False), *(_Subtree(d, True) for d in sorted(below))]

    def read(self, partition: _Subtree) -> Iterator[tuple]:
        todo = [partition.directory]
        while todo:
            here = todo.pop()
            try:
                entries = sorted(os.scandir(os.path.join(self.root, here)), key=lambda e: e.name)
            except OSError:
                continue
            for entry in entries:
                path = f"{here}/{entry.name}" if here else entry.name
                is_dir = entry.is_dir()
                try:
                    info = entry.stat()
                    present, size, mtime = True, None if stat.S_ISDIR(info.st_mode) else info.st_size, datetime.fromtimestamp(info.st_mtime, timezone.utc)
                except OSError:  # a link to nothing
                    present, size, mtime = False, None, None
                readable = os.access(entry.path, os.R_OK | os.X_OK) if is_dir else True
                yield self.root, path, is_dir, size, mtime, readable, present
                if partition.deep and entry.is_dir(follow_symlinks=False):
                    todo.append(path)


class ListingSource(DataSource):
    """spark.read.format("tessera_listing").load(root): one row for every file and directory below root."""

    @classmethod
    def name(cls) -> str:
        return "tessera_listing"

    def schema(self):
        return LISTING

    def reader(self, schema) -> ListingReader:
        return ListingReader(self.options["path"])


def list_tree(spark: SparkSession, root: str) -> DataFrame:
    """The tree below root, on a file system that driver and executors share; raises FolderNotFound."""
    if not root or not os.path.isdir(root):
        raise FolderNotFound(root)
    spark.dataSource.register(ListingSource)
    return spark.read.format("tessera_listing").load(root)


def list_store(spark: SparkSession, path: str) -> DataFrame:
    """(path, size_bytes, mtime) of the files of any store that Spark reads; contents aren't read, and names that begin with . or _ are skipped."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.selectExpr("path", "length AS size_bytes", "modificationTime AS mtime")
