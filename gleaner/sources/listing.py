"""A data source that lists a tree with its directories, empty ones too, which Spark's file sources leave out.

``spark.read.format("gleaner_tree").load(root)`` after ``register(spark)``. The driver lists the first two levels, which
are the folders of splits and classes; each folder at the second level is a partition that lists what is below it. Stores
are those of ``pyarrow.fs`` (local paths, file:, s3:, gs:, hdfs:).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "relative_path string, is_directory boolean, size long"
ROWS = 10_000


def _store(root: str):
    from pyarrow import fs

    if "://" in root or root.startswith("file:"):
        return fs.FileSystem.from_uri(root.replace("file:/", "file:///") if root.startswith("file:/") and not root.startswith("file://") else root)
    return fs.LocalFileSystem(), root


@dataclass
class Folder(InputPartition):
    path: str
    recursive: bool


class TreeReader(DataSourceReader):
    def __init__(self, root: str):
        self.root = root

    def _list(self, path: str, recursive: bool) -> list:
        from pyarrow import fs

        return _store(self.root)[0].get_file_info(fs.FileSelector(path, recursive=recursive))

    def partitions(self) -> list[Folder]:
        from pyarrow import fs

        store, top = _store(self.root)
        if store.get_file_info(top).type != fs.FileType.Directory:
            raise FileNotFoundError(f"no folder {self.root}")
        folders = lambda path: [x.path for x in self._list(path, False) if x.type == fs.FileType.Directory]
        first = folders(top)
        return [Folder(top, False), *(Folder(p, False) for p in first), *(Folder(q, True) for p in first for q in folders(p))]

    def read(self, partition: Folder) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        top = _store(self.root)[1].rstrip("/")
        found = self._list(partition.path, partition.recursive)
        for i in range(0, len(found), ROWS):
            part = found[i : i + ROWS]
            yield pa.RecordBatch.from_arrays([
                pa.array([x.path[len(top) + 1 :] for x in part], pa.string()), pa.array([x.type == fs.FileType.Directory for x in part], pa.bool_()),
                pa.array([x.size for x in part], pa.int64())], ["relative_path", "is_directory", "size"])


class TreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "gleaner_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TreeSource)


def list_tree(spark: SparkSession, root: str) -> DataFrame:
    """relative_path, is_directory, size of everything below ``root``."""
    register(spark)
    return spark.read.format("gleaner_tree").load(root)
