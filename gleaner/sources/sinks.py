"""Ordered files of any size, and sets of them that appear together or not at all.

A sorted table becomes one CSV without passing through one task: its sorted partitions are packed to blocks of text that
know where in their partition they begin, a row a partition comes back to the driver for the prefix sums, and every task
then writes its blocks at their places in one file beside the target. The data source's commit checks the length and
renames; its abort removes. A retried task writes the same bytes at the same places. The target is in a folder that the
driver and all executors mount; on other stores a table stays a folder of sorted parts (``manifests.write_manifest``).
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import ArrayType, BooleanType, MapType, StructType

from gleaner.workspace import Workspace

BLOCK = 1 << 20


@dataclass
class Written(WriterCommitMessage):
    size: int


class FileWriter(DataSourceArrowWriter):
    """Rows (at, block) of bytes go to their places; ``size`` is what all have together."""

    def __init__(self, path: str, size: int):
        self.path, self.size, self.part = path, size, path + ".part"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        done, file = 0, os.open(self.part, os.O_WRONLY | os.O_CREAT, 0o644)
        try:
            for b in iterator:
                for at, block in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    data = memoryview(block.as_buffer())
                    done += len(data)
                    while len(data):
                        n = os.pwrite(file, data, at)
                        at, data = at + n, data[n:]
        finally:
            os.close(file)
        return Written(done)

    def commit(self, messages: list) -> None:
        if sum(m.size for m in messages if m) != self.size or os.path.getsize(self.part) != self.size:
            raise OSError(f"{self.part} is not whole")
        os.replace(self.part, self.path)

    def abort(self, messages: list) -> None:
        Path(self.part).unlink(missing_ok=True)


class FileSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "gleaner_file"

    def schema(self) -> str:
        return "at long, block binary"

    def writer(self, schema: StructType, overwrite: bool) -> FileWriter:
        return FileWriter(self.options["path"], int(self.options["size"]))


def _mounted(path: str | Path) -> str:
    p = str(path).removeprefix("file://").replace("file:/", "/")
    if "://" in p:
        raise ValueError(f"{path}: one file needs a folder that the driver and all executors mount")
    return os.path.abspath(p)


def _cell(df: DataFrame, name: str) -> Column:
    kind, c = df.schema[name].dataType, F.col(f"`{name}`")
    if isinstance(kind, BooleanType):
        return F.when(c, "True").when(~c, "False").alias(name)
    return F.to_json(c).alias(name) if isinstance(kind, (ArrayType, MapType, StructType)) else c


def write_ordered(df: DataFrame, path: str | Path, order: list[str | Column]) -> None:
    """One CSV with a header, sorted by ``order``; a header alone for no rows. Booleans are True and False, nested values JSON."""
    path = _mounted(path)
    spark, work = df.sparkSession, Workspace(df.sparkSession, "file")
    csv = {"escape": '"', "emptyValue": "", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    lines = df.orderBy(*order).select(F.to_csv(F.struct(*(_cell(df, c) for c in df.columns)), csv).alias("line"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, at, held, size = TaskContext.get().partitionId(), 0, [], 0

        def block():
            data = b"".join(held)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([at], pa.int64()), pa.array([data], pa.binary())], ["part", "start", "block"])

        for b in batches:
            for line in b.column(0).to_pylist():
                held.append(line.encode() + b"\n")
                size += len(held[-1])
                if size >= BLOCK:
                    yield block()
                    at, held, size = at + size, [], 0
        if held:
            yield block()

    head = (",".join(f'"{c.replace(chr(34), chr(34) * 2)}"' if set(c) & set(',"\n') else c for c in df.columns) + "\n").encode()
    blocks = work.stash(lines.mapInArrow(packed, "part int, start long, block binary"), "blocks")
    sizes = {r["part"]: r["n"] for r in blocks.groupBy("part").agg(F.sum(F.octet_length("block")).alias("n")).collect()}  # a row a partition
    each = [sizes.get(p, 0) for p in range(max(sizes, default=-1) + 1)]
    begin = list(accumulate(each, initial=len(head)))
    base = spark.createDataFrame([(p, b) for p, b in enumerate(begin[:-1])], "part int, base long")
    placed = blocks.join(base, "part").select((F.col("base") + F.col("start")).alias("at"), "block")
    top = spark.createDataFrame([(0, bytearray(head))], "at long, block binary")
    os.makedirs(os.path.dirname(path), exist_ok=True)
    spark.dataSource.register(FileSink)
    Path(path + ".part").unlink(missing_ok=True)
    top.unionByName(placed).write.format("gleaner_file").mode("append").option("path", path).option("size", begin[-1]).save()
    work.close()


def write_set(spark: SparkSession, folder: str | Path, tables: dict[str, tuple[DataFrame, list]], documents: dict[str, dict | str] | None = None) -> list[str]:
    """Files by name: ``tables`` as ordered CSVs, ``documents`` as JSON or text. All are written before the first one appears."""
    folder = _mounted(folder)
    staged = f"{folder}/.staged-{uuid.uuid4().hex}"
    os.makedirs(staged)
    try:
        for name, (df, order) in tables.items():
            write_ordered(df, f"{staged}/{name}", order)
        for name, what in (documents or {}).items():
            os.makedirs(os.path.dirname(f"{staged}/{name}"), exist_ok=True)
            Path(f"{staged}/{name}").write_text(what if isinstance(what, str) else json.dumps(what, indent=2, default=str) + "\n", encoding="utf-8")
        names = [*tables, *(documents or {})]
        for name in names:
            os.makedirs(os.path.dirname(f"{folder}/{name}"), exist_ok=True)
            os.replace(f"{staged}/{name}", f"{folder}/{name}")
        return names
    finally:
        for top, folders, files in os.walk(staged, topdown=False):
            for f in files:
                os.unlink(f"{top}/{f}")
            os.rmdir(top)
