"""CSV manifests and tables with explicit schemas, read and written."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from gleaner.workspace import Workspace


def read_strings(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """All columns as text, as a manifest reader sees them."""
    return spark.read.csv(path, header=True, schema=StructType([StructField(c, StringType()) for c in columns]))


def read_rows(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """As ``read_strings``, with ``position``: the row's place in the order of the files' names and lines, from 0.

    A split of a file counts its lines from where it begins; the lines before it are one prefix sum over the splits. A
    record is one line. The columns are those of the header, in any order; all files must have the same one.
    """
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))

    def numbered(batches):
        at, n = None, 0
        for b in batches:
            places = []
            for here in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                at, n = here, n + 1 if here == at else 0
                places.append(n)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(places, pa.int64())], ["value", "file", "block", "line"])

    lines = Workspace(spark, "rows").stash(raw.mapInArrow(numbered, "value string, file string, block long, line long"), "lines")
    first = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)  # a row a split
    held = lines.groupBy("file", "block").agg(F.count("*").alias("n"))
    before = held.withColumn("before", F.coalesce(F.sum("n").over(first), F.lit(0))).withColumn("files", F.dense_rank().over(Window.orderBy("file"))).drop("n")
    header = lines.filter("line = 0 and block = 0").groupBy("value").count().limit(2).collect()
    if len(header) > 1:
        raise ValueError(f"{path}: files with different headers")
    names = [c.strip('"') for c in header[0]["value"].lstrip("\ufeff").split(",")] if header else columns
    missing = [c for c in columns if c not in names]
    if missing:
        raise ValueError(f"{path} has no column {', '.join(missing)}")
    rows = lines.filter("not (line = 0 and block = 0)").join(before, ["file", "block"])
    cells = F.from_csv("value", ", ".join(f"`{n}` string" for n in names), {"escape": '"'})
    return rows.select(cells.alias("x"), (F.col("before") + F.col("line") - F.col("files")).alias("position")).select(*(F.col(f"x.`{c}`").alias(c) for c in columns), "position")


def read_table(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema)


def load_manifest(rows: DataFrame, root: str) -> DataFrame:
    """(path, label_id) of rows with a path; ``require_rows`` is the check for none."""
    p = F.trim("relative_path")
    return rows.filter(p != "").select(F.concat_ws("/", F.lit(root.rstrip("/")), p).alias("path"), F.col("label_id").cast("int").alias("label_id"))


def require_rows(rows: DataFrame, what: str) -> DataFrame:
    if rows.isEmpty():
        raise ValueError(f"{what} has no rows")
    return rows


def write_csv(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    """One CSV file with a header, also for no rows; for reports, whose size is bounded by groups and classes."""
    one = (df.orderBy(*order) if order else df).coalesce(1)
    seen = Observation()
    one.observe(seen, F.count("*").alias("n")).write.mode("overwrite").csv(path, header=True)
    if not seen.get["n"]:
        header = df.sparkSession.createDataFrame([(",".join(df.columns),)], "value string")
        header.coalesce(1).write.mode("overwrite").text(path)


def write_manifest(rows: DataFrame, path: str, split: str) -> None:
    """Manifests are as large as the data: sorted by range, one file a partition, each with a header."""
    rows.withColumn("processed_split", F.lit(split)).orderBy("relative_path").write.mode("overwrite").csv(path, header=True)


def redundant_paths(spark: SparkSession, path: str) -> DataFrame:
    """Redundant copies named in a duplicates CSV; a missing file is an empty set."""
    from pyspark.errors import AnalysisException

    from gleaner.operators.duplicates import redundant
    from gleaner.schemas import TEST_DUPLICATES

    try:
        return redundant(read_strings(spark, path, TEST_DUPLICATES.fieldNames()))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "relative_path string")
