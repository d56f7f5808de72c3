"""A dataset tree <root>/<split>/<class>/<file>: structure audit, image metadata, strict scan.

``binaryFile`` lists the tree; content is read only where it is selected. Directories, empty ones too, come from the tree
source of ``gleaner.sources.listing``.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.dims import dim
from gleaner.functions.scalar import IMAGE_GLOB, extension
from gleaner.operators.imagetable import inspected
from gleaner.sources.listing import list_tree


class DatasetAuditError(RuntimeError):
    pass


class PreprocessingError(RuntimeError):
    pass


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """path, relative_path, depth, split, class, extension, file_size_bytes of every file, without reading content."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
    return path_columns(raw.select("path", _relative(root).alias("relative_path"), F.col("length").alias("file_size_bytes")))


def path_columns(files: DataFrame) -> DataFrame:
    """Adds depth, split, class and extension of ``relative_path``."""
    parts = F.split("relative_path", "/")
    return files.withColumns({
        "depth": F.size(parts), "split": F.when(F.size(parts) > 1, F.get(parts, F.lit(0))), "class": F.when(F.size(parts) > 2, F.get(parts, F.lit(1))),
        "extension": extension(F.col("relative_path"))})


def structure_anomalies(files: DataFrame, splits: list[str], classes: list[str], directories: DataFrame | None = None) -> DataFrame:
    """kind, name, n: missing and unexpected names, stray files, nested directories (n: files below).

    ``directories`` (relative_path) makes empty ones count: an empty class folder is there, an empty split misses its classes."""
    spark = files.sparkSession
    seen = files.select("split", "class", "depth")
    folders = path_columns(directories.select("relative_path")) if directories is not None else None
    if folders is not None:  # a folder is as good as a file in it
        name = F.split("relative_path", "/")
        seen = seen.unionByName(folders.select(F.get(name, F.lit(0)).alias("split"), F.get(name, F.lit(1)).alias("class"), (F.col("depth") + 1).alias("depth")))
    seen = seen.distinct()
    want_s = dim(spark, splits, "split").select("split")
    have_s = seen.filter("split is not null").select("split").distinct()
    known = have_s.join(want_s, "split")
    pairs = known.crossJoin(dim(spark, classes, "class").select("class"))
    have = seen.filter("class is not null").join(known, "split").select("split", "class").distinct()
    one = F.lit(1).cast("long").alias("n")
    name = F.concat_ws("/", "split", "class").alias("name")
    nested = files.filter("depth > 3").select("relative_path", "split", F.lit(1).alias("files"))
    if folders is not None:
        nested = nested.unionByName(folders.filter("depth = 3").select(F.concat("relative_path", F.lit("/")).alias("relative_path"), "split", F.lit(0).alias("files")))
    folder = F.array_join(F.slice(F.split("relative_path", "/"), 1, 3), "/")
    parts = [
        want_s.join(have_s, "split", "left_anti").select(F.lit("missing_split").alias("kind"), F.col("split").alias("name"), one),
        pairs.join(have, ["split", "class"], "left_anti").select(F.lit("missing_class").alias("kind"), name, one),
        have.join(pairs, ["split", "class"], "left_anti").select(F.lit("unexpected_class").alias("kind"), name, one),
        files.filter((F.col("depth") == 1) & (F.col("relative_path") != ".gitkeep")).select(F.lit("root_file").alias("kind"), F.col("relative_path").alias("name"), one),
        files.filter("depth = 2").join(known, "split").select(F.lit("file_in_split").alias("kind"), F.col("relative_path").alias("name"), one),
        nested.join(known, "split").groupBy(folder.alias("name")).agg(F.sum("files").alias("n")).select(F.lit("nested_directory").alias("kind"), "name", "n")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def image_metadata(spark: SparkSession, root: str) -> DataFrame:
    """One row for each image file in a class folder, in one scan of the tree; broken files are rows with valid = false and the
    reason in ``error``."""
    files = _image_files(spark, root).select("relative_path", "split", "class", "extension", "file_size_bytes", F.sha2("content", 256).alias("sha256"), "content")
    seen = inspected(files)
    return seen.select("relative_path", "split", "class", "extension", "width", "height", "mode", "channels", "format", "file_size_bytes", "sha256", F.col("error").isNull().alias("valid"), "error")


def _image_files(spark: SparkSession, root: str) -> DataFrame:
    """Image files in class folders with their content; other files' content is not read."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", IMAGE_GLOB).load(root)
    return path_columns(raw.select("content", _relative(root).alias("relative_path"), F.col("length").alias("file_size_bytes"))).filter("depth = 3")


def _relative(root: str) -> Column:
    """``path`` below the root, which stands in it without its scheme."""
    return F.regexp_extract("path", f"/{re.escape(re.sub('^[a-z0-9]+:/*', '', root).strip('/'))}/(.*)$", 1)


def tree(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(files, directories) of a listing that includes empty directories."""
    found = list_tree(spark, root)
    files = path_columns(found.filter("not is_directory").select("relative_path", F.col("size").alias("file_size_bytes")))
    return files, found.filter("is_directory").select("relative_path")


def strict_scan(spark: SparkSession, root: str, splits: list[str], classes: list[str]) -> DataFrame:
    """Hashed image rows of a tree in which every declared split and class must exist."""
    files, folders = tree(spark, root)
    missing = structure_anomalies(files, splits, classes, folders).filter(F.col("kind").isin("missing_split", "missing_class")).select("name").limit(20).collect()
    if missing:
        raise PreprocessingError("missing: " + ", ".join(sorted(r.name for r in missing)))
    rows = _image_files(spark, root).filter(F.col("split").isin(splits) & F.col("class").isin(classes))
    return rows.select("relative_path", "split", "class", F.sha2("content", 256).alias("sha256"), F.lit(True).alias("valid"))


def discover(spark: SparkSession, root: str, splits: list[str], classes: list[str]) -> DataFrame:
    files, folders = tree(spark, root)
    if files.select("split").unionByName(folders.select(F.col("relative_path").alias("split"))).filter(F.col("split").isin(splits)).isEmpty():
        raise DatasetAuditError(f"no expected split under {root}")
    return structure_anomalies(files, splits, classes, folders)
