"""Counts and distributions over split and class, zero-filled against the declared dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.dims import dim, ordinal
from gleaner.functions.scalar import expected_format, percent


def class_counts(rows: DataFrame, splits: list[str], classes: list[str]) -> DataFrame:
    """split, class, files, valid_files for every declared pair, and for undeclared ones that occur."""
    spark = rows.sparkSession
    grid = dim(spark, splits, "split").select("split").crossJoin(dim(spark, classes, "class").select("class"))
    seen = rows.groupBy("split", "class").agg(F.count("*").alias("files"), F.count_if("valid").alias("valid_files"))
    return grid.join(seen, ["split", "class"], "full").select("split", "class", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("files", "valid_files")))


def class_distribution(rows: DataFrame, splits: list[str], classes: list[str]) -> DataFrame:
    c = class_counts(rows, splits, classes).select("split", "class", "files")
    by_split = c.groupBy("split").agg(F.sum("files").alias("in_split"))
    total = c.agg(F.sum("files").alias("in_all"))
    return c.join(by_split, "split").crossJoin(total).select("split", "class", "files", percent(F.col("files"), F.col("in_split")).alias("pct_of_split"), percent(F.col("files"), F.col("in_all")).alias("pct_of_total"))


def imbalance(rows: DataFrame, classes: list[str]) -> DataFrame:
    """Largest and smallest class of valid rows; ties go to the earlier class; the ratio is NULL beside an empty class."""
    n = dim(rows.sparkSession, classes, "class").join(rows.filter("valid").groupBy("class").count(), "class", "left").select("class", "ordinal", F.coalesce("count", F.lit(0)).alias("n"))
    return n.agg(
        F.max_by("class", F.struct("n", -F.col("ordinal"))).alias("largest_class"), F.min_by("class", F.struct("n", "ordinal")).alias("smallest_class"),
        F.max("n").alias("largest"), F.min("n").alias("smallest")).withColumn("ratio", F.round(F.try_divide(F.col("largest").cast("double"), F.col("smallest").cast("double")), 3))


def histogram(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.groupBy(*columns).agg(F.count("*").alias("n"))


def dimension_stats(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.min("width").alias("min_width"), F.max("width").alias("max_width"), F.min("height").alias("min_height"), F.max("height").alias("max_height"),
        F.countDistinct("width", "height").alias("distinct_sizes"))


def top_dimensions(rows: DataFrame, first: str, k: int = 10) -> DataFrame:
    """The k most frequent sizes with their share; ties go to the size seen first by ``first``."""
    total = rows.agg(F.count("*").alias("total"))
    n = rows.groupBy("width", "height").agg(F.count("*").alias("n"), F.min(first).alias("seen"))
    return n.orderBy(F.desc("n"), "seen").limit(k).crossJoin(total).select("width", "height", "n", percent(F.col("n"), F.col("total")).alias("pct"))


def size_totals(rows: DataFrame) -> DataFrame:
    total = F.coalesce(F.sum("file_size_bytes"), F.lit(0)).cast("long")
    return rows.agg(F.count("*").alias("files"), total.alias("total_bytes"), F.round(total / 1048576.0, 2).alias("total_mb"))


#: What ``cube`` counts by, each in the same pass.
CUBE = {"class": ["split", "class"], "extension": ["extension"], "mode": ["mode"], "size": ["width", "height"], "all": []}


def cube(rows: DataFrame) -> DataFrame:
    """Every count of an audit in one scan: ``part`` (a key of CUBE), its columns (others NULL), files, valid_files,
    mismatched_files, bytes and the first valid path."""
    want = expected_format(F.col("extension"))
    odd = F.col("valid") & want.isNotNull() & ~want.eqNullSafe(F.col("format"))
    names = ["split", "class", "extension", "mode", "width", "height"]
    x = rows.select(*names, "valid", F.col("file_size_bytes").alias("bytes"), F.when(F.col("valid"), F.col("relative_path")).alias("path"), odd.alias("odd"))
    out = x.groupingSets(list(CUBE.values()), *names).agg(
        F.grouping_id().alias("id"), F.count("*").alias("files"), F.count_if("valid").alias("valid_files"), F.count_if("odd").alias("mismatched_files"), F.coalesce(F.sum("bytes"), F.lit(0)).cast("long").alias("bytes"), F.min("path").alias("first_path"))
    part = F.lit(None).cast("string")
    for name, columns in CUBE.items():  # a bit for each column that the set leaves out
        part = F.when(F.col("id") == sum(1 << (len(names) - 1 - i) for i, c in enumerate(names) if c not in columns), name).otherwise(part)
    return out.select(part.alias("part"), *names, "files", "valid_files", "mismatched_files", "bytes", "first_path")


def validity(rows: DataFrame) -> DataFrame:
    return rows.groupBy("split").agg(F.count_if("valid").alias("valid_files"), F.count_if(~F.col("valid")).alias("invalid_files"))


def format_mismatch(rows: DataFrame) -> DataFrame:
    """Valid rows whose known expected format differs from the real one."""
    want = expected_format(F.col("extension"))
    return rows.filter("valid").withColumn("expected_format", want).filter(F.col("expected_format").isNotNull() & ~F.col("expected_format").eqNullSafe(F.col("format")))


def expected_vs_found(rows: DataFrame, column: str, names: list[str]) -> DataFrame:
    """name, status: declared names that never occur are missing, others that occur are unexpected."""
    want = dim(rows.sparkSession, names).select("name")
    have = rows.select(F.col(column).alias("name")).distinct()
    return want.join(have, "name", "left_anti").withColumn("status", F.lit("missing")).unionByName(have.join(want, "name", "left_anti").withColumn("status", F.lit("unexpected")))


def first_per_class(rows: DataFrame, classes: list[str] | None = None) -> DataFrame:
    """The row with the smallest path of each class. With ``classes``, of these only and in no case without one of them: the
    result then fails with the names of those that have no row, when it is read."""
    first = rows.groupBy("class").agg(F.min_by(F.struct("relative_path", "sha256"), F.col("relative_path")).alias("x")).select("class", "x.relative_path", "x.sha256")
    if classes is None:
        return first
    want = dim(rows.sparkSession, classes, "class")
    missing = F.concat(F.lit("no rows of class "), F.col("class"))
    found = want.join(first, "class", "left")
    return found.orderBy("ordinal").select("class", F.when(F.col("relative_path").isNull(), F.raise_error(missing).cast("string")).otherwise(F.col("relative_path")).alias("relative_path"), "sha256")


def in_reference_order(rows: DataFrame, splits: list[str], classes: list[str]) -> DataFrame:
    return rows.orderBy(ordinal(F.col("split"), splits), "split", ordinal(F.col("class"), classes), "class", "relative_path")
