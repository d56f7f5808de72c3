"""Exact duplicates by content hash. Rows: relative_path, split, class, sha256, valid.

Groups are aggregates (partial sums before the shuffle) joined back to the rows, so a content that a third of all
rows share is split by adaptive execution and never sorted in one task, as a window over it would be. A row without
hash is a copy of nothing: it is in no group and is kept. Of rows with equal hash and path one is kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.operators.ranking import global_rank
from gleaner.workspace import fresh_name


def groups(rows: DataFrame) -> DataFrame:
    """One row for each content of two or more rows."""
    return rows.filter("sha256 is not null").groupBy("sha256").agg(
        F.count("*").alias("group_size"), F.countDistinct("split").alias("n_splits"), F.countDistinct("class").alias("n_classes"),
        F.count_if(F.col("split") == "Training").alias("training_files"), F.count_if(F.col("split") == "Testing").alias("testing_files"),
        F.min("relative_path").alias("first_path"), F.min("split").alias("first_split"),
    ).filter("group_size > 1").withColumn("group_type", F.when(F.col("n_classes") > 1, "conflicting-class").otherwise("same-class")).withColumn("crosses_splits", F.col("n_splits") > 1)


def members(rows: DataFrame, cross_split_only: bool = False) -> DataFrame:
    g = groups(rows).select("sha256", "group_size", "group_type", "crosses_splits")
    if cross_split_only:
        g = g.filter("crosses_splits")
    return rows.join(g, "sha256")


def summary(rows: DataFrame) -> DataFrame:
    """Totals over the groups; the ratio is over valid rows."""
    g = groups(rows)
    cross, conflict = F.col("crosses_splits"), F.col("n_classes") > 1
    total = lambda what: F.coalesce(F.sum(what), F.lit(0)).cast("long")
    out = g.agg(
        F.count("*").alias("duplicate_groups"), total(F.col("group_size")).alias("duplicate_files"), F.count_if(cross).alias("cross_groups"),
        total(F.when(cross, F.col("training_files"))).alias("cross_training_files"), total(F.when(cross, F.col("testing_files"))).alias("cross_testing_files"),
        F.count_if(conflict).alias("conflicting_groups"), total(F.when(conflict, F.col("group_size"))).alias("conflicting_files"),
        F.count_if(~cross & (F.col("first_split") == "Training")).alias("within_training"), F.count_if(~cross & (F.col("first_split") == "Testing")).alias("within_testing"),
        F.coalesce(F.max("group_size"), F.lit(0)).alias("largest_group"))
    valid = rows.agg(F.count_if("valid").alias("valid_files"))
    return out.crossJoin(valid).withColumn("duplicate_ratio", F.coalesce(F.try_divide(F.col("duplicate_files").cast("double"), F.col("valid_files").cast("double")), F.lit(0.0)))


def keep_first(rows: DataFrame) -> DataFrame:
    """Of each content the row with the smallest path, any one of equal paths; rows without hash as they are.

    One aggregation whose partial results are one row a content and task; any column types."""
    own = fresh_name("_own", rows.columns)
    keyed = rows.withColumn(own, F.when(F.col("sha256").isNull(), F.monotonically_increasing_id()))
    first = F.min_by(F.struct(*rows.columns), F.struct(F.col("relative_path").isNull(), F.col("relative_path"))).alias("_row")
    return keyed.groupBy("sha256", own).agg(first).select("_row.*")


def report(rows: DataFrame) -> DataFrame:
    """One row for each removed copy; a path listed n times with one content is removed n - 1 times."""
    several = rows.filter("sha256 is not null").groupBy("sha256").agg(F.min("relative_path").alias("kept_relative_path"), F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    found = rows.select("sha256", "relative_path", F.col("class").alias("label_name")).join(several, "sha256")
    kept = F.col("relative_path").eqNullSafe(F.col("kept_relative_path"))
    again = found.filter(kept).groupBy("sha256", "kept_relative_path").agg(F.count("*").alias("_n"), F.min("label_name").alias("label_name")).filter("_n > 1")
    # in two steps, so that no array grows with the count
    again = again.withColumn("_at", F.explode(F.expr("sequence(0L, (_n - 2) div 10000)"))).withColumn("_k", F.explode(F.expr("sequence(1, least(10000, _n - 1 - 10000 * _at))")))
    columns = ["sha256", "kept_relative_path", "removed_relative_path", "label_name"]
    removed = lambda df, path: df.withColumn("removed_relative_path", F.col(path)).select(*columns)
    return removed(found.filter(~kept), "relative_path").unionByName(removed(again, "kept_relative_path"))


def class_summary(rows: DataFrame) -> DataFrame:
    """By class: rows kept and removed, contents with removed copies, and the members of these."""
    kept = keep_first(rows).groupBy("class").agg(F.count("*").alias("kept"))
    gone = report(rows).groupBy(F.col("label_name").alias("class")).agg(F.count("*").alias("removed"), F.countDistinct("sha256").alias("groups"))
    number = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    both = kept.join(gone, kept["class"].eqNullSafe(gone["class"]), "full").select(F.coalesce(kept["class"], gone["class"]).alias("class"), number("kept"), number("removed"), number("groups"))
    return both.withColumn("members", F.col("groups") + F.col("removed"))


def ranked_groups(rows: DataFrame) -> DataFrame:
    """Members of groups numbered from 1 by their smallest path."""
    g = groups(rows).select("sha256", "group_size", "first_path")
    numbered = global_rank(g, ["first_path", "sha256"], "r").select("sha256", "group_size", "first_path", (F.col("r") + 1).cast("int").alias("group_id"))
    return rows.join(numbered, "sha256").select("group_id", "sha256", "relative_path", F.col("class").alias("label_name"), (F.col("relative_path") == F.col("first_path")).alias("is_representative"), "group_size")


def redundant(marked: DataFrame) -> DataFrame:
    """Paths of a duplicate table whose flag reads false, 0 or no."""
    flag = F.lower(F.trim(F.col("is_representative").cast("string")))
    return marked.filter(flag.isin("false", "0", "no")).select(F.replace("relative_path", F.lit("\\"), F.lit("/")).alias("relative_path")).distinct()


def without(rows: DataFrame, paths: DataFrame) -> DataFrame:
    return rows.join(paths.select("relative_path"), "relative_path", "left_anti")
