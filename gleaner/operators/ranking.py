"""Ranks over a total order without gathering the rows, or a group, in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.workspace import Workspace, shuffle_width

_LOCAL = (1 << 33) - 1


def global_rank(df: DataFrame, order: list[str], name: str = "rank") -> DataFrame:
    """0-based rank by ``order``, whose values should be unique: range-partitioned sort plus one offset a partition."""
    spark = df.sparkSession
    work = Workspace(spark, "rank")
    ranged = df.repartitionByRange(shuffle_width(spark), *order).sortWithinPartitions(*order)
    placed = work.stash(ranged.withColumn("_id", F.monotonically_increasing_id()), "placed")
    part = F.shiftright("_id", 33).cast("int")
    sizes = {r["p"]: r["count"] for r in placed.groupBy(part.alias("p")).count().collect()}  # a row a partition
    offsets, run = [], 0
    for p in range(max(sizes, default=-1) + 1):
        offsets.append(run)
        run += sizes.get(p, 0)
    base = F.get(F.array(*(F.lit(o).cast("long") for o in offsets or [0])), part)
    return placed.withColumn(name, F.col("_id").bitwiseAND(F.lit(_LOCAL)) + base).drop("_id")


def rank_within(df: DataFrame, groups: list[str], order: list[str], name: str = "rank") -> DataFrame:
    """0-based rank inside each group, with ``group_size``; a group may span many tasks."""
    ranked = global_rank(df, [*groups, *order], "_rank")
    first = ranked.groupBy(*groups).agg(F.min("_rank").alias("_first"), F.count("*").alias("group_size"))
    return ranked.join(first, groups).withColumn(name, F.col("_rank") - F.col("_first")).drop("_rank", "_first")
