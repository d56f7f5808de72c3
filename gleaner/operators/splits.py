"""Deterministic stratified splits, leakage checks and batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.operators.ranking import global_rank, rank_within


def stratified_split(rows: DataFrame, fraction: float, seed: int, key: str = "relative_path") -> DataFrame:
    """``processed_split``: of each class the first round(n * fraction) rows by md5(seed, key) are validation.

    Counts are exact and membership depends on the keys and the seed only, not on partitions.
    """
    mixed = rows.withColumn("_order", F.md5(F.concat(F.lit(f"{seed}|"), F.col(key))))
    ranked = rank_within(mixed, ["class"], ["_order", key], "_place")
    return ranked.withColumn("processed_split", F.when(F.col("_place") < F.bround(F.col("group_size") * fraction), "validation").otherwise("train")).drop("_order", "_place", "group_size")


def leakage(train: DataFrame, validation: DataFrame, test: DataFrame, examples: int = 3) -> DataFrame:
    """check, n_hashes and up to ``examples`` smallest hashes, for the checks that found any."""
    t, v, s = (x.select("sha256").distinct() for x in (train, validation, test))

    def found(shared: DataFrame, name: str) -> DataFrame:
        few = F.array_sort(F.collect_list("sha256"))
        total = shared.agg(F.count("*").alias("n_hashes"))
        some = shared.orderBy("sha256").limit(examples).agg(few.alias("e"))
        return total.crossJoin(some).filter("n_hashes > 0").select(F.lit(name).alias("check"), "n_hashes", F.array_join("e", ", ").alias("examples"))

    return found(t.intersect(v), "train/validation").unionByName(found(t.union(v).distinct().intersect(s), "processed/testing"))


def batches(rows: DataFrame, order: list[str], size: int) -> DataFrame:
    """``batch``: consecutive rows; the last batch may be short."""
    return global_rank(rows, order, "_place").withColumn("batch", F.floor(F.col("_place") / size).cast("long")).drop("_place")


def shuffled(rows: DataFrame, seed: int, epoch: int, key: str) -> DataFrame:
    """A new order each epoch that the seed fixes."""
    return rows.orderBy(F.md5(F.concat(F.lit(f"{seed}|{epoch}|"), F.col(key).cast("string"))), key)
