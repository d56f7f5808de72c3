"""Declared dimensions: names in reference order, with extras sorted after them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def dim(spark: SparkSession, names: list[str], column: str = "name") -> DataFrame:
    """(name, ordinal): a literal table of the declared names."""
    return spark.createDataFrame(list(enumerate(names)), f"ordinal int, {column} string").select(column, "ordinal")


def ordinal(column: Column, names: list[str]) -> Column:
    """Position of a name in the declared order; undeclared names come after all declared ones."""
    at = F.array_position(F.array(*(F.lit(n) for n in names)), column)
    return F.when(at > 0, at - 1).otherwise(F.lit(len(names))).cast("int")


def label_id(column: Column, names: list[str]) -> Column:
    at = F.array_position(F.array(*(F.lit(n) for n in names)), column)
    return F.when(at > 0, (at - 1).cast("int"))


def label_name(ids: Column, names: list[str]) -> Column:
    """Name of an id; an unknown id is its own text."""
    known = F.get(F.array(*(F.lit(n) for n in names)), ids)
    return F.coalesce(known, ids.cast("string"))
