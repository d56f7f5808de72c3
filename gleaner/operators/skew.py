"""Equi-joins against a table of counted keys, where one key may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is hot when it holds at least 1/HOT_SHARE of all rows, so there are at most HOT_SHARE hot keys.
HOT_SHARE = 1000


def join_counted(left: DataFrame, counted: DataFrame, keys: list[str], count: str, spread: Column, how: str = "inner") -> DataFrame:
    """Join ``left`` with ``counted``: one row per key, whose ``count`` column says how many rows of ``left`` have it.

    Hot keys, at most HOT_SHARE by the pigeonhole rule, are broadcast. Their rows then go through the sort-merge join
    of the other keys under a key of their own made from ``spread``, so that they are dealt evenly and ``left`` is
    read once. ``how`` is inner or left. NULL keys match nothing. ``counted`` should be a written table: it is read twice.
    """
    total = int(counted.agg(F.sum(count)).first()[0] or 0)
    is_hot = F.col(count) * F.lit(HOT_SHARE) >= F.lit(total)
    values = [c for c in counted.columns if c not in keys]
    hot = counted.filter(is_hot).select(*keys, *(F.col(v).alias(f"_hot_{v}") for v in values))
    cold = counted.filter(~is_hot).select(*keys, *(F.col(v).alias(f"_cold_{v}") for v in values), F.lit(0).cast("long").alias("_spread"))
    found = F.col(f"_hot_{count}").isNotNull()
    x = left.join(F.broadcast(hot), keys, "left")
    x = x.withColumn("_spread", F.when(found, F.xxhash64(spread).bitwiseOR(F.lit(1))).otherwise(F.lit(0)).cast("long"))
    y = x.join(cold.hint("merge"), [*keys, "_spread"], "left")
    if how == "inner":
        y = y.filter(F.coalesce(f"_hot_{count}", f"_cold_{count}").isNotNull())
    return y.select(*left.columns, *(F.coalesce(f"_hot_{v}", f"_cold_{v}").alias(v) for v in values))
