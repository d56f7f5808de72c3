"""The k first rows of each group by a number, largest first, and a string, by radix selection.

A pass counts, group by group, how many rows have each value of the next bits among those that agree with the k-th
row so far: a distributed histogram, of at most 2**DIGIT counts a group. Where its running sum from the top reaches k lie
the k-th row's next bits. Once all bits are known, rows with that number are told apart by the bytes of the string, PAIR
bytes a pass. A group is done as soon as the rows that still agree, which all are kept, are at most ``SMALL``; they and the
rows before them are sorted at the end. So no pass moves more than counts, and no task holds a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.operators.skew import join_counted
from gleaner.workspace import Workspace

DIGIT, PAIR, SMALL = 12, 2, 1024
#: Up to so many groups, of a few numbers each, are broadcast; more are joined with their hot keys apart.
MOST_SENT = 50_000


def _bits(x: Column) -> Column:
    return F.when(x > 0, F.length(F.bin(x))).otherwise(0)


def radix_top(rows: DataFrame, groups: list[str], value: str, item: str, k: int, work: Workspace, name: str = "rank") -> DataFrame:
    """Rows of a written table ranked from 1 to k in each group; ``value`` is a long of at least 0, ``item`` a string.

    Equal rows are interchangeable. NULL groups are dropped."""
    state = rows.groupBy(*groups).agg(F.count("*").alias("_size"), F.max(value).alias("_most")).select(
        *groups, "_size", F.lit(0).cast("long").alias("_at"), _bits(F.col("_most")).cast("int").alias("_low"), F.lit(k).cast("long").alias("_need"), F.col("_size").alias("_left"), F.lit("").alias("_prefix"))
    open_ = F.col("_left") > F.lit(max(SMALL, 1))
    step = 0
    state, seen = work.stash(state, f"radix{step}", open=F.count_if(open_ & (F.col("_left") > F.col("_need"))), groups=F.count("*"))

    def joined(left: DataFrame, right: DataFrame) -> DataFrame:
        if seen["groups"] <= MOST_SENT:
            return left.join(F.broadcast(right), groups)
        return join_counted(left, right, groups, "_size", F.col(item))

    live = open_ & (F.col("_left") > F.col("_need"))
    raw = F.col(item).cast("binary")
    while seen["open"]:
        step += 1
        active = joined(rows, state.filter(live))
        # the next bits, largest first; then the next bytes, smallest first, "" where the string has ended
        active = active.filter(F.expr(f"shiftright({value}, _low) = _at"))
        of_bits = F.col("_low") > 0
        width = F.least(F.lit(DIGIT), F.col("_low"))
        digit = F.expr(f"shiftright({value}, _low - least({DIGIT}, _low)) & (shiftleft(1L, least({DIGIT}, _low)) - 1)")
        done = F.length("_prefix") / 2
        text = F.hex(F.substring(raw, done.cast("int") + 1, F.lit(PAIR)))
        active = active.filter(of_bits | (F.hex(F.substring(raw, F.lit(1), done.cast("int"))) == F.col("_prefix")))
        keys = [*groups, "_at", "_low", "_need", "_prefix", "_size"]
        counts = active.groupBy(*keys, F.when(of_bits, digit).otherwise(0).alias("_digit"), F.when(of_bits, "").otherwise(text).alias("_text")).agg(F.count("*").alias("_n"))
        order = Window.partitionBy(*groups).orderBy(F.desc("_digit"), "_text")
        upto = F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        here = counts.withColumn("_upto", upto).filter((F.col("_upto") >= F.col("_need")) & (F.col("_upto") - F.col("_n") < F.col("_need")))
        # a string that has ended is one item: its rows are equal, and as many as are needed are taken at the end
        ended = ~of_bits & (F.length("_text") < 2 * PAIR)
        next_ = here.select(
            *groups, "_size", F.when(of_bits, F.expr(f"shiftleft(_at, least({DIGIT}, _low))").bitwiseOR(F.col("_digit"))).otherwise(F.col("_at")).alias("_at"), F.when(of_bits, F.col("_low") - width).otherwise(F.col("_low")).cast("int").alias("_low"),
            (F.col("_need") - F.col("_upto") + F.col("_n")).alias("_need"), F.when(ended, F.lit(0)).otherwise(F.col("_n")).cast("long").alias("_left"), F.concat("_prefix", "_text").alias("_prefix"))
        held = state.filter(~live)
        state, seen = work.stash(held.unionByName(next_), f"radix{step}", open=F.count_if(live), groups=F.count("*"))
    kept = joined(rows, state.select(*groups, "_size", "_at", "_low", "_prefix", (F.col("_left") == 0).alias("_ended")))
    top = F.expr(f"shiftright({value}, _low)")
    begin = F.hex(F.when(F.col("_ended"), raw).otherwise(F.substring(raw, F.lit(1), (F.length("_prefix") / 2).cast("int"))))
    kept = kept.filter((top > F.col("_at")) | (top == F.col("_at")) & ((F.length("_prefix") == 0) | (begin <= F.col("_prefix"))))
    order = Window.partitionBy(*groups).orderBy(F.desc(value), F.col(item))
    return kept.withColumn(name, F.row_number().over(order)).filter(F.col(name) <= k).select(*rows.columns, name)
