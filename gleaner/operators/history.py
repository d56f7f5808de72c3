"""Training histories: rows (run, epoch, value), one run a training, lower values better."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def from_lists(lists: DataFrame, names: list[str]) -> DataFrame:
    """Metric lists of one length, a row a run, to a row an epoch numbered from 1."""
    x = lists.select("run", F.posexplode(F.arrays_zip(*names)).alias("at", "x"))
    return x.select("run", (F.col("at") + 1).alias("epoch"), *(F.col(f"x.{n}").alias(n) for n in names))


def best_epoch(h: DataFrame) -> DataFrame:
    """The first epoch with the smallest value."""
    return h.groupBy("run").agg(F.min_by("epoch", F.struct("value", "epoch")).alias("best_epoch"), F.min("value").alias("best_value"), F.max("epoch").alias("epochs"))


def _improved(h: DataFrame) -> DataFrame:
    before = F.min("value").over(Window.partitionBy("run").orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1))
    return h.withColumn("improved", before.isNull() | (F.col("value") < before))


def checkpoints(h: DataFrame) -> DataFrame:
    return _improved(h).filter("improved").select("run", "epoch", "value")


def early_stop(h: DataFrame, patience: int = 5) -> DataFrame:
    """The epoch after ``patience`` epochs without improvement (NULL: ran to its end) and the best epoch until then."""
    w = Window.partitionBy("run").orderBy("epoch")
    x = _improved(h).withColumn("last", F.max(F.when(F.col("improved"), F.col("epoch"))).over(w))
    stop = x.groupBy("run").agg(F.min(F.when(F.col("epoch") - F.col("last") >= patience, F.col("epoch"))).alias("stop_epoch"), F.max("epoch").alias("epochs"))
    kept = x.join(stop, "run").filter(F.col("epoch") <= F.coalesce("stop_epoch", "epochs"))
    return kept.groupBy("run", "stop_epoch").agg(F.min_by("epoch", F.struct("value", "epoch")).alias("best_epoch"))


def lr_plateau(h: DataFrame, start: float = 1e-3, factor: float = 0.5, patience: int = 2, floor: float = 1e-6, min_delta: float = 1e-4) -> DataFrame:
    """The learning rate in force in each epoch: cut after ``patience`` epochs without improvement, counted anew after a cut.

    The count resets, so this is a fold; runs stream through sorted partitions with four numbers of state.
    """

    def fold(batches):
        run, lr, best, wait = None, start, float("inf"), 0
        for b in batches:
            rates = []
            for r, v in zip(b.column("run").to_pylist(), b.column("value").to_pylist(), strict=True):
                if r != run:
                    run, lr, best, wait = r, start, float("inf"), 0
                rates.append(lr)
                if v is not None and v < best - min_delta:
                    best, wait = v, 0
                else:
                    wait += 1
                    if wait >= patience:
                        lr, wait = max(lr * factor, floor), 0
            yield pa.RecordBatch.from_arrays([b.column("run"), b.column("epoch"), pa.array(rates, pa.float64())], ["run", "epoch", "learning_rate"])

    dealt = h.select(F.col("run").cast("long"), F.col("epoch").cast("long"), F.col("value").cast("double")).repartition("run").sortWithinPartitions("run", "epoch")
    return dealt.mapInArrow(fold, "run long, epoch long, learning_rate double")


def final_metrics(h: DataFrame) -> DataFrame:
    return h.groupBy("run").agg(F.max_by("value", "epoch").alias("final_value"), F.max("epoch").alias("epochs"))


def stage_selection(h: DataFrame) -> DataFrame:
    """Rows have a ``stage``: the later of two stages wins ties of the best value."""
    best = h.groupBy("run", "stage").agg(F.min("value").alias("best"))
    return best.groupBy("run").agg(F.min_by("stage", F.struct("best", -F.col("stage"))).alias("selected_stage"), F.min("best").alias("best_value"))
