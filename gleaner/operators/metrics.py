"""Multiclass evaluation from one pass: the confusion counts, then everything else on at most k * k rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions.scalar import share


def confusion(pairs: DataFrame, k: int, by: list[str] | None = None) -> DataFrame:
    """(by...,) true_id, pred_id, n for all k * k cells, zeros included. ``pairs``: y_true, y_pred."""
    by = by or []
    spark = pairs.sparkSession
    ids = spark.range(k).select(F.col("id").cast("int"))
    grid = ids.select(F.col("id").alias("true_id")).crossJoin(ids.select(F.col("id").alias("pred_id")))
    seen = pairs.groupBy(*by, F.col("y_true").alias("true_id"), F.col("y_pred").alias("pred_id")).count()
    if by:
        grid = pairs.select(*by).distinct().crossJoin(grid)
    return grid.join(seen, [*by, "true_id", "pred_id"], "left").select(*by, "true_id", "pred_id", F.coalesce("count", F.lit(0)).alias("n"))


def normalised(cm: DataFrame) -> DataFrame:
    """Share of the row; an empty row stays zero."""
    total = cm.groupBy("true_id").agg(F.sum("n").alias("t"))
    return cm.join(total, "true_id").select("true_id", "pred_id", share(F.col("n"), F.col("t")).alias("share"))


def per_class(cm: DataFrame, by: list[str] | None = None) -> DataFrame:
    """class_id, precision, recall, f1, support; an undefined ratio is 0."""
    by = by or []
    tp = F.when(F.col("true_id") == F.col("pred_id"), F.col("n")).otherwise(0)
    as_true = cm.groupBy(*by, F.col("true_id").alias("class_id")).agg(F.sum("n").alias("support"), F.sum(tp).alias("tp"))
    as_pred = cm.groupBy(*by, F.col("pred_id").alias("class_id")).agg(F.sum("n").alias("predicted"))
    m = as_true.join(as_pred, [*by, "class_id"]).select(*by, "class_id", "support", "tp", share(F.col("tp"), F.col("predicted")).alias("precision"), share(F.col("tp"), F.col("support")).alias("recall"))
    return m.withColumn("f1", share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def overall(cm: DataFrame, by: list[str] | None = None, digits: int = 9) -> DataFrame:
    """accuracy, macro and weighted precision, recall and F1; macro averages run over all declared classes."""
    by = by or []
    m = per_class(cm, by)
    weighted = lambda c: F.round(share(F.sum(F.col(c) * F.col("support")), F.sum("support")), digits)
    return m.groupBy(*by).agg(
        F.round(share(F.sum("tp"), F.sum("support")), digits).alias("accuracy"),
        *(F.round(F.avg(c), digits).alias(f"macro_{c}") for c in ("precision", "recall", "f1")),
        *(weighted(c).alias(f"weighted_{c}") for c in ("precision", "recall", "f1")), F.sum("support").alias("n"))


def report(cm: DataFrame, names: list[str], digits: int = 9) -> DataFrame:
    """A row a class, then accuracy (in every column), macro avg and weighted avg."""
    m = per_class(cm)
    name = F.get(F.array(*(F.lit(n) for n in names)), F.col("class_id"))
    r = lambda c: F.round(c, digits)
    rows = m.select(name.alias("label"), r("precision").alias("precision"), r("recall").alias("recall"), r("f1").alias("f1"), F.col("support").cast("double").alias("support"))
    o = overall(cm, digits=digits)
    acc = o.select(F.lit("accuracy").alias("label"), *(F.col("accuracy").alias(c) for c in ("precision", "recall", "f1", "support")))
    for kind in ("macro", "weighted"):
        acc = acc.unionByName(o.select(F.lit(f"{kind} avg").alias("label"), *(F.col(f"{kind}_{c}").alias(c) for c in ("precision", "recall", "f1")), F.col("n").cast("double").alias("support")))
    return rows.unionByName(acc)


def select_winner(models: DataFrame, primary: str = "macro_f1", secondary: str = "accuracy") -> DataFrame:
    """One row: the winner by ``primary`` at 4 places, then ``secondary`` at 4 places, then the smallest ordinal.

    ``models``: model, ordinal and metric columns; one row a model.
    """
    p, s = F.round(primary, 4), F.round(secondary, 4)
    best = models.agg(F.max(p).alias("best"), F.max_by("model", F.struct(p, s, -F.col("ordinal"))).alias("selected_model"))
    tied = models.crossJoin(best.select("best"))
    stats = tied.agg(F.count_if(p == F.col("best")).alias("n"), F.max(F.when(p < F.col("best"), p)).alias("next"))
    return best.crossJoin(stats).select("selected_model", F.lit(primary).alias("primary_metric"), F.col("best").alias("best_primary"), (F.col("n") > 1).alias("is_tie"), F.round(F.when(F.col("n") > 1, 0.0).otherwise(F.coalesce(F.col("best") - F.col("next"), F.lit(0.0))), 4).alias("margin"))
