"""Prediction tables and deterministic example selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.dims import label_name
from gleaner.functions.scalar import argmax


def predictions_table(rows: DataFrame, names: list[str]) -> DataFrame:
    """``rows``: filepath, y_true, prob. One column for each class beside ids, names and confidence."""
    pred = argmax(F.col("prob"))
    return rows.withColumn("y_pred", pred).select(
        "filepath", F.col("y_true").alias("true_label_id"), label_name(F.col("y_true"), names).alias("true_label_name"),
        F.col("y_pred").alias("predicted_label_id"), label_name(F.col("y_pred"), names).alias("predicted_label_name"),
        F.round(F.get("prob", F.col("y_pred")), 6).alias("confidence"), *(F.round(F.get("prob", F.lit(i)), 6).alias(f"prob_{n}") for i, n in enumerate(names)))


def misclassified(table: DataFrame) -> DataFrame:
    return table.filter("true_label_id <> predicted_label_id")


def select_examples(table: DataFrame, names: list[str], wrong: int = 4) -> DataFrame:
    """The first right row by path of each class, and the first ``wrong`` wrong rows by path, numbered 01, 02, ..."""
    right = table.filter(F.col("true_label_name") == F.col("predicted_label_name")).groupBy("true_label_name").agg(F.min_by(F.struct("filepath", "predicted_label_name"), F.col("filepath")).alias("x"))
    good = right.filter(F.col("true_label_name").isin(names)).select(F.concat(F.lit("correct_"), "true_label_name").alias("example"), "x.filepath", "true_label_name", "x.predicted_label_name")
    few = misclassified(table).orderBy("filepath").limit(wrong)
    order = Window.orderBy("filepath")  # over at most ``wrong`` rows
    bad = few.select(F.concat(F.lit("misclassified_"), F.lpad(F.row_number().over(order).cast("string"), 2, "0")).alias("example"), "filepath", "true_label_name", "predicted_label_name")
    return good.unionByName(bad)
