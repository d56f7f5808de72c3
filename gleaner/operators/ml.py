"""Train, predict and explain with ``pyspark.ml``: a multinomial linear head on precomputed features.

Convolutional training has no Spark form; features come from outside and the head is what is trained here.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions.scalar import argmax, max_normalise


def fit_head(data: DataFrame, iterations: int = 30, l2: float = 1e-2) -> PipelineModel:
    """``data``: features (vector), label (double)."""
    head = LogisticRegression(maxIter=iterations, regParam=l2, family="multinomial", standardization=False)
    return Pipeline(stages=[head]).fit(data)


def predict(model: PipelineModel, data: DataFrame) -> DataFrame:
    p = vector_to_array("probability")
    out = model.transform(data).withColumn("prob", p)
    return out.withColumn("predicted", argmax(F.col("prob"))).withColumn("confidence", F.get("prob", F.col("predicted")))


def attribution(model: PipelineModel, predicted: DataFrame) -> DataFrame:
    """``heat``: weight times feature of the predicted class, negative parts cut, scaled to a maximum of 1."""
    weights = model.stages[-1].coefficientMatrix.toArray().tolist()
    table = F.array(*(F.array(*(F.lit(float(x)) for x in row)) for row in weights))
    w = F.get(table, F.col("predicted"))
    raw = F.zip_with(w, vector_to_array("features"), lambda a, b: F.greatest(a * b, F.lit(0.0)))
    return predicted.withColumn("heat", max_normalise(raw))


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)
