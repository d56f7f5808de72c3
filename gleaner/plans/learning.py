"""Queries that train, predict and explain with networks on the embeddings. Weights follow from formulas, so SQL can say them too."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from gleaner.operators.training import Model, explain, predict, train
from gleaner.plans.registry import query, table

NAMES = ["glioma", "meningioma", "notumor", "pituitary"]
RATE = 0.01


def _rows(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("key"), F.col("embedding").alias("pixels"), (F.col("label") % 4).cast("int").alias("label"), "vec_id")


@query("train_epoch", f"""WITH e AS (SELECT vec_id, CAST(label % 4 AS INT) AS y, CAST(embedding AS DOUBLE[]) AS x FROM embeddings), n AS (SELECT count(*) AS n FROM e),
g AS (SELECT c, j, sum((0.25::DOUBLE - CASE WHEN y = c THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) * CASE WHEN j = 64 THEN 1.0::DOUBLE ELSE x[j + 1] END / n) AS g FROM e, n, range(4) a(c), range(65) b(j) GROUP BY ALL),
w AS (SELECT c, list(-{RATE}::DOUBLE * (sqrt(1 - 0.999::DOUBLE) / (1 - 0.9::DOUBLE)) * (0.1::DOUBLE * g) / (sqrt(0.001::DOUBLE * g * g) + 1e-7) ORDER BY j) AS w FROM g GROUP BY c),
z AS (SELECT vec_id, y, list(list_dot_product(x, w[1:64]) + w[65] ORDER BY c) AS z FROM e, w GROUP BY vec_id, y, x),
p AS (SELECT y, z, list_transform(z, lambda v: exp(v - list_max(z))) AS q FROM z)
SELECT 1 AS epoch, round(ln(4.0::DOUBLE), 6) AS loss, round((SELECT avg(CASE WHEN y = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) FROM e), 6) AS accuracy, round(avg(-ln(q[y + 1] / list_sum(q))), 6) AS val_loss,
  round(avg(CASE WHEN list_position(z, list_max(z)) - 1 = y THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS val_accuracy, {RATE}::DOUBLE AS learning_rate, true AS saved FROM p""")
def train_epoch(spark, sf):
    """One step over all rows from zero weights, by the barrier stage's tasks together; what it reaches on the same rows."""
    model = Model([("dense", 4, "")], (64,), [{"kernel": np.zeros((64, 4)), "bias": np.zeros(4)}])
    rows = _rows(spark, sf)
    history = train(model, rows, rows, epochs=1, batch=1 << 40, rate=RATE)[1]
    return history.select("epoch", *(F.round(c, 6).alias(c) for c in ("loss", "accuracy", "val_loss", "val_accuracy")), "learning_rate", "saved")


def _head() -> Model:
    i, j, c = np.arange(64)[:, None], np.arange(8), np.arange(4)
    return Model([("dense", 8, "relu"), ("dropout", 0.4), ("dense", 4, "")], (64,), [
        {"kernel": ((i * 7 + j * 5) % 11 - 5) / 10, "bias": (j - 1) / 10}, {}, {"kernel": ((j[:, None] * 3 + c * 2) % 7 - 3) / 5, "bias": np.zeros(4)}])


@query("network_predictions", """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
h AS (SELECT vec_id, list_transform(range(8), lambda j: greatest(list_sum(list_transform(range(64), lambda i: x[i + 1] * (((i * 7 + j * 5) % 11 - 5) / 10.0::DOUBLE))) + (j - 1) / 10.0::DOUBLE, 0)) AS h FROM e),
z AS (SELECT vec_id, list_transform(range(4), lambda c: list_sum(list_transform(range(8), lambda j: h[j + 1] * (((j * 3 + c * 2) % 7 - 3) / 5.0::DOUBLE)))) AS z FROM h),
p AS (SELECT vec_id, list_transform(z, lambda v: exp(v - list_max(z)) / list_sum(list_transform(z, lambda u: exp(u - list_max(z))))) AS p, CAST(list_position(z, list_max(z)) - 1 AS INT) AS predicted FROM z)
SELECT vec_id, predicted, round(p[predicted + 1], 6) AS confidence, (['glioma', 'meningioma', 'notumor', 'pituitary'])[predicted + 1] AS label_name FROM p""")
def network_predictions(spark, sf):
    return predict(_head(), _rows(spark, sf), NAMES).select("vec_id", "predicted", F.round("confidence", 6).alias("confidence"), "label_name")


def _convolution() -> Model:
    a, b, f, c = np.arange(3)[:, None, None, None], np.arange(3)[None, :, None, None], np.arange(2), np.arange(4)
    return Model([("conv", 2, 3), ("mean",), ("dense", 4, "")], (8, 8, 1), [{"kernel": ((a * 3 + b * 2 + f * 5) % 7 - 3) / 4, "bias": np.array([0.05, -0.05])}, {}, {"kernel": ((f[:, None] * 3 + c * 2) % 5 - 2).astype(float), "bias": np.zeros(4)}])


@query("activation_maps", """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
conv AS (SELECT vec_id, list_transform(range(2), lambda f: list_transform(range(64), lambda p: greatest(CASE WHEN f = 0 THEN 0.05::DOUBLE ELSE -0.05::DOUBLE END + list_sum(list_transform(range(9), lambda k:
  CASE WHEN p // 8 + k // 3 - 1 BETWEEN 0 AND 7 AND p % 8 + k % 3 - 1 BETWEEN 0 AND 7 THEN x[(p // 8 + k // 3 - 1) * 8 + p % 8 + k % 3] * ((((k // 3) * 3 + (k % 3) * 2 + f * 5) % 7 - 3) / 4.0::DOUBLE) ELSE 0.0::DOUBLE END)), 0.0::DOUBLE))) AS y FROM e),
z AS (SELECT vec_id, y, list_transform(range(4), lambda c: list_avg(y[1]) * ((c * 2) % 5 - 2) + list_avg(y[2]) * ((3 + c * 2) % 5 - 2)) AS z FROM conv),
p AS (SELECT vec_id, y, list_transform(z, lambda v: exp(v - list_max(z)) / list_sum(list_transform(z, lambda u: exp(u - list_max(z))))) AS p, CAST(list_position(z, list_max(z)) AS INT) AS best FROM z),
g AS (SELECT vec_id, y, p, best, list_transform(range(2), lambda f: p[best] * list_sum(list_transform(range(4), lambda c: (CASE WHEN c + 1 = best THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END - p[c + 1]) * ((f * 3 + c * 2) % 5 - 2))) / 64) AS g FROM p),
raw AS (SELECT vec_id, best, p, list_transform(range(1, 65), lambda q: greatest(y[1][q] * g[1] + y[2][q] * g[2], 0)) AS r FROM g)
SELECT vec_id, best - 1 AS predicted, round(p[best], 6) AS confidence, list_count(list_filter(r, lambda v: v > 0)) AS warm, round(list_sum(list_transform(r, lambda v: CASE WHEN list_max(r) > 1e-8 THEN CAST(CAST(v / list_max(r) AS FLOAT) AS DOUBLE) ELSE 0 END)), 5) AS total FROM raw""")
def activation_maps(spark, sf):
    """Each embedding as an image of 8 x 8 through a convolution: where the gradient of its class lights up."""
    out = explain(_convolution(), _rows(spark, sf), NAMES)
    warm = F.size(F.filter("heat", lambda v: v > 0)).cast("long")
    total = F.aggregate(F.transform("heat", lambda v: v.cast("double")), F.lit(0.0), lambda a, v: a + v)
    return out.select("vec_id", "predicted", F.round("confidence", 6).alias("confidence"), warm.alias("warm"), F.round(total, 5).alias("total"))
