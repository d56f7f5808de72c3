"""Queries of the evaluation family."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.functions.scalar import clip01, sane_probabilities, valid_probabilities
from gleaner.operators import metrics, predictions
from gleaner.plans import tables as t
from gleaner.plans.registry import ORACLES, query

K = 4
P = t.PREDICTIONS
CM = f"""WITH {P}, cells AS (SELECT * FROM (SELECT DISTINCT model FROM predictions), (SELECT unnest(range(4))::INT AS true_id), (SELECT unnest(range(4))::INT AS pred_id)),
cm AS (SELECT c.model, c.true_id, c.pred_id, count(p.vec_id) AS n FROM cells c LEFT JOIN predictions p ON p.model = c.model AND p.y_true = c.true_id AND p.y_pred = c.pred_id GROUP BY ALL)"""
PC = CM + """, a AS (SELECT model, true_id AS class_id, sum(n) AS support, sum(n) FILTER (true_id = pred_id) AS tp FROM cm GROUP BY ALL), b AS (SELECT model, pred_id AS class_id, sum(n) AS predicted FROM cm GROUP BY ALL),
pr AS (SELECT model, class_id, support, tp, coalesce(tp::DOUBLE / nullif(predicted, 0), 0) AS p, coalesce(tp::DOUBLE / nullif(support, 0), 0) AS r FROM a JOIN b USING (model, class_id)),
pc AS (SELECT *, coalesce(2 * p * r / nullif(p + r, 0), 0) AS f FROM pr)"""
OV = PC + """, ov AS (SELECT model, round(sum(tp)::DOUBLE / sum(support), 9) AS accuracy, round(avg(p), 9) AS macro_precision, round(avg(r), 9) AS macro_recall, round(avg(f), 9) AS macro_f1,
 round(sum(p * support) / sum(support), 9) AS weighted_precision, round(sum(r * support) / sum(support), 9) AS weighted_recall, round(sum(f * support) / sum(support), 9) AS weighted_f1, sum(support)::BIGINT AS n FROM pc GROUP BY model)"""


def _one(spark, sf, model: str = "baseline"):
    return t.predictions(spark, sf).filter(F.col("model") == model)


@query("predictions_table", f"WITH {P}, nm AS (SELECT ['glioma', 'meningioma', 'notumor', 'pituitary'] AS names) SELECT filepath, y_true AS true_label_id, names[y_true + 1] AS true_label_name, y_pred AS predicted_label_id, names[y_pred + 1] AS predicted_label_name, round(prob[y_pred + 1], 6) AS confidence, round(prob[1], 6) AS prob_glioma, round(prob[2], 6) AS prob_meningioma, round(prob[3], 6) AS prob_notumor, round(prob[4], 6) AS prob_pituitary FROM predictions, nm WHERE model = 'baseline'")
def predictions_table(spark, sf):
    return predictions.predictions_table(_one(spark, sf).drop("y_pred"), t.NAMES)


@query("prob_validate", "SELECT vec_id, coalesce(len(v) = 4 AND list_bool_and(list_transform(v, lambda x: x BETWEEN -1e-4 AND 1 + 1e-4)), false) AS is_valid, round(list_sum(list_transform(v, lambda x: greatest(least(x, 1.0), 0.0))), 6) AS clipped_sum FROM (SELECT vec_id, CAST(embedding[1:CASE WHEN label = 7 THEN 3 ELSE 4 END] AS DOUBLE[]) AS v FROM embeddings)")
def prob_validate(spark, sf):
    from gleaner.plans.registry import table

    e = table(spark, sf, "embeddings").select("vec_id", F.transform(F.slice("embedding", F.lit(1), F.when(F.col("label") == 7, 3).otherwise(4)), lambda x: x.cast("double")).alias("v"))
    return e.select("vec_id", valid_probabilities(F.col("v"), 4).alias("is_valid"), F.round(F.aggregate(clip01(F.col("v")), F.lit(0.0), lambda a, x: a + x), 6).alias("clipped_sum"))


@query("prob_sanity", f"WITH {P} SELECT model, bool_and(abs(list_sum(prob) - 1) <= 1e-5 AND y_pred BETWEEN 0 AND 3) AS all_sane, count(*) AS n FROM predictions GROUP BY model")
def prob_sanity(spark, sf):
    return t.predictions(spark, sf).groupBy("model").agg(F.bool_and(sane_probabilities(F.col("prob")) & F.col("y_pred").between(0, 3)).alias("all_sane"), F.count("*").alias("n"))


@query("confusion_matrix", CM + " SELECT model, true_id, pred_id, n FROM cm")
def confusion_matrix(spark, sf):
    return metrics.confusion(t.predictions(spark, sf), K, ["model"])


@query("confusion_wide", f"WITH {P} SELECT y_true AS true_id, count(*) FILTER (y_pred = 0) AS pred_0, count(*) FILTER (y_pred = 1) AS pred_1, count(*) FILTER (y_pred = 2) AS pred_2, count(*) FILTER (y_pred = 3) AS pred_3 FROM predictions WHERE model = 'baseline' GROUP BY y_true")
def confusion_wide(spark, sf):
    return _one(spark, sf).groupBy(F.col("y_true").alias("true_id")).agg(*(F.count_if(F.col("y_pred") == i).alias(f"pred_{i}") for i in range(K)))


@query("confusion_normalised", CM + " SELECT true_id, pred_id, round(coalesce(n::DOUBLE / nullif(sum(n) OVER (PARTITION BY true_id), 0), 0), 9) AS share FROM cm WHERE model = 'baseline'")
def confusion_normalised(spark, sf):
    return metrics.normalised(metrics.confusion(_one(spark, sf), K)).withColumn("share", F.round("share", 9))


@query("metrics_per_class", PC + " SELECT model, class_id, round(p, 9) AS precision, round(r, 9) AS recall, round(f, 9) AS f1, support::BIGINT AS support FROM pc")
def metrics_per_class(spark, sf):
    m = metrics.per_class(metrics.confusion(t.predictions(spark, sf), K, ["model"]), ["model"])
    return m.select("model", "class_id", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")), "support")


@query("metrics_overall", OV + " SELECT * FROM ov")
def metrics_overall(spark, sf):
    return metrics.overall(metrics.confusion(t.predictions(spark, sf), K, ["model"]), ["model"])


@query("classification_report", OV + """ SELECT (['glioma', 'meningioma', 'notumor', 'pituitary'])[class_id + 1] AS label, round(p, 9) AS precision, round(r, 9) AS recall, round(f, 9) AS f1, support::DOUBLE AS support FROM pc WHERE model = 'baseline'
UNION ALL SELECT 'accuracy', accuracy, accuracy, accuracy, accuracy FROM ov WHERE model = 'baseline' UNION ALL SELECT 'macro avg', macro_precision, macro_recall, macro_f1, n::DOUBLE FROM ov WHERE model = 'baseline'
UNION ALL SELECT 'weighted avg', weighted_precision, weighted_recall, weighted_f1, n::DOUBLE FROM ov WHERE model = 'baseline'""")
def classification_report(spark, sf):
    return metrics.report(metrics.confusion(_one(spark, sf), K), t.NAMES)


def _models(spark, sf):
    p = t.predictions(spark, sf)
    return metrics.overall(metrics.confusion(p, K, ["model", "ordinal"]), ["model", "ordinal"])


@query("model_comparison", OV + " SELECT model, accuracy, macro_precision, macro_recall, macro_f1, weighted_f1 FROM ov")
def model_comparison(spark, sf):
    return _models(spark, sf).select("model", "accuracy", "macro_precision", "macro_recall", "macro_f1", "weighted_f1")


@query("select_winner", OV + """, w AS (SELECT model, round(macro_f1, 4) AS p, round(accuracy, 4) AS s FROM ov), top AS (SELECT max(p) AS best FROM w)
SELECT (SELECT model FROM w ORDER BY p DESC, s DESC, model LIMIT 1) AS selected_model, 'macro_f1' AS primary_metric, best AS best_primary, (SELECT count(*) > 1 FROM w WHERE p = best) AS is_tie,
 round(CASE WHEN (SELECT count(*) > 1 FROM w WHERE p = best) THEN 0 ELSE coalesce(best - (SELECT max(p) FROM w WHERE p < best), 0) END, 4)::DOUBLE AS margin FROM top""")
def select_winner(spark, sf):
    return metrics.select_winner(_models(spark, sf))


@query("misclassified", f"WITH {P} SELECT filepath, y_true AS true_label_id, y_pred AS predicted_label_id FROM predictions WHERE model = 'baseline' AND y_true <> y_pred")
def misclassified(spark, sf):
    return predictions.misclassified(predictions_table(spark, sf)).select("filepath", "true_label_id", "predicted_label_id")


@query("gradcam_examples", f"""WITH {P}, x AS (SELECT filepath, (['glioma', 'meningioma', 'notumor', 'pituitary'])[y_true + 1] AS true_label_name, (['glioma', 'meningioma', 'notumor', 'pituitary'])[y_pred + 1] AS predicted_label_name FROM predictions WHERE model = 'baseline')
SELECT 'correct_' || true_label_name AS example, min(filepath) AS filepath, true_label_name, true_label_name AS predicted_label_name FROM x WHERE true_label_name = predicted_label_name GROUP BY true_label_name
UNION ALL SELECT 'misclassified_' || lpad(CAST(row_number() OVER (ORDER BY filepath) AS VARCHAR), 2, '0'), filepath, true_label_name, predicted_label_name FROM (SELECT * FROM x WHERE true_label_name <> predicted_label_name ORDER BY filepath LIMIT 4)""")
def gradcam_examples(spark, sf):
    return predictions.select_examples(predictions_table(spark, sf), t.NAMES)


@query("example_counts", f"WITH {P} SELECT count(*) FILTER (y_true = y_pred) AS correct, count(*) FILTER (y_true <> y_pred) AS misclassified FROM predictions WHERE model = 'baseline'")
def example_counts(spark, sf):
    return _one(spark, sf).agg(F.count_if(F.col("y_true") == F.col("y_pred")).alias("correct"), F.count_if(F.col("y_true") != F.col("y_pred")).alias("misclassified"))


KEPT = CM.replace("predictions AS (", "every AS (", 1).replace(
    ", cells AS", ", one AS (SELECT e.vec_id, label FROM embeddings e JOIN (SELECT min(vec_id) AS vec_id FROM embeddings GROUP BY embedding[1]) USING (vec_id)), predictions AS (SELECT * FROM every WHERE vec_id IN (SELECT vec_id FROM one WHERE label <> 9)), cells AS", 1)


@query("dedup_sensitivity", OV.replace(CM, KEPT) + " SELECT model, accuracy, macro_f1, n FROM ov")
def dedup_sensitivity(spark, sf):
    """Metrics without redundant files: copies by first value and the label 9, removed by an anti join."""
    from gleaner.operators.duplicates import without

    left = without(t.predictions(spark, sf).withColumnRenamed("filepath", "relative_path"), redundant_files(spark, sf))
    return metrics.overall(metrics.confusion(left, K, ["model"]), ["model"]).select("model", "accuracy", "macro_f1", "n")


def redundant_files(spark, sf):
    from gleaner.plans.registry import table

    keeper = table(spark, sf, "embeddings").groupBy(F.col("embedding")[0].alias("v")).agg(F.min("vec_id").alias("kept"))
    ids = table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding")[0].alias("v")).join(keeper, "v")
    return ids.filter((F.col("vec_id") != F.col("kept")) | (F.col("label") == 9)).select(F.concat(F.lit("data/"), F.lpad(F.col("vec_id").cast("string"), 8, "0"), F.lit(".jpg")).alias("relative_path"))


def _assembled(spark, sf):
    from pyspark.ml.functions import array_to_vector

    from gleaner.plans.registry import table

    e = table(spark, sf, "embeddings")
    return e.select("vec_id", array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("features"), (F.col("label") % K).cast("double").alias("label"))


@query("ml_predictions")
def ml_predictions(spark, sf):
    """A linear head on the embeddings: the stand-in for the trained networks."""
    from gleaner.operators.ml import fit_head, predict

    data = _assembled(spark, sf)
    return predict(fit_head(data), data).select("vec_id", "predicted", F.round("confidence", 6).alias("confidence"))


@query("ml_attribution")
def ml_attribution(spark, sf):
    from gleaner.operators.ml import attribution, fit_head, predict

    data = _assembled(spark, sf)
    model = fit_head(data)
    return attribution(model, predict(model, data)).select("vec_id", "predicted", F.size("heat").alias("n"), F.round(F.array_max("heat"), 6).alias("top"))


def _both(name: str, sql: str, of) -> None:
    """The second model's twin of a query that shows one model."""
    query(f"{name}_transfer", sql.replace("model = 'baseline'", "model = 'transfer'"))(of)


def _second(spark, sf):
    return _one(spark, sf, "transfer")


def _second_table(spark, sf):
    return predictions.predictions_table(_second(spark, sf).drop("y_pred"), t.NAMES)


_both("confusion_wide", ORACLES["confusion_wide"], lambda spark, sf: _second(spark, sf).groupBy(F.col("y_true").alias("true_id")).agg(*(F.count_if(F.col("y_pred") == i).alias(f"pred_{i}") for i in range(K))))
_both("misclassified", ORACLES["misclassified"], lambda spark, sf: predictions.misclassified(_second_table(spark, sf)).select("filepath", "true_label_id", "predicted_label_id"))
_both("gradcam_examples", ORACLES["gradcam_examples"], lambda spark, sf: predictions.select_examples(_second_table(spark, sf), t.NAMES))
_both("example_counts", ORACLES["example_counts"], lambda spark, sf: _second(spark, sf).agg(F.count_if(F.col("y_true") == F.col("y_pred")).alias("correct"), F.count_if(F.col("y_true") != F.col("y_pred")).alias("misclassified")))


_both("predictions_table", ORACLES["predictions_table"], lambda spark, sf: predictions.predictions_table(_second(spark, sf).drop("y_pred"), t.NAMES))
_both("confusion_normalised", ORACLES["confusion_normalised"], lambda spark, sf: metrics.normalised(metrics.confusion(_second(spark, sf), K)).withColumn("share", F.round("share", 9)))
_both("classification_report", ORACLES["classification_report"], lambda spark, sf: metrics.report(metrics.confusion(_second(spark, sf), K), t.NAMES))


@query("evaluation_run", OV.replace(CM, KEPT).replace("ov AS (", "dd AS (") + """, full_p AS (SELECT model, y_true, y_pred FROM every)
SELECT f.model, round(avg(CASE WHEN y_true = y_pred THEN 1.0::DOUBLE ELSE 0 END), 9) AS primary_accuracy, any_value(d.accuracy) AS dedup_accuracy, any_value(d.macro_f1) AS dedup_macro_f1 FROM full_p f JOIN dd d USING (model) GROUP BY f.model""")
def evaluation_run(spark, sf):
    """The sensitivity table of a whole evaluation run over both models."""
    from gleaner.plans.runs import evaluation_run as run

    return run(t.predictions(spark, sf), t.NAMES, redundant_files(spark, sf))[0]["duplicate_sensitivity"].drop("primary_macro_f1")
