"""Published figures that the metric and history operators must reproduce. Matrices, scores, losses."""

import pytest

from gleaner.operators import history, metrics

BASELINE = [[292, 42, 62, 4], [18, 321, 41, 20], [0, 0, 400, 0], [18, 26, 7, 349]]
TRANSFER = [[247, 76, 28, 49], [12, 310, 14, 64], [1, 3, 395, 1], [1, 2, 0, 397]]
SCORES = {"baseline": (0.85125, 0.8588518166117254, 0.85125, 0.8494955786715707), "transfer": (0.843125, 0.8549993029008611, 0.843125, 0.83664680616978)}
LOSSES = [3.117157459259033, 5.38449764251709, 4.002053260803223, 2.142317056655884, 1.1419514417648315, 1.3822625875473022, 1.058942198753357, 1.3144967555999756, 1.1341969966888428, 0.6849731206893921, 0.4857545495033264, 0.46700266003608704, 0.7766109704971313, 0.41910025477409363, 0.7574078440666199, 0.6932990550994873, 0.41692256927490234, 0.7387667298316956, 0.2816595137119293, 0.29962965846061707, 0.24506334960460663, 0.5356600284576416, 0.48291274905204773, 0.37027251720428467, 0.372864305973053, 0.3502330183982849]


@pytest.fixture(scope="module")
def scores(spark):
    rows = [(m, o, i, j) for m, o, cm in (("baseline", 0, BASELINE), ("transfer", 1, TRANSFER)) for i, r in enumerate(cm) for j, n in enumerate(r) for _ in range(n)]
    pairs = spark.createDataFrame(rows, "model string, ordinal int, y_true int, y_pred int")
    return metrics.overall(metrics.confusion(pairs, 4, ["model", "ordinal"]), ["model", "ordinal"], digits=15)


def test_scores(scores):
    for r in scores.collect():
        assert (r.accuracy, r.macro_precision, r.macro_recall, r.macro_f1) == pytest.approx(SCORES[r.model], abs=1e-12)
        assert r.n == 1600


def test_winner(scores):
    w = metrics.select_winner(scores).first()
    assert (w.selected_model, w.is_tie, w.margin) == ("baseline", False, 0.0129)


def test_training_history(spark):
    h = spark.createDataFrame([(1, i + 1, v) for i, v in enumerate(LOSSES)], "run long, epoch long, value double")
    assert history.best_epoch(h).first().best_epoch == 21
    assert [r.epoch for r in history.checkpoints(h).orderBy("epoch").collect()] == [1, 4, 5, 7, 10, 11, 12, 14, 17, 19, 21]
    e = history.early_stop(h, 5).first()
    assert (e.stop_epoch, e.best_epoch) == (26, 21)
    rates = [r.learning_rate for r in history.lr_plateau(h).orderBy("epoch").collect()]
    assert [i + 1 for i in range(1, 26) if rates[i] != rates[i - 1]] == [4, 10, 17, 24, 26]
