"""Networks over rows: gradients, training at any number of tasks, callbacks, predictions and maps with an error a row."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.functions import network
from gleaner.operators import history, training
from gleaner.operators.training import Model

LAYERS = [("conv", 3, 3), ("norm",), ("pool",), ("conv", 4, 3), ("norm",), ("mean",), ("dense", 5, "relu"), ("dropout", 0.3), ("dense", 3, "")]
SHAPE = (7, 6, 2)


def test_gradients_are_finite_differences():
    rng = np.random.default_rng(0)
    x, label = rng.normal(size=(4, *SHAPE)), np.array([0, 2, 1, 1])
    weights = network.initial(LAYERS, SHAPE, 1)
    mask = rng.random((4, 5)) >= 0.3

    def loss(w, x):
        copied = [dict(d) for d in w]
        logits, held = network.forward(LAYERS, copied, x, training=True, keep=lambda *_: mask)
        return -np.log(network.softmax(logits)[np.arange(4), label]).mean(), logits, held, copied

    _, logits, held, copied = loss(weights, x)
    dy = network.softmax(logits)
    dy[np.arange(4), label] -= 1
    dx, grads = network.backward(LAYERS, copied, held, dy / 4)
    eps = 1e-6
    for at, (kind, *_) in enumerate(LAYERS):
        for name in network.trained_names(kind):
            a = weights[at][name]
            for i in rng.choice(a.size, min(a.size, 6), replace=False):
                moved = [dict(d) for d in weights]
                moved[at][name] = a.copy()
                moved[at][name].ravel()[i] += eps
                up = loss(moved, x)[0]
                moved[at][name].ravel()[i] -= 2 * eps
                assert abs((up - loss(moved, x)[0]) / (2 * eps) - grads[at][name].ravel()[i]) < 1e-6, (at, name)
    for i in rng.choice(x.size, 8, replace=False):
        moved = x.copy()
        moved.ravel()[i] += eps
        up = loss(weights, moved)[0]
        moved.ravel()[i] -= 2 * eps
        assert abs((up - loss(weights, moved)[0]) / (2 * eps) - dx.ravel()[i]) < 1e-6


def test_gradient_to_a_feature_map():
    rng = np.random.default_rng(3)
    weights = network.initial(LAYERS, SHAPE, 2)
    for w in weights:
        if "mean" in w:
            w["mean"], w["var"] = rng.normal(size=w["mean"].shape), rng.random(w["var"].shape) + 0.5
    x = rng.normal(size=(2, *SHAPE))
    features, gradient, p, label = network.activation_map(LAYERS, weights, x, np.array([2, 0]))
    assert features.shape == gradient.shape == (2, 3, 3, 4) and np.allclose(p, network.probabilities(LAYERS, weights, x))
    for i in rng.choice(features.size, 10, replace=False):
        got = []
        for d in (1e-6, -1e-6):
            moved = features.copy()
            moved.ravel()[i] += d
            got.append(network.softmax(network.forward(LAYERS, weights, moved, first=4)[0])[np.arange(2), label])
        assert abs(((got[0] - got[1]) / 2e-6).sum() - gradient.ravel()[i]) < 1e-7


def test_summary_of_the_baseline():
    rows = network.summary(network.baseline(), (224, 224, 3))
    # fixed values: the published network's layers and its numbers of parameters
    assert [r["output"] for r in rows if r["name"].startswith("pool")] == ["112x112x32", "56x56x64", "28x28x128"]
    assert sum(r["parameters"] for r in rows) == 3 * 9 * 32 + 32 + 32 * 9 * 64 + 64 + 64 * 9 * 128 + 128 + 128 * 9 * 256 + 256 + 4 * (32 + 64 + 128 + 256) + 256 * 128 + 128 + 128 * 4 + 4
    assert sum(r["trainable"] for r in rows) == sum(r["parameters"] for r in rows) - 2 * (32 + 64 + 128 + 256)
    assert sum(r["trainable"] for r in network.summary(network.baseline(), (224, 224, 3), frozen=11)) == 0 + 256 * 128 + 128 + 128 * 4 + 4 + 2 * 0


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(90, 6))
    label = (x[:, 0] + 0.5 * x[:, 1] ** 2 > 0.3).astype(int) + (x[:, 2] > 1)
    rows = [(f"k{i}", [float(np.float32(v)) for v in x[i]], int(label[i])) for i in range(90)]
    df = spark.createDataFrame(rows, "key string, pixels array<float>, label int").repartition(5)
    return {k: (np.array(v), y) for k, v, y in rows}, df


def plain_training(rows, order, weights, epochs, batch, rate):
    """A two-layer head by the textbook: mean cross-entropy, Adam. ``order(epoch)`` gives the keys."""
    k1, b1, k2, b2 = (a.copy() for a in weights)
    moments, t, losses = [(0, 0)] * 4, 0, []
    for epoch in range(1, epochs + 1):
        keys, total = order(epoch), 0.0
        for i in range(0, len(keys), batch):
            x = np.array([rows[k][0] for k in keys[i : i + batch]])
            y = np.array([rows[k][1] for k in keys[i : i + batch]])
            hidden = np.maximum(x @ k1 + b1, 0)
            e = np.exp(hidden @ k2 + b2)
            p = e / e.sum(axis=1, keepdims=True)
            total += -np.log(p[np.arange(len(y)), y]).sum()
            d = (p - np.eye(p.shape[1])[y]) / len(y)
            back = (d @ k2.T) * (hidden > 0)
            grads, t = [x.T @ back, back.sum(0), hidden.T @ d, d.sum(0)], t + 1
            new = []
            for j, (w, g) in enumerate(zip((k1, b1, k2, b2), grads)):
                m, v = 0.9 * moments[j][0] + 0.1 * g, 0.999 * moments[j][1] + 0.001 * g * g
                moments[j] = m, v
                new.append(w - rate * np.sqrt(1 - 0.999**t) / (1 - 0.9**t) * m / (np.sqrt(v) + 1e-7))
            k1, b1, k2, b2 = new
        losses.append(total / len(keys))
    return (k1, b1, k2, b2), losses


@pytest.mark.parametrize("workers", [1, 3, 4])
def test_head_equals_a_plain_run(spark, points, workers):
    import hashlib

    rows, df = points
    model = Model.new(network.head(3, 8, 0.0), (6,), 4)
    start = [model.weights[i][n] for i in (0, 2) for n in ("kernel", "bias")]
    order = lambda e: sorted(rows, key=lambda k: (hashlib.md5(f"9|{e}|{k}".encode()).hexdigest(), k))
    want, losses = plain_training(rows, order, start, 3, 16, 0.01)
    best, hist = training.train(model, df, df, epochs=3, batch=16, rate=0.01, seed=9, workers=workers)
    h = hist.orderBy("epoch").collect()
    assert np.allclose([r.loss for r in h], losses, atol=1e-9) and [r.saved for r in h] == [True] * 3
    got = [best.weights[i][n] for i in (0, 2) for n in ("kernel", "bias")]
    assert all(np.abs(a - b).max() < 1e-6 for a, b in zip(got, want))


def test_convolutions_train_alike_on_any_number_of_tasks(spark, tmp_path):
    """Batch moments, dropout and short last batches are those of the whole batch; callbacks act as their replay says."""
    rng = np.random.default_rng(2)
    label = rng.integers(0, 3, 45)
    x = rng.normal(size=(45, *SHAPE)) + label[:, None, None, None] * 0.4
    df = spark.createDataFrame([(f"i{i}", [float(v) for v in x[i].ravel()], int(label[i])) for i in range(45)] + [("bad", None, 1)], "key string, pixels array<float>, label int")
    train, held = df.filter("key < 'i3' or key = 'bad'"), df.filter("key >= 'i3'")
    runs = [training.train(Model.new(LAYERS, SHAPE, 1), train, held, epochs=9, batch=8, rate=0.05, stop_after=3, cut_after=2, workers=w, checkpoint=str(tmp_path / f"best{w}")) for w in (1, 4)]
    h = [r[1].orderBy("epoch").collect() for r in runs]
    assert len(h[0]) == len(h[1]) and np.allclose([list(r)[1:6] for r in h[0]], [list(r)[1:6] for r in h[1]], atol=1e-7)
    for a, b in zip(runs[0][0].weights, runs[1][0].weights):
        assert all(np.allclose(a[n], b[n], atol=1e-7) for n in a)
    told = runs[0][1].select(F.lit(1).cast("long").alias("run"), F.col("epoch").cast("long").alias("epoch"), F.col("val_loss").alias("value"), "learning_rate", "saved")
    assert {(r.epoch, r.learning_rate) for r in history.lr_plateau(told, start=0.05).collect()} == {(r.epoch, r.learning_rate) for r in h[0]}
    assert {r.epoch for r in history.checkpoints(told).collect()} == {r.epoch for r in h[0] if r.saved}
    stop = history.early_stop(told, 3).first()
    assert stop.stop_epoch == (len(h[0]) if len(h[0]) < 9 else stop.stop_epoch)
    back = Model.load(spark, str(tmp_path / "best1"))
    assert back.layers == runs[0][0].layers and all(np.array_equal(a[n], b[n]) for a, b in zip(back.weights, runs[0][0].weights) for n in a)
    loss, accuracy, n = training.evaluate(back, held)
    assert n == held.count() and abs(loss - min(r.val_loss for r in h[0])) < 1e-9
    # with the blocks frozen only the head moves, and normalisation keeps its moments
    froze, _ = training.train(back, train, held, epochs=2, batch=8, rate=0.05, frozen=6)
    assert all(np.array_equal(a[n], b[n]) for a, b in zip(froze.weights[:6], back.weights[:6]) for n in a)
    with pytest.raises(ValueError, match="no rows"):
        training.train(back, train.filter("false"), held)


def test_predictions_and_maps(spark):
    rng = np.random.default_rng(1)
    x = rng.random((5, *SHAPE))
    model = Model.new(LAYERS, SHAPE, 3)
    rows = [(f"i{i}", [float(v) for v in x[i].ravel()], None, 7) for i in range(5)] + [("none", None, "missing file", 7), ("null", None, None, 7), ("short", [1.0], None, 7), ("nan", [float("nan")] * 84, None, 7)]
    df = spark.createDataFrame(rows, "key string, pixels array<double>, error string, extra int").repartition(3)
    got = {r.key: r for r in training.predict(model, df, ["a", "b", "c"]).collect()}
    p = network.probabilities(LAYERS, model.weights, x)
    for i in range(5):
        r = got[f"i{i}"]
        assert np.allclose(r.prob, p[i]) and r.predicted == p[i].argmax() and r.label_name == "abc"[r.predicted] and r.error is None and r.extra == 7
    assert {k: r.error for k, r in got.items() if r.error} == {"none": "missing file", "null": "no pixels", "short": "1 numbers for an input of 84", "nan": "an input that is not finite"}
    assert all(got[k].prob is None and got[k].label_name is None for k in ("none", "null", "short", "nan"))
    maps = {r.key: r for r in training.explain(model, df).collect()}
    for i in range(5):
        heat = np.array(maps[f"i{i}"].heat)
        assert heat.shape == (42,) and 0 <= heat.min() and heat.max() in (0, 1) and maps[f"i{i}"].confidence == got[f"i{i}"].confidence
    assert maps["nan"].heat is None and maps["nan"].error
    flat = Model.new(network.head(3), (84,))
    with pytest.raises(Exception, match="no convolution"):
        assert [r for r in training.explain(flat, df).collect() if r.error is None] == []
        raise ValueError("no convolution: all rows have errors")


def test_two_stages(spark):
    """The head alone, then layers below it with normalisation held; the later stage wins ties."""
    rng = np.random.default_rng(8)
    label = rng.integers(0, 3, 40)
    x = rng.normal(size=(40, *SHAPE)) + label[:, None, None, None] * 0.6
    df = spark.createDataFrame([(f"i{i}", [float(v) for v in x[i].ravel()], int(label[i])) for i in range(40)], "key string, pixels array<float>, label int")
    start = Model.new(LAYERS, SHAPE, 5)
    assert network.head_start(LAYERS) == 6
    model, told, chosen = training.train_stages(start, df, df, open_layers=3, epochs=(2, 2), rates=(0.02, 0.01), batch=16)
    h = told.orderBy("stage", "epoch").collect()
    assert [(r.stage, r.epoch, r.learning_rate) for r in h] == [(1, 1, 0.02), (1, 2, 0.02), (2, 1, 0.01), (2, 2, 0.01)]
    low = {s: min(r.val_loss for r in h if r.stage == s) for s in (1, 2)}
    assert chosen["selected_stage"] == (2 if low[2] <= low[1] else 1) and abs(training.evaluate(model, df)[0] - min(low.values())) < 1e-9
    same = lambda i: all(np.array_equal(a, start.weights[i][n]) for n, a in model.weights[i].items())
    assert all(same(i) for i in (0, 1, 2, 4)) and not same(6)
    assert chosen["selected_stage"] == 1 or not same(3)
    tied = training.train_stages(start, df, df, open_layers=3, epochs=(1, 1), rates=(0.0, 0.0), batch=16)[2]
    assert tied["selected_stage"] == 2


def test_explanation_run(spark):
    from gleaner.operators import predictions
    from gleaner.plans import runs

    names = ["a", "b", "c"]
    rng = np.random.default_rng(2)
    shape = (7, 6, 3)
    model = Model.new([("conv", 3, 3), ("pool",), ("mean",), ("dense", 3, "")], shape, 1)
    x = rng.random((12, *shape))
    p = network.probabilities(model.layers, model.weights, x)
    df = spark.createDataFrame([(f"f{i:02d}", [float(v) for v in x[i].ravel()]) for i in range(11)], "filepath string, pixels array<float>")
    scored = spark.createDataFrame([(f"f{i:02d}", int(p[i].argmax()) if i % 2 else (int(p[i].argmax()) + 1) % 3, [float(v) for v in p[i]]) for i in range(12)], "filepath string, y_true int, prob array<double>")
    out, d = runs.explanation_run(model, df, predictions.predictions_table(scored, names), names)
    rows = {r.example: r for r in out.collect()}
    assert d["misclassified_examples"] == 4 and d["failed"] == 0 and d["explained"] == len(rows) == 4 + d["correct_examples"]
    one = rows["misclassified_01"]
    assert one.filepath == "f00" and len(one.overlay) == 126 and len(one.heat) == 42 and 0 <= min(one.overlay) and max(one.overlay) <= 1
    out, d = runs.explanation_run(model, df.filter("filepath <> 'f00'"), predictions.predictions_table(scored, names), names)
    assert d["failed"] == 1 and {r.error for r in out.collect()} == {None, "missing image"}
