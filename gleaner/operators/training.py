"""Training, prediction and explanation of a network over rows (key, pixels, label), spread over tasks.

An epoch is one barrier stage: its tasks hold shares of every batch, which each epoch's order fixes whatever their number,
and add their gradients (and the moments of batch normalisation) by a ring all-reduce over sockets, so each moves about
twice the model's size a step and the driver nothing. All tasks then take the same optimiser step. The first one returns
weights and optimiser state at the epoch's end; a lost executor repeats the epoch from the driver's last state. Between
epochs the callbacks act: the best weights are kept (and saved), the rate is cut on a plateau, and training stops.
"""

from __future__ import annotations

import json
import pickle
import socket
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import network
from gleaner.functions.images import bilinear
from gleaner.functions.network import Layers, Weights
from gleaner.operators.splits import batches
from gleaner.workspace import Workspace, shuffle_width

#: Fixed values of the optimiser: decay of both moments, and what keeps its divisor from 0.
BETA1, BETA2, TINY = 0.9, 0.999, 1e-7
HISTORY = "epoch int, loss double, accuracy double, val_loss double, val_accuracy double, learning_rate double, saved boolean"


@dataclass
class Model:
    layers: Layers
    shape: tuple[int, ...]
    weights: Weights
    steps: int = 0
    moments: list[dict[str, tuple[np.ndarray, np.ndarray]]] = field(default_factory=list)

    @classmethod
    def new(cls, layers: Layers, shape: tuple[int, ...], seed: int = 42) -> Model:
        return cls(list(layers), tuple(shape), network.initial(layers, shape, seed))

    def save(self, spark: SparkSession, path: str) -> None:
        """A table: a row an array, and one of the layout. Replaces what is there once it is written."""
        rows = [(-1, json.dumps([self.layers, self.shape]), [], b"")]
        rows += [(i, name, list(a.shape), np.ascontiguousarray(a, "<f8").tobytes()) for i, w in enumerate(self.weights) for name, a in w.items()]
        spark.createDataFrame(rows, "layer int, name string, shape array<int>, data binary").coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Model:
        rows = spark.read.parquet(path).collect()  # a model's arrays
        layers, shape = json.loads(next(r.name for r in rows if r.layer < 0))
        weights: Weights = [{} for _ in layers]
        for r in rows:
            if r.layer >= 0:
                weights[r.layer][r.name] = np.frombuffer(r.data, "<f8").reshape(r.shape).copy()
        return cls([tuple(x) for x in layers], tuple(shape), weights)


class Ring:
    """All-reduce among the tasks of a barrier stage: each sends to the next and hears from the one before."""

    def __init__(self, ctx):
        infos = ctx.getTaskInfos()
        self.rank, self.size = ctx.partitionId(), len(infos)
        if self.size == 1:
            return
        with socket.create_server(("", 0), backlog=2) as server:
            told = ctx.allGather(json.dumps([server.getsockname()[1], uuid.uuid4().hex]))
            port, secret = json.loads(told[(self.rank + 1) % self.size])
            self.to = socket.create_connection((infos[(self.rank + 1) % self.size].address.split(":")[0], port), timeout=600)
            self.to.sendall(secret.encode())
            own = json.loads(told[self.rank])[1]
            server.settimeout(600)
            while True:
                self.of, _ = server.accept()
                self.of.settimeout(600)
                if self._read(self.of, len(own)) == own.encode():
                    break
                self.of.close()
        self.sender = ThreadPoolExecutor(1)

    @staticmethod
    def _read(from_: socket.socket, n: int) -> bytes:
        out = bytearray()
        while len(out) < n:
            part = from_.recv(min(n - len(out), 1 << 20))
            if not part:
                raise ConnectionError("a task of the barrier stage has ended")
            out += part
        return bytes(out)

    def total(self, values: np.ndarray) -> np.ndarray:
        """The sum over all tasks, the same bits in each."""
        if self.size == 1:
            return values
        x = np.array(values, np.float64)
        cut = [len(x) * i // self.size for i in range(self.size + 1)]
        part = lambda i: slice(cut[i % self.size], cut[i % self.size + 1])
        for step in range(2 * (self.size - 1)):
            out, into = part(self.rank - step), part(self.rank - step - 1)
            sent = self.sender.submit(self.to.sendall, x[out].tobytes())
            got = np.frombuffer(self._read(self.of, 8 * (into.stop - into.start)))
            x[into] = x[into] + got if step < self.size - 1 else got
            sent.result()
        return x

    def close(self) -> None:
        if self.size > 1:
            self.sender.shutdown()
            self.to.close()
            self.of.close()


def _kept_units(seed: int, epoch: int, keys: list[str]) -> Callable[[int, float, int], np.ndarray]:
    """Dropout that a row's key fixes, wherever the row is."""
    numbers = [int.from_bytes(str(k).encode(), "little") for k in keys]
    return lambda layer, rate, units: np.array([np.random.default_rng([seed, epoch, layer, n]).random(units) >= rate for n in numbers]).reshape(len(keys), units)


def step(model: Model, x: np.ndarray, label: np.ndarray, rows: int, rate: float, frozen: int, keep: Callable, total: Callable, hold_norms: bool = False) -> tuple[float, float]:
    """One optimiser step on this task's share of a batch of ``rows`` rows: the batch's loss and its right answers."""
    logits, held = network.forward(model.layers, model.weights, x, training=True, frozen=frozen, hold_norms=hold_norms, total=total, keep=keep)
    p = network.softmax(logits)
    dy = p.copy()
    dy[np.arange(len(p)), label] -= 1
    _, grads = network.backward(model.layers[frozen:], model.weights[frozen:], held[frozen:], dy / rows, total=total)
    names = [(i + frozen, n) for i, (kind, *_) in enumerate(model.layers[frozen:]) for n in network.trained_names(kind, hold_norms)]
    flat = np.concatenate([[network.cross_entropy(p, label).sum() if len(p) else 0.0, float((p.argmax(axis=1) == label).sum()) if len(p) else 0.0], *(grads[i - frozen][n].ravel() for i, n in names)])
    flat = total(flat)
    model.steps += 1
    if not model.moments:
        model.moments = [{} for _ in model.layers]
    scaled, at = rate * np.sqrt(1 - BETA2**model.steps) / (1 - BETA1**model.steps), 2
    for i, n in names:
        w = model.weights[i][n]
        g = flat[at : at + w.size].reshape(w.shape)
        at += w.size
        m, v = model.moments[i].get(n, (np.zeros_like(w), np.zeros_like(w)))
        m, v = BETA1 * m + (1 - BETA1) * g, BETA2 * v + (1 - BETA2) * g * g
        model.moments[i][n] = m, v
        model.weights[i][n] = w - scaled * m / (np.sqrt(v) + TINY)
    return float(flat[0]), float(flat[1])


def _arrays(b: pa.RecordBatch, at: int, shape: tuple[int, ...]) -> np.ndarray:
    return b.column(at).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, *shape)


def _epoch(ordered: DataFrame, n_rows: int, batch: int, model: Model, rate: float, frozen: int, hold_norms: bool, seed: int, epoch: int) -> tuple[Model, float, float]:
    """``ordered``: key, pixels, label, batch; partitions sorted by batch. The model after the epoch, its loss and accuracy."""
    sent = ordered.sparkSession.sparkContext.broadcast(pickle.dumps(model))
    steps = -(-n_rows // batch)

    def task(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import BarrierTaskContext

        ctx = BarrierTaskContext.get()
        ring, mine = Ring(ctx), pickle.loads(sent.value)

        def shares() -> Iterator[tuple[int, list[str], np.ndarray, np.ndarray]]:
            """This task's rows batch by batch."""
            now, held = 0, []
            for b in parts:
                of = b.column(3).to_numpy()
                for i in np.unique(of).tolist():
                    low, high = int(np.searchsorted(of, i)), int(np.searchsorted(of, i, "right"))
                    while now < i:
                        yield now, *joined(held)
                        now, held = now + 1, []
                    held.append(b.slice(low, high - low))
            while now < steps:
                yield now, *joined(held)
                now, held = now + 1, []

        def joined(held: list[pa.RecordBatch]):
            if not held:
                return [], np.zeros((0, *mine.shape)), np.zeros(0, np.int64)
            return [k for b in held for k in b.column(0).to_pylist()], np.concatenate([_arrays(b, 1, mine.shape) for b in held]), np.concatenate([b.column(2).to_numpy() for b in held]).astype(np.int64)

        loss = right = 0.0
        for i, keys, x, label in shares():
            one, ok = step(mine, x, label, min(batch, n_rows - i * batch), rate, frozen, _kept_units(seed, epoch, keys), ring.total, hold_norms)
            loss, right = loss + one, right + ok
        ring.close()
        if ring.rank == 0:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(mine)], pa.binary()), pa.array([loss]), pa.array([right])], ["model", "loss", "hits"])

    row = ordered.select("key", "pixels", "label", "batch").mapInArrow(task, "model binary, loss double, hits double", barrier=True).collect()[0]
    sent.destroy()
    return pickle.loads(row["model"]), row["loss"] / max(n_rows, 1), row["hits"] / max(n_rows, 1)


def evaluate(model: Model, data: DataFrame) -> tuple[float, float, int]:
    """(mean loss, accuracy, rows) of rows with pixels and label; sums only come back."""
    sent = data.sparkSession.sparkContext.broadcast(pickle.dumps(model))

    def sums(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = pickle.loads(sent.value)
        for b in parts:
            p, label = network.probabilities(mine.layers, mine.weights, _arrays(b, 0, mine.shape)), b.column(1).to_numpy().astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([network.cross_entropy(p, label).sum()]), pa.array([int((p.argmax(axis=1) == label).sum())]), pa.array([len(p)])], ["loss", "hits", "n"])

    r = data.select("pixels", "label").mapInArrow(sums, "loss double, hits long, n long").agg(F.sum("loss").alias("loss"), F.sum("hits").alias("hits"), F.sum("n").alias("n")).first()
    sent.destroy()
    n = int(r["n"] or 0)
    return (r["loss"] / n, r["hits"] / n, n) if n else (float("nan"), float("nan"), 0)


def train(model: Model, data: DataFrame, validation: DataFrame, epochs: int = 30, batch: int = 32, rate: float = 1e-3, stop_after: int = 5, cut_after: int = 2, factor: float = 0.5,
          floor: float = 1e-6, min_delta: float = 1e-4, frozen: int = 0, hold_norms: bool = False, seed: int = 42, workers: int | None = None, checkpoint: str | None = None) -> tuple[Model, DataFrame]:
    """The model with the weights of its best epoch (smallest validation loss), and the history, a row an epoch.

    ``data`` and ``validation``: key string (distinct), pixels array<float> of the model's shape, label int; rows without pixels
    take no part. Training stops after ``stop_after`` epochs without a new best; the rate is multiplied by ``factor`` after
    ``cut_after`` epochs that don't better the best by ``min_delta``, counted anew after a cut. Layers before ``frozen``
    stay as they are, and with ``hold_norms`` so does every normalisation. ``checkpoint``: where each best model is saved. ``workers``: tasks that must run at once.
    """
    spark = data.sparkSession
    work = Workspace(spark, "training")
    width = workers or min(shuffle_width(spark), spark.sparkContext.defaultParallelism)
    usable = lambda df: df.filter("pixels is not null").select(F.col("key").cast("string").alias("key"), "pixels", F.col("label").cast("int").alias("label"))
    rows, seen = work.stash(usable(data), "rows", n=F.count("*"))
    held_out = work.stash(usable(validation), "validation")
    n = int(seen["n"])
    if not n:
        raise ValueError("no rows to train on")
    best, best_loss, plateau, waited, stale, history = model, float("inf"), float("inf"), 0, 0, []
    for epoch in range(1, epochs + 1):
        # only keys are ranked; the pixels move once, to the task that holds their share
        order = batches(rows.select("key", F.md5(F.concat(F.lit(f"{seed}|{epoch}|"), "key")).alias("_turn")), ["_turn", "key"], batch).select("key", "batch")
        ordered = rows.join(order, "key").repartition(width, "key").sortWithinPartitions("batch", "key")
        model, loss, accuracy = _epoch(ordered, n, batch, model, rate, frozen, hold_norms, seed, epoch)
        val_loss, val_accuracy, _ = evaluate(model, held_out)
        saved = val_loss < best_loss
        history.append((epoch, loss, accuracy, val_loss, val_accuracy, rate, saved))
        if saved:
            best, best_loss, waited = model, val_loss, 0
            if checkpoint:
                best.save(spark, checkpoint)
        else:
            waited += 1
        if val_loss < plateau - min_delta:
            plateau, stale = val_loss, 0
        else:
            stale += 1
            if stale >= cut_after:
                rate, stale = max(rate * factor, floor), 0
        if waited >= stop_after:
            break
    work.close()
    return best, spark.createDataFrame(history, HISTORY)


def train_stages(model: Model, data: DataFrame, validation: DataFrame, open_layers: int, epochs: tuple[int, int] = (15, 15), rates: tuple[float, float] = (1e-3, 1e-5), checkpoint: str | None = None, **settings) -> tuple[Model, DataFrame, dict]:
    """Transfer in two stages: first the head alone, then also the last ``open_layers`` layers below it at a lower rate, with
    every normalisation held. The second stage's best model is taken where its loss is at most the first's.

    The model, the history of both (with ``stage``), and what was selected."""
    head = network.head_start(model.layers)
    settings.setdefault("stop_after", 4)
    fresh = lambda m: Model(m.layers, m.shape, m.weights)  # noqa: E731  a stage begins with an optimiser of its own
    first, told = train(fresh(model), data, validation, epochs[0], rate=rates[0], frozen=head, **settings)
    second, more = train(fresh(first), data, validation, epochs[1], rate=rates[1], frozen=max(0, head - open_layers), hold_norms=True, **settings)
    history = told.withColumn("stage", F.lit(1)).unionByName(more.withColumn("stage", F.lit(2)))
    best = {r["stage"]: r["best"] for r in history.groupBy("stage").agg(F.min("val_loss").alias("best")).collect()}  # two rows
    chosen = 2 if best[2] <= best[1] else 1
    out = second if chosen == 2 else first
    if checkpoint:
        out.save(data.sparkSession, checkpoint)
    return out, history, {"selected_stage": chosen, "best_val_loss": {f"stage{k}": v for k, v in sorted(best.items())}}


def model_summary(spark: SparkSession, model: Model, frozen: int = 0) -> DataFrame:
    """A row a layer: name, output shape, parameters and how many of them are trained."""
    return spark.createDataFrame(network.summary(model.layers, model.shape, frozen), "layer int, name string, output string, parameters long, trainable long")


def predict(model: Model, data: DataFrame, names: list[str] | None = None) -> DataFrame:
    """``data`` (with pixels and perhaps error) with prob, predicted, confidence, label_name; a bad row has its error instead."""
    return _each(model, data, names, explain=False)


def explain(model: Model, data: DataFrame, names: list[str] | None = None, side: tuple[int, int] | None = None, layer: int | None = None) -> DataFrame:
    """As ``predict``, with ``heat``: the class activation map at the input's size (or ``side``), row by row, at most 1."""
    return _each(model, data, names, explain=True, side=side, layer=layer)


def _each(model: Model, data: DataFrame, names: list[str] | None, explain: bool, side: tuple[int, int] | None = None, layer: int | None = None) -> DataFrame:
    sent = data.sparkSession.sparkContext.broadcast(pickle.dumps(model))  # lives as long as the result is read
    has_error = "error" in data.columns
    rest = [c for c in data.columns if c != "error"]
    size, classes = int(np.prod(model.shape)), network.shapes(model.layers, model.shape)[-1][0]
    if names is not None and len(names) != classes:
        raise ValueError(f"{len(names)} names for {classes} classes")

    def one(mine: Model, pixels) -> tuple:
        if pixels is None:
            raise ValueError("no pixels")
        if len(pixels) != size:
            raise ValueError(f"{len(pixels)} numbers for an input of {size}")
        x = np.asarray(pixels, np.float64).reshape(1, *mine.shape)
        if not np.isfinite(x).all():
            raise ValueError("an input that is not finite")
        if not explain:
            p, heat = network.probabilities(mine.layers, mine.weights, x)[0], None
        else:
            features, gradient, p, _ = network.activation_map(mine.layers, mine.weights, x, layer=layer)
            raw = np.maximum(features[0] @ gradient[0].mean(axis=(0, 1)), 0)
            want = tuple(side or mine.shape[:2])
            heat = raw if raw.shape == want else bilinear(raw[..., None], *want)[..., 0]
            top = heat.max()
            heat, p = (heat / top if top > 1e-8 else np.zeros_like(heat)).ravel(), p[0]
        if not np.isfinite(p).all() or (p < -1e-4).any() or (p > 1 + 1e-4).any():
            raise ValueError("the model's output is no row of probabilities")
        return np.clip(p, 0, 1), heat

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = pickle.loads(sent.value)
        for b in parts:
            before = b.column("error").to_pylist() if has_error else [None] * b.num_rows
            out: dict[str, list] = {"prob": [], "predicted": [], "confidence": [], "heat": [], "error": []}
            for i, error in enumerate(before):
                p = heat = None
                if error is None:
                    try:
                        p, heat = one(mine, b.column("pixels")[i].values)
                    except ValueError as e:
                        error = str(e)
                out["prob"].append(p)
                out["predicted"].append(None if p is None else int(p.argmax()))
                out["confidence"].append(None if p is None else float(p.max()))
                out["heat"].append(heat)
                out["error"].append(error)
            kinds = {"prob": pa.list_(pa.float64()), "predicted": pa.int32(), "confidence": pa.float64(), "heat": pa.list_(pa.float32()), "error": pa.string()}
            made = {k: pa.array(v, kinds[k]) for k, v in out.items() if explain or k != "heat"}
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), *made.values()], [*rest, *made])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in data.schema if f.name in rest)
    out = data.mapInArrow(rows, kept + ", prob array<double>, predicted int, confidence double" + (", heat array<float>" if explain else "") + ", error string")
    if names is None:
        return out
    return out.withColumn("label_name", F.get(F.array(*(F.lit(n) for n in names)), F.col("predicted")))
