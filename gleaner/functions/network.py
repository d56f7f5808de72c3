"""A small convolutional network on numpy arrays: the forward pass, and gradients to weights or to a feature map.

A network is a list of layers, each a tuple: ("conv", filters, side) with same padding and a rectifier, ("norm",) batch
normalisation, ("pool",) 2 x 2 maxima, ("mean",) over places, ("dense", units, "relu" or ""), ("dropout", rate). The
last layer's outputs are logits. Weights are a list of dicts of float64 arrays, one a layer. Sums over a batch go through
``total``, so a batch may be spread over tasks: every task then gets the figures of the whole batch.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: Fixed values of batch normalisation: what keeps of the running moments, and the variance's floor.
MOMENTUM, EPSILON = 0.99, 1e-3
Layers = list[tuple]
Weights = list[dict[str, np.ndarray]]


def baseline(classes: int = 4, filters: tuple[int, ...] = (32, 64, 128, 256), dense: int = 128, dropout: float = 0.4) -> Layers:
    """Blocks of convolution, normalisation and pooling (the last one unpooled), the mean, and a two-layer head."""
    blocks: Layers = []
    for i, f in enumerate(filters):
        blocks += [("conv", f, 3), ("norm",), *([("pool",)] if i + 1 < len(filters) else [])]
    return [*blocks, ("mean",), *head(classes, dense, dropout)]


def head(classes: int, dense: int = 128, dropout: float = 0.4) -> Layers:
    return [("dense", dense, "relu"), ("dropout", dropout), ("dense", classes, "")]


def shapes(layers: Layers, shape: tuple[int, ...]) -> list[tuple[int, ...]]:
    """The shape of each layer's output."""
    out = []
    for kind, *more in layers:
        if kind == "conv":
            shape = (*shape[:2], more[0])
        elif kind == "pool":
            shape = (shape[0] // 2, shape[1] // 2, shape[2])
        elif kind == "mean":
            shape = shape[2:]
        elif kind == "dense":
            shape = (more[0],)
        out.append(shape)
    return out


def initial(layers: Layers, shape: tuple[int, ...], seed: int = 42) -> Weights:
    """Uniform kernels by fan-in and fan-out, zero biases, unit scales."""
    rng, out = np.random.default_rng(seed), []
    for (kind, *more), before, after in zip(layers, [shape, *shapes(layers, shape)], shapes(layers, shape), strict=False):
        n, m = before[-1], after[-1]
        if kind == "conv":
            k, edge = more[1], np.sqrt(6 / (more[1] ** 2 * (n + m)))
            out.append({"kernel": rng.uniform(-edge, edge, (k, k, n, m)), "bias": np.zeros(m)})
        elif kind == "dense":
            edge = np.sqrt(6 / (n + m))
            out.append({"kernel": rng.uniform(-edge, edge, (n, m)), "bias": np.zeros(m)})
        elif kind == "norm":
            out.append({"scale": np.ones(n), "shift": np.zeros(n), "mean": np.zeros(n), "var": np.ones(n)})
        else:
            out.append({})
    return out


def trained_names(kind: str, hold_norms: bool = False) -> tuple[str, ...]:
    """The arrays of a layer that gradients change; running moments are not among them."""
    return {"conv": ("kernel", "bias"), "dense": ("kernel", "bias"), "norm": () if hold_norms else ("scale", "shift")}.get(kind, ())


def summary(layers: Layers, shape: tuple[int, ...], frozen: int = 0, hold_norms: bool = False) -> list[dict]:
    """A row a layer: name, output shape, parameters, and how many of them training changes."""
    rows = []
    for i, ((kind, *_), out, w) in enumerate(zip(layers, shapes(layers, shape), initial(layers, shape), strict=True)):
        trained = sum(w[n].size for n in trained_names(kind, hold_norms)) if i >= frozen else 0
        rows.append({"layer": i, "name": f"{kind}_{i}", "output": "x".join(map(str, out)), "parameters": sum(a.size for a in w.values()), "trainable": trained})
    return rows


def _windows(x: np.ndarray, side: int) -> list[tuple[tuple[int, int], np.ndarray]]:
    """The shifts of a same-padded input: one view a place of the kernel, so no patch is copied."""
    low = (side - 1) // 2
    wide = np.pad(x, ((0, 0), (low, side - 1 - low), (low, side - 1 - low), (0, 0)))
    h, w = x.shape[1:3]
    return [((i, j), wide[:, i : i + h, j : j + w]) for i in range(side) for j in range(side)]


def _pooled(x: np.ndarray) -> np.ndarray:
    n, h, w, c = x.shape
    return x[:, : h // 2 * 2, : w // 2 * 2].reshape(n, h // 2, 2, w // 2, 2, c).transpose(0, 1, 3, 5, 2, 4).reshape(n, h // 2, w // 2, c, 4)


def forward(layers: Layers, weights: Weights, x: np.ndarray, first: int = 0, training: bool = False, frozen: int = 0, hold_norms: bool = False, total: Callable = lambda v: v, keep: Callable | None = None) -> tuple[np.ndarray, list]:
    """Logits and what the reverse pass needs of each layer from ``first`` on.

    In training, layers from ``frozen`` on normalise by the batch's moments and update the running ones (not with
    ``hold_norms``), and ``keep(layer,
    rate, units)`` gives each row's kept units of a dropout layer."""
    held = []
    for at in range(first, len(layers)):
        (kind, *more), w, live = layers[at], weights[at], training and at >= frozen
        if kind == "conv":
            y = w["bias"] + sum(v @ w["kernel"][ij] for ij, v in _windows(x, more[1]))
            y = np.maximum(y, 0)
            held.append((x, y))
        elif kind == "norm":
            if live and not hold_norms:
                flat = x.reshape(-1, x.shape[-1])
                sums = total(np.concatenate([flat.sum(axis=0), (flat * flat).sum(axis=0), [len(flat)]]))
                n, c = max(sums[-1], 1), x.shape[-1]
                mean, var = sums[:c] / n, np.maximum(sums[c : 2 * c] / n - (sums[:c] / n) ** 2, 0)
                w["mean"], w["var"] = w["mean"] * MOMENTUM + mean * (1 - MOMENTUM), w["var"] * MOMENTUM + var * (1 - MOMENTUM)
            else:
                mean, var, n = w["mean"], w["var"], 0
            inverse = 1 / np.sqrt(var + EPSILON)
            unit = (x - mean) * inverse
            y = unit * w["scale"] + w["shift"]
            held.append((unit, inverse, n))
        elif kind == "pool":
            four = _pooled(x)
            y = four.max(axis=-1)
            held.append((x.shape, four.argmax(axis=-1)))
        elif kind == "mean":
            y = x.mean(axis=(1, 2))
            held.append(x.shape)
        elif kind == "dense":
            y = x @ w["kernel"] + w["bias"]
            y = np.maximum(y, 0) if more[1] == "relu" else y
            held.append((x, y))
        else:
            mask = keep(at, more[0], x.shape[-1]) / (1 - more[0]) if live and more[0] > 0 and keep else None
            y = x if mask is None else x * mask
            held.append(mask)
        x = y
    return x, held


def backward(layers: Layers, weights: Weights, held: list, dy: np.ndarray, first: int = 0, total: Callable = lambda v: v) -> tuple[np.ndarray, Weights]:
    """The gradient to the input of layer ``first``, and to the weights from there on, for ``dy`` of the logits."""
    grads: Weights = [{} for _ in layers]
    for at in range(len(layers) - 1, first - 1, -1):
        (kind, *more), w, mine = layers[at], weights[at], held[at - first]
        if kind == "conv":
            x, y = mine
            dy = dy * (y > 0)
            dk, low, side = np.empty_like(w["kernel"]), (more[1] - 1) // 2, more[1]
            n, h, wd, c = x.shape
            wide = np.zeros((n, h + side - 1, wd + side - 1, c))
            for (i, j), v in _windows(x, side):
                dk[i, j] = v.reshape(-1, c).T @ dy.reshape(-1, dy.shape[-1])
                wide[:, i : i + h, j : j + wd] += dy @ w["kernel"][i, j].T
            grads[at] = {"kernel": dk, "bias": dy.reshape(-1, dy.shape[-1]).sum(axis=0)}
            dy = wide[:, low : low + h, low : low + wd]
        elif kind == "norm":
            unit, inverse, n = mine
            axes = tuple(range(dy.ndim - 1))
            grads[at] = {"scale": (dy * unit).sum(axis=axes), "shift": dy.sum(axis=axes)}
            dy = dy * w["scale"]
            if n:
                c = dy.shape[-1]
                sums = total(np.concatenate([dy.sum(axis=axes), (dy * unit).sum(axis=axes)]))
                dy = dy - sums[:c] / n - unit * sums[c:] / n
            dy = dy * inverse
        elif kind == "pool":
            (n, h, wd, c), best = mine
            four = np.zeros((*best.shape, 4))
            np.put_along_axis(four, best[..., None], dy[..., None], axis=-1)
            dx = np.zeros((n, h, wd, c))
            dx[:, : h // 2 * 2, : wd // 2 * 2] = four.reshape(n, h // 2, wd // 2, c, 2, 2).transpose(0, 1, 4, 2, 5, 3).reshape(n, h // 2 * 2, wd // 2 * 2, c)
            dy = dx
        elif kind == "mean":
            dy = np.broadcast_to(dy[:, None, None, :] / (mine[1] * mine[2]), mine)
        elif kind == "dense":
            x, y = mine
            dy = dy * (y > 0) if more[1] == "relu" else dy
            grads[at] = {"kernel": x.T @ dy, "bias": dy.sum(axis=0)}
            dy = dy @ w["kernel"].T
        elif mine is not None:
            dy = dy * mine
    return dy, grads


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=1, keepdims=True)) if logits.size else logits
    return e / e.sum(axis=1, keepdims=True) if logits.size else e


def probabilities(layers: Layers, weights: Weights, x: np.ndarray) -> np.ndarray:
    return softmax(forward(layers, weights, x)[0])


def cross_entropy(p: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Of each row, with probabilities kept from 0."""
    return -np.log(np.clip(p[np.arange(len(p)), label], 1e-7, 1))


def head_start(layers: Layers) -> int:
    """Where the head begins: after the last layer that keeps places."""
    at = [i for i, x in enumerate(layers) if x[0] in ("conv", "norm", "pool", "mean")]
    return at[-1] + 1 if at else 0


def last_conv(layers: Layers) -> int:
    at = [i for i, x in enumerate(layers) if x[0] == "conv"]
    if not at:
        raise ValueError("the network has no convolution")
    return at[-1]


def activation_map(layers: Layers, weights: Weights, x: np.ndarray, label: np.ndarray | None = None, layer: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(feature maps, gradients to them, probabilities, labels) of a batch: the gradient of each row's probability of its label
    (its most probable class if none is given) to the output of a convolution, by default the last."""
    layer = last_conv(layers) if layer is None else layer
    features, _ = forward(layers[: layer + 1], weights[: layer + 1], x)
    logits, held = forward(layers, weights, features, first=layer + 1)
    p = softmax(logits)
    label = p.argmax(axis=1) if label is None else label
    one = np.zeros_like(p)
    one[np.arange(len(p)), label] = 1
    score = p[np.arange(len(p)), label][:, None]
    gradient, _ = backward(layers, weights, held, score * (one - p), first=layer + 1)
    return features, gradient, p, label
