"""Input batches from a manifest, and single images through a trained head, with every failure kept in its row."""

from __future__ import annotations

from collections.abc import Callable
from os.path import commonprefix

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions.containers import decode
from gleaner.functions.images import SIDE
from gleaner.functions.scalar import IMAGE_GLOB
from gleaner.operators.imagetable import decoded
from gleaner.operators.splits import batches, shuffled
from gleaner.workspace import Workspace


def build_dataset(manifest: DataFrame, batch_size: int = 32, training: bool = False, seed: int = 42, epoch: int = 0, side: int = SIDE) -> DataFrame:
    """(batch, path, label_id, pixels, error) of a loaded manifest (path, label_id): read, decoded, scaled and batched.

    Training input is put in a new order each epoch and augmented; both follow from ``seed`` and ``epoch``. Otherwise batches
    go by path. An image that can't be decoded keeps its place with NULL pixels and the error.
    """
    spark = manifest.sparkSession
    placed = manifest.withColumn("_turn", F.md5(F.concat(F.lit(f"{seed}|{epoch}|"), F.col("path")))) if training else manifest.withColumn("_turn", F.lit(""))
    dealt = Workspace(spark, "dataset").stash(batches(placed, ["_turn", "path"], batch_size).drop("_turn"), "batches")
    ends = dealt.agg(F.min("path"), F.max("path")).first()  # what these two have in common all paths have
    if ends[0] is None:
        return dealt.select("batch", "path", "label_id", F.lit(None).cast("array<float>").alias("pixels"), F.lit(None).cast("string").alias("error"))
    root = commonprefix(list(ends)).rpartition("/")[0] or "/"
    plain = lambda c: F.regexp_replace(c, "^file:/+", "/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", IMAGE_GLOB).load(root).select(plain("path").alias("_path"), "content")
    # only files that the manifest names are joined and decoded; what a shuffle moves is their bytes, not pixels
    joined = dealt.join(files, plain("path") == F.col("_path"), "left").withColumn("_found", F.col("_path").isNotNull()).drop("_path")
    out = decoded(joined, side=side, training=training, seed=seed, epoch=epoch, key="path")
    return out.select("batch", "path", "label_id", "pixels", F.when(~F.col("_found"), "missing file").otherwise(F.col("error")).alias("error"))


def epochs(manifest: DataFrame, n: int, seed: int = 42) -> list[DataFrame]:
    """The manifest in each epoch's order."""
    return [shuffled(manifest, seed, e, "path") for e in range(n)]


def image_row(source: bytes | str | np.ndarray) -> tuple[int, int, int, bytes]:
    """(height, width, channels, rows of B, G, R or gray bytes) of an array (RGB or gray), or of the bytes or path of an image
    file; ValueError where it is none."""
    if isinstance(source, np.ndarray):
        x = np.asarray(source, np.uint8)
        if x.ndim == 2:
            return x.shape[0], x.shape[1], 1, x.tobytes()
        if x.ndim != 3 or x.shape[2] not in (3, 4):
            raise ValueError("an image array is (h, w) or (h, w, 3)")
        return x.shape[0], x.shape[1], 3, np.ascontiguousarray(x[:, :, 2::-1]).tobytes()
    x = decode(source if isinstance(source, bytes) else open(source, "rb").read())
    return x.shape[0], x.shape[1], 3, np.ascontiguousarray(x[:, :, ::-1]).tobytes()


def predict_image(source: bytes | str | np.ndarray, predict: Callable[[np.ndarray], np.ndarray], names: list[str], side: int = SIDE) -> dict:
    """label, label_id, confidence and probabilities of one image; ``predict`` maps (1, side, side, 3) to (1, classes).

    Probabilities must be finite and within [0, 1] up to 1e-4 (ValueError); they are then clipped.
    """
    from gleaner.functions.images import preprocess, to_rgb

    p = np.asarray(predict(preprocess(to_rgb(*image_row(source)), side)[None]), float)
    if p.shape != (1, len(names)) or not np.isfinite(p).all() or (p < -1e-4).any() or (p > 1 + 1e-4).any():
        raise ValueError("the model's output is no row of probabilities")
    p = np.clip(p[0], 0, 1)
    best = int(p.argmax())
    return {"label": names[best], "label_id": best, "confidence": float(p[best]), "probabilities": dict(zip(names, p.tolist(), strict=True))}


def explain_image(source: bytes | str | np.ndarray, explain: Callable[[np.ndarray], np.ndarray], side: int = SIDE) -> dict:
    """success, heat and overlay of one image, or success = False with the error: never raises."""
    from gleaner.functions.images import overlay, preprocess, to_rgb

    try:
        rgb = preprocess(to_rgb(*image_row(source)), side)
        heat = np.asarray(explain(rgb[None]), float)
        if heat.ndim != 2 or not np.isfinite(heat).all():
            raise ValueError("a heat map is a finite matrix")
        return {"success": True, "heat": heat, "overlay": overlay(rgb, heat), "error": None}
    except Exception as e:  # the row's error is its result
        return {"success": False, "heat": None, "overlay": None, "error": f"{type(e).__name__}: {e}"}
