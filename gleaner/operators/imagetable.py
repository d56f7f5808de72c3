"""Images as bytes in a column: metadata, pixels, statistics and fingerprints of a table, one row an image.

Each operator passes over the bytes once, in Arrow batches, and keeps the other columns. What is wrong with an image is
in its row's ``error``; nothing stops the job. The bytes themselves are dropped from the result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions import containers, images
from gleaner.operators import pixels as statistics

_KINDS = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "double": pa.float64(), "array<float>": pa.list_(pa.float32())}


def _over(files: DataFrame, content: str, columns: dict[str, str], one: Callable[..., tuple], keys: tuple[str, ...] = ()) -> DataFrame:
    """``columns`` (name to type) of each row's bytes by ``one(bytes, *keys)``, and ``error``; the rest of the row stays."""
    rest = [c for c in files.columns if c != content]
    clash = {*columns, "error"} & set(rest)
    if clash:
        raise ValueError(f"the table already has {', '.join(sorted(clash))}")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, errors = [], []
            for i, data in enumerate(b.column(content)):
                try:
                    found.append(one(data.as_py(), *(b.column(k)[i].as_py() for k in keys)))
                    errors.append(None)
                except ValueError as e:
                    found.append((None,) * len(columns))
                    errors.append(str(e))
            made = [pa.array([x[j] for x in found], _KINDS[kind]) for j, kind in enumerate(columns.values())]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), *made, pa.array(errors, pa.string())], [*rest, *columns, "error"])

    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema if f.name != content]
    return files.mapInArrow(rows, ", ".join([*kept, *(f"{n} {k}" for n, k in columns.items()), "error string"]))


def inspected(files: DataFrame, content: str = "content") -> DataFrame:
    """width, height, mode, channels and format of each whole image, or its error."""

    def one(data: bytes | None) -> tuple:
        info = containers.inspect(data)
        return info.width, info.height, info.mode, info.channels, info.format

    return _over(files, content, {"width": "int", "height": "int", "mode": "string", "channels": "int", "format": "string"}, one)


def decoded(files: DataFrame, content: str = "content", side: int | tuple[int, int] = images.SIDE, training: bool = False, seed: int = 42, epoch: int = 0, key: str | None = None) -> DataFrame:
    """``pixels`` float32[side * side * 3] in [0, 1]; for training augmented as (seed, epoch, ``key`` column) fix."""
    if training and key is None:
        raise ValueError("augmentation needs a key column")
    h, w = (side, side) if isinstance(side, int) else side

    def one(data: bytes | None, *name: str) -> tuple:
        x = images.bilinear(containers.decode(data).astype(np.float32) / np.float32(255), h, w)
        return ((images.augment(x, seed, epoch, str(name[0])) if training else x).ravel(),)

    return _over(files, content, {"pixels": "array<float>"}, one, (key,) if training else ())


def _statistics(rgb: np.ndarray) -> tuple[float, ...]:
    x = images.bounded(rgb).astype(np.float64) / 255
    high, spread = x.max(axis=2), x.max(axis=2) - x.min(axis=2)
    saturation = np.divide(spread, high, out=np.zeros_like(spread), where=high > 1e-6)
    light = x @ np.array(statistics.LUMINANCE)
    vivid = (saturation >= statistics.PIXEL_SATURATION) & (spread >= statistics.PIXEL_SPREAD)
    low, top = np.percentile(light, [1, 99])
    return tuple(float(v) for v in (saturation.mean(), np.percentile(saturation, 95), spread.mean(), vivid.mean(), light.std(), top - low))


def gated(files: DataFrame, content: str = "content") -> DataFrame:
    """The statistics of each image, no side of it above 512 pixels, and the ``verdict`` (colour, blank or pass; NULL with an error)."""
    names = ["mean_saturation", "p95_saturation", "mean_spread", "colourful_fraction", "intensity_std", "intensity_range"]
    stats = _over(files, content, dict.fromkeys(names, "double"), lambda data: _statistics(containers.decode(data)))
    return statistics.plausibility(stats).withColumn("verdict", F.when(F.col("error").isNull(), F.col("verdict")))


def fingerprinted(files: DataFrame, content: str = "content") -> DataFrame:
    """``fp``: the perceptual hash of each image, NULL with an error."""
    return _over(files, content, {"fp": "long"}, lambda data: (images.perceptual_hash(containers.decode(data) @ np.array([0.299, 0.587, 0.114])),))
