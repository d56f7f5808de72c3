"""Merged partition count-min sketches, kept as bitmaps of the cells whose count reaches given thresholds.

A partition sends its occupied cells with counts, dealt by cell range; each range is summed in one dense array of
fixed size, so memory doesn't grow with the data. The driver gets one bitmap a threshold and sketch row, of
2**fold bits whatever the input. A count is never underestimated, so a key that reaches a threshold is always
marked; a crowded sketch marks more keys than it must and the exact pass that follows has more to do.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gleaner.workspace import shuffles_removed

#: 2**CELL_BITS cells a sketch row, in ranges of 2**RANGE_BITS.
CELL_BITS, RANGE_BITS = 32, 24
FLUSH = 2_000_000


def cells(keys: np.ndarray, row: int) -> np.ndarray:
    return (keys >> np.uint64(32) if row == 0 else keys & np.uint64(0xFFFFFFFF)).astype(np.uint32)


class Marks:
    """What the driver broadcasts: a bitmap for each sketch row and threshold, in zlib-packed pieces until it is used."""

    def __init__(self, thresholds: list[int], rows: int, folds: list[int], pieces: dict[tuple[int, int, int], bytes], marked: int = 0):
        """``pieces``: (threshold's place, row, range) to packed bits; ranges without marks are left out. ``marked``: how
        many of the sketched keys, repeats included, fell in marked cells of the first threshold and row."""
        self.thresholds, self.rows, self.folds, self.pieces, self.marked = thresholds, rows, folds, pieces, marked
        self._maps: dict[tuple[int, int], np.ndarray] = {}

    def __getstate__(self):
        return self.thresholds, self.rows, self.folds, self.pieces, self.marked

    def __setstate__(self, state):
        self.__init__(*state)

    def _map(self, at: int, row: int) -> np.ndarray:
        if (at, row) not in self._maps:
            bits = self._maps[at, row] = np.zeros(1 << (self.folds[at] - 3), np.uint8)
            for (a, r, b), packed in self.pieces.items():
                if (a, r) == (at, row):
                    piece = np.frombuffer(zlib.decompress(packed), np.uint8)
                    bits[b * len(piece) : (b + 1) * len(piece)] |= piece
        return self._maps[at, row]

    def reach(self, keys: np.ndarray, at: int = 0) -> np.ndarray:
        """Which keys may have a count of at least thresholds[at]."""
        out = None
        for row in range(self.rows):
            c = cells(keys, row) >> np.uint32(CELL_BITS - self.folds[at])
            hit = (self._map(at, row)[c >> np.uint32(3)] >> (c & np.uint32(7)).astype(np.uint8)) & np.uint8(1)
            out = hit if out is None else out & hit
        return out.astype(bool)


def mark_repeated(df: DataFrame, keys_of: Callable[[pa.RecordBatch], Iterator[np.ndarray]], thresholds: list[int], rows: int, folds: list[int]) -> Marks:
    """Sketch the 64-bit keys that ``keys_of`` finds in each batch of ``df``; ``folds``: log2 bits of each threshold's map."""
    ranges = 1 << (CELL_BITS - RANGE_BITS)

    def emit(held: list[np.ndarray]):
        keys = np.concatenate(held)
        for row in range(rows):
            c, n = np.unique(cells(keys, row), return_counts=True)
            cut = np.searchsorted(c, np.arange(1, ranges, dtype=np.uint64) << np.uint64(RANGE_BITS))
            cc, nn = np.split(c, cut), np.split(n.astype(np.uint32), cut)
            full = [b for b in range(ranges) if len(cc[b])]
            yield pa.RecordBatch.from_arrays([
                pa.array([row * ranges + b for b in full], pa.int32()),
                pa.array([cc[b].tobytes() for b in full], pa.binary()),
                pa.array([nn[b].tobytes() for b in full], pa.binary())], ["part", "cells", "counts"])

    def local(batches):
        held, n = [], 0
        for b in batches:
            for keys in keys_of(b):
                held.append(keys)
                n += len(keys)
                if n >= FLUSH:
                    yield from emit(held)
                    held, n = [], 0
        if n:
            yield from emit(held)

    low = [CELL_BITS - f for f in folds]

    def merge(batches):
        """One range at a time: rows come sorted by part. Few cells are sorted; more are summed in a dense array."""
        part, held, n_held, dense = -1, [], 0, None

        def settle():
            c = np.concatenate([x for x, _ in held])
            n = np.concatenate([x for _, x in held])
            order = np.argsort(c, kind="stable")
            c, n = c[order], n[order]
            at = np.flatnonzero(np.diff(c, prepend=c[0] ^ np.uint32(1)))
            return c[at], np.add.reduceat(n, at)

        def done():
            if dense is None:
                c, n = settle()
            else:
                c = np.flatnonzero(dense).astype(np.uint32)
                n = dense[c]
            found = []
            for at, t in enumerate(thresholds):
                bits = np.zeros(1 << max(RANGE_BITS - low[at], 3), bool)
                bits[c[n >= t] >> np.uint32(low[at])] = True
                found.append((part, at, int(n[n >= t].sum()), zlib.compress(np.packbits(bits, bitorder="little").tobytes(), 1)))
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], kind) for i, kind in enumerate((pa.int32(), pa.int32(), pa.int64(), pa.binary()))], ["part", "at", "marked", "bits"])

        for b in batches:
            for p, c, n in zip(b.column("part").to_pylist(), b.column("cells"), b.column("counts"), strict=True):
                if p != part:
                    if part >= 0:
                        yield done()
                    part, held, n_held, dense = p, [], 0, None
                held.append((np.frombuffer(c.as_buffer(), np.uint32) & np.uint32((1 << RANGE_BITS) - 1), np.frombuffer(n.as_buffer(), np.uint32)))
                n_held += len(held[-1][0])
                if n_held > 1 << 21:
                    dense = np.zeros(1 << RANGE_BITS, np.uint32) if dense is None else dense
                    for at, more in held:
                        dense[at] += more
                    held, n_held = [], 0
            if dense is not None and held:
                for at, more in held:
                    dense[at] += more
                held, n_held = [], 0
        if part >= 0:
            yield done()

    width = min(rows * ranges, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sent = df.mapInArrow(local, "part int, cells binary, counts binary")
    merged = sent.repartition(width, "part").sortWithinPartitions("part").mapInArrow(merge, "part int, at int, marked long, bits binary")
    pieces, marked = {}, 0
    with shuffles_removed(df.sparkSession):
        found = merged.collect()
    for x in found:  # packed bitmaps of a fixed total size
        row, b = divmod(x["part"], ranges)
        pieces[x["at"], row, b] = bytes(x["bits"])
        marked += x["marked"] if x["at"] == row == 0 else 0
    return Marks(thresholds, rows, folds, pieces, marked)
