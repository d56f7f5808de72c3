"""Connected components by minimum labels: local forests first, then one written table a round."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.workspace import Workspace

#: Edges that a task folds into one forest at a time.
FOLD = 1 << 20


def _forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest node of its component) that join the same nodes as the edges (u, v)."""
    node, where = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = where[: len(u)], where[len(u) :]
    root = np.arange(len(node))
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while not np.array_equal(up := root[root], root):
            root = up
        open_ = root[a] != root[b]
        a, b = a[open_], b[open_]
    far = root != np.arange(len(node))
    return node[far], node[root[far]]


def folded(batches):
    """Batches of edges (u, v) to forests that join the same nodes."""
    held, size = [], 0

    def emit():
        u, v = _forest(*(np.concatenate(x) for x in zip(*held, strict=True)))
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    for b in batches:
        held.append(tuple(b.column(c).to_numpy(zero_copy_only=False) for c in ("u", "v")))
        size += b.num_rows
        if size >= FOLD:
            yield emit()
            held, size = [], 0
    if size:
        yield emit()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """Rows (node, component): component is the smallest node reachable; nodes come from the edges only.

    Each task first replaces its edges by a forest of stars, which keeps what is connected. Each round then does the
    large-star step and the small-star step (Kiveris et al., 2014): neighbours are linked to the smallest node around
    them, so a chain of n nodes ends in O(log n) rounds. A node's neighbours are never gathered: each step is one
    minimum (partially aggregated) and one join on the node, which adaptive execution splits where a node has many.
    Ends when a round changes no edge; raises after ``max_rounds``. Rows with a NULL end are ignored.
    """
    work = Workspace(edges.sparkSession, "components")
    e = edges.select(F.col(src).cast("long").alias("u"), F.col(dst).cast("long").alias("v")).filter("u <> v").mapInArrow(folded, "u long, v long")
    marks = {"n": F.count(F.lit(1)), "mark": F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))}
    e, last = work.stash(e.distinct(), "e0", **marks)
    for i in range(1, max_rounds + 1):
        if not last["n"]:
            break
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2, "u").select(F.explode(F.array(
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("x"))
        e, now = work.stash(small.select("x.u", "x.v").filter("u <> v").distinct(), f"e{i}", **marks)
        work.discard(f"e{i - 1}")
        if now == last:
            break
        last = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionByName(roots)
