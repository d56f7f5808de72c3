"""Exact top-k by integer inner product on a bit-sliced index.

Components x of a vector become floor(scale * x), integers. A block of the index holds up to ``BLOCK`` different vectors:
each component, less the block's smallest value of it, is an unsigned attribute whose bits are kept as bitmaps over the
block's rows, one a slice. For a query:

1. Weighted sums are added with bitmap arithmetic: a slice of weight 2**i times a bit 2**j of the query's component is a
   bitmap at place i + j; full adders (three bitmaps of a place to one there and one at the next) leave one bitmap a place.
   A negative component takes the complement of its attribute. The lowest slices of wide attributes are left out of the
   sum: what they could add is at most ``slack``, known before.
2. The sum's bitmaps are walked from the most significant down, as the bits of the k-th largest sum: the rows that
   stay are those whose sum is at least that. Every row within ``slack`` of it, or of the k-th score found so far, is at
   the boundary.
3. Boundary rows are scored exactly from their integers; equal scores go to the smaller id.

Equal vectors are one row of the index with the k + 1 smallest ids of its rows (one may be the query's own), so that
copies, of which a third of the table may be, cost one row. Queries go in waves of at most ``WAVE_BYTES``, broadcast to
a scan of the index each; a task carries each query's k best from block to block and sends k rows a query at its end.

Defined results: vectors that are NULL or empty of numbers, or hold NULL, NaN or infinite components, take no part (an
empty vector is all zeros and does); a missing component counts as 0, so vectors may differ in length; rows without id are
candidates, after all others at equal scores, and no queries; each of several query rows with one id gets its own k
rows, and its own row is left out once; a query with fewer than k other rows gets all of them; empty tables give no rows;
other columns are ignored. Scores that could leave 64 bits, or components of 2**31 units and more, raise an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.workspace import Workspace

BLOCK, BLOCK_CELLS, WAVE_BYTES = 1 << 16, 1 << 23, 32 << 20
#: Slices of the widest attribute that are added; its lower ones are made good at the boundary.
SLICES = 6


def quantised(vectors: DataFrame, id_col: str, vec_col: str, scale: float) -> DataFrame:
    """(id, v): components as 32-bit integers, little end first, without the zeros at the end."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column(1)
            held = np.flatnonzero(np.asarray(column.is_valid()))
            if not len(held):
                continue
            lists = column.take(pa.array(held))
            flat, ends = lists.flatten(), np.cumsum(np.asarray(lists.value_lengths()).astype(np.int64))
            x = flat.to_numpy(zero_copy_only=False).astype(np.float64)  # NULL is NaN
            with np.errstate(over="ignore", invalid="ignore"):
                q = np.floor(scale * x)
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(x))])
            starts = np.concatenate([[0], ends[:-1]])
            ok = bad[ends] == bad[starts]
            keep = np.repeat(ok, ends - starts)
            if (np.abs(q[keep]) >= 2**31).any():
                raise ValueError("a component of 2**31 units or more: choose a smaller scale")
            q = np.where(keep, q, 0).astype("<i4")
            values = [q[s:e] for s, e, good in zip(starts, ends, ok, strict=True) if good]
            values = [v[: int(np.flatnonzero(v)[-1]) + 1] if v.any() else v[:0] for v in values]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(held[ok])), pa.array([v.tobytes() for v in values], pa.binary())], ["id", "v"])

    return vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("x")).mapInArrow(rows, "id long, v binary")


def _planes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(smallest value, bits, slices) of each attribute: slices are packed bitmaps, all of attribute 0 first, low to high."""
    low = values.min(axis=0)
    up = values - low
    bits = np.array([int(x).bit_length() for x in up.max(axis=0)], np.int64)
    pad = -len(values) % 64
    slices = [np.packbits(np.pad((up[:, j] >> i) & 1, (0, pad)).astype(np.uint8), bitorder="little") for j, n in enumerate(bits.tolist()) for i in range(n)]
    return low, bits, np.concatenate(slices) if slices else np.zeros(0, np.uint8)


def build_index(distinct: DataFrame) -> DataFrame:
    """Blocks of different vectors (v, ids): attribute values, bounds and slices, and each row's ids in order."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, cells = [], 0

        def put():
            dims = max((len(v) for v, _ in held), default=0) // 4
            values = np.zeros((len(held), dims), np.int64)
            for row, (v, _) in zip(values, held, strict=True):
                row[: len(v) // 4] = np.frombuffer(v, "<i4")
            low, bits, slices = _planes(values)
            return pa.RecordBatch.from_arrays(
                [pa.array([len(held)], pa.int32()), pa.array([values.astype("<i4").tobytes()], pa.binary()), pa.array([low.astype("<i8").tobytes()], pa.binary()),
                 pa.array([bits.astype("<i8").tobytes()], pa.binary()), pa.array([slices.tobytes()], pa.binary()), pa.array([[ids for _, ids in held]], pa.list_(pa.list_(pa.int64())))],
                ["n", "vals", "low", "bits", "slices", "ids"])

        for b in batches:
            for v, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if held and (len(held) == BLOCK or cells + len(v) // 4 > BLOCK_CELLS):
                    yield put()
                    held, cells = [], 0
                held.append((v, ids))
                cells += len(v) // 4
        if held:
            yield put()

    return distinct.select("v", "ids").mapInArrow(blocks, "n int, vals binary, low binary, bits binary, slices binary, ids array<array<long>>")


def add_bitmaps(places: list[np.ndarray]) -> list[np.ndarray]:
    """One bitmap a place from stacks of bitmaps: full adders pass their carries to the next place."""
    out, carried = [], []
    width = max((p.shape[1] for p in places), default=0)
    at = 0
    while at < len(places) or carried:
        stack = np.concatenate([*([places[at]] if at < len(places) and len(places[at]) else []), *carried]) if at < len(places) and len(places[at]) or carried else np.zeros((0, width), np.uint64)
        carried = []
        while len(stack) > 1:
            m = len(stack) // 3
            if m:
                a, b, c = stack[:m], stack[m : 2 * m], stack[2 * m : 3 * m]
                x = a ^ b
                carried.append((a & b) | (x & c))
                stack = np.concatenate([x ^ c, stack[3 * m :]]) if len(stack) > 3 * m else x ^ c
            else:
                carried.append(stack[:1] & stack[1:])
                stack = stack[:1] ^ stack[1:]
        out.append(stack[0] if len(stack) else np.zeros(width, np.uint64))
        at += 1
    return out


def kth_largest(sums: list[np.ndarray], every: np.ndarray, k: int) -> int:
    """The k-th largest of the rows' sums, most significant bitmap first; 0 if there are fewer rows."""
    above, equal, found = 0, every, 0
    for i in reversed(range(len(sums))):
        high = equal & sums[i]
        n = int(np.bitwise_count(high).sum())
        if above + n >= k:
            equal, found = high, found | 1 << i
        else:
            above += n
            equal = equal & ~sums[i]
    return found


def at_least(sums: list[np.ndarray], every: np.ndarray, least: int) -> np.ndarray:
    """The bitmap of the rows whose sum is at least ``least``."""
    if least <= 0:
        return every
    if least >> len(sums):
        return np.zeros_like(every)
    more, equal = np.zeros_like(every), every
    for i in reversed(range(len(sums))):
        if least >> i & 1:
            equal = equal & sums[i]
        else:
            more |= equal & sums[i]
            equal = equal & ~sums[i]
    return more | equal


class Block:
    """One block of the index, ready for queries."""

    def __init__(self, n: int, vals: bytes, low: bytes, bits: bytes, slices: bytes, ids: pa.ListScalar, added: int = SLICES):
        self.n, self.low, self.bits = n, np.frombuffer(low, "<i8"), np.frombuffer(bits, "<i8")
        self.dims = len(self.low)
        self.values = np.frombuffer(vals, "<i4").reshape(n, self.dims)
        words = -(-n // 64)
        self.slices = np.frombuffer(slices, np.uint64).reshape(-1, words) if len(slices) else np.zeros((0, words), np.uint64)
        self.complement = ~self.slices
        self.first = np.concatenate([[0], np.cumsum(self.bits)])
        self.every = np.full(words, 2**64 - 1, np.uint64)
        if n % 64:
            self.every[-1] = np.uint64((1 << n % 64) - 1)
        self.left_out = max(0, int(self.bits.max(initial=0)) - added)
        lists = ids.values
        self.id_at = np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths()))])
        flat = lists.flatten()
        self.no_id = np.asarray(flat.is_null())
        self.ids = flat.fill_null(0).to_numpy()
        #: for each slice that is added: its attribute and its place less the places left out
        self.attribute = np.repeat(np.arange(self.dims), np.maximum(self.bits - self.left_out, 0))
        self.slice = np.concatenate([np.arange(f + min(self.left_out, b), f + b) for f, b in zip(self.first[:-1], self.bits, strict=True)] or [np.zeros(0, np.int64)]).astype(np.int64)
        self.place = self.slice - self.first[self.attribute] - self.left_out if len(self.slice) else self.slice

    def boundary(self, query: np.ndarray, k: int, reached: int | None) -> np.ndarray:
        """Rows that may be among the k best, and may reach ``reached``."""
        d = min(self.dims, len(query))
        q = np.zeros(self.dims, np.int64)
        q[:d] = query[:d]
        weight, full = np.abs(q), (np.int64(1) << self.bits) - 1
        slack = int((weight * ((np.int64(1) << np.minimum(self.bits, self.left_out)) - 1)).sum())
        base = int((q * self.low).sum() - (weight * full)[q < 0].sum())
        w, negative = weight[self.attribute], q[self.attribute] < 0
        depth = int(weight.max(initial=0)).bit_length()
        bit, term = np.nonzero((w[None, :] >> np.arange(depth)[:, None]) & 1)
        place = bit + self.place[term]
        stacks = []
        for p in range(int(place.max(initial=-1)) + 1):
            here = term[place == p]
            turned = negative[here]
            stacks.append(np.concatenate([self.slices[self.slice[here[~turned]]], self.complement[self.slice[here[turned]]]]))
        sums = add_bitmaps(stacks)
        least = kth_largest(sums, self.every, k) - (slack >> self.left_out) if self.n >= k else 0
        if reached is not None:
            least = max(least, -((base + slack - reached) >> self.left_out))
        found = at_least(sums, self.every, least)
        return np.flatnonzero(np.unpackbits(found.view(np.uint8), count=self.n, bitorder="little"))

    def best(self, query: np.ndarray, own: int, k: int, reached: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(scores, whether the id is missing, ids): at least the block's k best rows, if they reach ``reached``."""
        rows = self.boundary(query, k + 1, reached)
        d = min(self.dims, len(query))
        scores = self.values[rows][:, :d].astype(np.int64) @ query[:d]
        if len(rows) > k + 1:
            near = scores >= np.partition(scores, -(k + 1))[-(k + 1)]
            rows, scores = rows[near], scores[near]
        n = self.id_at[rows + 1] - self.id_at[rows]
        at = np.repeat(self.id_at[rows], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        ids, no_id, scores, of = self.ids[at], self.no_id[at], np.repeat(scores, n), np.repeat(rows, n)
        for i in np.flatnonzero((ids == own) & ~no_id):
            if np.array_equal(self.values[of[i], :d], query[:d]) and not self.values[of[i], d:].any() and not query[d:].any():
                ids, no_id, scores = np.delete(ids, i), np.delete(no_id, i), np.delete(scores, i)
                break
        return scores, no_id, ids


def _merge(best: tuple | None, more: tuple, k: int) -> tuple:
    scores, no_id, ids = (np.concatenate(x) for x in zip(best, more, strict=True)) if best else more
    keep = np.lexsort((ids, no_id, -scores))[:k]
    return scores[keep], no_id[keep], ids[keep]


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vec_col: str = "embedding", slices: int = SLICES) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k rows of greatest integer inner product with each row where ``is_query``."""
    spark = vectors.sparkSession
    work = Workspace(spark, "bitslice")
    if k < 1:
        raise ValueError("k must be at least 1")
    rows = quantised(vectors, id_col, vec_col, scale)
    size = F.octet_length("v") / 4
    w = Window.partitionBy("v").orderBy(F.col("id").asc_nulls_last())
    few = rows.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k + 1)  # cut before the shuffle too
    distinct, seen = work.stash(few.groupBy("v").agg(F.expr("transform(array_sort(collect_list(struct(r, id))), x -> x.id)").alias("ids")), "distinct", dims=F.max(size))
    index = work.stash(build_index(distinct), "index")
    work.discard("distinct")
    asked, sizes = work.stash(quantised(vectors.filter(is_query & F.col(id_col).isNotNull()), id_col, vec_col, scale).withColumn("no", F.monotonically_increasing_id()), "queries", bytes=F.sum(F.octet_length("v") + 64))
    dims, total = int(seen["dims"] or 0), int(sizes["bytes"] or 0)
    waves = max(1, -(-total // WAVE_BYTES))
    out = None
    for wave in range(waves):
        mine = asked.filter(F.pmod(F.xxhash64("no"), F.lit(waves)) == wave).collect()  # a wave is of bounded size
        sent = work.broadcast([(r["no"], r["id"], bytes(r["v"])) for r in mine])

        def search(batches, sent=sent) -> Iterator[pa.RecordBatch]:
            queries = [(no, own, np.frombuffer(v, "<i4").astype(np.int64)) for no, own, v in sent.value]
            best: list[tuple | None] = [None] * len(queries)
            for b in batches:
                for i in range(b.num_rows):
                    block = Block(*(b.column(j)[i].as_py() for j in range(5)), b.column(5)[i], slices)
                    if dims * int(np.abs(block.values.astype(np.int64)).max(initial=0)) * max((int(np.abs(q).max(initial=0)) for _, _, q in queries), default=0) >= 2**62:
                        raise ValueError("scores may leave 64 bits: choose a smaller scale")
                    for j, (_, own, q) in enumerate(queries):
                        held = best[j]
                        best[j] = _merge(held, block.best(q, own, k, int(held[0][-1]) if held and len(held[0]) == k else None), k)
            for (no, own, _), held in zip(queries, best, strict=True):
                if held and len(held[0]):
                    n = len(held[0])
                    yield pa.RecordBatch.from_arrays([pa.array([no] * n, pa.int64()), pa.array([own] * n, pa.int64()), pa.array(held[2], pa.int64(), mask=held[1]), pa.array(held[0], pa.int64())], ["no", "query_id", "vec_id", "score"])

        found = work.stash(index.mapInArrow(search, "no long, query_id long, vec_id long, score long"), f"found{wave}")
        work.release()
        out = found if out is None else out.unionByName(found)
    w = Window.partitionBy("no").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
