"""Ranked lexical search on a two-level quantised index.

Terms are runs of ASCII letters and digits and of all characters beyond ASCII, A-Z lower-cased. With N documents that hold
terms and L terms in them, a document of n terms has m = 100 - LENGTH + (LENGTH * n * N) div L; a term it holds tf times
weighs g = (UNIT * tf) div (1000 * tf + 8 * m), less than 1 000 000. A term of a query held by df documents has the weight
w = floor(1000 * ln((2 * N + 2) / (2 * df + 1))), and a document's score is the sum of w * g over the query's terms.

The index is a table of blocks, each of whole documents (about ``INDEX_BYTES`` of text) with their postings by term:

* level 1: document numbers and one byte a posting, g * 255 / 1 000 000 rounded up, from which the scores of all documents of
  a block are bounded from above and below without their counts;
* level 2: tf and n, read only to score exactly.

A query scans the blocks. In each, documents whose upper bound stays below the k-th best score so far, or the k-th
largest lower bound of the block, are passed over; every other one is scored in exact integers. A task carries the k
best of each query from block to block and sends them at its end. Queries go in waves of at most ``WAVE`` items and
``WAVE_BYTES`` of text, broadcast to one scan of the index each; their df comes from a scan of the blocks' term lists.

Defined results: NULL and termless texts match nothing, and don't count in N; rows are documents and items, also where
their ids are NULL or repeated (each such item gets its own ranks; rows without doc_id come last at equal scores); empty
tables give no rows; other columns are ignored. Weights beyond what 64 bits hold raise an error.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.textkernel import ALNUM, class_terms, slices
from gleaner.workspace import Workspace

LENGTH, UNIT, MOST = 75, 1_000_000_000, 1_000_000
INDEX_BYTES, WAVE, WAVE_BYTES = 2 << 20, 20_000, 32 << 20
_INDEX = "docs array<long>, terms array<string>, starts binary, place binary, impact binary, tf binary, m binary"
#: What a byte says of g: at most UPPER, at least LOWER.
UPPER = np.arange(256, dtype=np.int64) * MOST // 255
LOWER_G = np.where(np.arange(256) > 0, (np.arange(256, dtype=np.int64) - 1) * MOST // 255 + 1, 0)


def length_norm(n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """100 - LENGTH + (LENGTH * n * n_docs) div n_terms, by long division where the product would leave 64 bits."""
    quotient, rest = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
    for at in (48, 32, 16, 0):
        rest = rest * 65536 + LENGTH * n * (n_docs >> at & 65535)
        quotient = quotient * 65536 + rest // n_terms
        rest %= n_terms
    return 100 - LENGTH + quotient


def gain(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return UNIT * tf // (1000 * tf + 8 * m)


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    docs = terms = 0
    for b in batches:
        for _, _, data, offsets in slices(b.column(0)):
            n = np.diff(class_terms(data, offsets, ALNUM)[2])
            docs, terms = docs + int((n > 0).sum()), terms + int(n.sum())
    yield pa.RecordBatch.from_pydict({"docs": pa.array([docs], pa.int64()), "terms": pa.array([terms], pa.int64())})


class LexicalIndex:
    """An index of documents in a workspace, or under ``path`` to be kept and opened again with ``LexicalIndex.open``."""

    def __init__(self, blocks: DataFrame, n_docs: int, n_terms: int, work: Workspace):
        self.blocks, self.n_docs, self.n_terms, self.work = blocks, n_docs, n_terms, work

    @classmethod
    def build(cls, docs: DataFrame, text: str = "text", id_col: str = "doc_id", path: str | None = None) -> LexicalIndex:
        work = Workspace(docs.sparkSession, "lexical")
        read = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))
        sums = read.select("text").mapInArrow(_sizes, "docs long, terms long").agg(F.sum("docs"), F.sum("terms")).first()
        n_docs, n_terms = int(sums[0] or 0), int(sums[1] or 0)

        def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for first, last, data, offsets in slices(b.column(1), INDEX_BYTES):
                    terms, codes, at = class_terms(data, offsets, ALNUM)
                    if not len(codes):
                        continue
                    n = np.diff(at)
                    m = length_norm(n, n_docs, n_terms)
                    keys, tf = np.unique(codes.astype(np.int64) << 32 | np.repeat(np.arange(last - first), n), return_counts=True)
                    place, starts = (keys & 0xFFFFFFFF).astype("<u4"), np.searchsorted(keys >> 32, np.arange(len(terms) + 1)).astype("<u4")
                    byte = -(-gain(tf, m[place]) * 255 // MOST)
                    packed = [x.tobytes() for x in (starts, place, byte.astype(np.uint8), tf.astype("<u4"), m.astype("<i8"))]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([b.column(0).slice(first, last - first).to_pylist()], pa.list_(pa.int64())), pa.ListArray.from_arrays(pa.array([0, len(terms)], pa.int32()), terms), *(pa.array([x], pa.binary()) for x in packed)],
                        ["docs", "terms", "starts", "place", "impact", "tf", "m"])

        made = read.mapInArrow(blocks, _INDEX)
        if path is None:
            return cls(work.stash(made, "index"), n_docs, n_terms, work)
        made.withColumn("n_docs", F.lit(n_docs).cast("long")).withColumn("n_terms", F.lit(n_terms).cast("long")).write.option("compression", "zstd").parquet(path)
        return cls.open(docs.sparkSession, path)

    @classmethod
    def open(cls, spark, path: str) -> LexicalIndex:
        kept = spark.read.parquet(path)
        sums = kept.agg(F.max("n_docs"), F.max("n_terms")).first()
        return cls(kept, int(sums[0] or 0), int(sums[1] or 0), Workspace(spark, "lexical"))

    def frequencies(self, terms: list[str]) -> dict[str, int]:
        """In how many documents each of the given terms occurs; terms in none are left out. Reads terms and postings' places."""
        sent = self.work.broadcast(terms)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            wanted = pa.array(sent.value, pa.string())
            found = np.zeros(len(wanted), np.int64)
            for b in batches:
                for i in range(b.num_rows):
                    at = pc.index_in(b.column(0)[i].values, value_set=wanted)
                    here = np.flatnonzero(np.asarray(at.is_valid()))
                    found[at.drop_null().to_numpy()] += np.diff(np.frombuffer(b.column(1)[i].as_buffer(), "<u4").astype(np.int64))[here]
            some = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(found[some])], ["term", "df"])

        rows = self.blocks.select("terms", "starts").mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()  # a wave's terms
        return {terms[r["term"]]: r["df"] for r in rows}

    def weight(self, df: int) -> int:
        return math.floor(1000 * math.log((2 * self.n_docs + 2) / (2 * df + 1)))

    def search(self, items: DataFrame, k: int = 10, text: str = "text", id_col: str = "item_id") -> DataFrame:
        """item_id, rank (from 1), doc_id, score: each item's k documents of highest score above 0, equal scores by doc_id."""
        size = F.coalesce(F.octet_length(text), F.lit(0)) + 64
        asked, sizes = self.work.stash(items.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text")).withColumn("no", F.monotonically_increasing_id()), "items", bytes=F.sum(size), rows=F.count("*"))
        waves = max(1, -(-int(sizes["rows"] or 0) // WAVE), -(-int(sizes["bytes"] or 0) // WAVE_BYTES))
        out = None
        for wave in range(waves):
            mine = asked.filter(F.pmod(F.xxhash64("no"), F.lit(waves)) == wave).collect()  # a wave is of bounded size
            found = self.work.stash(self._scan([(r["no"], r["id"], _terms(r["text"])) for r in mine], k), f"found{wave}")
            self.work.release()
            out = found if out is None else out.unionByName(found)
        w = Window.partitionBy("no").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
        return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")

    def _scan(self, items: list[tuple[int, int | None, Counter]], k: int) -> DataFrame:
        terms = sorted({t for _, _, x in items for t in x})
        df = self.frequencies(terms)
        number = {t: i for i, t in enumerate(t for t in terms if t in df)}
        queries = []
        for no, own, x in items:
            some = [(number[t], n * self.weight(df[t])) for t, n in sorted(x.items()) if t in number]
            if sum(w for _, w in some) * MOST >= 2**62:
                raise ValueError("an item's weights leave 64 bits")
            if some:
                queries.append((no, own, np.array([t for t, _ in some]), np.array([w for _, w in some], np.int64)))
        sent = self.work.broadcast((list(number), queries))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, queries = sent.value
            wanted = pa.array(names, pa.string())
            best: list[tuple | None] = [None] * len(queries)
            for b in batches:
                for i in range(b.num_rows):
                    block = _Block(b, i, wanted)
                    for j, (_, _, t, w) in enumerate(queries):
                        held = best[j]
                        place, scores = block.best(t, w, k, int(held[0][-1]) if held and len(held[0]) == k else 1)
                        if len(place):
                            more = (scores, block.no_id[place], block.ids[place])
                            scores, no_id, ids = (np.concatenate(x) for x in zip(held, more, strict=True)) if held else more
                            keep = np.lexsort((ids, no_id, -scores))[:k]
                            best[j] = scores[keep], no_id[keep], ids[keep]
            for (no, own, _, _), held in zip(queries, best, strict=True):
                if held:
                    n = len(held[0])
                    yield pa.RecordBatch.from_arrays([pa.array([no] * n, pa.int64()), pa.array([own] * n, pa.int64()), pa.array(held[2], pa.int64(), mask=held[1]), pa.array(held[0], pa.int64())], ["no", "item_id", "doc_id", "score"])

        return self.blocks.select("docs", "terms", "starts", "place", "impact", "tf", "m").mapInArrow(scan, "no long, item_id long, doc_id long, score long")


def _terms(text: str | None) -> Counter:
    data = np.frombuffer((text or "").encode(), np.uint8)
    names, codes, _ = class_terms(data, np.array([0, len(data)]), ALNUM)
    return Counter(names.take(pa.array(codes)).to_pylist())


class _Block:
    """One block of the index: ``where[t]`` are the bounds of the postings of the wave's term t."""

    def __init__(self, b: pa.RecordBatch, i: int, wanted: pa.StringArray):
        take = lambda name, kind: np.frombuffer(b.column(name)[i].as_buffer(), kind)
        docs = b.column("docs")[i].values
        self.no_id, self.ids = np.asarray(docs.is_null()), docs.fill_null(0).to_numpy()
        starts = take("starts", "<u4").astype(np.int64)
        at = pc.index_in(b.column("terms")[i].values, value_set=wanted)
        here = np.flatnonzero(np.asarray(at.is_valid()))
        self.where = np.zeros((len(wanted), 2), np.int64)
        self.where[at.drop_null().to_numpy()] = np.stack([starts[here], starts[here + 1]], axis=1)
        self.place, self.impact, self.tf, self.m = take("place", "<u4"), take("impact", np.uint8), take("tf", "<u4"), take("m", "<i8")

    def best(self, terms: np.ndarray, weights: np.ndarray, k: int, reached: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, scores) of the documents that score at least ``reached``; of more than k, those that may be among the k best."""
        low, high = self.where[terms].T
        n = high - low
        total = int(n.sum())
        if not total:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.repeat(low - np.cumsum(n) + n, n) + np.arange(total)
        place, w, byte = self.place[at], np.repeat(weights, n), self.impact[at]
        upper = np.zeros(len(self.ids), np.int64)
        np.add.at(upper, place, w * UPPER[byte])
        may = upper >= reached
        if may.sum() > k:
            lower = np.zeros(len(self.ids), np.int64)
            np.add.at(lower, place, w * LOWER_G[byte])
            may &= upper >= np.partition(lower, -k)[-k]
        mine = may[place]
        place, at = place[mine], at[mine]
        scores = np.zeros(len(self.ids), np.int64)
        np.add.at(scores, place, w[mine] * gain(self.tf[at].astype(np.int64), self.m[place]))
        found = np.flatnonzero(may & (scores >= reached))
        return found, scores[found]


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """The k best documents of each item, from an index made for this call."""
    return LexicalIndex.build(docs).search(items, k)
