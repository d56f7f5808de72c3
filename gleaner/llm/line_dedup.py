"""Line dedup over levelled, sorted runs of line hashes.

A run is a written table of (key hash, documents and lines holding the key, keeper), bucketed and sorted by hash, so
that a join with them shuffles and sorts the batch only. Batches of documents come by falling doc_id, cut at quantiles. Each is
merge-anti-joined with the runs: a key that no run has is fresh, and as every later document is smaller, the batch's
largest holder is its keeper; a known key only adds to the counts. The batch then adds its own run; ``fanout`` runs of
a level are compacted into one of the next. After the last batch the merged runs name the keys to drop, and each
document's drops are found by one join in which hot keys are spread.

A key is a line stripped of ASCII spaces with A-Z lower-cased; its hash has 128 bits. Defined results: a NULL text is
an empty one and has one empty line; rows with equal doc_id count as documents of their own, each judged by its own
lines; a row without doc_id doesn't count as a holder and keeps all lines; an empty table gives an empty result; other
columns of the input are passed through by ``dedup_lines`` and ignored by ``line_report``. The lines of a document are
handled in one task; texts are shuffled once.
"""

from __future__ import annotations

import hashlib
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.textkernel import SPACE, Chunk, chunks
from gleaner.operators.skew import join_counted
from gleaner.workspace import Workspace, fresh_name, shuffle_width, shuffles_removed

KEYS = ["k1", "k2"]
_SORTED, _UNION = "spark.sql.legacy.bucketedTableScan.outputOrdering", "spark.sql.unionOutputPartitioning"


def long_lines(c: Chunk, min_chars: int) -> tuple[np.ndarray, ...]:
    """(row, line of the row, two hashes of the key, first of its key in the row) of the lines of a lower-cased chunk
    whose key has at least ``min_chars`` code points."""
    n = len(c.data)
    breaks = np.flatnonzero(c.data == 10)
    row = np.concatenate([np.searchsorted(c.offsets, breaks, "right") - 1, np.arange(c.rows)])
    ends = np.concatenate([breaks, c.offsets[1:]])
    order = np.lexsort((ends, row))  # a row's end is past all its line ends
    row, ends = row[order], ends[order]
    head = np.searchsorted(row, row, "left")
    line = np.arange(len(row)) - head
    starts = np.where(line == 0, c.offsets[row], np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends)
    # strip: the next byte that is no space from the start on, the last one before the end
    place, solid = np.arange(n), ~SPACE[c.data]
    after = np.concatenate([np.minimum.accumulate(np.where(solid, place, n)[::-1])[::-1], [n]]) if n else np.zeros(1, np.int64)
    before = np.concatenate([[0], np.maximum.accumulate(np.where(solid, place + 1, 0))]) if n else np.zeros(1, np.int64)
    starts = np.minimum(after[starts], ends)
    ends = np.maximum(before[ends], starts)
    points = np.concatenate([[0], np.cumsum((c.data & 0xC0) != 0x80)])
    long = points[ends] - points[starts] >= min_chars
    row, line, starts, ends = row[long], line[long], starts[long], ends[long]
    k1, k2 = c.span_hash(starts, ends), c.span_hash(starts, ends, 1)
    order = np.lexsort((line, k2, k1, row))
    first = np.ones(len(order), bool)
    a = [x[order] for x in (row, k1, k2)]
    first[order] = np.concatenate([[True], np.any([x[1:] != x[:-1] for x in a], axis=0)]) if len(order) else first
    return row, line, k1.astype(np.int64), k2.astype(np.int64), first


class LineRuns:
    """The levelled store. ``add`` takes rows (doc_id, k1, k2, first) of a batch whose doc_ids are all at most those
    of the batches before."""

    def __init__(self, work: Workspace, fanout: int = 3):
        self.work, self.fanout, self.spark = work, fanout, work.spark
        self.levels: list[list[str]] = [[]]
        self.width = shuffle_width(self.spark)
        self._serial = 0

    @contextmanager
    def _planned(self):
        """A run has one file a bucket, so its scans are sorted. A union of runs must be dealt anew: Spark 4.1 takes it for
        partitioned like its parts and then leaves equal keys apart where buckets are empty (a test shows it)."""
        held = {_SORTED: "true", _UNION: "false"}
        before = {k: self.spark.conf.get(k, None) for k in held}
        for k, v in held.items():
            self.spark.conf.set(k, v)
        try:
            with shuffles_removed(self.spark):
                yield
        finally:
            for k, v in before.items():
                self.spark.conf.set(k, v) if v is not None else self.spark.conf.unset(k)

    def _write(self, rows: DataFrame) -> str:
        self._serial += 1
        name = f"gleaner_run_{uuid.uuid4().hex}"
        to = rows.write.format("parquet").bucketBy(self.width, *KEYS).sortBy(*KEYS).option("path", f"{self.work.path}/{name}").option("compression", "zstd")
        with self._planned():
            to.saveAsTable(name)
        return name

    def _drop(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            self.work.discard(name)

    def _runs(self) -> list[str]:
        return [r for level in self.levels for r in level]

    def _merge(self, names: list[str]) -> DataFrame:
        out = self.spark.table(names[0])
        for r in names[1:]:
            out = out.unionByName(self.spark.table(r))
        # one run alone has a key's keeper: the one in which it was fresh
        return out.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("lines").alias("lines"), F.min("keeper").alias("keeper"))

    def add(self, lines: DataFrame) -> None:
        holds = F.col("first") & F.col("doc_id").isNotNull()
        own = lines.groupBy(*KEYS).agg(F.count_if(holds).alias("docs"), F.count("*").alias("lines"), F.max("doc_id").alias("keeper"))
        fresh = F.lit(True)
        for i, run in enumerate(self._runs()):
            own = own.join(self.spark.table(run).select(*KEYS, F.lit(True).alias(f"in{i}")).hint("merge"), KEYS, "left")
            fresh = fresh & F.col(f"in{i}").isNull()
        self.levels[0].append(self._write(own.select(*KEYS, "docs", "lines", F.when(fresh, F.col("keeper")).alias("keeper"))))
        at = 0
        while len(self.levels[at]) >= self.fanout:
            full = self.levels[at]
            if len(self.levels) == at + 1:
                self.levels.append([])
            self.levels[at + 1].append(self._write(self._merge(full)))
            self.levels[at] = []
            self._drop(full)
            at += 1

    def close(self, min_docs: int) -> DataFrame:
        """The merged keys of at least ``min_docs`` documents; the runs go."""
        with self._planned():
            often = self.work.stash(self._merge(self._runs()).filter((F.col("docs") >= min_docs) & F.col("keeper").isNotNull()), "often")
        self._drop(self._runs())
        return often


def _cuts(docs: DataFrame, batches: int) -> list[int]:
    """The doc_ids that part the batches, falling."""
    found = docs.agg(F.percentile_approx("doc_id", F.array(*(F.lit(1 - i / batches) for i in range(1, batches))), 10_000)).first()[0] if batches > 1 else None
    return sorted(set(found or []), reverse=True)


def _drops(docs: DataFrame, work: Workspace, min_docs: int, min_chars: int, batches: int, fanout: int) -> DataFrame:
    """(doc_id, body, drop): positions of the lines that go from the rows with that doc_id and hash of the text."""
    def lines_of(rows):
        for b in rows:
            for c in chunks(b.column("text"), lower=True):
                row, line, k1, k2, first = long_lines(c, min_chars)
                at = pa.array(row + c.first)
                yield pa.RecordBatch.from_arrays([
                    b.column("doc_id").take(at), b.column("body").take(at), b.column("batch").take(at), pa.array(line, pa.int32()), pa.array(k1), pa.array(k2), pa.array(first)],
                    ["doc_id", "body", "batch", "at", "k1", "k2", "first"])

    cuts = _cuts(docs, batches)
    batch = F.lit(len(cuts))  # rows without doc_id come last
    for i in range(len(cuts) - 1, -1, -1):
        batch = F.when(F.col("doc_id") > cuts[i], F.lit(i)).otherwise(batch)
    lines = docs.select("doc_id", "text", F.xxhash64("text").alias("body"), batch.cast("int").alias("batch")).mapInArrow(lines_of, "doc_id long, body long, batch int, at int, k1 long, k2 long, first boolean")
    lines = work.stash(lines, "lines")
    store = LineRuns(work, fanout)
    for b in range(len(cuts) + 1):
        store.add(lines.filter(F.col("batch") == b).select("doc_id", "first", *KEYS))
    often = store.close(min_docs)
    hit = join_counted(lines.select("doc_id", "body", "at", *KEYS), often.drop("docs"), KEYS, "lines", F.struct("doc_id", "at"))
    return hit.filter(F.col("doc_id") < F.col("keeper")).groupBy("doc_id", "body").agg(F.collect_list("at").alias("drop"))


def _kept(text: str, drop) -> tuple[int, int, str]:
    lines = text.split("\n")
    gone = set() if drop is None else set(drop)
    kept = [x for i, x in enumerate(lines) if i not in gone] if gone else lines
    return len(lines), len(gone), "\n".join(kept)


def line_report(docs: DataFrame, min_docs: int = 3, min_chars: int = 20, batches: int = 4, fanout: int = 3) -> DataFrame:
    """Per document: doc_id, n_lines, n_dropped, kept_sha256."""
    work = Workspace(docs.sparkSession, "line-dedup")
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def digest(batches_):
        for b in batches_:
            found = [_kept(t.as_py(), d.as_py()) for t, d in zip(b.column("text"), b.column("drop"), strict=True)]
            yield pa.RecordBatch.from_arrays([
                b.column("doc_id"), pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64()),
                pa.array([hashlib.sha256(x[2].encode()).hexdigest() for x in found], pa.string())], ["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    drops = _drops(docs, work, min_docs, min_chars, batches, fanout)
    joined = docs.withColumn("body", F.xxhash64("text")).join(drops, ["doc_id", "body"], "left")
    return joined.select("doc_id", "text", "drop").mapInArrow(digest, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


def dedup_lines(docs: DataFrame, min_docs: int = 3, min_chars: int = 20, batches: int = 4, fanout: int = 3) -> DataFrame:
    """The rows of ``docs`` with ``text`` rewritten; all other columns as they are."""
    work = Workspace(docs.sparkSession, "line-dedup")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    drops = _drops(docs.select(F.col("doc_id").cast("long"), text.alias("text")), work, min_docs, min_chars, batches, fanout)
    doc, body, drop = (fresh_name(x, docs.columns) for x in ("_doc", "_body", "_drop"))
    drops = drops.select(F.col("doc_id").alias(doc), F.col("body").alias(body), F.col("drop").alias(drop))

    @F.arrow_udf("string")
    def rewrite(text: pa.Array, gone: pa.Array) -> pa.Array:
        hit = gone.is_valid()
        found = [_kept(t.as_py() or "", d.as_py())[2] for t, d in zip(text.filter(hit), gone.filter(hit), strict=True)]
        return pc.replace_with_mask(text, hit, pa.array(found, text.type))

    joined = docs.join(drops, (F.col("doc_id").cast("long") == F.col(doc)) & (F.xxhash64(text) == F.col(body)), "left")
    return joined.select(*(rewrite(F.col("text").cast("string"), F.col(drop)).alias("text") if c == "text" else F.col(c) for c in docs.columns))
