"""Toxicity severity by cumulative-link ordinal regression on sparse text features.

Features are presence bits of a document's words and word heads (the first 4 and 6 bytes), lower-cased, without
ASCII punctuation at the ends, hashed to 2**20. The model has one weight a feature, shared by all thresholds:
P(grade <= k) = sigmoid(theta_k - w x). It is fitted on at most ``max_labelled`` labelled documents, taken in hash
order, by accelerated proximal gradient with an L1 penalty on the ``screen`` (4096) features of largest chi-square; these
bounds of the fit are the only ones. Every document is then scored whole: severity is the expected grade.

``labels`` has two marks, so grades are: 0 not toxic, 1 toxic, 2 toxic and of low quality. Defined results: NULL and
empty texts have the severity of a text without features; labels that are NULL, contradictory repeats (the largest
grade counts) or of unknown documents do no harm; a labelled doc_id with several rows counts with one of their texts; with fewer than two grades in the sample all scores are 0; repeated
rows score alike; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.sparse import labelled_texts, largest_eigenvalue, screened
from gleaner.llm.textkernel import Chunk, bare_words, chunks
from gleaner.operators.sampling import hash_sample
from gleaner.workspace import Workspace

DIM_BITS = 20
HEADS = (4, 6)


def feature_ids(c: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of every word and head of a lower-cased chunk, with repeats."""
    row = np.repeat(np.arange(c.rows), np.diff(c.word_at))
    starts, ends, full = bare_words(c)
    starts, ends, row = starts[full], ends[full], row[full]
    ids, rows = [c.span_hash(starts, ends)], [row]
    for n in HEADS:
        long = ends - starts > n
        ids.append(c.span_hash(starts[long], starts[long] + n) ^ np.uint64(n))
        rows.append(row[long])
    return np.concatenate(rows), (np.concatenate(ids) >> np.uint64(64 - DIM_BITS)).astype(np.int64)


class OrdinalModel:
    def __init__(self, theta: np.ndarray, weight: np.ndarray):
        self.theta, self.weight = theta, weight

    def exceed(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k), a column a threshold."""
        return 1 / (1 + np.exp(np.clip(self.theta[None, :] - score[:, None], -40, 40)))


def fit_ordinal(docs: list[np.ndarray], grade: np.ndarray, grades: int, l1: float = 3e-4, screen: int = 4096, min_docs: int = 4, steps: int = 1500) -> OrdinalModel:
    """``docs``: the distinct features of each row."""
    n, dim = len(grade), 1 << DIM_BITS
    theta = np.array([np.log(((grade <= k).sum() + 0.5) / ((grade > k).sum() + 0.5)) for k in range(grades - 1)])
    theta = np.maximum.accumulate(theta + 1e-3 * np.arange(grades - 1))
    if n == 0 or len(np.unique(grade)) < 2:
        return OrdinalModel(np.full(grades - 1, 40.0), np.zeros(dim, np.float32))
    chosen, row, col = screened(docs, (grade > 0)[:, None], dim, screen, min_docs)
    m = len(chosen)
    step = 1 / max(0.25 * (grades - 1) * largest_eigenvalue(row, col, n, m), 1e-9)
    w, z, t = np.zeros(m), np.zeros(m), 1.0
    for _ in range(steps):
        s = np.bincount(row, z[col], n)
        # d NLL / d s and / d theta of P(k) = sigmoid(theta_k - s) - sigmoid(theta_{k-1} - s)
        edge = np.concatenate([[-40.0], theta, [40.0]])
        up = 1 / (1 + np.exp(-np.clip(edge[grade + 1] - s, -40, 40)))
        down = 1 / (1 + np.exp(-np.clip(edge[grade] - s, -40, 40)))
        p = np.maximum(up - down, 1e-9)
        du, dd = up * (1 - up), down * (1 - down)
        gs = (du - dd) / p
        gt = np.array([-(du / p)[grade == k].sum() + (dd / p)[grade == k + 1].sum() for k in range(grades - 1)]) / n
        gw = np.bincount(col, gs[row], m) / n
        nxt = z - step * gw
        nxt = np.sign(nxt) * np.maximum(np.abs(nxt) - step * l1, 0)
        theta = np.maximum.accumulate(theta - 2.0 * gt)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, w, t = nxt + (t - 1) / t2 * (nxt - w), nxt, t2
    weight = np.zeros(dim, np.float32)
    weight[chosen] = w
    return OrdinalModel(theta, weight)


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = 8000, **settings) -> OrdinalModel:
    """``docs``: doc_id, text; ``labels``: doc_id, toxic, quality."""
    graded = labels.filter("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long")).agg(
        F.max(F.when(F.col("toxic") == 1, F.when(F.col("quality") == 0, 2).otherwise(1)).otherwise(0)).alias("grade"))
    rows = labelled_texts(docs, hash_sample(graded, ["doc_id"], max_labelled), "grade")

    def features(batches):
        for b in batches:
            for c in chunks(b.column("text"), lower=True):
                row, ids = feature_ids(c)
                both = np.unique(row << DIM_BITS | ids)
                cut = np.searchsorted(both, np.arange(1, c.rows) << DIM_BITS)
                part = np.split((both & ((1 << DIM_BITS) - 1)).astype(np.int32), cut)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(c.first, c.rows), b.column("grade").slice(c.first, c.rows), pa.array([x.tobytes() for x in part], pa.binary())], ["doc_id", "grade", "ids"])

    found = sorted(rows.mapInArrow(features, "doc_id long, grade int, ids binary").collect(), key=lambda r: r.doc_id)
    return fit_ordinal([np.frombuffer(r.ids, np.int32) for r in found], np.array([r.grade for r in found], np.int64), 3, **settings)


def severities(docs: DataFrame, labels: DataFrame, max_labelled: int = 8000, cut: float = 0.4, **settings) -> DataFrame:
    """Per document: doc_id, severity (expected grade), p_toxic (P(grade > 0)), grade (most likely), toxic (p_toxic >= cut)."""
    work = Workspace(docs.sparkSession, "toxicity")
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    sent = work.broadcast(train(docs, labels, max_labelled, **settings))

    def score(batches):
        model = sent.value
        for b in batches:
            out = []
            for c in chunks(b.column("text"), lower=True):
                row, ids = feature_ids(c)
                used = model.weight[ids] != 0
                both = np.unique(row[used] << DIM_BITS | ids[used])
                out.append(np.bincount(both >> DIM_BITS, model.weight[both & ((1 << DIM_BITS) - 1)], c.rows))
            s = np.concatenate(out) if out else np.zeros(0)
            over = model.exceed(s)
            exact = -np.diff(np.hstack([np.ones((len(s), 1)), over, np.zeros((len(s), 1))]), axis=1)
            yield pa.RecordBatch.from_arrays([
                b.column("doc_id"), pa.array(over.sum(axis=1), pa.float64()), pa.array(over[:, 0], pa.float64()),
                pa.array(exact.argmax(axis=1).astype(np.int32), pa.int32()), pa.array(over[:, 0] >= cut, pa.bool_())], ["doc_id", "severity", "p_toxic", "grade", "toxic"])

    return docs.mapInArrow(score, "doc_id long, severity double, p_toxic double, grade int, toxic boolean")
