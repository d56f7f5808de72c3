"""Soft-membership mixing: nonnegative document rates whose expected domain token totals match targets.

1. A softmax classifier of the domains is fitted on at most ``max_labelled`` labelled documents in hash order: presence
   bits of words, word heads and word tails, the ``screen`` (4096) of largest chi-square, L1 penalty, accelerated
   proximal gradient. These two bounds of the fit are its only ones.
2. One pass over all whole texts gives each document's tokens n_i and posteriors p_ik.
3. Distributed projected gradient for least squares: with a_k = sum r_i n_i p_ik / sum n_i, minimise the squares of
   a - target, each over the domain's own share (a at r = 1), over r >= 0, from r = 1, with Nesterov's momentum. The
   metric weights each rate by its tokens, so a step is r_i <- max(0, z_i - p_i . ((a - target) / share)), and no
   eigenvalue of the problem is above 1; rare domains go as fast as large ones. A document's rate therefore
   follows from the errors of all steps so far, a few numbers: tasks replay them on their (n, p) columns and
   return one sum a domain. No rate is stored or shuffled until the last step.

Ends when all totals are within ``tolerance`` of the target weights, when they no longer move (targets that the
documents can't serve: the rates are then the nearest found), or after ``max_steps``. The column ``residual`` tells the
largest distance of a total from its target, so targets are met where it is at most ``tolerance``. Targets must not be
negative or all 0 (ValueError). Defined results: NULL and empty texts have no tokens, the
posteriors of a text without features and the rate these give; without labels posteriors are uniform; a labelled
document with several domains counts in the smallest named, one with several rows with one of their texts; repeated rows are documents of their own; an empty table
gives an empty result; other columns are ignored by ``mixture`` and kept by ``mix_documents``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.sparse import labelled_texts, largest_eigenvalue, screened
from gleaner.llm.textkernel import Chunk, chunks
from gleaner.operators.sampling import hash_sample
from gleaner.workspace import Workspace, fresh_name

DIM_BITS = 20
HEADS, TAIL = (4, 6), 2


def feature_ids(c: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of every word, head and tail of a lower-cased chunk, with repeats."""
    starts, ends = c.starts, c.ends
    row = np.repeat(np.arange(c.rows), np.diff(c.word_at))
    ids, rows = [c.span_hash(starts, ends)], [row]
    for n in HEADS:
        long = ends - starts > n
        ids.append(c.span_hash(starts[long], starts[long] + n) ^ np.uint64(n))
        rows.append(row[long])
    long = ends - starts >= TAIL
    ids.append(c.span_hash(ends[long] - TAIL, ends[long]) ^ np.uint64(99))
    rows.append(row[long])
    return np.concatenate(rows), (np.concatenate(ids) >> np.uint64(64 - DIM_BITS)).astype(np.int64)


class Softmax:
    def __init__(self, bias: np.ndarray, weight: np.ndarray):
        self.bias, self.weight = bias, weight
        self.used = (weight != 0).any(axis=1)

    def posteriors(self, c: Chunk) -> np.ndarray:
        row, ids = feature_ids(c)
        hit = self.used[ids]
        both = np.unique(row[hit] << DIM_BITS | ids[hit])
        r, w = both >> DIM_BITS, self.weight[both & ((1 << DIM_BITS) - 1)]
        score = self.bias + np.stack([np.bincount(r, w[:, k], c.rows) for k in range(len(self.bias))], axis=1)
        p = np.exp(score - score.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)


def fit_softmax(docs: list[np.ndarray], domain: np.ndarray, k: int, l1: float = 3e-4, screen: int = 4096, min_docs: int = 4, steps: int = 800) -> Softmax:
    n, dim = len(domain), 1 << DIM_BITS
    weight = np.zeros((dim, k), np.float32)
    if not n:
        return Softmax(np.zeros(k), weight)
    share = np.bincount(domain, minlength=k) / n
    bias = np.log(share + 0.5 / n)
    chosen, row, col = screened(docs, domain[:, None] == np.arange(k), dim, screen, min_docs)
    if not len(chosen):
        return Softmax(bias, weight)
    m = len(chosen)
    step = 1 / max(0.5 * largest_eigenvalue(row, col, n, m), 1e-9)
    w, z, t = np.zeros((m, k)), np.zeros((m, k)), 1.0
    one = np.eye(k)[domain]
    for _ in range(steps):
        s = bias + np.stack([np.bincount(row, z[col, j], n) for j in range(k)], axis=1)
        p = np.exp(s - s.max(axis=1, keepdims=True))
        g = p / p.sum(axis=1, keepdims=True) - one
        nxt = z - step * np.stack([np.bincount(col, g[row, j], m) for j in range(k)], axis=1) / n
        nxt = np.sign(nxt) * np.maximum(np.abs(nxt) - step * l1, 0)
        bias = bias - g.mean(axis=0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, w, t = nxt + (t - 1) / t2 * (nxt - w), nxt, t2
    weight[chosen] = w
    return Softmax(bias, weight)


def train(docs: DataFrame, labelled: DataFrame, names: list[str], max_labelled: int, **settings) -> Softmax:
    """``labelled``: doc_id, domain (one of ``names``)."""
    known = labelled.filter(F.col("domain").isin(names) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long")).agg(F.min("domain").alias("domain"))
    rows = labelled_texts(docs, hash_sample(known, ["doc_id"], max_labelled), "domain")

    def features(batches):
        for b in batches:
            for c in chunks(b.column("text"), lower=True):
                row, ids = feature_ids(c)
                both = np.unique(row << DIM_BITS | ids)
                part = np.split((both & ((1 << DIM_BITS) - 1)).astype(np.int32), np.searchsorted(both, np.arange(1, c.rows) << DIM_BITS))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(c.first, c.rows), b.column("domain").slice(c.first, c.rows), pa.array([x.tobytes() for x in part], pa.binary())], ["doc_id", "domain", "ids"])

    found = sorted(rows.mapInArrow(features, "doc_id long, domain string, ids binary").collect(), key=lambda r: r.doc_id)
    return fit_softmax([np.frombuffer(r.ids, np.int32) for r in found], np.array([names.index(r.domain) for r in found], np.int64), len(names), **settings)


def replay(p: np.ndarray, errors: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(rates, points at which the next error is measured) of documents with posteriors ``p`` after all errors so far."""
    r = z = np.ones(len(p))
    t = 1.0
    for e in errors:
        nxt = np.maximum(z - p @ e, 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        r, z, t = nxt, np.maximum(nxt + (t - 1) / t2 * (nxt - r), 0), t2
    return r, z


def _matrix(batch: pa.RecordBatch, k: int) -> np.ndarray:
    return batch.column("p").flatten().to_numpy(zero_copy_only=False).reshape(-1, k)


def fit_rates(soft: DataFrame, target: np.ndarray, tolerance: float, max_steps: int) -> tuple[list[np.ndarray], float]:
    """The errors of all steps over the domains' shares, and the largest distance that is left; ``soft``: n_tokens, p."""
    k = len(target)

    def sums(errors):
        def of(batches):
            total, at_rate, n = np.zeros(k), np.zeros(k), 0
            for b in batches:
                p, size = _matrix(b, k), b.column("n_tokens").to_numpy()
                r, z = replay(p, errors)
                total += (size * z) @ p
                at_rate += (size * r) @ p
                n += int(size.sum())
            yield pa.RecordBatch.from_arrays([pa.array([total]), pa.array([at_rate]), pa.array([n], pa.int64())], ["total", "at_rate", "n"])

        rows = soft.select("n_tokens", "p").mapInArrow(of, "total array<double>, at_rate array<double>, n long").collect()
        n = sum(r.n for r in rows)
        return [np.sum([r[i] for r in rows], axis=0) / n if n else target for i in (0, 1)]

    errors: list[np.ndarray] = []
    still, last, share = 0, np.full(k, np.inf), None
    while True:
        at_point, at_rate = sums(errors)
        share = share if errors else np.maximum(at_rate, 1e-6)
        left = float(np.abs(at_rate - target).max())
        still = still + 1 if np.abs(at_rate - last).max() < tolerance / 1000 else 0
        if left <= tolerance or still == 3 or len(errors) >= max_steps:
            return errors, left
        errors.append((at_point - target) / share)
        last = at_rate


def mixture(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], max_labelled: int = 8000, tolerance: float = 1e-3, max_steps: int = 300, **settings) -> DataFrame:
    """Per document: doc_id, n_tokens, p (a posterior for each name of ``targets`` in order), rate, residual."""
    names = list(targets)
    target = np.array(list(targets.values()), float)
    if not (np.isfinite(target).all() and (target >= 0).all() and target.sum() > 0):
        raise ValueError("targets must be weights of at least 0, and not all 0")
    target = target / target.sum()
    work = Workspace(docs.sparkSession, "mixing")
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    sent = work.broadcast(train(docs, labelled, names, max_labelled, **settings))
    k = len(names)

    def posteriors(batches):
        for b in batches:
            for c in chunks(b.column("text"), lower=True):
                p = sent.value.posteriors(c)
                yield pa.RecordBatch.from_arrays([
                    b.column("doc_id").slice(c.first, c.rows), pa.array(np.diff(c.word_at), pa.int64()),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, p.size + 1, k), pa.int32()), pa.array(p.ravel()))], ["doc_id", "n_tokens", "p"])

    soft = work.stash(docs.mapInArrow(posteriors, "doc_id long, n_tokens long, p array<double>"), "posteriors")
    work.release()
    errors, left = fit_rates(soft, target, tolerance, max_steps)

    def rated(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(replay(_matrix(b, k), errors)[0])], ["doc_id", "n_tokens", "p", "rate"])

    return soft.mapInArrow(rated, "doc_id long, n_tokens long, p array<double>, rate double").withColumn("residual", F.lit(left))


def copies(doc_id: Column, rate: Column) -> Column:
    """``rate`` rounded down or up by a hash of the document, so that its mean is the rate."""
    return F.floor(rate + F.pmod(F.xxhash64(doc_id, F.lit("copies")), F.lit(1 << 20)) / float(1 << 20)).cast("int")


def mix_documents(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], **settings) -> DataFrame:
    """``docs`` with rate and copies (how often a document is taken); documents taken not once are left out.

    Rows with equal doc_id get the rate of one of them; columns of ``docs`` named rate or copies are replaced.
    """
    doc = fresh_name("_doc", docs.columns)
    rates = mixture(docs, labelled, targets, **settings).groupBy(F.col("doc_id").alias(doc)).agg(F.max("rate").alias("rate"))
    taken = rates.withColumn("copies", copies(F.col(doc), F.col("rate")))
    rest = docs.select(*(c for c in docs.columns if c.lower() not in ("rate", "copies")))
    return rest.join(taken, F.col("doc_id").cast("long").eqNullSafe(F.col(doc))).filter("copies > 0").drop(doc)


def label_domains(labels: DataFrame) -> DataFrame:
    """doc_id, domain of the labels table: toxic, else junk (low quality), else clean."""
    name = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "junk").when(F.col("quality") == 1, "clean")
    return labels.select("doc_id", name.alias("domain")).filter("domain is not null")
