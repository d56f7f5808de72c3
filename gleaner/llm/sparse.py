"""Bounded labelled samples, and the screening of their hashed presence features in blocks of documents."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 500


def labelled_texts(docs: DataFrame, sample: DataFrame, label: str) -> DataFrame:
    """(doc_id, text, label): a row for each doc_id of the bounded ``sample``, of repeated rows that with the smallest text hash."""
    rows = docs.filter("doc_id is not null").join(F.broadcast(sample), "doc_id")
    return rows.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.first(label).alias(label))


def screened(docs: list[np.ndarray], groups: np.ndarray, dim: int, screen: int, min_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(chosen, row, col): the features with the largest chi-square against any column of ``groups`` (documents x
    groups, bool), and the places at which documents have them; ``chosen[col]`` are feature ids."""
    n, k = groups.shape
    total, hit = np.zeros(dim, np.int32), np.zeros((k, dim), np.int32)
    for a in range(0, n, BLOCK):
        part = docs[a : a + BLOCK]
        total += np.bincount(np.concatenate(part), minlength=dim).astype(np.int32) if part else 0
        for j in range(k):
            own = [d for d, g in zip(part, groups[a : a + BLOCK, j], strict=True) if g]
            if own:
                hit[j] += np.bincount(np.concatenate(own), minlength=dim).astype(np.int32)
    chi = np.zeros(dim)
    often = np.flatnonzero(total >= min_docs)
    for j in range(k):
        share = groups[:, j].mean() if n else 0.0
        if 0 < share < 1:
            t = total[often]
            chi[often] = np.maximum(chi[often], (hit[j, often] - t * share) ** 2 / (t * share * (1 - share)))
    chosen = np.sort(np.argsort(-chi, kind="stable")[:screen])
    chosen = chosen[chi[chosen] > 0]
    place = np.full(dim, -1, np.int32)
    place[chosen] = np.arange(len(chosen))
    rows, cols = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
    for i, d in enumerate(docs):
        c = place[d]
        c = c[c >= 0]
        rows.append(np.full(len(c), i, np.int32))
        cols.append(c)
    return chosen, np.concatenate(rows), np.concatenate(cols)


def largest_eigenvalue(row: np.ndarray, col: np.ndarray, n: int, m: int) -> float:
    """Of X'X / n for the presence matrix X, by power iteration."""
    v, size = np.ones(m), 0.0
    for _ in range(13):
        v = np.bincount(col, np.bincount(row, v[col], n)[row], m)
        size = float(np.linalg.norm(v))
        v /= size or 1
    return size / max(n, 1)
