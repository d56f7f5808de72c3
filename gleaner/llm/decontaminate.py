"""Benchmark decontamination: BM25 over test items with block-max WAND, then question and answer overlap.

The test items are the indexed documents, with word pairs as terms, and the passages of the training texts are the
queries: windows of
2 * STRIDE words every STRIDE words, so that any stretch of up to STRIDE words lies whole in one window. BM25 impacts
are divided by the item's score for its own text, so one threshold holds for all items; long items are indexed in
pieces that a window can hold, and any piece retrieves its item. For each window:

1. Upper bound without the index: terms whose greatest impacts together stay below half the threshold (the frequent
   ones) are non-essential; a window whose essential terms can't reach the rest has no item. This is one prefix sum.
2. Block-max WAND over the window's distinct terms: postings are cut into blocks with their own maxima; items whose
   bounds stay below the threshold are skipped, and every item with at least the threshold is returned.
3. Verification on the document's words: an item counts as leaked where at least ``question_overlap`` of the word
   trigrams of its question and ``answer_overlap`` of those of its answer occur in the window. An item without a
   separate answer column is split at its last quarter of words for the two figures; as that quarter is short and not a
   known answer, such an item also counts where ``question_overlap`` of the trigrams of its whole text occur.

Nothing caps the number of items or windows. Items are indexed in groups of about ``GROUP`` items, dealt by hash, one
after the other: a group is collected, broadcast, used for a scan of the texts whose finds are written, and destroyed, so
the driver holds one group for a benchmark of any size, and the texts are scanned once a group. Defined results: NULL and
wordless texts and items match nothing; items of fewer than ``min_words`` words, single words among them, must occur as
a whole run of words; repeated documents give a row each, repeated items count once; empty tables give an empty result;
other columns are ignored. ``drop_leaking`` judges every row by its own text, also where doc_id is NULL or repeated.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.textkernel import Chunk, bare_words, chunks, rolling
from gleaner.workspace import Workspace, fresh_name

STRIDE, BLOCK_ITEMS, SUPER, GROUP = 64, 16, 64, 20_000
#: Index terms are runs of so many words: with single words, most windows could hold half of some item's score.
TERM = 2
K1, B = 1.2, 0.75


def clean_words(c: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of a lower-cased chunk without ASCII marks at the ends of words, and each row's first word.

    Words of marks only are left out.
    """
    starts, ends, full = bare_words(c)
    at = np.concatenate([[0], np.cumsum(full)])[c.word_at]
    return c.span_hash(starts[full], ends[full]), at


class Postings:
    """Item numbers and normalised impacts of one term, cut into blocks."""

    __slots__ = ("items", "impacts", "most", "block_last", "block_most")

    def __init__(self, items: np.ndarray, impacts: np.ndarray):
        self.items, self.impacts = items.tolist(), impacts.tolist()
        self.most = float(impacts.max())
        cut = range(0, len(items), BLOCK_ITEMS)
        self.block_last = [int(items[min(i + BLOCK_ITEMS, len(items)) - 1]) for i in cut]
        self.block_most = [float(impacts[i : i + BLOCK_ITEMS].max()) for i in cut]


class Index:
    """BM25 over items given as arrays of term hashes; impacts are shares of the item's own score."""

    def __init__(self, items: list[np.ndarray], threshold: float):
        n = len(items)
        size = np.array([len(x) for x in items], float)
        mean = size.mean() if n else 1.0
        each = [np.unique(x, return_counts=True) for x in items]
        self.terms, df = np.unique(np.concatenate([t for t, _ in each]) if n else np.zeros(0, np.uint64), return_counts=True)
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        rows = []
        for i, (t, tf) in enumerate(each):
            at = np.searchsorted(self.terms, t)
            impact = idf[at] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[i] / mean))
            total = impact.sum()
            rows.append((at, np.full(len(at), i), impact / total if total else impact))
        term = np.concatenate([r[0] for r in rows]) if n else np.zeros(0, int)
        item = np.concatenate([r[1] for r in rows]) if n else np.zeros(0, int)
        impact = np.concatenate([r[2] for r in rows]) if n else np.zeros(0)
        order = np.lexsort((item, term))
        cut = np.searchsorted(term[order], np.arange(1, len(self.terms)))
        self.postings = [Postings(i, w) for i, w in zip(np.split(item[order], cut), np.split(impact[order], cut), strict=True)] if len(self.terms) else []
        self.most = np.array([p.most for p in self.postings])
        # the greatest impact of each term in each of at most SUPER ranges of items
        self.wide = np.zeros((len(self.terms), min(SUPER, max(1, -(-n // BLOCK_ITEMS)))), np.float32)
        np.maximum.at(self.wide, (term, item * self.wide.shape[1] // max(n, 1)), impact.astype(np.float32))
        self.threshold = threshold
        # non-essential: the terms of most items, as long as all of them together stay below half the threshold
        ease = np.lexsort((np.arange(len(df)), -df))
        free = ease[np.cumsum(self.most[ease]) < threshold / 2] if len(df) else ease
        self.essential = self.most.copy()
        self.essential[free] = 0
        self.slack = float(self.most[free].sum())
        bits = 20
        self.shift = np.uint64(64 - bits)
        self.maybe = np.zeros(1 << bits, bool)
        self.maybe[self.terms >> self.shift] = True

    def lookup(self, words: np.ndarray) -> np.ndarray:
        """Term numbers, -1 for those that no item has."""
        out = np.full(len(words), -1)
        if len(self.terms):
            some = np.flatnonzero(self.maybe[words >> self.shift])
            at = np.minimum(np.searchsorted(self.terms, words[some]), len(self.terms) - 1)
            out[some] = np.where(self.terms[at] == words[some], at, -1)
        return out

    def hopeful(self, terms: np.ndarray) -> bool:
        """Whether some range of items may hold one that reaches the threshold."""
        least = self.threshold - 1e-5
        return self.most[terms].sum() >= least and self.wide[terms].sum(axis=0).max() >= least

    def search(self, terms: list[int]) -> list[tuple[int, float]]:
        """All (item, score) of at least the threshold for distinct terms, by block-max WAND."""
        least = self.threshold - 1e-9
        lists = [[p.items[0], 0, 0, p] for p in (self.postings[t] for t in terms)]  # item, place, block, postings
        out = []
        while lists:
            lists.sort(key=lambda x: x[0])
            bound, pivot = 0.0, -1
            for i, x in enumerate(lists):
                bound += x[3].most
                if bound >= least:
                    pivot = i
                    break
            if pivot < 0:
                break
            target = lists[pivot][0]
            while pivot + 1 < len(lists) and lists[pivot + 1][0] == target:
                pivot += 1
            # the blocks in which the target would lie
            bound, after = 0.0, None
            for x in lists[: pivot + 1]:
                p, b = x[3], x[2]
                while b < len(p.block_last) and p.block_last[b] < target:
                    b += 1
                x[2] = b
                if b < len(p.block_last):
                    bound += p.block_most[b]
                    after = p.block_last[b] if after is None else min(after, p.block_last[b])
            if bound >= least:
                if lists[0][0] == target:
                    score = sum(x[3].impacts[x[1]] for x in lists[: pivot + 1])
                    if score >= least:
                        out.append((target, score))
                    goal = target + 1
                else:
                    goal = target
            else:
                # no item up to the nearest block border reaches the threshold
                goal = max(after if after is not None else target, target) + 1
                if pivot + 1 < len(lists):
                    goal = min(goal, lists[pivot + 1][0])
            for x in lists[: pivot + 1]:
                if x[0] < goal:
                    items = x[3].items
                    x[1] = bisect_left(items, goal, x[1])
                    x[0] = items[x[1]] if x[1] < len(items) else -1
            lists = [x for x in lists if x[0] >= 0]
        return out


def _share(part: np.ndarray, window: np.ndarray) -> float:
    """Which share of a part's word trigrams (shorter: the whole part) occurs in a window."""
    k = min(3, len(part))
    if not k:
        return 1.0
    return float(np.isin(rolling(part, k), rolling(window, k)).mean())


class Matcher:
    def __init__(self, items: list[tuple[int, str, str | None]], threshold: float, question_overlap: float, answer_overlap: float, min_words: int):
        self.ids, self.parts, self.undivided = [], [], []
        self.single: dict[int, list[int]] = {}
        for item_id, question, answer in items:
            q = self._words(question)
            if answer is None:
                cut = len(q) - len(q) // 4
                q, a = q[:cut], q[cut:]
            else:
                a = self._words(answer)
            if len(q) + len(a) >= TERM:
                self.ids.append(item_id)
                self.parts.append((q, a))
                self.undivided.append(answer is None)
            elif len(q) + len(a):  # too short for a term: the word itself is
                self.single.setdefault(int(np.concatenate([q, a])[0]), []).append(item_id)
        self.words = np.array(sorted(self.single), np.uint64)
        self.question_overlap, self.answer_overlap, self.min_words = question_overlap, answer_overlap, min_words
        # an item that is longer than a window can hold is indexed in pieces of about STRIDE words
        pieces, self.owner = [], []
        for i, p in enumerate(self.parts):
            whole = np.concatenate(p)
            for piece in np.array_split(whole, max(1, round(len(whole) / STRIDE))):
                pieces.append(rolling(piece, TERM))
                self.owner.append(i)
        self.index = Index(pieces, threshold)

    @staticmethod
    def _words(text: str) -> np.ndarray:
        for c in chunks(pa.array([text]), lower=True, limit=1 << 62):
            return clean_words(c)[0]
        return np.zeros(0, np.uint64)

    def verify(self, i: int, window: np.ndarray) -> tuple[float, float] | None:
        q, a = self.parts[i]
        if len(q) + len(a) < self.min_words:
            whole = np.concatenate([q, a])
            hit = np.isin(rolling(whole, len(whole)), rolling(window, len(whole))).all() if len(window) >= len(whole) else False
            return (1.0, 1.0) if hit else None
        x, y = _share(q, window), _share(a, window)
        if x >= self.question_overlap and y >= self.answer_overlap:
            return x, y
        return (x, y) if self.undivided[i] and _share(np.concatenate([q, a]), window) >= self.question_overlap else None

    def rows(self, c: Chunk):
        """(row, item_id, score, question overlap, answer overlap): for each row and item the best verified window."""
        words, at = clean_words(c)
        single = []
        if len(self.words):
            hit = np.flatnonzero(np.isin(words, self.words))
            found = {(int(np.searchsorted(at, i, "right")) - 1, int(words[i])) for i in hit.tolist()}
            single = [(r, i, 1.0, 1.0, 1.0) for r, w in sorted(found) for i in self.single[w]]
        if not len(self.index.terms):
            return single
        term = self.index.lookup(rolling(words, TERM))
        total = np.concatenate([[0.0], np.cumsum(np.where(term >= 0, self.index.essential[np.maximum(term, 0)], 0))])
        first, row = [], []
        steps = np.maximum(1, -(-np.diff(at) // STRIDE) - 1) * (np.diff(at) > 0)
        row = np.repeat(np.arange(c.rows), steps)
        first = at[:-1][row] + STRIDE * (np.arange(len(row)) - np.repeat(np.cumsum(steps) - steps, steps))
        last = np.minimum(first + 2 * STRIDE, at[1:][row])
        final = np.maximum(last - TERM + 1, first)  # terms that begin in [first, final) lie whole in the window
        best: dict[tuple[int, int], tuple] = {}
        for w in np.flatnonzero(total[final] - total[first] >= self.index.threshold - self.index.slack - 1e-9).tolist():
            a, b, r = int(first[w]), int(last[w]), int(row[w])
            part = np.unique(term[a : int(final[w])])
            part = part[part >= 0]
            if not self.index.hopeful(part):
                continue
            for piece, score in self.index.search(part.tolist()):
                item = self.owner[piece]
                # an item longer than the stride may reach beyond the window
                more = max(0, sum(len(x) for x in self.parts[item]) - STRIDE)
                found = self.verify(item, words[max(int(at[r]), a - more) : min(int(at[r + 1]), b + more)])
                if found and (score, *found) > best.get((r, item), (-1,)):
                    best[r, item] = (score, *found)
        return single + [(r, self.ids[i], *x) for (r, i), x in sorted(best.items())]


def _found(docs: DataFrame, items: DataFrame, question: str, answer: str | None, threshold: float, question_overlap: float, answer_overlap: float, min_words: int) -> DataFrame:
    """Rows of ``leaks`` with ``body``, a hash of the document's text."""
    spark = docs.sparkSession
    work = Workspace(spark, "leaks")
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64(F.col("text").cast("string")).alias("body"))
    known = items.filter(F.col("item_id").isNotNull()).select(F.col("item_id").cast("long"), F.coalesce(F.col(question).cast("string"), F.lit("")).alias("q"), (F.col(answer) if answer else F.lit(None)).cast("string").alias("a")).distinct()
    groups = max(1, -(-known.count() // GROUP))
    schema = "doc_id long, body long, item_id long, score double, question_overlap double, answer_overlap double"

    def scan(group: DataFrame, name: str) -> DataFrame:
        rows = sorted((tuple(r) for r in group.collect()), key=repr)
        sent = work.broadcast(Matcher(rows, threshold, question_overlap, answer_overlap, min_words))

        def of(batches):
            matcher = sent.value
            for b in batches:
                for c in chunks(b.column("text"), lower=True):
                    found = matcher.rows(c)
                    if found:
                        at = pa.array([c.first + f[0] for f in found])
                        yield pa.RecordBatch.from_arrays([
                            b.column("doc_id").take(at), b.column("body").take(at), pa.array([f[1] for f in found], pa.int64()),
                            *(pa.array([f[k] for f in found], pa.float64()) for k in (2, 3, 4))], ["doc_id", "body", "item_id", "score", "question_overlap", "answer_overlap"])

        out = work.stash(docs.mapInArrow(of, schema), name)
        work.release()
        return out

    out = scan(known.filter(F.pmod(F.xxhash64("item_id", "q", "a"), F.lit(groups)) == 0) if groups > 1 else known, "found0")
    for g in range(1, groups):
        out = out.unionByName(scan(known.filter(F.pmod(F.xxhash64("item_id", "q", "a"), F.lit(groups)) == g), f"found{g}"))
    return out


def leaks(docs: DataFrame, items: DataFrame, question: str = "text", answer: str | None = None, threshold: float = 0.5, question_overlap: float = 0.6, answer_overlap: float = 0.6, min_words: int = 8) -> DataFrame:
    """One row for each document and test item that it leaks: doc_id, item_id, score, question_overlap, answer_overlap."""
    return _found(docs, items, question, answer, threshold, question_overlap, answer_overlap, min_words).drop("body")


def drop_leaking(docs: DataFrame, items: DataFrame, question: str = "text", answer: str | None = None, threshold: float = 0.5, question_overlap: float = 0.6, answer_overlap: float = 0.6, min_words: int = 8) -> DataFrame:
    """The rows of ``docs`` that leak no test item, all columns as they are."""
    doc, body = fresh_name("_doc", docs.columns), fresh_name("_body", docs.columns)
    bad = _found(docs, items, question, answer, threshold, question_overlap, answer_overlap, min_words).select(F.col("doc_id").alias(doc), F.col("body").alias(body)).distinct()
    return docs.join(bad, F.col("doc_id").cast("long").eqNullSafe(F.col(doc)) & (F.xxhash64(F.col("text").cast("string")) == F.col(body)), "left_anti")
