"""Source divergence audit: which words set a source apart from its language, and how far sources are from each other.

Terms are runs of letters (ASCII letters and every character beyond ASCII), A-Z lower-cased. A language keeps the terms
in at least ``min_docs`` of its documents. A group (language, source) and the language itself give each kept term the
integer p = 1 + SCALE * (count + 1) div (N + V) of its occurrences there; f(p, q) = (p - q) ** 2 div q.

* Part ``term``: the kept terms that a group uses more than its language, by f, the ``most`` highest. Radix selection
  (``radix_top``) finds the threshold of each group from histograms, so no group is sorted or gathered.
* Part ``pair``: for each group and each other source of the language, the sum of f over all kept terms. Most terms
  occur in few sources, and where a source lacks a term its p is a constant. So the sum starts from the baseline of two
  constants times V, is corrected for the terms of either source by their counts of equal p, and for the terms of both
  one by one. Sources are numbered and cut into blocks of ``side``; two blocks make a matrix, summed by tasks that each
  see a share of the terms, in 64-bit integers. A task's memory is one such matrix, whatever holds the rows.

Texts are counted in Arrow batches: a task sends a row for each (language, source, term) that it has met since it last
passed ``flush`` entries. All arithmetic is exact (quotients of products beyond 64 bits are taken in decimals).

Defined results: NULL text, lang and source are ''; each row is a document, also where doc_id is NULL or repeated; a group
without terms is a group; a language without kept terms has pairs of value 0; a language of one source has no pairs; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.radix import radix_top
from gleaner.llm.textkernel import LETTERS, class_terms, slices
from gleaner.operators.skew import join_counted
from gleaner.workspace import Workspace, shuffle_width

SCALE, SIDE, FLUSH, FLUSH_CHARS, PAIRS = 1_000_000_000, 256, 2_000_000, 32 << 20, 1 << 20


class _Held:
    """A task's counts: terms and groups are numbered, counts are sorted arrays of (group, term)."""

    def __init__(self, flush: int):
        self.flush = flush
        self.groups: dict[tuple[str, str], int] = {}
        self.clear()

    def clear(self) -> None:
        self.terms: dict[str, int] = {}
        self.chars, self.entries, self.parts = 0, 0, []

    def number(self, terms: list[str]) -> np.ndarray:
        known = self.terms
        before = len(known)
        out = np.fromiter((known.setdefault(t, len(known)) for t in terms), np.int64, len(terms))
        if len(known) > before:
            self.chars += sum(len(t) for t, i in zip(terms, out.tolist(), strict=True) if i >= before)
        return out

    def merged(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        keys, n, docs = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.argsort(keys, kind="stable")
        keys, n, docs = keys[order], n[order], docs[order]
        at = np.flatnonzero(np.diff(keys, prepend=-1))
        return keys[at], np.add.reduceat(n, at), np.add.reduceat(docs, at)

    def add(self, keys: np.ndarray, n: np.ndarray, docs: np.ndarray) -> bool:
        """Whether the held rows should be sent."""
        if len(keys):
            self.parts.append((keys, n, docs))
            self.entries += len(keys)
        if self.entries > self.flush:
            self.parts = [self.merged()]
            self.entries = len(self.parts[0][0])
        return self.entries > self.flush // 2 or self.chars > FLUSH_CHARS

    def send(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            keys, n, docs = self.merged()
            names, terms = list(self.groups), pa.array(list(self.terms), pa.string())
            lang, source = (pa.array([x[i] for x in names], pa.string()) for i in (0, 1))
            for i in range(0, len(keys), 1 << 15):
                part = slice(i, i + (1 << 15))
                g, t = pa.array(keys[part] >> 32), pa.array(keys[part] & 0xFFFFFFFF)
                yield pa.RecordBatch.from_arrays([lang.take(g), source.take(g), terms.take(t), pa.array(n[part]), pa.array(docs[part])], ["lang", "source", "term", "n", "docs"])
        self.clear()


def _counts(batches: Iterator[pa.RecordBatch], flush: int) -> Iterator[pa.RecordBatch]:
    held = _Held(flush)
    for b in batches:
        pairs = zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)
        group = np.fromiter((held.groups.setdefault(p, len(held.groups)) for p in pairs), np.int64, b.num_rows)
        for first, last, data, offsets in slices(b.column(2)):
            terms, codes, at = class_terms(data, offsets, LETTERS)
            if not len(codes):
                continue
            number = held.number(terms.to_pylist())
            row = np.repeat(np.arange(first, last), np.diff(at))
            in_doc, n = np.unique(row << 32 | number[codes], return_counts=True)
            keys = group[in_doc >> 32] << 32 | in_doc & 0xFFFFFFFF
            order = np.argsort(keys, kind="stable")
            keys, n = keys[order], n[order]
            start = np.flatnonzero(np.diff(keys, prepend=-1))
            if held.add(keys[start], np.add.reduceat(n, start), np.diff(np.append(start, len(keys)))):
                yield from held.send()
    yield from held.send()
    if held.groups:  # every group is told once, with or without terms
        names = list(held.groups)
        none = pa.nulls(len(names), pa.string())
        zero = pa.array(np.zeros(len(names), np.int64))
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in names], pa.string()), pa.array([x for _, x in names], pa.string()), none, zero, zero], ["lang", "source", "term", "n", "docs"])


def _p(count: Column, total: Column) -> Column:
    whole = F.lit(SCALE).cast("decimal(10,0)") * (count + 1).cast("decimal(19,0)")
    return (F.lit(1).cast("long") + F.call_function("div", whole, total.cast("decimal(19,0)"))).cast("long")


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


class _Sums:
    """The sums of a pair of source blocks: rows are the sources judged, columns the others."""

    def __init__(self, a: int, b: int, side: int, pairs: int):
        self.a, self.b, self.side, self.pairs = a, b, side, pairs
        self.names: list[str | None] = [None] * (2 * side)
        self.p0, self.here = np.ones(2 * side, np.int64), np.zeros(2 * side, bool)
        self.sums, self.base = np.zeros((2 * side, 2 * side), np.int64), None
        self.terms, self.told = 0, False
        self.rest: tuple[str, np.ndarray, np.ndarray] | None = None

    def local(self, idx: np.ndarray) -> np.ndarray:
        return np.where(idx // self.side == self.a, 0, self.side) + idx % self.side

    def sources(self, idx: np.ndarray, names: list[str], p0: np.ndarray, v: np.ndarray, tells: bool) -> None:
        at = self.local(idx)
        for i, name in zip(at.tolist(), names, strict=True):
            self.names[i] = name
        self.p0[at], self.here[at] = p0, True
        self.terms, self.told = int(v[0]), tells

    def baseline(self) -> np.ndarray:
        if self.base is None:
            self.base = _f(self.p0[:, None], self.p0[None, :])
        return self.base

    def alone(self, idx: np.ndarray, p: np.ndarray, n: np.ndarray) -> None:
        """Terms of one source as if no other had them: ``n`` terms have the same p."""
        base = self.baseline()
        for i in range(0, len(idx), 4096):
            x, pp, nn = self.local(idx[i : i + 4096]), p[i : i + 4096, None], n[i : i + 4096, None]
            np.add.at(self.sums, x, nn * (_f(pp, self.p0[None, :]) - base[x]))
            np.add.at(self.sums.T, x, nn * (_f(self.p0[None, :], pp) - base[:, x].T))

    def shared(self, idx: np.ndarray, p: np.ndarray, starts: np.ndarray) -> None:
        """Sorted terms of several sources: what is not additive over the two of a pair."""
        base, ends = self.baseline(), np.append(starts[1:], len(idx))
        x, size = self.local(idx), ends - starts
        if not len(size):
            return
        todo = np.cumsum(size * size)
        i = 0
        while i < len(starts):
            j = max(i + 1, int(np.searchsorted(todo, (todo[i - 1] if i else 0) + self.pairs, "right")))
            m = np.repeat(size[i:j], size[i:j])  # for each row, the rows of its term
            left = np.repeat(np.arange(starts[i], ends[j - 1]), m)
            right = np.repeat(np.repeat(starts[i:j], size[i:j]), m) + np.arange(len(left)) - np.repeat(np.cumsum(m) - m, m)
            other = left != right
            left, right = left[other], right[other]
            g, o = x[left], x[right]
            fix = _f(p[left], p[right]) - _f(p[left], self.p0[o]) - _f(self.p0[g], p[right]) + base[g, o]
            np.add.at(self.sums, (g, o), fix)
            i = j

    def terms_of(self, term: pa.Array, idx: np.ndarray, p: np.ndarray, last: bool = False) -> None:
        """Rows in the order of their term; the last term may go on in the next batch."""
        if len(idx):
            code = np.asarray(term.dictionary_encode().indices)
            starts = np.flatnonzero(np.diff(code, prepend=-1))
            if self.rest is not None:
                name, ri, rp = self.rest
                if term[0].as_py() == name:
                    starts = np.append(0, starts[1:] + len(ri))
                else:
                    starts = np.append(0, starts + len(ri))
                idx, p = np.append(ri, idx), np.append(rp, p)
            cut = int(starts[-1])
            self.rest = (term[-1].as_py(), idx[cut:], p[cut:])
            self.shared(idx[:cut], p[:cut], starts[:-1])
        if last and self.rest is not None:
            self.shared(self.rest[1], self.rest[2], np.zeros(1, np.int64))
            self.rest = None

    def out(self, lang: str) -> pa.RecordBatch | None:
        self.terms_of(pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, np.int64), last=True)
        first, second = self.here.copy(), self.here.copy()
        first[self.side :], second[: self.side] = False, False
        want = self.here[:, None] & self.here[None, :] & ~np.eye(2 * self.side, dtype=bool) if self.a == self.b else first[:, None] & second[None, :] | second[:, None] & first[None, :]
        if self.told:  # one of the tasks of a pair of blocks adds the baseline
            self.sums = self.sums + self.terms * self.baseline()
        else:
            want &= self.sums != 0
        g, o = np.nonzero(want)
        if not len(g):
            return None
        names = pa.array(self.names, pa.string())
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), names.take(pa.array(g)), names.take(pa.array(o)), pa.array(self.sums[g, o])], ["lang", "source", "item", "value"])


def _pair_sums(batches: Iterator[pa.RecordBatch], side: int, pairs: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (lang, a, b, salt, kind, term): a run of (lang, a, b, salt) has its sources, then counts of p, then terms."""
    key, run = None, None
    for batch in batches:
        lang = batch.column("lang").dictionary_encode()
        a, b, salt, kind, idx, p, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("a", "b", "salt", "kind", "idx", "p", "n"))
        edge = np.zeros(batch.num_rows, bool)
        for x in (np.asarray(lang.indices), a, b, salt, kind):
            edge[1:] |= x[1:] != x[:-1]
        cuts = [0, *np.flatnonzero(edge).tolist(), batch.num_rows]
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            now = (lang[s].as_py(), int(a[s]), int(b[s]), int(salt[s]))
            if now != key:
                if run is not None and (found := run.out(key[0])) is not None:
                    yield found
                key, run = now, _Sums(now[1], now[2], side, pairs)
            name = batch.column("name").slice(s, e - s)
            if kind[s] == 0:
                run.sources(idx[s:e], name.to_pylist(), p[s:e], n[s:e], now[3] == 0)
            elif kind[s] == 1:
                run.alone(idx[s:e], p[s:e], n[s:e])
            else:
                run.terms_of(name, idx[s:e], p[s:e])
    if run is not None and (found := run.out(key[0])) is not None:
        yield found


def _pairs(groups: DataFrame, seen: DataFrame, spark_width: int, side: int, most_pairs: int) -> DataFrame:
    """(lang, source, item, value): ``groups`` has lang, source, idx, blocks (of its language), p0, terms; ``seen`` lang, source, idx, blocks, term, p."""
    total = groups.filter("idx = 0").agg(F.sum(F.expr("blocks * (blocks + 1) div 2"))).first()[0] or 1
    salts = max(1, -(-spark_width // total))
    kinds = "lang string, idx long, blocks long, name string, p long, n long, kind int, salt int"
    names = [c.split()[0] for c in kinds.split(", ")]
    every = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).select("lang", "idx", "blocks", F.col("source").alias("name"), F.col("p0").alias("p"), F.col("terms").alias("n"), F.lit(0).alias("kind"), "salt")
    equal = seen.groupBy("lang", "idx", "blocks", "p").agg(F.count("*").alias("n")).select("lang", "idx", "blocks", F.lit(None).cast("string").alias("name"), "p", "n", F.lit(1).alias("kind"), F.pmod(F.xxhash64("p"), F.lit(salts)).cast("int").alias("salt"))
    terms = seen.select("lang", "idx", "blocks", F.col("term").alias("name"), "p", F.lit(1).cast("long").alias("n"), F.lit(2).alias("kind"), F.pmod(F.xxhash64("term"), F.lit(salts)).cast("int").alias("salt"))
    mine = F.expr(f"idx div {side}")
    rows = every.select(*names).unionByName(equal.select(*names)).unionByName(terms.select(*names))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).withColumn("a", F.least(mine, "other")).withColumn("b", F.greatest(mine, "other"))
    rows = rows.select("lang", "a", "b", "salt", "kind", "name", "idx", "p", "n").repartition(spark_width, "lang", "a", "b", "salt").sortWithinPartitions("lang", "a", "b", "salt", "kind", "name")
    sums = lambda batches: _pair_sums(batches, side, most_pairs)
    return rows.mapInArrow(sums, "lang string, source string, item string, value long").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def source_divergence(docs: DataFrame, min_docs: int = 3, most: int = 200, text: str = "text", lang: str = "lang", source: str = "source", side: int = SIDE, flush: int = FLUSH, pairs_at_once: int = PAIRS) -> DataFrame:
    """lang, source, part, item, value, rank."""
    spark = docs.sparkSession
    work = Workspace(spark, "divergence")
    read = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))))
    sent = read.mapInArrow(lambda batches: _counts(batches, flush), "lang string, source string, term string, n long, docs long")
    # one exchange: the counts of a term by source and by language lie in one task, at most a row a source and task
    w = Window.partitionBy("lang", "term")
    counts = sent.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    counts = counts.withColumn("lang_n", F.sum("n").over(w)).withColumn("lang_docs", F.sum("docs").over(w)).withColumn("lead", F.min("source").over(w) == F.col("source"))
    counts = work.stash(counts.filter(F.col("term").isNull() | (F.col("lang_docs") >= min_docs)).select("lang", "source", "term", "n", "lang_n", "lead"), "counts")
    kept = F.col("term").isNotNull()
    groups = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("term").alias("held"), F.count_if(kept & F.col("lead")).alias("led"))
    of_lang = Window.partitionBy("lang")  # sources, not rows
    groups = groups.withColumn("terms", F.sum("led").over(of_lang)).withColumn("lang_total", F.sum("total").over(of_lang)).withColumn("idx", F.row_number().over(of_lang.orderBy("source")).cast("long") - 1)
    groups = groups.withColumn("blocks", F.expr(f"(count(*) over (partition by lang) + {side - 1}) div {side}"))
    safe = F.greatest(F.col("total") + F.col("terms"), F.lit(1))
    groups = work.stash(groups.withColumn("p0", _p(F.lit(0).cast("long"), safe)), "groups")
    known = groups.select("lang", "source", "held", "terms", "total", "lang_total", "idx", "blocks")
    seen = join_counted(counts.filter(kept).select("lang", "source", "term", "n", "lang_n"), known, ["lang", "source"], "held", F.col("term"))
    seen = seen.withColumn("p", _p(F.col("n"), F.col("total") + F.col("terms"))).withColumn("q", _p(F.col("lang_n"), F.col("lang_total") + F.col("terms")))
    seen = work.stash(seen.select("lang", "source", "idx", "blocks", "term", "p", "q"), "seen")
    above = work.stash(seen.filter("p > q").select("lang", "source", F.col("term").alias("item"), F.expr("(p - q) * (p - q) div q").alias("value")), "above")
    top = radix_top(above, ["lang", "source"], "value", "item", most, work)
    pairs = _pairs(groups, seen, shuffle_width(spark), side, pairs_at_once)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(order))
    cols = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.col("rank").cast("int").alias("rank"))
    return cols(pairs, "pair").unionByName(cols(top, "term"))
