"""Quality classifier: interpolated modified Kneser-Ney over trusted text, thresholded by language on held-out text.

Two models of the trusted text judge a document: word pairs in hash-sharded tables that grow with the text and are
joined to each document's n-grams (``word_model``), and byte trigrams, which also spell the words that the tables
lack. A document is kept where both perplexities (a byte) are within their thresholds. One trusted document of HELD
isn't counted by either; these tell the thresholds. Of the byte model:

1. Trusted documents (``labels.quality = 1``) are found by a join on doc_id behind a bitmap of fixed size, so that few
   other texts are shuffled. Tasks count trigrams and send them by the shard of the oldest byte.
2. Sharded count joins: each shard sums its counts; the shards' presence maps are joined into continuation counts of
   the lower orders; each shard then joins its counts with the lower order's probabilities. Discounts are at least 0.05.
3. Every document is scored in one pass over whole texts with the shards of log-probabilities (32 MiB, to 1/1000 bit,
   broadcast packed); the same pass sends its word n-grams to their tables.
4. A document's perplexity is shrunk to its language's mean with the weight of ``prior`` bytes, because a few words
   say little. A language's threshold is the ``quantile`` of its held-out documents' costs plus ``margin`` bits a byte,
   the room for what a small sample hasn't shown; documents above it are rejected. A language with trusted documents of which none is held out uses those that it has.

Defined results: NULL and empty texts have no symbols, perplexity NULL and are kept; a language without trusted
documents (NULL language included) uses the mean and threshold of all languages together; without any trusted
document everything is kept; repeated rows are scored alike; an empty table gives an empty result; other columns are
ignored by ``perplexities`` and kept by ``keep_good``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm import sketch
from gleaner.llm.textkernel import SPACE, chunks, mix
from gleaner.llm.word_model import fit_words, known_grams, word_costs
from gleaner.operators.skew import join_counted
from gleaner.workspace import Workspace, fresh_name, shuffle_width

ORDER, BITS = 3, 8
SYMBOLS = 1 << BITS
SHARD = SYMBOLS ** (ORDER - 1)
SPACE_CLASS, LINE_END = 32, 10

#: Bytes are symbols; only the rarer ASCII spaces are written as a space or a line end.
CLASS = np.arange(SYMBOLS, dtype=np.uint8)
CLASS[SPACE] = SPACE_CLASS
CLASS[[10, 13]] = LINE_END
UNIT = 1000  # steps of a bit in which log-probabilities are stored
FLUSH = 2_000_000  # distinct grams that a task holds
HELD = 5  # one of so many trusted documents, by hash of doc_id, is not counted and tells the thresholds
_BUCKETS = 20_000  # histogram buckets a unit of log2 perplexity


def gram_keys(texts) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, trigram keys of a chunk, where each row's keys begin); rows begin after two line ends."""
    for c in chunks(texts):
        size = np.diff(c.offsets)
        pad = ORDER - 1
        stream = np.full(len(c.data) + pad * c.rows, LINE_END, np.uint32)
        keep = np.arange(len(c.data), dtype=np.int32 if len(stream) < 1 << 31 else np.int64) + np.repeat((pad * (np.arange(c.rows) + 1)).astype(np.int32 if len(stream) < 1 << 31 else np.int64), size)
        stream[keep] = CLASS[c.data]
        key = np.zeros(len(stream) - pad if len(stream) else 0, np.uint32)
        for j in range(ORDER):
            key |= stream[pad - j : len(stream) - j] << np.uint32(BITS * j)
        yield c.first, key[keep - pad], c.offsets


def _discounts(counts_of_counts: np.ndarray) -> np.ndarray:
    """D of 0, 1, 2, 3 and more (Chen and Goodman, 1999); 0.75 where a count of counts is missing."""
    n1, n2, n3, n4 = (float(x) for x in counts_of_counts)
    if min(n1, n2, n3, n4) <= 0:
        return np.array([0, 0.75, 0.75, 0.75])
    y = n1 / (n1 + 2 * n2)
    return np.array([0, *np.clip([1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3], 0.05, [1, 2, 3])])


def _interpolate(counts: np.ndarray, lower: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Rows are contexts, columns symbols: the discounted counts, with the freed mass given to ``lower``."""
    total = counts.sum(axis=1, keepdims=True)
    cut = d[np.minimum(counts, 3)]
    free = cut.sum(axis=1, keepdims=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        p = (counts - cut + free * lower) / total
    return np.where(total > 0, p, lower)


_PARTIAL = "shard int, salt int, cells binary, counts binary"


def _summed(rows: DataFrame, keys: list[str], packed: bool) -> DataFrame:
    """Sums of the partial counts of each key, streamed through one dense array of SHARD cells.

    ``packed``: (shard, counts) with zlib-packed int64, else partial counts again.
    """

    def of(batches):
        at, dense = None, np.zeros(SHARD, np.int64)

        def done():
            if packed:
                return pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int32()), pa.array([zlib.compress(dense.data, 1)], pa.binary())], ["shard", "counts"])
            c = np.flatnonzero(dense).astype(np.uint32)
            return pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int32()), pa.array([0], pa.int32()), pa.array([c.tobytes()], pa.binary()), pa.array([dense[c].tobytes()], pa.binary())], ["shard", "salt", "cells", "counts"])

        for b in batches:
            for shard, salt, c, n in zip(b.column("shard").to_pylist(), b.column("salt").to_pylist(), b.column("cells"), b.column("counts"), strict=True):
                key = (shard, salt) if "salt" in keys else (shard,)
                if key != at:
                    if at is not None:
                        yield done()
                    at = key
                    dense[:] = 0
                dense[np.frombuffer(c.as_buffer(), np.uint32)] += np.frombuffer(n.as_buffer(), np.int64)
        if at is not None:
            yield done()

    return rows.repartition(shuffle_width(rows.sparkSession), *keys).sortWithinPartitions(*keys).mapInArrow(of, "shard int, counts binary" if packed else _PARTIAL)


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    key, back = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return key, np.bincount(back, np.concatenate([n for _, n in parts]), len(key)).astype(np.int64)


def _count_shards(trusted: DataFrame) -> DataFrame:
    """(shard, counts): the sum of every trusted document's trigrams.

    Where there are more tasks than shards, each shard is first summed in as many salted parts.
    """
    salts = max(1, shuffle_width(trusted.sparkSession) // SYMBOLS)

    def local(batches):
        from pyspark import TaskContext

        salt = TaskContext.get().partitionId()

        def emit(key: np.ndarray, n: np.ndarray):
            cut = np.searchsorted(key, np.arange(1, SYMBOLS, dtype=np.uint64) * SHARD)
            rows = [(s, k, c) for s, (k, c) in enumerate(zip(np.split(key, cut), np.split(n, cut), strict=True)) if len(k)]
            return pa.RecordBatch.from_arrays([
                pa.array([r[0] for r in rows], pa.int32()), pa.array([salt % salts] * len(rows), pa.int32()), pa.array([(r[1] % SHARD).astype(np.uint32).tobytes() for r in rows], pa.binary()),
                pa.array([r[2].tobytes() for r in rows], pa.binary())], ["shard", "salt", "cells", "counts"])

        held, size = [], 0
        for b in batches:
            for _, key, _ in gram_keys(b.column("text")):
                held.append(np.unique(key, return_counts=True))
                size += len(held[-1][0])
                if size > FLUSH:
                    held = [_merged(held)]
                    size = len(held[0][0])
                    if size > FLUSH // 2:
                        yield emit(*held[0])
                        held, size, salt = [], 0, salt + 1
        if size:
            yield emit(*_merged(held))

    part = trusted.mapInArrow(local, _PARTIAL)
    part = _summed(part, ["shard", "salt"], packed=False) if salts > 1 else part
    return _summed(part, ["shard"], packed=True)


def coded(p: np.ndarray) -> bytes:
    """-log2 p in units of 1/UNIT bit as 16-bit numbers, zlib-packed. They would end at 65 bits, which no probability reaches
    that comes from fewer than 2**57 symbols."""
    return zlib.compress(np.minimum(np.rint(-UNIT * np.log2(p)), 65535).astype(np.uint16).data, 1)


class SymbolModel:
    """The coded probability of every trigram, in packed shards: only workers hold the whole table."""

    def __init__(self, shards: list[bytes]):
        self.shards = shards
        self._cost = None

    def __getstate__(self):
        return self.shards

    def __setstate__(self, state):
        self.__init__(state)

    @property
    def cost(self) -> np.ndarray:
        if self._cost is None:
            self._cost = np.empty(SYMBOLS * SHARD, np.uint16)
            for s, packed in enumerate(self.shards):
                self._cost[s * SHARD : (s + 1) * SHARD] = np.frombuffer(zlib.decompress(packed), np.uint16)
        return self._cost


def fit(trusted: DataFrame, work: Workspace) -> SymbolModel | None:
    """None without trusted text."""
    shards = work.stash(_count_shards(trusted), "shards")

    def describe(batches):
        for b in batches:
            for c in b.column("counts"):
                dense = np.frombuffer(zlib.decompress(c.as_py()), np.int64)
                yield pa.RecordBatch.from_arrays([
                    pa.array([np.packbits(dense > 0).tobytes()], pa.binary()), pa.array([[int((dense == k).sum()) for k in (1, 2, 3, 4)]], pa.list_(pa.int64()))], ["seen", "cc"])

    found = shards.select("counts").mapInArrow(describe, "seen binary, cc array<long>").collect()
    if not found:
        return None
    # lower orders: in how many different contexts a shorter gram was seen
    below = np.zeros(SHARD, np.int64)
    for r in found:
        below += np.unpackbits(np.frombuffer(r.seen, np.uint8))
    d = _discounts(np.sum([r.cc for r in found], axis=0))
    orders = [below]
    while len(orders[-1]) > SYMBOLS:
        orders.append((orders[-1].reshape(SYMBOLS, -1) > 0).sum(axis=0))
    p = np.full(SYMBOLS, 1.0 / SYMBOLS)
    for counts in reversed(orders):
        table = counts.reshape(-1, SYMBOLS)
        lower = np.tile(p.reshape(-1, SYMBOLS), (len(table) // (len(p) // SYMBOLS), 1))
        p = _interpolate(table, lower, _discounts([(counts == k).sum() for k in (1, 2, 3, 4)])).ravel()
    lower = p.reshape(-1, SYMBOLS)

    def finish(batches):
        for b in batches:
            for s, c in zip(b.column("shard"), b.column("counts"), strict=True):
                counts = np.frombuffer(zlib.decompress(c.as_py()), np.int64).reshape(-1, SYMBOLS)
                yield pa.RecordBatch.from_arrays([pa.array([s.as_py()], pa.int32()), pa.array([coded(_interpolate(counts, lower, d))], pa.binary())], ["shard", "cost"])

    model = [coded(p)] * SYMBOLS
    del p, orders, below, table, counts
    for r in shards.mapInArrow(finish, "shard int, cost binary").collect():  # SYMBOLS rows
        model[r.shard] = bytes(r.cost)
    return SymbolModel(model)


def _likely(docs: DataFrame, ids: DataFrame, work: Workspace) -> DataFrame:
    """The rows of ``docs`` whose doc_id may be in ``ids``: a bitmap of 2**24 bits a sketch row, broadcast."""
    def keys(batch):
        yield mix(batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))

    sent = work.broadcast(sketch.mark_repeated(ids, keys, [1], 2, [24]))

    def of(batches):
        for b in batches:
            hit = sent.value.reach(next(keys(b)))
            yield b.filter(pa.array(hit))

    return docs.filter("doc_id is not null").mapInArrow(of, docs.schema)


_MODELS = (("word", "word_bits", ""), ("symbol", "bits", "symbol_"))


def _cuts(scores: DataFrame, good: DataFrame, code: Column, quantile: float, margin: float, prior: float, work: Workspace) -> DataFrame:
    """(code, docs and each model's mean and cut, in bits a symbol): what shrinks and bounds the documents of a language."""
    known = scores.filter("n_symbols > 0").join(good.hint("merge"), "doc_id").select(
        F.explode(F.array(F.struct(F.lit(False).alias("all"), code.alias("code")), F.struct(F.lit(True).alias("all"), F.lit("").alias("code")))).alias("of"), "held", "n_symbols", "bits", "word_bits")
    known = known.select("of.all", "of.code", "held", "n_symbols", "bits", "word_bits")
    sums = work.stash(known.groupBy("all", "code", "held").agg(*(F.sum(c).alias(c) for c in ("n_symbols", "bits", "word_bits"))), "sums")
    use = sums.groupBy("all", "code").agg(F.max_by(F.struct("held", *((F.col(b) / F.col("n_symbols")).alias(f"{m}_mean") for m, b, _ in _MODELS)), "held").alias("use")).select("all", "code", "use.*")
    shrunk = known.join(use, ["all", "code", "held"]).select("all", "code", F.explode(F.array(*(
        F.struct(F.lit(m).alias("model"), F.col(f"{m}_mean").alias("mean"), F.floor((F.col(b) + prior * F.col(f"{m}_mean")) / (F.col("n_symbols") + prior) * _BUCKETS).cast("long").alias("bucket")) for m, b, _ in _MODELS))).alias("x"))
    # the smallest bucket at which the share is reached; a group holds a count for each distinct bucket
    limit = (F.expr(f"percentile_disc({quantile}) WITHIN GROUP (ORDER BY bucket)") + 1) / F.lit(float(_BUCKETS)) + margin
    cuts = shrunk.select("all", "code", "x.*").groupBy("all", "code").pivot("model", [m for m, _, _ in _MODELS]).agg(F.max("mean").alias("mean"), limit.alias("cut"))
    cuts = work.stash(cuts, "limits")
    names = [f"{m}_{c}" for m, _, _ in _MODELS for c in ("mean", "cut")]
    general = cuts.filter("all").select(*(F.col(c).alias(f"all_{c}") for c in names))
    out = scores.groupBy(code.alias("code")).agg(F.count("*").alias("docs")).join(cuts.filter("not all").drop("all"), "code", "left").join(general, how="left")
    return work.stash(out.select("code", "docs", *(F.coalesce(c, f"all_{c}").alias(c) for c in names)), "cuts")


def perplexities(docs: DataFrame, labels: DataFrame, quantile: float = 0.999, margin: float = 0.05, prior: float = 100.0, batches: int = 4) -> DataFrame:
    """Per document: doc_id, lang, n_symbols, perplexity and threshold of the word model (both shrunk, a symbol), the
    same of the symbol model, keep. Documents are scored in ``batches`` by hash, so that fewer n-grams are on disk at once."""
    return _judged(docs, labels, quantile, margin, prior, batches).drop("k1", "k2")


def _text_keys(text: Column) -> list[Column]:
    """128 bits for a text: a row is judged by its text and language alone."""
    return [F.xxhash64(text), F.xxhash64(F.lit("other"), text)]


def _judged(docs: DataFrame, labels: DataFrame, quantile: float = 0.999, margin: float = 0.05, prior: float = 100.0, batches: int = 4) -> DataFrame:
    spark = docs.sparkSession
    work = Workspace(spark, "kneser-ney")
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"), *(k.alias(n) for k, n in zip(_text_keys(F.col("text").cast("string")), ("k1", "k2"), strict=True)))
    good = labels.filter("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long")).distinct()
    good = good.withColumn("held", F.pmod(F.xxhash64("doc_id", F.lit("held out")), F.lit(HELD)) == 0)
    trusted = work.stash(_likely(docs.select("doc_id", "text"), good, work).join(good.hint("merge"), "doc_id").select("text", "held"), "trusted")
    work.release()
    train = trusted.filter("not held").select("text")
    model = fit(train, work)
    if model is None:  # too few trusted documents to hold some out
        train = trusted.select("text")
        model = fit(train, work)
    if model is None:
        none = [F.lit(None).cast("double").alias(c) for c in ("perplexity", "threshold", "symbol_perplexity", "symbol_threshold")]
        return docs.select("doc_id", "lang", "k1", "k2", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_symbols"), *none, F.lit(True).alias("keep"))
    sent = work.broadcast(model)
    tables = fit_words(train, sent, work, "trusted")
    maybe, scores = known_grams(tables, work), None
    for b in range(batches):  # what a batch shuffles is gone before the next
        part = work.stash(word_costs(docs.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(batches)) == b), sent, tables, maybe), f"scores{b}")
        scores = part if scores is None else scores.unionByName(part)
    work.discard("words", "shards")
    work.release()
    code = F.coalesce("lang", F.lit(""))
    cuts = _cuts(scores, good, code, quantile, margin, prior, work)
    judged = join_counted(scores.withColumn("code", code), cuts, ["code"], "docs", F.struct("doc_id", "bits"), "left")
    out, within = [], F.lit(True)
    for m, bits, name in _MODELS:
        shrunk, limit = (F.col(bits) + prior * F.col(f"{m}_mean")) / (F.col("n_symbols") + prior), F.col(f"{m}_cut")
        out += [F.when(F.col("n_symbols") > 0, F.pow(F.lit(2.0), shrunk)).alias(f"{name}perplexity"), F.pow(F.lit(2.0), limit).alias(f"{name}threshold")]
        within = within & F.coalesce(shrunk <= limit, F.lit(True))
    return judged.select("doc_id", "lang", "k1", "k2", "n_symbols", *out, (F.col("n_symbols").eqNullSafe(0) | within).alias("keep"))


def keep_good(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs`` that are not rejected, all columns as they are.

    Each row goes by its own text and language, also where doc_id is NULL or repeated.
    """
    names = [fresh_name(n, docs.columns) for n in ("_doc", "_lang", "_k1", "_k2")]
    gone = _judged(docs, labels, **settings).filter(~F.col("keep")).select("doc_id", "lang", "k1", "k2").distinct().toDF(*names)
    own = [F.col("doc_id").cast("long"), F.col("lang").cast("string"), *_text_keys(F.col("text").cast("string"))]
    same = [mine.eqNullSafe(F.col(n)) for mine, n in zip(own, names, strict=True)]
    return docs.join(gone, same, "left_anti")
