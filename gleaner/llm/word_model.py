"""Word pairs under interpolated modified Kneser-Ney, as hash-sharded tables that are joined to the documents' n-grams.

A word is a run of bytes outside the ASCII spaces; every text with words is START, its words, END. A pair's
probability falls back to the word's continuation probability, and that to the word's spelling under the symbol model
(``kneser_ney.SymbolModel``), so that an unseen clean word costs what its letters cost.

In back-off form a document's cost is a sum over its n-grams: every word costs its spelling and the escape, every
n-gram of the tables then adds its own ``delta``. So the tables of all orders are one table from n-gram to delta, cut
into hash shards by the n-gram's last word; nobody holds more than a shard, and shards, shuffles and joins grow with the trusted text:

1. Tasks count word pairs and send them by the shard of the first word, where they are summed and discounted.
2. Pairs go to the shard of their second word, where continuation counts arise; that is the stored table.
3. Chunks of documents send their distinct n-grams, with documents and counts, to the shards; each shard sends back one
   sum a document. A bitmap of fixed size leaves out most n-grams that no table has; it changes no result.

Hashes of 64 bits stand for words while pairs are counted, then hashes of 48 bits for n-grams: an n-gram that the tables
lack is taken for one of theirs in one of 2**48 / size cases. Deltas are whole steps of 1/FINE bit, so sums don't depend
on their order.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gleaner.llm import sketch
from gleaner.llm.textkernel import Chunk, chunks, mix
from gleaner.workspace import Workspace, shuffle_width

START, END = np.uint64(0x5BD1E9955BD1E995), np.uint64(0xC2B2AE3D27D4EB4F)
FINE = 1000  # steps of a bit in which deltas are stored
FLUSH = 1_000_000  # n-grams that a task holds
MAP_BITS = 27


def word_key(w: np.ndarray) -> np.ndarray:
    return w >> np.uint64(16)


def pair_key(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return word_key(mix(v * np.uint64(0x9E3779B97F4A7C15) + w))


def shard_of(word: np.ndarray, shards: int) -> np.ndarray:
    return ((mix(word) >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int32)


def spelled(c: Chunk, cost: np.ndarray) -> np.ndarray:
    """The coded cost of each word of a chunk between spaces, its closing space included."""
    from gleaner.llm.kneser_ney import BITS, CLASS, ORDER, SPACE_CLASS

    size = c.ends - c.starts + 1
    off = np.concatenate([[0], np.cumsum(size)])
    kind = np.int32 if off[-1] < 1 << 31 else np.int64
    place = np.arange(off[-1], dtype=kind)
    shift = np.repeat((c.starts - off[:-1]).astype(kind), size)
    sym = np.full(off[-1] + ORDER - 1, SPACE_CLASS, np.uint32)
    body = np.ones(off[-1], bool)
    body[off[1:] - 1] = False
    sym[ORDER - 1 :][body] = CLASS[c.data[(place + shift)[body]]]
    key = np.zeros(off[-1], np.uint32)
    for j in range(ORDER):
        before = sym[ORDER - 1 - j : len(sym) - j].copy()
        for i in range(j):  # what stands before the word is space
            at = off[:-1] + i
            before[at[size > i]] = SPACE_CLASS
        key |= before << np.uint32(BITS * j)
    total = np.concatenate([[0], np.cumsum(cost[key], dtype=np.int64)])
    return total[off[1:]] - total[off[:-1]]


def end_cost(cost: np.ndarray) -> int:
    """END is spelled as a word without letters."""
    from gleaner.llm.kneser_ney import BITS, ORDER, SPACE_CLASS

    return int(cost[sum(SPACE_CLASS << BITS * j for j in range(ORDER))])


def transitions(c: Chunk, cost: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, word before, word, coded spelling of the word) of every word of a chunk and of every END."""
    n = np.diff(c.word_at)
    h = c.word_hash()
    each = (n + 1) * (n > 0)
    place = np.arange(len(h)) + np.repeat(np.cumsum(n > 0) - (n > 0), n)
    v, w, s = np.full(each.sum(), START), np.full(each.sum(), END), np.full(each.sum(), end_cost(cost), np.int64)
    w[place], v[place + 1], s[place] = h, h, spelled(c, cost)
    return np.repeat(np.arange(c.rows), each), v, w, s


def _pack(*arrays) -> bytes:
    """Hashes and floats as they are (sorted keys of 48 bits in little more than 4 bytes), other integers in the fewest
    bytes and zlib-packed; ``_unpack`` gives them as int64."""
    out = []
    for a in arrays:
        if isinstance(a, np.ndarray) and a.dtype == np.uint64 and len(a) and int(a.max()) < 1 << 48:
            high = np.diff((a >> np.uint64(32)).astype(np.uint16), prepend=np.uint16(0))
            out.append(("key", zlib.compress(high.tobytes(), 1), a.astype(np.uint32).tobytes()))
            continue
        if isinstance(a, np.ndarray) and a.dtype.kind in "iu" and a.dtype != np.uint64:
            low, high = (int(a.min()), int(a.max())) if len(a) else (0, 0)
            kind = next(t for t in (np.uint8, np.uint16, np.int32, np.int64) if np.iinfo(t).min <= low and high <= np.iinfo(t).max)
            out.append((np.dtype(kind).str, zlib.compress(a.astype(kind).tobytes(), 1)))
        else:
            out.append(a)
    return pickle.dumps(out, 5)


def _keys(high: bytes, low: bytes) -> np.ndarray:
    top = np.cumsum(np.frombuffer(zlib.decompress(high), np.uint16), dtype=np.uint16)
    return top.astype(np.uint64) << np.uint64(32) | np.frombuffer(low, np.uint32)


def _unpack(blob) -> list:
    return [a if not isinstance(a, tuple) else _keys(*a[1:]) if a[0] == "key" else np.frombuffer(zlib.decompress(a[1]), a[0]).astype(np.int64) for a in pickle.loads(blob)]


def _shrunk(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and how often each comes."""
    at = _runs(sorted_keys)
    return sorted_keys[at], np.diff(np.append(at, len(sorted_keys)))


def _runs(sorted_keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    return np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])) if len(sorted_keys) else np.zeros(0, np.int64)


def _pair_sums(v: np.ndarray, w: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((w, v))
    v, w, n = v[order], w[order], n[order]
    at = np.flatnonzero(np.concatenate([[True], (v[1:] != v[:-1]) | (w[1:] != w[:-1])])) if len(v) else np.zeros(0, np.int64)
    return v[at], w[at], np.add.reduceat(n, at) if len(at) else n


def _word_first(w: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    word, at = np.unique(w, return_index=True)
    return word, s[at]


_RECORD = "shard int, kind int, blob binary"


def _records(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], ["shard", "kind", "blob"])


def _cut(shard: np.ndarray, shards: int, *arrays: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The arrays of each shard that has any, in their order."""
    order = np.argsort(shard.astype(np.uint16) if shards <= 1 << 16 else shard, kind="stable")
    at = np.searchsorted(shard[order], np.arange(shards + 1))
    for s in np.flatnonzero(np.diff(at)).tolist():
        yield s, [a[order[at[s] : at[s + 1]]] for a in arrays]


def _by_shard(rows: DataFrame, finish, schema: str) -> DataFrame:
    """``finish(shard, {kind: blobs})`` for each shard."""

    def of(batches):
        at, held = None, {}
        for b in batches:
            for s, k, x in zip(b.column("shard").to_pylist(), b.column("kind").to_pylist(), b.column("blob").to_pylist(), strict=True):
                if s != at:
                    if at is not None:
                        yield finish(at, held)
                    at, held = s, {}
                held.setdefault(k, []).append(x)
        if at is not None:
            yield finish(at, held)

    return rows.repartition(shuffle_width(rows.sparkSession), "shard").sortWithinPartitions("shard").mapInArrow(of, schema)


def _counted_row(shard: int, blob: bytes, counts: np.ndarray) -> pa.RecordBatch:
    cc = [int((counts == k).sum()) for k in (1, 2, 3, 4)] + [len(counts), int(counts.sum())]
    return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([blob], pa.binary()), pa.array([cc], pa.list_(pa.int64()))], ["shard", "blob", "cc"])


_STORED = "shard int, blob binary, cc array<long>"


class WordTables:
    """The sharded tables of a fit, and what tells their deltas: discounts, total of continuation counts, escape."""

    def __init__(self, table: DataFrame, shards: int, d: np.ndarray, total: int, escape: float):
        self.table, self.shards, self.d, self.total, self.escape = table, shards, d, total, escape

    def deltas(self):
        """A function from a table row's blob to (keys, deltas)."""
        d, total, escape = self.d, self.total, self.escape

        def of(blob) -> tuple[np.ndarray, np.ndarray]:
            from gleaner.llm.kneser_ney import UNIT

            word, n, cost, key, ratio, context, back = _unpack(blob)
            p = (n - d[np.minimum(n, 3)]) / total + escape * 2.0 ** -(cost / UNIT)
            own = -np.log2(p) - cost / UNIT + np.log2(escape)
            pair = -np.log2(1 + 2.0 ** (ratio / FINE) / np.repeat(p, n))
            keys, where = np.unique(np.concatenate([word, context]), return_inverse=True)
            single = np.bincount(where, np.concatenate([own, back]), len(keys))
            keys, value = np.concatenate([keys, key]), np.rint(np.concatenate([single, pair]) * FINE).astype(np.int32)
            order = np.argsort(keys)
            return keys[order], value[order]

        return of


def fit_words(trusted: DataFrame, sent, work: Workspace, stashed: str | None = None) -> WordTables:
    """The tables of ``trusted`` (text), empty where no text has a word; ``sent``: the broadcast symbol model; ``stashed``:
    the table in ``work`` that holds the texts, discarded when they are counted."""
    from gleaner.llm.kneser_ney import _discounts

    shards = 2 * shuffle_width(trusted.sparkSession)

    def count(batches):
        cost = sent.value.cost
        pairs, words, size = [], [], 0

        def emit():
            v, w, n = _pair_sums(*(np.concatenate(x) for x in zip(*pairs, strict=True)))
            rows = [(s, 0, _pack(*_shrunk(a), b, k)) for s, (a, b, k) in _cut(shard_of(v, shards), shards, v, w, n)]
            word, s = _word_first(*(np.concatenate(x) for x in zip(*words, strict=True)))
            return _records(rows + [(k, 1, _pack(*x)) for k, x in _cut(shard_of(word, shards), shards, word, s)])

        for b in batches:
            for c in chunks(b.column("text")):
                _, v, w, s = transitions(c, cost)
                if len(v):
                    pairs.append(_pair_sums(v, w, np.ones(len(v), np.int64)))
                    words.append(_word_first(w, s))
                    size += len(pairs[-1][0])
                if size > FLUSH:
                    yield emit()
                    pairs, words, size = [], [], 0
        if size:
            yield emit()

    def summed(shard, held):
        parts = [(np.repeat(v, k), w, n) for v, k, w, n in map(_unpack, held.get(0, []))] or [(np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64))]
        v, w, n = _pair_sums(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        word, s = _word_first(*(np.concatenate(x) for x in zip(*(map(_unpack, held[1]) if 1 in held else [(np.zeros(0, np.uint64), np.zeros(0, np.int64))]), strict=True)))
        return _counted_row(shard, _pack(*_shrunk(v), w, n, word, s), n)

    first = work.stash(_by_shard(trusted.mapInArrow(count, _RECORD), summed, _STORED), "pairs")
    if stashed:
        work.discard(stashed)

    def totals(rows: DataFrame) -> np.ndarray:
        from pyspark.sql import functions as F

        return np.array(list(rows.agg(*(F.coalesce(F.sum(F.col("cc")[k]), F.lit(0)) for k in range(6))).first()))

    cc = totals(first)
    if not cc[4]:
        return WordTables(first, shards, _discounts(cc[:4]), 1, 1.0)
    d_pair = _discounts(cc[:4])

    def turn(batches):
        """Pairs to the shard of their second word, as what their delta needs: discounted count by the context's freed mass."""
        held, size = [], 0

        def emit():
            w, key, ratio = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(w)
            return _records([(s, 0, _pack(*_shrunk(a), k, r)) for s, (a, k, r) in _cut(shard_of(w[order], shards), shards, w[order], key[order], ratio[order])])

        for b in batches:
            for shard, blob in zip(b.column("shard").to_pylist(), b.column("blob"), strict=True):
                v, k, w, n, word, s = _unpack(blob.as_py())
                if len(v):
                    at, cut = np.cumsum(k) - k, d_pair[np.minimum(n, 3)]
                    free, all_ = np.add.reduceat(cut, at), np.add.reduceat(n, at)
                    ratio = np.maximum((n - cut) / np.repeat(free, k), 2.0**-60)
                    held.append((w, pair_key(np.repeat(v, k), w), np.rint(np.log2(ratio) * FINE).astype(np.int32)))
                    size += len(w)
                    yield _records([(shard, 1, _pack(word_key(v), -np.log2(free / all_)))])
                yield _records([(shard, 2, _pack(word, s))])
                if size > FLUSH:
                    yield emit()
                    held, size = [], 0
        if size:
            yield emit()

    def table(shard, held):
        def all_of(kind, *types):
            return [np.concatenate(x) for x in zip(*map(_unpack, held[kind]), strict=True)] if kind in held else [np.zeros(0, t) for t in types]

        parts = [(np.repeat(w, k), key, ratio) for w, k, key, ratio in map(_unpack, held.get(0, []))] or [(np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64))]
        w, key, ratio = (np.concatenate(x) for x in zip(*parts, strict=True))
        context, back = all_of(1, np.uint64, np.float64)
        known, cost = all_of(2, np.uint64, np.int64)
        order = np.lexsort((key, w))
        w = w[order]
        at = _runs(w)
        n = np.diff(np.append(at, len(w)))
        by = np.argsort(known)
        cost = cost[by][np.searchsorted(known[by], w[at])] if len(at) else cost[:0]
        return _counted_row(shard, _pack(word_key(w[at]), n, cost, key[order], ratio[order], context, back), n)

    second = work.stash(_by_shard(first.select("shard", "blob").mapInArrow(turn, _RECORD), table, _STORED), "words")
    work.discard("pairs")
    cc = totals(second)
    d = _discounts(cc[:4])
    free = d[1] * cc[0] + d[2] * cc[1] + d[3] * (cc[4] - cc[0] - cc[1])
    return WordTables(second, shards, d, int(cc[5]), float(free / cc[5]))


def known_grams(tables: WordTables, work: Workspace):
    """The broadcast bitmap of the tables' n-grams."""
    deltas = tables.deltas()

    def table_keys(batch):
        for blob in batch.column("blob"):
            yield deltas(blob.as_py())[0] << np.uint64(16)

    return work.broadcast(sketch.mark_repeated(tables.table.select("blob"), table_keys, [1], 1, [MAP_BITS]))


def word_costs(docs: DataFrame, sent, tables: WordTables, maybe) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, lang, k1, k2): all but the text, n_symbols, bits (symbol model), word_bits."""
    from gleaner.llm.kneser_ney import UNIT, gram_keys

    spark = docs.sparkSession
    shards, deltas, escape = tables.shards, tables.deltas(), round(-np.log2(tables.escape) * FINE)
    schema = "shard int, kind int, chunk long, blob binary"

    def ask(batches):
        from pyspark import TaskContext

        cost, chunk = sent.value.cost, TaskContext.get().partitionId() << 32
        for b in batches:
            for (first, grams, at), c in zip(gram_keys(b.column("text")), chunks(b.column("text")), strict=True):
                total = np.concatenate([[0], np.cumsum(cost[grams], dtype=np.int64)])
                row, v, w, s = transitions(c, cost)
                base = np.bincount(row, s * (FINE // UNIT) + escape, c.rows).astype(np.int64)
                head = _pack(
                    pickle.dumps([b.column(x).slice(first, c.rows).to_pylist() for x in ("doc_id", "lang", "k1", "k2")]),
                    np.diff(at), total[at[1:]] - total[at[:-1]], base)
                rows = [(chunk % shards, 1, head)]
                opening = v == START
                key = np.concatenate([word_key(w), word_key(v[opening]), pair_key(v, w)])
                home = np.concatenate([w, v[opening], w])
                place = np.concatenate([row, row[opening], row])
                some = np.flatnonzero(maybe.value.reach(key << np.uint64(16)))
                key, place = key[some], place[some].astype(np.uint64)
                # by key, then document, in one sort; documents alike in 16 bits may come in more runs than they must
                order = np.argsort(key << np.uint64(16) | place & np.uint64(0xFFFF))
                key, home, place = key[order], home[some[order]], place[order].astype(np.int64)
                cut = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (place[1:] != place[:-1])])) if len(key) else np.zeros(0, np.int64)
                times = np.diff(np.append(cut, len(key)))
                key, home, place = key[cut], home[cut], place[cut]
                for k, (x, p, t) in _cut(shard_of(home, shards), shards, key, place, times):
                    rows.append((k, 2, _pack(*_shrunk(x), p, t)))
                yield pa.RecordBatch.from_arrays([
                    pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([chunk] * len(rows), pa.int64()),
                    pa.array([r[2] for r in rows], pa.binary())], ["shard", "kind", "chunk", "blob"])
                chunk += 1

    def offer(batches):
        for b in batches:
            for shard, blob in zip(b.column("shard").to_pylist(), b.column("blob"), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([0], pa.int32()), pa.array([-1], pa.int64()), pa.array([_pack(*deltas(blob.as_py()))], pa.binary())], ["shard", "kind", "chunk", "blob"])

    def answer(batches):
        """Rows come by shard, its table first."""
        at, keys, value = None, None, None
        for b in batches:
            out = []
            for shard, kind, chunk, blob in zip(b.column("shard").to_pylist(), b.column("kind").to_pylist(), b.column("chunk").to_pylist(), b.column("blob"), strict=True):
                if kind == 0:
                    at, (keys, value) = shard, _unpack(blob.as_py())
                elif kind == 1:
                    out.append((chunk, 0, blob.as_py()))
                elif at == shard and len(keys):
                    x, size, place, times = _unpack(blob.as_py())
                    where = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
                    found = np.where(keys[where] == x, value[where], 0)
                    out.append((chunk, 1, _pack(np.bincount(place, np.repeat(found, size) * times).astype(np.int64))))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int32()), pa.array([r[2] for r in out], pa.binary())], ["chunk", "kind", "blob"])

    def gather(batches):
        """Rows come by chunk, its head first."""
        head = None

        def done():
            (ids, langs, k1, k2), n, symbol, word = head
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(langs, pa.string()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(n, pa.int64()), pa.array(symbol / UNIT, pa.float64()), pa.array(word / FINE, pa.float64())],
                                              ["doc_id", "lang", "k1", "k2", "n_symbols", "bits", "word_bits"])

        for b in batches:
            for kind, blob in zip(b.column("kind").to_pylist(), b.column("blob"), strict=True):
                if kind == 0:
                    if head is not None:
                        yield done()
                    names, n, symbol, word = _unpack(blob.as_py())
                    head = (pickle.loads(names), n, symbol, word)
                else:
                    (bits,) = _unpack(blob.as_py())
                    head[3][: len(bits)] += bits
        if head is not None:
            yield done()

    width = shuffle_width(spark)
    rows = tables.table.select("shard", "blob").mapInArrow(offer, schema).unionByName(docs.select("doc_id", "text", "lang", "k1", "k2").mapInArrow(ask, schema))
    told = rows.repartition(width, "shard").sortWithinPartitions("shard", "kind").mapInArrow(answer, "chunk long, kind int, blob binary")
    return told.repartition(width, "chunk").sortWithinPartitions("chunk", "kind").mapInArrow(gather, "doc_id long, lang string, k1 long, k2 long, n_symbols long, bits double, word_bits double")
