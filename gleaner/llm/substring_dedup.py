"""Substring dedup: remove words covered by a window of words whose sequence also starts earlier.

Two passes over whole texts.

1. Count-min prefilter. Each window is represented by its minimizer, the m-gram of words with the smallest hash in
   it; equal windows have equal minimizers at equal places, so the number of places at which a minimizer is chosen
   overestimates no window by less than its own count. Partition sketches of the minimizers are merged
   (``sketch.mark_repeated``) into bitmaps of fixed size.
2. Only windows whose minimizer is estimated repeated are grouped, by a 96-bit hash. Blocks of documents send each
   distinct hash once, with its first place in the block, to the hash's range; the range replies with one bit an
   entry: whether the first place of all is in that block. So a window in a third of all documents costs its range
   one entry a block, and no task gathers the occurrences of a window.

Defined results: NULL and empty texts have no words, nothing removed, and the hash of the empty string; repeated
doc_ids (NULL, the smallest, among them) are kept as separate rows, and of equal (doc_id, start) one alone counts as the
first, that of the smaller block; an empty table gives an empty result; other columns of the input are ignored. Blocks
are numbered by task and place, so both scans must see the same rows in the same order: an input that comes from a
shuffle is written first, and a checksum of each block's entries stops the job where the scans disagree. Memory is a few
times CHUNK_BYTES or the longest text, and RANGE_BYTES in a hash range.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm import sketch
from gleaner.llm.textkernel import Chunk, chunks, mix, rolling
from gleaner.workspace import Workspace, shuffle_width

#: The least number of hash ranges that windows are dealt to; a power of two. There are at least twice as many as
#: shuffle partitions, and so many that a range holds about RANGE_BYTES by the sketch's own totals.
RANGES, RANGE_BYTES, ENTRY_BYTES = 64, 64 << 20, 24
#: log2 of the bits of a merged bitmap: 32 MiB a sketch row.
FOLD = 28
_POS = np.uint64((1 << 32) - 1)


def _anchors(chunk: Chunk, words: np.ndarray, window: int, gram: int):
    """Starts of all windows within one row, and for each the place of its leftmost minimizer; the m-gram hashes."""
    grams = rolling(words, gram)
    n = len(words) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), grams
    key = (grams & ~_POS) | np.arange(len(grams), dtype=np.uint64)
    span, low, have = window - gram + 1, key, 1
    while 2 * have <= span:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if have < span:
        low = np.minimum(low[: len(low) - (span - have)], low[span - have :])
    starts = np.arange(n)
    starts = starts[starts + window <= chunk.word_end()[:n]]
    return starts, (low[starts] & _POS).astype(np.int64), grams


def _minimizers(window: int, gram: int):
    def of(batch: pa.RecordBatch):
        for c in chunks(batch.column("text")):
            _, place, grams = _anchors(c, c.word_hash(), window, gram)
            if len(place):
                yield grams[place[np.flatnonzero(np.diff(place, prepend=-1))]]

    return of


def _sha(text: bytes) -> str:
    return hashlib.sha256(text).hexdigest()


def _kept(chunk: Chunk, row: int, drop: np.ndarray) -> bytes:
    words = bytes(chunk.data[chunk.offsets[row] : chunk.offsets[row + 1]]).split()
    return b" ".join([w for w, d in zip(words, drop.tolist(), strict=True) if not d])


_DOCS = "block long, n_entries int, checksum long, doc_id long, n_words long, sha string, text string, starts binary, entries binary"
_ASKED = "part int, block long, base int, checksum long, asked binary"


class _Windows:
    """The windows of a chunk that may be repeated, and the chunk's distinct ones in hash order."""

    def __init__(self, c: Chunk, ids: np.ndarray, marks: sketch.Marks, window: int, gram: int):
        words = c.word_hash()
        starts, place, grams = _anchors(c, words, window, gram)
        starts = starts[marks.reach(grams[place])] if len(place) else starts
        self.row = np.searchsorted(c.word_at, starts, "right") - 1
        self.at = starts - c.word_at[self.row]
        doc = ids[c.first : c.last]
        h1 = rolling(words, window)[starts] if len(starts) else np.zeros(0, np.uint64)
        h2 = (rolling(c.word_hash(1), window, 1)[starts] >> np.uint64(32)).astype(np.uint32) if len(starts) else np.zeros(0, np.uint32)
        order = np.lexsort((self.at, doc[self.row], h2, h1))
        a, b = h1[order], h2[order]
        new = np.ones(len(order), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        self.entry = np.empty(len(order), np.int64)
        self.entry[order] = np.cumsum(new) - 1
        self.head = order[new]
        self.first_here = np.zeros(len(order), bool)
        self.first_here[self.head] = True
        self.h1, self.h2, self.doc = h1[self.head], h2[self.head], doc[self.row[self.head]]
        places = (self.row.astype(np.uint64) << np.uint64(32)) + self.at.astype(np.uint64)
        self.checksum = int((mix(h1 ^ mix(places)) + h2).sum(dtype=np.uint64).astype(np.int64))

    def asked(self, ranges: int) -> list[tuple[int, int, bytes]]:
        """(range, index of its first entry, entries) of each range that has any."""
        cut = np.searchsorted(self.h1, np.arange(1, ranges, dtype=np.uint64) << np.uint64(65 - ranges.bit_length()))
        edge = [0, *cut.tolist(), len(self.h1)]
        at = self.at[self.head].astype(np.int32)
        return [(p, s, b"".join(x[s:e].tobytes() for x in (self.h1, self.doc, self.h2, at))) for p, (s, e) in enumerate(zip(edge[:-1], edge[1:], strict=True)) if s < e]


def _blocks(batches, marks, window, gram):
    """Chunks in the order of the task's rows: the same in every attempt and in both passes, so they can be numbered."""
    from pyspark import TaskContext

    task, serial = TaskContext.get().partitionId(), 0
    for batch in batches:
        ids = batch.column("doc_id").fill_null(-(2**63)).to_numpy(zero_copy_only=False)
        for c in chunks(batch.column("text")):
            yield (task << 32) + serial, c, batch, _Windows(c, ids, marks, window, gram)
            serial += 1


def _ask(sent, window: int, gram: int, ranges: int):
    def of(batches):
        for block, _, _, w in _blocks(batches, sent.value, window, gram):
            rows = w.asked(ranges)
            yield pa.RecordBatch.from_arrays([
                pa.array([r[0] for r in rows], pa.int32()), pa.array([block] * len(rows), pa.int64()), pa.array([r[1] for r in rows], pa.int32()),
                pa.array([w.checksum] * len(rows), pa.int64()), pa.array([r[2] for r in rows], pa.binary())], ["part", "block", "base", "checksum", "asked"])

    return of


def _documents(sent, window: int, gram: int):
    """A row a document; those without a marked window are finished, the others carry text and windows."""

    def of(batches):
        for block, c, batch, w in _blocks(batches, sent.value, window, gram):
            coded = w.entry.astype(np.uint32) | (w.first_here.astype(np.uint32) << np.uint32(31))
            edge = np.searchsorted(w.row, np.arange(c.rows + 1)).tolist()
            n_words = np.diff(c.word_at)
            sha, text, starts, entries = [], [], [], []
            for r in range(c.rows):
                s, e = edge[r], edge[r + 1]
                clean = s == e
                sha.append(_sha(b" ".join(bytes(c.data[c.offsets[r] : c.offsets[r + 1]]).split())) if clean else None)
                text.append(None if clean else batch.column("text")[c.first + r].as_py())
                starts.append(None if clean else w.at[s:e].astype(np.int32).tobytes())
                entries.append(None if clean else coded[s:e].tobytes())
            yield pa.RecordBatch.from_arrays([
                pa.array([block] * c.rows, pa.int64()), pa.array([len(w.h1)] * c.rows, pa.int32()), pa.array([w.checksum] * c.rows, pa.int64()), batch.column("doc_id").slice(c.first, c.rows), pa.array(n_words, pa.int64()),
                pa.array(sha, pa.string()), pa.array(text, pa.string()), pa.array(starts, pa.binary()), pa.array(entries, pa.binary())],
                ["block", "n_entries", "checksum", "doc_id", "n_words", "sha", "text", "starts", "entries"])

    return of


def _answer(table: pa.Table) -> pa.Table:
    """One hash range: which of each block's entries hold the first place of all."""
    sizes = [len(x.as_buffer()) // 24 for x in table.column("asked")]
    total = sum(sizes)
    h1, doc, h2, at = np.empty(total, np.uint64), np.empty(total, np.int64), np.empty(total, np.uint32), np.empty(total, np.int32)
    edges = np.cumsum([0, *sizes])
    for x, n, o in zip(table.column("asked"), sizes, edges, strict=False):
        buf = x.as_buffer()
        for whole, skip in ((h1, 0), (doc, 8), (h2, 16), (at, 20)):
            whole[o : o + n] = np.frombuffer(buf, whole.dtype, n, skip * n)
    owner = np.repeat(table.column("block").to_numpy(), sizes)
    order = np.lexsort((owner, at, doc, h2, h1))
    first = np.ones(total, bool)
    a, b = h1[order], h2[order]
    first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    flag = np.zeros(total, bool)
    flag[order] = first
    bits = [np.packbits(flag[edges[i] : edges[i + 1]]).tobytes() for i in range(len(sizes))]
    return pa.table({"block": table.column("block"), "base": table.column("base"), "checksum": table.column("checksum"), "n": pa.array(sizes, pa.int32()), "bits": pa.array(bits, pa.binary())})


def _apply(window: int):
    def of(docs: pa.Table, replies: pa.Table) -> pa.Table:
        total = docs.column("n_entries")[0].as_py() if docs.num_rows else 0
        sums = set(docs.column("checksum").to_pylist()) | set(replies.column("checksum").to_pylist())
        if total != sum(replies.column("n").to_pylist()) or len(sums) > 1:
            raise RuntimeError("the two passes disagree on a block: the input changed between them")
        first = np.zeros(total, bool)
        for base, n, bits in zip(replies.column("base").to_pylist(), replies.column("n").to_pylist(), replies.column("bits"), strict=True):
            first[base : base + n] = np.unpackbits(np.frombuffer(bits.as_buffer(), np.uint8), count=n)
        removed, sha = [0] * docs.num_rows, docs.column("sha").to_pylist()
        starts, entries = docs.column("starts"), docs.column("entries")
        for c in chunks(docs.column("text")):
            for r in range(c.rows):
                i = c.first + r
                if sha[i] is not None:
                    continue
                at, coded = np.frombuffer(starts[i].as_buffer(), np.int32), np.frombuffer(entries[i].as_buffer(), np.uint32)
                again = at[~((coded >> np.uint32(31) == 1) & first[coded & np.uint32(0x7FFFFFFF)])]
                n = int(c.word_at[r + 1] - c.word_at[r])
                depth = np.bincount(again, minlength=n + 1)[: n + 1] - np.bincount(again + window, minlength=n + 1)[: n + 1]
                drop = np.cumsum(depth[:-1]) > 0
                removed[i] = int(drop.sum())
                sha[i] = _sha(_kept(c, r, drop))
        return pa.table({"doc_id": docs.column("doc_id"), "n_words": docs.column("n_words"), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(sha, pa.string())})

    return of


def substring_dedup(docs: DataFrame, window: int = 20, gram: int = 8, stable: bool = False) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256 (kept words joined by one space).

    The texts are scanned three times and must come in the same order each time, so they are written first, unless the
    caller says that they are ``stable``: plain scans of files that don't change. Checksums hold the scans together.
    """
    spark = docs.sparkSession
    gram = min(gram, window)
    work = Workspace(spark, "substring-dedup")
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    if not stable:
        docs = work.stash(docs, "documents")
    marks = sketch.mark_repeated(docs.select("text"), _minimizers(window, gram), [2], 2, [FOLD])
    sent = work.broadcast(marks)
    # a minimizer's place stands for at most ``window - gram + 1`` windows
    entries = marks.marked * (window - gram + 1) * ENTRY_BYTES // RANGE_BYTES
    ranges = 1 << (max(RANGES, 2 * shuffle_width(spark), entries) - 1).bit_length()
    asked = docs.mapInArrow(_ask(sent, window, gram, ranges), _ASKED)
    replies = asked.groupBy("part").applyInArrow(_answer, "block long, base int, checksum long, n int, bits binary")
    rows = docs.mapInArrow(_documents(sent, window, gram), _DOCS)
    return rows.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(_apply(window), "doc_id long, n_words long, n_removed long, kept_sha256 string")
