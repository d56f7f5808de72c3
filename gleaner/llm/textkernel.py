"""Words, word n-grams and their hashes of a whole Arrow batch at once, with numpy.

Words are the maximal runs of bytes outside the six ASCII spaces; UTF-8 never uses those bytes inside a
character, so byte positions are safe. Span hashes come from one prefix sum per chunk: a random value for each
byte times a power of an odd multiplier, modulo 2**64, then a bit mixer. Two independent seeds give 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_SEEDS = 2
_rng = np.random.RandomState(20240229)
_BYTE = [_rng.randint(0, 2**63, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(_SEEDS)]
_STEP = [int(_rng.randint(2**40, 2**62)) | 5 for _ in range(_SEEDS)]
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_table(step: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """step**i and its inverse, modulo 2**64, for i below n."""
    held = _powers.get(step)
    if held is None or len(held[0]) < n:
        size = max(n, 1 << 16, 0 if held is None else min(2 * len(held[0]), CHUNK_BYTES))
        tables = []
        for base in (step, pow(step, -1, 2**64)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            tables.append(np.multiply.accumulate(table))
        held = _powers[step] = (tables[0], tables[1])
    return held


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (shift, multiply); the multipliers are any odd constants."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xA0761D6478BD642F)
    x ^= x >> np.uint64(32)
    return x


class Chunk:
    """Rows [first, last) of an array: their bytes, and where each row's bytes and words begin."""

    def __init__(self, first: int, last: int, data: np.ndarray, offsets: np.ndarray, lower: bool):
        self.first, self.last = first, last
        self.data = LOWER[data] if lower else data
        self.offsets = offsets
        self._sums: dict[int, np.ndarray] = {}
        n = len(data)
        inside = ~SPACE[self.data]
        begin, end = inside.copy(), inside.copy()
        begin[1:] &= ~inside[:-1]
        end[:-1] &= ~inside[1:]
        if n:
            heads = offsets[:-1][np.diff(offsets) > 0]
            tails = offsets[1:][np.diff(offsets) > 0] - 1
            begin[heads], end[tails] = inside[heads], inside[tails]
        self.starts, self.ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
        #: row r of the chunk has the words [word_at[r], word_at[r + 1])
        self.word_at = np.searchsorted(self.starts, offsets)

    @property
    def rows(self) -> int:
        return self.last - self.first

    def span_hash(self, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
        n = len(self.data)
        power, inverse = _power_table(_STEP[seed], n + 1)
        if seed not in self._sums:
            self._sums[seed] = np.zeros(n + 1, np.uint64)
            np.cumsum(_BYTE[seed][self.data] * power[:n], out=self._sums[seed][1:])
        total = self._sums[seed]
        return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))

    def word_hash(self, seed: int = 0) -> np.ndarray:
        return self.span_hash(self.starts, self.ends, seed)

    def word_end(self) -> np.ndarray:
        """For each word, the index after the last word of its row."""
        return np.repeat(self.word_at[1:], np.diff(self.word_at))


_MARK = np.zeros(256, bool)
_MARK[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True


def bare_words(c: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words without ASCII marks at their ends, and whether anything is left of each."""
    n = len(c.data)
    place = np.arange(n)
    mark = _MARK[c.data]
    last = np.maximum.accumulate(np.where(mark, -1, place)) if n else place
    first = np.minimum.accumulate(np.where(mark, n, place)[::-1])[::-1] if n else place
    starts = np.minimum(first[c.starts], c.ends)
    ends = np.maximum(last[c.ends - 1] + 1, starts)
    return starts, ends, ends > starts


def rolling(words: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hashes of all runs of k neighbouring word hashes, row borders ignored: len(words) - k + 1 of them."""
    n = len(words)
    if n < k:
        return np.zeros(0, np.uint64)
    power, inverse = _power_table(_STEP[1 - seed], n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(words * power[:n], out=total[1:])
    return mix((total[k:] - total[:-k]) * inverse[: n - k + 1] + np.uint64(k))


def slices(array: pa.Array | pa.ChunkedArray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, bytes, offsets) of a string array in pieces of about ``limit`` bytes; a longer text is a piece
    alone. NULL is empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks() if array.num_chunks != 1 else array.chunk(0)
    if array.null_count:
        array = pc.fill_null(array, "")
    if not len(array):
        return
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    _, offs, data = array.buffers()
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    r = 0
    while r < len(array):
        end = max(r + 1, int(np.searchsorted(offsets, offsets[r] + limit, "right")) - 1)
        yield r, end, raw[offsets[r] : offsets[end]], offsets[r : end + 1] - offsets[r]
        r = end


def chunks(array: pa.Array | pa.ChunkedArray, lower: bool = False, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """The rows of a string array in chunks of about ``limit`` bytes; a longer text is a chunk alone. NULL is empty."""
    for first, last, data, offsets in slices(array, limit):
        yield Chunk(first, last, data, offsets, lower)


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """Which bytes lie in the ranges, both ends included; bytes of characters beyond ASCII always do."""
    out = np.zeros(256, bool)
    out[128:] = True
    for low, high in ranges:
        out[low : high + 1] = True
    return out


#: Terms of ASCII letters, or of letters and digits; A-Z are lower-cased before.
LETTERS, ALNUM = byte_class((0x61, 0x7A)), byte_class((0x61, 0x7A), (0x30, 0x39))


def class_terms(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[pa.StringArray, np.ndarray, np.ndarray]:
    """The maximal runs of bytes of a class in each row, A-Z lower-cased: (distinct terms, each run's term, each row's first run)."""
    low = LOWER[data]
    kept = inside[low]
    begin = kept.copy()
    begin[1:] &= ~kept[:-1]
    heads = offsets[:-1][np.diff(offsets) > 0]
    begin[heads] = kept[heads]
    at = np.searchsorted(np.flatnonzero(begin), offsets)
    body = low[kept]
    edges = np.append(np.flatnonzero(begin[kept]), len(body)).astype(np.int32)
    coded = pa.StringArray.from_buffers(len(edges) - 1, pa.py_buffer(edges), pa.py_buffer(body)).dictionary_encode()
    return coded.dictionary, np.asarray(coded.indices), at
