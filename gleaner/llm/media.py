"""Media columns: Netpbm and BMP decoded to numpy arrays, resized by area with integral images, kept as NPY tiles.

``decode_image`` reads P1 to P6 Netpbm (8 and 16 bit) and uncompressed BMP of 8, 24 or 32 bits. ``area_resize``
averages exact areas, fractional borders included, from a summed-area table that is built in blocks of rows.
``difference_hash`` compares neighbours of a 9 x 8 gray tile.

``text_media`` stores texts as 8-bit graymaps: the UTF-8 bytes, zero-padded to a positive multiple of the width, are
the samples. The stored images are written to the shared folder, read back and decoded; their NPY tiles are written too,
and the features are those of the tiles read back. NULL is the empty
text (64 zero bytes); equal texts give equal values; repeated rows stay; an empty table gives an empty result; other
columns are ignored. A row is handled alone, so memory is a few times the longest text.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.workspace import Workspace

WIDTH = 64
TILE = (8, 9)
_TOKEN = re.compile(rb"(?:\s|#[^\n\r]*[\n\r])*([^\s#]+)")


class MediaError(ValueError):
    pass


def encode_pgm(samples: np.ndarray) -> bytes:
    h, w = samples.shape
    return b"P5\n%d %d\n255\n" % (w, h) + samples.astype(np.uint8).tobytes()


def _netpbm(data: bytes) -> np.ndarray:
    kind, at = data[:2], 2
    fields = []
    for _ in range(2 if kind in (b"P1", b"P4") else 3):
        if not (m := _TOKEN.match(data, at)):
            raise MediaError("header ends early")
        if not m[1].isdigit():
            raise MediaError(f"not a number: {m[1][:20]!r}")
        fields.append(int(m[1]))
        at = m.end()
    w, h = fields[:2]
    most = fields[2] if len(fields) > 2 else 1
    planes = 3 if kind in (b"P3", b"P6") else 1
    if not (w and h and 0 < most < 65536):
        raise MediaError("size or maximum out of range")
    if kind in (b"P1", b"P2", b"P3"):
        body = re.sub(rb"#[^\n\r]*", b"", data[at:])
        values = np.array([int(x) for x in (re.findall(rb"[01]", body) if kind == b"P1" else body.split())], np.int64)
    else:
        at += 1
        if kind == b"P4":
            row = (w + 7) // 8
            raw = np.frombuffer(data, np.uint8, count=min(row * h, len(data) - at), offset=at)
            if len(raw) < row * h:
                raise MediaError("samples end early")
            values = np.unpackbits(raw.reshape(h, row), axis=1)[:, :w].ravel()
        else:
            unit = np.dtype(">u2" if most > 255 else "u1")
            values = np.frombuffer(data, unit, count=min(w * h * planes, (len(data) - at) // unit.itemsize), offset=at)
    if len(values) < w * h * planes:
        raise MediaError("samples end early")
    values = values[: w * h * planes]
    if kind in (b"P1", b"P4"):
        values = (1 - values) * 255  # a set bit is black
    elif most != 255:
        values = (values.astype(np.int64) * 255 + most // 2) // most
    image = values.astype(np.uint8)
    return image.reshape((h, w, 3) if planes == 3 else (h, w))


def _bmp(data: bytes) -> np.ndarray:
    if len(data) < 54:
        raise MediaError("header ends early")
    start, size, w, h, _, bits, packing = struct.unpack_from("<I I i i H H I", data, 10)
    if packing not in (0, 3) or bits not in (8, 24, 32) or w <= 0 or h == 0:
        raise MediaError("this kind of BMP is not read")
    rows, row = abs(h), (w * bits // 8 + 3) // 4 * 4
    if len(data) < start + row * rows:
        raise MediaError("samples end early")
    raw = np.frombuffer(data, np.uint8, row * rows, start).reshape(rows, row)[:, : w * bits // 8]
    if bits == 8:
        used = struct.unpack_from("<I", data, 46)[0] or 256
        table = np.zeros((256, 3), np.uint8)
        held = np.frombuffer(data, np.uint8, used * 4, 14 + size).reshape(-1, 4)[:256, 2::-1]
        table[: len(held)] = held
        image = table[raw]
    else:
        image = raw.reshape(rows, w, bits // 8)[:, :, 2::-1]
    return np.ascontiguousarray(image if h < 0 else image[::-1])


def decode_image(data: bytes) -> np.ndarray:
    """uint8, (height, width) for gray and (height, width, 3) for colour; MediaError for what isn't a whole image."""
    if data[:2] == b"BM":
        return _bmp(data)
    if len(data) > 2 and data[:1] == b"P" and data[1:2] in b"123456":
        return _netpbm(data)
    raise MediaError("neither Netpbm nor BMP")


def to_gray(image: np.ndarray) -> np.ndarray:
    """Rec. 601 weights in thousandths, rounded."""
    if image.ndim == 2:
        return image
    return ((image.astype(np.uint32) @ np.array([299, 587, 114], np.uint32) + 500) // 1000).astype(np.uint8)


def _area_sums(gray: np.ndarray, height: int, width: int, block: int = 1 << 14) -> np.ndarray:
    """Each target cell's samples weighted by their exact areas, in whole units of 1 / (height * width) of a sample; a cell
    has gray.size of them."""
    h, w = gray.shape
    x, y = np.arange(width + 1) * w, np.arange(height + 1) * h
    x0, y0 = np.minimum(x // width, w - 1), np.minimum(y // height, h - 1)
    need = np.unique(np.concatenate([y0, y0 + 1]))
    lines = np.zeros((len(need), width + 1), np.int64)
    carry = np.zeros(w + 1, np.int64)
    for top in range(0, h, block):
        part = gray[top : top + block]
        table = np.zeros((len(part) + 1, w + 1), np.int64)
        np.cumsum(np.cumsum(part, axis=0, dtype=np.int64), axis=1, out=table[1:, 1:])
        table += carry
        at = (need >= top) & (need <= top + len(part))
        rows = table[need[at] - top]
        lines[at] = rows[:, x0] * width + (rows[:, x0 + 1] - rows[:, x0]) * (x - x0 * width)
        carry = table[-1].copy()
    a, b = lines[np.searchsorted(need, y0)], lines[np.searchsorted(need, y0 + 1)]
    whole = a * height + (b - a) * (y - y0 * height)[:, None]
    return np.diff(np.diff(whole, axis=0), axis=1)


def area_resize(gray: np.ndarray, height: int, width: int, block: int = 1 << 14) -> np.ndarray:
    """Mean of each target cell's exact area, as float64."""
    return _area_sums(gray, height, width, block) / gray.size


def area_tile(gray: np.ndarray, height: int, width: int) -> np.ndarray:
    """The means as uint8, halves rounded up."""
    return ((2 * _area_sums(gray, height, width) + gray.size) // (2 * gray.size)).astype(np.uint8)


def difference_hash(tile: np.ndarray) -> str:
    bits = np.packbits((tile[:, 1:] > tile[:, :-1]).ravel())
    return bits.tobytes().hex()


def npy_tile(tile: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.lib.format.write_array(out, np.ascontiguousarray(tile), version=(1, 0), allow_pickle=False)
    return out.getvalue()


def read_tile(data: bytes) -> np.ndarray:
    return np.lib.format.read_array(io.BytesIO(data), allow_pickle=False)


def image_tiles(images: DataFrame, column: str = "media", size: tuple[int, int] = TILE) -> DataFrame:
    """Adds height, width, tile (NPY bytes), dhash and media_error (then the others are NULL) to every row."""
    names = images.columns

    def of(batches):
        for b in batches:
            out = []
            for x in b.column(column):
                try:
                    image = decode_image(x.as_py() or b"")
                    tile = area_tile(to_gray(image), *size)
                    out.append((image.shape[0], image.shape[1], npy_tile(tile), difference_hash(tile), None))
                except MediaError as e:
                    out.append((None, None, None, None, str(e)))
            more = [pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], [*names, "height", "width", "tile", "dhash", "media_error"])

    schema = images.schema
    for name, kind in (("height", "long"), ("width", "long"), ("tile", "binary"), ("dhash", "string"), ("media_error", "string")):
        schema = schema.add(name, kind)
    return images.mapInArrow(of, schema)


def text_images(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_bytes, media: each text as a graymap ``width`` samples wide."""

    def of(batches):
        for b in batches:
            sizes, media = [], []
            for t in b.column("text"):
                raw = (t.as_py() or "").encode()
                sizes.append(len(raw))
                rows = max(1, -(-len(raw) // width))
                media.append(b"P5\n%d %d\n255\n" % (width, rows) + raw.ljust(rows * width, b"\0"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(of, "doc_id long, n_bytes long, media binary")


def text_tiles(docs: DataFrame, work: Workspace) -> DataFrame:
    """The written tiles of the stored images: doc_id, n_bytes, tile (NPY bytes), dhash and the digests of the stored form
    and of the payload decoded from it."""
    stored = work.stash(text_images(docs), "images")
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "dhash", "tile"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]

    def of(batches):
        for b in batches:
            out = []
            for media in b.column("media"):
                raw = media.as_py()
                image = decode_image(raw)
                payload = image.tobytes()
                tile = area_tile(to_gray(image), *TILE)
                out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(raw), hashlib.sha256(raw).hexdigest(), difference_hash(tile), npy_tile(tile)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), *(pa.array([r[i] for r in out], k) for i, k in enumerate(kinds))], ["doc_id", "n_bytes", *names])

    tiles = stored.mapInArrow(of, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, dhash string, tile binary")
    return work.stash(tiles, "tiles")


def text_media(docs: DataFrame) -> DataFrame:
    """Per document the digests of its stored image, of the payload decoded from it and of its written tile, and the
    difference hash of that tile as it is read back."""
    tiles = text_tiles(docs, Workspace(docs.sparkSession, "media"))

    def of(batches):
        for b in batches:
            found = []
            for data, dhash in zip(b.column("tile"), b.column("dhash").to_pylist(), strict=True):
                feature = difference_hash(read_tile(data.as_py()))
                if feature != dhash:
                    raise MediaError("a written tile differs from its difference hash")
                found.append((feature, hashlib.sha256(data.as_py()).hexdigest()))
            rest = [b.column(c) for c in b.schema.names if c not in ("dhash", "tile")]
            yield pa.RecordBatch.from_arrays([*rest, *(pa.array([x[i] for x in found], pa.string()) for i in (0, 1))], [*(c for c in b.schema.names if c not in ("dhash", "tile")), "feature", "tile_sha256"])

    return tiles.mapInArrow(of, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tile_sha256 string")
