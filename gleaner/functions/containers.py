"""Image files as bytes: what a container says of its image, whether it is whole, and its pixels.

``inspect`` walks PNG (with checksums, and its data inflated), JPEG, GIF, BMP, TIFF and WebP to their ends. ``decode`` gives
pixels of PNG (all depths, palettes, interlaced), BMP and sequential JPEG. Both raise ValueError with the reason.
"""

from __future__ import annotations

import struct
import zlib
from functools import lru_cache
from typing import NamedTuple

import numpy as np

from gleaner.functions.images import bilinear

#: The number of bands of each mode.
BANDS = {"1": 1, "L": 1, "P": 1, "I;16": 1, "LA": 2, "RGB": 3, "RGBA": 4, "CMYK": 4}
_PNG_SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
CUT, UNKNOWN = "image file is truncated", "cannot identify image file"
#: A larger image is refused, before its pixels are unpacked.
MOST_PIXELS = 178_956_970


class Info(NamedTuple):
    format: str
    width: int
    height: int
    mode: str

    @property
    def channels(self) -> int:
        return BANDS[self.mode]


def _need(ok: bool, what: str = CUT) -> None:
    if not ok:
        raise ValueError(what)


class _Png(NamedTuple):
    width: int
    height: int
    depth: int
    colour: int
    interlaced: bool
    palette: np.ndarray | None
    packed: bytes

    @property
    def mode(self) -> str:
        if self.colour == 0:
            return "1" if self.depth == 1 else "I;16" if self.depth == 16 else "L"
        return {2: "RGB", 3: "P", 4: "LA", 6: "RGBA"}[self.colour]

    @property
    def passes(self) -> list[tuple[int, int, int, int]]:
        """First column, first row, column step, row step of each pass."""
        return [(0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2)] if self.interlaced else [(0, 0, 1, 1)]

    def sizes(self) -> list[tuple[int, int, int]]:
        """Columns, rows and bytes a row of each pass."""
        out = []
        for x, y, dx, dy in self.passes:
            w, h = max(0, -(-(self.width - x) // dx)), max(0, -(-(self.height - y) // dy))
            out.append((w, h, -(-w * _PNG_SAMPLES[self.colour] * self.depth // 8)))
        return out

    def raw(self) -> bytes:
        want = sum(h * (n + 1) for w, h, n in self.sizes() if w)
        try:
            out = zlib.decompressobj().decompress(self.packed, want)
        except zlib.error as e:
            raise ValueError(f"broken PNG data: {e}") from e
        _need(len(out) >= want)
        return out


def _png(data: bytes) -> _Png:
    at, head, palette, packed = 8, None, None, []
    while True:
        _need(at + 12 <= len(data))
        n, kind = struct.unpack_from(">I4s", data, at)
        _need(at + 12 + n <= len(data))
        body = data[at + 8 : at + 8 + n]
        _need(zlib.crc32(data[at + 4 : at + 8 + n]) == struct.unpack_from(">I", data, at + 8 + n)[0], f"broken PNG file (chunk {kind!r})")
        if kind == b"IHDR":
            _need(n == 13, "broken PNG file (chunk b'IHDR')")
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body[: n // 3 * 3], np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            packed.append(body)
        elif kind == b"IEND":
            break
        at += 12 + n
    _need(head is not None and bool(packed), "broken PNG file")
    w, h, depth, colour, _, _, interlaced = head
    fits = {0: (1, 2, 4, 8, 16), 2: (8, 16), 3: (1, 2, 4, 8), 4: (8, 16), 6: (8, 16)}
    _need(w > 0 and h > 0 and depth in fits.get(colour, ()), "broken PNG file (chunk b'IHDR')")
    _need(w * h <= MOST_PIXELS, "image is too large")
    _need(colour != 3 or palette is not None, "broken PNG file (no palette)")
    return _Png(w, h, depth, colour, bool(interlaced), palette, b"".join(packed))


def _unfiltered(raw: np.ndarray, step: int) -> np.ndarray:
    """Rows of a filter byte and data, ``step`` bytes a pixel: all rows at once, along the diagonals they depend on."""
    kind, x = raw[:, 0], raw[:, 1:]
    if not kind.any():
        return x
    _need(int(kind.max()) <= 4, "broken PNG data: unknown filter")
    h, n = x.shape
    w = n // step
    src = x.reshape(h, w, step).astype(np.int16)
    out = np.zeros((h + 1, w + 1, step), np.int16)
    for d in range(w + h - 1):
        y = np.arange(max(0, d - w + 1), min(h, d + 1))
        z = d - y
        a, b, c, k = out[y + 1, z], out[y, z + 1], out[y, z], kind[y, None]
        pa, pb, pc = np.abs(b - c), np.abs(a - c), np.abs(a + b - 2 * c)
        nearest = np.where((pa <= pb) & (pa <= pc), a, np.where(pb <= pc, b, c))
        out[y + 1, z + 1] = (src[y, z] + np.select([k == 1, k == 2, k == 3, k == 4], [a, b, (a + b) >> 1, nearest], 0)) & 255
    return out[1:, 1:].astype(np.uint8).reshape(h, n)


def _png_pixels(p: _Png) -> np.ndarray:
    """(height, width, samples): 8 bits a sample, of 16 the upper; palette entries as they are."""
    raw, n = np.frombuffer(p.raw(), np.uint8), _PNG_SAMPLES[p.colour]
    out, at = np.zeros((p.height, p.width, n), np.uint8), 0
    for (x, y, dx, dy), (w, h, row) in zip(p.passes, p.sizes(), strict=True):
        if not w or not h:
            continue
        lines = _unfiltered(raw[at : at + h * (row + 1)].reshape(h, row + 1), max(1, n * p.depth // 8))
        at += h * (row + 1)
        if p.depth == 16:
            part = lines[:, ::2]
        elif p.depth == 8:
            part = lines
        else:
            bits = np.unpackbits(lines, axis=1)[:, : w * p.depth].reshape(h, w, p.depth)
            part = bits @ (1 << np.arange(p.depth)[::-1]).astype(np.uint8)
            part = part if p.colour == 3 else part * np.uint8(255 // ((1 << p.depth) - 1))
        out[y::dy, x::dx] = part.reshape(h, w, n)
    return out


class _Bmp(NamedTuple):
    width: int
    height: int
    bits: int
    kind: int
    at: int
    down: bool
    palette: np.ndarray | None


def _bmp(data: bytes) -> _Bmp:
    _need(len(data) >= 26)
    at, size = struct.unpack_from("<II", data, 10)
    if size == 12:
        w, h, _, bits = struct.unpack_from("<HHHH", data, 18)
        kind, used, entry = 0, 0, 3
    else:
        _need(size >= 40 and len(data) >= 54, "unsupported BMP header")
        w, h, _, bits, kind, _, _, _, used = struct.unpack_from("<iiHHIIiiI", data, 18)
        entry = 4
    _need(w > 0 and h != 0 and bits in (1, 4, 8, 16, 24, 32), "unsupported BMP header")
    _need(w * abs(h) <= MOST_PIXELS, "image is too large")
    palette = None
    if bits <= 8:
        first, n = 14 + size, used or 1 << bits
        _need(first + n * entry <= len(data))
        palette = np.frombuffer(data, np.uint8, n * entry, first).reshape(n, entry)[:, 2::-1]
    if kind in (0, 3):
        _need(at + -(-w * bits // 32) * 4 * abs(h) <= len(data))
    return _Bmp(w, abs(h), bits, kind, at, h < 0, palette)


def _bmp_pixels(data: bytes, b: _Bmp) -> np.ndarray:
    _need(b.kind == 0 or b.kind == 3 and b.bits == 32, "BMP compression is not decoded")
    _need(b.bits != 16, "BMP of 16 bits is not decoded")
    row = -(-b.width * b.bits // 32) * 4
    lines = np.frombuffer(data, np.uint8, row * b.height, b.at).reshape(b.height, row)
    lines = lines if b.down else lines[::-1]
    if b.bits > 8:
        return lines[:, : b.width * b.bits // 8].reshape(b.height, b.width, b.bits // 8)[:, :, 2::-1]
    bits = np.unpackbits(lines, axis=1)[:, : b.width * b.bits].reshape(b.height, b.width, b.bits)
    index = bits @ (1 << np.arange(b.bits)[::-1]).astype(np.uint8)
    return b.palette[np.minimum(index, len(b.palette) - 1)]


class _Jpeg(NamedTuple):
    width: int
    height: int
    sof: int
    parts: list[tuple[int, int, int, int]]  # id, across, down, table of each component
    tables: dict[int, np.ndarray]
    scans: list[tuple[list[tuple[int, int, int]], dict, bytes, int]]  # components with their tables, codes, data, restart interval
    adobe: int


def _jpeg(data: bytes) -> _Jpeg:
    at, frame, tables, codes, scans, restart, adobe = 2, None, {}, {}, [], 0, -1
    while True:
        _need(at + 2 <= len(data))
        _need(data[at] == 0xFF, "broken JPEG file: no marker where one must be")
        mark = data[at + 1]
        if mark == 0xFF:
            at += 1
            continue
        if mark == 0xD9:
            break
        if mark in (0x01, *range(0xD0, 0xD9)):
            at += 2
            continue
        _need(at + 4 <= len(data))
        n = struct.unpack_from(">H", data, at + 2)[0]
        _need(n >= 2 and at + 2 + n <= len(data))
        body = data[at + 4 : at + 2 + n]
        at += 2 + n
        if mark in (*range(0xC0, 0xC4), *range(0xC5, 0xC8), *range(0xC9, 0xCC), *range(0xCD, 0xD0)):
            _need(len(body) >= 6 and len(body) >= 6 + 3 * body[5], "broken JPEG file: frame header")
            _, h, w, k = struct.unpack_from(">BHHB", body)
            frame = (w, h, mark, [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(k)])
        elif mark == 0xDB:
            i = 0
            while i < len(body):
                wide = body[i] >> 4
                _need(i + 1 + 64 * (wide + 1) <= len(body), "broken JPEG file: quantisation table")
                tables = tables | {body[i] & 15: np.frombuffer(body, ">u2" if wide else np.uint8, 64, i + 1).astype(np.int64)}
                i += 1 + 64 * (wide + 1)
        elif mark == 0xC4:
            i = 0
            while i + 17 <= len(body):
                counts = body[i + 1 : i + 17]
                _need(i + 17 + sum(counts) <= len(body), "broken JPEG file: code table")
                codes = codes | {body[i]: (counts, body[i + 17 : i + 17 + sum(counts)])}
                i += 17 + sum(counts)
        elif mark == 0xDD:
            restart = struct.unpack_from(">H", body)[0] if len(body) >= 2 else 0
        elif mark == 0xEE and body[:5] == b"Adobe" and len(body) >= 12:
            adobe = body[11]
        elif mark == 0xDA:
            _need(frame is not None and len(body) >= 1 + 2 * body[0], "broken JPEG file: scan header")
            end = at
            while True:  # to the next marker that is neither a stuffed byte nor a restart
                end = data.find(b"\xff", end)
                _need(end >= 0 and end + 1 < len(data))
                if data[end + 1] == 0 or 0xD0 <= data[end + 1] <= 0xD7:
                    end += 2
                elif data[end + 1] == 0xFF:
                    end += 1
                else:
                    break
            scans.append(([(body[1 + 2 * i], body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])], codes, data[at:end], restart))
            at = end
    _need(frame is not None and bool(scans), "broken JPEG file: no image data")
    w, h, sof, parts = frame
    _need(w > 0 and h > 0 and len(parts) in (1, 3, 4) and all(1 <= x <= 4 and 1 <= y <= 4 for _, x, y, _ in parts), "broken JPEG file: frame header")
    _need(w * h <= MOST_PIXELS, "image is too large")
    return _Jpeg(w, h, sof, parts, tables, scans, adobe)


@lru_cache(64)
def _code_table(counts: bytes, symbols: bytes) -> list[int]:
    """For each 16 bits: length * 256 + symbol of the code they begin with, 0 for none."""
    out, code, at = np.zeros(1 << 16, np.int32), 0, 0
    for length in range(1, 17):
        for _ in range(counts[length - 1]):
            low = code << (16 - length)
            out[low : low + (1 << (16 - length))] = length << 8 | symbols[at]
            code, at = code + 1, at + 1
        code <<= 1
    return out.tolist()


def _zigzag() -> np.ndarray:
    """Place of each coefficient in the stream: along the diagonals, in turns up and down."""
    order = sorted(((i, j) for i in range(8) for j in range(8)), key=lambda x: (sum(x), x[0] if sum(x) % 2 else x[1]))
    return np.array([8 * i + j for i, j in order])


_ORDER = _zigzag()
_WAVE = np.cos(np.pi * (2 * np.arange(8)[None, :] + 1) * np.arange(8)[:, None] / 16) * np.where(np.arange(8) == 0, np.sqrt(1 / 8), 0.5)[:, None]


def _scan(jpeg: _Jpeg, coefficients: list[np.ndarray], scan: tuple) -> None:
    """Decode one sequential scan into (rows, columns, 64) coefficient arrays, in stream order."""
    named, codes, data, restart = scan
    at = {c: i for i, (c, *_) in enumerate(jpeg.parts)}
    _need(all(c in at and d in codes and a | 16 in codes for c, d, a in named), "broken JPEG file: missing code table")
    mine = [(at[c], _code_table(*codes[d]), _code_table(*codes[a | 16])) for c, d, a in named]
    most_x, most_y = max(x for _, x, _, _ in jpeg.parts), max(y for _, _, y, _ in jpeg.parts)
    if len(mine) == 1:  # a scan of one component has its own blocks only
        i, (_, x, y, _) = mine[0][0], jpeg.parts[mine[0][0]]
        across, down = -(-(-(-jpeg.width * x // most_x)) // 8), -(-(-(-jpeg.height * y // most_y)) // 8)
        unit = [(0, 0, 0)]
        step = {i: (1, 1)}
    else:
        across, down = -(-jpeg.width // (8 * most_x)), -(-jpeg.height // (8 * most_y))
        unit = [(k, v, u) for k, (i, _, _) in enumerate(mine) for v in range(jpeg.parts[i][2]) for u in range(jpeg.parts[i][1])]
        step = {i: (jpeg.parts[i][1], jpeg.parts[i][2]) for i, _, _ in mine}
    pieces, begin = [], 0
    if restart:
        i = data.find(b"\xff")
        while i >= 0:
            if 0xD0 <= data[i + 1 : i + 2][0] <= 0xD7:
                pieces.append(data[begin:i])
                begin = i + 2
            i = data.find(b"\xff", i + 2)
    pieces.append(data[begin:])
    total, done = across * down, 0
    for piece in pieces:
        raw = piece.replace(b"\xff\x00", b"\xff") + b"\0" * 16
        size, bits, held, pos, last = len(raw), 0, 0, 0, [0] * len(mine)
        for mcu in range(done, min(done + restart, total) if restart else total):
            my, mx = divmod(mcu, across)
            for k, v, u in unit:
                i, dc, ac = mine[k]
                block, place, table = coefficients[i][my * step[i][1] + v, mx * step[i][0] + u], 0, dc
                while place < 64:
                    if held < 32:
                        _need(pos < size)
                        bits = (bits & ((1 << held) - 1)) << 48 | int.from_bytes(raw[pos : pos + 6].ljust(6, b"\0"), "big")
                        held += 48
                        pos += 6
                    entry = table[bits >> (held - 16) & 0xFFFF]
                    _need(entry > 0, "broken JPEG file: unknown code")
                    held -= entry >> 8
                    run, n = (entry & 255) >> 4, entry & 15
                    value = 0
                    if n:
                        held -= n
                        value = bits >> held & ((1 << n) - 1)
                        if value < 1 << (n - 1):
                            value -= (1 << n) - 1
                    if place == 0:
                        last[k] += value
                        block[0], place, table = last[k], 1, ac
                    elif n:
                        place += run
                        _need(place < 64, "broken JPEG file: too many coefficients")
                        block[place] = value
                        place += 1
                    elif run == 15:
                        place += 16
                    else:
                        break
        done = min(done + restart, total) if restart else total
    _need(done == total)


def _jpeg_pixels(j: _Jpeg) -> np.ndarray:
    _need(j.sof in (0xC0, 0xC1), "only sequential JPEG is decoded")
    most_x, most_y = max(x for _, x, _, _ in j.parts), max(y for _, _, y, _ in j.parts)
    across, down = -(-j.width // (8 * most_x)), -(-j.height // (8 * most_y))
    coefficients = [np.zeros((down * y, across * x, 64), np.int64) for _, x, y, _ in j.parts]
    for scan in j.scans:
        _scan(j, coefficients, scan)
    planes = []
    for (_, x, y, table), c in zip(j.parts, coefficients, strict=True):
        _need(table in j.tables, "broken JPEG file: missing quantisation table")
        spread = np.zeros((*c.shape[:2], 64))
        spread[..., _ORDER] = c * j.tables[table]
        block = np.einsum("ki,rckl,lj->rcij", _WAVE, spread.reshape(*c.shape[:2], 8, 8), _WAVE)
        plane = np.clip(np.rint(block + 128), 0, 255).transpose(0, 2, 1, 3).reshape(c.shape[0] * 8, c.shape[1] * 8)
        plane = plane[: -(-j.height * y // most_y), : -(-j.width * x // most_x)]
        if (x, y) != (most_x, most_y):
            plane = bilinear(plane[..., None], plane.shape[0] * most_y // y, plane.shape[1] * most_x // x)[..., 0]
        planes.append(plane[: j.height, : j.width])
    p = np.stack(planes, axis=2).astype(np.float64)
    if len(planes) > 1 and j.adobe != 0:  # luma and two colour differences, unless the file says otherwise
        y, cb, cr = p[..., 0], p[..., 1] - 128, p[..., 2] - 128
        p = np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb, *([p[..., 3]] if len(planes) == 4 else [])], axis=2)
        p = 255 - p if len(planes) == 4 and j.adobe == 2 else p
    p = np.clip(p, 0, 255)
    if len(planes) == 4:
        ink = p if j.adobe < 0 else 255 - p if j.adobe == 0 else np.concatenate([p[..., :3], 255 - p[..., 3:]], axis=2)
        p = (255 - ink[..., :3]) * (255 - ink[..., 3:]) / 255
    return np.rint(p).astype(np.uint8)


def _gif(data: bytes) -> Info:
    _need(len(data) >= 13)
    w, h, flags = struct.unpack_from("<HHB", data, 6)
    at = 13 + (3 << ((flags & 7) + 1) if flags & 128 else 0)
    images = 0
    while True:
        _need(at < len(data))
        kind = data[at]
        if kind == 0x3B:
            break
        if kind == 0x21:
            at += 2
        elif kind == 0x2C:
            _need(at + 10 <= len(data))
            local = data[at + 9]
            at += 10 + (3 << ((local & 7) + 1) if local & 128 else 0) + 1
            images += 1
        else:
            raise ValueError("broken GIF file: unknown block")
        while True:
            _need(at < len(data))
            n = data[at]
            at += 1 + n
            if n == 0:
                break
    _need(images > 0 and w > 0 and h > 0, "broken GIF file: no image")
    return Info("GIF", w, h, "P")


def _webp(data: bytes) -> Info:
    _need(len(data) >= 30)
    _need(8 + struct.unpack_from("<I", data, 4)[0] <= len(data))
    kind = data[12:16]
    if kind == b"VP8 ":
        _need(data[23:26] == b"\x9d\x01\x2a", "broken WebP file: no key frame")
        w, h = (x & 0x3FFF for x in struct.unpack_from("<HH", data, 26))
        alpha = False
    elif kind == b"VP8L":
        _need(data[20] == 0x2F, "broken WebP file: no signature")
        bits = struct.unpack_from("<I", data, 21)[0]
        w, h, alpha = (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1, bool(bits >> 28 & 1)
    elif kind == b"VP8X":
        w, h, alpha = int.from_bytes(data[24:27], "little") + 1, int.from_bytes(data[27:30], "little") + 1, bool(data[20] & 16)
    else:
        raise ValueError("broken WebP file: unknown chunk")
    return Info("WEBP", w, h, "RGBA" if alpha else "RGB")


def _tiff(data: bytes) -> Info:
    end = "<" if data[:2] == b"II" else ">"
    _need(len(data) >= 8)
    at = struct.unpack_from(end + "I", data, 4)[0]
    _need(at + 2 <= len(data))
    n = struct.unpack_from(end + "H", data, at)[0]
    _need(at + 2 + 12 * n <= len(data))
    tags = {}
    for i in range(n):
        tag, kind, count = struct.unpack_from(end + "HHI", data, at + 2 + 12 * i)
        size, code = {1: (1, "B"), 3: (2, "H"), 4: (4, "I")}.get(kind, (0, ""))
        if size:
            where = at + 10 + 12 * i if size * count <= 4 else struct.unpack_from(end + "I", data, at + 10 + 12 * i)[0]
            _need(where + size * count <= len(data))
            tags[tag] = struct.unpack_from(f"{end}{count}{code}", data, where)
    w, h = tags.get(256, (0,))[0], tags.get(257, (0,))[0]
    _need(w > 0 and h > 0, "broken TIFF file: no size")
    offsets, counts = tags.get(273, tags.get(324, ())), tags.get(279, tags.get(325, ()))
    _need(bool(offsets) and len(offsets) == len(counts), "broken TIFF file: no image data")
    _need(all(o + c <= len(data) for o, c in zip(offsets, counts, strict=True)))
    bits, samples, kind = tags.get(258, (1,))[0], tags.get(277, (1,))[0], tags.get(262, (1,))[0]
    mode = {2: "RGBA" if samples == 4 else "RGB", 3: "P", 5: "CMYK", 6: "RGB"}.get(kind)
    return Info("TIFF", w, h, mode or ("1" if bits == 1 else "I;16" if bits == 16 else "LA" if samples == 2 else "L"))


def kind_of(data: bytes) -> str | None:
    """The format that the leading bytes tell."""
    if data.startswith(b"\x89PNG\r\n\x1a\n"):
        return "PNG"
    if data.startswith(b"\xff\xd8\xff"):
        return "JPEG"
    if data.startswith((b"GIF87a", b"GIF89a")):
        return "GIF"
    if data.startswith(b"BM"):
        return "BMP"
    if data.startswith((b"II*\0", b"MM\0*")):
        return "TIFF"
    return "WEBP" if data[:4] == b"RIFF" and data[8:12] == b"WEBP" else None


def _walk(read, data: bytes):
    try:
        return read(data)
    except (struct.error, IndexError) as e:
        raise ValueError(CUT) from e


def inspect(data: bytes | None) -> Info:
    """Format, size and mode of a whole image file."""
    kind = kind_of(data or b"")
    if kind == "PNG":
        p = _walk(_png, data)
        p.raw()
        return Info(kind, p.width, p.height, p.mode)
    if kind == "JPEG":
        j = _walk(_jpeg, data)
        return Info(kind, j.width, j.height, {1: "L", 3: "RGB", 4: "CMYK"}[len(j.parts)])
    if kind == "BMP":
        b = _walk(_bmp, data)
        return Info(kind, b.width, b.height, "P" if b.bits <= 8 else "RGB")
    if kind is None:
        raise ValueError(UNKNOWN if data else "empty image")
    return _walk({"GIF": _gif, "WEBP": _webp, "TIFF": _tiff}[kind], data)


def decode(data: bytes | None) -> np.ndarray:
    """uint8 (height, width, 3); transparency is dropped."""
    kind = kind_of(data or b"")
    if kind == "PNG":
        p = _walk(_png, data)
        x = _png_pixels(p)
        if p.colour == 3:
            return p.palette[np.minimum(x[..., 0], len(p.palette) - 1)]
        return np.repeat(x[..., :1], 3, axis=2) if p.colour in (0, 4) else np.ascontiguousarray(x[..., :3])
    if kind == "BMP":
        return np.ascontiguousarray(_walk(lambda d: _bmp_pixels(d, _bmp(d)), data))
    if kind == "JPEG":
        x = _walk(lambda d: _jpeg_pixels(_jpeg(d)), data)
        return np.repeat(x, 3, axis=2) if x.shape[2] == 1 else x
    if kind is None:
        raise ValueError(UNKNOWN if data else "empty image")
    inspect(data)
    raise ValueError(f"{kind} pixels are not decoded")
