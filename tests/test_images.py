"""Image bytes in a column: containers walked and decoded, tables of them with an error a row."""

import struct
import zlib

import numpy as np
import pytest

from gleaner.functions import containers
from gleaner.operators import imagetable


def png(lines, width, depth, colour, palette=None, interlaced=0, filters=None):
    """``lines``: packed rows (bytes) of each pass; filtered as ``filters`` say, row by row."""
    part = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    step = max(1, {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour] * depth // 8)
    raw, height = b"", sum(len(x) for x in lines)
    for rows in lines:
        before = bytes(len(rows[0])) if rows else b""
        for i, row in enumerate(rows):
            kind = filters[i % len(filters)] if filters else 0
            out = []
            for j, v in enumerate(row):
                a, b, c = row[j - step] if j >= step else 0, before[j], before[j - step] if j >= step else 0
                p = a + b - c
                paeth = min((a, b, c), key=lambda x: (abs(p - x), 0 if x == a else 1))
                if abs(p - b) <= abs(p - c) and not (abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c)):
                    paeth = b
                out.append((v - [0, a, b, (a + b) // 2, paeth][kind]) & 255)
            raw, before = raw + bytes([kind]) + bytes(out), row
    body = zlib.compress(raw)
    return (b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", width, height if not interlaced else interlaced, depth, colour, 0, 0, 1 if interlaced else 0)) + (part(b"PLTE", palette) if palette else b"")
            + part(b"IDAT", body[:7]) + part(b"IDAT", body[7:]) + part(b"IEND", b""))


def rows_of(x):
    return [r.tobytes() for r in x]


RNG = np.random.default_rng(7)
RGB = RNG.integers(0, 256, (9, 13, 3), dtype=np.uint8)


def test_png_kinds():
    gray, wide = RGB[..., 0], RNG.integers(0, 65536, (5, 4)).astype(">u2")
    palette = bytes(range(48))
    four = RNG.integers(0, 16, (6, 7)).astype(np.uint8)
    packed = [bytes(np.pad(r, (0, 1)).reshape(-1, 2) @ np.array([16, 1], np.uint8)) for r in four]
    bits = RNG.integers(0, 2, (3, 10)).astype(np.uint8)
    for filters in (None, [1, 2, 3, 4, 0], [4]):
        data = png([rows_of(RGB)], 13, 8, 2, filters=filters)
        assert (containers.decode(data) == RGB).all() and containers.inspect(data) == ("PNG", 13, 9, "RGB")
    data = png([rows_of(gray)], 13, 8, 0, filters=[4, 3])
    assert (containers.decode(data) == gray[..., None]).all() and containers.inspect(data).mode == "L"
    data = png([[r.tobytes() for r in wide]], 4, 16, 0, filters=[3])
    assert (containers.decode(data)[..., 0] == wide >> 8).all() and containers.inspect(data).mode == "I;16"
    data = png([packed], 7, 4, 3, palette)
    assert (containers.decode(data) == np.arange(48).reshape(16, 3)[four]).all() and (containers.inspect(data).mode, containers.inspect(data).channels) == ("P", 1)
    data = png([rows_of(np.packbits(bits, axis=1))], 10, 1, 0)
    assert (containers.decode(data)[..., 1] == bits * 255).all() and containers.inspect(data).mode == "1"
    alpha = np.concatenate([RGB, RGB[..., :1]], axis=2)
    data = png([rows_of(alpha)], 13, 8, 6, filters=[4, 1])
    assert (containers.decode(data) == RGB).all() and containers.inspect(data).channels == 4
    assert containers.inspect(png([rows_of(alpha[..., :2])], 13, 8, 4)).mode == "LA"
    passes = [(0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2)]
    parts = [rows_of(np.ascontiguousarray(RGB[y::dy, x::dx])) for x, y, dx, dy in passes]
    assert (containers.decode(png([p for p in parts if p], 13, 8, 2, interlaced=9, filters=[4, 2, 3])) == RGB).all()


def test_broken_files():
    whole = png([rows_of(RGB)], 13, 8, 2)
    for cut in (9, 20, 40, len(whole) - 20, len(whole) - 5):
        with pytest.raises(ValueError, match="truncated"):
            containers.inspect(whole[:cut])
    bent = bytearray(whole)
    bent[50] ^= 1
    with pytest.raises(ValueError, match=r"broken PNG file \(chunk b'IDAT'\)"):
        containers.inspect(bytes(bent))
    short = png([rows_of(RGB[:4])], 13, 8, 2)
    head = short[:16] + struct.pack(">II", 13, 9) + short[24:29]
    with pytest.raises(ValueError, match="truncated"):
        containers.inspect(head + struct.pack(">I", zlib.crc32(head[12:29])) + short[33:])
    for data, said in ((None, "empty"), (b"", "empty"), (b"this is not an image", "cannot identify"), (b"\xff\xd8\xff\xe0", "truncated"), (b"GIF89a", "truncated"), (b"BM12", "truncated"), (b"II*\0", "truncated"), (b"RIFF\0\0\0\0WEBP", "truncated")):
        with pytest.raises(ValueError, match=said):
            containers.inspect(data)
        with pytest.raises(ValueError):
            containers.decode(data)


def test_other_containers():
    gif = b"GIF89a" + struct.pack("<HHBBB", 5, 4, 0x80, 0, 0) + bytes(6) + b"\x21\xfe\x03abc\0" + b"\x2c" + struct.pack("<HHHHB", 0, 0, 5, 4, 0) + b"\x02\x02\x4c\x01\0" + b"\x3b"
    assert containers.inspect(gif) == ("GIF", 5, 4, "P")
    webp = lambda body: b"RIFF" + struct.pack("<I", len(body) + 4) + b"WEBP" + body
    assert containers.inspect(webp(b"VP8X" + struct.pack("<I", 10) + b"\x10\0\0\0" + (99).to_bytes(3, "little") + (49).to_bytes(3, "little"))) == ("WEBP", 100, 50, "RGBA")
    assert containers.inspect(webp(b"VP8L" + struct.pack("<I", 9) + b"\x2f" + struct.pack("<I", 6 | 7 << 14) + bytes(8))) == ("WEBP", 7, 8, "RGB")
    assert containers.inspect(webp(b"VP8 " + struct.pack("<I", 10) + b"\0\0\0\x9d\x01\x2a" + struct.pack("<HH", 30, 20))) == ("WEBP", 30, 20, "RGB")
    tags = [(256, 3, 1, 6), (257, 3, 1, 3), (258, 3, 1, 8), (262, 3, 1, 5), (273, 4, 1, 90), (277, 3, 1, 4), (279, 4, 1, 72)]
    tiff = b"II*\0" + struct.pack("<IH", 8, len(tags)) + b"".join(struct.pack("<HHI", t, k, n) + (struct.pack("<HH", v, 0) if k == 3 else struct.pack("<I", v)) for t, k, n, v in tags)
    tiff = tiff.ljust(162, b"\0")
    assert containers.inspect(tiff) == ("TIFF", 6, 3, "CMYK") and containers.inspect(tiff).channels == 4
    for data in (gif, tiff):
        with pytest.raises(ValueError, match="truncated"):
            containers.inspect(data[:-1])
    bmp = lambda bits, body, top=9, palette=b"": b"BM" + struct.pack("<IHHI", 0, 0, 0, 54 + len(palette)) + struct.pack("<IiiHHIIiiII", 40, 13, top, 1, bits, 0, 0, 0, 0, len(palette) // 4, 0) + palette + body
    lines = b"".join(r[:, ::-1].tobytes().ljust(40, b"\0") for r in RGB)
    assert (containers.decode(bmp(24, lines, -9)) == RGB).all() and (containers.decode(bmp(24, lines)) == RGB[::-1]).all()
    four = b"".join(bytes([*p[::-1], 0]) for p in RGB.reshape(-1, 3)[:4])
    index = RNG.integers(0, 4, (9, 13)).astype(np.uint8)
    assert (containers.decode(bmp(8, b"".join(r.tobytes().ljust(16, b"\0") for r in index), -9, four)) == RGB.reshape(-1, 3)[:4][index]).all()


@pytest.fixture(scope="module")
def jpegs(spark, tmp_path_factory):
    """Files by the JVM's writer: its reader gives the pixels that ours must give."""
    folder, jvm = tmp_path_factory.mktemp("jpegs"), spark._jvm
    for name, kind, (w, h) in (("colour", 5, (50, 37)), ("gray", 10, (33, 64)), ("tiny", 5, (1, 1)), ("flat", 5, (120, 90))):
        image = jvm.java.awt.image.BufferedImage(w, h, kind)
        for y in range(h):
            for x in range(w):
                v = int(120 + 100 * np.sin(x / 9) * np.cos(y / 7))
                image.setRGB(x, y, (v << 16 | (255 - v) << 8 | (x * 3 + y) % 200) if name != "flat" else 0x336699)
        jvm.javax.imageio.ImageIO.write(image, "jpg", jvm.java.io.File(f"{folder}/{name}.jpg"))
    return folder


def test_jpeg(spark, jpegs):
    seen = {r.origin.rsplit("/", 1)[-1]: r for r in spark.read.format("image").load(str(jpegs)).select("image.*").collect()}
    for name, r in seen.items():
        data = (jpegs / name).read_bytes()
        mine = containers.decode(data)
        theirs = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.nChannels)
        theirs = np.repeat(theirs, 3, axis=2) if r.nChannels == 1 else theirs[..., ::-1]
        assert mine.shape == theirs.shape and np.abs(mine.astype(int) - theirs).mean() < 1.5, name
        assert containers.inspect(data) == ("JPEG", r.width, r.height, "L" if name == "gray.jpg" else "RGB")
        with pytest.raises(ValueError, match="truncated"):
            containers.inspect(data[: len(data) * 2 // 3])


def test_tables_of_bytes(spark, jpegs):
    """One row in, one row out, whatever the bytes are."""
    solid = lambda *v: png([rows_of(np.full((40, 40, 3), v, np.uint8))], 40, 8, 2)
    ramp = png([rows_of(np.repeat(np.arange(0, 200, 5, dtype=np.uint8)[:, None], 40, axis=1))], 40, 8, 0)
    data = {"red": solid(250, 10, 10), "black": solid(3, 3, 3), "ramp": ramp, "none": None, "text": b"no image", "cut": solid(1, 2, 3)[:-30], "photo": (jpegs / "colour.jpg").read_bytes()}
    df = spark.createDataFrame([(k, bytearray(v) if v is not None else None, 1) for k, v in data.items()], "name string, content binary, width_ int").repartition(3)
    seen = {r.name: r for r in imagetable.inspected(df).collect()}
    assert (seen["photo"].width, seen["photo"].mode, seen["red"].format, seen["text"].error, seen["cut"].error, seen["none"].error) == (50, "RGB", "PNG", containers.UNKNOWN, containers.CUT, "empty image")
    pixels = {r.name: r for r in imagetable.decoded(df, side=(4, 6)).collect()}
    assert len(pixels["red"].pixels) == 72 and abs(pixels["red"].pixels[0] - 250 / 255) < 1e-6 and pixels["cut"].pixels is None and pixels["cut"].width_ == 1
    again = [{r.name: r.pixels for r in imagetable.decoded(x, side=8, training=True, seed=3, epoch=1, key="name").collect()} for x in (df, df.repartition(1))]
    assert again[0] == again[1] and again[0]["ramp"]
    verdicts = {r.name: r.verdict for r in imagetable.gated(df).collect()}
    assert verdicts == {"red": "colour", "black": "blank", "ramp": "pass", "none": None, "text": None, "cut": None, "photo": "colour"}
    assert {r.name for r in imagetable.fingerprinted(df).filter("fp is not null").collect()} == {"red", "black", "ramp", "photo"}
    assert imagetable.inspected(df.filter("false")).count() == 0
    with pytest.raises(ValueError, match="already has"):
        imagetable.inspected(df.withColumnRenamed("width_", "width"))


def test_gate_bounds_large_images(spark):
    """Figures come from at most 512 pixels a side: fine stripes average out."""
    stripes = np.zeros((4, 2048, 3), np.uint8)
    stripes[:, ::2] = 255
    df = spark.createDataFrame([(1, bytearray(png([rows_of(stripes)], 2048, 8, 2)))], "id int, content binary")
    r = imagetable.gated(df).first()
    assert r.verdict == "pass" or r.intensity_range < 0.6
    assert imagetable.images.bounded(stripes).shape == (1, 512, 3) and abs(imagetable.images.bounded(stripes).mean() - 127.5) < 3
