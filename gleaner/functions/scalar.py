"""Scalar expressions shared by operators; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: File extensions that count as images, and the format each stands for.
IMAGE_EXTENSIONS = [".jpg", ".jpeg", ".png", ".bmp", ".gif", ".tif", ".tiff", ".webp"]
EXPECTED_FORMAT = {".jpg": "JPEG", ".jpeg": "JPEG", ".png": "PNG", ".bmp": "BMP", ".gif": "GIF", ".tif": "TIFF", ".tiff": "TIFF", ".webp": "WEBP"}
#: A file name pattern for them, in any case.
IMAGE_GLOB = "*.{" + ",".join("".join(f"[{c}{c.upper()}]" for c in e[1:]) for e in IMAGE_EXTENSIONS) + "}"


def share(part: Column, whole: Column) -> Column:
    """part / whole; 0 where whole is 0."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    return F.round(share(part, whole) * 100, digits)


def extension(path: Column) -> Column:
    """Lower-cased suffix with its dot, or the empty string."""
    return F.regexp_extract(F.lower(path), r"(\.[^./]+)$", 1)


def is_image(path: Column) -> Column:
    return extension(path).isin(IMAGE_EXTENSIONS)


def expected_format(ext: Column) -> Column:
    out = F.lit(None).cast("string")
    for e, name in EXPECTED_FORMAT.items():
        out = F.when(ext == e, F.lit(name)).otherwise(out)
    return out


def posix(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def relative_to(path: Column, root: str) -> Column:
    """Relative POSIX path under ``root``; a path elsewhere stays as it is."""
    p, top = posix(path), root.rstrip("/") + "/"
    return F.when(p.startswith(top), F.substr(p, F.lit(len(top) + 1))).otherwise(p)


def reroot(path: Column, anchor: str, root: str) -> Column:
    """Everything from the first path part named ``anchor`` on, put under ``root``; else the path itself."""
    parts = F.split(posix(path), "/")
    at = F.array_position(parts, anchor)
    tail = F.array_join(F.slice(parts, F.greatest(at, F.lit(1)).cast("int"), F.size(parts)), "/")
    return F.when(at > 0, F.concat(F.lit(root.rstrip("/") + "/"), tail)).otherwise(path)


def magic_format(content: Column) -> Column:
    """Image format from the leading bytes."""
    h = F.hex(F.substring(content, 1, 12))
    return (F.when(h.startswith("89504E470D0A1A0A"), "PNG").when(h.startswith("FFD8FF"), "JPEG").when(h.startswith("47494638"), "GIF")
            .when(h.startswith("424D"), "BMP").when(h.startswith("49492A00") | h.startswith("4D4D002A"), "TIFF")
            .when(h.startswith("52494646") & h.endswith("57454250"), "WEBP"))


def argmax(values: Column) -> Column:
    """0-based place of the first maximum."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def valid_probabilities(p: Column, size: int, slack: float = 1e-4) -> Column:
    """Right length, finite and within [0, 1] up to ``slack``."""
    fine = F.forall(p, lambda x: ~F.isnan(x) & x.between(-slack, 1 + slack))
    return F.coalesce((F.size(p) == size) & fine, F.lit(False))


def clip01(p: Column) -> Column:
    return F.transform(p, lambda x: F.greatest(F.least(x, F.lit(1.0)), F.lit(0.0)))


def sane_probabilities(p: Column, slack: float = 1e-5) -> Column:
    total = F.aggregate(p, F.lit(0.0), lambda a, x: a + x)
    return F.coalesce(F.forall(p, lambda x: ~F.isnan(x) & (F.abs(x) < float("inf"))) & (F.abs(total - 1) <= slack), F.lit(False))


def softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    e = F.transform(logits, lambda x: F.exp(x - top))
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    return F.transform(e, lambda x: x / total)


def array_percentile(ordered: Column, p: float) -> Column:
    """Linear interpolation between the neighbours, on a sorted array."""
    at = (F.size(ordered) - 1) * F.lit(float(p))
    low, high = F.floor(at).cast("int"), F.ceil(at).cast("int")
    a, b = F.get(ordered, low), F.get(ordered, high)
    return a + (b - a) * (at - low)


def sha_matches(content: Column, expected: Column) -> Column:
    """A blank expectation always holds."""
    want = F.lower(F.trim(F.coalesce(expected, F.lit(""))))
    return (want == "") | (want == F.sha2(content, 256))


def max_normalise(values: Column, floor: float = 1e-8) -> Column:
    """Divided by the maximum; a map without any positive value is all zero."""
    top = F.array_max(values)
    return F.transform(values, lambda x: F.when(top > floor, x / top).otherwise(F.lit(0.0)))


def hex_to_long(code: Column) -> Column:
    """16 hexadecimal digits as the signed number with the same 64 bits; NULL where they are none."""
    half = lambda at: F.conv(F.substring(code, at, 8), 16, 10).cast("long")
    return F.when(code.rlike("^[0-9a-fA-F]{16}$"), F.shiftleft(half(1), 32).bitwiseOR(half(9)))


def utc_text(at: Column) -> Column:
    """A timestamp as ISO 8601 text to the second, in UTC whatever the session's time zone."""
    return F.date_format(F.to_utc_timestamp(at, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def metric_key(columns: list[str], name: str) -> str:
    """The column that holds a metric: the name itself, else the first that ends with it (``val_`` before others)."""
    fits = [c for c in columns if c == name] or sorted((c for c in columns if c.endswith(name)), key=lambda c: (not c.startswith("val_"), columns.index(c)))
    if not fits:
        raise KeyError(f"no column for {name}")
    return fits[0]


def parameter_count(shapes: list[tuple[int, ...]]) -> int:
    """Numbers in arrays of these shapes; a scalar's shape is ()."""
    from math import prod

    return sum(prod(s) for s in shapes)
