"""File-backed operators over a tree of PNG images made here."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.functions import images
from gleaner.sources import filetree, manifests, models, reports
from gleaner.streaming.incremental import arriving_files, first_arrivals

SPLITS, CLASSES = ["Training", "Testing"], ["glioma", "notumor"]


def png(pixels: np.ndarray) -> bytes:
    h, w, c = pixels.shape
    part = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    raw = b"".join(b"\0" + r.tobytes() for r in pixels)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2, 4: 6}[c], 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("set") / "raw"
    solid = lambda v, c=3: png(np.full((32, 48, c), v, np.uint8))
    for name, content in {
        "Training/glioma/a.png": solid(10), "Training/glioma/b.jpg": solid(20), "Training/glioma/note.txt": b"x", "Training/glioma/bad.png": b"garbage", "Training/notumor/gray.png": solid(40, 1),
        "Testing/glioma/copy.png": solid(10), "Testing/extra/e.png": solid(50), "Testing/loose.png": solid(60), "stray.txt": b"y", "Training/glioma/deep/n.png": solid(70)}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(content)
    return str(root)


def test_structure(spark, tree):
    got = {(r.kind, r.name, r.n) for r in filetree.discover(spark, tree, SPLITS, CLASSES).collect()}
    assert got == {("missing_class", "Testing/notumor", 1), ("unexpected_class", "Testing/extra", 1), ("root_file", "stray.txt", 1), ("file_in_split", "Testing/loose.png", 1), ("nested_directory", "Training/glioma/deep", 1)}
    with pytest.raises(filetree.PreprocessingError):
        filetree.strict_scan(spark, tree, SPLITS, CLASSES)
    with pytest.raises(filetree.DatasetAuditError):
        filetree.discover(spark, tree, ["Other"], CLASSES)
    assert filetree.strict_scan(spark, tree, ["Training"], CLASSES).count() == 4


def test_metadata(spark, tree):
    m = {r.relative_path: r for r in filetree.image_metadata(spark, tree).collect()}
    assert len(m) == 6
    a, bad, gray = m["Training/glioma/a.png"], m["Training/glioma/bad.png"], m["Training/notumor/gray.png"]
    assert (a.width, a.height, a.mode, a.format, a.valid, a.error) == (48, 32, "RGB", "PNG", True, None)
    assert (bad.width, bad.valid, bad.error) == (None, False, "cannot identify image file") and gray.mode == "L"
    assert m["Training/glioma/b.jpg"].format == "PNG" and a.sha256 == m["Testing/glioma/copy.png"].sha256


def test_empty_folders(spark, tmp_path):
    """An empty class folder is there, a stray or nested empty folder is told, an empty split misses all its classes."""
    for name in ("Training/glioma/a.png", "Training/weird/b.png", "Testing/glioma/nested/d.png", "Training/loose.txt", "stray.zip"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(png(np.zeros((2, 2, 3), np.uint8)))
    for name in ("Training/notumor", "Testing/odd", "Training/glioma/hollow/deeper"):
        (tmp_path / name).mkdir(parents=True)
    got = {(r.kind, r.name, r.n) for r in filetree.discover(spark, str(tmp_path), SPLITS, CLASSES).collect()}
    assert got == {("unexpected_class", "Training/weird", 1), ("unexpected_class", "Testing/odd", 1), ("missing_class", "Testing/notumor", 1), ("file_in_split", "Training/loose.txt", 1),
                   ("root_file", "stray.zip", 1), ("nested_directory", "Testing/glioma/nested", 1), ("nested_directory", "Training/glioma/hollow", 0)}
    (tmp_path / "only" / "Training").mkdir(parents=True)
    assert {(r.kind, r.name) for r in filetree.discover(spark, str(tmp_path / "only"), SPLITS, CLASSES).collect()} == {("missing_split", "Testing"), ("missing_class", "Training/glioma"), ("missing_class", "Training/notumor")}
    with pytest.raises(Exception, match="no folder"):
        filetree.discover(spark, str(tmp_path / "none"), SPLITS, CLASSES)
    (tmp_path / "other" / "x").mkdir(parents=True)
    with pytest.raises(filetree.DatasetAuditError):
        filetree.discover(spark, str(tmp_path / "other"), SPLITS, CLASSES)


def test_preprocessing(spark, tree):
    src = spark.read.format("image").option("recursiveFileLookup", "true").load(tree)
    rows = {r.origin.rsplit("/", 1)[-1]: r for r in images.preprocessed(src, 8).collect()}
    assert len(rows["a.png"].pixels) == 192 and abs(rows["a.png"].pixels[0] - 10 / 255) < 1e-6
    assert rows["bad.png"].pixels is None and rows["bad.png"].error
    one = images.preprocessed(src, 8, training=True, seed=1, epoch=2).collect()
    two = images.preprocessed(src.repartition(3), 8, training=True, seed=1, epoch=2).collect()
    assert {(r.origin, tuple(r.pixels or ())) for r in one} == {(r.origin, tuple(r.pixels or ())) for r in two}
    assert images.fingerprints(src).filter("fp is not null").count() == 7


def test_arrays():
    x = np.random.default_rng(0).random((20, 30, 3)).astype(np.float32)
    assert np.allclose(images.bilinear(x, 20, 30), x) and images.bilinear(x, 7, 5).shape == (7, 5, 3)
    y = images.augment(x, 1, 1, "k")
    assert y.shape == x.shape and 0 <= y.min() and y.max() <= 1 and (y == images.augment(x, 1, 1, "k")).all() and (y != images.augment(x, 1, 2, "k")).any()
    heat = images.class_activation(np.ones((4, 4, 2)), np.stack([np.ones((4, 4)), -0.5 * np.ones((4, 4))], axis=2))
    assert heat.max() == 1 and images.class_activation(np.ones((2, 2, 1)), -np.ones((2, 2, 1))).max() == 0
    assert images.overlay(x.astype(float), heat).shape == x.shape and images.bounded(np.zeros((1024, 10, 3), np.uint8)).shape == (512, 5, 3)
    assert images.colour_map(np.array([0.0, 1.0])).tolist() == [[0, 0, 0.5], [0.5, 0, 0]]


def test_manifests(spark, tmp_path):
    rows = spark.createDataFrame([("b", "False"), ("a", "True")], "relative_path string, is_representative string")
    full = rows.select(F.lit(1).alias("group_id"), F.lit("h").alias("sha256"), "relative_path", F.lit("l").alias("label_name"), "is_representative", F.lit(2).alias("group_size"))
    manifests.write_csv(full, str(tmp_path / "d"), ["relative_path"])
    assert [r[0] for r in manifests.redundant_paths(spark, str(tmp_path / "d")).collect()] == ["b"]
    manifests.write_csv(full.filter("false"), str(tmp_path / "e"))
    assert manifests.redundant_paths(spark, str(tmp_path / "e")).count() == 0 and manifests.redundant_paths(spark, str(tmp_path / "none")).count() == 0
    assert next((tmp_path / "e").glob("part-*")).read_text().startswith("group_id,")
    manifests.write_manifest(rows, str(tmp_path / "m"), "train")
    assert spark.read.csv(str(tmp_path / "m"), header=True).filter("processed_split = 'train'").count() == 2
    with pytest.raises(ValueError):
        manifests.require_rows(rows.filter("false"), "manifest")


def test_model_sources(tmp_path, monkeypatch):
    a, b = tmp_path / "a.bin", tmp_path / "b.bin"
    a.write_bytes(b"model"), b.write_bytes(b"other")
    sha = models.file_sha256(a)
    assert models.resolve(str(a), "GLEANER_T", b) == a
    monkeypatch.setenv("GLEANER_T", str(a))
    assert models.resolve(None, "GLEANER_T", b, expected=f" {sha.upper()} ") == a
    monkeypatch.delenv("GLEANER_T")
    assert models.resolve(None, "GLEANER_T", b) == b
    with pytest.raises(models.ModelError):
        models.resolve(None, "GLEANER_T", b, expected=sha)
    got = models.resolve(None, "GLEANER_T", tmp_path / "n" / "c.bin", url=a.as_uri(), expected=sha)
    assert got.read_bytes() == b"model" and not list(got.parent.glob("*.tmp"))
    with pytest.raises(models.ModelError):
        models.resolve(None, "GLEANER_T", tmp_path / "d.bin", url=a.as_uri(), expected="0" * 64)
    assert not (tmp_path / "d.bin").exists()


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([("a|b", 1.5, None)], "x string, y double, z int")
    text = reports.markdown_report("T", {"S": df, "P": "plain"})
    assert "| a\\|b | 1.5000 |  |" in text
    reports.write_json(tmp_path / "o" / "s.json", {"a": [1]})
    assert (tmp_path / "o" / "s.json").read_text() == '{\n  "a": [\n    1\n  ]\n}\n'


def test_incremental(spark, tree, tmp_path):
    q = first_arrivals(arriving_files(spark, tree, "*.png")).writeStream.format("memory").queryName("arrivals").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("arrivals").groupBy("sha256").count().filter("count > 1").count() == 0
