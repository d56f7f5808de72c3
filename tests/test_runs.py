"""The three runs end to end, input batches and single images. Golden counts are fixed published values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.functions import dataset, scalar
from gleaner.plans import runs

CLASSES = ["glioma", "meningioma", "notumor", "pituitary"]
REMOVED = {"glioma": 0, "meningioma": 14, "notumor": 119, "pituitary": 38}
VALIDATION = {"glioma": 280, "meningioma": 277, "notumor": 256, "pituitary": 272}


@pytest.fixture(scope="module")
def tree(spark):
    """1400 training files a class with the published number of copies, 400 test files a class, some odd ones."""
    rows = []
    for c in CLASSES:
        rows += [("Training", c, i, f"{c}{i if i >= REMOVED[c] else i + 1000}") for i in range(1400)] + [("Testing", c, i, f"t{c}{max(i, 1)}") for i in range(400)]
    df = spark.createDataFrame(rows, "split string, class string, i int, sha256 string")
    return df.select(
        F.concat_ws("/", "split", "class", F.format_string("f%04d.jpg", "i")).alias("relative_path"), "split", "class", "sha256", F.lit(".jpg").alias("extension"), F.lit(512).alias("width"), (F.col("i") % 2 + 500).alias("height"),
        F.when(F.col("i") < 3, "P").otherwise("RGB").alias("mode"), F.when(F.col("i") == 7, "PNG").otherwise("JPEG").alias("format"), F.lit(1000).cast("long").alias("file_size_bytes"), (F.col("i") != 9).alias("valid"), F.when(F.col("i") == 9, "truncated").alias("error"))


def test_split_run(tree):
    tables, doc = runs.split_run(tree, CLASSES)
    assert doc["removed_duplicates_per_class"] == REMOVED and doc["class_counts"]["validation"] == VALIDATION
    assert (doc["original_training_count"], doc["deduplicated_training_count"], doc["train_count"], doc["validation_count"], doc["test_count"]) == (5600, 5429, 4344, 1085, 1600)
    assert doc["class_counts"]["train"] == {"glioma": 1120, "meningioma": 1109, "notumor": 1025, "pituitary": 1090}
    assert tables["split_distribution"].filter("processed_split = 'test'").agg(F.sum("percentage")).first()[0] == 100
    assert tables["test_duplicates"].filter("not is_representative").count() == 4
    leaking = tree.withColumn("sha256", F.when(F.col("relative_path").isin("Training/glioma/f1300.jpg", "Testing/glioma/f0300.jpg"), "shared").otherwise(F.col("sha256")))
    with pytest.raises(ValueError, match="processed/testing: 1"):
        runs.split_run(leaking, CLASSES)


def test_audit_run(spark, tree):
    others = spark.createDataFrame([("Training/glioma/notes.txt", ".txt", 5)], "relative_path string, extension string, file_size_bytes long")
    issues = spark.createDataFrame([("missing_class", "Testing/other", 1), ("nested_directory", "Training/glioma/x", 2)], "kind string, name string, n long")
    codes = tree.select("relative_path", F.when(F.col("height") == 500, F.xxhash64("sha256")).alias("fp"))
    tables, doc = runs.audit_run(tree, others, issues, ["Training", "Testing"], CLASSES, codes)
    c = doc["counts"]
    assert (c["total_images"], c["total_files_scanned"], c["valid_images"], c["per_split"], c["total_size_bytes"]) == (7200, 7201, 7192, {"Training": 5600, "Testing": 1600}, 7_200_005)
    assert doc["imbalance"]["dataset_level"] == {"largest_class": "glioma", "largest_count": 1800, "smallest_class": "glioma", "smallest_count": 1800, "largest_to_smallest_ratio": 1.0}
    assert doc["dimensions"]["most_common"][0] == {"width": 512, "height": 500, "count": 3600, "percentage": 50.06}
    assert doc["modes"]["unusual_modes"] == {"P": 24} and doc["modes"]["rgb"] == 7168
    assert doc["format_extension_mismatches"]["count"] == 8 and len(doc["corrupt_images"]["examples"]) == 8
    assert doc["duplicates"]["groups_within_splits"] == {"Training": sum(REMOVED.values()), "Testing": 4} and doc["duplicates"]["files_in_duplicate_groups"] == 2 * sum(REMOVED.values()) + 8
    assert doc["perceptual_duplicates"]["hash_failures"] == 3600 and doc["perceptual_duplicates"]["status"] == "completed"
    assert doc["warnings"] == ["8 corrupt/unreadable image file(s) found.", "1 non-image file(s) found inside class folders.", "8 image(s) whose real format does not match their extension.", "Missing expected class folder(s) in Testing: other.",
                               "Unexpected nested director(ies) found inside class folders (their files are NOT counted as dataset images)."]
    assert tables["corrupt_images"].count() == 8 and runs.audit_run(tree.limit(3), others, issues, ["Training", "Testing"], CLASSES)[1]["perceptual_duplicates"]["status"] == "skipped"


def test_evaluation_run(spark):
    from tests.test_golden import BASELINE, SCORES, TRANSFER

    rows, serial = [], 0
    for m, o, cm in (("baseline", 0, BASELINE), ("transfer", 1, TRANSFER)):
        for i, r in enumerate(cm):
            for j, n in enumerate(r):
                for _ in range(n):
                    serial += 1
                    rows.append((m, o, f"f{serial}", i, [0.7 if k == j else 0.1 for k in range(4)]))
    scored = spark.createDataFrame(rows, "model string, ordinal int, filepath string, y_true int, prob array<double>")
    redundant = spark.createDataFrame([("f1",), ("f2",), ("elsewhere",)], "relative_path string")
    tables, doc = runs.evaluation_run(scored, CLASSES, redundant)
    assert doc["model_selection"]["selected_model"] == "baseline" and doc["test_sample_count"] == 1600 and [m["key"] for m in doc["models"]] == ["baseline", "transfer"]
    for m in doc["models"]:
        assert m["primary_metrics"]["macro_f1"] == pytest.approx(SCORES[m["key"]][3], abs=1e-9)
    s = {r.model: r for r in tables["duplicate_sensitivity"].collect()}
    assert s["baseline"].dedup_accuracy == pytest.approx((1362 - 2) / 1598, abs=1e-9) and s["transfer"].dedup_accuracy == s["transfer"].primary_accuracy
    assert tables["transfer/misclassified"].count() == 1600 - 1349 and tables["baseline/predictions"].count() == 1600


def test_dataset_and_single_images(spark, tmp_path):
    import struct
    import zlib

    def png(path, colour):
        raw = b"".join(b"\0" + bytes(colour) * 20 for _ in range(10))
        chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
        path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 20, 10, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))

    for i in range(5):
        png(tmp_path / f"{i}.png", (i * 50, 0, 255))
    (tmp_path / "5.png").write_bytes(b"no image")
    manifest = spark.createDataFrame([(str(tmp_path / f"{i}.png"), i % 4) for i in range(7)], "path string, label_id int")
    out = dataset.build_dataset(manifest, batch_size=3, side=8).orderBy("path").collect()
    assert [r.batch for r in out] == [0, 0, 0, 1, 1, 1, 2] and [r.error for r in out] == [None] * 5 + ["cannot identify image file", "missing file"]
    assert out[2].pixels[:3] == pytest.approx([100 / 255, 0, 1], abs=1e-6) and len(out[0].pixels) == 192
    train = lambda e: [(r.batch, r.path) for r in dataset.build_dataset(manifest, 3, True, 1, e, 8).collect()]
    assert sorted(train(0)) == sorted(train(0)) != sorted(train(1))
    assert dataset.build_dataset(manifest.filter("false")).count() == 0
    model = lambda x: np.array([[x[0, ..., 2].mean(), 0.0]])
    for source in (str(tmp_path / "1.png"), (tmp_path / "1.png").read_bytes(), np.full((4, 4, 3), 255, np.uint8)):
        got = dataset.predict_image(source, model, ["blue", "other"], 8)
        assert got["label"] == "blue" and got["confidence"] == pytest.approx(1, abs=1e-6)
    for bad in (b"no image", np.zeros(3)):
        with pytest.raises(ValueError):
            dataset.predict_image(bad, model, ["blue", "other"])
    with pytest.raises(ValueError):
        dataset.predict_image(np.zeros((2, 2)), lambda x: np.array([[np.nan, 0]]), ["a", "b"])
    fine = dataset.explain_image(np.full((6, 6, 3), 9, np.uint8), lambda x: np.ones((2, 2)), 8)
    assert fine["success"] and fine["overlay"].shape == (8, 8, 3)
    failed = dataset.explain_image(b"no image", lambda x: x)
    assert not failed["success"] and "cannot identify" in failed["error"]


def test_scalars(spark):
    row = spark.createDataFrame([("ffffffffffffffff", "0123456789ABCDEF", "xyz")], "a string, b string, c string").select(*(scalar.hex_to_long(F.col(c)).alias(c) for c in "abc")).first()
    assert (row.a, row.b, row.c) == (-1, 0x0123456789ABCDEF, None)
    assert runs.utc_stamp(__import__("datetime").datetime(2024, 1, 2, 3, 4, 5, tzinfo=__import__("datetime").timezone.utc)) == "2024-01-02T03:04:05Z"
    assert scalar.metric_key(["epoch", "accuracy", "val_accuracy"], "accuracy") == "accuracy" and scalar.metric_key(["x_auc", "val_auc"], "auc") == "val_auc"
    with pytest.raises(KeyError):
        scalar.metric_key(["loss"], "auc")
    assert scalar.parameter_count([(3, 3, 3, 32), (32,), ()]) == 897
