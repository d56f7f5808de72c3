"""One ordered file from many tasks, sets of files that appear together, rows with their place in a file."""

import csv
import json
import os

import pytest
from pyspark.sql import functions as F

from gleaner.operators import counts
from gleaner.plans import runs
from gleaner.sources import manifests, reports, sinks

SPLITS, CLASSES = ["Training", "Testing"], ["glioma", "notumor"]


def read(path):
    with open(path, newline="", encoding="utf-8") as f:
        return list(csv.reader(f))


def test_one_ordered_file(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "BLOCK", 500)
    rows = [(i, f'say "{i}", é\n' if i % 7 == 0 else f"v {i} ", None if i % 5 == 0 else i / 4, i % 2 == 0, [i, i + 1]) for i in range(2000)]
    df = spark.createDataFrame(rows, "k long, `t,x` string, d double, b boolean, a array<int>").repartition(9)
    sinks.write_ordered(df, tmp_path / "sub" / "one.csv", [F.desc("k")])
    got = read(tmp_path / "sub" / "one.csv")
    assert got[0] == ["k", "t,x", "d", "b", "a"] and len(got) == 2001
    for (k, t, d, b, a), (wk, wt, wd, wb, wa) in zip(got[1:], sorted(rows, reverse=True)):
        assert (int(k), t, b, json.loads(a)) == (wk, wt, str(wb), wa) and (d == "" if wd is None else float(d) == wd)
    sinks.write_ordered(df.filter("false"), tmp_path / "none.csv", ["k"])
    assert read(tmp_path / "none.csv") == [["k", "t,x", "d", "b", "a"]]
    sinks.write_ordered(df.filter("k < 2"), "file:" + str(tmp_path / "sub" / "one.csv"), ["k"])  # replaces
    assert len(read(tmp_path / "sub" / "one.csv")) == 3 and sorted(os.listdir(tmp_path / "sub")) == ["one.csv"]
    with pytest.raises(ValueError, match="mount"):
        sinks.write_ordered(df, "hdfs://host/x.csv", ["k"])


def test_nothing_is_visible_after_a_failure(spark, tmp_path):
    good = spark.range(5).toDF("k")
    bad = good.select(F.when(F.col("k") == 3, F.raise_error(F.lit("broken row")).cast("long")).otherwise(F.col("k")).alias("k"))
    with pytest.raises(Exception, match="broken row"):
        sinks.write_set(spark, tmp_path / "out", {"a.csv": (good, ["k"]), "b.csv": (bad, ["k"])}, {"c.json": {"x": 1}})
    assert os.listdir(tmp_path / "out") == []
    assert sinks.write_set(spark, tmp_path / "out", {"a.csv": (good, ["k"]), "d/b.csv": (good, ["k"])}, {"c.json": {"x": 1}, "e.md": "text"}) == ["a.csv", "d/b.csv", "c.json", "e.md"]
    assert sorted(os.listdir(tmp_path / "out")) == ["a.csv", "c.json", "d", "e.md"] and json.loads((tmp_path / "out" / "c.json").read_text()) == {"x": 1}
    class Lost(sinks.FileWriter):
        pass
    writer = Lost(str(tmp_path / "f"), 10)
    (tmp_path / "f.part").write_bytes(b"123")
    with pytest.raises(OSError, match="not whole"):
        writer.commit([sinks.Written(3)])
    writer.abort([])
    assert not (tmp_path / "f.part").exists() and not (tmp_path / "f").exists()


def test_rows_know_their_place(spark, tmp_path):
    for name, span in (("a.csv", range(0, 900)), ("b.csv", range(900, 901)), ("c.csv", range(0)), ("d.csv", range(901, 1500))):
        (tmp_path / name).write_text("label_id,relative_path\n" + "".join(f'{i % 4},"dir, {i}/x.png"\n' for i in span))
    for size in ("300", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1" if size == "300" else "4m")
        try:
            rows = manifests.read_rows(spark, str(tmp_path), ["relative_path", "label_id"])
            assert size != "300" or rows.rdd.getNumPartitions() > 4
            got = sorted((r.position, r.relative_path, r.label_id) for r in rows.collect())
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
        assert got == [(i, f"dir, {i}/x.png", str(i % 4)) for i in range(1500)]
    with pytest.raises(ValueError, match="no column"):
        manifests.read_rows(spark, str(tmp_path), ["sha256"])
    (tmp_path / "e.csv").write_text("other\n1\n")
    with pytest.raises(ValueError, match="different headers"):
        manifests.read_rows(spark, str(tmp_path), ["relative_path"])


@pytest.fixture(scope="module")
def rows(spark):
    made = []
    for i in range(60):
        split, label = ("Training" if i % 3 else "Testing"), CLASSES[i % 2]
        made.append((f"{split}/{label}/{i:03d}.{'png' if i % 5 else 'jpg'}", split, label, ".png" if i % 5 else ".jpg", 100 + i % 2, 200, "RGB" if i % 4 else "L", 3, "PNG", 10 * i, f"h{i // 2 if i < 20 else i}", i % 11 != 0, None if i % 11 else "image file is truncated"))
    return spark.createDataFrame(made, runs.METADATA)


def test_audit_files(spark, rows, tmp_path):
    others = spark.createDataFrame([("Training/glioma/n.txt", ".txt", 7)], "relative_path string, extension string, file_size_bytes long")
    issues = spark.createDataFrame([("root_file", f"r{i:05d}", 1) for i in range(12_000)] + [("missing_class", "Testing/notumor", 1), ("nested_directory", "Training/glioma/deep", 0)], "kind string, name string, n long")
    tables, d = runs.audit_run(rows, others, issues, SPLITS, CLASSES)
    assert d["structure_issues"]["counts"] == {"root_file": 12_000, "missing_class": 1, "nested_directory": 1} and len(d["structure_issues"]["unexpected_root_files"]) == 20
    assert d["structure_issues"]["nested_dirs_in_class_dirs"] == [{"path": "Training/glioma/deep", "file_count": 0}]
    names = runs.write_audit(str(tmp_path / "audit"), tables, d, SPLITS, CLASSES)
    assert sorted(names) == sorted(os.listdir(tmp_path / "audit")) == ["audit_report.md", "class_distribution.csv", "corrupt_images.csv", "cross_split_duplicates.csv", "dataset_summary.json", "exact_duplicates.csv", "image_metadata.csv"]
    meta = read(tmp_path / "audit" / "image_metadata.csv")
    assert meta[0] == runs.METADATA.fieldNames() and len(meta) == 61
    order = {"Training": 0, "Testing": 1}
    assert [r[0] for r in meta[1:]] == [r[0] for r in sorted(meta[1:], key=lambda r: (order[r[1]], CLASSES.index(r[2]), r[0]))] and meta[1][11] in ("True", "False")
    assert read(tmp_path / "audit" / "exact_duplicates.csv")[0] == ["sha256", "duplicate_group_size", "group_type", "crosses_splits", "relative_path", "split", "class"]
    assert len(read(tmp_path / "audit" / "corrupt_images.csv")) == 1 + d["corrupt_images"]["count"] == 7
    assert read(tmp_path / "audit" / "class_distribution.csv")[0] == ["split", "class", "image_count", "percentage", "percentage_of_total"]
    text = (tmp_path / "audit" / "audit_report.md").read_text()
    assert [x[3:] for x in text.splitlines() if x.startswith("## ")] == reports.SECTIONS and "| Training |" in text
    assert json.loads((tmp_path / "audit" / "dataset_summary.json").read_text())["counts"] == d["counts"]
    empty, doc = runs.audit_run(rows.filter("false"), others.filter("false"), issues.filter("false"), SPLITS, CLASSES)
    assert doc["counts"]["total_images"] == 0 and doc["warnings"] == []
    runs.write_audit(str(tmp_path / "empty"), empty, doc, SPLITS, CLASSES)
    assert read(tmp_path / "empty" / "corrupt_images.csv") == [["relative_path", "split", "class", "error"]]


def test_one_pass_counts(spark, rows):
    c = {(r.part, r.split, r["class"], r.extension, r.mode, r.width, r.height): r for r in counts.cube(rows).collect()}
    every = c["all", None, None, None, None, None, None]
    assert (every.files, every.valid_files, every.bytes, every.mismatched_files) == (60, 54, sum(10 * i for i in range(60)), sum(i % 5 == 0 and i % 11 != 0 for i in range(60)))
    assert c["size", None, None, None, None, 101, 200].files == 30 and c["mode", None, None, None, "L", None, None].files == 15 and c["extension", None, None, ".jpg", None, None, None].files == 12
    assert sum(r.files for k, r in c.items() if k[0] == "class") == 60 and len(c) == 4 + 2 + 2 + 2 + 1


def test_split_and_evaluation_files(spark, rows, tmp_path):
    clean = rows.withColumn("sha256", F.concat("split", "sha256"))
    tables, d = runs.split_run(clean, CLASSES)
    runs.write_splits(str(tmp_path / "s"), tables, d, CLASSES)
    made = read(tmp_path / "s" / "train_manifest.csv")
    assert made[0] == ["relative_path", "label_name", "label_id", "sha256", "processed_split"] and [r[0] for r in made[1:]] == sorted(r[0] for r in made[1:]) and len(made) == 1 + d["train_count"]
    back = manifests.read_rows(spark, str(tmp_path / "s" / "*_manifest.csv"), ["relative_path", "sha256", "processed_split"])
    assert runs.verify_manifests(back, clean).count() == 0
    # one stale row, one doubled row, one content in two parts
    train = [r[0] for r in made[1:4]]
    bent = back.withColumn("sha256", F.when(F.col("relative_path") == train[0], "old").otherwise(F.col("sha256"))).drop("position")
    bent = bent.unionByName(back.drop("position").filter(F.col("relative_path") == train[1])).unionByName(back.drop("position").filter(F.col("relative_path") == train[2]).withColumn("processed_split", F.lit("test")))
    assert {tuple(r) for r in runs.verify_manifests(bent, clean).collect()} == {("stale", train[0], 1), ("doubled", train[1], 1), ("doubled", train[2], 1), ("leaking", train[2], 2)}
    scored = spark.createDataFrame([(m, o, f"f{i:02d}", i % 2, [0.7, 0.3] if (i + o) % 3 else [0.2, 0.8]) for o, m in enumerate(("one", "two")) for i in range(20)], "model string, ordinal int, filepath string, y_true int, prob array<double>")
    tables, d = runs.evaluation_run(scored, CLASSES, spark.createDataFrame([("f01",)], "relative_path string"))
    runs.write_evaluation(str(tmp_path / "e"), tables, d)
    assert sorted(os.listdir(tmp_path / "e")) == ["duplicate_sensitivity", "evaluation_summary.json", "model_comparison.csv", "model_comparison.json"] + sorted(f"{m}_{x}" for m in ("one", "two") for x in ("classification_report.csv", "confusion_matrix.csv", "metrics.json", "predictions.csv"))
    matrix = read(tmp_path / "e" / "one_confusion_matrix.csv")
    assert matrix[0] == ["class", *CLASSES] and sum(int(x) for r in matrix[1:] for x in r[1:]) == 20
    assert [r[0] for r in read(tmp_path / "e" / "two_classification_report.csv")[1:]] == [*CLASSES, "accuracy", "macro avg", "weighted avg"]
    assert len(read(tmp_path / "e" / "one_predictions.csv")) == 21 and json.loads((tmp_path / "e" / "one_metrics.json").read_text())["model"] == "one"


def test_sections_that_fail_are_told(spark, rows):
    """A failing fingerprint fails its section, not the audit; a class without a row is an error that names it."""
    others, issues = spark.createDataFrame([], "relative_path string, extension string, file_size_bytes long"), spark.createDataFrame([], "kind string, name string, n long")
    codes = rows.select("relative_path", F.when(F.col("relative_path") >= "", F.raise_error(F.lit("no fingerprint")).cast("long")).alias("fp"))
    d = runs.audit_run(rows, others, issues, SPLITS, CLASSES, codes)[1]
    assert d["perceptual_duplicates"]["status"] == "failed" and d["perceptual_duplicates"]["error"] and d["counts"]["total_images"] == 60
    assert "status: failed" in reports.audit_report(d)
    assert [r["class"] for r in counts.first_per_class(rows, ["notumor", "glioma"]).collect()] == ["notumor", "glioma"]
    with pytest.raises(Exception, match="no rows of class pituitary"):
        counts.first_per_class(rows, [*CLASSES, "pituitary"]).collect()


def test_model_summary_file(spark, tmp_path):
    from gleaner.functions import network
    from gleaner.operators.training import Model, model_summary

    model = Model.new(network.baseline(2, (3, 4), 5), (8, 8, 3))
    sinks.write_set(spark, tmp_path, {"model_summary.csv": (model_summary(spark, model, frozen=6), ["layer"])})
    got = read(tmp_path / "model_summary.csv")
    assert got[1] == ["0", "conv_0", "8x8x3", "84", "0"] and got[-1] == ["8", "dense_8", "2", "12", "12"] and len(got) == 10
