"""The three runs as calls: audit, splits and evaluation. Each composes operators and returns tables and a document.

A document is a dict of bounded size: every part is an aggregate over classes, splits or formats, or a listed top-k. Its
keys, texts and limits are fixed values of the published formats.
"""

from __future__ import annotations

from datetime import datetime, timezone
from typing import Any

import numpy as np
import pandas as pd
from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.dims import label_id, ordinal
from gleaner.functions.images import overlay
from gleaner.functions.scalar import expected_format, percent
from gleaner.operators import counts, duplicates, metrics, near, predictions, splits
from gleaner.operators.training import Model, explain
from gleaner.schemas import METADATA
from gleaner.sources.reports import audit_report, rows_of
from gleaner.sources.sinks import write_set
from gleaner.workspace import Workspace

#: How many examples are listed, and the published note.
LISTED = 20
NOTE = ("Heuristic similarity only - not proof of duplication. Never delete files based on this section alone. Groups are connected components at the "
        "threshold, so very large group(s) can reflect transitive similarity chaining rather than one duplicate cluster.")


def utc_stamp(at: datetime | None = None) -> str:
    return (at or datetime.now(timezone.utc)).astimezone(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def listed(rows: DataFrame, order: list[str], columns: list[str], most: int = LISTED) -> DataFrame:
    """The first ``most`` rows by ``order``: the examples of a report."""
    return rows.orderBy(*order).limit(most).select(*columns)


def warning_messages(counts_: DataFrame) -> DataFrame:
    """``counts_``: one row with the counters named here; one message for each counter above 0, in this order."""
    texts = [  # fixed values: the published messages
        ("groups_crossing_splits", "%d exact-duplicate group(s) cross Training and Testing (%d Training + %d Testing files) - potential leakage.", ["groups_crossing_splits", "cross_split_files_training", "cross_split_files_testing"]),
        ("conflicting_class_groups", "%d duplicate group(s) contain conflicting class labels for identical content.", None),
        ("invalid_images", "%d corrupt/unreadable image file(s) found.", None),
        ("non_image_files", "%d non-image file(s) found inside class folders.", None),
        ("format_mismatches", "%d image(s) whose real format does not match their extension.", None)]
    made = [F.when(F.col(c) > 0, F.format_string(text, *(of or [c]))) for c, text, of in texts]
    return counts_.select(F.explode(F.array_compact(F.array(*made))).alias("message"))


def _imbalance(cells: dict[str, int], classes: list[str]) -> dict:
    """``cells``: files by class. Ties go to the earlier class."""
    n = [cells.get(c, 0) for c in classes]
    high, low = (f(range(len(n)), key=n.__getitem__) for f in (max, min))
    return {"largest_class": classes[high], "largest_count": n[high], "smallest_class": classes[low], "smallest_count": n[low], "largest_to_smallest_ratio": round(n[high] / n[low], 3) if n[low] else None}


def _duplicates(groups: DataFrame, valid: int, splits_: list[str]) -> dict:
    cross, conflict = F.col("crosses_splits"), F.col("n_classes") > 1
    total = lambda what: F.coalesce(F.sum(what), F.lit(0)).cast("long")
    s = groups.agg(
        F.count("*").alias("groups"), total(F.col("group_size")).alias("files"), F.count_if(cross).alias("cross"), total(F.when(cross, F.col("training_files"))).alias("training"), total(F.when(cross, F.col("testing_files"))).alias("testing"),
        F.count_if(conflict).alias("conflicts"), total(F.when(conflict, F.col("group_size"))).alias("conflict_files"), *(F.count_if(~cross & (F.col("first_split") == x)).alias(f"in{i}") for i, x in enumerate(splits_))).first()
    return {
        "groups_total": s.groups, "files_in_duplicate_groups": s.files, "groups_within_splits": {x: s[f"in{i}"] for i, x in enumerate(splits_)},
        "groups_crossing_splits": s.cross, "unique_hashes_crossing_splits": s.cross, "cross_split_files_training": s.training, "cross_split_files_testing": s.testing,
        "conflicting_class_groups": s.conflicts, "conflicting_class_files": s.conflict_files, "duplicate_file_ratio_percent": round(s.files / valid * 100, 2) if valid else 0.0}


def _perceptual(rows: DataFrame, codes: DataFrame | None, threshold: int) -> dict:
    """``codes``: relative_path, fp (NULL where hashing failed); None skips the section. What goes wrong here is told in the
    section and doesn't end the audit."""
    if codes is None:
        return {"status": "skipped", "method": None}
    try:
        keyed = rows.select(F.xxhash64("relative_path").alias("id"), "relative_path", "split", "class").join(codes, "relative_path")
        s = near.summary(keyed.select("id", "fp"), keyed.select("id", "split", "class"), threshold).first()
        n = keyed.agg(F.count("fp").alias("hashed"), F.count_if(F.col("fp").isNull()).alias("failed")).first()
    except (PySparkException, Py4JError) as e:
        return {"status": "failed", "method": None, "error": f"{type(e).__name__}: {str(e).splitlines()[0]}"}
    return {
        "status": "completed", "method": f"pHash (64-bit), Hamming distance <= {threshold}", "images_hashed": n.hashed, "hash_failures": n.failed, "near_duplicate_pairs": s.pairs, "pairs_capped": False,
        "groups": s.groups, "files_in_groups": s.files, "largest_group_size": s.largest, "cross_split_groups": s.cross_split_groups, "conflicting_class_groups": s.conflicting_groups, "note": NOTE}


def audit_run(rows: DataFrame, others: DataFrame, issues: DataFrame, splits_: list[str], classes: list[str], codes: DataFrame | None = None, threshold: int = 8, dataset: dict | None = None) -> tuple[dict[str, DataFrame], dict[str, Any]]:
    """Tables and summary document of an audited tree.

    ``rows``: images (``filetree.image_metadata``); ``others``: non-image files in class folders (relative_path, extension,
    file_size_bytes); ``issues``: ``filetree.structure_anomalies``; ``codes``: perceptual hashes by path.
    """
    spark, work = rows.sparkSession, Workspace(rows.sparkSession, "audit")
    rows = work.stash(rows, "rows")
    # three passes: all counts, the contents of several files, and the rows that are listed by name
    cube = work.stash(counts.cube(rows), "counts")
    groups = work.stash(duplicates.groups(rows), "groups")
    want = expected_format(F.col("extension"))
    mismatch = F.col("valid") & want.isNotNull() & ~want.eqNullSafe(F.col("format"))
    odd = work.stash(rows.filter(~F.col("valid") | mismatch).select("relative_path", "split", "class", "extension", F.col("format").alias("actual_format"), "error", "valid"), "odd")
    part = lambda name: cube.filter(F.col("part") == name)
    by = lambda df, column, n: {r[column]: r[n] for r in rows_of(df.filter(F.col(n) > 0).orderBy(F.desc(n), column).select(column, n))}
    grid = rows_of(part("class").select("split", "class", "files", "valid_files"))
    total = part("all").first()
    total = total.asDict() if total else {"files": 0, "valid_files": 0, "mismatched_files": 0, "bytes": 0}
    n, valid, mismatches = total["files"], total["valid_files"], total["mismatched_files"]
    kinds = work.stash(others.groupBy("extension").agg(F.count("*").alias("files"), F.coalesce(F.sum("file_size_bytes"), F.lit(0)).cast("long").alias("bytes")), "others")
    rest = kinds.agg(F.coalesce(F.sum("files"), F.lit(0)).alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()
    cells = {s: {c: sum(r["files"] for r in grid if (r["split"], r["class"]) == (s, c)) for c in classes} for s in splits_}
    fine = {c: sum(r["valid_files"] for r in grid if r["class"] == c) for c in classes}
    sizes = part("size").filter("valid_files > 0")
    bounds = sizes.agg(F.count("*").alias("n"), *(f(c).alias(f"{name}_{c}") for c in ("width", "height") for name, f in (("min", F.min), ("max", F.max)))).first()
    common = rows_of(sizes.orderBy(F.desc("valid_files"), "first_path").limit(10).select("width", "height", "valid_files"))
    modes = by(part("mode"), "mode", "valid_files")
    # counts are whole; of names the missing ones are whole (as many as are declared), of others the first are listed
    issues = work.stash(issues.select("kind", "name", "n"), "issues")
    told = {r["kind"]: r["count"] for r in issues.groupBy("kind").count().collect()}  # a row a kind
    found = {k: rows_of(issues.filter(F.col("kind") == k).orderBy("name").limit(m).select("name", "n")) for k in told for m in [len(splits_) * len(classes) + len(splits_) if k.startswith("missing") else LISTED]}
    names = lambda k: [r["name"] for r in found.get(k, [])]
    missing: dict[str, list[str]] = {}
    for name in names("missing_class"):
        missing.setdefault(name.split("/")[0], []).append(name.split("/")[1])
    dup, bytes_ = _duplicates(groups, valid, splits_), total["bytes"] + rest["bytes"]
    flags = spark.createDataFrame([(dup["groups_crossing_splits"], dup["cross_split_files_training"], dup["cross_split_files_testing"], dup["conflicting_class_groups"], n - valid, rest["n"], mismatches)],
                                  "groups_crossing_splits long, cross_split_files_training long, cross_split_files_testing long, conflicting_class_groups long, invalid_images long, non_image_files long, format_mismatches long")
    warnings = [r["message"] for r in rows_of(warning_messages(flags))]
    warnings += [f"Missing expected class folder(s) in {s}: {', '.join(x)}." for s, x in missing.items()]
    if told.get("missing_split"):
        warnings.append(f"Missing expected split folder(s): {', '.join(names('missing_split'))}.")
    if told.get("nested_directory"):
        warnings.append("Unexpected nested director(ies) found inside class folders (their files are NOT counted as dataset images).")
    per_class = {c: sum(cells[s][c] for s in splits_) for c in classes}
    document = {
        "generated_at_utc": utc_stamp(),
        "dataset": {**(dataset or {}), "expected_splits": splits_, "expected_classes": classes, "detected_splits": [s for s in splits_ if any(cells[s].values())], "detected_classes": [c for c in classes if per_class[c]]},
        "structure_issues": {
            "missing_splits": names("missing_split"), "missing_classes": missing, "unexpected_class_dirs": names("unexpected_class"), "unexpected_files_in_split_dirs": names("file_in_split"),
            "unexpected_root_files": names("root_file"), "nested_dirs_in_class_dirs": [{"path": r["name"], "file_count": r["n"]} for r in found.get("nested_directory", [])], "non_image_files": [r["relative_path"] for r in rows_of(listed(others, ["relative_path"], ["relative_path"]))],
            "counts": told},
        "counts": {
            "total_files_scanned": n + rest["n"], "total_images": n, "valid_images": valid, "invalid_images": n - valid, "non_image_files": rest["n"], "per_split": {s: sum(cells[s].values()) for s in splits_},
            "per_split_class": cells, "per_class": per_class, "valid_per_class": fine, "total_size_bytes": bytes_, "total_size_mb": round(bytes_ / 2**20, 2)},
        "imbalance": {"dataset_level": _imbalance(per_class, classes), "per_split": {s: _imbalance(cells[s], classes) for s in splits_}},
        "extensions": {"image_extensions": by(part("extension"), "extension", "files"), "non_image_extensions": by(kinds, "extension", "files")},
        "dimensions": {
            "unique_combinations": bounds.n, "min_width": bounds.min_width, "max_width": bounds.max_width, "min_height": bounds.min_height, "max_height": bounds.max_height,
            "most_common": [{"width": r["width"], "height": r["height"], "count": r["valid_files"], "percentage": round(r["valid_files"] / valid * 100, 2)} for r in common]},
        "modes": {"counts_by_mode": modes, "grayscale_L": modes.get("L", 0), "rgb": modes.get("RGB", 0), "rgba": modes.get("RGBA", 0), "unusual_modes": {m: k for m, k in modes.items() if m not in ("L", "RGB", "RGBA")}},
        "format_extension_mismatches": {"count": mismatches, "examples": rows_of(listed(odd.filter("valid"), ["relative_path"], ["relative_path", "extension", "actual_format"]))},
        "corrupt_images": {"count": n - valid, "by_split": {s: sum(r["files"] - r["valid_files"] for r in grid if r["split"] == s) for s in splits_ if any(r["files"] > r["valid_files"] for r in grid if r["split"] == s)},
                           "examples": rows_of(listed(odd.filter("not valid"), ["relative_path"], ["relative_path", "split", "class", "error"]))},
        "duplicates": dup, "perceptual_duplicates": _perceptual(rows, codes, threshold), "warnings": warnings}
    members = rows.join(groups.select("sha256", "group_size", "group_type", "crosses_splits"), "sha256")
    tables = {
        "class_distribution": counts.class_distribution(rows, splits_, classes), "image_metadata": counts.in_reference_order(rows, splits_, classes), "corrupt_images": odd.filter("not valid").select("relative_path", "split", "class", "error"),
        "exact_duplicates": members, "cross_split_duplicates": members.filter("crosses_splits")}
    return tables, document


def write_audit(folder: str, tables: dict[str, DataFrame], document: dict[str, Any], splits_: list[str], classes: list[str]) -> list[str]:
    """The published files of an audit, all or none: five tables, the summary and the report."""
    spark = tables["image_metadata"].sparkSession
    place = [ordinal(F.col("split"), splits_), "split", ordinal(F.col("class"), classes), "class"]
    copies = lambda df: (df.select("sha256", F.col("group_size").alias("duplicate_group_size"), "group_type", "crosses_splits", "relative_path", "split", "class"), [F.desc("duplicate_group_size"), "sha256", "relative_path"])
    shares = tables["class_distribution"].select("split", "class", F.col("files").alias("image_count"), F.col("pct_of_split").alias("percentage"), F.col("pct_of_total").alias("percentage_of_total"))
    files = {
        "image_metadata.csv": (tables["image_metadata"].select(*METADATA.fieldNames()), [*place, "relative_path"]), "corrupt_images.csv": (tables["corrupt_images"], [*place, "relative_path"]),
        "exact_duplicates.csv": copies(tables["exact_duplicates"]), "cross_split_duplicates.csv": copies(tables["cross_split_duplicates"]), "class_distribution.csv": (shares, place)}
    return write_set(spark, folder, files, {"dataset_summary.json": document, "audit_report.md": audit_report(document)})


def write_splits(folder: str, tables: dict[str, DataFrame], document: dict[str, Any], classes: list[str]) -> list[str]:
    """Manifests, removed copies, test copies, distribution and summary of a split run, all or none."""
    names = ("train", "validation", "test")
    files = {f"{n}_manifest.csv": (tables[n], ["relative_path"]) for n in names}
    files["training_deduplication.csv"] = (tables["training_duplicates"].select("sha256", "kept_relative_path", "removed_relative_path", "label_name"), ["kept_relative_path", "removed_relative_path"])
    files["test_duplicates.csv"] = (tables["test_duplicates"].select("group_id", "sha256", "relative_path", "label_name", "is_representative", "group_size"), ["group_id", "relative_path"])
    files["class_distribution.csv"] = (tables["split_distribution"].select("processed_split", "label_name", "image_count", "percentage"), [ordinal(F.col("processed_split"), list(names)), ordinal(F.col("label_name"), classes)])
    return write_set(tables["train"].sparkSession, folder, files, {"split_summary.json": document})


def write_evaluation(folder: str, tables: dict[str, DataFrame], document: dict[str, Any]) -> list[str]:
    """Each model's metrics, report, predictions and confusion matrix, the comparison and the summary, all or none."""
    names, spark = document["class_names_fixed_order"], tables["comparison"].sparkSession
    files, documents = {"model_comparison.csv": (tables["comparison"], ["model"])}, {"evaluation_summary.json": document, "model_comparison.json": {m["key"]: m["primary_metrics"] for m in document["models"]} | {"selection": document["model_selection"]}}
    for m in document["models"]:
        key = m["key"]
        cells = tables[f"{key}/confusion"]
        wide = cells.groupBy("true_id").agg(*(F.sum(F.when(F.col("pred_id") == i, F.col("n")).otherwise(0)).alias(x) for i, x in enumerate(names)))
        files[f"{key}_confusion_matrix.csv"] = (wide.select("true_id", F.get(F.array(*(F.lit(x) for x in names)), F.col("true_id")).alias("class"), *names).select("class", *names), [ordinal(F.col("class"), names)])
        report = tables[f"{key}/classification_report"]
        files[f"{key}_classification_report.csv"] = (report, [ordinal(F.col(report.columns[0]), [*names, "accuracy", "macro avg", "weighted avg"])])
        files[f"{key}_predictions.csv"] = (tables[f"{key}/predictions"], ["filepath"])
        documents[f"{key}_metrics.json"] = {**m["primary_metrics"], "model": key}
    if "duplicate_sensitivity" in tables:
        files["duplicate_sensitivity/comparison.csv"] = (tables["duplicate_sensitivity"], ["model"])
    return write_set(spark, folder, files, documents)


def explanation_run(model: Model, pixels: DataFrame, table: DataFrame, names: list[str], k: int = 4) -> tuple[DataFrame, dict[str, Any]]:
    """Activation maps of chosen predictions: the first correct one of each class and the first ``k`` wrong ones.

    ``pixels``: filepath, pixels, perhaps error; ``table``: ``predictions.predictions_table``. A row an example, with heat and
    overlay (RGB in [0, 1], flat) or its error, and a document that counts them."""
    examples = predictions.select_examples(table, names, k)
    rows = examples.join(pixels, "filepath", "left")  # at most k and a row a class
    rows = rows.withColumn("error", F.coalesce("error", F.when(F.col("pixels").isNull(), "missing image"))) if "error" in pixels.columns else rows.withColumn("error", F.when(F.col("pixels").isNull(), "missing image"))
    mapped = explain(model, rows, names)
    h, w = model.shape[:2]

    @F.pandas_udf("array<float>")
    def blended(image: pd.Series, heat: pd.Series) -> pd.Series:
        of = lambda x, m: None if x is None or m is None else overlay(np.broadcast_to(np.asarray(x, float).reshape(h, w, -1), (h, w, 3)), np.asarray(m, float).reshape(h, w)).astype(np.float32).ravel()
        return pd.Series([of(x, m) for x, m in zip(image, heat, strict=True)])

    out = Workspace(table.sparkSession, "explanations").stash(mapped.withColumn("overlay", blended("pixels", "heat")).drop("pixels"), "maps")
    wrong = F.col("true_label_name") != F.col("predicted_label_name")
    n = out.agg(F.count_if(~wrong).alias("correct"), F.count_if(wrong).alias("misclassified"), F.count("heat").alias("explained"), F.count("error").alias("failed")).first()
    return out, {"generated_at_utc": utc_stamp(), "correct_examples": n.correct, "misclassified_examples": n.misclassified, "explained": n.explained, "failed": n.failed, "classes": names}


def verify_manifests(manifests: DataFrame, tree: DataFrame) -> DataFrame:
    """What is wrong with written manifests (relative_path, sha256, processed_split) against the tree (relative_path, sha256):
    problem, relative_path, n. Bags are compared, so a row that a manifest has twice is told.

    stale: the manifests' content of a path is not the tree's (or the path is gone); doubled: more rows of a path than the
    tree has files; leaking: a content of the training or validation part that another part has too, by its first path.
    """
    bag = manifests.select("relative_path", "sha256").exceptAll(tree.select("relative_path", "sha256"))
    extra = bag.groupBy("relative_path", "sha256").agg(F.count("*").alias("n"))
    own = tree.select("relative_path", "sha256").distinct().withColumn("there", F.lit(True))
    bad = extra.join(own, ["relative_path", "sha256"], "left").select(F.when(F.col("there").isNull(), "stale").otherwise("doubled").alias("problem"), "relative_path", "n")
    parts = manifests.groupBy("sha256").agg(F.min("relative_path").alias("relative_path"), F.countDistinct("processed_split").alias("parts"), F.count("*").alias("n")).filter("parts > 1 and sha256 is not null")
    return bad.unionByName(parts.select(F.lit("leaking").alias("problem"), "relative_path", "n"))


def split_run(rows: DataFrame, classes: list[str], fraction: float = 0.2, seed: int = 42, **about) -> tuple[dict[str, DataFrame], dict[str, Any]]:
    """Manifests and summary of hashed rows (relative_path, split, class, sha256, valid); ValueError where contents leak."""
    work = Workspace(rows.sparkSession, "splits")
    training, test = rows.filter("split = 'Training'"), rows.filter("split = 'Testing'")
    whole = work.stash(splits.stratified_split(duplicates.keep_first(training).select("relative_path", "class", "sha256"), fraction, seed), "processed")
    train, validation = (whole.filter(F.col("processed_split") == x) for x in ("train", "validation"))
    leaks = rows_of(splits.leakage(train, validation, test))
    if leaks:
        raise ValueError("contents in two splits: " + "; ".join(f"{x['check']}: {x['n_hashes']} ({x['examples']})" for x in leaks))
    removed = duplicates.report(training)
    marked = lambda df, name: df.select("relative_path", F.col("class").alias("label_name"), label_id(F.col("class"), classes).alias("label_id"), "sha256", F.lit(name).alias("processed_split"))
    tables = {"train": marked(train, "train"), "validation": marked(validation, "validation"), "test": marked(test, "test"), "training_duplicates": removed, "test_duplicates": duplicates.ranked_groups(test)}
    per = {n: {c: 0 for c in classes} | {r["label_name"]: r["count"] for r in tables[n].groupBy("label_name").count().collect()} for n in ("train", "validation", "test", "training_duplicates")}  # a row a class
    n = {k: sum(v.values()) for k, v in per.items()}
    kept = n["train"] + n["validation"]
    everything = tables["train"].unionByName(tables["validation"]).unionByName(tables["test"]).groupBy("processed_split", "label_name").agg(F.count("*").alias("image_count"))
    in_split = everything.groupBy("processed_split").agg(F.sum("image_count").alias("all"))
    tables["split_distribution"] = everything.join(in_split, "processed_split").select("processed_split", "label_name", "image_count", percent(F.col("image_count"), F.col("all")).alias("percentage"))
    document = {
        "generated_at_utc": utc_stamp(), **about, "random_seed": seed, "validation_fraction": fraction, "label_mapping": {c: i for i, c in enumerate(classes)},
        "original_training_count": kept + n["training_duplicates"], "deduplicated_training_count": kept, "removed_duplicate_count": n["training_duplicates"], "removed_duplicates_per_class": per["training_duplicates"],
        "train_count": n["train"], "validation_count": n["validation"], "test_count": n["test"], "class_counts": {k: per[k] for k in ("train", "validation", "test")}}
    return tables, document


def evaluation_run(scored: DataFrame, names: list[str], redundant: DataFrame | None = None, **about) -> tuple[dict[str, DataFrame], dict[str, Any]]:
    """Reports of scored rows (model, ordinal, filepath, y_true, prob) of any number of models, with and without ``redundant``
    copies (relative_path). Every figure comes from one written predictions table."""
    from gleaner.functions.scalar import argmax

    work, k = Workspace(scored.sparkSession, "evaluation"), len(names)
    scored = work.stash(scored.select("model", "ordinal", "filepath", "y_true", "prob", argmax(F.col("prob")).alias("y_pred")), "predictions")
    models = [r.model for r in scored.groupBy("model").agg(F.min("ordinal").alias("o")).orderBy("o").collect()]  # a row a model
    cm = work.stash(metrics.confusion(scored, k, ["model", "ordinal"]), "confusion")
    overall = work.stash(metrics.overall(cm, ["model", "ordinal"]), "overall")
    tables = {"comparison": overall.drop("ordinal"), "per_class": metrics.per_class(cm, ["model"])}
    for m in models:
        own, cells = scored.filter(F.col("model") == m), cm.filter(F.col("model") == m).select("true_id", "pred_id", "n")
        tables[f"{m}/predictions"] = predictions.predictions_table(own.select("filepath", "y_true", "prob"), names)
        tables[f"{m}/misclassified"] = predictions.misclassified(tables[f"{m}/predictions"])
        tables[f"{m}/classification_report"] = metrics.report(cells, names)
        tables[f"{m}/confusion_normalised"] = metrics.normalised(cells)
        tables[f"{m}/confusion"] = cells
    winner = metrics.select_winner(overall).first().asDict()
    by_model = {r["model"]: r for r in rows_of(tables["comparison"])}
    document = {
        "eval_timestamp_utc": utc_stamp(), **about, "test_sample_count": scored.filter(F.col("model") == models[0]).count() if models else 0, "class_mapping": {c: i for i, c in enumerate(names)}, "class_names_fixed_order": names,
        "primary_comparison_metric": winner["primary_metric"], "models": [{"key": m, "primary_metrics": {c: v for c, v in by_model[m].items() if c != "model"}} for m in models], "model_selection": winner}
    if redundant is not None:
        left = duplicates.without(scored.withColumnRenamed("filepath", "relative_path"), redundant)
        again = metrics.overall(metrics.confusion(left, k, ["model"]), ["model"])
        tables["duplicate_sensitivity"] = tables["comparison"].select("model", F.col("accuracy").alias("primary_accuracy"), F.col("macro_f1").alias("primary_macro_f1")).join(
            again.select("model", F.col("accuracy").alias("dedup_accuracy"), F.col("macro_f1").alias("dedup_macro_f1")), "model", "left")
        document["duplicate_sensitivity"] = {"redundant_copies_removed": redundant.count()}
    return tables, document
