"""Queries of the audit, duplicate, split and history families."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.dims import label_id, label_name
from gleaner.functions.scalar import expected_format, reroot
from gleaner.operators import counts, duplicates, history, near, pixels, splits
from gleaner.plans import tables as t
from gleaner.plans.registry import query, table

GROUPS = f"""WITH {t.FILES}, g AS (SELECT sha256, count(*) AS group_size, count(DISTINCT split) AS n_splits, count(DISTINCT class) AS n_classes,
  count(*) FILTER (split = 'Training') AS training_files, count(*) FILTER (split = 'Testing') AS testing_files, min(relative_path) AS first_path, min(split) AS first_split
  FROM files GROUP BY sha256 HAVING count(*) > 1)"""
KEEP = f"WITH {t.FILES}, k AS (SELECT *, row_number() OVER (PARTITION BY sha256 ORDER BY relative_path) AS r, min(relative_path) OVER (PARTITION BY sha256) AS kept_path FROM files WHERE split = 'Training')"


@query("dup_summary", GROUPS + """
SELECT count(*) AS duplicate_groups, coalesce(sum(group_size), 0)::BIGINT AS duplicate_files, count(*) FILTER (n_splits > 1) AS cross_groups,
 coalesce(sum(training_files) FILTER (n_splits > 1), 0)::BIGINT AS cross_training_files, coalesce(sum(testing_files) FILTER (n_splits > 1), 0)::BIGINT AS cross_testing_files,
 count(*) FILTER (n_classes > 1) AS conflicting_groups, coalesce(sum(group_size) FILTER (n_classes > 1), 0)::BIGINT AS conflicting_files,
 count(*) FILTER (n_splits = 1 AND first_split = 'Training') AS within_training, count(*) FILTER (n_splits = 1 AND first_split = 'Testing') AS within_testing,
 coalesce(max(group_size), 0) AS largest_group, any_value(v.valid_files) AS valid_files, coalesce(sum(group_size), 0)::DOUBLE / any_value(v.valid_files) AS duplicate_ratio
FROM g, (SELECT count(*) FILTER (valid) AS valid_files FROM files) v""")
def dup_summary(spark, sf):
    return duplicates.summary(t.files(spark, sf))


@query("exact_dup_groups", GROUPS + """SELECT sha256, group_size, n_splits, n_classes, training_files, testing_files, CASE WHEN n_classes > 1 THEN 'conflicting-class' ELSE 'same-class' END AS group_type, n_splits > 1 AS crosses_splits FROM g""")
def exact_dup_groups(spark, sf):
    return duplicates.groups(t.files(spark, sf)).drop("first_path", "first_split")


@query("dup_groups_by_source", GROUPS.replace("lang AS class", "source AS class").replace("source, extension, split ||", "extension, split ||") + """SELECT sha256, group_size, n_classes, CASE WHEN n_classes > 1 THEN 'conflicting-class' ELSE 'same-class' END AS group_type FROM g""")
def dup_groups_by_source(spark, sf):
    """The source as the class, so that groups conflict."""
    return duplicates.groups(t.files(spark, sf).withColumn("class", F.col("source"))).select("sha256", "group_size", "n_classes", "group_type")


@query("dup_rows", GROUPS + "SELECT f.relative_path, f.split, f.class, g.sha256, g.group_size, g.n_splits > 1 AS crosses_splits FROM files f JOIN g USING (sha256) ORDER BY group_size DESC, sha256, relative_path")
def dup_rows(spark, sf):
    return duplicates.members(t.files(spark, sf)).select("relative_path", "split", "class", "sha256", "group_size", "crosses_splits").orderBy(F.desc("group_size"), "sha256", "relative_path")


@query("dup_rows_cross_split", GROUPS + "SELECT f.relative_path, f.split, g.sha256, g.group_size FROM files f JOIN g USING (sha256) WHERE g.n_splits > 1")
def dup_rows_cross_split(spark, sf):
    return duplicates.members(t.files(spark, sf), cross_split_only=True).select("relative_path", "split", "sha256", "group_size")


@query("dedup_keep_first", KEEP + "SELECT relative_path, class, sha256 FROM k WHERE r = 1")
def dedup_keep_first(spark, sf):
    return duplicates.keep_first(t.training(spark, sf)).select("relative_path", "class", "sha256")


@query("dedup_report", KEEP + "SELECT sha256, kept_path AS kept_relative_path, relative_path AS removed_relative_path, class AS label_name FROM k WHERE r > 1")
def dedup_report(spark, sf):
    return duplicates.report(t.training(spark, sf))


@query("dedup_summary", KEEP + "SELECT class, count(*) FILTER (r = 1) AS kept, count(*) FILTER (r > 1) AS removed, count(DISTINCT sha256) FILTER (r > 1) AS groups, count(DISTINCT sha256) FILTER (r > 1) + count(*) FILTER (r > 1) AS members FROM k GROUP BY class")
def dedup_summary(spark, sf):
    return duplicates.class_summary(t.training(spark, sf))


RANKED = GROUPS + ", n AS (SELECT *, row_number() OVER (ORDER BY first_path, sha256) AS group_id FROM g), marked AS (SELECT CAST(group_id AS INT) AS group_id, sha256, relative_path, class AS label_name, relative_path = first_path AS is_representative, group_size FROM files JOIN n USING (sha256)) "


@query("dup_groups_ranked", RANKED + "SELECT * FROM marked")
def dup_groups_ranked(spark, sf):
    return duplicates.ranked_groups(t.files(spark, sf))


@query("redundant_copies", RANKED + "SELECT relative_path FROM marked WHERE NOT is_representative")
def redundant_copies(spark, sf):
    return duplicates.redundant(duplicates.ranked_groups(t.files(spark, sf)))


@query("dedup_antijoin", RANKED + "SELECT relative_path, class FROM files WHERE relative_path NOT IN (SELECT relative_path FROM marked WHERE NOT is_representative)")
def dedup_antijoin(spark, sf):
    f = t.files(spark, sf)
    return duplicates.without(f, duplicates.redundant(duplicates.ranked_groups(f))).select("relative_path", "class")


@query("dup_crosscheck", KEEP + "SELECT (SELECT count(*) FROM k WHERE r > 1) AS removed, (SELECT count(*) - count(DISTINCT sha256) FROM files WHERE split = 'Training') AS audited, (SELECT count(*) FROM k WHERE r > 1) = (SELECT count(*) - count(DISTINCT sha256) FROM files WHERE split = 'Training') AS agrees")
def dup_crosscheck(spark, sf):
    tr = t.training(spark, sf)
    a = duplicates.report(tr).agg(F.count("*").alias("removed"))
    b = tr.agg((F.count("*") - F.countDistinct("sha256")).alias("audited"))
    return a.crossJoin(b).withColumn("agrees", F.col("removed") == F.col("audited"))


GRID = "grid AS (SELECT * FROM (VALUES ('Training'), ('Testing')) a(split), (VALUES ('en', 0), ('fr', 1), ('de', 2), ('es', 3)) b(class, ord)), "
CELLS = f"WITH {t.FILES}, {GRID} c AS (SELECT g.split, g.class, g.ord, count(f.doc_id) AS files, count(f.doc_id) FILTER (f.valid) AS valid_files FROM grid g LEFT JOIN files f USING (split, class) GROUP BY ALL) "


@query("class_counts", CELLS + "SELECT split, class, files, valid_files FROM c")
def class_counts(spark, sf):
    return counts.class_counts(t.files(spark, sf), t.SPLITS, t.CLASSES)


@query("class_distribution", CELLS + "SELECT split, class, files, round(files::DOUBLE / sum(files) OVER (PARTITION BY split) * 100, 2) AS pct_of_split, round(files::DOUBLE / sum(files) OVER () * 100, 2) AS pct_of_total FROM c")
def class_distribution(spark, sf):
    return counts.class_distribution(t.files(spark, sf), t.SPLITS, t.CLASSES)


@query("imbalance", CELLS + ", n AS (SELECT class, ord, sum(valid_files)::BIGINT AS n FROM c GROUP BY ALL) SELECT (SELECT class FROM n ORDER BY n DESC, ord LIMIT 1) AS largest_class, (SELECT class FROM n ORDER BY n, ord LIMIT 1) AS smallest_class, max(n) AS largest, min(n) AS smallest, round(max(n)::DOUBLE / nullif(min(n), 0), 3) AS ratio FROM n")
def imbalance(spark, sf):
    return counts.imbalance(t.files(spark, sf), t.CLASSES)


@query("dim_histogram", f"WITH {t.FILES} SELECT width, height, mode, extension, count(*) AS n FROM files GROUP BY ALL")
def dim_histogram(spark, sf):
    return counts.histogram(t.files(spark, sf), ["width", "height", "mode", "extension"])


@query("dim_stats", f"WITH {t.FILES} SELECT min(width) AS min_width, max(width) AS max_width, min(height) AS min_height, max(height) AS max_height, count(DISTINCT (width, height)) AS distinct_sizes FROM files WHERE valid")
def dim_stats(spark, sf):
    return counts.dimension_stats(t.files(spark, sf).filter("valid"))


@query("top_dimensions", f"WITH {t.FILES} SELECT width, height, count(*) AS n, round(count(*)::DOUBLE / (SELECT count(*) FROM files WHERE valid) * 100, 2) AS pct FROM files WHERE valid GROUP BY ALL ORDER BY n DESC, min(relative_path) LIMIT 10")
def top_dimensions(spark, sf):
    return counts.top_dimensions(t.files(spark, sf).filter("valid"), "relative_path")


@query("size_totals", f"WITH {t.FILES} SELECT count(*) AS files, sum(file_size_bytes)::BIGINT AS total_bytes, round(sum(file_size_bytes) / 1048576.0::DOUBLE, 2) AS total_mb FROM files")
def size_totals(spark, sf):
    return counts.size_totals(t.files(spark, sf))


@query("valid_invalid", f"WITH {t.FILES} SELECT split, count(*) FILTER (valid) AS valid_files, count(*) FILTER (NOT valid) AS invalid_files FROM files GROUP BY split")
def valid_invalid(spark, sf):
    return counts.validity(t.files(spark, sf))


@query("filter_extension", f"WITH {t.FILES} SELECT relative_path, extension FROM files WHERE extension <> '.txt'")
def filter_extension(spark, sf):
    from gleaner.functions.scalar import extension, is_image

    return t.files(spark, sf).filter(is_image(F.col("relative_path"))).select("relative_path", extension(F.col("relative_path")).alias("extension"))


@query("format_mismatch", f"WITH {t.FILES}, w AS (SELECT *, CASE extension WHEN '.jpg' THEN 'JPEG' WHEN '.jpeg' THEN 'JPEG' WHEN '.png' THEN 'PNG' WHEN '.bmp' THEN 'BMP' END AS expected_format FROM files) SELECT relative_path, extension, expected_format, format FROM w WHERE valid AND expected_format IS NOT NULL AND expected_format IS DISTINCT FROM format")
def format_mismatch(spark, sf):
    return counts.format_mismatch(t.files(spark, sf)).select("relative_path", "extension", "expected_format", "format")


@query("path_normalise", f"WITH {t.FILES} SELECT doc_id, relative_path AS path FROM files")
def path_normalise(spark, sf):
    from gleaner.functions.scalar import relative_to

    windows = F.concat(F.lit("C:\\work\\"), F.replace("relative_path", F.lit("/"), F.lit("\\")))
    return t.files(spark, sf).select("doc_id", relative_to(windows, "C:/work").alias("path"))


@query("path_reroot", f"WITH {t.FILES} SELECT doc_id, CASE WHEN valid THEN '/srv/data/' || relative_path ELSE 'elsewhere/' || relative_path END AS path FROM files")
def path_reroot(spark, sf):
    old = F.concat(F.when(F.col("valid"), "/home/u/data/").otherwise("elsewhere/"), "relative_path")
    return t.files(spark, sf).select("doc_id", reroot(old, "data", "/srv").alias("path"))


@query("label_lookup", f"WITH {t.FILES} SELECT doc_id, CAST(list_position(['en', 'fr', 'de', 'es'], class) - 1 AS INT) AS label_id, coalesce((['glioma', 'meningioma', 'notumor', 'pituitary'])[CAST(doc_id % 6 AS INT) + 1], CAST(doc_id % 6 AS VARCHAR)) AS display FROM files")
def label_lookup(spark, sf):
    return t.files(spark, sf).select("doc_id", label_id(F.col("class"), t.CLASSES).alias("label_id"), label_name((F.col("doc_id") % 6).cast("int"), t.NAMES).alias("display"))


@query("manifest_load", f"WITH {t.FILES} SELECT '/data/' || relative_path AS path, CAST(list_position(['en', 'fr', 'de', 'es'], class) - 1 AS INT) AS label_id FROM files WHERE file_size_bytes >= 200")
def manifest_load(spark, sf):
    """Padded and blank paths as a manifest has them; blank ones are skipped."""
    from gleaner.sources.manifests import load_manifest

    raw = t.files(spark, sf).select(F.when(F.col("file_size_bytes") < 200, "  ").otherwise(F.concat(F.lit(" "), "relative_path", F.lit(" "))).alias("relative_path"), label_id(F.col("class"), t.CLASSES).cast("string").alias("label_id"))
    return load_manifest(raw, "/data")


@query("manifest_counts", f"WITH {t.FILES} SELECT split, count(*) AS n_rows FROM files GROUP BY split")
def manifest_counts(spark, sf):
    return t.files(spark, sf).groupBy("split").agg(F.count("*").alias("n_rows"))


@query("split_distribution", f"WITH {t.FILES}, g(class) AS (VALUES ('en'), ('fr'), ('de'), ('es'), ('it')) SELECT g.class, count(f.doc_id) AS n FROM g LEFT JOIN files f ON f.class = g.class AND f.split = 'Testing' GROUP BY g.class")
def split_distribution(spark, sf):
    """A declared class without rows keeps its zero."""
    return counts.class_counts(t.files(spark, sf).filter("split = 'Testing'"), ["Testing"], [*t.CLASSES, "it"]).select("class", F.col("files").alias("n"))


@query("first_per_class", f"WITH {t.FILES} SELECT class, min(relative_path) AS relative_path, arg_min(sha256, relative_path) AS sha256 FROM files GROUP BY class")
def first_per_class(spark, sf):
    return counts.first_per_class(t.files(spark, sf))


@query("expected_vs_found", f"WITH {t.FILES}, w(name) AS (VALUES ('en'), ('fr'), ('it')) SELECT name, 'missing' AS status FROM w WHERE name NOT IN (SELECT class FROM files) UNION ALL SELECT DISTINCT class, 'unexpected' FROM files WHERE class NOT IN (SELECT name FROM w)")
def expected_vs_found(spark, sf):
    return counts.expected_vs_found(t.files(spark, sf), "class", ["en", "fr", "it"])


@query("audit_warnings", GROUPS + """, x AS (SELECT (SELECT count(*) FROM g WHERE n_splits > 1) AS cross_split_groups, (SELECT count(*) FROM g WHERE n_classes > 1) AS conflicting_groups,
 (SELECT count(*) FROM files WHERE NOT valid) AS unreadable_files, (SELECT count(*) FROM files WHERE extension = '.txt') AS non_image_files,
 (SELECT count(*) FROM files WHERE valid AND format IS DISTINCT FROM CASE extension WHEN '.jpg' THEN 'JPEG' WHEN '.jpeg' THEN 'JPEG' WHEN '.png' THEN 'PNG' WHEN '.bmp' THEN 'BMP' END AND extension <> '.txt') AS format_mismatches)
SELECT code, n FROM (UNPIVOT x ON cross_split_groups, conflicting_groups, unreadable_files, non_image_files, format_mismatches INTO NAME code VALUE n) WHERE n > 0""")
def audit_warnings(spark, sf):
    f = t.files(spark, sf)
    s = duplicates.summary(f).select(F.col("cross_groups").alias("cross_split_groups"), "conflicting_groups")
    want = expected_format(F.col("extension"))
    c = f.agg(F.count_if(~F.col("valid")).alias("unreadable_files"), F.count_if(want.isNull()).alias("non_image_files"), F.count_if(F.col("valid") & want.isNotNull() & ~want.eqNullSafe(F.col("format"))).alias("format_mismatches"))
    codes = ["cross_split_groups", "conflicting_groups", "unreadable_files", "non_image_files", "format_mismatches"]
    return s.crossJoin(c).unpivot([], codes, "code", "n").filter("n > 0")


SPLIT = KEEP + ", u AS (SELECT relative_path, class, sha256, row_number() OVER (PARTITION BY class ORDER BY md5('42|' || relative_path), relative_path) AS r, count(*) OVER (PARTITION BY class) AS n FROM k WHERE k.r = 1) "


@query("stratified_split", SPLIT + "SELECT relative_path, class, CASE WHEN r <= round_even(n * 0.2, 0) THEN 'validation' ELSE 'train' END AS processed_split FROM u")
def stratified_split(spark, sf):
    kept = duplicates.keep_first(t.training(spark, sf)).select("relative_path", "class", "sha256")
    return splits.stratified_split(kept, 0.2, 42).select("relative_path", "class", "processed_split")


@query("leakage_check", f"""WITH {t.FILES}, tr AS (SELECT DISTINCT sha256 FROM files WHERE split = 'Training' AND width < 160), va AS (SELECT DISTINCT sha256 FROM files WHERE split = 'Training' AND width >= 160),
te AS (SELECT DISTINCT sha256 FROM files WHERE split = 'Testing'), a AS (SELECT sha256 FROM tr INTERSECT SELECT sha256 FROM va), b AS ((SELECT sha256 FROM tr UNION SELECT sha256 FROM va) INTERSECT SELECT sha256 FROM te)
SELECT 'train/validation' AS "check", count(*) AS n_hashes, array_to_string(list_sort(list(sha256))[1:3], ', ') AS examples FROM a HAVING count(*) > 0
UNION ALL SELECT 'processed/testing', count(*), array_to_string(list_sort(list(sha256))[1:3], ', ') FROM b HAVING count(*) > 0""")
def leakage_check(spark, sf):
    f = t.files(spark, sf)
    tr = f.filter("split = 'Training'")
    return splits.leakage(tr.filter("width < 160"), tr.filter("width >= 160"), f.filter("split = 'Testing'"))


@query("batching", f"WITH {t.FILES} SELECT relative_path, CAST((row_number() OVER (ORDER BY relative_path) - 1) // 32 AS BIGINT) AS batch FROM files")
def batching(spark, sf):
    return splits.batches(t.files(spark, sf).select("relative_path"), ["relative_path"], 32)


@query("batch_summary", f"WITH {t.FILES}, b AS (SELECT *, CAST((row_number() OVER (ORDER BY relative_path) - 1) // 32 AS BIGINT) AS batch FROM files) SELECT batch, count(*) AS n, min(file_size_bytes) AS smallest, max(file_size_bytes) AS largest, array_to_string(list_sort(list(DISTINCT class)), ',') AS labels FROM b GROUP BY batch")
def batch_summary(spark, sf):
    b = splits.batches(t.files(spark, sf).select("relative_path", "class", "file_size_bytes"), ["relative_path"], 32)
    return b.groupBy("batch").agg(F.count("*").alias("n"), F.min("file_size_bytes").alias("smallest"), F.max("file_size_bytes").alias("largest"), F.array_join(F.array_sort(F.collect_set("class")), ",").alias("labels"))


@query("best_epoch", f"WITH {t.HISTORY} SELECT run, arg_min(epoch, (value, epoch)) AS best_epoch, min(value) AS best_value, max(epoch) AS epochs FROM history GROUP BY run")
def best_epoch(spark, sf):
    return history.best_epoch(t.history(spark, sf))


IMPROVED = f"WITH {t.HISTORY}, i AS (SELECT *, coalesce(value < min(value) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS improved FROM history)"


@query("checkpoint_epochs", IMPROVED + " SELECT run, epoch, value FROM i WHERE improved")
def checkpoint_epochs(spark, sf):
    return history.checkpoints(t.history(spark, sf))


@query("early_stop", IMPROVED + """, l AS (SELECT *, max(epoch) FILTER (improved) OVER (PARTITION BY run ORDER BY epoch) AS last FROM i), s AS (SELECT run, min(epoch) FILTER (epoch - last >= 5) AS stop_epoch FROM l GROUP BY run)
SELECT s.run, s.stop_epoch, arg_min(l.epoch, (l.value, l.epoch)) AS best_epoch FROM s JOIN l ON l.run = s.run AND (s.stop_epoch IS NULL OR l.epoch <= s.stop_epoch) GROUP BY s.run, s.stop_epoch""")
def early_stop(spark, sf):
    return history.early_stop(t.history(spark, sf))


@query("lr_plateau", f"""WITH RECURSIVE {t.HISTORY}, st AS (
 SELECT run, epoch, 0.001::DOUBLE AS learning_rate, CAST(value AS DOUBLE) AS best, 0 AS wait, 0.001::DOUBLE AS next_lr FROM history WHERE epoch = 1
 UNION ALL SELECT h.run, h.epoch, s.next_lr, CASE WHEN h.value < s.best - 1e-4::DOUBLE THEN h.value ELSE s.best END,
  CASE WHEN h.value < s.best - 1e-4::DOUBLE OR s.wait + 1 >= 2 THEN 0 ELSE s.wait + 1 END,
  CASE WHEN NOT h.value < s.best - 1e-4::DOUBLE AND s.wait + 1 >= 2 THEN greatest(s.next_lr * 0.5, 1e-6::DOUBLE) ELSE s.next_lr END
 FROM st s JOIN history h ON h.run = s.run AND h.epoch = s.epoch + 1)
SELECT run, epoch, learning_rate FROM st""")
def lr_plateau(spark, sf):
    return history.lr_plateau(t.history(spark, sf))


@query("final_metrics", f"WITH {t.HISTORY} SELECT run, arg_max(value, epoch) AS final_value, max(epoch) AS epochs FROM history GROUP BY run")
def final_metrics(spark, sf):
    return history.final_metrics(t.history(spark, sf))


@query("stage_selection", f"WITH {t.HISTORY}, b AS (SELECT run, stage, min(value) AS best FROM history GROUP BY ALL) SELECT run, arg_min(stage, (best, -stage)) AS selected_stage, min(best) AS best_value FROM b GROUP BY run")
def stage_selection(spark, sf):
    return history.stage_selection(t.history(spark, sf))


@query("fingerprint", f"WITH {t.FINGERPRINTS} SELECT id, fp FROM codes")
def fingerprint(spark, sf):
    return t.fingerprints(spark, sf).select("id", "fp")


def _pairs(spark, sf):
    return near.hamming_pairs(t.fingerprints(spark, sf), 20)


@query("hamming_pairs", f"WITH {t.FINGERPRINTS} SELECT i, j, distance FROM pairs")
def hamming_pairs(spark, sf):
    return _pairs(spark, sf)


@query("hamming_pairs_8", f"WITH {t.FINGERPRINTS} SELECT i, j, distance FROM pairs WHERE distance <= 8")
def hamming_pairs_8(spark, sf):
    return near.hamming_pairs(t.fingerprints(spark, sf), 8)


REACH = "edges AS (SELECT i AS a, j AS b FROM pairs UNION ALL SELECT j, i FROM pairs), reach AS (SELECT a AS node, a AS c FROM edges UNION SELECT e.b, r.c FROM reach r JOIN edges e ON e.a = r.node), comp AS (SELECT node, min(c) AS component FROM reach GROUP BY node)"


@query("near_dup_groups", f"WITH RECURSIVE {t.FINGERPRINTS}, {REACH} SELECT node, component, count(*) OVER (PARTITION BY component) AS component_size FROM comp")
def near_dup_groups(spark, sf):
    return near.classes(t.fingerprints(spark, sf), 20)


@query("near_dup_summary", f"""WITH RECURSIVE {t.FINGERPRINTS}, {REACH}, g AS (SELECT component, count(*) AS n, count(DISTINCT split) AS s, count(DISTINCT class) AS k FROM comp JOIN codes ON id = node GROUP BY component)
SELECT (SELECT count(*) FROM pairs) AS pairs, count(*) AS groups, coalesce(sum(n), 0)::BIGINT AS files, coalesce(max(n), 0) AS largest, count(*) FILTER (s > 1) AS cross_split_groups, count(*) FILTER (k > 1) AS conflicting_groups FROM g""")
def near_dup_summary(spark, sf):
    codes = t.fingerprints(spark, sf)
    return near.summary(codes, codes.select("id", "split", "class"), 20)


@query("pixel_stats", f"WITH {t.IMAGES} SELECT * FROM pixel")
def pixel_stats(spark, sf):
    return pixels.pixel_stats(t.images(spark, sf))


@query("plausibility_gate", f"""WITH {t.IMAGES} SELECT image_id, CASE WHEN (mean_saturation >= 0.3 AND p95_saturation >= 0.65 AND mean_spread >= 0.12) OR (colourful_fraction >= 0.35 AND mean_spread >= 0.12) THEN 'colour'
 WHEN intensity_std < 0.01 AND intensity_range < 0.02 THEN 'blank' ELSE 'pass' END AS verdict FROM pixel""")
def plausibility_gate(spark, sf):
    return pixels.plausibility(pixels.pixel_stats(t.images(spark, sf))).select("image_id", "verdict")


@query("content_hash", "SELECT doc_id, sha256(text) AS sha256 FROM documents")
def content_hash(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))


@query("label_coverage", "SELECT d.lang AS class, count(*) AS n, count(l.doc_id) AS labelled, count(*) - count(l.doc_id) AS unlabelled FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY d.lang")
def label_coverage(spark, sf):
    d, lab = table(spark, sf, "documents"), table(spark, sf, "labels").select("doc_id", F.lit(1).alias("has"))
    return d.join(lab, "doc_id", "left").groupBy(F.col("lang").alias("class")).agg(F.count("*").alias("n"), F.count("has").alias("labelled"), (F.count("*") - F.count("has")).alias("unlabelled"))


@query("audit_structure_anomalies", f"""WITH {t.FILES}, p AS (SELECT CASE source WHEN 'src1' THEN split || '/' || class || '/extra/' || doc_id WHEN 'src2' THEN split || '/' || doc_id WHEN 'src3' THEN CAST(doc_id AS VARCHAR) ELSE split || '/' || class || '/' || doc_id END AS rel FROM files),
q AS (SELECT rel, len(string_split(rel, '/')) AS depth, CASE WHEN len(string_split(rel, '/')) > 1 THEN split_part(rel, '/', 1) END AS split, CASE WHEN len(string_split(rel, '/')) > 2 THEN split_part(rel, '/', 2) END AS class FROM p),
s(split) AS (VALUES ('Training'), ('Testing'), ('Validation')), c(class) AS (VALUES ('en'), ('fr'), ('de'), ('it')), known AS (SELECT DISTINCT split FROM q JOIN s USING (split)),
have AS (SELECT DISTINCT split, class FROM q JOIN known USING (split) WHERE class IS NOT NULL), want AS (SELECT * FROM known, c)
SELECT 'missing_split' AS kind, split AS name, 1::BIGINT AS n FROM s WHERE split NOT IN (SELECT split FROM known)
UNION ALL SELECT 'missing_class', split || '/' || class, 1 FROM (FROM want EXCEPT FROM have) UNION ALL SELECT 'unexpected_class', split || '/' || class, 1 FROM (FROM have EXCEPT FROM want)
UNION ALL SELECT 'root_file', rel, 1 FROM q WHERE depth = 1 UNION ALL SELECT 'file_in_split', rel, 1 FROM q JOIN known USING (split) WHERE depth = 2
UNION ALL SELECT 'nested_directory', array_to_string(string_split(rel, '/')[1:3], '/'), count(*) FROM q JOIN known USING (split) WHERE depth > 3 GROUP BY 2""")
def audit_structure_anomalies(spark, sf):
    """Paths as a tree lists them; some sources are nested, loose or at the root."""
    from gleaner.sources.filetree import path_columns, structure_anomalies

    place = F.col("doc_id").cast("string")
    src = F.col("source")
    rel = F.when(src == "src1", F.concat_ws("/", "split", "class", F.lit("extra"), place)).when(src == "src2", F.concat_ws("/", "split", place)).when(src == "src3", place).otherwise(F.concat_ws("/", "split", "class", place))
    paths = path_columns(t.files(spark, sf).select(rel.alias("relative_path")))
    return structure_anomalies(paths, ["Training", "Testing", "Validation"], ["en", "fr", "de", "it"])


@query("history_rows", "SELECT user_id AS run, CAST(u AS INT) AS epoch, losses[u] AS val_loss, kinds[u] AS kind FROM (SELECT user_id, list(value ORDER BY ts, event_id) AS losses, list(event_type ORDER BY ts, event_id) AS kinds FROM events GROUP BY user_id), unnest(range(1, len(losses) + 1)) x(u)")
def history_rows(spark, sf):
    """Column lists by epoch, as a trainer keeps them, to one row an epoch."""
    ordered = F.array_sort(F.collect_list(F.struct("ts", "event_id", "value", "event_type")))
    lists = table(spark, sf, "events").groupBy(F.col("user_id").alias("run")).agg(ordered.alias("h")).select("run", F.col("h.value").alias("val_loss"), F.col("h.event_type").alias("kind"))
    return history.from_lists(lists, ["val_loss", "kind"])


@query("format_examples", f"WITH {t.FILES}, w AS (SELECT *, CASE extension WHEN '.jpg' THEN 'JPEG' WHEN '.jpeg' THEN 'JPEG' WHEN '.png' THEN 'PNG' WHEN '.bmp' THEN 'BMP' END AS expected_format FROM files) SELECT relative_path, extension, format FROM w WHERE valid AND expected_format IS NOT NULL AND expected_format IS DISTINCT FROM format ORDER BY relative_path LIMIT 20")
def format_examples(spark, sf):
    """The first 20 by path, as a report lists them."""
    from gleaner.plans.runs import listed

    return listed(counts.format_mismatch(t.files(spark, sf)), ["relative_path"], ["relative_path", "extension", "format"])


@query("warning_messages", GROUPS + """, x AS (SELECT (SELECT count(*) FROM g WHERE n_splits > 1) AS a, (SELECT coalesce(sum(training_files), 0)::BIGINT FROM g WHERE n_splits > 1) AS b, (SELECT coalesce(sum(testing_files), 0)::BIGINT FROM g WHERE n_splits > 1) AS c,
 (SELECT count(*) FROM g WHERE n_classes > 1) AS d, (SELECT count(*) FROM files WHERE NOT valid) AS e, (SELECT count(*) FROM files WHERE extension = '.txt') AS f,
 (SELECT count(*) FROM (SELECT *, CASE extension WHEN '.jpg' THEN 'JPEG' WHEN '.jpeg' THEN 'JPEG' WHEN '.png' THEN 'PNG' WHEN '.bmp' THEN 'BMP' END AS want FROM files) WHERE valid AND want IS NOT NULL AND want IS DISTINCT FROM format) AS h)
 SELECT message FROM (SELECT unnest([CASE WHEN a > 0 THEN a || ' exact-duplicate group(s) cross Training and Testing (' || b || ' Training + ' || c || ' Testing files) - potential leakage.' END,
  CASE WHEN d > 0 THEN d || ' duplicate group(s) contain conflicting class labels for identical content.' END, CASE WHEN e > 0 THEN e || ' corrupt/unreadable image file(s) found.' END,
  CASE WHEN f > 0 THEN f || ' non-image file(s) found inside class folders.' END, CASE WHEN h > 0 THEN h || ' image(s) whose real format does not match their extension.' END]) AS message FROM x) WHERE message IS NOT NULL""")
def warning_messages(spark, sf):
    from gleaner.plans import runs

    f = t.files(spark, sf)
    s = duplicates.summary(f).select(F.col("cross_groups").alias("groups_crossing_splits"), F.col("cross_training_files").alias("cross_split_files_training"), F.col("cross_testing_files").alias("cross_split_files_testing"), F.col("conflicting_groups").alias("conflicting_class_groups"))
    c = f.agg(F.count_if(~F.col("valid")).alias("invalid_images"), F.count_if(expected_format(F.col("extension")).isNull()).alias("non_image_files"))
    c = c.crossJoin(counts.format_mismatch(f).agg(F.count("*").alias("format_mismatches")))
    return runs.warning_messages(s.crossJoin(c))


@query("hex_codes", "SELECT doc_id, CAST(CASE WHEN h >= 9223372036854775808 THEN h - 18446744073709551616 ELSE h END AS BIGINT) AS code FROM (SELECT doc_id, ('0x' || substr(sha256(text), 1, 16))::UBIGINT::HUGEINT AS h FROM documents)")
def hex_codes(spark, sf):
    from gleaner.functions.scalar import hex_to_long

    return table(spark, sf, "documents").select("doc_id", hex_to_long(F.substring(F.sha2("text", 256), 1, 16)).alias("code"))


@query("utc_stamps", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS stamp FROM events")
def utc_stamps(spark, sf):
    from gleaner.functions.scalar import utc_text

    return table(spark, sf, "events").select("event_id", utc_text(F.col("ts")).alias("stamp"))


@query("split_run_counts", SPLIT + """, s AS (SELECT class, CASE WHEN r <= round_even(n * 0.2, 0) THEN 'validation' ELSE 'train' END AS part FROM u UNION ALL SELECT class, 'test' FROM files WHERE split = 'Testing')
SELECT part AS processed_split, class AS label_name, count(*) AS image_count, round(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY part) * 100, 2) AS percentage FROM s WHERE class IS NOT NULL GROUP BY part, class""")
def split_run_counts(spark, sf):
    """The distribution table of a whole split run; copies of training contents are no test files here, or the run would refuse them."""
    from gleaner.plans.runs import split_run

    f = t.files(spark, sf).withColumn("sha256", F.concat("split", "sha256"))
    return split_run(f, t.CLASSES)[0]["split_distribution"]


@query("audit_cube", f"""WITH {t.FILES}, x AS (SELECT *, CASE WHEN valid THEN relative_path END AS path, valid AND want IS NOT NULL AND want IS DISTINCT FROM format AS odd
  FROM (SELECT *, CASE extension WHEN '.jpg' THEN 'JPEG' WHEN '.jpeg' THEN 'JPEG' WHEN '.png' THEN 'PNG' WHEN '.bmp' THEN 'BMP' END AS want FROM files))
SELECT CASE GROUPING(split, class, extension, mode, width, height) WHEN 15 THEN 'class' WHEN 55 THEN 'extension' WHEN 59 THEN 'mode' WHEN 60 THEN 'size' ELSE 'all' END AS part, split, class, extension, mode, width, height,
  count(*) AS files, count(*) FILTER (valid) AS valid_files, count(*) FILTER (odd) AS mismatched_files, sum(file_size_bytes)::BIGINT AS bytes, min(path) AS first_path
FROM x GROUP BY GROUPING SETS ((split, class), (extension), (mode), (width, height), ())""")
def audit_cube(spark, sf):
    """All counts of an audit in one scan."""
    return counts.cube(t.files(spark, sf))


WRITTEN = f"""WITH {t.FILES}, parted AS (SELECT *, CASE WHEN doc_id % 10 < 7 THEN 'train' WHEN doc_id % 10 < 9 THEN 'validation' ELSE 'test' END AS part FROM files),
m AS (SELECT relative_path, CASE WHEN doc_id % 97 = 5 THEN 'old' || doc_id ELSE sha256 END AS sha256, part FROM parted UNION ALL SELECT relative_path, sha256, part FROM parted WHERE doc_id % 89 = 3)"""


@query("verify_manifests", WRITTEN + """, extra AS (SELECT relative_path, sha256, count(*) AS n FROM (SELECT relative_path, sha256 FROM m EXCEPT ALL SELECT relative_path, sha256 FROM files) GROUP BY ALL)
SELECT CASE WHEN f.relative_path IS NULL THEN 'stale' ELSE 'doubled' END AS problem, e.relative_path, e.n FROM extra e LEFT JOIN files f USING (relative_path, sha256)
UNION ALL SELECT 'leaking', min(relative_path), count(*) FROM m GROUP BY sha256 HAVING count(DISTINCT part) > 1""")
def verify_manifests(spark, sf):
    """Manifests of documents, some of whose rows are stale or doubled and whose parts share contents, against the documents."""
    from gleaner.plans.runs import verify_manifests as verify

    f = t.files(spark, sf)
    at = F.col("doc_id")
    part = F.when(at % 10 < 7, "train").when(at % 10 < 9, "validation").otherwise("test").alias("processed_split")
    written = f.select("relative_path", F.when(at % 97 == 5, F.concat(F.lit("old"), at)).otherwise(F.col("sha256")).alias("sha256"), part)
    return verify(written.unionByName(f.filter(at % 89 == 3).select("relative_path", "sha256", part)), f)
