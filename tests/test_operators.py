"""Operators on small literal tables; expectations follow from the stated rules."""

import pytest
from pyspark.sql import functions as F

from gleaner import dims
from gleaner.functions import scalar
from gleaner.operators import counts, duplicates, history, metrics, near, pixels, predictions, ranking, splits
from gleaner.operators.graph import connected_components
from gleaner.operators.skew import join_counted

FILES = "relative_path string, split string, class string, sha256 string, valid boolean"
ROWS = [
    ("Training/glioma/a.png", "Training", "glioma", "aaa", True), ("Testing/glioma/a.png", "Testing", "glioma", "aaa", True),
    ("Training/meningioma/b.png", "Training", "meningioma", "bbb", True), ("Training/glioma/b2.png", "Training", "glioma", "bbb", True),
    ("Training/notumor/unique.png", "Training", "notumor", "ccc", True), ("Training/notumor/bad.png", "Training", "notumor", "ddd", False)]
NAMES = ["glioma", "meningioma", "notumor", "pituitary"]


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame(ROWS, FILES)


def test_duplicate_groups(files):
    g = {r.sha256: r for r in duplicates.groups(files).collect()}
    assert set(g) == {"aaa", "bbb"} and g["aaa"].group_type == "same-class" and g["bbb"].group_type == "conflicting-class"
    s = duplicates.summary(files).first()
    assert (s.duplicate_groups, s.duplicate_files, s.cross_groups, s.cross_training_files, s.cross_testing_files, s.conflicting_groups, s.conflicting_files, s.within_training) == (2, 4, 1, 1, 1, 1, 2, 1)
    assert s.duplicate_ratio == 0.8
    none = duplicates.summary(files.filter("false")).first()
    assert none.duplicate_groups == 0 and none.duplicate_ratio == 0


def test_keeper_is_the_smallest_path(files):
    assert {(r.kept_relative_path, r.removed_relative_path) for r in duplicates.report(files).collect()} == {("Testing/glioma/a.png", "Training/glioma/a.png"), ("Training/glioma/b2.png", "Training/meningioma/b.png")}
    ranked = duplicates.ranked_groups(files)
    assert {(r.group_id, r.sha256) for r in ranked.collect()} == {(1, "aaa"), (2, "bbb")}
    gone = duplicates.redundant(ranked)
    assert duplicates.without(files, gone).count() == 4
    flags = files.sparkSession.createDataFrame([("a\\b", " False "), ("c", "0"), ("d", "maybe"), ("e", "True")], "relative_path string, is_representative string")
    assert sorted(r[0] for r in duplicates.redundant(flags).collect()) == ["a/b", "c"]


def test_counts(files):
    c = {(r.split, r["class"]): r.files for r in counts.class_counts(files, ["Training", "Testing"], NAMES).collect()}
    assert len(c) == 8 and c["Testing", "pituitary"] == 0 and c["Training", "glioma"] == 2
    i = counts.imbalance(files, NAMES).first()
    assert (i.largest_class, i.smallest_class, i.ratio) == ("glioma", "pituitary", None)
    assert {(r.name, r.status) for r in counts.expected_vs_found(files, "class", ["glioma", "other"]).collect()} == {("other", "missing"), ("meningioma", "unexpected"), ("notumor", "unexpected")}


def test_split_is_exact_and_independent_of_partitions(spark):
    rows = spark.range(1007).select(F.format_string("p%05d", "id").alias("relative_path"), F.when(F.col("id") % 10 < 7, "big").otherwise("small").alias("class"))
    first = None
    for n in (1, 3, 11):
        got = {(r.relative_path, r.processed_split) for r in splits.stratified_split(rows.repartition(n), 0.2, 42).collect()}
        assert first is None or got == first
        first = got
    n = rows.groupBy("class").count().collect()
    assert sum(s == "validation" for _, s in first) == sum(round(r["count"] * 0.2) for r in n)


def test_leakage(spark):
    t = lambda x: spark.createDataFrame([(x,)], "sha256 string")
    assert splits.leakage(t("a"), t("b"), t("c")).count() == 0
    assert splits.leakage(t("a"), t("a"), t("c")).first().check == "train/validation"
    assert splits.leakage(t("a"), t("b"), t("a")).first().check == "processed/testing"


def test_global_rank(spark):
    df = spark.range(500).select((F.col("id") * 37 % 500).alias("x"))
    assert all(r.x == r["rank"] for r in ranking.global_rank(df, ["x"]).collect())
    assert ranking.global_rank(df.filter("false"), ["x"]).count() == 0


def pairs(spark, t, p):
    return spark.createDataFrame(list(zip(t, p, strict=True)), "y_true int, y_pred int")


def test_metrics(spark):
    cm = metrics.confusion(pairs(spark, [0, 0, 1, 1, 2, 2, 3, 3], [0, 1, 1, 1, 2, 0, 3, 3]), 4)
    o = metrics.overall(cm).first()
    assert o.accuracy == 0.75 and o.macro_f1 == pytest.approx(0.741667, abs=1e-6)
    assert [r.f1 for r in metrics.per_class(cm).orderBy("class_id").collect()] == pytest.approx([0.5, 0.8, 2 / 3, 1.0])
    one = metrics.overall(metrics.confusion(pairs(spark, [0, 1, 2, 3], [0, 0, 0, 0]), 4)).first()
    assert one.macro_precision == 0.0625
    same = metrics.overall(metrics.confusion(pairs(spark, [0] * 5, [0] * 5), 4)).first()
    assert (same.accuracy, same.macro_f1) == (1.0, 0.25)
    assert metrics.normalised(metrics.confusion(pairs(spark, [0], [0]), 4)).filter("true_id = 3 and share <> 0").count() == 0
    assert metrics.report(cm, NAMES).count() == 7


@pytest.mark.parametrize("rows,winner,tie", [
    ([("A", 0, 0.88, 0.90), ("B", 1, 0.82, 0.85)], "A", False), ([("A", 0, 0.88, 0.90), ("B", 1, 0.88, 0.85)], "A", True),
    ([("A", 0, 0.88, 0.85), ("B", 1, 0.88, 0.90)], "B", True), ([("A", 0, 0.5, 0.5), ("B", 1, 0.5, 0.5)], "A", True), ([("A", 0, 0.88001, 0.1), ("B", 1, 0.88004, 0.2)], "B", True)])
def test_winner(spark, rows, winner, tie):
    r = metrics.select_winner(spark.createDataFrame(rows, "model string, ordinal int, macro_f1 double, accuracy double")).first()
    assert (r.selected_model, r.is_tie) == (winner, tie)


def test_examples(spark):
    rows = [("data/b_glioma.jpg", 0, [0.99, 0.0, 0.01, 0.0]), ("data/a_glioma.jpg", 0, [0.6, 0.2, 0.1, 0.1]), ("data/m.jpg", 1, [0.1, 0.7, 0.1, 0.1]), ("data/b_err.jpg", 2, [0.9, 0.1, 0.0, 0.0]), ("data/a_err.jpg", 3, [0.9, 0.1, 0.0, 0.0])]
    table = predictions.predictions_table(spark.createDataFrame(rows, "filepath string, y_true int, prob array<double>"), NAMES)
    got = {r.example: r.filepath for r in predictions.select_examples(table, NAMES, 1).collect()}
    assert got == {"correct_glioma": "data/a_glioma.jpg", "correct_meningioma": "data/m.jpg", "misclassified_01": "data/a_err.jpg"}


def test_history(spark):
    v = [5.0, 6.0, 6.0, 4.0, 4.0, 4.5, 4.6, 4.7, 4.8, 1.0]
    h = spark.createDataFrame([(1, i + 1, x) for i, x in enumerate(v)], "run long, epoch long, value double")
    assert history.best_epoch(h).first().best_epoch == 10
    assert [r.epoch for r in history.checkpoints(h).orderBy("epoch").collect()] == [1, 4, 10]
    e = history.early_stop(h, 5).first()
    assert (e.stop_epoch, e.best_epoch) == (9, 4)
    assert [r.learning_rate for r in history.lr_plateau(h).orderBy("epoch").collect()] == [1e-3] * 3 + [5e-4] * 3 + [2.5e-4] * 2 + [1.25e-4] * 2
    st = h.withColumn("stage", F.when(F.col("epoch") <= 5, 1).otherwise(2))
    assert history.stage_selection(st).first().selected_stage == 2


def test_near_duplicates(spark):
    codes = spark.createDataFrame([(0, 0), (1, 1), (2, 3), (3, -1)], "id long, fp long")
    p = near.hamming_pairs(codes, 2)
    assert {(r.i, r.j) for r in p.collect()} == {(0, 1), (0, 2), (1, 2)}
    assert {(r.node, r.component, r.component_size) for r in near.classes(codes, 2).collect()} == {(0, 0, 3), (1, 0, 3), (2, 0, 3)}
    import random

    rng = random.Random(1)
    c = [rng.getrandbits(64) for _ in range(60)]
    c += [x ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for x in c]
    sign = lambda x: x - 2**64 if x >> 63 else x
    df = spark.createDataFrame([(i, sign(x)) for i, x in enumerate(c)], "id long, fp long")
    for t in (0, 3, 8, 20):
        assert {(r.i, r.j) for r in near.hamming_pairs(df, t).collect()} == {(i, j) for i in range(len(c)) for j in range(i + 1, len(c)) if (c[i] ^ c[j]).bit_count() <= t}


def test_components_of_a_long_chain(spark):
    chain = spark.range(300).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    got = connected_components(chain).collect()
    assert len(got) == 301 and {r.component for r in got} == {0}
    assert connected_components(chain.filter("false")).count() == 0


def test_join_counted(spark):
    left = spark.range(3000).select("id", F.when(F.col("id") < 1000, 0).when(F.col("id") < 2990, F.col("id")).alias("k"))
    counted = left.filter("k is not null").groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("top"))
    got = join_counted(left, counted, ["k"], "n", F.col("id"), "left")
    assert got.count() == 3000 and got.filter("k = 0 and top = 999 and n = 1000").count() == 1000 and got.filter("top is null").count() == 10
    assert join_counted(left, counted, ["k"], "n", F.col("id")).count() == 2990


def gate(spark, pixel):
    r, g, b = ([float(p[i]) for p in pixel] for i in range(3))
    df = spark.createDataFrame([(1, r, g, b)], "image_id int, r array<double>, g array<double>, b array<double>")
    return pixels.plausibility(pixels.pixel_stats(df)).first()


def test_plausibility(spark):
    ramp = [i / 100 for i in range(4, 96)]
    assert gate(spark, [(x, x, x) for x in ramp]).verdict == "pass"
    assert gate(spark, [(1, 0, 0)] * 50).verdict == "colour"
    assert gate(spark, [(1, 0, 0), (0, 1, 0), (0, 0, 1), (1, 1, 0)] * 9).colourful_fraction == 1
    assert gate(spark, [(x + 0.016, x, x - 0.012) for x in ramp]).verdict == "pass"
    assert gate(spark, [(0, 0, 0)] * 9).verdict == gate(spark, [(1, 1, 1)] * 9).verdict == "blank"


def test_scalars(spark):
    p = [[0.8, 0.1, 0.05, 0.05], [0.25] * 4, [0.5, 0.5], [float("nan"), 0.0, 0.0, 1.0], [float("inf"), 0.0, 0.0, 0.0], [1.5, -0.2, 0.1, 0.1], None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(p)], "i int, p array<double>")
    assert [r[0] for r in df.orderBy("i").select(scalar.valid_probabilities(F.col("p"), 4)).collect()] == [True, True] + [False] * 5
    assert [r[0] for r in df.orderBy("i").limit(2).select(scalar.argmax(F.col("p"))).collect()] == [0, 0]
    one = spark.createDataFrame([("C:\\w\\data\\X.JPG",)], "p string")
    r = one.select(scalar.extension(F.col("p")), scalar.is_image(F.col("p")), scalar.relative_to(F.col("p"), "C:/w"), scalar.reroot(F.col("p"), "data", "/s"), scalar.reroot(F.lit("q/r"), "data", "/s")).first()
    assert tuple(r) == (".jpg", True, "data/X.JPG", "/s/data/X.JPG", "q/r")
    s = spark.range(1).select(dims.label_name(F.lit(9), NAMES), dims.label_name(F.lit(1), NAMES), dims.label_id(F.lit("notumor"), NAMES), scalar.sha_matches(F.lit("a"), F.lit(" ")), scalar.max_normalise(F.array(F.lit(1.0), F.lit(4.0))), scalar.max_normalise(F.array(F.lit(0.0)))).first()
    assert tuple(s) == ("9", "meningioma", 2, True, [0.25, 1.0], [0.0])


def test_hamming_plans(spark, monkeypatch):
    """Every plan gives the brute-force pairs; its expected candidates stay below all pairs."""
    import random

    from gleaner.operators import near

    rng = random.Random(7)
    base = [rng.getrandbits(64) for _ in range(40)]
    codes = [c ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(10))) for c in base * 5] + base[:3]
    signed = [c - (1 << 64) if c >> 63 else c for c in codes]
    df = spark.createDataFrame([*enumerate(signed), (999, None)], "id long, fp long")
    for t in (0, 8, 20):
        want = {(i, j, (codes[i] ^ codes[j]).bit_count()) for i in range(len(codes)) for j in range(i + 1, len(codes)) if (codes[i] ^ codes[j]).bit_count() <= t}
        for m in {0, t + 1, max(1, t // 2)} if t != 20 else {0, 11}:
            bands = [near.Band(tuple(range(i * 64 // m, (i + 1) * 64 // m)), 0, t // m) for i in range(m)]
            monkeypatch.setattr(near, "plan", lambda n, threshold, agree, bands=bands: (bands, 0.0, 0.0))
            monkeypatch.setattr(near, "BLOCK", 60)
            assert {(r.i, r.j, r.distance) for r in near.hamming_pairs(df, t).collect()} == want, (t, m)
        monkeypatch.undo()
        for n in (2000, 10**6, 10**9):
            bands, _, candidates = near.plan(n, t)
            print(t, n, len(bands), candidates)
            assert candidates <= n * n / 2 and (t == 20 or n < 10**6 or candidates < n * n / 1000)
        rows = df.select("id", F.lit("Training").alias("split"), F.lit("x").alias("class"))
        s = near.summary(df, rows, t).first()
        found = near.classes(df, t).collect()
        assert s["pairs"] == len(want) and s.files == len({x for p in want for x in p[:2]}) == len(found)
        assert s.groups == len({r.component for r in found})


def test_duplicates_without_hash_and_listed_twice(spark):
    rows = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "x"), ("c", None), ("d", None), ("e", "y")], "relative_path string, sha256 string")
    rows = rows.withColumns({"split": F.lit("Training"), "class": F.lit("k"), "valid": F.lit(True)})
    assert sorted(r.relative_path for r in duplicates.keep_first(rows).collect()) == ["a", "c", "d", "e"]
    assert sorted((r.kept_relative_path, r.removed_relative_path) for r in duplicates.report(rows).collect()) == [("a", "a"), ("a", "b")]
    assert [(r.sha256, r.group_size) for r in duplicates.groups(rows).collect()] == [("x", 3)]
    assert duplicates.members(rows).count() == 3


def test_keepers_take_any_columns_and_no_window(spark):
    """Map columns can't be ordered; a copy listed many times is removed one time less."""
    rows = spark.createDataFrame([("b", "x", {"k": 1}), ("a", "x", {"k": 2}), ("c", None, {"k": 3}), ("c", None, {"k": 3})] + [("d", "y", {})] * 25_001, "relative_path string, sha256 string, extra map<string,int>").withColumns({"class": F.lit("k"), "_own": F.lit(1)})
    kept = duplicates.keep_first(rows)
    assert kept.columns == rows.columns and sorted((r.relative_path, r.extra.get("k")) for r in kept.collect()) == [("a", 2), ("c", 3), ("c", 3), ("d", None)]
    gone = duplicates.report(rows)
    assert gone.count() == 25_001 and gone.filter("removed_relative_path = 'd'").count() == 25_000
    assert [tuple(r) for r in duplicates.class_summary(rows).select("kept", "removed", "groups", "members").collect()] == [(4, 25_001, 2, 25_003)]
    for df in (kept, gone):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan
    assert rows.sparkSession.createDataFrame([], rows.schema).transform(duplicates.keep_first)._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_hamming_join_stays_below_all_pairs(spark, capsys):
    """Rows sent and joined at threshold 8: expected by the plan and counted, for 10**5 and 10**6 codes."""
    import numpy as np

    rng = np.random.default_rng(6)
    for n in (10**5, 10**6):
        found, sent, joined = near.plan(n, 8)
        codes = rng.integers(-(2**63), 2**63, n, dtype=np.int64)
        rows = meets = 0
        for b in found:
            sides = []
            for radius in (b.left, b.right):
                flips = np.array([near._signed(sum(1 << i for i in c)) for k in range(radius + 1) for c in __import__("itertools").combinations(b.bits, k)], np.int64)
                own = codes & np.int64(near._signed(b.mask))
                packed = sum(((own >> i) & 1) << at for at, i in enumerate(b.bits))
                low = sum(((flips >> i) & 1) << at for at, i in enumerate(b.bits))
                counts = np.zeros(1 << len(b.bits), np.int64)
                for f in low.tolist():
                    counts += np.bincount(packed ^ f, minlength=len(counts))
                sides.append(counts)
                rows += n * len(flips)
            meets += int((sides[0] * sides[1]).sum())
        with capsys.disabled():
            print(f"\n{n} codes, {len(found)} bands: {rows:.3g} rows sent, {meets:.3g} joined, {meets / (n * (n - 1) / 2):.2g} of all pairs")
        assert rows == sent and abs(meets - n * sum(near.probes(len(b.bits), min(b.left, b.right)) for b in found) - joined) < 0.5 * joined
        assert rows + meets < n * n / 2 / 50
    skewed = [0.5] * 40 + [0.999] * 24  # half of the bits hardly tell: no band may be left with only such bits
    assert all(sum(i < 40 for i in b.bits) >= 10 for b in near.plan(10**5, 8, skewed)[0])
    assert [sum(b.radius + 1 for b in near.plan(10**5, t)[0]) for t in (0, 1, 3, 8)] == [1, 2, 4, 9]


def test_hamming_join_by_every_plan(spark, monkeypatch):
    """Bands probed from one side, from both, by one or two bits, on codes with dead bits and clusters."""
    import random

    rng = random.Random(3)
    base = [rng.getrandbits(50) << 3 for _ in range(25)]
    codes = {c ^ sum(1 << rng.randrange(64) for _ in range(0)) for c in base}
    for c in base:
        for _ in range(8):
            x = c
            for _ in range(rng.randrange(1, 7)):
                x ^= 1 << rng.randrange(64)
            codes.add(x)
    codes = sorted(codes)
    sign = lambda x: x - 2**64 if x >> 63 else x
    df = spark.createDataFrame([(i, sign(x)) for i, x in enumerate(codes)], "id long, fp long")
    want = {t: {(i, j) for i in range(len(codes)) for j in range(i + 1, len(codes)) if (codes[i] ^ codes[j]).bit_count() <= t} for t in (1, 4, 8)}
    seen = set()
    for t, n in ((1, 10), (4, 10**4), (4, 10**6), (8, 10**4), (8, 10**6), (8, 10**8)):
        real = near.plan
        monkeypatch.setattr(near, "plan", lambda _, threshold, agree, n=n, real=real: real(n, threshold, agree))
        seen |= {(b.left, b.right) for b in real(n, t)[0]}
        pairs = [(r.i, r.j) for r in near.hamming_pairs(df, t).collect()]
        assert len(pairs) == len(set(pairs)) and set(pairs) == want[t], (t, n)
        monkeypatch.setattr(near, "plan", real)
    assert len(seen) > 3 and max(a for a, _ in seen) == 2
