"""Severities, posteriors with rates, and rows of leaks against plain versions that call nothing under test."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from gleaner.llm import decontaminate, mixing, toxicity
from gleaner.workspace import scope, shared_root
from tests.llm import brute
from tests.llm.test_pipeline_rows import bare, runs

L1 = 5e-3


def features(text):
    words = [w.encode() for w in bare(text)]
    return {("word", w) for w in words} | {("head", n, w[:n]) for w in words for n in (4, 6) if len(w) > n}


def domain_features(text):
    """Whole words with their marks, their heads and their last two bytes; equal bytes are one feature."""
    words = [w.encode() for w in brute.WORD.findall((text or "").translate(brute.FOLD))]
    return set(words) | {w[:n] for w in words for n in (4, 6) if len(w) > n} | {w[-2:] for w in words if len(w) > 1}


def design(texts, columns, features=features):
    x = np.zeros((len(texts), len(columns)))
    for i, t in enumerate(texts):
        for f in features(t):
            if f in columns:
                x[i, columns[f]] = 1
    return x


def chosen(texts, groups, features=features):
    """Features of at least four labelled documents that are not spread evenly over every group."""
    seen = Counter(f for t in texts for f in features(t))
    out = []
    for f, n in seen.items():
        hit = [sum(f in features(t) for t, g in zip(texts, own) if g) for own in groups]
        if n >= 4 and any(abs(h - n * np.mean(own)) > 1e-12 for h, own in zip(hit, groups) if 0 < np.mean(own) < 1):
            out.append(f)
    return {f: i for i, f in enumerate(sorted(out))}


def lasso(gradient, w, b, step, steps=30_000):
    """Proximal gradient: an L1 penalty on ``w``, none on ``b``."""
    for _ in range(steps):
        gw, gb = gradient(w, b)
        w = w - step * gw
        w, b = np.sign(w) * np.maximum(np.abs(w) - step * L1, 0), b - step * gb
    return w, b


@pytest.fixture(scope="module")
def graded():
    rng = random.Random(12)
    plain = ["river", "stone", "water", "winter", "garden", "other", "under", "again", "over", "things"]
    rude, vile = ["scum", "moron", "idiot"], ["moronically", "filthiest"]
    rows, labels = [], []
    for i in range(90):
        grade = i % 3
        w = [rng.choice(plain) for _ in range(rng.randrange(6, 20))]
        for _ in range(grade):
            w[rng.randrange(len(w))] = rng.choice(rude if rng.random() < 0.8 else plain)
        if grade == 2 and rng.random() < 0.8:
            w[rng.randrange(len(w))] = rng.choice(vile)
        if rng.random() < 0.1:
            w[0] = rng.choice(rude + vile)
        rows.append((i, " ".join(w).capitalize() + "!"))
        if i < 75:
            labels.append((i, int(grade != 2), int(grade > 0)))
    return rows + [(200, None), (201, "nothing known here"), (202, "scum " * 9_000)], labels


def test_severities_are_those_of_the_plain_fit(spark, graded):
    rows, labels = graded
    texts, by = [t for i, t in rows if i < 75], {i: (2 if not q else 1) if t else 0 for i, q, t in labels}
    grade = np.array([by[i] for i, _ in rows if i < 75])
    columns = chosen(texts, [grade > 0])
    x, n = design(texts, columns), len(texts)

    def gradient(w, theta):
        s = x @ w
        edge = np.concatenate([[-40.0], theta, [40.0]])
        up, down = (1 / (1 + np.exp(-(edge[grade + k] - s))) for k in (1, 0))
        p = up - down
        du, dd = up * (1 - up) / p, down * (1 - down) / p
        return x.T @ (du - dd) / n, np.array([(-du[grade == k].sum() + dd[grade == k + 1].sum()) / n for k in range(2)])

    w, theta = lasso(gradient, np.zeros(len(columns)), np.array([-0.5, 0.5]), 0.4 / np.linalg.eigvalsh(x.T @ x / n)[-1])
    over = 1 / (1 + np.exp(theta[None, :] - (design([t for _, t in rows], columns) @ w)[:, None]))
    got = {r.doc_id: r for r in toxicity.severities(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), steps=12_000, l1=L1).collect()}
    assert 0.2 < np.std(over.sum(axis=1)) and len(got) == len(rows)
    for (i, _), o in zip(rows, over):
        r = got[i]
        assert abs(r.severity - o.sum()) < 0.02 and abs(r.p_toxic - o[0]) < 0.02, (i, r, o)
        exact = [1 - o[0], o[0] - o[1], o[1]]
        assert r.grade == int(np.argmax(exact)) or sorted(exact)[-1] - sorted(exact)[-2] < 0.04
        assert r.toxic == (o[0] >= 0.4) or abs(o[0] - 0.4) < 0.02


def test_rates_meet_targets_under_plain_posteriors(spark, graded):
    rows, labels = graded
    names = ["clean", "junk", "toxic"]
    rows = [(i, t) if i % 9 else (i, (t or "") + " ### %%% ###") for i, t in rows]
    domain = {i: "toxic" if t else "junk" if not i % 9 else "clean" for i, _, t in labels}
    texts, at = [t for i, t in rows if i < 75], np.array([names.index(domain[i]) for i, _ in rows if i < 75])
    columns = chosen(texts, [at == k for k in range(3)], domain_features)
    x, n, one = design(texts, columns, domain_features), len(texts), np.eye(3)[at]

    def gradient(w, b):
        e = np.exp(x @ w + b)
        g = e / e.sum(axis=1, keepdims=True) - one
        return x.T @ g / n, g.mean(axis=0)

    w, b = lasso(gradient, np.zeros((len(columns), 3)), np.zeros(3), 1.0 / np.linalg.eigvalsh(x.T @ x / n)[-1])
    every = design([t for _, t in rows], columns, domain_features) @ w + b
    p = np.exp(every - every.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marked = spark.createDataFrame([(i, d) for i, d in domain.items()], "doc_id long, domain string")
    targets = {"clean": 0.6, "junk": 0.1, "toxic": 0.3}
    got = {r.doc_id: r for r in mixing.mixture(docs, marked, targets, steps=12_000, l1=L1, tolerance=1e-4).collect()}
    size = np.array([len(brute.WORD.findall(t or "")) for _, t in rows])
    assert [got[i].n_tokens for i, _ in rows] == size.tolist()  # the one of 9000 words among them
    fitted = np.array([i < 75 for i, _ in rows])  # elsewhere columns that are equal on the fitted texts may be weighted either way
    theirs = np.array([got[i].p for i, _ in rows])
    assert np.abs(theirs - p)[fitted].max() < 0.02
    p[~fitted] = theirs[~fitted]
    rate = np.array([got[i].rate for i, _ in rows])
    assert (rate >= 0).all() and np.abs((size * rate) @ p / size.sum() - list(targets.values())).max() < 0.02


def plain_leaks(docs, items, threshold=0.5, overlap=0.6, least=8):
    """(doc, item, score, question overlap, answer overlap) of items of up to 64 words, each a whole piece."""
    known = sorted({(i, t or "") for i, t in items if i is not None})
    words = [bare(t) for _, t in known]
    terms = [Counter(runs(x, 2)) if len(x) > 1 else Counter() for x in words]
    df = Counter(t for x in terms for t in x)
    held = [len(x) - 1 for x in words if len(x) > 1]
    mean = sum(held) / len(held)
    impact = [{t: math.log1p((len(held) - df[t] + 0.5) / (df[t] + 0.5)) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * (len(x) - 1) / mean)) for t, n in tf.items()} for x, tf in zip(words, terms)]
    share = lambda part, seen: sum(g in seen for g in runs(part, 3)) / len(runs(part, 3)) if len(part) > 2 else None
    out = {}
    for at, (d, text) in enumerate(docs):
        w = bare(text)
        for (item, _), x, weights in zip(known, words, impact):
            best = None
            if len(x) == 1:
                best = (1.0, 1.0, 1.0) if x[0] in w else None
            elif x:
                for first in range(0, max(1, len(w) - 64), 64):
                    window = w[first : first + 128]
                    score = sum(v for t, v in weights.items() if t in set(runs(window, 2))) / sum(weights.values())
                    if score < threshold:
                        continue
                    cut = len(x) - len(x) // 4
                    if len(x) < least:
                        fits = (1.0, 1.0) if tuple(x) in runs(window, len(x)) else None
                    else:
                        seen = set(runs(window, 3))
                        q, a = share(x[:cut], seen), share(x[cut:], seen)
                        fits = (q, a) if q >= overlap and (a is None or a >= overlap) or share(x, seen) >= overlap else None
                    if fits:
                        best = max(best or (-1,), (score, *fits), key=lambda v: v[0])
            if best:
                out[at, d, item] = min(out.get((at, d, item), best), best)
    return out


def test_rows_of_leaks(spark):
    rng = random.Random(21)
    vocabulary = [f"word{i}" for i in range(400)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.randrange(12, 60))) for i in range(25)] + [(30, "short item of words"), (31, "single"), (32, None), (33, ""), (None, text(20)), (5, text(30)), (40, text(14)), (40, text(14))]
    docs = []
    for i in range(60):
        w = text(rng.randrange(20, 300)).split(" ")
        if i % 2:
            own = (items[rng.randrange(25)][1]).split(" ")
            for _ in range(rng.randrange(4)):
                own[rng.randrange(len(own))] = "changed"
            place = rng.randrange(len(w))
            w[place:place] = own if i % 4 == 1 else own[: len(own) * 2 // 3]
        docs.append((i, " ".join(w).upper() if i % 5 == 0 else " ".join(w)))
    docs += [(100, "A short item, of words"), (101, "(single)"), (102, text(20_000) + " " + items[3][1] + " " + text(30)), (103, None), (104, ""), (7, items[8][1]), (None, items[9][1]), (105, items[25 + 5][1] + ". " + items[31][1])]
    want = plain_leaks(docs, items)
    df = spark.createDataFrame([(d, t, 1.0) for d, t in docs], "doc_id long, text string, score double").repartition(3)
    got = decontaminate.leaks(df, spark.createDataFrame(items, "item_id long, text string")).collect()
    told = {(d, i) for _, d, i in want}
    assert {(r.doc_id, r.item_id) for r in got} == told and {(102, 3), (100, 30), (101, 31), (None, 9), (7, 8), (105, 5), (105, 40)} <= told and len(told) > 20
    for r in got:
        near = [v for (_, d, i), v in want.items() if (d, i) == (r.doc_id, r.item_id)]
        assert any(abs(r.score - s) < 1e-9 and abs(r.question_overlap - q) < 1e-9 for s, q, _ in near) or (r.doc_id, r.item_id) in {(105, 5), (105, 40)}, (r, near)


def test_operators_leave_nothing_in_a_scope(spark, tmp_path):
    """Once a query's rows are read, its tables are gone from the shared folder and the catalog."""
    import os

    from gleaner.llm import queries

    top = shared_root(spark).removeprefix("file:") + "/gleaner"
    os.makedirs(top, exist_ok=True)
    before = set(os.listdir(top))
    for name in sorted(queries.QUERIES):
        with scope():
            queries.QUERIES[name](spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()
        assert set(os.listdir(top)) == before, name
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("gleaner_run")]
