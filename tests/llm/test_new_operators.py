"""Bit-sliced top-k, source divergence and ranked search on awkward rows, against plain Python."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.llm import bitslice, lexical, radix
from gleaner.llm.bitslice import top_k
from gleaner.llm.divergence import source_divergence
from gleaner.llm.lexical import LexicalIndex, ranked_search
from gleaner.workspace import Workspace
from tests.llm import brute

LETTERS = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_top(rows, k, scale=256.0):
    """rows: (id, vector): each query row's (id, rank, id, score), sorted."""
    vecs = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (q, v) in enumerate(vecs):
        if q is not None and q % 50 == 0:
            scores = [(-sum(a * b for a, b in zip(v, w)), c is None, c or 0, c) for other, (c, w) in enumerate(vecs) if other != at]
            out += [(q, r + 1, c, -s) for r, (s, _, _, c) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


def vectors():
    rng = random.Random(2)
    rows = [(i, [rng.uniform(-0.6, 0.6) for _ in range(12)]) for i in range(0, 130)]
    rows += [(i, rows[0][1]) for i in range(130, 170)]  # copies of a query's vector
    rows += [(50, rows[50][1]), (50, rows[3][1]), (200, rows[7][1][:5]), (201, rows[7][1][:5] + [0.0] * 4), (250, [0.0] * 12), (300, []), (None, rows[0][1]), (None, rows[9][1])]
    rows += [(350, None), (351, [1.0, None]), (400, [float("nan")] * 12), (401, [float("inf")]), (402, [900.25, -700.5, 3.0]), (450, [2.0, 5e3])]
    return rows


@pytest.mark.parametrize("block,slices,k", [(1 << 16, 6, 5), (16, 3, 5), (7, 1, 1), (64, 30, 40)])
def test_top_k(spark, monkeypatch, block, slices, k):
    monkeypatch.setattr(bitslice, "BLOCK", block)
    rows = vectors()
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, score int, no string").repartition(3)
    got = sorted(((r.query_id, r["rank"], r.vec_id, r.score) for r in top_k(df, F.col("vec_id") % 50 == 0, k, slices=slices).collect()), key=repr)
    assert got == plain_top(rows, k)


def test_top_k_in_waves_and_empty(spark, monkeypatch):
    monkeypatch.setattr(bitslice, "WAVE_BYTES", 200)
    rows = [(i, [math.sin(i * j) for j in range(1, 6)]) for i in range(301)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    exact = [(r.vec_id, list(r.embedding)) for r in df.collect()]
    got = sorted(((r.query_id, r["rank"], r.vec_id, r.score) for r in top_k(df, F.col("vec_id") % 50 == 0, 3).collect()), key=repr)
    assert got == plain_top(exact, 3)
    assert top_k(df.filter("false"), F.col("vec_id") % 50 == 0).count() == 0
    assert top_k(df.filter("vec_id = 50"), F.col("vec_id") % 50 == 0).count() == 0
    with pytest.raises(Exception, match="smaller scale"):
        top_k(df, F.col("vec_id") % 50 == 0, scale=1e12).count()


def test_bitmaps():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 50, (130, 9))
    weights = rng.integers(0, 9, 9)
    low, bits, slices = bitslice._planes(values)
    planes = slices.view(np.uint64).reshape(-1, 3)
    first = np.concatenate([[0], np.cumsum(bits)])
    stacks = [[] for _ in range(12)]
    for j in range(9):
        for i in range(bits[j]):
            for b in range(4):
                if weights[j] >> b & 1:
                    stacks[i + b].append(planes[first[j] + i])
    sums = bitslice.add_bitmaps([np.array(s, np.uint64).reshape(-1, 3) for s in stacks])
    want = ((values - low) * weights).sum(axis=1)
    got = sum(np.unpackbits(s.view(np.uint8), count=130, bitorder="little").astype(np.int64) << i for i, s in enumerate(sums))
    assert got.tolist() == want.tolist()
    every = np.array([2**64 - 1, 2**64 - 1, 3], np.uint64)
    for k in (1, 5, 130):
        t = bitslice.kth_largest(sums, every, k)
        assert t == sorted(want)[-k]
        assert np.bitwise_count(bitslice.at_least(sums, every, t)).sum() == (want >= t).sum()
    assert np.bitwise_count(bitslice.at_least(sums, every, 1 << 40)).sum() == 0


def plain_divergence(rows, min_docs=3, most=200):
    """rows: (text, lang, source)."""
    count, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        words = LETTERS.findall((text or "").translate(brute.FOLD))
        count[lang, source].update(words)
        docs[lang].update(set(words))
    out = []
    for lang, sources in groups.items():
        kept = sorted(t for t, n in docs[lang].items() if n >= min_docs)
        v = len(kept)

        def p_of(c, kept=kept, v=v):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 1) // (total + v) for t in kept}

        q = p_of(sum((count[lang, s] for s in sources), Counter()))
        p = {s: p_of(count[lang, s]) for s in sources}
        for s in sources:
            pairs = [(-sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o.encode(), o) for o in sources if o != s]
            terms = [(-((p[s][t] - q[t]) ** 2 // q[t]), t.encode(), t) for t in kept if count[lang, s][t] and p[s][t] > q[t]]
            out += [(lang, s, "pair", o, -f, r + 1) for r, (f, _, o) in enumerate(sorted(pairs))]
            out += [(lang, s, "term", t, -f, r + 1) for r, (f, _, t) in enumerate(sorted(terms)[:most])]
    return sorted(out)


def audited():
    rng = random.Random(8)
    rows = [(None, None, None), ("", "en", "empty"), ("12 34 !!", "en", "s1"), ("lone", "xx", "only"), (None, "xx", "other"), ("Ünter ÜNTER é́ \U0001f600x", "de", None)] + [("Ünter ä", "de", s) for s in "abcd"]
    for lang in ("en", "fr"):
        words = [f"{a}{b}" for a in "abcdefghij" for b in ("", "x", "yz", "é")]
        for s in range(9):
            mine = rng.sample(words, 15)
            rows += [(" ".join(rng.choice(mine if rng.random() < 0.7 else words).title() for _ in range(rng.randrange(1, 60))), lang, f"s{s}") for _ in range(6)]
    return rows + [(" ".join("tail" + chr(97 + i % 26) * 40 + str(i) for i in range(30_000)), "en", "s3")] + [("same tie words here", "en", f"s{s}") for s in range(9)] * 3


@pytest.mark.parametrize("side,small,most", [(256, 1024, 200), (2, 2, 6), (4, 1, 1)])
def test_divergence(spark, monkeypatch, side, small, most):
    monkeypatch.setattr(radix, "SMALL", small)
    rows = audited()
    df = spark.createDataFrame([(i % 40, *r, 1, "t") for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, n int, term string").repartition(5)
    got = sorted((r.lang, r.source, r.part, r["item"], r.value, r["rank"]) for r in source_divergence(df, 3, most, side=side, pairs_at_once=50).collect())
    assert got == plain_divergence(rows, 3, most)


def test_divergence_flushes_and_empty(spark):
    rows = audited()[:40]
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    assert sorted((r.lang, r.source, r.part, r["item"], r.value, r["rank"]) for r in source_divergence(df, flush=30).collect()) == plain_divergence(rows)
    assert source_divergence(df.filter("false")).count() == 0


def test_radix_ties(spark, monkeypatch):
    """Equal values told apart by bytes, by prefixes that end early, and repeated rows."""
    monkeypatch.setattr(radix, "SMALL", 1)
    rng = random.Random(4)
    rows = [(g, rng.choice([0, 7, 7, 7, 2**40, 2**62]), rng.choice(["", "a", "ab", "abc", "é", "zz", "\U0001f600"]) + rng.choice(["", "q", "qq"])) for g in ("x", "y") for _ in range(120)] + [("z", 5, "alone")]
    work = Workspace(spark, "t")
    df = work.stash(spark.createDataFrame(rows, "g string, v long, s string").repartition(4), "rows")
    for k in (1, 10, 60, 500):
        got = sorted((r.g, r["rank"], r.v, r.s) for r in radix.radix_top(df, ["g"], "v", "s", k, Workspace(spark, "t")).collect())
        want = []
        for g in "xyz":
            mine = sorted(((-v, s.encode(), s) for h, v, s in rows if h == g))[:k]
            want += [(g, i + 1, -v, s) for i, (v, _, s) in enumerate(mine)]
        assert got == sorted(want)


def plain_search(docs, items, k):
    tf = [Counter(ALNUM.findall((t or "").translate(brute.FOLD))) for _, t in docs]
    size = [sum(c.values()) for c in tf]
    n_docs, total = sum(n > 0 for n in size), sum(size)
    df = Counter(t for c in tf for t in c)
    w = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for t, n in df.items()}
    out = []
    for item, text in items:
        asked = Counter(ALNUM.findall((text or "").translate(brute.FOLD)))
        scores = []
        for (d, _), c, n in zip(docs, tf, size):
            m = 25 + (75 * n * n_docs) // total if total else 0
            s = sum(x * w[t] * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, x in asked.items() if t in c)
            if s > 0:
                scores.append((-s, d is None, d or 0, d))
        out += [(item, r + 1, d, -s) for r, (s, _, _, d) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


def searched():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(30)] + ["É", "a", "the"]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 80)))) for i in range(150)]
    docs += [(200 + i, docs[4][1]) for i in range(40)] + [(None, docs[4][1]), (7, docs[9][1].upper()), (300, None), (301, ""), (302, "-- !!"), (303, " ".join(rng.choice(words) for _ in range(60_000)))]
    items = [(i, " ".join(rng.choice(words) for _ in range(8))) for i in range(12)] + [(3, "w1 w1 w1 zzz"), (None, docs[4][1]), (20, None), (21, "nothing matches"), (22, ""), (23, "THE é")]
    return docs, items


def test_ranked_search(spark, monkeypatch):
    docs, items = searched()
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, tf int, place string").repartition(4)
    b = spark.createDataFrame([(i, t, 2) for i, t in items], "item_id long, text string, doc_id int").repartition(2)
    for size, wave, k in ((2 << 20, 20_000, 10), (500, 3, 3)):
        monkeypatch.setattr(lexical, "INDEX_BYTES", size)
        monkeypatch.setattr(lexical, "WAVE", wave)
        got = sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in ranked_search(d, b, k).collect()), key=repr)
        assert got == plain_search(docs, items, k)
    assert ranked_search(d.filter("false"), b).count() == 0
    assert ranked_search(d, b.filter("false")).count() == 0


def test_kept_index(spark, tmp_path):
    docs, items = searched()
    d = spark.createDataFrame(docs, "doc_id long, text string")
    LexicalIndex.build(d, path=str(tmp_path / "index"))
    index = LexicalIndex.open(spark, str(tmp_path / "index"))
    assert index.frequencies(["the", "zzz"]).get("zzz") is None and index.n_docs == 193
    b = spark.createDataFrame(items, "item_id long, text string")
    assert sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in index.search(b, 4).collect()), key=repr) == plain_search(docs, items, 4)


def test_bounds_and_norms():
    tf, m = np.meshgrid(np.arange(1, 200), np.array([25, 26, 100, 999, 10**6, 10**9]))
    g = lexical.gain(tf, m)
    byte = -(-g * 255 // lexical.MOST)
    assert byte.max() <= 255 and (lexical.UPPER[byte] >= g).all() and (lexical.LOWER_G[byte] <= g).all()
    n = np.array([0, 1, 7, 10**9])
    for docs, terms in ((1, 1), (10**11, 10**13), (3, 10)):
        assert lexical.length_norm(n, docs, terms).tolist() == [25 + 75 * int(x) * docs // terms for x in n]
