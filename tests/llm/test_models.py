"""Language model, ordinal regression, mixing, decontamination and the pipeline."""

import io
import random

import numpy as np
import pyarrow as pa
import pytest

from gleaner.llm import decontaminate, kneser_ney, media, mixing, toxicity, warc
from gleaner.llm.textkernel import chunks, rolling
from gleaner.workspace import Workspace

DOCS = "doc_id long, text string, lang string, source string, n_chars long, rate double"
LABELS = "doc_id long, quality int, toxic int, text string"


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(2)
    words = ["the", "of", "thing", "other", "water", "stone", "river", "under", "over", "again", "garden", "winter"]
    rows, labels = [], []
    for i in range(400):
        w = [rng.choice(words) for _ in range(rng.randrange(30, 90))]
        bad, toxic = i % 8 == 0, i % 5 == 0
        if toxic:
            w[rng.randrange(len(w))] = rng.choice(["moronic", "scummy"])
        text = " ".join(x + "***%%" if bad else x for x in w)
        rows.append((i, text, rng.choice(["en", "fr", None]), "s", len(text), 0.5))
        if i % 2 == 0 or bad:
            labels.append((i, int(not bad), int(toxic), "clash"))
    rows += [(1000, None, "en", "s", 0, 0.5), (1001, "", None, None, 0, 0.5), (1002, "the stone", "xx", "s", 9, 0.5), (1003, "stone " * 20_000, "en", "s", 1, 0.5), (1, rows[1][1], rows[1][2], "s", 1, 0.5)]
    labels += [(None, 1, 1, ""), (5, None, None, ""), (99_999, 1, 0, "")]
    return spark.createDataFrame(rows, DOCS).repartition(3), spark.createDataFrame(labels, LABELS), rows


def test_kneser_ney_is_a_distribution(spark, corpus):
    docs, _, _ = corpus
    model = kneser_ney.fit(docs.select("text"), Workspace(spark, "t"))
    p = 2.0 ** (-model.cost.astype(float) / kneser_ney.UNIT).reshape(-1, kneser_ney.SYMBOLS)
    assert np.abs(p.sum(axis=1) - 1).max() < 0.04
    assert kneser_ney.fit(docs.filter("false").select("text"), Workspace(spark, "t")) is None


def test_kneser_ney_counts_by_hand(spark):
    """The n-gram counts of the shards equal a plain count."""
    texts = ["abcabd", "ab\nab", None, "é!"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    import zlib
    from collections import Counter

    want = Counter()
    for t in texts:
        pad = kneser_ney.ORDER - 1
        s = [kneser_ney.LINE_END] * pad + [int(kneser_ney.CLASS[b]) for b in (t or "").encode()]
        for i in range(pad, len(s)):
            want[sum(s[i - j] << kneser_ney.BITS * j for j in range(kneser_ney.ORDER))] += 1
    got = Counter()
    for r in kneser_ney._count_shards(df).collect():
        dense = np.frombuffer(zlib.decompress(r.counts), np.int64)
        for c in np.flatnonzero(dense):
            got[r.shard * kneser_ney.SHARD + int(c)] = int(dense[c])
    assert got == want


def test_quality_keeps_clean_text(spark, corpus):
    docs, labels, rows = corpus
    out = {r.doc_id: r for r in kneser_ney.perplexities(docs, labels).collect()}
    assert all(out[i].keep == (i % 8 != 0) for i in range(400))
    assert all(out[i].keep for i in (1000, 1001, 1002)) and out[1000].perplexity is None
    kept = kneser_ney.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r[0] >= 400 or r[0] % 8 != 0 for r in rows)
    assert kneser_ney.perplexities(docs, labels.filter("false")).filter("not keep").count() == 0
    assert kneser_ney.perplexities(docs.filter("false"), labels).count() == 0


def test_toxicity(spark, corpus):
    docs, labels, rows = corpus
    out = toxicity.severities(docs, labels).collect()
    assert len(out) == len(rows)
    for r in out:
        if r.doc_id < 400:
            assert r.toxic == (r.doc_id % 5 == 0), r
            assert abs(r.severity - r.p_toxic) <= 1
    assert toxicity.severities(docs, labels.filter("false")).filter("toxic").count() == 0
    assert toxicity.severities(docs.filter("false"), labels).count() == 0


def test_ordinal_gradient():
    """The fit beats its neighbours: likelihood at the optimum of a small problem."""
    rng = np.random.RandomState(0)
    ids = [np.unique(rng.randint(0, 30, 6)) for _ in range(300)]
    grade = np.array([min(2, int(3 in x) + int(7 in x)) for x in ids])
    m = toxicity.fit_ordinal(ids, grade, 3, l1=1e-4, steps=2000)
    assert m.weight[3] > 2 and m.weight[7] > 2 and (np.diff(m.theta) > 0).all()
    score = np.array([m.weight[x].sum() for x in ids])
    assert ((m.exceed(score) > 0.5).sum(axis=1) == grade).mean() > 0.98


def test_mixing(spark, corpus):
    docs, labels, rows = corpus
    targets = {"clean": 0.8, "junk": 0.15, "toxic": 0.05}
    out = mixing.mixture(docs.filter("doc_id <> 1003"), mixing.label_domains(labels), targets, tolerance=1e-4).collect()
    n, p, r = (np.array([x[c] for x in out]) for c in ("n_tokens", "p", "rate"))
    assert len(out) == len(rows) - 1 and (r >= 0).all() and np.abs(p.sum(axis=1) - 1).max() < 1e-9
    assert np.abs((n * r) @ p / n.sum() - list(targets.values())).max() < 1e-3
    assert max(x.residual for x in out) <= 1e-4
    # the least squares' own conditions: no gradient along a positive rate, none that would raise a rate of 0
    unreachable = mixing.mixture(docs.filter("doc_id % 5 <> 0 and doc_id < 400"), mixing.label_domains(labels), {"clean": 0.5, "toxic": 0.5}).collect()
    n, p, r = (np.array([x[c] for x in unreachable]) for c in ("n_tokens", "p", "rate"))
    left = (n * r) @ p / n.sum() - 0.5
    assert abs(unreachable[0].residual - np.abs(left).max()) < 1e-6 and unreachable[0].residual > 0.1
    slope = p @ (left / (n @ p / n.sum()))
    assert (slope > -5e-3).all() and np.abs(slope[r > 1e-3]).max() < 5e-3
    for bad in ({"clean": 0, "toxic": 0}, {"clean": -1, "toxic": 2}):
        with pytest.raises(ValueError):
            mixing.mixture(docs, mixing.label_domains(labels), bad)
    mixed = mixing.mix_documents(docs, mixing.label_domains(labels), targets)
    assert mixed.columns == ["doc_id", "text", "lang", "source", "n_chars", "rate", "copies"] and mixed.filter("copies < 1").count() == 0
    assert mixing.mixture(docs.filter("false"), mixing.label_domains(labels), targets).count() == 0
    even = mixing.mixture(docs, mixing.label_domains(labels).filter("false"), targets).first()
    assert max(even.p) - min(even.p) < 1e-9


def test_block_max_wand_equals_scoring_everything():
    rng = np.random.RandomState(1)
    vocabulary = rng.randint(1, 2**62, 300).astype(np.uint64)
    items = [vocabulary[rng.zipf(1.3, 25) % 300] for _ in range(120)]
    for threshold in (0.05, 0.2, 0.5, 0.9):
        index = decontaminate.Index(items, threshold)
        dense = np.zeros((len(index.terms), len(items)))
        for t, p in enumerate(index.postings):
            dense[t, p.items] = p.impacts
        for _ in range(60):
            terms = np.unique(index.lookup(vocabulary[rng.zipf(1.3, 60) % 300]))
            terms = terms[terms >= 0]
            score = dense[terms].sum(axis=0)
            want = {int(i): score[i] for i in np.flatnonzero(score >= threshold - 1e-9)}
            got = dict(index.search(terms.tolist()))
            assert set(got) == set(want) and all(abs(got[i] - want[i]) < 1e-9 for i in got)
            assert not want or index.hopeful(terms)
            assert not want or index.essential[terms].sum() >= threshold - index.slack - 1e-9


def test_leaks(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(3000)]
    make = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, make(30)) for i in range(50)] + [(100, None), (101, ""), (102, "tiny item here"), (103, make(300)), (104, "one")]
    by = dict(items)
    docs = [(0, None), (1, ""), (2, make(200)), (3, make(63) + " " + by[7] + " " + make(90)), (4, by[9].upper().replace(" ", ", ") + "***"), (5, "x tiny item here y"), (6, make(40) + " " + by[103] + " z"), (8, "there is ONE, here"), (None, by[11]), (None, "nothing of them"), (7, " ".join(by[3].split()[:12]))]
    df = spark.createDataFrame([(*d, 1.0) for d in docs], "doc_id long, text string, score double")
    bench = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, q string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(df, bench).collect()}
    assert got == {(3, 7), (4, 9), (5, 102), (6, 103), (8, 104), (None, 11)}
    kept = [(r.doc_id, r.text) for r in decontaminate.drop_leaking(df, bench).collect()]
    assert sorted(kept, key=repr) == sorted([d for d in docs if d[0] in (0, 1, 2, 7) or d[1] == "nothing of them"], key=repr)
    assert decontaminate.leaks(df, bench.union(bench)).count() == len(got)
    assert decontaminate.leaks(df.filter("false"), bench).count() == 0 and decontaminate.leaks(df, bench.filter("false")).count() == 0
    decontaminate.GROUP, held = 7, decontaminate.GROUP
    try:
        assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(df, bench).collect()} == got
    finally:
        decontaminate.GROUP = held


def test_images():
    gray = np.arange(12, dtype=np.uint8).reshape(3, 4)
    colour = np.arange(36, dtype=np.uint8).reshape(3, 4, 3)
    assert (media.decode_image(media.encode_pgm(gray)) == gray).all()
    assert (media.decode_image(b"P6 # note\n4 3\n255\n" + colour.tobytes()) == colour).all()
    assert (media.decode_image(b"P2\n4 3 255\n" + " ".join(map(str, gray.ravel())).encode()) == gray).all()
    assert media.decode_image(b"P1\n2 2\n10\n01").tolist() == [[0, 255], [255, 0]]
    assert media.decode_image(b"P4\n2 2\n\x80\x40").tolist() == [[0, 255], [255, 0]]
    assert media.decode_image(b"P5\n1 1\n65535\n\xff\xff").tolist() == [[255]]
    rows = b"".join(r[:, ::-1].tobytes() for r in colour[::-1])
    head = b"BM" + (54 + len(rows)).to_bytes(4, "little") + bytes(4) + (54).to_bytes(4, "little") + (40).to_bytes(4, "little") + (4).to_bytes(4, "little") + (3).to_bytes(4, "little") + (1).to_bytes(2, "little") + (24).to_bytes(2, "little") + bytes(24)
    assert (media.decode_image(head + rows) == colour).all()
    for bad in (b"", b"P5\n4 3\n255\nxx", b"P9", b"P5\n0 3\n255\n", head):
        with pytest.raises(media.MediaError):
            media.decode_image(bad)
    big = np.random.RandomState(0).randint(0, 255, (50, 37)).astype(np.uint8)
    want = np.array([[np.mean(np.repeat(np.repeat(big, 8, 0), 9, 1)[i * 50 : i * 50 + 50, j * 37 : j * 37 + 37]) for j in range(9)] for i in range(8)])
    assert np.abs(media.area_resize(big, 8, 9, block=7) - want).max() < 1e-9
    assert np.load(io.BytesIO(media.npy_tile(gray))).tolist() == gray.tolist()


def test_damaged_archives():
    w = warc.ArchiveWriter(b"")
    w.add(warc.build_record(3, "http://x/", b"payload" * 50, None))
    whole = w.close()
    assert [f["warc-type"] for f, _ in warc.read_archive(whole)] == ["warcinfo", "response"]
    for bad in (whole[:-1], whole[:-20], whole[:60] + b"\xff\xff\xff" + whole[63:]):
        with pytest.raises(warc.WarcError):
            list(warc.read_archive(bad))
    for page in (0, 1, -1, 2**62, -(2**63)):
        assert warc.page_of_urn(warc.record_urn(page)) == page


def test_word_hashes():
    rng = random.Random(3)
    texts = [None, "", "  ", "a", "é ü", "b a  b\ta\n", *(" ".join(rng.choice(["aa", "b", "ß"]) for _ in range(rng.randrange(50))) for _ in range(40))]
    seen = {}
    for limit in (1, 64, 1 << 20):
        for c in chunks(pa.array(texts), limit=limit):
            h = c.word_hash()
            for r in range(c.rows):
                words = (texts[c.first + r] or "").split()
                own = h[c.word_at[r] : c.word_at[r + 1]]
                assert len(own) == len(words)
                for w, x in zip(words, own.tolist()):
                    assert seen.setdefault(w, x) == x
                for k in (2, 5):
                    for i, x in enumerate(rolling(own, k).tolist()):
                        assert seen.setdefault(tuple(words[i : i + k]), x) == x
    assert len(set(seen.values())) == len(seen)


def test_rows_without_an_id(spark, corpus):
    """A NULL doc_id loses no row and harms no other."""
    from gleaner.llm.jaccard_join import jaccard_classes
    from gleaner.llm.line_dedup import dedup_lines, line_report
    from gleaner.llm.substring_dedup import substring_dedup

    docs, labels, rows = corpus
    more = docs.filter("doc_id < 60").unionByName(docs.limit(0)).unionByName(spark.createDataFrame([(None, "the stone over the river", None, None, None, None)] * 2, DOCS))
    n = more.count()
    targets = {"clean": 0.9, "junk": 0.05, "toxic": 0.05}
    for out in (line_report(more), dedup_lines(more), jaccard_classes(more), substring_dedup(more), media.text_media(more), kneser_ney.perplexities(more, labels), toxicity.severities(more, labels), mixing.mixture(more, mixing.label_domains(labels), targets)):
        assert out.count() == n and out.filter("doc_id is null").count() == 2
    assert mixing.mix_documents(more, mixing.label_domains(labels), targets).filter("doc_id is null").count() == 2
    bench = spark.createDataFrame([(1, "the stone over the river")], "item_id long, text string")
    assert decontaminate.leaks(more, bench).filter("doc_id is null").count() == 2


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    work = Workspace(spark, "p")
    for name, stage in corpus_pipeline.STAGES:
        before, columns = docs.count(), docs.columns
        docs = work.stash(stage(spark, docs, sf), name)
        assert 0 < docs.count() <= before
        if name != "mixing":
            assert docs.columns == columns
