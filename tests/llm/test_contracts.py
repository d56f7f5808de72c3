"""Each operator on awkward rows, against plain Python; and the registered queries against their SQL."""

import base64
import hashlib
import os
import random
import zlib

import pytest

from gleaner.llm import queries
from gleaner.llm.jaccard_join import jaccard_classes
from gleaner.llm.line_dedup import dedup_lines, line_report
from gleaner.llm.media import text_media
from gleaner.llm.substring_dedup import substring_dedup
from gleaner.llm.url_filter import filter_urls
from gleaner.llm.warc import archive_pages, read_pages
from tests.llm import brute
from tests.oracle import same

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
DOCS = "doc_id long, text string, lang string, rate double, copies int, _drop string, key string"


def awkward():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)] + ["é", "Ünter", "!!", "a"]
    base = [" ".join(rng.choice(words) for _ in range(90)) for _ in range(4)]
    texts = [None, "", " ", "\n\n", "one", "two words", "a b c d", "A  b\tc d", "x " * 60, "A line that is long enough\nshort\nA line that is long enough"]
    texts += base * 3 + [b.upper() for b in base[:2]]
    for b in base:
        for _ in range(4):
            w = b.split()
            w[rng.randrange(len(w))] = "changed"
            texts.append(" ".join(w))
            texts.append(" ".join(w[: rng.randrange(20, 80)]) + "\n  a LINE that is long enough \n" + " ".join(rng.choice(words) for _ in range(40)))
    texts.append(" ".join(rng.choice(words) for _ in range(60_000)))
    texts += ["\n".join(["the same long line in one document"] * 5)] * 2
    return list(enumerate(texts))


@pytest.fixture(scope="module")
def docs(spark):
    rows = awkward()
    return rows, spark.createDataFrame([(d, t, "en", 1.0, 1, "x", "k") for d, t in rows], DOCS).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_line_dedup(docs):
    rows, df = docs
    want = brute.line_dedup(rows)
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in line_report(df).collect()}
    assert got == {d: (n, m, brute.sha(t)) for d, (n, m, t) in want.items()}
    out = dedup_lines(df)
    assert out.columns == df.columns
    assert {r.doc_id: r.text or "" for r in out.collect()} == {d: t for d, (_, _, t) in want.items()}


def test_jaccard(docs):
    rows, df = docs
    for n, percent in ((4, 85), (5, 80), (1, 100), (2, 50)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_classes(df, n, percent).collect()}
        assert got == brute.jaccard(rows, n, percent)


def test_substring(docs):
    rows, df = docs
    for window in (20, 5, 3):
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup(df, window).collect()}
        assert got == brute.substring_dedup(rows, window)


def test_media(docs):
    rows, df = docs
    texts = dict(rows)
    seen = {}
    for r in text_media(df).collect():
        raw = (texts[r.doc_id] or "").encode()
        pay = raw.ljust(max(1, -(-len(raw) // 64)) * 64, b"\0")
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-64:]))
        pgm = b"P5\n64 %d\n255\n" % (len(pay) // 64) + pay
        assert (r.media_bytes, r.media_sha256) == (len(pgm), hashlib.sha256(pgm).hexdigest())
        assert seen.setdefault(raw, r.feature) == r.feature


def test_warc(spark):
    html = [None, "", "same", "same", "same", "é" * 5000, "x" * 300_000, "other"]
    rows = [(i - 2, f"http://h/{i}" if i else None, h) for i, h in enumerate(html)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, keeper int")
    payload = {p: (h or "").encode() for p, _, h in rows}
    keeper = {v: max(p for p in payload if payload[p] == v) for v in payload.values()}
    for least in (0, 3):
        got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in read_pages(archive_pages(pages, least)).collect()}
        for p, v in payload.items():
            again = len(v) >= least and keeper[v] != p
            assert got[p] == (len(v), base64.b32encode(hashlib.sha1(v).digest()).decode(), "revisit" if again else "response", keeper[v] if again else None)
        assert len(got) == len(rows)


def test_urls(spark):
    urls = [None, "", "no scheme", "http://", "http://Example.NET", "http://example.net/en/x?y#z", "http://a.b.example.net/en/", "http://notexample.net/en/", "https://example.com/de/1", "https://x.example.com/de", "http://a.org/fr/9#q", "http://a.org/en/", "ftp://net/", "http://example.net?/en/"] * 3
    pages = spark.createDataFrame([(i, u, "r") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    rules = [*queries.URL_RULES, ("example.net", "/en/x", "block"), ("a.b.example.net", "/", "block")]
    got = {r.page_id: r for r in filter_urls(pages, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        rest = (u or "").split("://", 1)[1] if "://" in (u or "") else ""
        rest = rest.split("?")[0].split("#")[0]
        host, path = rest.split("/")[0].translate(brute.FOLD), rest[len(rest.split("/")[0]) :]
        fits = [x for x in rules if (host == x[0] or host.endswith("." + x[0])) and path.startswith(x[1])]
        best = max(fits, key=lambda x: (len(x[0] + x[1]), len(x[0])), default=None)
        r = got[i]
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, best and best[0] + best[1], best[2] if best else "allow")


def test_empty_tables(spark, empty):
    assert line_report(empty).count() == 0
    assert jaccard_classes(empty).count() == 0
    assert substring_dedup(empty).count() == 0
    assert text_media(empty).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert read_pages(archive_pages(pages)).count() == 0
    assert filter_urls(pages, spark.createDataFrame(queries.URL_RULES, "host string, path string, verdict string")).count() == 0
    one = spark.createDataFrame([(1, "http://a.net/", "")], "page_id long, url string, html string")
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert filter_urls(one, none).first().verdict == "allow"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    same(spark, SF, queries.QUERIES[name], queries.ORACLES[name])


def test_jaccard_in_blocks(spark, monkeypatch):
    """Small vocabularies and clusters larger than a block, by the hub and by single postings."""
    from gleaner.llm import jaccard_join

    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice("abcdef") for _ in range(rng.randrange(8, 30)))) for i in range(150)]
    base = [f"v{rng.randrange(900)}" for _ in range(80)]
    for i in range(150, 220):
        w = list(base)
        for _ in range(rng.randrange(4)):
            w[rng.randrange(80)] = f"x{rng.randrange(50)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for block in (6, 40):
        monkeypatch.setattr(jaccard_join, "BLOCK", block)
        for n, percent in ((1, 60), (4, 85)):
            assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_classes(df, n, percent).collect()} == brute.jaccard(rows, n, percent)


def test_jaccard_repeated_and_null_ids(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(3, a), (5, a), (5, b), (7, b), (None, a), (None, None), (1, c), (1, c), (1, a + " z")]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect()), key=repr)
    assert got == sorted([(3, 27, 1), (5, 27, 1), (5, 27, 5), (7, 27, 5), (None, 27, None), (None, 0, None), (1, 27, 1), (1, 27, 1), (1, 28, 1)], key=repr)


def test_trie_against_all_pairs():
    from collections import Counter

    import numpy as np

    from gleaner.llm.jaccard_join import global_paths, linked, trie_links

    rng = np.random.RandomState(4)
    for percent in (50, 80):
        sets = [np.unique(rng.randint(0, 25, rng.randint(3, 12))).astype(np.uint64) for _ in range(60)]
        often = Counter(x for s in sets for x in s.tolist())
        level = lambda x: min(often[x] // 8, 3)
        sets = [np.array(sorted(s.tolist(), key=lambda x: (-level(x), x)), np.uint64) for s in sets]
        paths = global_paths(sets, [np.array([level(x) for x in s.tolist()], np.int8) for s in sets])
        assert all((np.diff(p) > 0).all() for p in paths)
        half = np.arange(60) < 30
        found = trie_links(paths, [len(s) for s in sets], half, ~half, np.ones(60, bool), percent)
        parent = list(range(60))

        def find(x, parent=parent):
            return x if parent[x] == x else find(parent[x])

        want = [(i, j) for i in range(30) for j in range(30, 60) if linked(len(set(paths[i]) & set(paths[j])), len(paths[i]), len(paths[j]), percent)]
        assert set(found) <= set(want)
        for i, j in found:
            assert find(i) != find(j)
            parent[find(i)] = find(j)
        assert all(find(i) == find(j) for i, j in want)


def test_lines_of_repeated_and_null_ids(spark):
    """Each row by its own lines; rows without doc_id neither hold nor lose lines."""
    line = "a line that three documents share"
    rows = [(1, line + "\nuniq a"), (1, "keep me first line that is unique\nother"), (2, line), (3, "x\n " + line.upper() + "\t"), (None, line), (0, "only two hold this line of text"), (None, "only two hold this line of text"), (4, "only two hold this line of text\n")]
    got = sorted((r.text for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == sorted([rows[3][1], rows[1][1], "uniq a", "", line, rows[5][1], rows[6][1], rows[7][1]])
    report = line_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_lines, r.n_dropped) for r in report if r.doc_id is not None) == [(0, 1, 0), (1, 2, 0), (1, 2, 1), (2, 1, 1), (3, 2, 0), (4, 2, 0)]


def test_line_batches(spark, docs):
    """Any number of batches and any fanout give the same; a key's keeper is decided where it was fresh."""
    from pyspark.sql import functions as F

    from gleaner.llm.line_dedup import LineRuns
    from gleaner.workspace import Workspace

    rows, df = docs
    want = {d: (n, m, brute.sha(t)) for d, (n, m, t) in brute.line_dedup(rows).items()}
    for batches, fanout in ((1, 2), (7, 2), (5, 9)):
        assert {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in line_report(df, batches=batches, fanout=fanout).collect()} == want
    store = LineRuns(Workspace(spark, "t"), fanout=2)
    lines = spark.createDataFrame([(d, k, k, True) for d, k in [(9, 1), (8, 1), (6, 1), (6, 2), (2, 2), (2, 1), (1, 3)]], "doc_id long, k1 long, k2 long, first boolean")
    for low, high in ((8, 9), (6, 6), (1, 2)):
        store.add(lines.filter(F.col("doc_id").between(low, high)))
    assert sorted((r.k1, r.docs, r.keeper) for r in store.close(1).collect()) == [(1, 4, 9), (2, 2, 6), (3, 1, 1)]
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("gleaner_run")]


def test_lines_of_a_chunk():
    import numpy as np
    import pyarrow as pa

    from gleaner.llm.line_dedup import long_lines
    from gleaner.llm.textkernel import chunks

    texts = ["", "abc\n\n abc \nab", "\n", "é\n", "x", "abc\nABC", "\n\nabc"]
    for limit in (1, 10, 1 << 20):
        got = []
        for c in chunks(pa.array(texts), lower=True, limit=limit):
            row, line, k1, _, first = long_lines(c, 1)
            got += list(zip((row + c.first).tolist(), line.tolist(), first.tolist()))
        assert got == [(1, 0, True), (1, 2, False), (1, 3, True), (3, 0, True), (4, 0, True), (5, 0, True), (5, 1, False), (6, 2, True)]
    assert np.all([len(long_lines(c, 3)[0]) == 5 for c in chunks(pa.array(texts), lower=True)])


def test_odd_urls(spark):
    """Commas, NUL and the largest characters in hosts, NULL page_ids, a very long url."""
    urls = ["http://example,foo.net/en/x", "http://a,net/", "http://net\x00/", "http://x.net\x00.net/en/", "http://\U0010ffff.example.net/en/", "http://example.net./en/", "http://.net/", "http:///en/", "http://org/fr/" + "é" * 200_000, "http://" + "a." * 5000 + "example.com/de/"]
    pages = spark.createDataFrame([(i if i % 3 else None, u) for i, u in enumerate(urls)] * 2, "page_id long, url string").repartition(3)
    rules = [*queries.URL_RULES, ("net\x00", "/", "allow"), ("\U0010ffff.example.net", "/en/", "block"), ("example,foo.net", "/zz", "allow")]
    got = sorted((repr((r.page_id, r.host, r.path, r.rule, r.verdict)) for r in filter_urls(pages, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()))
    want = []
    for i, u in enumerate(urls):
        rest = u.split("://", 1)[1]
        host, path = rest.split("/")[0].translate(brute.FOLD), rest[len(rest.split("/")[0]) :]
        fits = [x for x in rules if (host == x[0] or host.endswith("." + x[0])) and path.startswith(x[1])]
        best = max(fits, key=lambda x: (len(x[0] + x[1]), len(x[0])), default=None)
        want += [repr((i if i % 3 else None, host, path, best and best[0] + best[1], best[2] if best else "allow"))] * 2
    assert got == sorted(want)


def test_warc_null_ids_and_urls(spark):
    rows = [(None, " http://edge/ ", "same"), (7, "http://x/", "same"), (3, None, "same"), (None, "a", "only nulls"), (None, "b", "only nulls"), (None, "c", "lone"), (-5, "d", None)]
    out = read_pages(archive_pages(spark.createDataFrame(rows, "page_id long, url string, html string"))).collect()
    got = sorted(((r.page_id, r.url, r.record_type, r.refers_to) for r in out), key=repr)
    assert got == sorted([(None, " http://edge/ ", "revisit", 7), (7, "http://x/", "response", None), (3, "", "revisit", 7), (None, "a", "response", None), (None, "b", "response", None), (None, "c", "response", None), (-5, "d", "response", None)], key=repr)


def test_substring_of_shuffled_and_repeated_rows(spark, docs):
    rows, df = docs
    want = brute.substring_dedup(rows)
    shuffled = df.repartition(7, "text").orderBy("rate", "text")
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup(shuffled).collect()} == want
    text = " ".join(f"w{i}" for i in range(25))
    same_id = spark.createDataFrame([(1, text), (1, text), (1, "x " + text), (None, text)], "doc_id long, text string").repartition(2)
    assert sorted(r.n_removed for r in substring_dedup(same_id).collect()) == [0, 25, 25, 25]
