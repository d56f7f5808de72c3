"""The quality classifier against plain Python, row by row."""

import random

import pytest

from gleaner.llm import kneser_ney
from gleaner.llm.word_model import WordTables
from gleaner.workspace import Workspace
from tests.llm import quality_brute


def invented(rng, syllables, n):
    common = ["".join(rng.sample(syllables, 1)) for _ in range(8)]
    word = lambda: rng.choice(common) if rng.random() < 0.5 else "".join(rng.choice(syllables) for _ in range(rng.randrange(2, 4)))
    return " ".join(word() + rng.choice(["", "", "", ",", ".\n" + word().title()]) for _ in range(n))


def junk(rng, text, kind):
    w = text.split()
    if kind == "symbols":
        return " ".join(x + rng.choice(["***", "%%%", "&&&"]) for x in w)
    if kind == "table":
        return "\n".join(" | ".join(w[i : i + 5]) for i in range(0, len(w), 5))
    if kind == "capitals":
        return "!! ".join(x.upper() for x in w)
    return " ".join(" ".join([x] * 20) for x in w[:5])


@pytest.fixture(scope="module")
def mixed():
    """(rows, labels, items): each kind of junk, copies, repeated lines, leaks, toxic text, empty rows, rare languages."""
    rng = random.Random(11)
    langs = {"en": ["the", "ing", "an", "re", "ou", "st", "ea"], "fr": ["é", "eau", "le", "tion", "ou", "re", "que"], None: ["ung", "sch", "ei", "ü", "er", "ge"]}
    rows, labels = [], []
    items = [(i, invented(rng, langs["en"], 30)) for i in range(6)]
    for i in range(150):
        lang = rng.choice(list(langs))
        text, kind = invented(rng, langs[lang], rng.randrange(20, 70)), i % 10
        if kind < 4:
            text = junk(rng, text, ["symbols", "table", "capitals", "repeat"][kind])
        elif kind == 4 and i % 3:
            text = text + " " + items[i % 6][1] + " " + text[:40]
        elif kind == 5:
            text = text + " moronic scum"
        elif kind == 6 and len(rows) > 20:
            text, lang = next((r[1], r[2]) for r in rows[::-1] if r[0] % 10 > 6)
        elif kind == 7:
            text += "\nthe same line in many of the texts\nend"
        rows.append((i, text, lang))
        if i % 2 or kind < 4:
            labels.append((i, int(kind >= 4), int(kind == 5)))
    rows += [(200, None, "en"), (201, "", "fr"), (202, " \n", "en"), (203, "st ea", "xx"), (1, rows[1][1], rows[1][2]), (204, invented(rng, langs["en"], 500), "yy")]
    labels += [(204, 1, 0), (9999, 1, 0)]
    return rows, labels, items


def test_perplexities_equal_plain_python(spark, mixed):
    rows, labels, _ = mixed
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    marked = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    good = {d for d, q, _ in labels if q}
    held = {r.doc_id for r in spark.createDataFrame([(d,) for d in good], "doc_id long").filter(f"pmod(xxhash64(doc_id, 'held out'), {kneser_ney.HELD}) = 0").collect()}
    assert 5 < len(held) < len(good) / 2
    want = sorted(quality_brute.perplexities(rows, good, held), key=repr)
    got = sorted((tuple(r[c] for c in ("doc_id", "perplexity", "threshold", "symbol_perplexity", "symbol_threshold", "keep")) for r in kneser_ney.perplexities(docs, marked).collect()), key=repr)
    assert len(got) == len(want)
    for g, w in zip(sorted(got, key=lambda x: x[0]), sorted(want, key=lambda x: x[0]), strict=True):
        assert g[0] == w[0] and g[5] == w[5], (g, w)
        for x, y in zip(g[1:5], w[1:5], strict=True):
            assert (x is None) == (y is None) and (x is None or abs(x - y) < 2e-3 * y), (g, w)
    kept = {g[0] for g in got if g[5]}
    assert not [d for d in range(150) if d % 10 in (0, 2) and d in kept] and all(d in kept for d in good if d < 150)


def test_word_tables_grow_with_trusted_text(spark, mixed):
    """Every word pair of the trusted text has its own entry, in more than one shard."""
    rows, _, _ = mixed
    sizes = []
    for n in (20, 150):
        docs = spark.createDataFrame([(t,) for _, t, _ in rows[:n]], "text string")
        work = Workspace(spark, "t")
        model = kneser_ney.fit(docs, work)
        tables = kneser_ney.fit_words(docs, spark.sparkContext.broadcast(model), work)
        assert isinstance(tables, WordTables)
        found = [tables.deltas()(r.blob)[0] for r in tables.table.collect()]
        pairs = {x for r in rows[:n] for x in quality_brute.path(r[1] or "")}
        assert sum(map(len, found)) == len(pairs) + len({w for x in pairs for w in x})
        assert len(found) == tables.shards
        sizes.append(sum(map(len, found)))
    assert sizes[1] > 3 * sizes[0]


def test_order_of_words_counts(spark):
    """The same sentences with their words in other places cost more: the symbol classes alone hardly see it."""
    rng = random.Random(5)
    names = ["ab", "cd", "ef", "gh", "ij", "kl", "mn", "op"]
    chain = lambda: " ".join(names[(k + i) % 8] for k in [rng.randrange(8)] for i in range(60))
    rows = [(i, chain(), "en") for i in range(60)] + [(100, " ".join(rng.choice(names) for _ in range(60)), "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = {r.doc_id: r for r in kneser_ney.perplexities(docs, spark.createDataFrame([(i, 1) for i in range(60)], "doc_id long, quality int")).collect()}
    assert not out[100].keep and all(out[i].keep for i in range(60))
    assert out[100].perplexity > 1.5 * max(out[i].perplexity for i in range(60))
    blank = spark.createDataFrame([(1, "  \n", "en"), (2, "ab cd", "en")], "doc_id long, text string, lang string")
    assert kneser_ney.perplexities(blank, spark.createDataFrame([(1, 1)], "doc_id long, quality int")).filter("perplexity is null").count() == 0


def test_other_scripts_are_told_apart(spark):
    """Texts in two scripts, alike in lengths and spaces, have their own costs; the words of one are unseen in the other."""
    rng = random.Random(8)
    make = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(2, 6))) for _ in range(60))
    cyrillic, greek = "абвгд", "αβγδε"
    rows = [(i, make(cyrillic), "x") for i in range(80)] + [(100, make(greek), "x"), (101, make("世界平和人"), "x"), (102, make(cyrillic), "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = {r.doc_id: r for r in kneser_ney.perplexities(docs, spark.createDataFrame([(i, 1) for i in range(80)], "doc_id long, quality int")).collect()}
    assert out[102].keep and not out[100].keep and not out[101].keep
    assert min(out[100].symbol_perplexity, out[101].symbol_perplexity) > 2 * out[102].symbol_perplexity


def test_rows_go_by_their_own_text(spark):
    """NULL and repeated ids don't shield junk, nor drag clean rows along."""
    clean, junk = "a clean line of text and more of it", "%%% $$$ ### @@@ ^^^ ~~~ |||| {{{{ }}}}" * 20
    labels = spark.createDataFrame([(i, 1) for i in range(40)], "doc_id long, quality int")
    rows = [(i, clean, "en", 1) for i in range(40)] + [(None, clean, "en", 1)] + [(None, junk, "en", 1)] * 5 + [(901, clean, "en", 1), (901, junk, "en", 1), (902, None, None, 1), (902, junk, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, _doc int")
    out = kneser_ney.keep_good(docs, labels)
    assert out.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in out.filter("doc_id is null or doc_id > 900").collect()), key=repr) == sorted([(None, clean), (901, clean), (902, None)], key=repr)
    assert out.count() == 43
