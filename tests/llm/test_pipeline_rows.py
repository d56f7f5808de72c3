"""run() of the pipeline against plain Python, row by row, on a fixture with every kind of junk, copies, leaks and toxic text."""

import math
from collections import Counter

import corpus_pipeline
from gleaner.llm import kneser_ney, mixing
from tests.llm import brute, quality_brute
from tests.llm.test_quality import mixed  # noqa: F401

MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def bare(text):
    return [x for x in (w.strip(MARKS) for w in brute.WORD.findall((text or "").translate(brute.FOLD))) if x]


def runs(words, k):
    return [tuple(words[i : i + k]) for i in range(len(words) - k + 1)]


def leaking(docs, items, threshold=0.5, overlap=0.6):
    """Ids of documents with a window that scores ``threshold`` of an item's BM25 and holds its parts or its whole."""
    items = [bare(t) for _, t in items]
    terms = [Counter(runs(x, 2)) for x in items]
    df = Counter(t for x in terms for t in x)
    mean = sum(len(x) - 1 for x in items) / len(items)
    share = lambda part, seen: sum(g in seen for g in runs(part, 3)) / len(runs(part, 3))
    out = set()
    for d, text in docs:
        w = bare(text)
        for first in range(0, max(1, len(w) - 64), 64):
            window = w[first : first + 128]
            pairs, threes = set(runs(window, 2)), set(runs(window, 3))
            for x, tf in zip(items, terms):
                impact = {t: math.log1p((len(items) - df[t] + 0.5) / (df[t] + 0.5)) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * (len(x) - 1) / mean)) for t, n in tf.items()}
                if sum(v for t, v in impact.items() if t in pairs) >= threshold * sum(impact.values()):
                    cut = len(x) - len(x) // 4
                    if min(share(x[:cut], threes), share(x[cut:], threes)) >= overlap or share(x, threes) >= overlap:
                        out.add(d)
    return out


def test_run_equals_plain_python(spark, mixed, tmp_path):  # noqa: F811
    rows, labels, items = mixed
    rows = [r for i, r in enumerate(rows) if r[0] not in {x[0] for x in rows[:i]}]
    # an edited copy of an item, so that leaks aren't only verbatim
    # (it goes into a text that is trusted, so that the quality stage lets it through; only a part, or it would be a near copy)
    rows.append((300, " ".join("ing" if i in (3, 27) else w for i, w in enumerate(items[2][1].split(" "))) + " " + " ".join(next(t for d, t, x in rows if d == 204).split(" ")[:150]), "en"))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(d, t, lang, f"s{d % 3}", len(t or "")) for d, t, lang in rows], schema).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    good = {d for d, q, _ in labels if q}
    held = {r.doc_id for r in spark.createDataFrame([(d,) for d in good], "doc_id long").filter(f"pmod(xxhash64(doc_id, 'held out'), {kneser_ney.HELD}) = 0").collect()}
    keep = {r[0] for r in quality_brute.perplexities(rows, good, held) if r[-1]}
    lang = {d: x for d, _, x in rows}
    docs = [(d, t) for d, t, _ in rows if d in keep]
    sizes = [len(rows), len(docs)]
    lines = brute.line_dedup(docs)
    dropped = sum(x[1] for x in lines.values())
    docs = [(d, lines[d][2] if lines[d][1] else t) for d, t in docs]
    classes = brute.jaccard(docs, 5, 80)
    docs = [(d, t) for d, t in docs if classes[d][1] == d]
    sizes.append(len(docs))
    leaks = leaking(docs, items)
    docs = [(d, t) for d, t in docs if d not in leaks]
    sizes.append(len(docs))
    assert sizes == sorted(set(sizes), reverse=True) and dropped and 300 in leaks, (sizes, dropped, leaks, 300 in keep, classes.get(300))

    # mixing is held to plain arrays in test_models; here its part is to get the right rows
    clean = spark.createDataFrame([(d, t, lang[d], f"s{d % 3}", len(t or "")) for d, t in docs], schema)
    domains = mixing.label_domains(spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).filter("domain <> 'junk'")
    want = {r.doc_id: r for r in mixing.mix_documents(clean, domains, {"clean": 0.97, "toxic": 0.03}).collect()}
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in got) == sorted(want)
    for r in got:
        w = want[r.doc_id]
        assert (r.text, r.lang, r.source, r.n_chars, r.copies) == (w.text, w.lang, w.source, w.n_chars, w.copies)
        assert abs(r.rate - w.rate) < 1e-6
    assert any(r.copies > 1 or r.rate < 1 for r in got)
