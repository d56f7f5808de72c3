"""Benchmark items copied with a few words changed."""

import random

from gleaner.llm import decontaminate


def test_changed_words_do_not_hide_a_copy(spark):
    rng = random.Random(4)
    make = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    items = {i: make(36) for i in range(12)}
    docs, want = [], set()

    def plant(item, places):
        copy = list(items[item])
        for k in places:
            copy[k] = f"other{k}"
        docs.append((len(docs), " ".join(make(50) + copy + make(70))))

    for i in items:  # the last nine words are the part that counts as the answer
        for places in ([31], [29, 32], [28, 31, 34], [5, 17, 31], [2, 12, 22]):
            want.add((len(docs), i))
            plant(i, places)
        plant(i, range(0, 36, 3))
        docs.append((len(docs), " ".join(make(50) + items[i][:20] + make(60))))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(df, bench).collect()} == want


def test_a_given_answer_must_be_there(spark):
    """With an answer column both parts keep their own thresholds."""
    rng = random.Random(6)
    q, a = (" ".join(f"w{rng.randrange(3000)}" for _ in range(n)) for n in (30, 6))
    df = spark.createDataFrame([(0, q + " and so on and on"), (1, q + " " + a)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, q, a)], "item_id long, text string, answer string")
    assert [r.doc_id for r in decontaminate.leaks(df, bench, answer="answer").collect()] == [1]
