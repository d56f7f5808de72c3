"""What operators leave in the shared folder."""

import os

from gleaner.operators import ranking
from gleaner.workspace import Workspace, scope, shared_root


def tables(spark):
    top = shared_root(spark).removeprefix("file:") + "/gleaner"
    return set(os.listdir(top)) if os.path.isdir(top) else set()


def test_scope_leaves_nothing(spark):
    before = tables(spark)
    rows = spark.range(50).withColumnRenamed("id", "k")
    with scope():
        assert ranking.global_rank(rows, ["k"]).count() == 50
        assert ranking.rank_within(rows.selectExpr("k", "k % 3 as g"), ["g"], ["k"]).filter("rank = 0").count() == 3
        with scope():
            inner = Workspace(spark, "inner")
            inner.stash(rows, "rows")
            sent = inner.broadcast([1])
        assert not any(x.startswith("inner") for x in tables(spark)) and inner._sent == []
        assert tables(spark) > before
    assert tables(spark) == before
    outside = Workspace(spark, "outside")
    with scope():
        kept = outside.stash(rows, "rows")
    assert kept.count() == 50 and sent is not None
    outside.close()
    assert tables(spark) == before


def test_scope_closes_after_an_error(spark):
    before = tables(spark)
    try:
        with scope():
            Workspace(spark, "broken").stash(spark.range(3), "rows")
            raise ZeroDivisionError
    except ZeroDivisionError:
        pass
    assert tables(spark) == before
