"""Candidates are worded in Arrow batches as the column expressions word them, and what tells a record's kind runs once."""

import pytest
from pyspark.sql import functions as F
from test_criteria import BODIES

from sievecraft.catalog import rewriting
from sievecraft.functions import surface as sf
from sievecraft.functions.tasks import tidy_sentence
from sievecraft.operators.rewrites import rewritten

TEXTS = [a + b for a in rewriting.SHELLS for b in (*BODIES, "Doesó de la", "should isé", "“É” does has  it;", "a: b?", "Is it?..", "satisfies all, by it")]


@pytest.mark.parametrize("worded", [False, True])
def test_rewritten_as_expressions(spark, worded):
    rows = spark.createDataFrame([(k, x, ("general_task", "math_problem", "code_generation")[k % 3]) for k, x in enumerate([*TEXTS, None])], "k int, item string, kind string")
    x, kind = F.col("item"), F.col("kind")
    good = lambda d: d.where(~sf.is_poor_surface(x))
    first = good(rows.withColumn("item", tidy_sentence(sf.surface(x if worded else sf.surface(sf.imperative(sf.stated(x), kind))))))
    want = good(first.withColumn("item", sf.surface(F.when(sf.is_bad_prefix(x), sf.imperative(x, kind)).otherwise(x))))
    got = rewritten(rows.withColumn("worded", F.lit(worded)))
    assert sorted(map(tuple, got.select(rows.columns[0], "kind", "item").collect())) == sorted(map(tuple, want.select("k", "kind", "item").collect()))
    last = good(rows.withColumn("item", sf.surface(sf.imperative(x, kind))))
    assert sorted(map(tuple, rewritten(rows, last=True).select("k", "kind", "item").collect())) == sorted(map(tuple, last.select("k", "kind", "item").collect()))


def test_kinds_are_told_once(spark, monkeypatch):
    """Records are written before they meet, so that no join tells their kinds anew."""
    from sievecraft.operators import criteria as cr

    written = []
    monkeypatch.setattr(cr, "checkpointed", lambda df, put=cr.checkpointed: written.append(df.columns) or put(df))
    cr.consolidate_criteria(spark.createDataFrame([(1, 1, "States the year")], "rec int, i int, item string"), spark.createDataFrame([(1, "What year?", "pool", "general_task")], "rec int, task string, source string, kind string"))
    assert written[0] == ["rec", "task", "source", "kind", "terms", "least", "most", "tau"]
