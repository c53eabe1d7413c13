"""Scores of answers by criteria, pairwise and among several candidates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievecraft.functions.text import dedupe_items, join_key, parse_items, strip, tokens

TIE = 1e-8


def keyword_score(answer: Column, criterion: Column) -> Column:
    """Share of the criterion's distinct tokens that the answer has; 0 without tokens."""
    wanted = F.array_distinct(tokens(criterion))
    return F.when(F.size(wanted) > 0, F.size(F.array_intersect(wanted, tokens(answer))) / F.size(wanted)).otherwise(0.0)


def answer_score(answer: Column, criteria: Column) -> Column:
    """Mean over criteria; 0 without any."""
    total = F.aggregate(F.transform(criteria, lambda c: keyword_score(answer, c)), F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(criteria) > 0, total / F.size(criteria)).otherwise(0.0)


def preference(chosen: Column, rejected: Column) -> dict[str, Column]:
    margin = chosen - rejected
    return {"margin": margin, "tie": F.abs(margin) <= TIE, "correct": margin > TIE}


def multicandidate(scores: Column, label: Column) -> dict[str, Column]:
    """Prediction (first of the best), margin of the label to the best other, tie and correct; a tie is not correct."""
    top = F.array_max(scores)
    own = F.get(scores, label)
    others = F.array_max(F.filter(scores, lambda x, i: i != label))
    tie = F.size(F.filter(scores, lambda x: F.abs(x - top) <= TIE)) > 1
    first = (F.array_position(F.transform(scores, lambda x: F.abs(x - top) <= TIE), F.lit(True)) - 1).cast("int")
    return {"prediction": first, "label_score": own, "top_score": top, "margin": own - F.coalesce(others, F.lit(0.0)), "tie": tie, "correct": (first == label) & ~tie}


#: A scorer gives the score of an answer to a query by one criterion, as a column of these three columns; null: it cannot tell.
Scorer = Callable[[Column, Column, Column], Column]
#: Fixed value: the reward of a row without query, answer or criteria.
MISSING = -1.0


def keyword_scorer(query: Column, answer: Column, criterion: Column) -> Column:
    return keyword_score(answer, criterion)


def vectorised(score: Callable) -> Scorer:
    """A scorer from a function of three pandas Series (queries, answers, criteria) that returns one of floats, such as a model
    called with whole batches; missing values mean that it cannot tell."""
    run = F.pandas_udf(lambda query, answer, criterion: score(query, answer, criterion).astype(float), "double", F.PandasUDFType.SCALAR)
    return lambda query, answer, criterion: F.nanvl(run(query, answer, criterion), F.lit(None).cast("double"))


def with_fallback(first: Scorer, *others: Scorer) -> Scorer:
    """The first scorer that can tell."""
    return lambda *x: F.coalesce(first(*x), *[s(*x) for s in others])


def policy_rewards(rows: DataFrame, sources: list[str], scorers: dict[str, Scorer], cache: DataFrame | None = None, missing: float = MISSING) -> DataFrame:
    """rec, n_criteria and a reward for each scorer of rows (rec, query, answer and columns of criteria text).

    Criteria are those of the first column of `sources` that has any, else those of the cache (key, criteria) under the
    query's key, or under the row's own where rows have a column `key` (null: the cache is not asked); equal ones count once.
    A reward is the mean over criteria, where a scorer that cannot tell gives 0.
    Rows without query, answer or criteria have the reward `missing`. Criteria are dealt out as rows, so scorers see
    batches of them whatever records they are of.
    """
    key = F.col("key") if "key" in rows.columns else join_key(F.col("query"))
    rows = rows.select("rec", "query", "answer", F.coalesce(*[F.nullif(F.col(s), F.lit("")) for s in sources]).alias("own"), key.alias("key"))
    if cache is not None:
        first = cache.groupBy(F.col("key").alias("at")).agg(F.max("criteria").alias("cached"))
        rows = rows.join(first, F.col("key") == F.col("at"), "left").withColumn("own", F.coalesce("own", "cached")).drop("at", "cached")
    items = dedupe_items(parse_items(F.coalesce("own", F.lit(""))))
    bad = (F.coalesce("query", F.lit("")) == "") | (strip(F.coalesce("answer", F.lit(""))) == "")
    rows = rows.select("rec", "query", "answer", F.when(bad, F.array().cast("array<string>")).otherwise(items).alias("items"))
    each = rows.select("rec", "query", "answer", F.explode_outer("items").alias("criterion"))
    scored = each.select("rec", "criterion", *[F.when(F.col("criterion").isNotNull(), F.coalesce(s(F.col("query"), F.col("answer"), F.col("criterion")), F.lit(0.0))).alias(n) for n, s in scorers.items()])
    return scored.groupBy("rec").agg(F.count("criterion").alias("n_criteria"), *[F.coalesce(F.avg(n), F.lit(missing)).alias(n) for n in scorers])
