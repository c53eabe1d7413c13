"""Criteria of records: rewritten until stable, the best of each key, sources limited, near copies left out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievecraft.functions import surface as sf
from sievecraft.functions.dimensions import MORE_STOP, STOP, dimension, surface_key
from sievecraft.functions.tasks import holds_any
from sievecraft.operators.graph import checkpointed
from sievecraft.operators.rewrites import rewritten
from sievecraft.operators.similarity import greedy_dedupe

#: Least and most criteria of a kind of task, and from which similarity on two are one.
BOUNDS = {
    "simple_fact_qa": (4, 6, 0.80), "ambiguous_fact_qa": (7, 10, 0.82), "historical_uncertain_fact": (8, 12, 0.83), "code_generation": (8, 12, 0.84), "math_problem": (7, 10, 0.82), "creative_writing": (7, 10, 0.86),
    "safety_refusal": (6, 9, 0.82), "medical_advice": (7, 10, 0.82), "instruction_following": (7, 12, 0.84), "writing_task": (7, 10, 0.86), "preference_judging": (7, 10, 0.82), "general_task": (6, 9, 0.82),
}


def until_stable(rows: DataFrame, column: str, step: Callable[[Column], Column], most: int = sf.MOST_ROUNDS) -> DataFrame:
    """Distinct texts of a column, the text that repeated steps make of each, and after how many steps it is reached.

    Every round takes only the texts that the one before has changed. Texts that still change after `most` rounds are an
    error: a rewrite that runs in a circle must not look like a result. Null stays null, after no step.
    """
    live = checkpointed(rows.select(F.col(column).alias("text")).distinct().select("text", F.col("text").alias("was"), step(F.col("text")).alias("result")))
    done = None
    for n in range(most):
        same = F.col("was").eqNullSafe(F.col("result"))
        part = live.where(same).select("text", "result", F.lit(n).alias("rounds"))
        done = part if done is None else done.unionByName(part)
        live = checkpointed(live.where(~same).select("text", F.col("result").alias("was"), step(F.col("result")).alias("result")))
        if live.isEmpty():
            return done
    raise ValueError(f"{live.count()} texts still change after {most} rounds, such as {live.first()['text']!r}")


def best_of_key(items: DataFrame, key: Column, score: Column, first_seen: bool = True) -> DataFrame:
    """Items (rec, i, ...) that are the best of their key in a record (ties: the first), with `place`: in the order in
    which the keys were first seen, or best first."""
    rows = items.withColumn("key", key).withColumn("score", score)
    by = Window.partitionBy("rec", "key")
    rows = rows.withColumn("seen", F.min("i").over(by)).withColumn("n", F.row_number().over(by.orderBy(F.desc("score"), "i"))).where("n = 1")
    order = ["seen"] if first_seen else [F.desc("score"), "seen"]
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("rec").orderBy(*order))).drop("n", "seen")


def sources_last(items: DataFrame) -> DataFrame:
    """Items (rec, place, item, score) with at most one about sources, the best (ties: the first), moved to the end."""
    rows = items.withColumn("about", sf.names_sources(F.col("item")))
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("rec", "about").orderBy(F.desc("score"), "place"))).where("NOT about OR n = 1")
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("rec").orderBy("about", "place"))).drop("about", "n")


def added_criteria(records: DataFrame, rules: tuple = sf.ADDED) -> DataFrame:
    """rec and the criteria (j, item) that that the kind, source and words of a record's task add."""
    low = F.lower("task")
    parts = []
    for kinds, sources, groups, criteria in rules:
        test = F.col("kind").isin(*kinds) if kinds else F.lit(True)
        test = test & F.col("source").isin(*sources) if sources else test
        for words in groups:
            test = test & holds_any(low, words)
        parts.append(F.when(test, F.array(*map(F.lit, criteria))).otherwise(F.array().cast("array<string>")))
    return records.select("rec", F.posexplode(F.concat(*parts)).alias("j", "item"))


def polish(items: DataFrame, most: int) -> DataFrame:
    """rec, place, item: criteria (rec, i, item) as written sentences, the best of each key, keys in the order of their
    first sight, at most `most`."""
    rows = checkpointed(items.select("rec", "i", sf.asserted(sf.response_statement(F.col("item"))).alias("item"))).where("item <> ''")
    return best_of_key(rows, surface_key(F.col("item")), sf.written_score(F.col("item"))).where(F.col("place") <= most).select("rec", "place", "item")


def consolidate_criteria(items: DataFrame, records: DataFrame) -> DataFrame:
    """rec, place, item: a record's candidates (rec, i, item), rewritten, as its final criteria.

    records: rec, task, source and kind. The best of each dimension (else of each key) stays, best first; of those about sources
    one, at the end; near copies of better ones go, unless fewer than the kind's least number would be left; at most its
    greatest number stays. Poor and generic criteria go at every step. A record without good candidates gives no rows.
    """
    bound = lambda k: F.element_at(F.create_map(*[F.lit(x) for kind, b in BOUNDS.items() for x in (kind, b[k])]), F.col("kind"))
    # Written, as what tells kinds and terms would else run again for each join, and for each test that a join asks of its side.
    records = checkpointed(records.select("rec", "task", "source", "kind", sf.task_terms(F.col("task")).alias("terms"), bound(0).alias("least"), bound(1).alias("most"), bound(2).alias("tau")))
    kinds = records.select("rec", "kind", "terms")
    rows = items.select("rec", "i", "item").join(kinds, "rec").withColumn("worded", F.lit(False))
    more = added_criteria(records).join(kinds, "rec").withColumn("i", (F.col("j") + (1 << 30)).cast(items.schema["i"].dataType))
    more = more.select("rec", "i", "item", "kind", "terms", F.lit(True).alias("worded"))
    rows = checkpointed(rewritten(rows.unionByName(more)).where(~sf.is_generic(F.col("item"), F.col("terms"))))
    own = dimension(F.col("item"), F.col("kind"))
    key = sf.bound(own, lambda k: F.when(k != "", k).otherwise(surface_key(F.col("item"), f"{STOP}|{MORE_STOP}")))
    ranked = sources_last(best_of_key(rows, key, sf.criterion_score(F.col("item"), F.col("terms")), first_seen=False))
    ranked = checkpointed(ranked.select("rec", "place", "item", "kind"))
    kept = greedy_dedupe(ranked.select("rec", F.col("place").alias("i"), "item"), min(b[2] for b in BOUNDS.values()), records)
    both = ranked.join(kept.select("rec", F.col("i").alias("place"), "kept"), ["rec", "place"]).join(records.select("rec", "least", "most"), "rec")
    both = both.withColumn("fresh", F.row_number().over(Window.partitionBy("rec", "kept").orderBy("place"))).withColumn("in", F.col("kept") & (F.col("fresh") <= F.col("most")))
    both = both.withColumn("n", F.sum(F.col("in").cast("int")).over(Window.partitionBy("rec")))
    # What was left out comes back, in order, until the least number is reached.
    spare = F.row_number().over(Window.partitionBy("rec", "in").orderBy("place"))
    both = both.withColumn("spare", spare).where(F.col("in") | (F.col("n") + F.col("spare") <= F.col("least")))
    final = both.withColumn("place", F.row_number().over(Window.partitionBy("rec").orderBy(F.desc("in"), "place")))
    final = rewritten(final.select("rec", "place", "item", "kind"), last=True)
    return final.select("rec", F.row_number().over(Window.partitionBy("rec").orderBy("place")).alias("place"), "item")


def corpus_counters(items: DataFrame, records: DataFrame) -> DataFrame:
    """One row of counts over all criteria (rec, place, item) of records (rec, task): totals, rates and records with
    several about sources or with equal keys. Each record is counted first, so that sums alone are shuffled further."""
    rows = items.join(records.select("rec", sf.task_terms(F.col("task")).alias("terms")), "rec")
    item = F.col("item")
    tests = {"bad_prefix": sf.is_bad_prefix(item), "bad_surface": sf.is_poor_surface(item), "generic": sf.is_generic(item, F.col("terms")), "json_string": F.ltrim(item).rlike(r"^[\[{]"), "sources": sf.names_sources(item)}
    by = rows.groupBy("rec").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(t).alias(k) for k, t in tests.items()], F.count_distinct(surface_key(item, f"{STOP}|{MORE_STOP}")).alias("keys"))
    rate = lambda k: F.col(k) / F.greatest(F.col("total_items"), F.lit(1))
    out = by.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_items"), *[F.coalesce(F.sum(k), F.lit(0)).alias(f"{k}_count") for k in ("bad_prefix", "bad_surface", "generic", "json_string")], F.count_if(F.col("sources") > 1).alias("rows_with_source_overflow"), F.count_if(F.col("keys") != F.col("n")).alias("rows_with_duplicate"))
    return out.withColumns({f"{k}_rate": rate(f"{k}_count") for k in ("bad_prefix", "bad_surface", "generic")})
