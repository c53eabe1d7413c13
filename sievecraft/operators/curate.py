"""Filtering of a record's items: rules, exact copies, near copies and a cap, with the reason for each."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievecraft.functions.text import item_key
from sievecraft.functions.verify import verify_reason
from sievecraft.operators.graph import checkpointed
from sievecraft.operators.similarity import greedy_dedupe
from sievecraft.operators.whole import WHOLE_BYTES, kept_of_whole


def filter_items(items: DataFrame, dedup_tau: float = 0.9, most: int | None = None) -> DataFrame:
    """rec, i, item, valid, reason, duplicate_of: every item, with the first test that it fails."""
    rows = items.select("rec", "i", "item", verify_reason(F.col("item")).alias("rule"))
    # Items that break a rule are each a key of their own.
    key = F.when(F.col("rule") == "rule_pass", F.md5(item_key(F.col("item")))).otherwise(F.concat(F.lit("-"), F.col("i").cast("string")))
    rows = checkpointed(rows.withColumn("first", F.min("i").over(Window.partitionBy("rec", key))))
    fresh = rows.where("rule = 'rule_pass' AND i = first").select("rec", "i", "item")
    # A near copy points to the first kept item that it is near.
    out = rows.join(greedy_dedupe(fresh, dedup_tau), ["rec", "i"], "left")
    reason = F.when(F.col("rule") != "rule_pass", F.col("rule")).when(F.col("first") < F.col("i"), "exact_duplicate").when(~F.coalesce("kept", F.lit(False)), "semantic_duplicate")
    out = out.withColumn("reason", reason).withColumn("ok", F.col("reason").isNull().cast("int"))
    place = F.sum("ok").over(Window.partitionBy("rec").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    over = (F.col("ok") == 1) & (place > most) if most else F.lit(False)
    out = out.withColumn("over", over)
    final = F.coalesce("reason", F.when(F.col("over"), "max_items_exceeded").otherwise("rule_pass"))
    of = F.when(F.col("reason") == "exact_duplicate", F.col("first")).when(F.col("reason") == "semantic_duplicate", F.col("near_of"))
    return out.select("rec", "i", "item", (final == "rule_pass").alias("valid"), final.alias("reason"), of.alias("duplicate_of"))


def union_items(sides: list[DataFrame], dedup_tau: float = 0.9) -> DataFrame:
    """rec, i (its place), item of several teachers (rec, i, item) in their order, near copies of earlier ones left out."""
    rows = None
    for k, side in enumerate(sides):
        part = side.select("rec", F.lit(k).alias("side"), "i", "item")
        rows = part if rows is None else rows.unionByName(part)
    return union_rows(rows, rows.groupBy("rec").agg(F.sum(F.octet_length("item")).alias("size")), dedup_tau)


def union_rows(rows: DataFrame, sizes: DataFrame, dedup_tau: float = 0.9, most: int = WHOLE_BYTES) -> DataFrame:
    """What union_items gives of rows (rec, side, i, item). sizes: rec and the bytes of its items, or more. A record of at most
    `most` bytes lies whole in one task; the pairs of larger ones are dealt over tasks."""
    large = checkpointed(sizes.where(F.col("size") > most).select("rec"))
    if large.isEmpty():
        return kept_of_whole(rows, ["side", "i"], dedup_tau)
    whole = kept_of_whole(rows.join(F.broadcast(large), "rec", "left_anti"), ["side", "i"], dedup_tau)
    place = F.row_number().over(Window.partitionBy("rec").orderBy("side", "i")) - 1
    rest = rows.join(F.broadcast(large), "rec", "left_semi").withColumn("i", place).drop("side")
    fresh = checkpointed(rest.withColumn("first", F.min("i").over(Window.partitionBy("rec", F.md5(item_key(F.col("item")))))).where("i = first").drop("first"))
    return whole.unionByName(fresh.join(greedy_dedupe(fresh, dedup_tau).where("kept").select("rec", "i"), ["rec", "i"]))


def consolidate(items: DataFrame, dimension, score, most: int, dedup_tau: float = 0.9) -> DataFrame:
    """The best item of each dimension of a record (ties: the first), best first, near copies of better ones left
    out, at most `most`: rec, place, item, dimension, score. `dimension` and `score` are columns over item.
    """
    rows = items.select("rec", "i", "item", dimension.alias("dimension"), score.cast("double").alias("score"))
    best = rows.withColumn("_n", F.row_number().over(Window.partitionBy("rec", "dimension").orderBy(F.desc("score"), "i"))).where("_n = 1")
    place = F.row_number().over(Window.partitionBy("rec").orderBy(F.desc("score"), "i")) - 1
    ranked = checkpointed(best.select("rec", place.alias("i"), "item", "dimension", "score"))
    kept = ranked.join(greedy_dedupe(ranked, dedup_tau).where("kept").select("rec", "i"), ["rec", "i"])
    out = kept.withColumn("place", F.row_number().over(Window.partitionBy("rec").orderBy("i")))
    return out.where(F.col("place") <= most).select("rec", "place", "item", "dimension", "score")


def quality_score(item, dimension):
    """An additive score: a sentence of some length that names something definite beats a short or general one."""
    from sievecraft.functions.text import tokens

    n = F.size(tokens(item))
    return (n.between(5, 40).cast("int") * 2 + item.rlike(r"[0-9]").cast("int") + item.rlike(r"[.!?]$").cast("int") + (dimension != "completeness").cast("int") - (n < 4).cast("int") * 2).cast("double")
