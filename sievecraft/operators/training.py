"""Rows for training and for the reward hook: conversion, provenance, forbidden sources, flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievecraft.functions import flags as fl
from sievecraft.functions.text import collapse, dedupe_items, parse_items, strip

#: Fields of a record's origin, those that hold its split, and where gold items may stand.
PROVENANCE = ("provenance", "source_url", "paper_url", "dataset_version", "license", "split")
SPLIT_FIELDS = ("split", "data_split", "subset", "metadata.split", "metadata.data_split", "metadata.subset")
GOLD_FIELDS = ("gold_rubrics", "gold", "rubrics_gold")
FLAG_FIELDS = ("valid_flags", "verifier_flags", "validity_flags")
#: Reward of a response that cannot be judged.
BAD_FORMAT = -1.0


def one_line(x: Column) -> Column:
    """Line ends as blanks, ends trimmed."""
    return strip(F.regexp_replace(x, r"\r\n|[\n\r\x0B\f\x1C-\x1E\x{85}\x{2028}\x{2029}]", " "))


def _at(record: Column, path: str) -> Column:
    return F.nullif(F.try_variant_get(record, f"$.{path}", "string"), F.lit(""))


def with_provenance(rows: DataFrame, record: str, given: dict[str, str] | None = None) -> DataFrame:
    """Adds the fields of origin: given values first, else those of the record."""
    given = given or {}
    return rows.withColumns({f: F.coalesce(F.lit(given.get(f)).cast("string"), _at(F.col(record), f)) for f in PROVENANCE})


def split_value(record: Column) -> Column:
    return F.coalesce(*[_at(record, p) for p in SPLIT_FIELDS])


def blockers(rows: DataFrame, record: str, markers: tuple[str, ...], splits: tuple[str, ...]) -> DataFrame:
    """Rows once for each reason not to train on them: a forbidden marker in the source, or a forbidden split."""
    source, split = F.lower(_at(F.col(record), "data_source")), F.lower(split_value(F.col(record)))
    marked = F.exists(F.array(*[F.lit(m.lower()) for m in markers]), lambda m: F.contains(source, m))
    found = F.array(F.when(marked, F.concat(F.lit("source="), source)), F.when(split.isin(*[s.lower() for s in splits]), F.concat(F.lit("split="), split)))
    return rows.withColumn("blocker", F.explode(F.array_compact(found)))


def gold_of(payload: Column) -> Column:
    """Gold items of a reward payload: the first of its fields, or of its nested ground truth, that gives any."""
    paths = [f"$.{f}" for f in GOLD_FIELDS] + [f"$.ground_truth.{f}" for f in GOLD_FIELDS] + ["$.ground_truth"]
    texts = [F.coalesce(F.array_join(F.try_variant_get(payload, p, "array<string>"), "\n"), F.try_variant_get(payload, p, "string")) for p in paths]
    # One parse for all of them: the expression stands in the plan once.
    found = F.filter(F.transform(F.array_compact(F.array(*texts)), lambda x: dedupe_items(parse_items(x))), lambda items: F.size(items) > 0)
    return F.coalesce(F.get(found, F.lit(0)), F.array().cast("array<string>"))


def flags_of(payload: Column) -> Column:
    """The first list of flags in a payload or its ground truth, as texts; null without any."""
    paths = [f"$.{f}" for f in FLAG_FIELDS] + [f"$.ground_truth.{f}" for f in FLAG_FIELDS]
    return F.coalesce(*[F.try_variant_get(payload, p, "array<string>") for p in paths])


def aligned(flags: Column, n: Column) -> Column:
    """Flags as booleans; fails unless there are n of them."""
    return F.when(flags.isNull(), None).when(F.size(flags) == n, F.transform(flags, fl.strict_flag)).otherwise(F.raise_error(F.concat(F.lit("flags and items differ in number: "), F.size(flags), F.lit(" and "), n)).cast("array<boolean>"))


def flagged_items(items: Column, flags: Column) -> Column:
    """Items whose flag holds, first of equal ones; without flags all items."""
    held = F.filter(F.arrays_zip(items.alias("item"), aligned(flags, F.size(items)).alias("ok")), lambda z: z["ok"])
    return dedupe_items(F.when(flags.isNull(), items).otherwise(F.transform(held, lambda z: z["item"])))


def share_valid(flags: Column, fallback: Column) -> Column:
    """Share of flags that hold, the fallback where there are none."""
    return F.when(flags.isNull(), fallback).when(F.size(flags) > 0, F.aggregate(flags, F.lit(0.0), lambda s, f: s + f.cast("double")) / F.size(flags)).otherwise(0.0)


def hook_reward(coverage: Column, validity: Column, redundant: Column, n_gold: Column, n_gen: Column, weights: tuple[float, float, float] = (1.0, 0.5, 0.5)) -> Column:
    """Reward as a trainer asks for it: BAD_FORMAT without gold or generated items."""
    return F.when((n_gold == 0) | (n_gen == 0), BAD_FORMAT).otherwise(weights[0] * coverage + weights[1] * validity - weights[2] * redundant)


def balanced_reward(coverage: Column, balanced: Column, validity: Column, redundant: Column, n_gen: Column, weights: tuple[float, float, float, float] = (0.7, 0.3, 0.5, 0.5)) -> Column:
    """Reward with a term for the mean coverage over categories."""
    return F.when(n_gen == 0, BAD_FORMAT).otherwise(weights[0] * coverage + weights[1] * balanced + weights[2] * validity - weights[3] * redundant)


def rl_rows(rows: DataFrame, template: str, data_source: str) -> DataFrame:
    """Rows (pos, prompt, query, response, source) as training rows: prompt, gold items and extra fields; those without
    prompt or gold items go. The template, with {query}, stands in for a missing prompt."""
    items = F.transform(dedupe_items(parse_items(F.col("response"))), one_line)
    rows = rows.withColumn("gold", items).where((F.size("gold") > 0) & (F.coalesce(F.nullif("prompt", F.lit("")), F.nullif("query", F.lit(""))).isNotNull()))
    query = one_line(F.coalesce(F.nullif("query", F.lit("")), "prompt"))
    shown = F.when(F.coalesce("prompt", F.lit("")) != "", one_line(F.col("prompt"))).otherwise(F.replace(F.lit(template), F.lit("{query}"), query))
    source = F.coalesce(F.nullif("source", F.lit("")), F.lit(data_source))
    return rows.select("pos", shown.alias("prompt"), F.col("gold").alias("gold_rubrics"), source.alias("data_source"), F.struct(F.col("gold").alias("gold_rubrics")).alias("ground_truth"), F.struct(F.col("gold").alias("gold_rubrics"), query.alias("query"), source.alias("data_source")).alias("extra_info"))


def query_pool_rows(rows: DataFrame, template: str, data_source: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows (pos, query, source) as prompts: the first of those that are equal but for white space."""
    rows = rows.where(F.coalesce("query", F.lit("")) != "").withColumn("prompt", F.replace(F.lit(template), F.lit("{query}"), F.col("query")))
    first = Window.partitionBy(F.md5(strip(collapse(F.col("prompt"))))).orderBy("pos")
    rows = rows.withColumn("_n", F.row_number().over(first)).where("_n = 1")
    return rows.select("pos", "prompt", "query", F.coalesce(F.nullif("source", F.lit("")), F.lit(data_source)).alias("data_source"), *[F.nullif(F.col(k).cast("string"), F.lit("")).alias(k) for k in keep])


def chat_rows(rows: DataFrame, system: str) -> DataFrame:
    """Rows (task, response) with the messages of a chat."""
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    return rows.withColumn("messages", F.array(message("system", F.lit(system)), message("user", F.col("task")), message("assistant", F.col("response"))))


def teachers_disagree(outputs: DataFrame, key: str) -> DataFrame:
    """key and whether its teachers differ: rows (key, n_items, n_valid, n_input), one for each teacher. Counts that
    spread by four or by a deviation of two, or shares of valid items that spread by a quarter."""
    share = F.try_divide("n_valid", F.nullif("n_input", F.lit(0)))
    by = outputs.groupBy(key).agg(F.count(F.lit(1)).alias("n"), (F.max("n_items") - F.min("n_items")).alias("range"), F.stddev_pop("n_items").alias("deviation"), (F.max(share) - F.min(share)).alias("spread"))
    return by.select(key, F.col("n").alias("n_teachers"), ((F.col("n") >= 2) & ((F.col("range") >= 4) | (F.col("deviation") >= 2.0) | F.coalesce(F.col("spread") >= 0.25, F.lit(False)))).alias("disagree"))
