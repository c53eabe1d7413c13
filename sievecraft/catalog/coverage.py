"""Queries over coverage, redundancy, reward, sweeps, categories and transitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievecraft.catalog import carriers as c
from sievecraft.catalog.scalars import VERIFY
from sievecraft.functions import verify as v
from sievecraft.operators import similarity as s
from sievecraft.sources.records import table

TAU, NEAR = 0.5, 0.85


def hits_of(spark: SparkSession, sf_dir: str, distinct: bool = True, gen: DataFrame | None = None) -> DataFrame:
    """rec, gold_id, g, item, best, best_i, lang, source of each record's gold items. Generated items that repeat an earlier one
    change neither the best similarity nor the first that has it; gen may leave them out."""
    gen = c.paired(spark, sf_dir, *c.CUT) if gen is None else gen
    gold = c.distinct_gold(spark, sf_dir, *c.CUT) if distinct else c.gold(spark, sf_dir, "item", *c.CUT)
    pairs = c.pairing(spark, sf_dir)
    return s.gold_hits(gold.drop(*c.CUT), s.gold_similarity(gold, gen, pairs), pairs)


def coverage_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean coverage of gold items per language: the flagship query."""
    hit = (F.col("best") >= TAU).cast("int")
    by = hits_of(spark, sf_dir).groupBy("lang").agg(F.count(F.lit(1)).alias("gold_items"), F.sum(hit).cast("long").alias("hits"))
    return by.withColumn("coverage", F.round(F.col("hits") / F.col("gold_items"), 6))


def marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All generated items with gold_id, reason and what tells equal ones apart, cut once and written."""
    return s.marked_classes(c.paired(spark, sf_dir, *c.CUT, "reason"), "gold_id", "reason")


def per_record(spark: SparkSession, sf_dir: str, items: DataFrame | None = None) -> DataFrame:
    """rec, coverage, blind, redundancy, validity, hallucination, reward, n_gold, n_gen of every record."""
    items = marked(spark, sf_dir) if items is None else items
    classes = items.where("w IS NOT NULL")
    cov = hits_of(spark, sf_dir, gen=classes).groupBy("rec").agg(F.count(F.lit(1)).alias("n_gold"), F.sum((F.col("best") >= TAU).cast("int")).cast("long").alias("hits"))
    valid = items.groupBy("rec").agg(F.count(F.lit(1)).alias("n_gen"), F.avg((F.col("reason") == "rule_pass").cast("int")).alias("validity"))
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("rec"), "source", "lang")
    rows = rows.join(cov, "rec", "left").join(valid, "rec", "left").join(s.pairs_of_classes(classes, NEAR), "rec", "left")
    gold, n = F.coalesce("n_gold", F.lit(0)), F.coalesce("n_gen", F.lit(0))
    covered = F.when((n > 0) & (gold > 0), F.col("hits") / F.col("n_gold")).otherwise(0.0)
    blind = F.when(n == 0, F.when(gold > 0, 1.0).otherwise(0.0)).otherwise(1 - covered)
    red, val = F.coalesce(F.try_divide("pairs", "n_gen"), F.lit(0.0)), F.coalesce("validity", F.lit(0.0))
    reward = F.when(n == 0, -1.0).otherwise(s.composite_reward(covered, val, red))
    return rows.select("rec", "source", "lang", covered.alias("coverage"), blind.alias("blind"), red.alias("redundancy"), val.alias("validity"), (1 - val).alias("hallucination"), reward.alias("reward"), gold.alias("n_gold"), n.alias("n_gen"))


def coverage_per_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = (F.col("best") >= TAU).cast("int")
    return hits_of(spark, sf_dir).groupBy("rec").agg(F.count(F.lit(1)).alias("n_gold"), F.sum(hit).cast("long").alias("hits"), F.round(F.avg(hit), 6).alias("coverage"))


def balanced_by_record(spark: SparkSession, sf_dir: str, gen: DataFrame | None = None) -> DataFrame:
    """rec, n_categories and balanced: the macro average over the categories of a record's gold items, which are not deduplicated."""
    hits = hits_of(spark, sf_dir, False, gen).withColumn("category", v.classify_category(F.col("item")))
    by = hits.groupBy("rec", "category").agg(F.avg((F.col("best") >= TAU).cast("int")).alias("c"))
    return by.groupBy("rec").agg(F.count(F.lit(1)).alias("n_categories"), F.avg("c").alias("balanced"))


def balanced_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balanced_by_record(spark, sf_dir).withColumn("balanced", F.round("balanced", 6))


def redundancy_per_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.redundancy(c.generated(spark, sf_dir, *c.CUT), NEAR).select("rec", "n_gen", F.round("redundancy", 6).alias("redundancy"))


def reward_per_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = per_record(spark, sf_dir)
    return rows.select("rec", *[F.round(x, 6).alias(x) for x in ("coverage", "blind", "redundancy", "validity", "hallucination", "reward")], "n_gold", "n_gen")


def bsc_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means, median and counts over all records, one row."""
    r = per_record(spark, sf_dir)
    means = [F.round(F.avg(x), 6).alias(f"mean_{x}") for x in ("coverage", "blind", "redundancy", "validity", "hallucination", "reward")]
    counts = [F.count_if(F.col("coverage") <= 0.5).alias("coverage_le_half"), F.count_if(F.col("coverage") >= 0.8).alias("coverage_ge_080"), F.count_if(F.col("coverage") == 0).alias("coverage_zero")]
    return r.agg(F.count(F.lit(1)).alias("n"), *means, F.round(F.percentile("blind", 0.5), 6).alias("median_blind"), *counts, F.sum("n_gold").alias("total_gold"), F.sum("n_gen").alias("total_gen"))


def median_blind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return per_record(spark, sf_dir).groupBy("source").agg(F.round(F.percentile("blind", 0.5), 6).alias("median_blind"), F.count(F.lit(1)).alias("n"))


THRESHOLDS = (0.3, 0.5, 0.7)


def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage at several thresholds from one set of similarities."""
    hits = hits_of(spark, sf_dir).select("rec", "best", F.explode(F.array(*map(F.lit, THRESHOLDS))).alias("tau"))
    return hits.groupBy("tau").agg(F.count(F.lit(1)).alias("gold_items"), F.sum((F.col("best") >= F.col("tau")).cast("int")).cast("long").alias("hits"), F.count_distinct("rec").alias("records"))


BUDGETS = (1, 3, 5, 10)


def budget_curve_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage by the first K generated items only, K in several steps."""
    gen, gold, pairs = c.paired(spark, sf_dir), c.distinct_gold(spark, sf_dir), c.pairing(spark, sf_dir).select("rec", "gold_id")
    first = F.row_number().over(s.Window.partitionBy("rec").orderBy("i"))
    gen = gen.withColumn("k", first).where(F.col("k") <= max(BUDGETS))
    # The place among the record's items stands for the line.
    sims = s.gold_similarity(gold, gen.select("rec", "gold_id", F.col("k").alias("i"), "item"), pairs)
    need = sims.where(F.col("sim") >= TAU).groupBy("rec", "g").agg(F.min("i").alias("need"))
    rows = pairs.join(gold, "gold_id").join(need, ["rec", "g"], "left").select("need", F.explode(F.array(*map(F.lit, BUDGETS))).alias("budget"))
    return rows.groupBy("budget").agg(F.count(F.lit(1)).alias("gold_items"), F.count_if(F.col("need") <= F.col("budget")).alias("hits"))


VARIANTS = (("full", 1.0, 0.5, 0.5), ("no_validity", 1.0, 0.0, 0.5), ("no_redundancy", 1.0, 0.5, 0.0), ("coverage_only", 1.0, 0.0, 0.0), ("no_coverage", 0.0, 0.5, 0.5))


def reward_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean reward under several weights."""
    variants = F.array(*[F.struct(F.lit(n).alias("variant"), F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(d).alias("d")) for n, a, b, d in VARIANTS])
    r = per_record(spark, sf_dir).withColumn("w", F.explode(variants))
    reward = F.when(F.col("n_gen") == 0, -1.0).otherwise(F.col("w.a") * F.col("coverage") + F.col("w.b") * F.col("validity") - F.col("w.d") * F.col("redundancy"))
    return r.groupBy(F.col("w.variant").alias("variant")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(reward), 6).alias("mean_reward"))


def missed_category_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold items and misses by category, categories without items included."""
    hits = hits_of(spark, sf_dir, False).groupBy(v.classify_category(F.col("item")).alias("category")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("best") < TAU).alias("missed"))
    all_ = spark.sql("SELECT explode(array(" + ",".join(f"'{x}'" for x in v.CATEGORIES) + ")) AS category")
    out = all_.join(hits, "category", "left")
    return out.select("category", F.coalesce("n", F.lit(0)).alias("n_gold"), F.coalesce("missed", F.lit(0)).alias("n_blind"), F.round(F.coalesce(F.try_divide("missed", "n"), F.lit(0.0)), 6).alias("blind_rate"))


def transitions(spark: SparkSession, sf_dir: str, thirds: bool = False) -> DataFrame:
    """Each gold item covered by the record's first half of items (baseline) and by all (candidate), so that none is lost; with
    thirds, the candidate lacks every third item."""
    gen, gold, pairs = c.paired(spark, sf_dir), c.gold(spark, sf_dir), c.pairing(spark, sf_dir)
    ids = pairs.select("rec", "gold_id")
    rec = s.Window.partitionBy("rec")
    gen = gen.withColumn("k", F.row_number().over(rec.orderBy("i"))).withColumn("n", F.count(F.lit(1)).over(rec))
    # Place and half of an item in one number, which takes the place of its line.
    gen = gen.select("rec", "gold_id", (F.col("k") * 2 + (F.col("k") * 2 <= F.col("n")).cast("int")).alias("i"), "item")
    sims = s.gold_similarity(gold, gen, ids)
    hit = F.col("sim") >= TAU
    by = sims.groupBy("rec", "g").agg(F.max(hit & (F.col("i") % 2 == 1)).alias("baseline"), F.max(hit & (F.expr("i div 2") % 3 != 0) if thirds else hit).alias("candidate"))
    out = ids.join(gold, "gold_id").join(by, ["rec", "g"], "left")
    return out.select("rec", "g", v.classify_category(F.col("item")).alias("category"), F.coalesce("baseline", F.lit(False)).alias("baseline"), F.coalesce("candidate", F.lit(False)).alias("candidate"))


def moves(rows: DataFrame) -> DataFrame:
    a, b = F.col("baseline"), F.col("candidate")
    return rows.groupBy("category").agg(F.count(F.lit(1)).alias("total"), F.count_if(~a & b).alias("recovered"), F.count_if(a & ~b).alias("lost"), F.count_if(a & b).alias("retained"), F.count_if(~a & ~b).alias("still_blind"))


def dimension_transition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold items of each category by what the second half of items does for them."""
    return moves(transitions(spark, sf_dir))


def transition_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of gold items recovered and lost by a candidate that lacks every third item."""
    t = moves(transitions(spark, sf_dir, thirds=True)).agg(*[F.sum(x).alias(x) for x in ("total", "recovered", "lost", "retained", "still_blind")])
    rate = lambda p, w: F.round(F.coalesce(F.try_divide(p, w), F.lit(0.0)), 6)
    return t.select("total", rate(F.col("recovered"), F.col("recovered") + F.col("still_blind")).alias("recovered_rate"), rate(F.col("lost"), F.col("lost") + F.col("retained")).alias("loss_rate"), rate(F.col("recovered") - F.col("lost"), F.col("total")).alias("net_rate"))


def exact_dup_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid items that repeat an earlier valid one of the record, with that one's place."""
    items = c.generated(spark, sf_dir).where(v.verify_reason(F.col("item")) == "rule_pass").withColumn("key", c.clean_item(F.lower("item")))
    first = F.min("i").over(s.Window.partitionBy("rec", "key"))
    return items.withColumn("duplicate_of", first).where("i > duplicate_of").select("rec", F.col("i").cast("long").alias("i"), F.col("duplicate_of").cast("long").alias("duplicate_of"))


def max_items_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items per record, valid ones, and those that a cap of five valid ones turns down."""
    items = c.generated(spark, sf_dir).withColumn("valid", (v.verify_reason(F.col("item")) == "rule_pass").cast("int"))
    running = F.sum("valid").over(s.Window.partitionBy("rec").orderBy("i").rowsBetween(s.Window.unboundedPreceding, 0))
    items = items.withColumn("running", running)
    return items.groupBy("rec").agg(F.count(F.lit(1)).alias("n"), F.sum("valid").cast("long").alias("n_valid"), F.count_if((F.col("valid") == 1) & (F.col("running") > 5)).alias("n_over_cap"))


def semantic_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items kept by greedy deduplication at 0.85 in order."""
    kept = s.greedy_dedupe(c.distinct_generated(spark, sf_dir, *c.CUT), NEAR).where("kept")
    return kept.groupBy("rec").agg(F.count(F.lit(1)).alias("n_kept"), F.sum("i").cast("long").alias("sum_i"))


QUERIES = {f.__name__: f for f in (coverage_by_lang, coverage_per_record, balanced_coverage, redundancy_per_record, reward_per_record, bsc_summary, median_blind, threshold_sweep, budget_curve_k, reward_ablation, missed_category_map, dimension_transition, transition_rates, exact_dup_marks, max_items_cap, semantic_dedupe)}

_D = f"WITH {c.GEN}, {c.GOLD}, {c.PAIRING}, {c.DISTINCT}, {c.sql_sims('dgen', 'dgold')}"
_A = f"WITH {c.GEN}, {c.GOLD}, {c.PAIRING}, {c.sql_sims()}"


def sql_category(x: str) -> str:
    scores = ", ".join("(" + " + ".join(f"contains(lower({x}), {c.sql_quote(k)})::INT" for k in v.KEYWORDS[n]) + ")" for n in v.CATEGORIES)
    names = ", ".join(f"'{n}'" for n in v.CATEGORIES)
    return f"(CASE WHEN list_max([{scores}]) > 0 THEN [{names}][list_position([{scores}], list_max([{scores}]))] ELSE 'completeness' END)"


RECORDS = f"""WITH {c.GEN}, {c.GOLD}, {c.PAIRING}, {c.DISTINCT}, {c.sql_counts('a', 'dgold', 'gold_id, g')}, {c.sql_counts('bd', 'dgen', 'rec, i')},
sims AS (SELECT b.rec, a.g, sum(a.c * b.c) / sqrt(any_value(a.nn) * any_value(b.nn)) AS sim FROM bd b JOIN pairing p ON b.rec = p.rec JOIN a ON a.gold_id = p.gold_id AND a.token = b.token GROUP BY b.rec, a.g, b.i),
best AS (SELECT rec, g, max(sim) AS best FROM sims GROUP BY ALL),
cov AS (SELECT p.rec, count(*) AS n_gold, count(*) FILTER (coalesce(s.best, 0) >= {TAU}) AS hits FROM pairing p JOIN dgold o ON o.gold_id = p.gold_id LEFT JOIN best s ON s.rec = p.rec AND s.g = o.g GROUP BY p.rec),
{c.sql_own()}, {VERIFY},
red AS (SELECT g.rec, g.n_gen, coalesce(o.pairs, 0) / g.n_gen AS redundancy FROM (SELECT rec, count(*) AS n_gen FROM gen GROUP BY rec) g LEFT JOIN (SELECT rec, count(*) AS pairs FROM own WHERE sim >= {NEAR} GROUP BY rec) o ON o.rec = g.rec),
val AS (SELECT rec, avg((reason = 'rule_pass')::INT) AS validity FROM ver GROUP BY rec),
r0 AS (SELECT d.doc_id AS rec, d.source, d.lang, coalesce(n_gold, 0) AS n_gold, coalesce(n_gen, 0) AS n_gen, coalesce(redundancy, 0) AS redundancy, coalesce(validity, 0) AS validity,
  CASE WHEN coalesce(n_gen, 0) > 0 AND coalesce(n_gold, 0) > 0 THEN hits / n_gold ELSE 0 END AS coverage
  FROM documents d LEFT JOIN cov ON cov.rec = d.doc_id LEFT JOIN red ON red.rec = d.doc_id LEFT JOIN val ON val.rec = d.doc_id),
r AS (SELECT *, CASE WHEN n_gen = 0 THEN CASE WHEN n_gold > 0 THEN 1.0 ELSE 0.0 END ELSE 1 - coverage END AS blind, 1 - validity AS hallucination,
  CASE WHEN n_gen = 0 THEN -1.0 ELSE coverage + 0.5 * validity - 0.5 * redundancy END AS reward FROM r0)"""


def _trans(candidate: str) -> str:
    return f"""{_A}, place AS (SELECT rec, i, row_number() OVER (PARTITION BY rec ORDER BY i) AS k, count(*) OVER (PARTITION BY rec) AS n FROM gen),
tr0 AS (SELECT s.rec, s.g, bool_or(sim >= {TAU} AND k * 2 <= n) AS baseline, bool_or({candidate}) AS candidate FROM sims s JOIN place p ON p.rec = s.rec AND p.i = s.i GROUP BY ALL),
tr AS (SELECT {sql_category('o.item')} AS category, coalesce(t.baseline, false) AS a, coalesce(t.candidate, false) AS b FROM pairing p JOIN gold o ON o.gold_id = p.gold_id LEFT JOIN tr0 t ON t.rec = p.rec AND t.g = o.g),
dt AS (SELECT category, count(*) AS total, count(*) FILTER (NOT a AND b) AS recovered, count(*) FILTER (a AND NOT b) AS lost, count(*) FILTER (a AND b) AS retained, count(*) FILTER (NOT a AND NOT b) AS still_blind FROM tr GROUP BY category)"""


BALANCED = f"{_A} SELECT rec, count(*) AS n_categories, avg(c) AS balanced FROM (SELECT rec, {sql_category('item')} AS category, avg((best >= {TAU})::INT) AS c FROM hits GROUP BY ALL) GROUP BY rec"
ORACLE_SQL = {
    "coverage_by_lang": f"{_D} SELECT lang, count(*) AS gold_items, count(*) FILTER (best >= {TAU}) AS hits, round(count(*) FILTER (best >= {TAU}) / count(*), 6) AS coverage FROM hits GROUP BY lang",
    "coverage_per_record": f"{_D} SELECT rec, count(*) AS n_gold, count(*) FILTER (best >= {TAU}) AS hits, round(avg((best >= {TAU})::INT), 6) AS coverage FROM hits GROUP BY rec",
    "balanced_coverage": f"{_A} SELECT rec, count(*) AS n_categories, round(avg(c), 6) AS balanced FROM (SELECT rec, {sql_category('item')} AS category, avg((best >= {TAU})::INT) AS c FROM hits GROUP BY ALL) GROUP BY rec",
    "redundancy_per_record": f"WITH {c.GEN}, {c.sql_own()} SELECT g.rec, g.n_gen, round(coalesce(o.pairs, 0) / g.n_gen, 6) AS redundancy FROM (SELECT rec, count(*) AS n_gen FROM gen GROUP BY rec) g LEFT JOIN (SELECT rec, count(*) AS pairs FROM own WHERE sim >= {NEAR} GROUP BY rec) o ON o.rec = g.rec",
    "reward_per_record": f"{RECORDS} SELECT rec, round(coverage, 6) AS coverage, round(blind, 6) AS blind, round(redundancy, 6) AS redundancy, round(validity, 6) AS validity, round(hallucination, 6) AS hallucination, round(reward, 6) AS reward, n_gold, n_gen FROM r",
    "bsc_summary": f"""{RECORDS} SELECT count(*) AS n, {', '.join(f'round(avg({x}), 6) AS mean_{x}' for x in ('coverage', 'blind', 'redundancy', 'validity', 'hallucination', 'reward'))}, round(quantile_cont(blind, 0.5), 6) AS median_blind,
        count(*) FILTER (coverage <= 0.5) AS coverage_le_half, count(*) FILTER (coverage >= 0.8) AS coverage_ge_080, count(*) FILTER (coverage = 0) AS coverage_zero, sum(n_gold)::BIGINT AS total_gold, sum(n_gen)::BIGINT AS total_gen FROM r""",
    "median_blind": f"{RECORDS} SELECT source, round(quantile_cont(blind, 0.5), 6) AS median_blind, count(*) AS n FROM r GROUP BY source",
    "threshold_sweep": f"{_D} SELECT tau, count(*) AS gold_items, count(*) FILTER (best >= tau) AS hits, count(DISTINCT rec) AS records FROM hits, (SELECT unnest([0.3, 0.5, 0.7])::DOUBLE AS tau) GROUP BY tau",
    "budget_curve_k": f"""WITH {c.GEN}, {c.GOLD}, {c.PAIRING}, {c.DISTINCT}, {c.sql_sims('gen', 'dgold')}, place AS (SELECT rec, i, row_number() OVER (PARTITION BY rec ORDER BY i) AS k FROM gen),
        need AS (SELECT s.rec, s.g, min(k) AS need FROM sims s JOIN place p ON p.rec = s.rec AND p.i = s.i WHERE sim >= {TAU} AND k <= 10 GROUP BY ALL)
        SELECT budget, count(*) AS gold_items, count(*) FILTER (need <= budget) AS hits FROM pairing p JOIN dgold o ON o.gold_id = p.gold_id LEFT JOIN need n ON n.rec = p.rec AND n.g = o.g, (SELECT unnest([1, 3, 5, 10]) AS budget) GROUP BY budget""",
    "reward_ablation": f"""{RECORDS} SELECT variant, count(*) AS n, round(avg(CASE WHEN n_gen = 0 THEN -1.0 ELSE a * coverage + b * validity - d * redundancy END), 6) AS mean_reward
        FROM r, (VALUES {', '.join(f"('{n}', {a}::DOUBLE, {b}::DOUBLE, {d}::DOUBLE)" for n, a, b, d in VARIANTS)}) w(variant, a, b, d) GROUP BY variant""",
    "missed_category_map": f"""{_A}, m AS (SELECT {sql_category('item')} AS category, count(*) AS n, count(*) FILTER (best < {TAU}) AS missed FROM hits GROUP BY ALL)
        SELECT a.category, coalesce(n, 0) AS n_gold, coalesce(missed, 0) AS n_blind, round(coalesce(missed / n, 0), 6) AS blind_rate FROM (SELECT unnest([{', '.join(f"'{x}'" for x in v.CATEGORIES)}]) AS category) a LEFT JOIN m ON m.category = a.category""",
    "dimension_transition": f"{_trans(f'sim >= {TAU}')} SELECT * FROM dt",
    "transition_rates": f"""{_trans(f'sim >= {TAU} AND k % 3 <> 0')} SELECT sum(total)::BIGINT AS total, round(coalesce(sum(recovered) / nullif(sum(recovered) + sum(still_blind), 0), 0), 6) AS recovered_rate,
        round(coalesce(sum(lost) / nullif(sum(lost) + sum(retained), 0), 0), 6) AS loss_rate, round(coalesce((sum(recovered) - sum(lost)) / nullif(sum(total), 0), 0), 6) AS net_rate FROM dt""",
    "exact_dup_marks": f"WITH {c.GEN}, {VERIFY} SELECT rec, i, f AS duplicate_of FROM (SELECT rec, i, min(i) OVER (PARTITION BY rec, {c.sql_clean('lower(item)')}) AS f FROM ver WHERE reason = 'rule_pass') WHERE i > f",
    "max_items_cap": f"WITH {c.GEN}, {VERIFY} SELECT rec, count(*) AS n, count(*) FILTER (v) AS n_valid, count(*) FILTER (v AND k > 5) AS n_over_cap FROM (SELECT rec, reason = 'rule_pass' AS v, count(*) FILTER (reason = 'rule_pass') OVER (PARTITION BY rec ORDER BY i) AS k FROM ver) GROUP BY rec",
    "semantic_dedupe": f"""WITH {c.GEN}, {c.GOLD}, {c.DISTINCT}, {c.sql_own('dgen')}, near AS (SELECT rec, j, list(i) AS n FROM own WHERE sim >= {NEAR} GROUP BY ALL),
        l AS (SELECT g.rec, list({{'i': g.i, 'n': coalesce(n.n, []::BIGINT[])}} ORDER BY g.i) AS xs FROM dgen g LEFT JOIN near n ON n.rec = g.rec AND n.j = g.i GROUP BY g.rec),
        f AS (SELECT rec, list_reduce(list_prepend([]::BIGINT[], list_transform(xs, lambda x: list_prepend(x.i, x.n))), lambda acc, x: CASE WHEN list_has_any(acc, x[2:]) THEN acc ELSE list_append(acc, x[1]) END) AS kept FROM l)
        SELECT rec, len(kept) AS n_kept, list_sum(kept)::BIGINT AS sum_i FROM f""",
}
