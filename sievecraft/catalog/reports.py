"""Queries over reports: validation, splits with exact counts, audits, deltas between methods, summaries of samples and queues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievecraft.catalog import carriers as c
from sievecraft.catalog import coverage as cov
from sievecraft.catalog import relations, samples, scalars
from sievecraft.catalog.scalars import VERIFY
from sievecraft.functions import flags as fl
from sievecraft.functions import verify as v
from sievecraft.functions.text import hash_order
from sievecraft.operators import joins as j
from sievecraft.operators import stats
from sievecraft.sources.records import table


def gold_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of records, of queries that repeat and of records that they make, and of records that cannot serve as gold."""
    d = table(spark, sf_dir, "documents").select(F.md5("text").alias("q"), (F.length("text") == 0).alias("empty"), (F.col("source") == "").alias("anonymous"))
    by = d.groupBy("q").agg(F.count(F.lit(1)).alias("c"), F.count_if(F.col("empty") | F.col("anonymous")).alias("blocked"))
    return by.agg(F.sum("c").cast("long").alias("n_records"), F.count(F.lit(1)).alias("n_unique"), F.count_if(F.col("c") > 1).alias("n_duplicate_queries"), F.sum(F.when(F.col("c") > 1, F.col("c")).otherwise(0)).cast("long").alias("n_duplicate_records"), F.sum("blocked").cast("long").alias("n_blocked"))


def method_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validation by method (language): records that pass, kinds of issues, mean number of items."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    has = lambda x: F.count_if(F.contains("issues", F.lit(x)))
    by = scalars.validate_items_issues(spark, sf_dir).join(d, "doc_id").groupBy("lang").agg(
        F.count(F.lit(1)).alias("n_records"), F.count_if("ok").alias("ok_records"), has("no_parseable").alias("parse_failures"), has("too_few").alias("too_few"), has("too_many").alias("too_many"),
        has("exact_duplicates").alias("duplicate_records"), has("generic_terms").alias("generic_records"), F.round(F.avg("n_items"), 6).alias("mean_n_items"),
    )
    return by.withColumn("ok_rate", F.round(F.col("ok_records") / F.col("n_records"), 6))


def multicandidate_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = relations.multicandidate_eval(spark, sf_dir)
    zero = lambda x, k=6: F.round(F.coalesce(F.avg(x), F.lit(0.0)), k)
    return m.agg(F.count(F.lit(1)).alias("n"), zero(F.col("correct").cast("int")).alias("accuracy"), zero(F.col("tie").cast("int")).alias("tie_rate"), zero(F.col("margin"), 5).alias("mean_margin"), zero(F.col("n_candidates")).alias("mean_candidates"))


def method_table_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Method rows with the interval columns of their metric, where there is one."""
    rows = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("method")).agg(F.count_distinct("user_id").alias("n_users"))
    ci = samples.bootstrap_ci(spark, sf_dir).where("n >= 10").select(F.col("metric").alias("method"), F.col("low").alias("value_ci_lower"), F.col("high").alias("value_ci_upper"))
    shown = F.coalesce(F.format_string("[%.3f, %.3f]", "value_ci_lower", "value_ci_upper"), F.lit(""))
    return rows.join(ci, "method", "left").withColumn("value_ci", shown)


def split_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Splits of orders by whole customers, with exact numbers of groups: groups, records, strata and their first group."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority")
    rows = stats.exact_split(o, "o_custkey", [("test", 20), ("dev", 10), ("train", None)])
    return rows.groupBy("split").agg(F.count_distinct("o_custkey").alias("n_groups"), F.count(F.lit(1)).alias("n_records"), F.count_distinct("o_orderpriority").alias("n_strata"), F.min("o_custkey").alias("first_group"))


def split_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority")
    rows = stats.exact_split(o, "o_custkey", [("test", 20), ("dev", 10), ("train", None)])
    return rows.groupBy("split", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


def stage_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every method (language) beside the baseline: coverage of both and their difference, to four decimals."""
    rows = cov.coverage_by_lang(spark, sf_dir).select("lang", "coverage", "gold_items")
    base = rows.where("lang = 'en'").select(F.col("coverage").alias("baseline"))
    return rows.where("lang <> 'en'").join(F.broadcast(base), how="left").select("lang", "baseline", F.col("coverage").alias("candidate"), fl.difference(F.col("coverage"), F.col("baseline")).alias("delta"))


def verifier_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source its items, the valid ones, and its reasons with their numbers."""
    items = c.generated(spark, sf_dir).select("rec", v.verify_reason(F.col("item")).alias("reason"))
    by = items.join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("rec"), "source"), "rec").groupBy("source", "reason").agg(F.count(F.lit(1)).alias("n"))
    each = F.array_join(F.sort_array(F.collect_list(F.format_string("%s=%d", "reason", "n"))), " ")
    return by.groupBy("source").agg(F.sum("n").cast("long").alias("n_input"), F.coalesce(F.sum(F.when(F.col("reason") == "rule_pass", F.col("n"))), F.lit(0)).cast("long").alias("n_valid"), each.alias("reasons"))


def _matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("best") >= cov.TAU, "matched").otherwise("unmatched")
    return cov.hits_of(spark, sf_dir).select("rec", "g", F.round("best", 6).alias("best"), status.alias("status"))


def audit_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold items for a human to look at: at most 50 matched and 50 unmatched ones, in hash order."""
    order = hash_order(13, F.concat_ws(":", F.col("rec").cast("string"), F.col("g").cast("string")))
    rows = stats.top_per_group(_matches(spark, sf_dir), "status", 50, order, F.col("rec"), F.col("g"))
    return rows.select("rec", F.col("g").cast("long").alias("g"), "best", "status", F.col("rank").cast("long").alias("rank"))


def audit_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matches(spark, sf_dir).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.least(F.count(F.lit(1)), F.lit(50)).alias("n_sampled"), F.round(F.avg("best"), 5).alias("mean_best"))


def sampled_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strata of the input beside those of a sample of it."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    size = lambda df, name: df.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias(name))
    both = size(rows, "n_input").join(size(stats.stratified_sample(rows, "c_mktsegment", "c_custkey", 97), "n_sampled"), "c_mktsegment", "full_outer")
    return both.select("c_mktsegment", F.coalesce("n_input", F.lit(0)).alias("n_input"), F.coalesce("n_sampled", F.lit(0)).alias("n_sampled"))


def queue_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The selective queue by source and by reason."""
    q = relations.selective_queue(spark, sf_dir)
    by_source = q.groupBy(F.col("source").alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("source").alias("kind"), "name", "n")
    by_reason = q.select(F.explode(F.split("reasons", ",")).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n")).select(F.lit("reason").alias("kind"), "name", "n")
    return by_source.unionByName(by_reason)


def plan_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks (nations of a region) one after the other: the days on which each begins and ends."""
    n = table(spark, sf_dir, "nation").withColumn("days", F.length("n_name"))
    w = Window.partitionBy("n_regionkey").orderBy("n_nationkey")
    end = F.sum("days").over(w)
    return n.select("n_regionkey", "n_nationkey", (end - F.col("days")).cast("long").alias("first_day"), end.cast("long").alias("last_day"))


def failed_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns without items, with the class of their failure."""
    x = table(spark, sf_dir, "conversations")
    error, response = F.when(F.col("role") == "user", F.col("text")), F.when(F.col("role") != "user", F.col("text"))
    return x.select("conv_id", "turn", v.failure_class(error, response, F.lit(False)).alias("failure"))


def cached_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer with the status of its last order, or none: an optional lookup that falls back."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"))
    return j.lookup_last(rows, o, "o_custkey", "o_orderkey", "left").select(F.col("o_custkey").alias("c_custkey"), F.coalesce("o_orderstatus", F.lit("none")).alias("status"))


def dataset_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source and language: records, least, mean and greatest number of items, share of the whole."""
    n = c.generated(spark, sf_dir).groupBy("rec").agg(F.count(F.lit(1)).alias("n"))
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("rec"), "source", "lang").join(n, "rec", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = d.agg(F.count(F.lit(1)).alias("all"))
    by = d.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n_records"), F.min("n").alias("least"), F.round(F.avg("n"), 6).alias("mean"), F.max("n").alias("most"))
    return by.join(F.broadcast(total)).select("source", "lang", "n_records", "least", "mean", "most", F.round(F.col("n_records") / F.col("all"), 6).alias("share"))


QUERIES = {f.__name__: f for f in (gold_validation, method_validation, multicandidate_summary, method_table_ci, split_manifest, split_strata, stage_delta, verifier_report, audit_sample, audit_summary, sampled_strata, queue_summary, plan_days, failed_turns, cached_lookup, dataset_report)}

_HITS = f"WITH {c.GEN}, {c.GOLD}, {c.PAIRING}, {c.DISTINCT}, {c.sql_sims('dgen', 'dgold')}, m AS (SELECT rec, g, round(best, 6) AS best, CASE WHEN best >= {cov.TAU} THEN 'matched' ELSE 'unmatched' END AS status FROM hits)"
_GROUPS = f"""WITH g AS (SELECT o_custkey, row_number() OVER (ORDER BY {samples._h(13, 'o_custkey')}, o_custkey) AS k FROM (SELECT DISTINCT o_custkey FROM orders)),
s AS (SELECT o.o_custkey, o_orderpriority, CASE WHEN k <= 20 THEN 'test' WHEN k <= 30 THEN 'dev' ELSE 'train' END AS split FROM orders o JOIN g ON g.o_custkey = o.o_custkey)"""
ORACLE_SQL = {
    "gold_validation": """WITH q AS (SELECT text, count(*) AS c, count(*) FILTER (length(text) = 0 OR source = '') AS b FROM documents GROUP BY text)
        SELECT sum(c)::BIGINT AS n_records, count(*) AS n_unique, count(*) FILTER (c > 1) AS n_duplicate_queries, coalesce(sum(c) FILTER (c > 1), 0)::BIGINT AS n_duplicate_records, sum(b)::BIGINT AS n_blocked FROM q""",
    "method_validation": f"""WITH v AS (SELECT * FROM ({scalars.ORACLE_SQL['validate_items_issues']}))
        SELECT lang, count(*) AS n_records, count(*) FILTER (ok) AS ok_records, count(*) FILTER (contains(issues, 'no_parseable')) AS parse_failures, count(*) FILTER (contains(issues, 'too_few')) AS too_few, count(*) FILTER (contains(issues, 'too_many')) AS too_many,
        count(*) FILTER (contains(issues, 'exact_duplicates')) AS duplicate_records, count(*) FILTER (contains(issues, 'generic_terms')) AS generic_records, round(avg(n_items), 6) AS mean_n_items, round(count(*) FILTER (ok) / count(*), 6) AS ok_rate FROM v JOIN documents d ON d.doc_id = v.doc_id GROUP BY lang""",
    "multicandidate_summary": f"SELECT count(*) AS n, round(coalesce(avg(correct::INT), 0), 6) AS accuracy, round(coalesce(avg(tie::INT), 0), 6) AS tie_rate, round(coalesce(avg(margin), 0), 5) AS mean_margin, round(coalesce(avg(n_candidates), 0), 6) AS mean_candidates FROM ({relations.ORACLE_SQL['multicandidate_eval']})",
    "method_table_ci": f"""WITH b AS (SELECT * FROM ({samples.ORACLE_SQL['bootstrap_ci']}) WHERE n >= 10) SELECT m.method, n_users, low AS value_ci_lower, high AS value_ci_upper, coalesce(printf('[%.3f, %.3f]', low, high), '') AS value_ci
        FROM (SELECT event_type AS method, count(DISTINCT user_id) AS n_users FROM events GROUP BY 1) m LEFT JOIN b ON b.metric = m.method""",
    "split_manifest": f"{_GROUPS} SELECT split, count(DISTINCT o_custkey) AS n_groups, count(*) AS n_records, count(DISTINCT o_orderpriority) AS n_strata, min(o_custkey) AS first_group FROM s GROUP BY split",
    "split_strata": f"{_GROUPS} SELECT split, o_orderpriority, count(*) AS n FROM s GROUP BY ALL",
    "stage_delta": f"WITH l AS (SELECT * FROM ({cov.ORACLE_SQL['coverage_by_lang']})) SELECT a.lang, b.coverage AS baseline, a.coverage AS candidate, coalesce(printf('%.4f', a.coverage - b.coverage), '') AS delta FROM l a LEFT JOIN l b ON b.lang = 'en' WHERE a.lang <> 'en'",
    "verifier_report": f"""WITH {c.GEN}, {VERIFY}, n AS (SELECT source, reason, count(*) AS n FROM ver JOIN documents ON doc_id = rec GROUP BY ALL)
        SELECT source, sum(n)::BIGINT AS n_input, coalesce(sum(n) FILTER (reason = 'rule_pass'), 0)::BIGINT AS n_valid, string_agg(reason || '=' || n, ' ' ORDER BY reason || '=' || n) AS reasons FROM n GROUP BY source""",
    "audit_sample": f"{_HITS} SELECT rec, g, best, status, row_number() OVER (PARTITION BY status ORDER BY {samples._h(13, chr(40) + 'rec || ' + chr(39) + ':' + chr(39) + ' || g' + chr(41))}, rec, g) AS rank FROM m QUALIFY rank <= 50",
    "audit_summary": f"{_HITS} SELECT status, count(*) AS n, least(count(*), 50) AS n_sampled, round(avg(best), 5) AS mean_best FROM m GROUP BY status",
    "sampled_strata": f"WITH s AS (SELECT * FROM ({samples.ORACLE_SQL['stratified_sample']})) SELECT c.c_mktsegment, count(*) AS n_input, (SELECT count(*) FROM s WHERE s.c_mktsegment = c.c_mktsegment) AS n_sampled FROM customer c GROUP BY c.c_mktsegment",
    "queue_summary": f"""WITH q AS (SELECT * FROM ({relations.ORACLE_SQL['selective_queue']})) SELECT 'source' AS kind, source AS name, count(*) AS n FROM q GROUP BY source
        UNION ALL SELECT 'reason', r, count(*) FROM (SELECT unnest(string_split(reasons, ',')) AS r FROM q) GROUP BY r""",
    "plan_days": "SELECT n_regionkey, n_nationkey, (sum(length(n_name)) OVER w - length(n_name))::BIGINT AS first_day, (sum(length(n_name)) OVER w)::BIGINT AS last_day FROM nation WINDOW w AS (PARTITION BY n_regionkey ORDER BY n_nationkey)",
    "failed_turns": f"""SELECT conv_id, turn, CASE WHEN {scalars._in(v.REFUSALS, 'e || chr(10) || r')} THEN 'safety_refusal' WHEN {scalars._in(v.API_ERRORS, 'e')} THEN 'api_error' WHEN r = '' THEN 'empty_output' ELSE 'parse_failure' END AS failure
        FROM (SELECT conv_id, turn, CASE WHEN role = 'user' THEN lower(coalesce(text, '')) ELSE '' END AS e, CASE WHEN role <> 'user' THEN lower(coalesce(text, '')) ELSE '' END AS r FROM conversations)""",
    "cached_lookup": "SELECT c_custkey, coalesce(arg_max(o_orderstatus, o_orderkey), 'none') AS status FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey",
    "dataset_report": f"""WITH {c.GEN}, n AS (SELECT rec, count(*) AS n FROM gen GROUP BY rec), d AS (SELECT source, lang, coalesce(n, 0) AS n FROM documents LEFT JOIN n ON rec = doc_id)
        SELECT source, lang, count(*) AS n_records, min(n) AS least, round(avg(n), 6) AS mean, max(n) AS most, round(count(*) / (SELECT count(*) FROM documents), 6) AS share FROM d GROUP BY ALL""",
}
