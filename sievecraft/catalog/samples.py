"""Queries over samples, splits, bootstrap intervals, arg-max merges, histograms and label rates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievecraft.functions.text import hash_order, parse_bool, parse_number
from sievecraft.operators import joins as j
from sievecraft.operators import stats
from sievecraft.sources.records import table


def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers by market segment: 97 of them, in proportion."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return stats.stratified_sample(rows, "c_mktsegment", "c_custkey", 97)


def group_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of splits of orders by whole customers."""
    rows = stats.group_split(table(spark, sf_dir, "orders"), "o_custkey", [("test", 0.2), ("dev", 0.1), ("train", 0.7)])
    return rows.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_custkey").alias("n_groups"))


def split_overlap_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups in several splits when rows rather than groups are dealt out: what group_split prevents."""
    rows = stats.group_split(table(spark, sf_dir, "orders"), "o_orderkey", [("test", 0.2), ("dev", 0.1), ("train", 0.7)])
    by = rows.groupBy("o_custkey").agg(F.count_distinct("split").alias("n_splits"))
    return by.groupBy("n_splits").agg(F.count(F.lit(1)).alias("n_groups"))


def top_k_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.length("text").cast("long").alias("n"))
    return stats.top_per_group(d, "source", 5, F.desc("n"), F.asc("doc_id")).withColumn("rank", F.col("rank").cast("long"))


def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and 95 % interval of the events' value by type, from 40 rounds."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("metric"), "value", F.col("event_id").alias("key"))
    means = stats.bootstrap_means(e, "metric", "value", "key", 40)
    plain = e.groupBy("metric").agg(F.count("value").alias("n"), F.round(F.avg("value"), 6).alias("mean"))
    return plain.join(stats.interval(means, "metric"), "metric").select("metric", "n", "mean", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


def argmax_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's latest order; of one day the greater key."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus")
    return j.best_per_key(o, ["o_custkey"], "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey", "o_orderstatus", F.col("o_orderdate").cast("string").alias("o_orderdate"))


def shard_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("text").alias("n_distinct"), F.count_distinct("lang").alias("n_langs"), F.sum(F.length("text")).cast("long").alias("chars"), F.count_if(F.length("text") == 0).alias("n_empty"))


def dense_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source with every language, also those without documents, and whether it is labelled in full."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    n = d.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"), F.count("quality").alias("labelled"))
    # Dimension lists: as many rows as there are sources and languages.
    grid = d.select("source").distinct().join(F.broadcast(d.select("lang").distinct()))
    return grid.join(n, ["source", "lang"], "left").select("source", "lang", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("labelled", F.lit(0)).alias("labelled"), (F.coalesce("n", F.lit(0)) == F.coalesce("labelled", F.lit(0))).alias("complete"))


def audit_label_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    r = lambda p, w: F.round(stats.rate(p, w), 6)
    by = d.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count("toxic").alias("labelled"), F.count_if(F.col("toxic") == 1).alias("toxic"), F.count_if((F.col("toxic") == 1) & (F.col("quality") == 1)).alias("both"))
    return by.select("lang", "n", "labelled", r(F.col("labelled"), F.col("n")).alias("completeness"), r(F.col("toxic"), F.col("labelled")).alias("toxic_rate"), r(F.col("both"), F.col("toxic")).alias("good_among_toxic"))


def policy_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy and mean score over rows that have them; a score of 50 or more counts as passed."""
    e = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    flag, score = parse_bool(F.col("quality")), parse_number(F.col("n_chars"))
    by = e.groupBy("lang").agg(F.count_if(flag.isNotNull()).alias("n_flagged"), F.avg(flag.cast("int")).alias("accuracy"), F.avg(score).alias("mean_score"), F.count_if(score >= 50).alias("n_passed"), F.count_if(flag.isNull()).alias("n_skipped"))
    return by.select("lang", "n_flagged", F.round("accuracy", 6).alias("accuracy"), F.round("mean_score", 4).alias("mean_score"), "n_passed", "n_skipped")


def oversample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources dealt a target of 60 documents each: by hash, and again from the first where there are fewer."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    w = Window.partitionBy("source").orderBy(hash_order(13, F.col("doc_id")), "doc_id")
    sizes = d.groupBy("source").agg(F.count(F.lit(1)).alias("c"))
    rows = d.withColumn("n", F.row_number().over(w) - 1).join(sizes, "source").where("n < 60")
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(0), F.floor((F.lit(59) - F.col("n")) / F.least(F.col("c"), F.lit(60))).cast("int"))))
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("doc_id").alias("n_docs"), F.max("copy").cast("long").alias("most_copies"))


def cumulative_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per customer the first order at which the running total passes 100,000."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    o = table(spark, sf_dir, "orders").withColumn("total", F.sum("o_totalprice").over(w)).where("total >= 100000")
    return o.groupBy("o_custkey").agg(F.min("o_orderkey").alias("first_order"))


def dedupe_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First row of each text in the order of ids, counted by language."""
    w = Window.partitionBy(F.sha2("text", 256)).orderBy("doc_id")
    return table(spark, sf_dir, "documents").withColumn("n", F.row_number().over(w)).where("n = 1").groupBy("lang").agg(F.count(F.lit(1)).alias("n_kept"), F.sum("doc_id").alias("sum_ids"))


QUERIES = {f.__name__: f for f in (stratified_sample, group_split, split_overlap_check, top_k_per_source, bootstrap_ci, argmax_merge, shard_summary, dense_grid, audit_label_rates, policy_accuracy, oversample, cumulative_limit, dedupe_first)}


def _h(seed: int, key: str) -> str:
    return f"('0x' || substr(md5('{seed}|' || {key}), 1, 8))::BIGINT"


def _split(key: str) -> str:
    return f"CASE WHEN {_h(13, key)} / 4294967296.0 < 0.2 THEN 'test' WHEN {_h(13, key)} / 4294967296.0 < 0.2 + 0.1 THEN 'dev' ELSE 'train' END"


_TIMES = " + ".join(f"(u >= {p})::INT" for p in stats.POISSON)
ORACLE_SQL = {
    "stratified_sample": f"""WITH s AS (SELECT c_mktsegment AS k, count(*) AS c, (SELECT count(*) FROM customer) AS t FROM customer GROUP BY 1),
        b AS (SELECT k, c, least(c, (97 * c) // t) AS base, row_number() OVER (ORDER BY (97 * c) % t DESC, k DESC) AS r FROM s),
        a AS (SELECT k, base + CASE WHEN r <= 97 - (SELECT sum(base) FROM b) AND base < c THEN 1 ELSE 0 END AS allocated FROM b)
        SELECT c_custkey, c_mktsegment FROM customer JOIN a ON k = c_mktsegment QUALIFY row_number() OVER (PARTITION BY c_mktsegment ORDER BY {_h(13, 'c_custkey')}, c_custkey) <= allocated""",
    "group_split": f"SELECT {_split('o_custkey')} AS split, count(*) AS n, count(DISTINCT o_custkey) AS n_groups FROM orders GROUP BY 1",
    "split_overlap_check": f"SELECT n_splits, count(*) AS n_groups FROM (SELECT o_custkey, count(DISTINCT {_split('o_orderkey')}) AS n_splits FROM orders GROUP BY 1) GROUP BY 1",
    "top_k_per_source": "SELECT doc_id, source, length(text) AS n, row_number() OVER (PARTITION BY source ORDER BY length(text) DESC, doc_id) AS rank FROM documents QUALIFY rank <= 5",
    "bootstrap_ci": f"""WITH d AS (SELECT event_type AS metric, value, r AS round, {_h(13, "(r || '|' || event_id)")} / 4294967296.0 AS u FROM events, range(40) t(r)),
        m AS (SELECT metric, round, sum(value * ({_TIMES})) / sum({_TIMES}) AS mean FROM d GROUP BY ALL)
        SELECT e.metric, n, mean, low, high FROM (SELECT event_type AS metric, count(value) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1) e
        JOIN (SELECT metric, round(quantile_cont(mean, 0.025), 6) AS low, round(quantile_cont(mean, 0.975), 6) AS high FROM m GROUP BY 1) i ON i.metric = e.metric""",
    "argmax_merge": "SELECT o_custkey, o_orderkey, o_orderstatus, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1",
    "shard_summary": "SELECT source, count(*) AS n, count(DISTINCT text) AS n_distinct, count(DISTINCT lang) AS n_langs, sum(length(text))::BIGINT AS chars, count(*) FILTER (length(text) = 0) AS n_empty FROM documents GROUP BY source",
    "dense_grid": """WITH n AS (SELECT source, lang, count(*) AS n, count(quality) AS labelled FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY ALL)
        SELECT s.source, g.lang, coalesce(n, 0) AS n, coalesce(labelled, 0) AS labelled, coalesce(n, 0) = coalesce(labelled, 0) AS complete FROM (SELECT DISTINCT source FROM documents) s CROSS JOIN (SELECT DISTINCT lang FROM documents) g LEFT JOIN n ON n.source = s.source AND n.lang = g.lang""",
    "audit_label_rates": """SELECT lang, count(*) AS n, count(toxic) AS labelled, round(count(toxic) / count(*), 6) AS completeness, round(count(*) FILTER (toxic = 1) / nullif(count(toxic), 0), 6) AS toxic_rate,
        round(count(*) FILTER (toxic = 1 AND quality = 1) / nullif(count(*) FILTER (toxic = 1), 0), 6) AS good_among_toxic FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY lang""",
    "policy_accuracy": "SELECT lang, count(quality) AS n_flagged, round(avg(quality), 6) AS accuracy, round(avg(n_chars), 4) AS mean_score, count(*) FILTER (n_chars >= 50) AS n_passed, count(*) FILTER (quality IS NULL) AS n_skipped FROM labels l JOIN documents d ON d.doc_id = l.doc_id GROUP BY lang",
    "oversample": f"""WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY {_h(13, 'doc_id')}, doc_id) - 1 AS n, count(*) OVER (PARTITION BY source) AS c FROM documents),
        x AS (SELECT source, doc_id, unnest(range((59 - n) // least(c, 60) + 1)) AS copy FROM r WHERE n < 60)
        SELECT source, count(*) AS n_rows, count(DISTINCT doc_id) AS n_docs, max(copy) AS most_copies FROM x GROUP BY source""",
    "cumulative_limit": "SELECT o_custkey, min(o_orderkey) AS first_order FROM (SELECT o_custkey, o_orderkey, sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS t FROM orders) WHERE t >= 100000 GROUP BY 1",
    "dedupe_first": "SELECT lang, count(*) AS n_kept, sum(doc_id)::BIGINT AS sum_ids FROM (SELECT lang, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1) GROUP BY lang",
}
