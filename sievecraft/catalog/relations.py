"""Queries over joins, contamination, set operations, ablations and judging."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievecraft.catalog import carriers as c
from sievecraft.catalog.scalars import VERIFY
from sievecraft.functions import text as t
from sievecraft.functions import verify as v
from sievecraft.operators import joins as j
from sievecraft.operators import judge
from sievecraft.operators import similarity as s
from sievecraft.sources.records import spread, table


def _keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", t.query_key(F.col("text")).alias("key"), F.length("text").alias("n"))


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents of even and of odd sources, as two sides that share texts."""
    d = _keyed(spark, sf_dir).withColumn("key", F.sha2("key", 256))
    odd = F.substr("source", F.lit(4), F.lit(9)).cast("int") % 2 == 1
    return d.where(~odd).select("key", F.col("doc_id").alias("left_id")), d.where(odd).select("key", F.col("doc_id").alias("right_id"), "lang")


def occurrence_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _sides(spark, sf_dir)
    return j.occurrence_join(a, b, "key", "left_id", "right_id").select("key", F.col("occ").cast("long").alias("occ"), "left_id", "right_id")


def join_report_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of both sides, joined and unmatched ones, and keys that repeat."""
    a, b = _sides(spark, sf_dir)
    x, y = j.with_occurrence(a, "key", "left_id"), j.with_occurrence(b, "key", "right_id")
    both = x.join(y, ["key", "occ"], "full_outer")
    return both.agg(F.count("left_id").alias("left_rows"), F.count("right_id").alias("right_rows"), F.count_if(F.col("left_id").isNotNull() & F.col("right_id").isNotNull()).alias("joined"), F.count_if(F.col("right_id").isNull()).alias("missing"), F.count_if(F.col("left_id").isNull()).alias("unmatched"), F.count_if((F.col("occ") == 2) & F.col("left_id").isNotNull()).alias("left_duplicate_keys"))


def lookup_join_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their customer's last order."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("pos"), F.col("o_totalprice").alias("price"))
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), "c_mktsegment")
    return j.lookup_last(rows, o, "key", "pos").select("key", "c_mktsegment", "pos", F.round("price", 2).alias("price"))


def contamination_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark texts or lines that stand in documents, with the sources that hold them."""
    keys = F.explode(F.array_distinct(F.concat(F.array(t.query_key(F.col("text"))), F.transform(t.lines(F.col("text")), t.query_key)))).alias("key")
    held = table(spark, sf_dir, "benchmark").select("item_id", keys).where("key <> ''")
    # A source's line counts once: copies are gone before anything is joined.
    train = spread(table(spark, sf_dir, "documents").select("source", "text")).select("source", keys).where("key <> ''").distinct()
    return held.join(train, "key").groupBy("item_id").agg(F.count_distinct("key").alias("n_keys"), F.count_distinct("source").alias("n_sources"), F.min("source").alias("first_source"))


def contamination_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of odd sources whose text stands in no even source."""
    a, b = _sides(spark, sf_dir)
    return j.uncontaminated(b, a, "key").groupBy("lang").agg(F.count(F.lit(1)).alias("n_kept"))


def contamination_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document lines that are near a benchmark line (cosine of token counts at least 0.9).

    Lines are cut into tokens once and meet where they share one of the rarest tokens of both, so frequent tokens seldom do.
    """
    gen = c.generated(spark, sf_dir).select(F.struct("rec", "i").alias("id"), "item")
    sims = s.near_pairs(gen, c.gold(spark, sf_dir).select(F.struct("gold_id", "g").alias("id"), "item"), 0.9)
    out = sims.groupBy("b").agg(F.count(F.lit(1)).alias("n_lines"), F.count_distinct("a.rec").alias("n_docs"), F.round(F.max("sim"), 6).alias("best"))
    return out.select("b.gold_id", F.col("b.g").cast("long").alias("g"), "n_lines", "n_docs", "best")


def pending_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that each supplier has not delivered yet."""
    done = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"))
    return j.pending(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("p")), table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("s")), done, ["p", "s"]).select(F.col("s").alias("s_suppkey"), "pending")


def api_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls, tokens and cost per supplier of the pairs that are pending; a supplier's key sets its price."""
    tokens = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("p"), t.estimate_tokens(F.col("p_name")).alias("n"))
    supp = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("s"))
    done = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s")).distinct().join(tokens, "p")
    gone = done.groupBy("s").agg(F.count(F.lit(1)).alias("calls"), F.sum("n").alias("tokens"))
    total = tokens.agg(F.count(F.lit(1)).alias("all_calls"), F.sum("n").alias("all_tokens"))
    out = supp.join(gone, "s", "left").join(F.broadcast(total))
    calls, n = F.col("all_calls") - F.coalesce("calls", F.lit(0)), F.col("all_tokens") - F.coalesce("tokens", F.lit(0))
    return out.select(F.col("s").alias("s_suppkey"), calls.alias("calls"), n.alias("prompt_tokens"), (calls * 200).alias("completion_tokens"), F.round(n * (1 + F.col("s") % 5) / 1000.0, 6).alias("cost"))


def teacher_union_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage of benchmark lines by each language's lines and by their union."""
    best = _by_gold(spark, sf_dir)
    single = best.groupBy("lang").agg(F.count_if(F.col("best") >= 0.5).alias("hits"))
    union = best.groupBy("gold_id", "g").agg(F.max("best").alias("best")).agg(F.count_if(F.col("best") >= 0.5).alias("hits")).select(F.lit("union").alias("lang"), "hits")
    n = c.gold(spark, sf_dir).agg(F.count(F.lit(1)).alias("n_gold"))
    return single.unionByName(union).join(F.broadcast(n)).select(F.col("lang").alias("variant"), "hits", "n_gold")


def _by_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    gen, gold, pairs = c.paired(spark, sf_dir), c.gold(spark, sf_dir), c.pairing(spark, sf_dir)
    sims = s.gold_similarity(gold, gen, pairs.select("rec", "gold_id")).join(pairs.select("rec", "gold_id", "lang"), "rec")
    return sims.groupBy("gold_id", "g", "lang").agg(F.max("sim").alias("best"))


def verifier_filter_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Covered gold items with all items and with valid items only."""
    gen, gold, pairs = c.paired(spark, sf_dir, *c.CUT, "reason"), c.distinct_gold(spark, sf_dir, *c.CUT), c.pairing(spark, sf_dir).select("rec", "gold_id")
    # The reason's test goes with the item's place, so that texts are read once.
    gen = gen.withColumn("i", F.col("i").cast("long") * 2 + (F.col("reason") == "rule_pass").cast("int"))
    sims = s.gold_similarity(gold, gen, pairs).where("sim >= 0.5")
    hits = sims.groupBy("rec", "g").agg(F.lit(1).alias("raw"), F.max(F.col("i") % 2).alias("filtered"))
    return hits.agg(F.sum("raw").cast("long").alias("raw_hits"), F.sum("filtered").cast("long").alias("filtered_hits"), (F.sum("filtered") - F.sum("raw")).cast("long").alias("delta"))


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns of a conversation with its first user turn's lines as criteria."""
    x = table(spark, sf_dir, "conversations")
    criteria = x.where("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("ask"))
    return x.where("role = 'assistant'").select("conv_id", "turn", "text").join(criteria, "conv_id").withColumn("criteria", F.filter(F.transform(F.split("ask", r"[.\n]"), t.clean_item), lambda i: i != ""))


def keyword_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _turns(spark, sf_dir).select("conv_id", "turn", F.size("criteria").cast("long").alias("n_criteria"), F.round(judge.answer_score(F.col("text"), F.col("criteria")), 6).alias("score"))


def _preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _turns(spark, sf_dir).withColumn("score", judge.answer_score(F.col("text"), F.col("criteria")))
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = rows.withColumn("other", F.lead("score").over(w)).withColumn("n", F.row_number().over(w)).where("n = 1 AND other IS NOT NULL")
    return rows.select("conv_id", "score", "other", *[x.alias(n) for n, x in judge.preference(F.col("score"), F.col("other")).items()])


def preference_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _preferences(spark, sf_dir).select("conv_id", F.round("score", 6).alias("chosen_score"), F.round("other", 6).alias("rejected_score"), F.round("margin", 6).alias("margin"), "tie", "correct")


def preference_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _preferences(spark, sf_dir)
    return p.agg(F.count(F.lit(1)).alias("n"), F.round(F.coalesce(F.avg(F.col("correct").cast("int")), F.lit(0.0)), 6).alias("accuracy"), F.round(F.coalesce(F.avg(F.col("tie").cast("int")), F.lit(0.0)), 6).alias("tie_rate"), F.round(F.coalesce(F.avg("margin"), F.lit(0.0)), 6).alias("mean_margin"))


def multicandidate_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All assistant turns of a conversation as candidates, the first being right."""
    rows = _turns(spark, sf_dir).withColumn("score", judge.answer_score(F.col("text"), F.col("criteria")))
    by = rows.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "score"))), lambda e: e["score"]).alias("scores"))
    m = judge.multicandidate(F.col("scores"), F.lit(0))
    return by.select("conv_id", F.size("scores").cast("long").alias("n_candidates"), m["prediction"].cast("long").alias("prediction"), F.round(m["top_score"], 6).alias("top_score"), F.round(m["margin"], 6).alias("margin"), m["tie"].alias("tie"), m["correct"].alias("correct"))


def selective_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents worth another look, with reasons and priority; at most twenty per source."""
    items = c.generated(spark, sf_dir).withColumn("valid", (v.verify_reason(F.col("item")) == "rule_pass").cast("int"))
    st = items.groupBy(F.col("rec").alias("doc_id")).agg(F.count(F.lit(1)).alias("n"), F.sum("valid").alias("ok"))
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", "text").join(st, "doc_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    share = F.try_divide("ok", "n")
    borderline, low, short = (share > 0) & (share < 0.85), F.col("n") < 3, F.size(t.tokens(F.col("text"))) <= 5
    reasons = F.array_compact(F.array(F.when(borderline, "borderline"), F.when(low, "low_count"), F.when(short, "ambiguous")))
    rows = rows.select("doc_id", "source", reasons.alias("r"), F.when(F.coalesce(borderline, F.lit(False)), 0).when(low, 1).otherwise(2).alias("p")).where("size(r) > 0")
    w = Window.partitionBy("source").orderBy("p", F.desc(F.size("r")), "doc_id")
    return rows.withColumn("rank", F.row_number().over(w)).where("rank <= 20").select("doc_id", "source", F.array_join("r", ",").alias("reasons"), F.col("rank").cast("long").alias("rank"))


def method_table_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two summaries by method merged so that neither side's methods are lost."""
    a = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("method")).agg(F.count(F.lit(1)).alias("n_events"), F.round(F.avg("value"), 6).alias("mean_value"))
    b = table(spark, sf_dir, "conversations").groupBy(F.col("role").alias("method")).agg(F.count(F.lit(1)).alias("n_turns"))
    return a.join(b, "method", "full_outer")


def evidence_status_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status of each source from its checks: contradicted, missing_evidence or safe_to_claim."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    by = d.groupBy("source").agg(F.count_if(F.col("toxic") == 1).alias("failed"), F.count_if(F.col("quality").isNull()).alias("missing"), F.count(F.lit(1)).alias("n"))
    status = F.when(F.col("failed") > 0.05 * F.col("n"), "contradicted").when(F.col("missing") > 0.6 * F.col("n"), "missing_evidence").otherwise("safe_to_claim")
    return by.select("source", "failed", "missing", status.alias("status"))


def key_set_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that both sides hold, and those of one side only."""
    a, b = _sides(spark, sf_dir)
    both = a.select("key").intersect(b.select("key")).agg(F.count(F.lit(1)).alias("n_both"))
    only = a.select("key").distinct().join(b, "key", "left_anti").agg(F.count(F.lit(1)).alias("n_left_only"))
    return both.join(only)


QUERIES = {f.__name__: f for f in (occurrence_join, join_report_counts, lookup_join_last_wins, contamination_audit, contamination_filter, contamination_near_dup, pending_pairs, api_budget, teacher_union_gain, verifier_filter_delta, keyword_score, preference_eval, preference_summary, multicandidate_eval, selective_queue, method_table_outer, evidence_status_fold, key_set_intersection)}


def _qk(x: str) -> str:
    return c.sql_collapse(f"lower({c.sql_strip(f'coalesce({x}, {chr(39) * 2})')})")


_SIDES = f"""k AS (SELECT doc_id, lang, sha256({_qk('text')}) AS key, substr(source, 4)::INT % 2 = 1 AS odd FROM documents),
l AS (SELECT key, doc_id AS left_id, row_number() OVER (PARTITION BY key ORDER BY doc_id) AS occ FROM k WHERE NOT odd),
r AS (SELECT key, doc_id AS right_id, lang, row_number() OVER (PARTITION BY key ORDER BY doc_id) AS occ FROM k WHERE odd)"""
_KEYS = lambda n: f"SELECT {n}, unnest(list_distinct(list_prepend({_qk('text')}, list_transform(string_split(text, chr(10)), lambda x: {_qk('x')})))) AS key"
_ANSWERS = f"""ask AS (SELECT conv_id, arg_min(text, turn) AS ask FROM conversations WHERE role = 'user' GROUP BY conv_id),
cri AS (SELECT conv_id, list_filter(list_transform(string_split_regex(ask, '[.\\n]'), lambda x: {c.sql_clean('x')}), lambda x: x <> '') AS criteria FROM ask),
ans AS (SELECT a.conv_id, a.turn, len(q.criteria) AS n_criteria, CASE WHEN len(q.criteria) = 0 THEN 0.0 ELSE
  list_sum(list_transform(q.criteria, lambda x: CASE WHEN len({c.sql_tokens('x')}) = 0 THEN 0.0 ELSE len(list_intersect(list_distinct({c.sql_tokens('x')}), {c.sql_tokens('a.text')})) / len(list_distinct({c.sql_tokens('x')})) END)) / len(q.criteria) END AS score
  FROM conversations a JOIN cri q ON q.conv_id = a.conv_id WHERE a.role = 'assistant'),
pre AS (SELECT conv_id, score, lead(score) OVER (PARTITION BY conv_id ORDER BY turn) AS other, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM ans),
pref AS (SELECT conv_id, score, other, score - other AS margin, abs(score - other) <= 1e-8 AS tie, score - other > 1e-8 AS correct FROM pre WHERE n = 1 AND other IS NOT NULL)"""
ORACLE_SQL = {
    "occurrence_join": f"WITH {_SIDES} SELECT l.key, l.occ, left_id, right_id FROM l JOIN r ON l.key = r.key AND l.occ = r.occ",
    "join_report_counts": f"WITH {_SIDES} SELECT count(left_id) AS left_rows, count(right_id) AS right_rows, count(*) FILTER (left_id IS NOT NULL AND right_id IS NOT NULL) AS joined, count(*) FILTER (right_id IS NULL) AS missing, count(*) FILTER (left_id IS NULL) AS unmatched, count(*) FILTER (l.occ = 2) AS left_duplicate_keys FROM l FULL JOIN r ON l.key = r.key AND l.occ = r.occ",
    "lookup_join_last_wins": "SELECT c_custkey AS key, c_mktsegment, max(o_orderkey) AS pos, round(arg_max(o_totalprice, o_orderkey), 2) AS price FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY ALL",
    "contamination_audit": f"WITH h AS ({_KEYS('item_id')} FROM benchmark), d AS ({_KEYS('source')} FROM documents) SELECT item_id, count(DISTINCT h.key) AS n_keys, count(DISTINCT source) AS n_sources, min(source) AS first_source FROM h JOIN d ON h.key = d.key WHERE h.key <> '' GROUP BY item_id",
    "contamination_filter": f"WITH {_SIDES} SELECT lang, count(*) AS n_kept FROM r WHERE key NOT IN (SELECT key FROM l) GROUP BY lang",
    "contamination_near_dup": f"""WITH {c.GEN}, {c.GOLD}, {c.sql_counts('a', 'gold', 'gold_id, g')}, {c.sql_counts('b', 'gen', 'rec, i')},
        sm AS (SELECT b.rec, b.i, a.gold_id, a.g, sum(a.c * b.c) / sqrt(any_value(a.nn) * any_value(b.nn)) AS sim FROM a JOIN b ON a.token = b.token GROUP BY ALL HAVING sim >= 0.9)
        SELECT gold_id, g, count(*) AS n_lines, count(DISTINCT rec) AS n_docs, round(max(sim), 6) AS best FROM sm GROUP BY ALL""",
    "pending_pairs": "SELECT s_suppkey, (SELECT count(*) FROM part) - count(DISTINCT l_partkey) AS pending FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey AND l_partkey IN (SELECT p_partkey FROM part) GROUP BY s_suppkey",
    "api_budget": """WITH tk AS (SELECT p_partkey, greatest(1, ceil(length(p_name) / 3.5))::BIGINT AS n FROM part), dn AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem),
        g AS (SELECT l_suppkey, count(*) AS calls, sum(n) AS tokens FROM dn JOIN tk ON p_partkey = l_partkey GROUP BY l_suppkey), a AS (SELECT count(*) AS c, sum(n) AS t FROM tk)
        SELECT s_suppkey, a.c - coalesce(calls, 0) AS calls, (a.t - coalesce(tokens, 0))::BIGINT AS prompt_tokens, (a.c - coalesce(calls, 0)) * 200 AS completion_tokens, round((a.t - coalesce(tokens, 0)) * (1 + s_suppkey % 5) / 1000.0, 6)::DOUBLE AS cost FROM supplier LEFT JOIN g ON l_suppkey = s_suppkey, a""",
    "teacher_union_gain": f"""WITH {c.GEN}, {c.GOLD}, {c.PAIRING}, {c.sql_sims()}, bl AS (SELECT p.gold_id, s.g, p.lang, max(s.sim) AS best FROM sims s JOIN pairing p ON p.rec = s.rec GROUP BY ALL)
        SELECT variant, hits, (SELECT count(*) FROM gold) AS n_gold FROM (SELECT lang AS variant, count(*) FILTER (best >= 0.5) AS hits FROM bl GROUP BY lang UNION ALL SELECT 'union', count(*) FILTER (m >= 0.5) FROM (SELECT max(best) AS m FROM bl GROUP BY gold_id, g))""",
    "verifier_filter_delta": f"""WITH {c.GEN}, {c.GOLD}, {c.PAIRING}, {c.DISTINCT}, {c.sql_sims('gen', 'dgold')}, {VERIFY}, h AS (SELECT s.rec, s.g, max((v.reason = 'rule_pass')::INT) AS f FROM sims s JOIN ver v ON v.rec = s.rec AND v.i = s.i WHERE sim >= 0.5 GROUP BY ALL)
        SELECT count(*) AS raw_hits, sum(f)::BIGINT AS filtered_hits, (sum(f) - count(*))::BIGINT AS delta FROM h""",
    "keyword_score": f"WITH {_ANSWERS} SELECT conv_id, turn, n_criteria, round(score, 6)::DOUBLE AS score FROM ans",
    "preference_eval": f"WITH {_ANSWERS} SELECT conv_id, round(score, 6)::DOUBLE AS chosen_score, round(other, 6)::DOUBLE AS rejected_score, round(margin, 6)::DOUBLE AS margin, tie, correct FROM pref",
    "preference_summary": f"WITH {_ANSWERS} SELECT count(*) AS n, round(coalesce(avg(correct::INT), 0), 6) AS accuracy, round(coalesce(avg(tie::INT), 0), 6) AS tie_rate, round(coalesce(avg(margin), 0), 6) AS mean_margin FROM pref",
    "multicandidate_eval": f"""WITH {_ANSWERS}, m AS (SELECT conv_id, list(score ORDER BY turn) AS s FROM ans GROUP BY conv_id)
        SELECT conv_id, len(s) AS n_candidates, list_position(list_transform(s, lambda x: abs(x - list_max(s)) <= 1e-8), true)::BIGINT - 1 AS prediction, round(list_max(s), 6)::DOUBLE AS top_score,
        round(s[1] - coalesce(list_max(s[2:]), 0), 6)::DOUBLE AS margin, len(list_filter(s, lambda x: abs(x - list_max(s)) <= 1e-8)) > 1 AS tie, abs(s[1] - list_max(s)) <= 1e-8 AND len(list_filter(s, lambda x: abs(x - list_max(s)) <= 1e-8)) = 1 AS correct FROM m""",
    "selective_queue": f"""WITH {c.GEN}, {VERIFY}, st AS (SELECT rec, count(*) AS n, count(*) FILTER (reason = 'rule_pass') AS ok FROM ver GROUP BY rec),
        q AS (SELECT doc_id, source, coalesce(ok / n > 0 AND ok / n < 0.85, false) AS b, coalesce(n, 0) < 3 AS lo, len({c.sql_tokens('text')}) <= 5 AS sh FROM documents LEFT JOIN st ON rec = doc_id),
        o AS (SELECT doc_id, source, list_filter([CASE WHEN b THEN 'borderline' END, CASE WHEN lo THEN 'low_count' END, CASE WHEN sh THEN 'ambiguous' END], lambda x: x IS NOT NULL) AS r, CASE WHEN b THEN 0 WHEN lo THEN 1 ELSE 2 END AS p FROM q WHERE b OR lo OR sh)
        SELECT doc_id, source, array_to_string(r, ',') AS reasons, row_number() OVER (PARTITION BY source ORDER BY p, len(r) DESC, doc_id) AS rank FROM o QUALIFY rank <= 20""",
    "method_table_outer": "SELECT coalesce(a.method, b.method) AS method, n_events, mean_value, n_turns FROM (SELECT event_type AS method, count(*) AS n_events, round(avg(value), 6) AS mean_value FROM events GROUP BY 1) a FULL JOIN (SELECT role AS method, count(*) AS n_turns FROM conversations GROUP BY 1) b ON a.method = b.method",
    "evidence_status_fold": """SELECT source, failed, missing, CASE WHEN failed > 0.05 * n THEN 'contradicted' WHEN missing > 0.6 * n THEN 'missing_evidence' ELSE 'safe_to_claim' END AS status
        FROM (SELECT source, count(*) FILTER (toxic = 1) AS failed, count(*) FILTER (quality IS NULL) AS missing, count(*) AS n FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY source)""",
    "key_set_intersection": f"WITH {_SIDES} SELECT (SELECT count(*) FROM (SELECT key FROM l INTERSECT SELECT key FROM r)) AS n_both, (SELECT count(DISTINCT key) FROM l WHERE key NOT IN (SELECT key FROM r)) AS n_left_only",
}
