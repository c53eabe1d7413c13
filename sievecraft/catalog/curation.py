"""Queries over normalisation, item filters, unions, components, task kinds and rewrites."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievecraft.catalog import carriers as c
from sievecraft.catalog.coverage import sql_category
from sievecraft.catalog.scalars import VERIFY
from sievecraft.functions import tasks
from sievecraft.functions.verify import KEYWORDS, classify_category
from sievecraft.operators import curate, graph, normalize
from sievecraft.operators import similarity as s
from sievecraft.operators.items import items_of
from sievecraft.operators.joins import match_keywords
from sievecraft.plans.stages import Stage, run_stages
from sievecraft.sources.profile import profile
from sievecraft.sources.records import spread, table
from sievecraft.streaming.resume import not_done


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as loose records: the first user turn asks, assistant turns answer."""
    x = table(spark, sf_dir, "conversations")
    ask = x.where("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("prompt"))
    said = x.where("role = 'assistant'").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda e: e["text"]).alias("responses"))
    rows = ask.join(said, "conv_id", "left")
    label = F.when(F.col("conv_id") % 3 == 0, "A>B").when(F.col("conv_id") % 3 == 1, "B > A").otherwise("A=B")
    parts = F.struct("prompt", F.get("responses", F.lit(0)).alias("response_A"), F.get("responses", F.lit(1)).alias("response_B"), label.alias("preference"), F.col("responses").alias("candidates"), F.lit("0").alias("label"), F.concat(F.lit("- "), F.regexp_replace(F.translate("prompt", "\n", " "), r"\. +", ".\n- ")).alias("criteria"))
    return rows.select(F.col("conv_id").alias("pos"), F.parse_json(F.to_json(parts)).alias("record"))


def _target(target: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = normalize.normalize(_records(spark, sf_dir), target)
        cells = {"gold": F.sha2(F.array_join(F.col("gold_rubrics"), "\n"), 256), "query_pool": F.col("data_source"), "preference": F.sha2(F.concat_ws("|", "chosen", "rejected"), 256), "multicandidate": F.sha2(F.concat_ws("|", F.array_join(F.col("candidates"), "|"), F.col("label").cast("string")), 256)}
        return out.select("pos", F.sha2("query", 256).alias("query_sha256"), cells[target].alias("cells"))

    query.__name__ = f"normalize_{target}"
    return query


#: Targets in the order in which they are tried, and how many rows one needs.
TRIED, ENOUGH = ["multicandidate", "preference", "gold", "query_pool"], 40


def schema_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows of each target the conversations' records make, and the first target with enough."""
    return normalize.target_counts(_records(spark, sf_dir), TRIED, ENOUGH)


def filter_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reasons of item filtering per language: rules, exact and near copies, a cap of eight."""
    out = curate.filter_items(c.generated(spark, sf_dir), 0.9, 8)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("rec"), "lang")
    return out.join(docs, "rec").groupBy("lang", "reason").agg(F.count(F.lit(1)).alias("n"), F.count("duplicate_of").alias("n_pointing"))


def union_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per benchmark row the items of two teachers, exact and near copies of earlier ones left out."""
    n = table(spark, sf_dir, "benchmark").agg(F.count(F.lit(1)).alias("n"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    dealt = lambda rows: rows.join(F.broadcast(n)).withColumn("rec", F.expr("pmod(doc_id, n)")).drop("n")
    side = F.when(F.col("lang") == "en", 0).when(F.col("lang") != "en", 1).otherwise(2)
    rows = items_of(dealt(spread(docs)), "doc_id").select("rec", side.alias("side"), F.struct("doc_id", "i").alias("i"), "item")
    sizes = dealt(docs).groupBy("rec").agg(F.sum(F.octet_length("text")).alias("size"))
    return curate.union_rows(rows, sizes).groupBy("rec").agg(F.count(F.lit(1)).alias("n_items"), F.sum(F.length("item")).cast("long").alias("chars"))


def sim_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of benchmark lines that are near each other (0.75), named by their smallest member."""
    items = c.gold(spark, sf_dir).select(F.struct(F.col("gold_id").alias("gold_id"), F.col("g").alias("g")).alias("id"), "item")
    edges = s.near_pairs(items, items, 0.75).where("a <> b")
    return graph.min_labels(edges, items.select(F.col("id").alias("node"))).select(F.format_string("%d:%d", "node.gold_id", "node.g").alias("item"), F.format_string("%d:%d", "component.gold_id", "component.g").alias("component"))


def consolidate_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best item of each category of a document, at most five: their number and lengths."""
    kind = classify_category(F.col("item"))
    out = curate.consolidate(c.generated(spark, sf_dir), kind, curate.quality_score(F.col("item"), kind), 5)
    return out.groupBy("rec").agg(F.count(F.lit(1)).alias("n_items"), F.sum(F.length("item")).cast("long").alias("chars"), F.sum("score").alias("score"))


def nested_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths and kinds of values of the conversations' records."""
    return profile(_records(spark, sf_dir)).select("path", "kind", "n")


def keyword_concerns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by the categories whose keywords they hold."""
    rows = match_keywords(table(spark, sf_dir, "documents").select("lang", "text"), "text", KEYWORDS)
    return rows.groupBy("concern", "lang").agg(F.count(F.lit(1)).alias("n"))


def task_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "conversations")
    return x.groupBy(tasks.task_type(F.col("text"), F.col("role")).alias("task_type"), "role").agg(F.count(F.lit(1)).alias("n"))


def declarative_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark lines as statements, with their content keys' digest."""
    g = c.gold(spark, sf_dir)
    return g.select("gold_id", F.col("g").cast("long").alias("g"), tasks.declarative(F.col("item")).alias("statement"), F.sha2(tasks.content_key(F.col("item")), 256).alias("content_sha256"))


#: Beginnings that make questions of the benchmark lines.
ASKED = ("Does the answer ", "Is it ", "Are ", "Should the model ", "If asked, does the text ", "How well does the plan ", "Tone: ", "The response should is ")


def statement_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark lines asked in several forms, as statements that begin with a verb."""
    g = c.gold(spark, sf_dir)
    asked = F.concat(F.element_at(F.array(*map(F.lit, ASKED)), (F.col("g") % len(ASKED) + 1).cast("int")), F.col("item"), F.lit("?"))
    kind = F.when(F.col("g") % 3 == 0, "math_problem").when(F.col("g") % 3 == 1, "simple_fact_qa").otherwise("other")
    rows = g.select("gold_id", F.col("g").cast("long").alias("g"), tasks.statement(asked).alias("statement"), kind.alias("kind"))
    return rows.select("gold_id", "g", "statement", tasks.with_verb(F.col("statement"), F.col("kind")).alias("criterion"))


def resume_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last order of each (customer, priority) that no finished order has yet."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", F.col("o_orderkey").alias("pos"), "o_orderstatus")
    return not_done(o.where("o_orderstatus <> 'F'").drop("o_orderstatus"), o.where("o_orderstatus = 'F'"), ["o_custkey", "o_orderpriority"]).select("o_custkey", "o_orderpriority", "pos")


def staged_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small plan of named stages: items, their filter, its summary."""
    stages = [
        Stage("items", lambda docs: c.item_rows(docs, "doc_id").withColumnRenamed("doc_id", "rec"), ("documents",)),
        Stage("filtered", curate.filter_items, ("items",), {"dedup_tau": 0.9}),
        Stage("summary", lambda rows: rows.groupBy("valid").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("rec").alias("records")), ("filtered",)),
    ]
    return run_stages(stages, {"documents": c.texts(spark, sf_dir)})["summary"]


QUERIES = {f.__name__: f for f in (*(_target(t) for t in ("gold", "query_pool", "preference", "multicandidate")), schema_choice, filter_items, union_items, sim_components, consolidate_items, nested_profile, keyword_concerns, task_types, declarative_items, statement_items, resume_pairs, staged_summary)}


def _any(x: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({x}, {c.sql_quote(w)})" for w in words) + ")"


_REC = """ask AS (SELECT conv_id, arg_min(text, turn) AS prompt FROM conversations WHERE role = 'user' GROUP BY conv_id),
said AS (SELECT conv_id, list(text ORDER BY turn) AS r FROM conversations WHERE role = 'assistant' GROUP BY conv_id),
rec AS (SELECT a.conv_id AS pos, %s AS query, prompt, r FROM ask a LEFT JOIN said s ON s.conv_id = a.conv_id),
fst AS (SELECT * FROM rec WHERE query <> '' QUALIFY row_number() OVER (PARTITION BY query ORDER BY pos) = 1)""" % c.sql_strip("prompt")
_LIST = f"list_filter(list_transform(r, lambda x: {c.sql_strip('x')}), lambda x: x <> '')"
_ITEMS = f"list_filter(list_transform(string_split(regexp_replace(replace(prompt, chr(10), ' '), '\\. +', '.' || chr(10), 'g'), chr(10)), lambda x: {c.sql_clean('x')}), lambda x: x <> '')"
_BARE = f"regexp_replace({c.sql_strip('y')}, '\\?+$', '')"
_STATEMENT = f"""CASE WHEN regexp_matches(b, '(?i)^does the (response|answer) ') THEN regexp_replace(b, '(?i)^does the (response|answer) ', 'The response should ')
  WHEN regexp_matches(b, '(?i)^is the (response|answer) ') THEN regexp_replace(b, '(?i)^is the (response|answer) ', 'The response should be ')
  WHEN regexp_matches(b, '(?i)^has the (response|answer) ') THEN regexp_replace(b, '(?i)^has the (response|answer) ', 'The response should have ') ELSE {c.sql_strip('y')} END"""
_STOP = "['a', 'an', 'and', 'are', 'as', 'at', 'be', 'by', 'for', 'in', 'is', 'of', 'on', 'or', 'should', 'that', 'the', 'to', 'with']"
def _tidy(x: str) -> str:
    out = c.sql_quotes(c.sql_collapse(x))
    for pattern, fixed in tasks.SENTENCE_FIXES:
        out = f"regexp_replace({out}, '(?i){pattern}', '{fixed}', 'g')"
    return f"(CASE WHEN rtrim({out}, '.;?') = '' THEN '' ELSE rtrim({out}, '.;?') || '.' END)"


_RULES = " ".join(f"WHEN regexp_matches(b, '(?i){p}') THEN regexp_replace(b, '(?i){p}', '{r}')" for p, r in tasks.QUESTION_RULES)
_VERB = "CASE kind " + " ".join(f"WHEN '{k}' THEN '{w}'" for k, w in tasks.TASK_VERBS.items() if k) + f" ELSE '{tasks.TASK_VERBS['']}' END"
_FILTER = f"""WITH {c.GEN}, {VERIFY}, ps AS (SELECT rec, i, item, min(i) OVER (PARTITION BY rec, {c.sql_collapse('lower(item)')}) AS f FROM ver WHERE reason = 'rule_pass'),
fresh AS (SELECT rec, i, item FROM ps WHERE i = f), {c.sql_greedy('fresh', 0.9)},
jd AS (SELECT v.rec, v.i, CASE WHEN v.reason <> 'rule_pass' THEN v.reason WHEN p.f < v.i THEN 'exact_duplicate' WHEN NOT list_contains(k.kept, v.i) THEN 'semantic_duplicate' END AS reason,
  CASE WHEN p.f < v.i THEN p.f ELSE list_min(list_filter(n.n, lambda x: list_contains(k.kept, x))) END AS of
  FROM ver v LEFT JOIN ps p ON p.rec = v.rec AND p.i = v.i LEFT JOIN kept k ON k.rec = v.rec LEFT JOIN near n ON n.rec = v.rec AND n.j = v.i),
fi AS (SELECT rec, i, of, coalesce(reason, CASE WHEN count(*) FILTER (reason IS NULL) OVER (PARTITION BY rec ORDER BY i) > %d THEN 'max_items_exceeded' ELSE 'rule_pass' END) AS reason, reason AS why FROM jd)"""
#: Letters of any alphabet continue a word, which RE2's \\b does not know.
SIGNED = tasks.SIGNATURE.replace("\\b", "(?:^|[^\\p{L}\\p{N}_])", 1)
_WORDS = f"len({c.sql_tokens('item')})"
ORACLE_SQL = {
    "filter_items": f"{_FILTER % 8} SELECT lang, reason, count(*) AS n, count(of) FILTER (why IN ('exact_duplicate', 'semantic_duplicate')) AS n_pointing FROM fi JOIN documents ON doc_id = rec GROUP BY ALL",
    "staged_summary": f"{_FILTER % 1_000_000_000} SELECT reason = 'rule_pass' AS valid, count(*) AS n, count(DISTINCT rec) AS records FROM fi GROUP BY ALL",
    "union_items": f"""WITH {c.GEN}, {c.PAIRING}, u AS (SELECT p.gold_id AS rec, row_number() OVER (PARTITION BY p.gold_id ORDER BY p.lang <> 'en', g.rec, g.i) - 1 AS i, item FROM gen g JOIN pairing p ON p.rec = g.rec),
        fresh AS (SELECT rec, i, item FROM u QUALIFY row_number() OVER (PARTITION BY rec, {c.sql_collapse('lower(item)')} ORDER BY i) = 1), {c.sql_greedy('fresh', 0.9)}
        SELECT f.rec, count(*) AS n_items, sum(length(item))::BIGINT AS chars FROM fresh f JOIN kept k ON k.rec = f.rec AND list_contains(k.kept, f.i) GROUP BY f.rec""",
    "consolidate_items": f"""WITH {c.GEN}, sc AS (SELECT rec, i, item, {sql_category('item')} AS dim, {_WORDS} AS n FROM gen), sd AS (SELECT rec, i, item, dim, (n BETWEEN 5 AND 40)::INT * 2 + regexp_matches(item, '[0-9]')::INT + regexp_matches(item, '[.!?]$')::INT + (dim <> 'completeness')::INT - (n < 4)::INT * 2 AS score FROM sc),
        bs AS (SELECT * FROM sd QUALIFY row_number() OVER (PARTITION BY rec, dim ORDER BY score DESC, i) = 1), rk AS (SELECT rec, row_number() OVER (PARTITION BY rec ORDER BY score DESC, i) - 1 AS i, item, score FROM bs), {c.sql_greedy('rk', 0.9)},
        o AS (SELECT r.rec, r.item, r.score FROM rk r JOIN kept k ON k.rec = r.rec AND list_contains(k.kept, r.i) QUALIFY row_number() OVER (PARTITION BY r.rec ORDER BY r.i) <= 5)
        SELECT rec, count(*) AS n_items, sum(length(item))::BIGINT AS chars, sum(score)::DOUBLE AS score FROM o GROUP BY rec""",
    "normalize_gold": f"WITH {_REC} SELECT pos, sha256(query) AS query_sha256, sha256(array_to_string({_ITEMS}, chr(10))) AS cells FROM fst WHERE len({_ITEMS}) > 0",
    "normalize_query_pool": f"WITH {_REC} SELECT pos, sha256(query) AS query_sha256, 'unknown' AS cells FROM fst",
    "normalize_preference": f"WITH {_REC} SELECT pos, sha256(query) AS query_sha256, sha256(CASE WHEN pos % 3 = 0 THEN r[1] || '|' || r[2] ELSE r[2] || '|' || r[1] END) AS cells FROM fst WHERE pos % 3 < 2 AND nullif(r[1], '') IS NOT NULL AND nullif(r[2], '') IS NOT NULL",
    "normalize_multicandidate": f"WITH {_REC} SELECT pos, sha256(query) AS query_sha256, sha256(array_to_string({_LIST}, '|') || '|0') AS cells FROM fst WHERE len({_LIST}) >= 2",
    "sim_components": f"""WITH RECURSIVE {c.GOLD}, {c.sql_counts('a', 'gold', 'gold_id, g')}, n AS (SELECT row(gold_id, g) AS id FROM gold),
        e AS (SELECT row(x.gold_id, x.g) AS u, row(y.gold_id, y.g) AS w FROM a x JOIN a y ON x.token = y.token AND (x.gold_id, x.g) <> (y.gold_id, y.g) GROUP BY x.gold_id, x.g, y.gold_id, y.g HAVING sum(x.c * y.c) / sqrt(any_value(x.nn) * any_value(y.nn)) >= 0.75),
        reach(item, v) AS (SELECT id, id FROM n UNION SELECT r.item, e.w FROM reach r JOIN e ON e.u = r.v)
        SELECT item[1] || ':' || item[2] AS item, min(v)[1] || ':' || min(v)[2] AS component FROM reach GROUP BY item""",
    "task_types": f"""SELECT CASE WHEN role = 'healthbench' OR {_any('l', tasks.MEDICAL)} THEN 'medical_advice' WHEN contains(l, 'keyword') OR contains(l, 'exactly') AND contains(l, 'response') THEN 'instruction_following'
        WHEN {_any('l', tasks.WRITING)} AND {_any('l', tasks.CREATIVE)} THEN 'creative_writing' WHEN {_any('l', tasks.WRITING)} THEN 'writing_task' WHEN {_any('l', tasks.UNSAFE)} THEN 'safety_refusal'
        WHEN {_any("(' ' || l || ' ')", tasks.CODE)} OR regexp_matches(text, '{SIGNED}') THEN 'code_generation' WHEN regexp_matches({c.sql_marked('l')}, '{tasks.MATH_WORDS}') OR regexp_matches(l, '{tasks.MATH_TERM}') THEN 'math_problem'
        WHEN {_any('l', tasks.HISTORY)} THEN 'historical_uncertain_fact' WHEN {_any('l', tasks.AMBIGUOUS)} THEN 'ambiguous_fact_qa' ELSE 'general_task' END AS task_type, role, count(*) AS n FROM (SELECT role, text, lower(text) AS l FROM conversations) GROUP BY ALL""",
    "declarative_items": f"""WITH {c.GOLD}, s1 AS (SELECT gold_id, g, item, {c.sql_strip("regexp_replace(item, '^[A-Z][A-Za-z /&-]{1,40}:[ ]+', '')")} AS y FROM gold), s2 AS (SELECT *, {_BARE} AS b FROM s1),
        s3 AS (SELECT *, {c.sql_strip(c.sql_collapse(_STATEMENT))} AS f FROM s2), s4 AS (SELECT *, upper(substr(f, 1, 1)) || substr(f, 2) AS u FROM s3)
        SELECT gold_id, g, CASE WHEN f = '' THEN '' WHEN regexp_matches(u, '[.!?。！？]$') THEN u ELSE regexp_replace(u, '[,;:]+$', '') || '.' END AS statement,
        sha256(array_to_string(list_filter({c.sql_tokens('item')}, lambda w: NOT list_contains({_STOP}, w)), ' ')) AS content_sha256 FROM s4""",
    "statement_items": f"""WITH {c.GOLD}, s1 AS (SELECT gold_id, g, {_tidy("[" + ", ".join(f"'{a}'" for a in ASKED) + f"][g % {len(ASKED)} + 1] || item || '?'")} AS x FROM gold),
        s2 AS (SELECT gold_id, g, CASE WHEN regexp_matches(x, '{tasks.LABEL}') THEN {c.sql_strip(f"regexp_extract(x, '{tasks.LABEL}', 1)")} ELSE x END AS y FROM s1),
        s3 AS (SELECT gold_id, g, y, {c.sql_strip("regexp_replace(regexp_replace(y, '\\.+$', ''), '\\?+$', '')")} AS b FROM s2), s4 AS (SELECT gold_id, g, CASE {_RULES} END AS m, y FROM s3),
        s5 AS (SELECT gold_id, g, {_tidy("coalesce(m, y)")} AS statement, CASE g % 3 WHEN 0 THEN 'math_problem' WHEN 1 THEN 'simple_fact_qa' ELSE 'other' END AS kind FROM s4)
        SELECT gold_id, g, statement, CASE WHEN regexp_matches(lower(statement), '^({'|'.join(tasks.VERB_STARTS)})') THEN statement ELSE {_VERB} || ' ' || lower(substr(statement, 1, 1)) || substr(statement, 2) END AS criterion FROM s5""",
    "keyword_concerns": "SELECT concern, lang, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS concern, lang FROM documents WHERE {_any('lower(text)', w)}" for k, w in KEYWORDS.items()) + ") GROUP BY ALL",
    "resume_pairs": """SELECT o_custkey, o_orderpriority, max(o_orderkey) AS pos FROM orders o WHERE o_orderstatus <> 'F' AND NOT EXISTS (SELECT 1 FROM orders d WHERE d.o_orderstatus = 'F' AND d.o_custkey = o.o_custkey AND d.o_orderpriority = o.o_orderpriority) GROUP BY ALL""",
}
ORACLE_SQL["schema_choice"] = f"""WITH n AS ({' UNION ALL '.join(f"SELECT {k} AS k, '{t}' AS target, count(*) AS n FROM ({ORACLE_SQL[f'normalize_{t}']})" for k, t in enumerate(TRIED))})
    SELECT target, n, coalesce(k = (SELECT min(k) FROM n WHERE n >= {ENOUGH}), false) AS chosen FROM n"""
