"""Queries over text functions, field resolution, the rule verifier and validators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievecraft.catalog import carriers as c
from sievecraft.functions import text as t
from sievecraft.functions import verify as v
from sievecraft.sources.records import get_path, table


def parse_items_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.generated(spark, sf_dir).select(F.col("rec").alias("doc_id"), F.col("i").cast("long").alias("line"), "item")


def parse_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of every document by JSON, else bullets, else lines: number and joined digest."""
    items = t.parse_items(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, "\n"), 256).alias("items_sha256"))


def clean_norm_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(t.join_key(F.col("text")), 256).alias("join_key"), F.sha2(t.query_key(F.col("text")), 256).alias("query_key"))


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = t.tokens(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(words).cast("long").alias("n_tokens"), F.size(F.array_distinct(words)).cast("long").alias("n_distinct"))


def estimate_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", t.estimate_tokens(F.col("text")).alias("estimated"), t.rough_tokens(F.col("text")).alias("rough"))


def text_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small text functions over conversations."""
    x = F.col("text")
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", t.short_example(x).alias("example"), t.lower_first(x).alias("lowered"), t.stable_id(F.col("role"), x).alias("stable_id"), t.normalize_label(F.col("role")).alias("label"), t.parse_score(x).alias("score"),
        t.parse_bool(F.col("role")).alias("flag"), t.parse_number(F.col("turn")).alias("number"),
    )


def alias_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First present field of several, per event."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", t.first_present(F.get_json_object("props", "$.query"), F.get_json_object("props", "$.k"), F.col("event_type")).alias("picked"))


def props_path_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("v", F.try_parse_json("props"))
    return e.select("event_id", get_path(F.col("v"), "k", "key", "page").alias("value"), F.col("v").isNotNull().alias("parsed"))


def schema_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of the JSON records with their number and first example."""
    e = table(spark, sf_dir, "events").select("event_id", F.explode(F.json_object_keys("props")).alias("path"), "props")
    e = e.withColumn("example", F.try_variant_get(F.try_parse_json("props"), "$", "map<string,string>")[F.col("path")])
    return e.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.min_by("example", "event_id").alias("example"))


def rule_verify_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = c.generated(spark, sf_dir)
    return items.groupBy(v.verify_reason(F.col("item")).alias("reason")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("rec").alias("records"))


def validity_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = c.generated(spark, sf_dir).withColumn("valid", (v.verify_reason(F.col("item")) == "rule_pass").cast("int"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("rec"), "lang")
    by = items.join(docs, "rec").groupBy("lang").agg(F.sum("valid").cast("long").alias("n_valid"), F.count(F.lit(1)).alias("n_input"))
    return by.withColumn("validity", F.round(F.col("n_valid") / F.greatest("n_input", F.lit(1)), 6))


def validate_items_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues of each document as a record of items."""
    items = c.generated(spark, sf_dir, "name", "w")
    terms = F.array(*map(F.lit, v.GENERIC_TERMS))
    # Small rows travel: names of a record meet, its items do not.
    names = items.select("rec", "name", F.arrays_overlap("w", terms).alias("generic")).groupBy("rec", "name").agg(F.count(F.lit(1)).alias("n"), F.max("generic").alias("generic"))
    found = names.groupBy("rec").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("d"), F.max("generic").alias("generic"))
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("rec")).join(found, "rec", "left").select(F.col("rec").alias("doc_id"), F.coalesce("n", F.lit(0)).alias("n_items"), F.coalesce(F.col("n") - F.col("d"), F.lit(0)).alias("exact_duplicates"), F.coalesce("generic", F.lit(False)).alias("generic"))
    n = F.col("n_items")
    issues = F.array_compact(F.array(F.when(n == 0, "no_parseable_items"), F.when(n < 3, "too_few_items"), F.when(n > 12, "too_many_items"), F.when(F.col("exact_duplicates") > 0, "exact_duplicates"), F.when(F.col("generic"), "generic_terms")))
    return rows.select("doc_id", "n_items", "exact_duplicates", F.array_join(issues, ",").alias("issues"), (F.size(issues) == 0).alias("ok"))


def issue_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = validate_items_issues(spark, sf_dir).where("issues <> ''")
    return rows.select(F.explode(F.split("issues", ",")).alias("issue")).groupBy("issue").agg(F.count(F.lit(1)).alias("n"))


def failure_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failure classes of conversation turns: a user's text as the error, others' as the response."""
    x = table(spark, sf_dir, "conversations")
    error, response = F.when(F.col("role") == "user", F.col("text")), F.when(F.col("role") != "user", F.col("text"))
    return x.select("role", v.failure_class(error, response, F.col("turn") % 2 == 1).alias("failure")).groupBy("role", "failure").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (parse_items_lines, parse_items, clean_norm_key, token_counts, estimate_tokens, text_scalars, alias_coalesce, props_path_get, schema_profile, rule_verify_reasons, validity_summary, validate_items_issues, issue_counts, failure_histogram)}


def _in(words, x: str) -> str:
    return "(" + " OR ".join(f"contains({x}, {c.sql_quote(w)})" for w in words) + ")"


_RULE = f"regexp_replace({c.sql_collapse(c.sql_strip('item'))}, {c.sql_quote(t.BULLET)}, '')"
_RULE = c.sql_quotes(_RULE)
_GENERIC = "[" + ", ".join(f"'{w}'" for w in v.GENERIC_STANDALONE) + "]"
VERIFY = f"""ver AS (SELECT rec, i, item, CASE WHEN x = '' THEN 'empty' WHEN len(w) < 3 THEN 'too_short'
  WHEN len(w) <= 4 AND list_has_any(w, {_GENERIC}) THEN 'too_generic' WHEN length(x) > 800 THEN 'too_long'
  WHEN starts_with(lower(x), 'return ') OR starts_with(lower(x), 'generate ') OR {_in(('json list', 'candidate answer a', 'candidate answer b'), 'lower(x)')} THEN 'meta_instruction'
  ELSE 'rule_pass' END AS reason FROM (SELECT rec, i, item, x, {c.sql_tokens('x')} AS w FROM (SELECT rec, i, item, {_RULE} AS x FROM gen)))"""
_ISSUES = f"""found AS (SELECT rec, count(*) AS n, count(DISTINCT {c.sql_collapse('lower(item)')}) AS d,
  bool_or(list_has_any({c.sql_tokens('item')}, [{', '.join(f"'{w}'" for w in v.GENERIC_TERMS)}])) AS gen_hit FROM gen GROUP BY rec),
iss AS (SELECT doc_id, coalesce(n, 0) AS n_items, coalesce(n - d, 0) AS exact_duplicates,
  list_filter([CASE WHEN coalesce(n, 0) = 0 THEN 'no_parseable_items' END, CASE WHEN coalesce(n, 0) < 3 THEN 'too_few_items' END, CASE WHEN n > 12 THEN 'too_many_items' END,
    CASE WHEN n - d > 0 THEN 'exact_duplicates' END, CASE WHEN gen_hit THEN 'generic_terms' END], lambda x: x IS NOT NULL) AS l
  FROM documents LEFT JOIN found ON rec = doc_id)"""
_LINES = f"list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: {c.sql_clean('x')}), lambda x: x <> '')"
_MARKED = f"list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: {c.sql_strip('x')}), lambda x: regexp_matches(x, {c.sql_quote(t.BULLET)}))"
# What is left of a line without its bullet is cleaned like any item, so a second bullet goes too.
_UNBULLETED = f"regexp_replace(x, {c.sql_quote(t.BULLET)}, '')"
_BULLETS = f"list_filter(list_transform({_MARKED}, lambda x: {c.sql_clean(_UNBULLETED)}), lambda x: x <> '')"
ORACLE_SQL = {
    # None of the documents is JSON or holds any: what is left of the parser are bullets, else lines.
    "parse_items": f"SELECT doc_id, len(i) AS n_items, sha256(array_to_string(i, chr(10))) AS items_sha256 FROM (SELECT doc_id, CASE WHEN len({_BULLETS}) > 0 THEN {_BULLETS} ELSE {_LINES} END AS i FROM documents)",
    "parse_items_lines": f"WITH {c.GEN} SELECT rec AS doc_id, i AS line, item FROM gen",
    "clean_norm_key": f"SELECT doc_id, sha256({c.sql_strip(c.sql_collapse('''coalesce(text, '')'''))}) AS join_key, sha256({c.sql_collapse('lower(' + c.sql_strip('''coalesce(text, '')''') + ')')}) AS query_key FROM documents",
    "token_counts": f"SELECT doc_id, len({c.sql_tokens('text')}) AS n_tokens, len(list_distinct({c.sql_tokens('text')})) AS n_distinct FROM documents",
    "estimate_tokens": "SELECT doc_id, greatest(1, ceil(length(text) / 3.5))::BIGINT AS estimated, greatest(1, length(text) // 4)::BIGINT AS rough FROM documents",
    "text_scalars": """SELECT conv_id, turn, CASE WHEN length(text) > 160 THEN substr(text, 1, 157) || '...' ELSE text END AS example,
        lower(substr(text, 1, 1)) || substr(text, 2) AS lowered, role || ':' || substr(sha1(role || chr(10) || text), 1, 16) AS stable_id,
        translate(lower(trim(role)), '- ', '__') AS label,
        coalesce(CASE WHEN try_cast(lower(trim(text)) AS DOUBLE) IS NOT NULL THEN greatest(0.0, least(1.0, try_cast(lower(trim(text)) AS DOUBLE))) END, CASE WHEN contains(lower(text), 'yes') OR contains(lower(text), 'satisfied') THEN 1.0 WHEN contains(lower(text), 'no') THEN 0.0 END, 0.0)::DOUBLE AS score,
        CASE WHEN lower(role) IN ('1', 'true', 'yes', 'y', 'correct', 'pass', 'passed') THEN true WHEN lower(role) IN ('0', 'false', 'no', 'n', 'incorrect', 'fail', 'failed') THEN false END AS flag,
        turn::DOUBLE AS number FROM conversations""",
    "alias_coalesce": "SELECT event_id, coalesce(nullif(json_extract_string(props, '$.query'), ''), nullif(json_extract_string(props, '$.k'), ''), nullif(event_type, '')) AS picked FROM events",
    "props_path_get": "SELECT event_id, coalesce(nullif(json_extract_string(props, '$.k'), ''), nullif(json_extract_string(props, '$.key'), ''), nullif(json_extract_string(props, '$.page'), '')) AS value, json_valid(props) AS parsed FROM events",
    "schema_profile": "SELECT path, count(*) AS n, arg_min(json_extract_string(props, '$.' || path), event_id) AS example FROM (SELECT event_id, props, unnest(json_keys(props)) AS path FROM events) GROUP BY path",
    "rule_verify_reasons": f"WITH {c.GEN}, {VERIFY} SELECT reason, count(*) AS n, count(DISTINCT rec) AS records FROM ver GROUP BY reason",
    "validity_summary": f"WITH {c.GEN}, {VERIFY} SELECT lang, count(*) FILTER (reason = 'rule_pass') AS n_valid, count(*) AS n_input, round(count(*) FILTER (reason = 'rule_pass') / count(*), 6) AS validity FROM ver JOIN documents ON doc_id = rec GROUP BY lang",
    "validate_items_issues": f"WITH {c.GEN}, {_ISSUES} SELECT doc_id, n_items, exact_duplicates, array_to_string(l, ',') AS issues, len(l) = 0 AS ok FROM iss",
    "issue_counts": f"WITH {c.GEN}, {_ISSUES} SELECT issue, count(*) AS n FROM (SELECT unnest(l) AS issue FROM iss) GROUP BY issue",
    "failure_histogram": f"""SELECT role, CASE WHEN {_in(('safety', 'refuse', 'cannot comply', "can't comply", 'unable to assist', 'not able to help'), 'e || chr(10) || r')} THEN 'safety_refusal'
        WHEN {_in(('http', 'timeout', 'rate', 'api', 'urlerror', 'connection', 'server', 'quota'), 'e')} THEN 'api_error' WHEN r = '' AND NOT has THEN 'empty_output' WHEN r <> '' AND NOT has THEN 'parse_failure' ELSE 'other_failure' END AS failure, count(*) AS n
        FROM (SELECT role, CASE WHEN role = 'user' THEN lower(coalesce(text, '')) ELSE '' END AS e, CASE WHEN role <> 'user' THEN lower(coalesce(text, '')) ELSE '' END AS r, turn % 2 = 1 AS has FROM conversations) GROUP BY ALL""",
}
