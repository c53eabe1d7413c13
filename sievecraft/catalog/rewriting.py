"""Queries over rewrites of criteria until stable, poor and generic ones, polishing and consolidation.

The lines of `documents` are a document's criteria, behind openings that the rewrites are about; its first line is the task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievecraft.catalog import carriers as c
from sievecraft.functions import dimensions as d
from sievecraft.functions import surface as sf
from sievecraft.functions import tasks
from sievecraft.functions.tasks import task_type
from sievecraft.functions.text import clean_item
from sievecraft.operators import criteria as cr
from sievecraft.sources.records import table

#: What stands before a document's lines in turn.
SHELLS = (
    "The response should ensure that ", "Provides the document should ", "Provides clearly states ", "States if ", "States explicitly states ", "Implements is ", "Provides satisfies the reader, ", "Does the answer ", "Is the response clearly ",
    "Completeness: provides ", "The document clearly identifies ", "Information is ", "Mentions ", "Provides describes presents ", "Provides satisfies all, implements presents ", "Credible sources for ", "Names the exact ", "Tone: How well does the plan ", "If asked , does the text ",
    "stays focused on ", "States directly states explicitly states is ", "For all, does the model ", "provides states does not ", "Does each line include ", "Can it ", "", "Evidence is official for ", "- ",
)


def shelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = c.generated(spark, sf_dir)
    shell = F.element_at(F.array(*map(F.lit, SHELLS)), ((F.col("rec") + F.col("i")) % len(SHELLS) + 1).cast("int"))
    return items.select("rec", "i", F.concat(shell, F.col("item")).alias("item"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec, task (the first line), source and kind of each document."""
    docs = c.texts(spark, sf_dir).select(F.col("doc_id").alias("rec"), clean_item(F.substring_index("text", "\n", 1)).alias("task"))
    return docs.withColumn("source", F.lit("pool")).withColumn("kind", task_type(F.col("task"), F.col("source")))


def surface_rewrites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct criteria as they are when no round of the rewrite changes them, and after how many rounds that is."""
    opened = sf.unshelled(sf.imperative(sf.stated(F.col("item")), F.lit("general_task")))
    out = cr.until_stable(shelled(spark, sf_dir).select(opened.alias("text")), "text", sf.one_round)
    return out.select(F.sha2("text", 256).alias("text_sha256"), F.col("rounds").cast("long").alias("rounds"), sf.finished(F.col("result")).alias("criterion"))


def criterion_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Poor, generic and source-naming criteria, and their scores, told by the terms of their own task."""
    rows = shelled(spark, sf_dir).join(records(spark, sf_dir).select("rec", sf.task_terms(F.col("task")).alias("terms")), "rec")
    x = F.col("item")
    # Columns of their own, so that the score does not run the tests again.
    tests = {"bad_prefix": sf.is_bad_prefix(x), "poor": sf.is_poor_surface(x), "worn": sf.is_worn(x), "sources": sf.names_sources(x)}
    rows, known = rows.withColumns(tests), {k: F.col(k) for k in tests}
    return rows.select("rec", F.col("i").cast("long").alias("i"), "bad_prefix", "poor", sf.is_generic(x, F.col("terms"), F.col("worn")).alias("generic"), "sources", F.round(sf.criterion_score(x, F.col("terms"), known), 6).alias("score"))


def corpus_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cr.corpus_counters(shelled(spark, sf_dir), records(spark, sf_dir))
    return out.select(*[F.round(k, 9).alias(k) if k.endswith("_rate") else k for k in out.columns])


def response_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Criteria of many forms as sentences about the response."""
    rows = shelled(spark, sf_dir)
    return rows.select("rec", F.col("i").cast("long").alias("i"), sf.asserted(sf.response_statement(F.col("item"))).alias("statement"))


def polished_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's criteria, polished: the best of each key where the key was first seen, at most ten."""
    return cr.polish(shelled(spark, sf_dir), 10).select("rec", F.col("place").cast("long").alias("place"), "item")


def sources_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's criteria with one about sources at most, the last."""
    rows = shelled(spark, sf_dir).join(records(spark, sf_dir).select("rec", sf.task_terms(F.col("task")).alias("terms")), "rec")
    rows = rows.select("rec", F.col("i").alias("place"), F.col("i").cast("long").alias("i"), "item", sf.criterion_score(F.col("item"), F.col("terms")).alias("score"))
    return cr.sources_last(rows).select("rec", F.col("place").cast("long").alias("place"), "i")


#: What is asked beside the turns of a conversation.
ASIDES = ("", "Where does the river end?", "The birthday of Berlusconi", "Write fibfib")


def added_criteria(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Criteria that conversation turns add, each with an aside, by its kind of task and source."""
    x = table(spark, sf_dir, "conversations")
    turn = lambda options: F.element_at(F.array(*map(F.lit, options)), (F.col("conv_id") % len(options) + 1).cast("int"))
    x = x.select(F.struct("conv_id", "turn").alias("rec"), F.concat_ws(" ", "text", turn(ASIDES)).alias("task"), turn(("beir_nq", "pool", "beir_nq")).alias("source"), turn(tuple(cr.BOUNDS)).alias("kind"))
    return cr.added_criteria(x).groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.min("rec.conv_id").alias("first_conv"))


def consolidated_criteria(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's lines as its final criteria."""
    return cr.consolidate_criteria(shelled(spark, sf_dir), records(spark, sf_dir)).select("rec", F.col("place").cast("long").alias("place"), "item")


QUERIES = {f.__name__: f for f in (surface_rewrites, criterion_flags, corpus_counters, response_statements, polished_items, sources_last, added_criteria, consolidated_criteria)}

q = c.sql_quote


def _replaced(x: str, rules: tuple[tuple[str, str], ...]) -> str:
    wide = any("\\b" in pattern for pattern, _ in rules)
    x = c.sql_marked(x) if wide else x
    for pattern, form in rules:
        x = f"regexp_replace({x}, {q('(?i)' + pattern)}, {q(form)}, 'g')"
    return c.sql_unmarked(x) if wide else x


def _tidy(x: str, fixes: tuple = tasks.SENTENCE_FIXES, empty: str = "''") -> str:
    """A tidy sentence; x must be short, as it stands here more than once."""
    return f"(SELECT CASE WHEN t = '' THEN {empty} ELSE t || '.' END FROM (SELECT rtrim({_replaced('v', fixes)}, '.;?') AS t FROM (SELECT {c.sql_quotes(c.sql_collapse(x))} AS v)))"


def _steps(name: str, source: str, keys: str, *steps: tuple[str, str]) -> str:
    """CTEs that each add or change one column x of a source."""
    out, last = [], source
    for k, (column, expression) in enumerate(steps):
        out.append(f"{name}{k} AS (SELECT {keys}, {expression} AS {column} FROM {last})")
        last = f"{name}{k}"
    return ",\n".join([*out, f"{name} AS (SELECT * FROM {last})"])


_ITEMS = f"{c.GEN}, sh AS (SELECT rec, i, [{', '.join(map(q, SHELLS))}][(rec + i) % {len(SHELLS)} + 1] || item AS item FROM gen)"
_ACTS = f"regexp_matches({c.sql_marked('x')}, '^({d.ACTIONS})\\b')"
_WITH_VERB = f"CASE WHEN {_ACTS} OR regexp_matches(lower(x), '^({'|'.join(tasks.VERB_STARTS)})') THEN x ELSE 'Provides ' || lower(substr(x, 1, 1)) || substr(x, 2) END"
_LABEL = f"CASE WHEN regexp_matches(x, {q(tasks.LABEL)}) THEN {c.sql_strip(f'regexp_extract(x, {q(tasks.LABEL)}, 1)')} ELSE x END"
_BARE = c.sql_strip("regexp_replace(regexp_replace(x, '\\.+$', ''), '\\?+$', '')")
_ASKED = "CASE " + " ".join(f"WHEN regexp_matches(b, {q('(?i)' + p)}) THEN regexp_replace(b, {q('(?i)' + p)}, {q(r)})" for p, r in tasks.QUESTION_RULES) + " END"
_OPENED = [("x", _tidy("x")), ("x", _LABEL), ("x", _tidy("x")), ("x", _LABEL), ("x", _tidy("x")), ("x", _replaced("x", sf.OPENINGS)), ("x", _tidy("x")), ("x", _WITH_VERB), ("x", _tidy("x")), ("x", _tidy("x")), ("x", _replaced("x", sf.SHELLS))]
_ROUND = _tidy(f"(CASE WHEN regexp_matches(now, '(?i)^(?:{sf.ROUND_STARTS})') THEN {_replaced('now', sf.ROUND)} ELSE now END)")
_TERMS_OF = lambda x: f"list_filter(regexp_extract_all(lower({x}), '[a-z0-9_]+'), lambda w: NOT list_contains([{', '.join(map(q, sf.TASK_STOP))}], w))"
_TASK = f"tk AS (SELECT doc_id AS rec, {c.sql_clean('string_split(coalesce(text, chr(0)), chr(10))[1]')} AS task FROM documents), te AS (SELECT rec, list_distinct(list_filter({_TERMS_OF('task')}, lambda w: length(w) >= 3 OR regexp_matches(w, '^[0-9]+$'))) AS terms FROM tk)"
#: Letters of any alphabet continue a word, which RE2's \\b does not know.
_ENDED = "(?:$|[^\\p{L}\\p{N}_])"
_PREFIX = f"(regexp_matches(x, {q('(?i)' + sf.BAD_PREFIX.removesuffix(chr(92) + 'b') + _ENDED)}) OR regexp_matches(x, {q('(?i)' + sf.ASKS.removesuffix(chr(92) + 'b') + _ENDED)}))"
_POOR = f"(y = '' OR regexp_matches(y, {q('(?i)' + sf.BAD_SURFACE)}) OR regexp_matches(y, {q('(?i)' + sf.BAD_GRAMMAR)}) OR regexp_matches(y, '^[a-z]'))"
_WORN = f"regexp_matches(x, {q('(?i)' + '|'.join(f'(?:{p})' for p in sf.GENERIC))})"
_SOURCES = f"regexp_matches(x, {q('(?i)' + sf.SOURCES)})"
_MARKED = " + ".join(f"contains(lower(x), {q(m.lower())})::INT" for m in sf.MARKERS)
_FLAGS = f"""{_ITEMS}, {_TASK}, fa AS (SELECT s.rec, s.i, s.item AS x, {_tidy('s.item')} AS y, {_TERMS_OF('s.item')} AS w, te.terms FROM sh s JOIN te ON te.rec = s.rec),
fl AS (SELECT rec, i, x, y, {_PREFIX} AS bad_prefix, {_POOR} AS poor, regexp_matches(x, {q('(?i)' + sf.ALWAYS_GENERIC)}) OR {_WORN} AND NOT list_has_any(w, terms) AS generic, {_SOURCES} AS sources,
  least(len(w), 28) / 20.0::DOUBLE + least(len(list_intersect(w, terms)), 6) * 1.2::DOUBLE + CASE WHEN {_ACTS} THEN 2.0::DOUBLE ELSE 0 END - CASE WHEN {_PREFIX} THEN 6.0::DOUBLE ELSE 0 END - CASE WHEN {_POOR} THEN 4.0::DOUBLE ELSE 0 END
  - CASE WHEN {_WORN} AND NOT list_has_any(w, terms) THEN 5.0::DOUBLE ELSE 0 END - CASE WHEN {_SOURCES} THEN 0.2::DOUBLE ELSE 0 END + ({_MARKED}) AS score FROM fa)"""
_SURFACE_KEY = c.sql_surface("x", f"{d.STOP}|{d.MORE_STOP}")
_WRITTEN_KEY = c.sql_surface("x", d.STOP)


def _written(x: str) -> str:
    return f"(SELECT CASE WHEN v = '' THEN '' ELSE rtrim({_replaced('v', sf.WRITTEN_FIXES)}, '.;?') || '.' END FROM (SELECT {c.sql_quotes(c.sql_collapse(x))} AS v))"


_QUESTION = c.sql_strip(f"regexp_extract(x, {q(sf.QUESTION_LABEL)}, 1)")
_TOLD = c.sql_strip(f"regexp_extract(x, {q(sf.QUALITY_LABEL)}, 1)")
_UNLABELLED = f"""CASE WHEN regexp_matches(x, {q(sf.QUESTION_LABEL)}) AND regexp_matches({c.sql_marked(_QUESTION)}, {q('(?i)' + sf.QUESTION_BODY)}) THEN {_QUESTION}
  WHEN regexp_matches(x, {q(sf.QUALITY_LABEL)}) THEN CASE WHEN regexp_matches({_TOLD}, {q('(?i)' + sf.QUALITY_BODY)}) THEN 'The response should ' || {_TOLD} ELSE {_TOLD} END ELSE x END"""
_BASE = "CASE " + " ".join(f"WHEN starts_with(lower(r), {q(v)}) THEN {q(b)} || substr(r, {len(v) + 1})" for v, b in sf.BASE_FORMS.items()) + " ELSE r END"
_VERB = "CASE lower(r) " + " ".join(f"WHEN {q(v)} THEN {q(b)}" for v, b in sf.BASE_FORMS.items()) + " ELSE lower(r) END"
_GROUP = lambda p, k: f"regexp_extract(x, {q('(?i)' + p)}, {k})"
_SUBJECT = f"""CASE WHEN regexp_matches(x, {q('(?i)' + sf.SUBJECT)}) THEN {_written(f"(SELECT 'The response should ' || {_BASE} FROM (SELECT {_GROUP(sf.SUBJECT, 1)} AS r))")}
  WHEN regexp_matches(x, {q('(?i)' + sf.OPENING_VERB)}) THEN {_written(f"(SELECT 'The response should ' || {_VERB} || ' ' || {_GROUP(sf.OPENING_VERB, 2)} FROM (SELECT {_GROUP(sf.OPENING_VERB, 1)} AS r))")} ELSE x END"""


def _rule(pattern: str, form: str) -> str:
    p = "(?i)" + pattern
    if form.startswith("\\1 "):
        one = f"regexp_extract(b, {q(p)}, 1)"
        return f"WHEN regexp_matches(b, {q(p)}) THEN upper(substr({one}, 1, 1)) || lower(substr({one}, 2)) || regexp_replace(b, {q(p)}, {q(form[2:])})"
    return f"WHEN regexp_matches(b, {q(p)}) THEN regexp_replace(b, {q(p)}, {q(form)})"


_RESPONSE = "CASE " + " ".join(_rule(p, f) for p, f in sf.RESPONSE_RULES) + " ELSE x END"
_REFUSED = "(?i)^Does not\\s+(.+)$"
_HOW = sf.RESPONSE_RULES[11]
_STATED = [("x", c.sql_quotes(c.sql_collapse("x"))), ("x", _UNLABELLED), ("x", _replaced("x", (sf.APPLICABLE,))), ("x", _SUBJECT), ("x", f"CASE WHEN x = '' THEN '' ELSE (SELECT {_RESPONSE} FROM (SELECT {c.sql_strip('rtrim(rtrim(x, chr(46)), chr(63))')} AS b)) END"), ("x", _written("x")),
           ("x", f"CASE WHEN regexp_matches(x, {q(_REFUSED)}) THEN regexp_replace(x, {q(_REFUSED)}, 'The response should not \\1') ELSE {_replaced('x', (_HOW,))} END"), ("x", _written("x"))]
_STATEMENTS = f"{_ITEMS}, so AS (SELECT rec, i, item AS x FROM sh), " + _steps("st", "so", "rec, i", *_STATED)
_WRITTEN_SCORE = f"CASE WHEN regexp_matches(x, '{sf.WRITTEN_OPENINGS}') THEN 3.0::DOUBLE ELSE 0 END - CASE WHEN ends_with({c.sql_strip('x')}, '?') THEN 4.0::DOUBLE ELSE 0 END" + "".join(f" + CASE WHEN {' OR '.join(f'contains(lower(x), {q(w)})' for w in words)} THEN {v}::DOUBLE ELSE 0 END" for words, v in sf.WRITTEN_WORDS) + f" + least(len(list_filter(string_split({c.sql_strip(c.sql_collapse('x'))}, ' '), lambda w: w <> '')), 28) / 100.0::DOUBLE"


def _added_sql() -> str:
    turn = lambda options: f"[{', '.join(map(q, options))}][conv_id % {len(options)} + 1]"
    parts = []
    for kinds, sources, groups, criteria in sf.ADDED:
        tests = [f"{c_} IN ({', '.join(map(q, some))})" for c_, some in (("kind", kinds), ("source", sources)) if some]
        tests += ["(" + " OR ".join(f"contains(l, {q(w)})" for w in words) + ")" for words in groups]
        parts += [f"SELECT conv_id, {q(x)} AS item FROM k WHERE {' AND '.join(tests)}" for x in criteria]
    return f"""WITH k AS (SELECT conv_id, lower(concat_ws(' ', text, {turn(ASIDES)})) AS l, {turn(("beir_nq", "pool", "beir_nq"))} AS source, {turn(tuple(cr.BOUNDS))} AS kind FROM conversations), a AS ({' UNION ALL '.join(parts)})
        SELECT item, count(*) AS n, min(conv_id) AS first_conv FROM a GROUP BY item"""


ORACLE_SQL = {
    "surface_rewrites": f"""WITH RECURSIVE {_ITEMS}, o AS (SELECT DISTINCT item AS x FROM sh), {_steps('a', 'o', '1', _OPENED[0], _OPENED[1])}, ab AS (SELECT x, {_BARE} AS b FROM a), ac AS (SELECT coalesce({_ASKED}, x) AS x FROM ab), {_steps('f', 'ac', '1', *_OPENED[2:])},
        rr(text, was, now, n) AS (SELECT DISTINCT x, NULL::VARCHAR, x, -1 FROM f UNION ALL SELECT text, now, {_ROUND}, n + 1 FROM rr WHERE was IS DISTINCT FROM now),
        z AS (SELECT text, n AS rounds, now AS x FROM rr WHERE was = now), {_steps('g', 'z', 'text, rounds', ('x', _replaced('x', sf.REST)), ('x', _tidy('x')), ('x', f"CASE WHEN x = '' THEN '' ELSE {_WITH_VERB} END"), ('x', _tidy('x')))}
        SELECT sha256(text) AS text_sha256, rounds::BIGINT AS rounds, x AS criterion FROM g""",
    "criterion_flags": f"WITH {_FLAGS} SELECT rec, i, bad_prefix, poor, generic, sources, round(score, 6) AS score FROM fl",
    "corpus_counters": f"""WITH {_FLAGS}, r AS (SELECT rec, count(*) AS n, count(DISTINCT {_SURFACE_KEY}) AS k, count(*) FILTER (sources) AS s FROM fl GROUP BY rec),
        t AS (SELECT count(*) AS total_items, count(*) FILTER (bad_prefix) AS bad_prefix_count, count(*) FILTER (poor) AS bad_surface_count, count(*) FILTER (generic) AS generic_count, count(*) FILTER (regexp_matches(x, '^ *[\\[{{]')) AS json_string_count FROM fl)
        SELECT t.*, (SELECT count(*) FROM r WHERE s > 1) AS rows_with_source_overflow, (SELECT count(*) FROM r WHERE k <> n) AS rows_with_duplicate, round(bad_prefix_count / total_items, 9) AS bad_prefix_rate,
        round(bad_surface_count / total_items, 9) AS bad_surface_rate, round(generic_count / total_items, 9) AS generic_rate FROM t""",
    "response_statements": f"WITH {_STATEMENTS} SELECT rec, i, x AS statement FROM st",
    "polished_items": f"""WITH {_STATEMENTS}, k AS (SELECT rec, i, x, {_WRITTEN_KEY} AS k, {_WRITTEN_SCORE} AS score FROM st WHERE x <> ''),
        b AS (SELECT rec, x, min(i) OVER (PARTITION BY rec, k) AS seen FROM k QUALIFY row_number() OVER (PARTITION BY rec, k ORDER BY score DESC, i) = 1)
        SELECT rec, row_number() OVER (PARTITION BY rec ORDER BY seen) AS place, x AS item FROM b QUALIFY place <= 10""",
    "sources_last": f"""WITH {_FLAGS}, b AS (SELECT rec, i, sources FROM fl QUALIFY NOT sources OR row_number() OVER (PARTITION BY rec, sources ORDER BY score DESC, i) = 1)
        SELECT rec, row_number() OVER (PARTITION BY rec ORDER BY sources, i) AS place, i FROM b""",
    "added_criteria": _added_sql(),
}
