"""How the tables carry the reference's records: views in Spark, and the same as SQL.

Generated items are the lines of `documents`; gold items are the lines of the `benchmark` row that doc_id
modulo the number of rows points to.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievecraft.functions.text import BULLET, QUOTES, TOKEN, WS, clean_item
from sievecraft.operators.items import items_of
from sievecraft.operators.similarity import first_of_key
from sievecraft.sources.records import spread, table


#: What similarity needs of an item.
CUT = ("w", "nn", "d")


def item_rows(rows: DataFrame, key: str) -> DataFrame:
    """key, i and item of the cleaned non-empty lines of text; i is the line's place."""
    return items_of(rows, key)


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def generated(spark: SparkSession, sf_dir: str, *facts: str) -> DataFrame:
    """rec, i and facts (the item alone, if none are named) of the generated items."""
    return items_of(texts(spark, sf_dir), "doc_id", *facts).withColumnRenamed("doc_id", "rec")


def paired(spark: SparkSession, sf_dir: str, *facts: str) -> DataFrame:
    """Generated items with the gold_id of their record."""
    n = table(spark, sf_dir, "benchmark").agg(F.count(F.lit(1)).alias("n"))
    docs = texts(spark, sf_dir).join(F.broadcast(n)).withColumn("gold_id", F.expr("pmod(doc_id, n)"))
    return items_of(docs.select("doc_id", "gold_id", "text"), "doc_id", *facts).withColumnRenamed("doc_id", "rec")


def gold(spark: SparkSession, sf_dir: str, *facts: str) -> DataFrame:
    items = items_of(table(spark, sf_dir, "benchmark").select("item_id", "text"), "item_id", *(facts or ("item",)))
    return items.withColumnRenamed("item_id", "gold_id").withColumnRenamed("i", "g")


def pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "benchmark").agg(F.count(F.lit(1)).alias("n"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("rec"), "lang", "source")
    return docs.join(F.broadcast(n)).select("rec", "lang", "source", F.expr("pmod(rec, n)").alias("gold_id"))


def distinct_gold(spark: SparkSession, sf_dir: str, *facts: str) -> DataFrame:
    items = gold(spark, sf_dir, "item", "name", *facts).withColumnRenamed("g", "i")
    return first_of_key(items, "gold_id").withColumnRenamed("i", "g")


def distinct_generated(spark: SparkSession, sf_dir: str, *facts: str) -> DataFrame:
    return first_of_key(paired(spark, sf_dir, *(facts or ("item",)), "name"), "rec")


def sql_quote(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def sql_collapse(x: str) -> str:
    return f"regexp_replace({x}, {sql_quote(WS + '+')}, ' ', 'g')"


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, {sql_quote(f'^{WS}+|{WS}+$')}, '', 'g')"


def sql_quotes(x: str) -> str:
    return f"regexp_replace({x}, {sql_quote(QUOTES)}, '', 'g')"


def sql_clean(x: str) -> str:
    bare = f"regexp_replace({sql_strip(x)}, {sql_quote(BULLET)}, '')"
    return sql_quotes(sql_collapse(bare))


#: A letter or digit beyond ASCII. It continues a word, which RE2's \\b does not know.
WIDE, MARK = r"([^\x00-\x7F\P{L}]|[^\x00-\x7F\P{Nd}])", "__0__"


def sql_marked(x: str, mark: str = MARK) -> str:
    """x with a mark between ASCII and other letters of one word, so that \\b finds no boundary there."""
    for pattern in (f"([A-Za-z0-9_]){WIDE}", f"{WIDE}([A-Za-z0-9_])"):
        x = f"regexp_replace({x}, {sql_quote(pattern)}, '\\1{mark}\\2', 'g')"
    return x


def sql_unmarked(x: str, mark: str = MARK) -> str:
    return f"replace({x}, '{mark}', '')"


def sql_surface(x: str, stop: str) -> str:
    """Small letters, digits and CJK in order, without the words of stop. No capital is left to be taken for the mark."""
    bare = f"regexp_replace({sql_marked(f'lower({x})', 'Z')}, '\\b({stop})\\b', ' ', 'g')"
    return f"trim(regexp_replace({sql_unmarked(bare, 'Z')}, '[^a-z0-9\\x{{4e00}}-\\x{{9fff}}]+', ' ', 'g'))"


def sql_tokens(x: str) -> str:
    return f"regexp_extract_all(lower({x}), {sql_quote(TOKEN)})"


#: Common table expressions; each list names what it needs before it.
GEN = f"""gen0 AS (SELECT doc_id AS rec, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents),
gen AS (SELECT rec, i, item FROM (SELECT rec, i, {sql_clean('line')} AS item FROM gen0) WHERE item <> '')"""
GOLD = f"""gold0 AS (SELECT item_id AS gold_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS g FROM benchmark),
gold AS (SELECT gold_id, g, item FROM (SELECT gold_id, g, {sql_clean('line')} AS item FROM gold0) WHERE item <> '')"""
PAIRING = "pairing AS (SELECT doc_id AS rec, lang, source, doc_id % (SELECT count(*) FROM benchmark) AS gold_id FROM documents)"
DISTINCT = f"""dgen AS (SELECT rec, i, item FROM gen QUALIFY row_number() OVER (PARTITION BY rec, {sql_collapse('lower(item)')} ORDER BY i) = 1),
dgold AS (SELECT gold_id, g, item FROM gold QUALIFY row_number() OVER (PARTITION BY gold_id, {sql_collapse('lower(item)')} ORDER BY g) = 1)"""


def sql_counts(name: str, source: str, keys: str) -> str:
    """CTE of token counts with squared norms of a source's items."""
    return f"""{name}_t AS (SELECT {keys}, unnest({sql_tokens('item')}) AS token FROM {source}),
{name}_c AS (SELECT {keys}, token, count(*) AS c FROM {name}_t GROUP BY ALL),
{name} AS (SELECT *, sum(c * c) OVER (PARTITION BY {keys}) AS nn FROM {name}_c)"""


def sql_sims(gen: str = "gen", gold_: str = "gold") -> str:
    """CTEs up to sims (rec, g, i, sim) of gold and generated items, and hits (rec, gold_id, g, item, best, best_i)."""
    return f"""{sql_counts('a', gold_, 'gold_id, g')},
{sql_counts('b', gen, 'rec, i')},
sims AS (SELECT b.rec, a.g, b.i, sum(a.c * b.c) / sqrt(any_value(a.nn) * any_value(b.nn)) AS sim
  FROM b JOIN pairing p ON b.rec = p.rec JOIN a ON a.gold_id = p.gold_id AND a.token = b.token GROUP BY ALL),
best AS (SELECT rec, g, max(sim) AS best, arg_max(i, (sim, -i)) AS best_i FROM sims GROUP BY ALL),
hits AS (SELECT p.rec, p.lang, p.source, p.gold_id, o.g, o.item, coalesce(s.best, 0) AS best, s.best_i
  FROM pairing p JOIN {gold_} o ON o.gold_id = p.gold_id LEFT JOIN best s ON s.rec = p.rec AND s.g = o.g)"""


def sql_own(gen: str = "gen") -> str:
    """CTEs up to own (rec, i, j, sim) of the items of one record."""
    return f"""{sql_counts('b', gen, 'rec, i')},
own AS (SELECT x.rec, x.i, y.i AS j, sum(x.c * y.c) / sqrt(any_value(x.nn) * any_value(y.nn)) AS sim
  FROM b x JOIN b y ON x.rec = y.rec AND x.token = y.token AND x.i < y.i GROUP BY ALL)"""


def sql_greedy(source: str, tau: float) -> str:
    """CTEs up to kept (rec, kept): places of a source's items (rec, i, item) kept in order, each below tau with all kept
    before; and near (rec, j, n) with the earlier items that one is near."""
    return f"""{sql_own(source)}, near AS (SELECT rec, j, list(i ORDER BY i) AS n FROM own WHERE sim >= {tau} GROUP BY ALL),
l AS (SELECT g.rec, list({{'i': g.i, 'n': coalesce(n.n, []::BIGINT[])}} ORDER BY g.i) AS xs FROM {source} g LEFT JOIN near n ON n.rec = g.rec AND n.j = g.i GROUP BY g.rec),
kept AS (SELECT rec, list_reduce(list_prepend([]::BIGINT[], list_transform(xs, lambda x: list_prepend(x.i, x.n))), lambda acc, x: CASE WHEN list_has_any(acc, x[2:]) THEN acc ELSE list_append(acc, x[1]) END) AS kept FROM l)"""
