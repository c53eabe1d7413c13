"""Queries over nested prompts and item lists, carried by conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievecraft.catalog import carriers as c
from sievecraft.functions.text import expand_items
from sievecraft.operators.flatten import flatten_text
from sievecraft.sources.records import table


def _shaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pos and prompt: each turn as plain text, broken JSON, a chat, an object of several fields, or JSON inside JSON text."""
    x = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("pos"), "role", "text")
    message = F.struct("role", F.col("text").alias("content"))
    chat = F.to_json(F.array(message, message))
    deep = F.to_json(F.struct(F.lit(1).alias("n"), F.col("text").alias("z"), F.array(F.lit(""), F.lit("  "), chat, F.lit("[]")).alias("b"), F.struct(F.col("role").alias("y"), F.lit("").alias("x")).alias("a")))
    k = F.col("pos") % 6
    shape = F.when(k == 0, F.col("text")).when(k == 1, F.concat(F.lit("[ "), F.col("text"))).when(k == 2, chat).when(k == 3, deep).when(k == 4, F.to_json(F.array(deep, F.lit("x"), chat))).otherwise(F.concat(F.lit(" "), F.to_json(F.struct(F.array(chat, deep).alias("content"), F.lit("gone").alias("other")))))
    return x.select("pos", shape.alias("prompt"))


def flattened_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts of all shapes as one text each."""
    return flatten_text(_shaped(spark, sf_dir), "pos", "prompt").select("pos", F.sha2("text", 256).alias("text_sha256"), F.length("text").cast("long").alias("n_chars"))


def _listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pos and items: lines of a turn, every other turn's as a JSON list with a tail, as an object, or as broken JSON beside a blank."""
    x = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("pos"), F.split("text", "\n").alias("l"), "text")
    k = F.col("pos") % 4
    odd = F.when(k == 0, F.concat(F.to_json("l"), F.lit(" and so on"))).when(k == 1, F.to_json(F.struct(F.col("text").alias("criterion")))).when(k == 2, F.lit("[broken")).otherwise(F.lit("  "))
    return x.select("pos", F.concat(F.array(odd), "l").alias("items"))


def _expanded(keep_blank: bool):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = expand_items(F.col("items"), keep_blank)
        return _listed(spark, sf_dir).select("pos", F.size(out).cast("long").alias("n_items"), F.sha2(F.array_join(out, "\n"), 256).alias("items_sha256"))

    query.__name__ = "expanded_items_with_blanks" if keep_blank else "expanded_items"
    return query


QUERIES = {f.__name__: f for f in (flattened_prompts, _expanded(False), _expanded(True))}

_POS = "conv_id * 100 + turn"
_CHAT = "to_json([{'role': role, 'content': text}, {'role': role, 'content': text}])::VARCHAR"
_DEEP = f"to_json({{'n': 1, 'z': text, 'b': ['', '  ', {_CHAT}, '[]'], 'a': {{'y': role, 'x': ''}}}})::VARCHAR"
_FALSE = "(type IN ('NULL') OR value::VARCHAR IN ('0', '0.0', 'false', '\"\"', '[]', '{}'))"
_ITEM = lambda x: f"list_filter(list_transform({x}, lambda y: {c.sql_clean('y')}), lambda y: y <> '')"


def _listed_sql(blank: bool) -> str:
    items = "list_prepend(CASE k WHEN 0 THEN to_json(l)::VARCHAR || ' and so on' WHEN 1 THEN to_json({'criterion': text})::VARCHAR WHEN 2 THEN '[broken' ELSE '  ' END, l)"
    # Broken JSON is read as lines, that is, as itself.
    front = "regexp_extract(t, '(?s)^(\\[.*\\])', 1)"
    return f"""WITH x AS (SELECT {_POS} AS pos, ({_POS}) % 4 AS k, text, string_split(text, chr(10)) AS l FROM conversations), y AS (SELECT pos, unnest({items}) AS i, unnest(range(len(l) + 1)) AS n FROM x),
        z AS (SELECT pos, n, {c.sql_strip('i')} AS t FROM y),
        w AS (SELECT pos, n, CASE WHEN json_valid({front}) THEN {_ITEM(f"from_json(CASE WHEN json_valid({front}) THEN {front} END, '[\"VARCHAR\"]')")} WHEN t LIKE '{{%' AND json_valid(t) THEN {_ITEM("[json_extract_string(CASE WHEN json_valid(t) THEN t END, '$.criterion')]")} ELSE list_filter([t], lambda y: {'true' if blank else "y <> ''"}) END AS o FROM z),
        e AS (SELECT pos, flatten(list(o ORDER BY n)) AS o FROM w GROUP BY pos) SELECT pos, len(o) AS n_items, sha256(array_to_string(o, chr(10))) AS items_sha256 FROM e"""


ORACLE_SQL = {
    "flattened_prompts": f"""WITH RECURSIVE x AS (SELECT {_POS} AS pos, ({_POS}) % 6 AS k, role, text FROM conversations),
        p AS (SELECT pos, {c.sql_strip(f"CASE k WHEN 0 THEN text WHEN 1 THEN '[ ' || text WHEN 2 THEN {_CHAT} WHEN 3 THEN {_DEEP} WHEN 4 THEN to_json([{_DEEP}, 'x', {_CHAT}])::VARCHAR ELSE ' ' || to_json({{'content': [{_CHAT}, {_DEEP}], 'other': 'gone'}})::VARCHAR END")} AS t FROM x),
        r(pos, path, t, nested) AS (SELECT pos, []::INT[], t, regexp_matches(t, '^[\\[{{]') AND json_valid(t) FROM p UNION ALL
          SELECT pos, list_append(path, n), t, regexp_matches(t, '^[\\[{{]') AND json_valid(t) FROM (SELECT pos, path, n, {c.sql_strip('t')} AS t FROM (
            SELECT r.pos, r.path, unnest(range(greatest(len(c), 1)))::INT AS n, unnest(CASE WHEN len(c) = 0 THEN [''] ELSE c END) AS t FROM r, LATERAL (
              SELECT coalesce(list(CASE WHEN type = 'VARCHAR' THEN json_extract_string(value, '$') ELSE value::VARCHAR END ORDER BY id), []) AS c FROM json_each(CASE WHEN r.nested THEN r.t ELSE '[]' END) j
              WHERE CASE WHEN starts_with(r.t, '[') THEN NOT {_FALSE} WHEN json_exists(CASE WHEN r.nested THEN r.t ELSE '[]' END, '$.content') THEN key = 'content' ELSE type IN ('VARCHAR', 'ARRAY', 'OBJECT') END) WHERE r.nested))),
        f AS (SELECT pos, array_to_string(list({c.sql_collapse('t')} ORDER BY path), ' ') AS t FROM r WHERE NOT nested GROUP BY pos) SELECT pos, sha256(t) AS text_sha256, length(t) AS n_chars FROM f""",
    "expanded_items": _listed_sql(False),
    "expanded_items_with_blanks": _listed_sql(True),
}
