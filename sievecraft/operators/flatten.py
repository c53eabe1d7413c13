"""Prompts of any shape as one text: chats, lists, objects, JSON inside text, to any depth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievecraft.functions.text import collapse, strip
from sievecraft.operators.graph import checkpointed

#: Levels after which a prompt that is still nested is an error.
MOST_LEVELS = 64


def _container(text: Column) -> Column:
    """Whether a text is a JSON list or object, and nothing after it: in a list it is then the only element."""
    alone = F.size(F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), "$", "array<variant>")) == 1
    return F.coalesce(text.rlike(r"^[\[{]") & alone, F.lit(False))


def _said(v: Column) -> Column:
    """A scalar VARIANT as text: nothing for null, zero and false."""
    kind, word = F.schema_of_variant(v), F.try_variant_get(v, "$", "string")
    return F.when(kind == "BOOLEAN", F.when(word == "true", "True").otherwise("")).when((kind != "STRING") & (word.try_cast("double") == 0), "").otherwise(F.coalesce(word, F.lit("")))


def _children(text: Column) -> Column:
    """Texts of what a list or object holds, in the document's order: of a list what is not empty, null, zero or false; of an
    object its content, or else those of its values that are texts, lists or objects."""
    nested = lambda v: F.schema_of_variant(v).rlike("^(ARRAY|OBJECT)")
    kinds, raw = F.from_json(text, "array<variant>"), F.from_json(text, "array<string>")
    listed = F.filter(F.arrays_zip(kinds.alias("v"), raw.alias("t")), lambda x: F.when(nested(x["v"]), ~x["t"].isin("[]", "{}")).otherwise(_said(x["v"]) != ""))
    listed = F.transform(listed, lambda x: F.when(nested(x["v"]), x["t"]).otherwise(_said(x["v"])))
    # Maps keep the order of the document, which a VARIANT does not.
    values, texts = F.from_json(text, "map<string,variant>"), F.from_json(text, "map<string,string>")
    held = F.filter(F.map_keys(texts), lambda k: F.schema_of_variant(F.element_at(values, k)).rlike("^(ARRAY|OBJECT|STRING)"))
    content = F.try_element_at(values, F.lit("content"))
    inside = F.when(F.coalesce(nested(content), F.lit(False)), F.element_at(texts, F.lit("content"))).otherwise(_said(content))
    of_object = F.when(F.map_contains_key(values, "content"), F.array(inside)).otherwise(F.transform(held, lambda k: F.element_at(texts, k)))
    return F.when(text.startswith("["), listed).otherwise(of_object)


def flatten_text(rows: DataFrame, key: str, column: str, most: int = MOST_LEVELS) -> DataFrame:
    """key and text of rows (key unique, column): the prompt's texts in order, joined by blanks.

    Level by level lists and objects are replaced by what they hold, JSON inside text being read like JSON around it; what
    is no JSON has its white space collapsed. Only what is still nested goes to the next level. An empty list or object
    is an empty text. Null gives the empty text, and an object that repeats a key is no
    JSON. Deeper nesting than `most` levels is an error.
    """
    live = rows.select(F.col(key).alias("key"), F.array().cast("array<int>").alias("path"), strip(F.coalesce(F.col(column), F.lit(""))).alias("text"))
    live = checkpointed(live.withColumn("nested", _container(F.col("text"))))
    leaves = None
    for _ in range(most + 1):
        part = live.where("NOT nested").select("key", "path", collapse(F.col("text")).alias("text"))
        leaves = part if leaves is None else leaves.unionByName(part)
        live = live.where("nested")
        if live.isEmpty():
            break
        held = F.coalesce(F.nullif(_children(F.col("text")), F.array().cast("array<string>")), F.array(F.lit("")))
        live = live.select("key", "path", F.posexplode(held).alias("at", "text"))
        live = live.select("key", F.array_append("path", F.col("at")).alias("path"), strip(F.col("text")).alias("text"))
        live = checkpointed(live.withColumn("nested", _container(F.col("text"))))
    else:
        raise ValueError(f"prompts are nested more than {most} levels deep")
    by = leaves.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("path", "text"))).alias("xs"))
    return by.select(F.col("key").alias(key), F.array_join(F.transform("xs", lambda x: x["text"]), " ").alias("text"))
