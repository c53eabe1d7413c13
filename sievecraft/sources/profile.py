"""Shape of loosely structured records: paths, kinds of values, examples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievecraft.functions.text import short_example

#: Children of a list that are looked at.
LIST_CHILDREN = 3


def walk_paths(records: DataFrame, depth: int = 5) -> DataFrame:
    """pos, path, value of every field of the records (pos, record), nested ones included; lists name their
    children by []. Levels beyond `depth` are not entered."""
    level = records.select("pos", F.lit("").alias("path"), F.col("record").alias("value"))
    out = None
    for _ in range(depth):
        kind = F.schema_of_variant("value")
        fields = F.when(kind.startswith("OBJECT"), F.try_variant_get("value", "$", "map<string,variant>"))
        children = F.when(kind.startswith("ARRAY"), F.slice(F.try_variant_get("value", "$", "array<variant>"), 1, LIST_CHILDREN))
        named = level.select("pos", "path", F.explode(fields).alias("name", "value")).select("pos", F.concat("path", F.when(F.col("path") != "", ".").otherwise(""), "name").alias("path"), "value")
        listed = level.select("pos", "path", F.explode(children).alias("value")).select("pos", F.concat("path", F.lit("[]")).alias("path"), "value")
        level = named.unionByName(listed)
        out = level if out is None else out.unionByName(level)
    return out


def profile(records: DataFrame, depth: int = 5) -> DataFrame:
    """path, kind, n and first example of the fields of records."""
    rows = walk_paths(records, depth)
    kind = F.regexp_extract(F.schema_of_variant("value"), "^[A-Z]+", 0)
    return rows.groupBy("path", kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.min_by(short_example(F.to_json("value")), "pos").alias("example"))


def suggest(paths: list[str], aliases: tuple[str, ...]) -> str | None:
    """The path for a part of a record: an alias itself, else a path that ends in one."""
    return next((a for a in aliases if a in paths), None) or next((p for a in aliases for p in sorted(paths) if p.endswith(f".{a}")), None)
