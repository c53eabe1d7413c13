"""Joins by duplicate-aware, last-wins, semi and anti semantics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_occurrence(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Adds occ: the how-manieth row of its key this is."""
    return rows.withColumn("occ", F.row_number().over(Window.partitionBy(key).orderBy(order)))


def occurrence_join(left: DataFrame, right: DataFrame, key: str, left_order: str, right_order: str, how: str = "inner") -> DataFrame:
    """Joins the n-th row of a key with the n-th row of that key on the other side."""
    return with_occurrence(left, key, left_order).join(with_occurrence(right, key, right_order), [key, "occ"], how)


def last_per_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key."""
    cols = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*cols), F.col(order)).alias("_last")).select(key, *[F.col(f"_last.{c}") for c in cols])


def lookup_last(rows: DataFrame, side: DataFrame, key: str, order: str, how: str = "inner") -> DataFrame:
    """Many-to-one join with the last row of each key of the other side."""
    return rows.join(last_per_key(side, key, order), key, how)


def contaminated(rows: DataFrame, other: DataFrame, key: str) -> DataFrame:
    return rows.join(other.select(key).distinct(), key, "left_semi")


def uncontaminated(rows: DataFrame, other: DataFrame, key: str) -> DataFrame:
    return rows.join(other.select(key).distinct(), key, "left_anti")


#: Tasks for each split of a scan: some 40,000 to 700,000 rows of two numbers each, whatever the size of the input.
TASKS = 16


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows of a scan by keys, over tasks whose number grows with the scan and which are not merged by their few bytes: rows of two
    numbers shrink in a shuffle and take many times as much in a sort. Not for joined or grouped rows."""
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    splits = rows.rdd.getNumPartitions()
    return rows.repartition(max(least, TASKS * splits) if splits > 1 else least, *keys)


def pending(left: DataFrame, right: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Number of pairs of a left and a right row that are not done, per right row, without forming the pairs."""
    l, r = keys
    # An inner join, as left rows are distinct: a semi join would be moved before the pairs are made distinct.
    done = dealt(done.select(*keys), l).distinct().join(left.select(l).distinct(), l)
    finished = done.groupBy(r).agg(F.count(F.lit(1)).alias("_done"))
    total = left.select(l).distinct().agg(F.count(F.lit(1)).alias("_all"))
    return right.select(r).distinct().join(finished, r, "left").join(F.broadcast(total)).select(r, (F.col("_all") - F.coalesce("_done", F.lit(0))).alias("pending"))


def best_per_key(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The row of each key with the greatest order columns."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_best")).select(*keys, *[F.col(f"_best.{c}") for c in rest])


def match_keywords(rows: DataFrame, text: str, concerns: dict[str, tuple[str, ...]], name: str = "concern") -> DataFrame:
    """Rows once for each concern of which the text holds a keyword: a theta join with a list given in the plan."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    hits = [F.when(F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w)), F.lit(c)) for c, words in concerns.items()]
    return rows.withColumn(name, F.explode(F.array_compact(F.array(*hits))))
