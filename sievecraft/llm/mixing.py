"""Mixing sources to target weights.

Every document draws a key by hash; documents are range-sorted by source and key, prefix sums of their sizes are
taken partition by partition, and each source is cut where its budget ends: whole epochs first, then the documents
with the least keys, the last of them in part. A source may hold any share of the rows: its documents lie in as many
partitions as the sort gives it, and only one sum for each partition and source is put in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievecraft.llm.common import join_hot, map_arrow, materialise

#: Weights of the sources in order, repeating; share of all words that the mix takes; epochs at most; seed of the keys.
WEIGHTS, SHARE, EPOCHS, SEED = (5, 2, 1), 1.5, 2, 11
WORD = r"[^\x20\x09-\x0D]+"


def draw(key: Column, seed: int = SEED) -> Column:
    """60 bits that order rows at random but reproducibly, in any engine with MD5; a null key counts as empty."""
    return F.conv(F.substr(F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(key.cast("string"), F.lit("")))), F.lit(1), F.lit(15)), 16, 10).cast("long")


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows with their place (from 0) in this order: a range sort, numbers within partitions, and the partitions' sizes."""
    ids = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id())
    ids = materialise(ids.withColumn("_p", F.shiftright("_m", 33)), "numbered")
    by = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    starts = ids.groupBy("_p").agg(F.count(F.lit(1)).alias("_c")).select("_p", F.coalesce(F.sum("_c").over(by), F.lit(0)).alias("_s"))
    place = F.col("_s") + F.col("_m").bitwiseAND((1 << 33) - 1)
    return ids.join(F.broadcast(starts), "_p").withColumn(name, place).drop("_p", "_m", "_s")


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """sources (of, source_size, ...) with their target.

    Sources in the order of `of` weigh as `weights` repeat and share `share` of all words; no target is above `epochs`
    times its source's size, and what is above goes to the others by weight until none is. The common level rises from
    round to round, each a sum over one row for each source.
    """
    ranked = numbered(sources, ["of"], "rank")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = materialise(ranked.withColumn("w", w).withColumn("most", (epochs * F.col("source_size")).cast("double")), "sources")
    total = share * (ranked.agg(F.sum("source_size")).first()[0] or 0)
    level, full = 0.0, -1
    while True:
        above = F.col("most") < F.lit(level) * F.col("w")
        now = ranked.agg(F.count_if(above).alias("n"), F.coalesce(F.sum(F.when(above, F.col("most"))), F.lit(0.0)).alias("held"), F.coalesce(F.sum(F.when(~above, F.col("w"))), F.lit(0.0)).alias("w")).first()
        if now["n"] == full or not now["w"]:
            break
        full, level = now["n"], (total - now["held"]) / now["w"]
    reached = F.lit(level) * F.col("w")
    return ranked.withColumn("target", F.when(F.col("most") < reached, F.col("most")).otherwise(reached)).drop("w", "most")


def running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows with the number of their partition and the sum of sizes of their source up to them in it."""
    from pyspark import TaskContext

    part, last, held = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        ranks, sizes = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("rank", "size"))
        ends = np.cumsum(sizes)
        first = np.flatnonzero(np.concatenate(([True], ranks[1:] != ranks[:-1])))
        before = ends[first] - sizes[first]
        if ranks[0] == last:
            before[0] -= held
        run = ends - np.repeat(before, np.diff(np.append(first, len(ranks))))
        last, held = ranks[-1], int(run[-1])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(run), part, np.int32)), pa.array(run)], names=[*batch.schema.names, "part", "run"])


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, text: str = "text", key: str = "doc_id", source: str = "source", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: key, size, source_size, target, taken, and the columns named in `carry`.

    size: words between ASCII blanks (null text: 0); source_size and target: words of its source and what the mix should
    take of them; taken: words that it takes of the document, repeats counted, so that each source's sum is its target
    rounded. A null source is a source of its own, the last one; the empty text is another. Rows with equal keys follow
    each other by size; repeated rows are alike. Empty tables give no rows; a source without words has the target 0.
    Other columns are ignored.
    """
    of = F.when(F.col(source).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(source).cast("string")))
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(F.col(key).alias("key"), of.alias("of"), size.alias("size"), draw(F.col(key)).alias("draw"), *[F.col(c).alias(f"carry_{i}") for i, c in enumerate(carry)])
    rows = materialise(rows, "sizes")
    sources = targets(rows.groupBy("of").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("c")), weights, share, epochs)
    rows = join_hot(rows, materialise(sources, "targets"), "of").drop("of")
    order = ["rank", "draw", "key", "size"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    rows = materialise(map_arrow(rows, running, f"{fields}, part int, run bigint"), "sorted")
    by = Window.partitionBy("rank").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition of a source
    starts = rows.groupBy("rank", "part").agg(F.sum("size").alias("s")).select("rank", "part", F.coalesce(F.sum("s").over(by), F.lit(0)).alias("start"))
    budget = F.floor(F.col("target") + 0.5)
    out = rows.join(starts, ["rank", "part"]).withColumn("epochs", F.when(F.col("source_size") > 0, F.expr("floor(target + 0.5) div source_size")).otherwise(0))
    rest = budget - F.col("epochs") * F.col("source_size") - (F.col("start") + F.col("run") - F.col("size"))
    taken = F.col("epochs") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest))
    return out.select(F.col("key").alias(key), "size", "source_size", "target", taken.cast("long").alias("taken"), *[F.col(f"carry_{i}").alias(c) for i, c in enumerate(carry)])


def mixed(docs: DataFrame, text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """The mix itself: key, epoch (from 1), text; a document that is taken in part comes with its first words."""
    out = mix(docs, text=text, key=key, carry=(text,), **options)
    most = F.ceil(F.try_divide(F.col("taken"), F.col("size"))).cast("int")
    out = out.where("taken > 0").withColumn("epoch", F.explode(F.sequence(F.lit(1), most)))
    words = F.least(F.col("size"), F.col("taken") - (F.col("epoch") - 1) * F.col("size"))
    part = F.array_join(F.slice(F.regexp_extract_all(F.col(text), F.lit(WORD), F.lit(0)), F.lit(1), words.cast("int")), " ")
    return out.select(key, "epoch", F.when(words == F.col("size"), F.col(text)).otherwise(part).alias(text))
