"""Dense vectors: nearest gold, dispersion, clusters of near vectors, projection."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievecraft.operators.graph import checkpointed


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """The vector of length one, or zeros; the sum of squares is taken once a vector, not once a component."""
    squares = lambda s, x: s + x.cast("double") * x.cast("double")
    return F.aggregate(a, F.lit(0.0), squares, lambda s: F.transform(a, lambda x: F.when(F.sqrt(s) > 1e-12, x.cast("double") / F.sqrt(s)).otherwise(0.0)))


def centroid(rows: DataFrame, by: list[str], vector: str) -> DataFrame:
    """by, n and the mean vector (array) of a group; components combine before the shuffle."""
    each = rows.select(*by, F.posexplode(vector).alias("d", "x")).groupBy(*by, "d").agg(F.sum(F.col("x").cast("double")).alias("s"), F.count(F.lit(1)).alias("n"))
    return each.groupBy(*by).agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("d", (F.col("s") / F.col("n")).alias("m")))), lambda e: e["m"]).alias("centroid"))


def mean_pairwise_cosine(rows: DataFrame, by: list[str], vector: str) -> DataFrame:
    """Mean cosine of all pairs of a group, from the sum of its unit vectors: no pair is formed.

    |sum u|^2 = n + 2 * (sum over pairs), so the mean needs the sum alone.
    """
    each = rows.select(*by, F.posexplode(unit(F.col(vector))).alias("d", "x")).groupBy(*by, "d").agg(F.sum("x").alias("s"), F.count(F.lit(1)).alias("n"))
    return each.groupBy(*by).agg(F.max("n").alias("n"), F.sum(F.col("s") * F.col("s")).alias("q")).select(*by, "n", F.try_divide(F.col("q") - F.col("n"), F.col("n") * (F.col("n") - 1)).alias("mean_cosine"))


def normalized_entropy(rows: DataFrame, by: list[str], category: str, support: int) -> DataFrame:
    counts = rows.groupBy(*by, category).agg(F.count(F.lit(1)).alias("c"))
    totals = counts.groupBy(*by).agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.ln("c")).alias("clc"))
    return totals.select(*by, ((F.ln("n") - F.col("clc") / F.col("n")) / F.ln(F.lit(float(support)))).alias("entropy"))


#: Vectors in a block: two blocks and their similarities are what a task holds at once.
BLOCK = 2048


def blocks(rows: DataFrame, key: str, vector: str, name: str) -> DataFrame:
    """Rows packed into blocks (name_ids, name_values: unit vectors as packed doubles), at most BLOCK of one partition in each."""
    import numpy as np
    import pyarrow as pa

    most = BLOCK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, most):
                part = batch.slice(i, most)
                ids = part.column(0).to_numpy(zero_copy_only=False).astype("<i8")
                x = np.array(part.column(1).flatten().to_numpy(zero_copy_only=False), "<f8").reshape(len(ids), -1)
                x = x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)
                yield pa.RecordBatch.from_arrays([pa.array([ids.tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary())], names=[f"{name}_ids", f"{name}_values"])

    rows = rows.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).cast("long"), F.col(vector).cast("array<double>"))
    return rows.mapInArrow(run, f"{name}_ids binary, {name}_values binary")


def nearest(queries: DataFrame, rows: DataFrame, key: str, vector: str) -> DataFrame:
    """query, nearest, similarity: for each query the row of the greatest cosine (of equal ones, to nine decimals, the least key).

    Exact: every block of queries meets every block of rows, and only a best row of each block is kept. Blocks are written first:
    the join reads those of one side again for each task of the other, and what leads to them would run as often.
    """
    import numpy as np
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q_ids, q, r_ids, r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                q_ids, r_ids = np.frombuffer(q_ids, "<i8"), np.frombuffer(r_ids, "<i8")
                order = np.argsort(r_ids)
                q, r = np.frombuffer(q, "<f8").reshape(len(q_ids), -1), np.frombuffer(r, "<f8").reshape(len(r_ids), -1)[order]
                sims = np.round(q @ r.T, 9)
                best = sims.argmax(1)  # the first of equal ones, which has the least key
                yield pa.RecordBatch.from_arrays([pa.array(q_ids), pa.array(r_ids[order][best]), pa.array(sims[np.arange(len(q_ids)), best])], names=["query", "nearest", "similarity"])

    pairs = checkpointed(blocks(queries, key, vector, "q")).crossJoin(checkpointed(blocks(rows, key, vector, "r")))
    found = pairs.mapInArrow(run, "query bigint, nearest bigint, similarity double")
    best = found.groupBy("query").agg(F.max_by(F.struct("nearest", "similarity"), F.struct("similarity", -F.col("nearest"))).alias("b"))
    return best.select("query", "b.nearest", "b.similarity")
