"""Clusters of dense vectors: components of the graph that links vectors whose cosine reaches a threshold.

Vectors go to the cell of the nearest of some centres. Where an angle of at most alpha lies between two vectors, one in cell c
is no further from the other's centre than that one's own distance and 2 alpha: so each vector also goes to the cells
before its own that lie within this bound, and no link is lost. A cell of many vectors is dealt over pairs of groups, and of
the links of a pair of groups only a forest travels: as many as vectors at most, with the same components. Members of the
largest component that a task has found so far are not compared with each other any more, so that dense regions cost less than
all their pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievecraft.operators.graph import checkpointed, min_labels

#: Centres, whose cells the vectors go to; vectors of a group of a cell about; vectors of a block of similarities, and few of them.
CENTRES, GROUP, STEP, FEW = 256, 1 << 15, 1 << 11, 1 << 8
#: Decimals of a cosine that count.
DECIMALS = 9


def unit_rows(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """id and x, the unit vector as packed doubles; null and zero vectors, which are near nothing, are left out."""
    import numpy as np
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, xs = [], []
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                x = np.array(v.values.to_numpy(zero_copy_only=False), "<f8")
                norm = math.sqrt(float(x @ x))
                if norm > 1e-12 and math.isfinite(norm):
                    ids.append(i)
                    xs.append((x / norm).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(xs, pa.binary())], names=["id", "x"])

    rows = rows.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).cast("long"), F.col(vector).cast("array<double>"))
    return rows.mapInArrow(run, "id bigint, x binary")


def in_cells(units: DataFrame, centres: list[bytes], tau: float) -> DataFrame:
    """cell, own, id and x of each vector: in its own cell, and in those before it where vectors near it may be at home."""
    import numpy as np
    import pyarrow as pa

    reach = 2 * math.acos(max(-1.0, min(1.0, tau - 10.0**-DECIMALS)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = np.frombuffer(b"".join(centres), "<f8").reshape(len(centres), -1)
        for batch in batches:
            for start in range(0, batch.num_rows, STEP):
                part = batch.slice(start, STEP)
                x = np.frombuffer(b"".join(part.column("x").to_pylist()), "<f8").reshape(part.num_rows, -1)
                angle = np.arccos(np.clip(x @ c.T, -1, 1))
                home = angle.argmin(1)
                within = (angle <= angle[np.arange(len(x)), home][:, None] + reach + 1e-9) & (np.arange(len(c)) < home[:, None])
                within[np.arange(len(x)), home] = True
                row, cell = np.nonzero(within)
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(cell == home[row]), part.column("id").take(at), part.column("x").take(at)], names=["cell", "own", "id", "x"])

    return units.mapInArrow(run, "cell int, own boolean, id bigint, x binary")


def linker(tau: float) -> Callable:
    """A function from a pair of groups of a cell to links (a, b) that join each component of theirs. What goes to the executors
    is defined in here, so that they need no copy of this package."""
    import numpy as np
    import pyarrow as pa

    few, step, decimals = FEW, STEP, DECIMALS

    def joined(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The least member of each one's component, after links of places i and j."""
        while len(i):
            a, b = parent[i], parent[j]
            differ = a != b
            i, j, a, b = i[differ], j[differ], a[differ], b[differ]
            np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(parent, up := parent[parent]):
                parent = up
        return parent

    def near(table: pa.Table) -> pa.Table:
        ids, own, part = (table[c].to_numpy() for c in ("id", "own", "part"))
        x = np.frombuffer(b"".join(table["x"].to_pylist()), "<f8").reshape(len(ids), -1)
        same = table["low"][0].as_py() == table["high"][0].as_py()
        parent, mine = np.arange(len(ids)), np.flatnonzero(own)
        for start in range(0, len(mine), few):
            some = mine[start : start + few]
            large = parent == np.bincount(parent).argmax()
            # Links inside the largest component so far would change nothing: its members meet the others only.
            for left, right in ((some[~large[some]], np.arange(len(ids))), (some[large[some]], np.flatnonzero(~large))):
                for other in range(0, len(right) if len(left) else 0, step):
                    to = right[other : other + step]
                    sims = np.round(x[left] @ x[to].T, decimals) >= tau
                    if not same:  # the groups by themselves are another task's
                        sims &= part[left][:, None] != part[to][None, :]
                    i, j = np.nonzero(sims)
                    parent = joined(parent, left[i], to[j])
        child = np.flatnonzero(parent != np.arange(len(ids)))
        return pa.table({"a": ids[parent[child]], "b": ids[child]})

    return near


def links(rows: DataFrame, key: str, vector: str, tau: float, centres: int = CENTRES, group: int = GROUP) -> DataFrame:
    """Links (a, b) of vectors with a cosine of at least tau (to nine decimals), enough of them for all components."""
    units = checkpointed(unit_rows(rows, key, vector))
    # A bounded sample; which vectors are centres decides about the work and never about the links.
    chosen = [bytes(r["x"]) for r in units.dropDuplicates(["id"]).orderBy(F.xxhash64("id"), "id").limit(centres).select("x").collect()]
    if not chosen:
        return units.select(F.col("id").alias("a"), F.col("id").alias("b"))
    placed = in_cells(units, chosen, tau)
    sizes = {r["cell"]: r["n"] for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each centre
    groups = F.lit(1)
    for cell, n in sizes.items():
        if n > group:
            groups = F.when(F.col("cell") == cell, -(-n // group)).otherwise(groups)
    dealt = placed.withColumn("g", groups.cast("int")).withColumn("part", F.pmod(F.xxhash64("id"), F.col("g")).cast("int"))
    dealt = dealt.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    dealt = dealt.select("cell", F.least("part", "k").alias("low"), F.greatest("part", "k").alias("high"), "part", "own", "id", "x")
    return dealt.groupBy("cell", "low", "high").applyInArrow(linker(tau), "a bigint, b bigint").where("a <> b")


def clusters(rows: DataFrame, key: str, vector: str, tau: float, **options) -> DataFrame:
    """node, component (the least key of the cluster) and size of every vector; one near no other is a cluster by itself."""
    nodes = rows.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("node")).distinct()
    out = min_labels(links(rows, key, vector, tau, **options), nodes)
    sizes = out.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    return out.join(sizes, "component").select("node", "component", "size")
