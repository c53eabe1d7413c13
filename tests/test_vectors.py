"""Search and unit vectors: results against numpy, and work that grows with the rows alone."""

import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sievecraft.operators import clusters, vector


@pytest.fixture
def no_broadcast(spark):
    """Blocks of larger tables are not broadcast."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def counted(spark, rows):
    """The rows, and how often one was read."""
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    return rows.mapInArrow(run, rows.schema), seen


def test_nearest_reads_each_side_once(spark, no_broadcast):
    """Both sides lie in several partitions; copies tie, and the least key wins."""
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, (600, 8))
    x[300:] = x[:300]
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (None, x[0].tolist())], "k long, v array<double>").repartition(5)
    queries, asked = counted(spark, frame.where("k % 10 = 0 OR k IS NULL"))
    rows, read = counted(spark, frame.where("k % 10 <> 0 OR k IS NULL"))
    out = {r["query"]: (r["nearest"], r["similarity"]) for r in vector.nearest(queries, rows, "k", "v").collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    of, others = np.arange(0, 600, 10), np.flatnonzero(np.arange(600) % 10)
    sims = np.round(u[of] @ u[others].T, 9)
    assert {q: r for q, (r, _) in out.items()} == {int(q): int(others[s.argmax()]) for q, s in zip(of, sims, strict=True)}
    assert [out[int(q)][1] for q in of] == pytest.approx(sims.max(1).tolist(), abs=1e-9)
    assert (asked.value, read.value) == (frame.where("k % 10 = 0 OR k IS NULL").count(), frame.where("k % 10 <> 0 OR k IS NULL").count())


def test_unit(spark):
    rows = [(0, [3.0, 4.0]), (1, [0.0, 0.0]), (2, []), (3, None), (4, [1.0, None])]
    out = spark.createDataFrame(rows, "k int, v array<float>").select("k", vector.unit(F.col("v")).alias("u"))
    assert {r["k"]: r["u"] for r in out.collect()} == {0: [0.6, 0.8], 1: [0.0, 0.0], 2: [], 3: None, 4: [0.0, 0.0]}


def test_unit_of_long_vectors(spark):
    """The norm is not taken anew for each component."""
    rows = spark.range(8).select(F.transform(F.sequence(F.lit(1), F.lit(6000)), lambda i: (i + F.col("id")).cast("double")).alias("v"))
    began = time.time()
    out = rows.select(vector.norm(vector.unit(F.col("v"))).alias("n")).collect()
    assert time.time() - began < 8 and all(abs(r["n"] - 1) < 1e-9 for r in out)


def test_a_dense_region(spark):
    """One component of 3,000 vectors, a chain that leaves it, lone vectors and copies; cells of several groups."""
    n = 3000
    rng = np.random.default_rng(6)
    axis = np.eye(16)
    chain = [np.cos(t) * axis[0] + np.sin(t) * axis[1] for t in np.arange(0.2, 2.2, 0.2)]
    x = np.concatenate((axis[0] + rng.uniform(-0.1, 0.1, (n, 16)), chain, [-axis[3], axis[4] - axis[0], axis[5] - axis[0], axis[5] - axis[0]]))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "k long, v array<double>").repartition(4)
    lone = n + len(chain)
    for group in (1 << 15, 800):
        out = {r["node"]: r["component"] for r in clusters.clusters(rows, "k", "v", 0.95, centres=4, group=group).collect()}
        assert out == dict.fromkeys(range(lone), 0) | {lone: lone, lone + 1: lone + 1, lone + 2: lone + 2, lone + 3: lone + 2}


def test_links_of_a_dense_region():
    """Four times the vectors of a dense region cost about four times the work, not sixteen times."""
    rng = np.random.default_rng(7)
    near = clusters.linker(0.95)

    def run(n):
        x = np.eye(16)[0] + rng.uniform(-0.1, 0.1, (n, 16))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        group = pa.table({"low": [0] * n, "high": [0] * n, "part": [0] * n, "own": [True] * n, "id": list(range(n)), "x": [v.tobytes() for v in x]})
        took = []
        for _ in range(3):
            began = time.perf_counter()
            assert near(group).num_rows == n - 1
            took.append(time.perf_counter() - began)
        return min(took)

    assert run(16_000) < 9 * run(4_000)
