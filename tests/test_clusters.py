"""Clusters of dense vectors and components with one giant label, against plain search."""

import numpy as np
import pytest

from sievecraft.operators import clusters, graph


def components(n, pairs):
    label = list(range(n))
    for i, j in pairs:
        a, b = label[i], label[j]
        if a != b:
            label = [min(a, b) if x in (a, b) else x for x in label]
    return label


@pytest.mark.parametrize(("tau", "centres", "group"), [(0.9, 256, 1 << 15), (0.9, 7, 40), (0.6, 5, 64)])
def test_clusters(spark, tau, centres, group):
    """A dense region with a third of all vectors, copies, chains and strays; small groups make many tasks of a cell."""
    rng = np.random.default_rng(4)
    x = np.concatenate((rng.normal(0, 1, (60, 8)), rng.normal(0, 0.15, (100, 8)) + np.eye(8)[0], np.repeat(rng.normal(0, 1, (3, 8)), 20, 0), [np.eye(8)[1] * np.cos(t) + np.eye(8)[2] * np.sin(t) for t in np.arange(0, 2.5, 0.05)], np.zeros((2, 8))))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5, x[5].tolist()), (None, x[0].tolist()), (900, None)]
    out = clusters.clusters(spark.createDataFrame(rows, "k long, v array<double>").repartition(4), "k", "v", tau, centres=centres, group=group)
    unit = x[:-2] / np.linalg.norm(x[:-2], axis=1, keepdims=True)
    want = components(len(x), [(i, j) for i, j in np.argwhere(np.round(unit @ unit.T, 9) >= tau) if i < j])
    assert {r["node"]: r["component"] for r in out.collect()} == dict(enumerate(want)) | {900: 900}
    assert {r["node"]: r["size"] for r in out.collect()} == {i: want.count(c) for i, c in enumerate(want)} | {900: 1}


def test_no_vectors(spark):
    none = spark.createDataFrame([], "k long, v array<double>")
    assert clusters.clusters(none, "k", "v", 0.5).count() == 0
    assert clusters.clusters(spark.createDataFrame([(1, None), (2, [0.0, 0.0])], "k long, v array<double>"), "k", "v", 0.5).count() == 2


def test_a_giant_label(spark):
    """A star and a chain that hang together, beside pairs: nearly all nodes have one label."""
    edges = [(0, i) for i in range(1, 3000)] + [(i, i + 1) for i in range(3000, 3060)] + [(7, 3000)] + [(5000 + 2 * i, 5001 + 2 * i) for i in range(40)]
    out = {r["node"]: r["component"] for r in graph.min_labels(spark.createDataFrame(edges, "a int, b int"), spark.createDataFrame([(x,) for e in edges for x in e] + [(9999,)], "node int")).collect()}
    assert all(out[i] == 0 for i in range(3061)) and all(out[5001 + 2 * i] == out[5000 + 2 * i] == 5000 + 2 * i for i in range(40)) and out[9999] == 9999
