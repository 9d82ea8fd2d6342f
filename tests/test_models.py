"""Forest, clusters and reconstruction errors against plain numpy."""

import math

import numpy as np
import pytest

from transfergraph.operators import anomalies

COLUMNS = ["f1", "f2", "f3"]


def _frame(spark, x, parts=3):
    return spark.createDataFrame([(f"a{k:03d}", *map(float, row)) for k, row in enumerate(x)], "address string, f1 double, f2 double, f3 double").repartition(parts)


def _depth(node, row, depth=0):
    """Where one row ends in a tree, with the mean depth of what is left unsplit there."""
    while "k" in node:
        node, depth = node["left" if row[node["k"]] < node["at"] else "right"], depth + 1
    n = node["n"]
    return depth + (2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 1 else 0)


def test_forest_scores_are_those_of_its_trees(spark):
    x = np.random.default_rng(1).normal(size=(60, 3))
    x[17] = (25, -30, 40)
    got = {r.address: r for r in anomalies.isolation_forest(_frame(spark, x), "address", COLUMNS, trees=20, sample=256, max_depth=6, seed=5).collect()}
    trees = [anomalies._grow(x, np.random.default_rng([5, t]), 6) for t in range(20)]  # the sample is larger than the table: each tree has all rows, by key
    typical = 2 * (math.log(59) + 0.5772156649) - 2 * 59 / 60
    for k, row in enumerate(x):
        want = 2 ** (-sum(_depth(t, row) for t in trees) / 20 / typical)
        assert got[f"a{k:03d}"].score == pytest.approx(want) and got[f"a{k:03d}"].outlier == (want > 0.6)
    assert max(got.values(), key=lambda r: r.score).address == "a017" and got["a017"].outlier


def test_forest_is_the_same_for_any_partitioning_and_samples(spark):
    x = np.random.default_rng(2).normal(size=(300, 3))
    runs = [sorted((r.address, r.score) for r in anomalies.isolation_forest(_frame(spark, x, n), "address", COLUMNS, trees=5, sample=50).collect()) for n in (1, 7)]
    assert runs[0] == runs[1] and len(runs[0]) == 300
    assert anomalies.isolation_forest(_frame(spark, x[:1]), "address", COLUMNS, trees=2).count() == 1
    assert anomalies.isolation_forest(_frame(spark, x).limit(0), "address", COLUMNS).count() == 0


def test_clusters_are_the_planted_groups(spark):
    r = np.random.default_rng(3)
    centres = np.array([(0, 0, 0), (50, 0, 0), (0, 50, 0), (0, 0, 50)])
    x = np.repeat(centres, 25, axis=0) + r.normal(size=(100, 3))
    got = {row.address: row.cluster for row in anomalies.account_clusters(_frame(spark, x), COLUMNS, k=4).collect()}
    groups = [{got[f"a{25 * g + k:03d}"] for k in range(25)} for g in range(4)]
    assert all(len(g) == 1 for g in groups) and len(set.union(*groups)) == 4


def test_errors_are_those_of_principal_components(spark):
    r = np.random.default_rng(4)
    a, b = r.normal(size=(2, 200))
    x = np.column_stack([a, b, a + 2 * b + 0.05 * r.normal(size=200)])
    x[33] = (1, 1, -8)
    got = {row.address: row for row in anomalies.reconstruction_outliers(_frame(spark, x), COLUMNS, components=2).collect()}
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    last = np.linalg.svd(z, full_matrices=False)[2][2]
    want = np.abs(z @ last)
    for k in range(200):
        assert got[f"a{k:03d}"].error == pytest.approx(want[k], abs=1e-9)
    assert got["a033"].outlier and sum(row.outlier for row in got.values()) == (want > np.sort(want)[189]).sum()
