"""Betweenness in blocks, with blocks so small that each search crosses them, against listed paths."""

from collections import defaultdict

import pytest

from transfergraph.operators import blocks, metrics

E = "from_address string, to_address string"


def _brute(links, sources, depth=None):
    ahead, want = defaultdict(set), defaultdict(float)
    for a, b in links:
        if a != b:
            ahead[a].add(b)
    for s in sources:
        paths, now = {}, [(s,)]
        while now and len(now[0]) <= (depth or len(links)):  # all shortest paths, level by level
            old = set(paths) | {s}
            now = [(*p, v) for p in now for v in ahead[p[-1]] if v not in old]
            for p in now:
                paths.setdefault(p[-1], []).append(p)
        for found in paths.values():
            for p in found:
                for v in p[1:-1]:
                    want[v] += 1 / len(found)
    return want


@pytest.mark.parametrize("depth", [None, 2])
def test_betweenness_across_blocks(spark, monkeypatch, depth):
    monkeypatch.setattr(blocks, "VERTICES", 5)
    monkeypatch.setattr(blocks, "SOURCES", 2)
    links = [(f"v{a:02d}", f"v{(a * 7 + k * k * 5 + 3) % 23:02d}") for a in range(23) for k in range(1 + a % 4)] + [("v00", "v00"), ("in", "v01"), ("v02", "out")]
    sources = ["v00", "v07", "v11", "in", "out", "not there"]
    edges = spark.createDataFrame(links + links[:5], E)
    got = {r.address: r.betweenness for r in metrics.betweenness(edges, spark.createDataFrame([(s,) for s in [*sources, "v00"]], "address string"), depth).collect()}
    names = {v for e in links for v in e}
    n = len(names)
    want = _brute(links, sources, depth)
    assert got == pytest.approx({v: want[v] * 2 / ((n - 1) * (n - 2)) for v in names}) and any(got.values())


def test_betweenness_without_paths(spark):
    one = spark.createDataFrame([("a",)], "address string")
    assert metrics.betweenness(spark.createDataFrame([], E), one).count() == 0
    assert metrics.betweenness(spark.createDataFrame([("a", "a"), ("b", "b"), ("c", "c")], E), one).collect()[0].betweenness == 0.0
