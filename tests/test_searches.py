"""Searches in tasks that hold the graph, against those by joins and by cells, and against listed paths."""

import pytest

from tests.test_blocks import E, _brute
from transfergraph.operators import blocks, metrics, searches, weighted

LINKS = [(f"v{a:02d}", f"v{(a * 7 + k * k * 5 + 3) % 23:02d}") for a in range(23) for k in range(1 + a % 4)] + [("v00", "v00"), ("in", "v01"), ("v02", "out")]
ASKED = ["v00", "v07", "v11", "in", "out", "not there", "v00"]


def asked(spark):
    return spark.createDataFrame([(s,) for s in ASKED], "address string")


@pytest.mark.parametrize("depth", [None, 2])
def test_closeness_by_bits(spark, monkeypatch, depth):
    edges = spark.createDataFrame(LINKS + LINKS[:5], E)
    monkeypatch.setattr(searches, "NUMBERS", 1)  # 64 targets at a time, so a word a vertex
    monkeypatch.setattr(searches, "PACK", 7)
    rows = lambda df: {r.address: (r.reachable, r.closeness) for r in df.collect()}
    got = rows(metrics.closeness(edges, None, depth)), rows(metrics.closeness(edges, asked(spark), depth))
    monkeypatch.setattr(searches, "VERTICES", 0)
    want = rows(metrics.closeness(edges, None, depth)), rows(metrics.closeness(edges, asked(spark), depth))
    assert got == want and len(got[0]) == 25 and len(got[1]) == 6 and any(c for _, c in got[0].values())


def test_closeness_of_a_chain_of_many(spark, monkeypatch):
    """130 targets are three words; no join makes a row for a target and a vertex."""
    monkeypatch.setattr(metrics, "bfs", None)
    edges = spark.createDataFrame([(f"c{k:03d}", f"c{k + 1:03d}") for k in range(129)], E)
    got = {r.address: r for r in metrics.closeness(edges).collect()}
    assert {v: r.reachable for v, r in got.items()} == {f"c{k:03d}": k for k in range(130)}
    assert got["c129"].closeness == pytest.approx(129 / (129 * 130 / 2)) and got["c000"].closeness == 0.0


@pytest.mark.parametrize("depth", [None, 2])
@pytest.mark.parametrize("held", [True, False])
def test_betweenness_by_both_ways(spark, monkeypatch, depth, held):
    monkeypatch.setattr(blocks, "VERTICES", 5)
    monkeypatch.setattr(blocks, "SOURCES", 2)
    monkeypatch.setattr(searches, "NUMBERS", 50)
    monkeypatch.setattr(searches, "SENT", 4)
    if not held:
        monkeypatch.setattr(searches, "EDGES", 0)
    got = {r.address: r.betweenness for r in metrics.betweenness(spark.createDataFrame(LINKS, E), asked(spark), depth).collect()}
    want = _brute(LINKS, set(ASKED), depth)
    n = len({v for e in LINKS for v in e})
    assert got == pytest.approx({v: want[v] * 2 / ((n - 1) * (n - 2)) for v in {v for e in LINKS for v in e}}) and any(got.values())


def test_network_metrics_hold_the_graph_once(spark, monkeypatch):
    """Neither searches by joins nor by cells, and one graph for both centralities; the same rows as those have."""
    edges = spark.createDataFrame([(a, b, 1, 5) for a, b in set(LINKS)], E + ", transfer_count long, total_volume long")
    rows = lambda df: {r.address: (r.betweenness, r.closeness, r.pagerank) for r in df.collect()}
    seen, hold = [], metrics.held
    with monkeypatch.context() as m:
        m.setattr(metrics, "held", lambda e: seen.append(e) or hold(e))
        m.setattr(metrics, "bfs", None)
        m.setattr(metrics, "dependencies_of_sources", None)
        got = rows(metrics.network_metrics(edges, block=1))
    monkeypatch.setattr(searches, "VERTICES", 0)
    want = rows(metrics.network_metrics(edges))
    assert len(seen) == 1 and len(got) == 25 and got.keys() == want.keys() and all(got[v] == pytest.approx(want[v]) for v in got)


COSTS = [(a, b, (7 * k * k + 3) % 5 + (k % 9 > 0)) for k, (a, b) in enumerate(LINKS)]


@pytest.mark.parametrize("kind", ["decimal(38,0)", "double"])
def test_costs_by_both_ways(spark, monkeypatch, kind):
    """Held, no table of distances is made; the rows are those of the joins. Costs of up to 10^17 add up exactly."""
    unit = 10**16 if kind != "double" else 0.5
    costed = spark.createDataFrame([*COSTS, ("v01", "v02", None)], E + ", cost long").selectExpr("from_address", "to_address", f"cast(cost * {unit} as {kind}) as cost")
    monkeypatch.setattr(searches, "NUMBERS", 50)
    monkeypatch.setattr(searches, "SENT", 4)

    def rows():
        near = {r.address: (r.reachable, r.closeness * float(unit)) for r in weighted.weighted_closeness(costed, asked(spark)).collect()}
        return near, {r.address: r.betweenness for r in weighted.weighted_betweenness(costed, asked(spark)).collect()}

    with monkeypatch.context() as m:
        m.setattr(weighted, "weighted_distances", None)
        got = rows()
    monkeypatch.setattr(searches, "VERTICES", 0)
    want = rows()
    assert all(got[k] == {v: pytest.approx(x) for v, x in want[k].items()} for k in (0, 1)) and len(got[0]) == 6 and any(got[1].values())


def test_sums_too_large_for_a_task(spark):
    """Costs without a common unit whose sums may pass 2^62 are added up by joins, as decimals."""
    costed = spark.createDataFrame([("a", "b", str(2**62 - 1)), ("b", "c", str(2**62 - 2)), ("c", "d", "3")], "from_address string, to_address string, c string").selectExpr("from_address", "to_address", "cast(c as decimal(38,0)) as cost")
    assert searches.held(costed, "cost") is None
    got = {r.address: r for r in weighted.weighted_closeness(costed, spark.createDataFrame([("d",)], "address string")).collect()}
    assert got["d"].reachable == 3 and got["d"].closeness == pytest.approx(3 / (3 + (2**62 + 1) + (2**63)))
