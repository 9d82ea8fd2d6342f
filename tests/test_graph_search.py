"""Searches from both ends, weighted distances and sampled centralities on small graphs, against plain Python."""

import heapq
import itertools
import random
from collections import defaultdict
from decimal import Decimal

import pytest

from transfergraph.operators import paths as G
from transfergraph.operators import sampling as S
from transfergraph.operators import weighted as V


def graph(spark, links):
    return spark.createDataFrame([(a, b, Decimal(w), 1) for a, b, w in links], "from_address string, to_address string, total_volume decimal(38,0), transfer_count long").repartition(3)


def random_links(n, m, seed, most=5):
    r = random.Random(seed)
    return sorted({(f"v{r.randrange(n):02d}", f"v{r.randrange(n):02d}"): r.randint(1, most) for _ in range(m)}.items())


def dijkstra(links, source):
    out, heap = {}, [(0, source)]
    near = defaultdict(list)
    for a, b, w in links:
        near[a].append((b, w))
    while heap:
        d, v = heapq.heappop(heap)
        if v not in out:
            out[v] = d
            for w, c in near[v]:
                if w != v:
                    heapq.heappush(heap, (d + c, w))
    return out


def best_paths(links, source, target, cost=None):
    """The cheapest cost and all paths of it, listed: a step is taken only if the target can still be reached at that cost."""
    priced = [(a, b, w if cost else 1) for a, b, w in links if a != b]
    left = dijkstra([(b, a, w) for a, b, w in priced], target)
    near = defaultdict(list)
    for a, b, w in priced:
        near[a].append((b, w))
    best, found, stack = left.get(source), [], [(0, [source])]
    while stack and best is not None:
        d, p = stack.pop()
        if p[-1] == target:
            found.append(p)
        else:
            stack += [(d + c, [*p, b]) for b, c in near[p[-1]] if b in left and d + c + left[b] == best]
    return best, found


@pytest.fixture(scope="module")
def links():
    chain = [(f"c{k}", f"c{k + 1}", 9 - k) for k in range(8)] + [("c0", "c2", 1), ("a", "a", 5), ("x", "c0", 2)]
    return [(a, b, w) for (a, b), w in random_links(18, 40, 3)] + chain + [("v03", "c4", 4), ("island", "shore", 1)]


def test_pairs_meet_in_the_middle(spark, links):
    names = sorted({v for a, b, _ in links for v in (a, b)})
    pairs = [(a, b) for a, b in itertools.product(names[::3], names[::2])] + [("c0", "c8"), ("c0", "c8"), ("shore", "island"), ("nowhere", "c1"), ("c1", "nowhere")]
    got = G.shortest_path_of_pairs(graph(spark, links), spark.createDataFrame(pairs, "seed string, target string"), 6).collect()
    volume = {(a, b): w for a, b, w in links}
    want = {}
    for a, b in set(pairs):
        hops, found = best_paths(links, a, b)
        if a != b and hops is not None and hops <= 6:
            want[a, b] = (hops, max(min(volume[x] for x in itertools.pairwise(p)) for p in found))
    assert {(r.seed, r.end): (r.hops, r.bottleneck) for r in got} == want and len(got) == len(want)
    for r in got:
        assert len(r.path) == r.hops + 1 and r.path[0] == r.seed and r.path[-1] == r.end
        assert min(volume[x] for x in itertools.pairwise(r.path)) == r.bottleneck


def test_two_fronts_hold_less_than_one(spark, monkeypatch):
    """A tree of three children down four levels, and one leaf asked for: one side alone would reach all of it."""
    links = [(f"t{k}", f"t{3 * k + c}", 1) for k in range(40) for c in (1, 2, 3)]
    rows = []
    put = G._Front._put
    monkeypatch.setattr(G._Front, "_put", lambda self, df: (put(self, df), rows.append(self.rows))[0])
    got = G.shortest_path_of_pairs(graph(spark, links), spark.createDataFrame([("t0", "t120")], "seed string, target string"), 6).collect()
    assert [(r.hops, r.path) for r in got] == [(4, ["t0", "t3", "t12", "t39", "t120"][:1] + got[0].path[1:])]
    assert sum(rows) <= 12 < 121


def test_pairs_of_nothing(spark, links):
    none = spark.createDataFrame([], "seed string, target string")
    assert G.shortest_path_of_pairs(graph(spark, links), none, 4).count() == 0
    assert G.shortest_path_of_pairs(graph(spark, []), spark.createDataFrame([("a", "b")], "seed string, target string"), 4).count() == 0


@pytest.mark.parametrize(("kind", "delta"), [("decimal(38,0)", None), ("double", 2.5)])
def test_distances_against_dijkstra(spark, links, kind, delta):
    sources = ["v00", "c0", "island", "alone"]
    costed = graph(spark, links).selectExpr("from_address", "to_address", f"cast(total_volume as {kind}) as cost").unionByName(spark.createDataFrame([("v00", "c9", None)], f"from_address string, to_address string, cost {kind}"))
    got = V.weighted_distances(costed, spark.createDataFrame([(s,) for s in [*sources, "c0"]], "address string"), delta).collect()
    want = {(s, v): d for s in sources for v, d in dijkstra(links, s).items()}
    assert {(r.source, r.address): float(r.distance) for r in got} == want and len(got) == len(want)


def test_costs_must_be_positive(spark):
    costed = spark.createDataFrame([("a", "b", 0)], "from_address string, to_address string, cost long")
    with pytest.raises(ValueError, match="above 0"):
        V.weighted_distances(costed, spark.createDataFrame([("a",)], "address string"))


def test_betweenness_against_listed_paths(spark, links):
    names = sorted({v for a, b, _ in links for v in (a, b)})
    sources = ["v00", "x"]
    want = dict.fromkeys(names, 0.0)
    for s in sources:
        for t in names:
            if t != s:
                _, found = best_paths(links, s, t, True)
                for p in found:
                    for v in p[1:-1]:
                        want[v] += 1 / len(found)
    n = len(names)
    seeds = spark.createDataFrame([(s,) for s in sources], "address string")
    e = graph(spark, links)
    got = V.weighted_betweenness(e.withColumnRenamed("total_volume", "cost"), seeds)
    assert {r.address: r.betweenness for r in got.collect()} == pytest.approx({v: x * 2 / ((n - 1) * (n - 2)) for v, x in want.items()})


def test_closeness_by_volume(spark, links):
    back = [(b, a, w) for a, b, w in links]
    n = len({v for a, b, _ in links for v in (a, b)})
    got = {r.address: r for r in V.weighted_closeness(graph(spark, links).withColumnRenamed("total_volume", "cost"), spark.createDataFrame([("c5",), ("v03",), ("island",)], "address string")).collect()}
    for v, r in got.items():
        d = dijkstra(back, v)
        k = len(d) - 1
        assert r.reachable == k and r.closeness == pytest.approx(k / sum(d.values()) * k / (n - 1) if k else 0.0)
    assert set(got) == {"c5", "v03", "island"}


def test_sampled_betweenness_is_within_its_bound(spark, links):
    names = sorted({v for a, b, _ in links for v in (a, b)})
    n, exact = len(names), dict.fromkeys(names, 0.0)
    for s, t in itertools.permutations(names, 2):
        _, found = best_paths(links, s, t)
        for p in found:
            for v in p[1:-1]:
                exact[v] += 1 / len(found) / (n * (n - 1))
    e = graph(spark, links)
    got = S.sampled_betweenness(e, most=20_000, seed=1, epsilon=0.2, first=128).collect()
    assert {r.address for r in got} == set(names)
    assert all(abs(r.betweenness - exact[r.address]) <= r.bound <= 0.2 for r in got)
    assert {r.pairs for r in got} <= {128, 256, 512}, "drawing stops long before 20,000 pairs"
    assert S.sampled_betweenness(graph(spark, [])).count() == 0


def test_pairs_hang_on_the_seed_and_their_number(spark):
    numbered = spark.createDataFrame([(f"v{k}", k) for k in range(9)], "address string, i long")
    some, more, other = (sorted(map(tuple, S.draw_pairs(numbered, 9, 0, n, seed).collect())) for n, seed in ((300, 1), (400, 1), (300, 2)))
    assert some == more[:300] and some != other and len(some) == 300
    assert all(u != v for _, u, v in more) and len({(u, v) for _, u, v in more}) > 65  # of 72
