"""Rings are two halves that meet: many long ways out that never come back are not walked to their end."""

import itertools
import time
from decimal import Decimal

from transfergraph.operators import coordination, paths

E = "from_address string, to_address string, total_volume decimal(38,0), transfer_count long"


def test_ways_that_do_not_come_back(spark):
    wide = 60
    links = [("a", f"l1_{k:02d}") for k in range(wide)]
    links += [(f"l{n}_{i:02d}", f"l{n + 1}_{j:02d}") for n in range(1, 5) for i in range(wide) for j in range(wide)]  # 60^5 paths of five edges
    links += itertools.pairwise(["a", "r1", "r2", "r3", "r4", "r5", "a"])
    edges = spark.createDataFrame([(a, b, Decimal(7), 1) for a, b in links], E)
    start = time.time()
    got = coordination.rings(edges, 6, 4, spark.createDataFrame([("a",)], "address string")).collect()
    assert [(r.length, r.path, int(r.total)) for r in got] == [(6, ["a", "r1", "r2", "r3", "r4", "r5", "a"], 42)]
    assert time.time() - start < 120


def test_all_cycles_of_a_dense_graph(spark):
    names = "abcdefg"
    links = [(a, b, 1 + (i * 5 + j * 3) % 11, 1) for i, a in enumerate(names) for j, b in enumerate(names) if (i * 3 + j * 5) % 4 or a == b]
    costs = {(a, b): w for a, b, w, _ in links}
    want = {}
    for k in range(2, 7):
        for p in itertools.permutations(names, k):
            steps = list(itertools.pairwise([*p, p[0]]))
            if all(s in costs for s in steps) and costs[steps[0]] >= 4:
                want[(p[0], k, "".join([*p, p[0]]))] = (min(costs[s] for s in steps), sum(costs[s] for s in steps))
    edges = spark.createDataFrame([(a, b, Decimal(w), n) for a, b, w, n in links], E)
    got = {(r.seed, r.length, "".join(r.path)): (int(r.bottleneck), int(r.total)) for r in paths.circular_flows(edges, None, 6, 4).collect()}
    assert got == want and len(want) > 100
