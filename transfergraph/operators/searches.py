"""Searches from many sources over a graph of bounded size: the sources are dealt to tasks, and each task gets the edges once and keeps its sources' numbers in arrays.

No row is made for a source and a vertex, whatever the sources reach: what is shuffled are the edges, once for each group of sources. A graph of more than VERTICES or EDGES has none
of this; its searches go by cells (blocks.py) or by joins (metrics.bfs, weighted.weighted_distances).
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, IntegralType

from ..plans.cut import drop, materialise
from .aggregates import prefix_of_values
from .blocks import _ints
from .sets import vertices
from .weighted import counted

#: Vertices and edges of a graph that a task holds, and numbers (a vertex's for a source, or for 64 sources) in one of its arrays (twice as many in between_by_hops), at most.
VERTICES, EDGES, NUMBERS = 1 << 22, 1 << 24, 1 << 22
#: Edges in a row of bytes, on average, and numbers that are sent along edges at a time.
PACK, SENT = 1 << 20, 1 << 18
#: No path: more than any sum of costs.
FAR = 1 << 62


@dataclass
class Graph:
    """Edges u -> v in order of v."""

    n: int
    u: np.ndarray
    v: np.ndarray
    cost: np.ndarray

    def send(self, op: np.ufunc, numbers: np.ndarray, out: np.ndarray, live: np.ndarray, cost: bool = False) -> np.ndarray:
        """The numbers of the live vertices, with the cost of the edge if asked, folded by op into the rows of out that their edges lead to."""
        on = np.flatnonzero(live[self.u])
        u, v = self.u[on], self.v[on]
        size = max(1, SENT // numbers.shape[1])
        for a in range(0, len(on), size):
            w = v[a : a + size]
            first = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
            x = numbers[u[a : a + size]]
            if cost:
                x += self.cost[on[a : a + size], None]
            out[w[first]] = op(out[w[first]], op.reduceat(x, first, axis=0))
        return out

    def turned(self) -> Graph:
        order = np.argsort(self.u, kind="stable")
        return Graph(self.n, self.v[order], self.u[order], self.cost[order] if len(self.cost) else self.cost)


@dataclass
class Held:
    """A graph that a task may hold: every (address, i), n of them, and the edges in packed rows (p, u, v, cost); costs are whole units."""

    every: DataFrame
    n: int
    packed: DataFrame
    kind: type
    unit: int

    def search(self, sources: DataFrame, work: Callable[[Graph, np.ndarray], dict[str, np.ndarray]], schema: str) -> DataFrame:
        """What work(graph, sources) gives for each group of the sources, which are in a column `i`."""
        n, kind, unit = self.n, self.kind, self.unit
        asked, s = counted(prefix_of_values(sources.join(self.every, "address", "left_semi").select("address").distinct(), "address").select(F.col("value").alias("address"), F.col("before").alias("k")))
        groups = max(1, min(s, 3 * self.packed.sparkSession.sparkContext.defaultParallelism))
        some = asked.join(self.every, "address").select((F.col("k") % groups).cast("int").alias("t"), "i", *(F.lit(None).cast(c).alias(x) for x, c in (("p", "int"), ("u", "binary"), ("v", "binary"), ("cost", "binary"))))
        edges = self.packed.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("t"), F.lit(None).cast("long").alias("i"), "p", "u", "v", "cost")

        def run(t: pa.Table) -> pa.Table:
            own = np.sort(t["i"].drop_null().to_numpy())
            parts = t.filter(t["p"].is_valid()).sort_by("p")
            cost = _ints(parts["cost"], kind)
            return pa.table(work(Graph(n, _ints(parts["u"]), _ints(parts["v"]), cost // unit if unit > 1 else cost), own))

        out = materialise(some.unionByName(edges).repartitionByRange(groups, "t").groupBy("t").applyInArrow(run, schema)) if s else self.packed.sparkSession.createDataFrame([], schema)
        drop(asked)
        return out

    def drop(self) -> None:
        drop(self.every)
        drop(self.packed)


def held(edges: DataFrame, cost: str | None = None) -> Held | None:
    """The graph, if a task may hold it and its sums of costs are exact; parallel edges count once, by the least cost, and those of no cost are none."""
    exact = cost is None or isinstance(edges.schema[cost].dataType, (IntegralType, DecimalType))
    kind = np.int64 if exact else np.float64
    x = F.lit(0) if cost is None else F.col(cost) if exact else F.col(cost).cast("double")
    every, n = counted(prefix_of_values(vertices(edges), "address").select(F.col("value").alias("address"), F.col("before").alias("i")))
    least = edges.where(F.expr("from_address <> to_address") & x.isNotNull()).groupBy("from_address", "to_address").agg(F.min(x).alias("cost"))
    end = lambda c, name: every.select(F.col("address").alias(c), F.col("i").alias(name))
    links, m = counted(least.join(end("from_address", "u"), "from_address").join(end("to_address", "v"), "to_address").select("u", "v", "cost"))
    low, high = links.agg(F.min("cost"), F.max("cost")).first()
    if low is not None and low < 0:
        raise ValueError("costs must not be below 0")
    if not n or n > VERTICES or m > EDGES or (exact and (high or 0) >= FAR):
        drop(every)
        drop(links)
        return None
    parts = max(1, -(-m // PACK))

    def pack(t: pa.Table) -> pa.Table:
        t = t.sort_by("v")
        numbers = t["cost"].to_numpy().astype(kind)
        unit = int(np.gcd.reduce(numbers)) if exact else 0
        return pa.table({"p": t["p"][:1], "unit": pa.array([unit], pa.int64()), "u": pa.array([t["u"].to_numpy().astype(np.int32).tobytes()], pa.binary()), "v": pa.array([t["v"].to_numpy().astype(np.int32).tobytes()], pa.binary()),
                         "cost": pa.array([numbers.tobytes() if cost else b""], pa.binary())})

    dealt = links.select(F.floor(F.col("v") * parts / n).cast("int").alias("p"), "u", "v", F.col("cost").cast("long" if exact else "double").alias("cost"))
    packed = materialise(dealt.groupBy("p").applyInArrow(pack, "p int, unit long, u binary, v binary, cost binary"))
    drop(links)
    got = Held(every, n, packed, kind, math.gcd(*(r.unit for r in packed.select("unit").collect())) or 1)  # a row for each pack of edges
    if exact and (high or 0) // got.unit * n >= FAR:
        got.drop()
        return None
    return got


def _chunks(sources: np.ndarray, n: int, wide: int = 1):
    """The sources in runs, each so long that a row of numbers for each vertex is no more than NUMBERS."""
    size = wide * max(1, NUMBERS // n)
    return (sources[a : a + size] for a in range(0, len(sources), size))


def hops(g: Graph, sources: np.ndarray, depth: int | None) -> dict[str, np.ndarray]:
    """(i, reachable, total): how many vertices each source reaches, and by how many edges in all; a bit for each vertex and source."""
    found = {"i": sources, "reachable": np.zeros(len(sources), np.int64), "total": np.zeros(len(sources), np.float64)}
    at = 0
    for some in _chunks(sources, g.n, 64):
        k = np.arange(len(some))
        front = np.zeros((g.n, -(-len(some) // 64)), np.uint64)
        front[some, k // 64] = np.uint64(1) << (k % 64).astype(np.uint64)
        seen, level = front.copy(), 0
        while depth is None or level < depth:
            level += 1
            front = g.send(np.bitwise_or, front, np.zeros_like(front), front.any(axis=1)) & ~seen
            seen |= front
            rows = front[front.any(axis=1)]
            if not len(rows):
                break
            counts = np.zeros(64 * front.shape[1], np.int64)
            for a in range(0, len(rows), 4096):
                counts += np.unpackbits(rows[a : a + 4096].view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint16)
            found["reachable"][at : at + len(some)] += counts[: len(some)]
            found["total"][at : at + len(some)] += level * counts[: len(some)]
        at += len(some)
    return found


def between_by_hops(g: Graph, sources: np.ndarray, depth: int | None) -> dict[str, np.ndarray]:
    """(i, delta): Brandes' dependencies by numbers of edges, added up over the sources, of the vertices that lie between."""
    back, total = g.turned(), np.zeros(g.n)
    for some in _chunks(sources, g.n, 2):  # it holds fewer arrays than the others
        k = len(some)
        front = np.zeros((g.n, k))
        front[some, np.arange(k)] = 1
        seen, levels = front > 0, []
        while depth is None or len(levels) < depth:
            front = g.send(np.add, front, np.zeros_like(front), front.any(axis=1))
            front[seen] = 0
            at = np.flatnonzero(front)
            if not len(at):
                break
            seen.ravel()[at] = True
            levels.append((at, front.ravel()[at]))
        sent = np.zeros((g.n, k))
        for at, paths in reversed(levels):
            got = paths * back.send(np.add, sent, np.zeros_like(sent), sent.any(axis=1)).ravel()[at]
            total += np.bincount(at // k, got, g.n)
            sent[:] = 0
            sent.ravel()[at] = (1 + got) / paths
    i = np.flatnonzero(total)
    return {"i": i, "delta": total[i]}


def _least_sums(g: Graph, some: np.ndarray) -> np.ndarray:
    """The least sum of costs from each source (column) to each vertex (row); FAR or infinite without a path. Rows are sent again as long as they get nearer."""
    far = FAR if g.cost.dtype == np.int64 else np.inf
    d = np.full((g.n, len(some)), far, g.cost.dtype)
    d[some, np.arange(len(some))] = 0
    live = np.zeros(g.n, bool)
    live[some] = True
    while live.any():
        near = g.send(np.minimum, d, np.full_like(d, far), live, True)
        live = (near < d).any(axis=1)
        np.minimum(d, near, out=d)
    return d


def sums(g: Graph, sources: np.ndarray, unit: int) -> dict[str, np.ndarray]:
    """(i, reachable, total): how many vertices each source reaches and the sum of their distances, whole units added up exactly."""
    reachable, total = [], []
    for some in _chunks(sources, g.n):
        d = _least_sums(g, some)
        there = d < (FAR if d.dtype == np.int64 else np.inf)
        reachable.append(there.sum(axis=0) - 1)
        d[~there] = 0
        total += [float(x) for x in d.sum(axis=0)] if d.dtype != np.int64 else [float(((int(a) << 32) + int(b)) * unit) for a, b in zip((d >> 32).sum(axis=0), (d & 0xFFFFFFFF).sum(axis=0))]
    return {"i": sources, "reachable": np.concatenate(reachable), "total": np.array(total)}


def _carried(now: np.ndarray, a: np.ndarray, b: np.ndarray, share: np.ndarray) -> np.ndarray:
    """now, and what it hands on along the pairs a -> b, each taking its share, and what that hands on, until none is left; the pairs make no circle."""
    order = np.argsort(a, kind="stable")
    b, share = b[order], share[order]
    start = np.concatenate([[0], np.cumsum(np.bincount(a, minlength=len(now)))])
    total = now.copy()
    while len(at := np.flatnonzero(now)):
        size = start[at + 1] - start[at]
        pair = np.arange(size.sum()) + np.repeat(start[at] - np.cumsum(size) + size, size)
        now = np.bincount(b[pair], np.repeat(now[at], size) * share[pair], len(now))
        total += now
    return total


def between_by_sums(g: Graph, sources: np.ndarray) -> dict[str, np.ndarray]:
    """(i, delta): Brandes' dependencies by least sums of costs, added up over the sources, of the vertices that lie between."""
    total = np.zeros(g.n)
    for some in _chunks(sources, g.n):
        k = len(some)
        d = _least_sums(g, some)
        far = FAR if d.dtype == np.int64 else np.inf
        a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        size = max(1, SENT // k)
        for e in range(0, len(g.u), size):
            u, v = g.u[e : e + size].astype(np.int64), g.v[e : e + size].astype(np.int64)
            to = d[v]
            edge, source = np.nonzero((d[u] + g.cost[e : e + size, None] == to) & (to < far))
            a.append(u[edge] * k + source)
            b.append(v[edge] * k + source)
        a, b = np.concatenate(a), np.concatenate(b)
        own = some * k + np.arange(k)
        one = np.zeros(g.n * k)
        one[own] = 1
        paths = _carried(one, a, b, np.ones(len(a)))
        share = paths[a] / paths[b]
        delta = _carried(np.bincount(a, share, g.n * k), b, a, share)
        delta[own] = 0
        total += delta.reshape(g.n, k).sum(axis=1)
    i = np.flatnonzero(total)
    return {"i": i, "delta": total[i]}


def closeness_of(graph: Held, targets: DataFrame, depth: int | None = None, weighted: bool = False) -> DataFrame:
    """(address, reachable, _sum) of the targets, by searches against the edges: how many vertices reach each, and their distances to it. Nothing reaches what the graph does not have."""
    unit = graph.unit
    work = (lambda g, s: sums(g.turned(), s, unit)) if weighted else (lambda g, s: hops(g.turned(), s, depth))
    got = graph.search(targets, work, "i long, reachable long, total double").join(graph.every, "i").select("address", "reachable", F.col("total").alias("_sum"))
    return targets.select("address").distinct().join(got, "address", "left").fillna({"reachable": 0, "_sum": 0.0})


def dependencies_of(graph: Held, sources: DataFrame, depth: int | None = None, weighted: bool = False) -> DataFrame:
    """(address, delta) of the vertices that lie between a source and another vertex, added up over the sources."""
    work = between_by_sums if weighted else (lambda g, s: between_by_hops(g, s, depth))
    return graph.search(sources, work, "i long, delta double").groupBy("i").agg(F.sum("delta").alias("delta")).join(graph.every, "i").select("address", "delta")
