"""Brandes' dependencies of many sources at once: a level of their searches is a product of cells of the graph with blocks of numbers."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.cut import drop, materialise
from .aggregates import prefix_of_values
from .sets import vertices
from .weighted import Parts, counted

#: Vertices of a block, sources of a chunk, and numbers that meet in a group, at most; edges of a cell, on average. A task's memory follows these, not the graph.
VERTICES, SOURCES, NUMBERS, EDGES = 32_768, 64, 1 << 24, 1 << 22
#: Edges that a product takes at a time.
SLICE = 1 << 15
#: b: block of vertices, c: chunk of sources, at: vertex within the block * sources of a chunk + source within the chunk (int32), x: a number for each (double).
PART = "b int, c int, at binary, x binary"


def _ints(column: pa.ChunkedArray, kind=np.int32) -> np.ndarray:
    """The numbers of all rows of a column of bytes, one after the other."""
    return np.concatenate([np.frombuffer(b.as_buffer(), kind) for b in column if b.is_valid] or [np.empty(0, kind)])


def _part(b: int, c: int, at: np.ndarray, x: np.ndarray) -> pa.Table:
    got = len(at) > 0
    return pa.table({"b": pa.array([b] * got, pa.int32()), "c": pa.array([c] * got, pa.int32()), "at": pa.array([at.astype(np.int32).tobytes()] * got, pa.binary()), "x": pa.array([x.astype(np.float64).tobytes()] * got, pa.binary())})


def _cells(links: DataFrame, u: str, v: str, blocks: int) -> DataFrame:
    """(i, j, ends): the edges u -> v from block i to block j, as their places in the blocks, in order of the target."""

    def pack(t: pa.Table) -> pa.Table:
        ends = np.stack([t["u"].to_numpy(), t["v"].to_numpy()]).astype(np.int32)
        return pa.table({"i": t["i"][:1], "j": t["j"][:1], "ends": pa.array([ends[:, np.argsort(ends[1], kind="stable")].tobytes()], pa.binary())})

    place = lambda c: F.floor(F.col(c) / blocks).cast("int")
    block = lambda c: F.pmod(F.col(c), F.lit(blocks)).cast("int")
    return materialise(links.select(block(u).alias("i"), block(v).alias("j"), place(u).alias("u"), place(v).alias("v")).groupBy("i", "j").applyInArrow(pack, "i int, j int, ends binary"))


def _product(front: pa.Table, cell: pa.Table, sources: int) -> pa.Table:
    """For each target and source the sum of the front's numbers over the edges into the target; a target may come more than once."""
    if not front.num_rows or not cell.num_rows:
        return _part(0, 0, np.empty(0), np.empty(0))
    u, v = _ints(cell["ends"]).reshape(2, -1)
    at = _ints(front["at"])
    numbers = np.zeros((max(int(u.max()), int(at.max()) // sources) + 1, sources))
    numbers.ravel()[at] = _ints(front["x"], np.float64)
    live = numbers.any(axis=1)[u]
    u, v = u[live], v[live]
    found, sums = [np.empty(0, np.int64)], [np.empty(0)]
    for a in range(0, len(u), SLICE):
        w = v[a : a + SLICE]
        first = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
        got = np.add.reduceat(numbers[u[a : a + SLICE]], first, axis=0)
        row, source = np.nonzero(got)
        found.append(w[first][row].astype(np.int64) * sources + source)
        sums.append(got[row, source])
    return _part(cell["j"][0].as_py(), front["c"][0].as_py(), np.concatenate(found), np.concatenate(sums))


def _step(front: DataFrame, cells: DataFrame, blocks: int, chunks: int, sources: int) -> DataFrame:
    """The front's numbers sent along the edges, a part for each cell that has any; each block of numbers meets the cells of its block one by one."""
    sent = front.select(F.col("b").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("j"), "c", "at", "x")
    there = cells.select("i", "j", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("c"), "ends")
    return sent.groupBy("i", "j", "c").cogroup(there.groupBy("i", "j", "c")).applyInArrow(lambda a, b: _product(a, b, sources), PART)


def _added(parts: pa.Table, size: int = 0) -> np.ndarray:
    return np.bincount(_ints(parts["at"]), _ints(parts["x"], np.float64), size)


def _new(key: tuple, parts: pa.Table, seen: pa.Table) -> pa.Table:
    """The parts of one block and chunk added up, without what was seen on earlier levels."""
    sums, old = _added(parts), _ints(seen["at"])
    sums[old[old < len(sums)]] = 0
    at = np.flatnonzero(sums)
    return _part(key[0].as_py(), key[1].as_py(), at, sums[at])


BACK = PART + ", v binary, delta binary"


def _handed_back(key: tuple, level: pa.Table, parts: pa.Table, sources: int) -> pa.Table:
    """One block and chunk of a level: x is what it hands on to the level before, (1 + dependency) / number of paths; delta is the dependency on each vertex v, added up over the chunk."""
    at, sigma = _ints(level["at"]), _ints(level["x"], np.float64)
    if not len(at):
        return _part(0, 0, at, sigma).append_column("v", pa.array([], pa.binary())).append_column("delta", pa.array([], pa.binary()))
    got = sigma * _added(parts, int(at.max()) + 1)[at]
    v, place = np.unique(at // sources, return_inverse=True)
    out = _part(key[0].as_py(), key[1].as_py(), at, (1 + got) / sigma)
    return out.append_column("v", pa.array([v.astype(np.int32).tobytes()], pa.binary())).append_column("delta", pa.array([np.bincount(place, got).tobytes()], pa.binary()))


def dependencies_of_sources(edges: DataFrame, sources: DataFrame, max_depth: int | None = None) -> tuple[DataFrame, int]:
    """(address, delta) of the vertices that lie between a source and another vertex: Brandes' dependencies by numbers of edges, added up over the sources; and the number of vertices.

    Vertices are numbered and dealt into blocks, sources into chunks, edges into cells by the blocks of their ends. A level is one product of cells and blocks of
    numbers (paths on the way out, shares of dependencies on the way back) and one sum for each block and chunk, so no row is made for a source and an edge: what is
    shuffled are 12 bytes for each vertex that a source reaches on a level, once for each block, and the edges once for each chunk and level.
    """
    every, n = counted(prefix_of_values(vertices(edges), "address").select(F.col("value").alias("address"), F.col("before").alias("i")))
    none = every.select("address", F.lit(0.0).alias("delta")).where(F.lit(False))
    asked, s = counted(prefix_of_values(sources.join(every, "address", "left_semi").select("address").distinct(), "address").select(F.col("value").alias("address"), F.col("before").alias("k")))
    if not n or not s:
        return none, n
    end = lambda c, name: every.select(F.col("address").alias(c), F.col("i").alias(name))
    links, m = counted(edges.where("from_address <> to_address").select("from_address", "to_address").distinct().join(end("from_address", "_u"), "from_address").join(end("to_address", "_v"), "to_address").select("_u", "_v"))
    tasks = 2 * every.sparkSession.sparkContext.defaultParallelism
    blocks, wide = max(1, -(-n // VERTICES), math.isqrt(m // EDGES)), max(1, min(SOURCES, NUMBERS // n, max(8, -(-s // tasks))))
    chunks = -(-s // wide)
    ahead, back = _cells(links, "_u", "_v", blocks), _cells(links, "_v", "_u", blocks)

    def start(t: pa.Table) -> pa.Table:
        return _part(t["b"][0].as_py(), t["c"][0].as_py(), t["at"].to_numpy(), np.ones(t.num_rows))

    at = F.floor(F.col("i") / blocks) * wide + F.pmod(F.col("k"), F.lit(wide))
    front = materialise(asked.join(every, "address").select(F.pmod("i", F.lit(blocks)).cast("int").alias("b"), F.floor(F.col("k") / wide).cast("int").alias("c"), at.alias("at")).groupBy("b", "c").applyInArrow(start, PART))
    levels, rows = [front], 1
    seen = Parts(front.select("b", "c", "at"))
    while rows and (max_depth is None or len(levels) <= max_depth):
        got = _step(front, ahead, blocks, chunks, wide).groupBy("b", "c").cogroup(seen.whole().groupBy("b", "c")).applyInArrow(_new, PART)
        front, rows = counted(got)
        levels.append(front)
        seen.add(front.select("b", "c", "at"))
    seen.drop()
    sent, given = levels[-1].limit(0), []
    for level in reversed(levels[1:]):  # from the far ends back to the sources
        got = level.groupBy("b", "c").cogroup(_step(sent, back, blocks, chunks, wide).groupBy("b", "c")).applyInArrow(lambda key, a, b: _handed_back(key, a, b, wide), BACK)
        sent = materialise(got)
        given.append(sent)
    if not given:
        return none, n

    def spread(batches):
        for t in batches:
            for b, v, x in zip(t["b"], t["v"], t["delta"], strict=True):
                v, x = np.frombuffer(v.as_buffer(), np.int32), np.frombuffer(x.as_buffer(), np.float64)
                yield pa.RecordBatch.from_pydict({"i": v.astype(np.int64) * blocks + b.as_py(), "delta": x})

    sums = reduce(DataFrame.unionByName, given).select("b", "v", "delta").mapInArrow(spread, "i long, delta double").groupBy("i").agg(F.sum("delta").alias("delta"))
    out = materialise(every.join(sums.where("delta <> 0"), "i").select("address", "delta"))
    for t in (links, ahead, back, asked, every, *levels, *given):
        drop(t)
    return out, n
