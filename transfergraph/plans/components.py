"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .cut import drop, materialise
from .hot import join_counted

#: With so many edges or fewer, the minima of all nodes (two numbers each) are broadcast.
BROADCAST_EDGES = 500_000


def _with_least(edges: DataFrame, least: DataFrame, rows: int) -> DataFrame:
    if rows <= BROADCAST_EDGES:
        return edges.join(F.broadcast(least.drop("n")), "u")
    return join_counted(edges, least, ["u"], "n", rows=rows, write=False)


def _large_star(edges: DataFrame, rows: int) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
    joined = _with_least(both.where("v > u"), least, 2 * rows)
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame, rows: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    joined = _with_least(down, least, rows).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return joined.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _marked(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The written edges with their number and a sum of hashes, which are counted while they are written."""
    seen = Observation()
    out = materialise(edges.observe(seen, F.count("*").alias("rows"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("hash")))
    return out, (seen.get["rows"], seen.get["hash"])


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node that has an edge; component is the smallest node reachable.

    Rows with a null end and self-loops link nothing and are left out (an isolated node is its own component).
    Each round is two steps, each a join with pre-aggregated minima in which nodes of a great share of the edges (the centre of a large
    star) meet a bounded broadcast; only two numbers come back to the driver, and a round's table goes when the next one is written.
    Rounds grow with the logarithm of the longest chain. Raises if max_rounds is not enough rather than return a partial answer.
    """
    now, mark = _marked(edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u <> v").distinct())
    for _ in range(max_rounds):
        if not mark[0]:
            break
        before, old = mark, now
        now, mark = _marked(_small_star(_large_star(old, mark[0]), mark[0]))
        drop(old)
        if mark == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
