"""Distances over weighted edges to a fixed point (delta-stepping), and closeness and betweenness by them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, IntegralType

from ..plans.cut import drop, materialise
from .sets import vertices

#: Tables of one kind are folded into one when there are so many.
FOLD = 8


def counted(df: DataFrame) -> tuple[DataFrame, int]:
    """df written, and its number of rows, counted while it is written."""
    seen = Observation()
    return materialise(df.observe(seen, F.count("*").alias("rows"))), seen.get["rows"]


class Parts:
    """A table that grows by written parts; all but the last are folded into one when they are many, so that plans and files stay few."""

    def __init__(self, first: DataFrame):
        self.parts = [first]

    def add(self, part: DataFrame) -> None:
        self.parts.append(part)
        if len(self.parts) >= FOLD:
            *old, last = self.parts
            self.parts = [materialise(reduce(DataFrame.unionByName, old)), last]
            for p in old:
                drop(p)

    def whole(self) -> DataFrame:
        return reduce(DataFrame.unionByName, self.parts)

    def drop(self) -> None:
        for p in self.parts:
            drop(p)


def weighted_distances(costed: DataFrame, sources: DataFrame, delta: float | int | None = None, zero: bool = False) -> DataFrame:
    """(source, address, distance) of all that each source reaches: the least sum of cost along the edges, without a bound on their number.

    costed: from_address, to_address, cost > 0, or >= 0 with `zero` (a null cost is no edge; of edges between the same two the cheapest counts). Integer and
    decimal costs stay exact. Delta-stepping: distances are settled bucket by bucket, each `delta` wide (the mean cost if not given). Within the least bucket edges
    of at most delta are followed until nothing in it gets nearer, each round from the rows that did; then the edges that leave the bucket are followed
    once from all of it. So settled rows are never joined with edges again, and a round is one join and one aggregation for all sources. The
    driver gets a count a round and a number a bucket.
    """
    exact = isinstance(costed.schema["cost"].dataType, (IntegralType, DecimalType))
    kind = "decimal(38,0)" if exact else "double"
    edges = materialise(costed.where("from_address <> to_address and cost is not null").groupBy(F.col("from_address").alias("address"), F.col("to_address").alias("_to")).agg(F.min(F.col("cost").cast(kind)).alias("_cost")))
    least, mean = edges.agg(F.min("_cost"), F.avg("_cost")).first()
    if least is not None and (least < 0 or least == 0 and not zero):
        raise ValueError("costs must not be below 0" if zero else "costs must be above 0")
    delta = delta or mean or 1
    delta = max(1, int(delta)) if exact else float(delta)
    columns = ["source", "address", "distance"]
    waiting = materialise(sources.select(F.col("address").alias("source"), "address", F.lit(0).cast(kind).alias("distance")).distinct())
    settled = Parts(waiting.sparkSession.createDataFrame([], waiting.schema))

    def nearest(*tables: DataFrame) -> DataFrame:
        return reduce(DataFrame.unionByName, tables).groupBy("source", "address").agg(F.min("distance").cast(kind).alias("distance"))

    def follow(rows: DataFrame, along: DataFrame) -> DataFrame:
        return rows.join(along, "address").select("source", F.col("_to").alias("address"), (F.col("distance") + F.col("_cost")).cast(kind).alias("distance"))

    while (low := waiting.agg(F.min("distance")).first()[0]) is not None:
        top = F.lit(str((int(low) // delta + 1) * delta) if exact else (low // delta + 1) * delta).cast(kind)  # text, as a long may be too small
        bucket = Parts(materialise(waiting.where(F.col("distance") < top)))
        active, n = bucket.parts[0], 1
        while n:
            near = follow(active, edges.where(F.col("_cost") <= F.lit(str(delta) if exact else delta).cast(kind))).where(F.col("distance") < top)
            near = nearest(near).join(settled.whole().select("source", "address"), ["source", "address"], "left_anti")
            known = nearest(bucket.whole()).withColumnRenamed("distance", "_known")
            better = near.join(known, ["source", "address"], "left").where("_known is null or distance < _known").select(*columns)
            active, n = counted(better)
            bucket.add(active)
        done = materialise(nearest(bucket.whole()))
        bucket.drop()
        settled.add(done)
        out = follow(done, edges).where(F.col("distance") >= top)
        rest = nearest(out, waiting.where(F.col("distance") >= top)).join(settled.whole().select("source", "address"), ["source", "address"], "left_anti")
        old, waiting = waiting, materialise(rest.select(*columns))
        drop(old)
    result = materialise(settled.whole())
    settled.drop()
    drop(edges)
    return result


def weighted_closeness(costed: DataFrame, targets: DataFrame, delta: float | int | None = None) -> DataFrame:
    """(address, reachable, closeness) of the targets: by distances to each along the edges, scaled by the share of vertices that reach it.

    Targets are dealt to tasks that hold the graph (see searches.py); in a larger graph, distances are found by joins.
    """
    from .searches import closeness_of, held

    if (graph := held(costed, "cost")) is not None:
        d = materialise(closeness_of(graph, targets, weighted=True))
        graph.drop()
    else:
        back = costed.select(F.col("to_address").alias("from_address"), F.col("from_address").alias("to_address"), "cost")
        d = weighted_distances(back, targets, delta, True).groupBy(F.col("source").alias("address")).agg((F.count("*") - 1).alias("reachable"), F.sum("distance").cast("double").alias("_sum"))
    n = vertices(costed).agg(F.count("*").alias("_n"))
    x = d.crossJoin(F.broadcast(n))  # one row
    return x.select("address", "reachable", F.when((F.col("_sum") > 0) & (F.col("_n") > 1), F.col("reachable") / F.col("_sum") * F.col("reachable") / (F.col("_n") - 1)).otherwise(0.0).alias("closeness"))


def dependencies(tight: DataFrame, reached: DataFrame) -> DataFrame:
    """(source, address, delta): Brandes' dependency of each source on each vertex.

    tight: (source, v, w), the edges that lie on shortest paths of each source; reached: (source, address). Numbers of paths are added up by
    their number of edges, front by front; dependencies are the same sums taken backwards, each front giving its predecessors their share of
    paths. Edges of shortest paths make no circle, so both end after the longest of them.
    """
    front = materialise(reached.where("source = address").select("source", "address", F.lit(1.0).alias("sigma")))
    paths, n = Parts(front), 1
    while n:
        step = tight.join(front, (tight.v == front.address) & (tight.source == front.source)).select(tight.source, F.col("w").alias("address"), "sigma")
        front, n = counted(step.groupBy("source", "address").agg(F.sum("sigma").alias("sigma")))
        paths.add(front)
    sigma = materialise(paths.whole().groupBy("source", "address").agg(F.sum("sigma").alias("sigma")))
    shares = tight.join(sigma.select("source", F.col("address").alias("v"), F.col("sigma").alias("_v")), ["source", "v"]).join(sigma.select("source", F.col("address").alias("w"), F.col("sigma").alias("_w")), ["source", "w"])
    shares = materialise(shares.select("source", "v", "w", (F.col("_v") / F.col("_w")).alias("share")))
    paths.drop()
    drop(sigma)
    now, n = counted(shares.groupBy("source", F.col("v").alias("address")).agg(F.sum("share").alias("delta")))
    every = Parts(now)
    while n:
        step = shares.join(now.withColumnRenamed("address", "w"), ["source", "w"]).groupBy("source", F.col("v").alias("address")).agg(F.sum(F.col("share") * F.col("delta")).alias("delta"))
        now, n = counted(step)
        every.add(now)
    out = materialise(every.whole().groupBy("source", "address").agg(F.sum("delta").alias("delta")))
    every.drop()
    drop(shares)
    return out


def _no_circle(free: DataFrame) -> None:
    """Raise if the edges (v, w) make a circle; what no edge leads to is taken away until nothing is left, so rounds grow with the longest path."""
    free, n = counted(free.select("v", "w").distinct())
    while n:
        left, m = counted(free.join(free.select(F.col("w").alias("v")).distinct(), "v", "left_semi"))
        if m == n:
            raise ValueError("edges of cost 0 make a circle, along which paths of the same sum are endless")
        drop(free)
        free, n = left, m
    drop(free)


def weighted_betweenness(costed: DataFrame, sources: DataFrame, delta: float | int | None = None) -> DataFrame:
    """(address, betweenness): dependencies over the cheapest paths of the sources, scaled by 2 / ((n - 1)(n - 2)).

    Paths of the same sum are told apart from others by equality, so costs should be integers or decimals; with floating costs, ties by different ways
    of adding up may be missed.
    Edges of cost 0 are steps like others; a circle of them is refused, as its paths cannot be counted. Sources are dealt to tasks that hold the graph
    (see searches.py); in a larger graph, distances and paths are found by joins.
    """
    from .searches import dependencies_of, held

    kind = "decimal(38,0)" if isinstance(costed.schema["cost"].dataType, (IntegralType, DecimalType)) else "double"
    e = costed.where("from_address <> to_address").groupBy(F.col("from_address").alias("v"), F.col("to_address").alias("w")).agg(F.min(F.col("cost").cast(kind)).alias("_cost"))
    _no_circle(e.where("_cost = 0"))
    every = materialise(vertices(costed))
    n = every.count()
    if (graph := held(costed, "cost")) is not None:
        delta_of = materialise(dependencies_of(graph, sources, weighted=True))
        graph.drop()
    else:
        d = weighted_distances(costed, sources, delta, True)
        ends = d.select("source", F.col("address").alias("w"), F.col("distance").alias("_far"))
        tight = materialise(d.withColumnRenamed("address", "v").join(e, "v").join(ends, ["source", "w"]).where((F.col("distance") + F.col("_cost")).cast(kind) == F.col("_far")).select("source", "v", "w"))
        delta_of = dependencies(tight, d).where("source <> address").groupBy("address").agg(F.sum("delta").alias("delta"))
        drop(tight)
    scale = 2 / ((n - 1) * (n - 2)) if n > 2 else 0.0
    return every.join(delta_of.select("address", (F.col("delta") * scale).alias("betweenness")), "address", "left").fillna(0.0, ["betweenness"])
