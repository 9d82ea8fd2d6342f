"""Paths: rounds of joins that keep only what a question needs (a target, an amount, the best state of each vertex)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.times import days_between, micros
from ..plans.cut import drop, materialise
from .filters import ladder
from .sets import undirected_view
from .topk import topk

UNIT = 10**12


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _step(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("from_address").alias("end"), F.col("to_address").alias("_to"), F.col("total_volume").alias("_volume"), F.col("transfer_count").alias("_count"))


def enumerate_paths(edges: DataFrame, seeds: DataFrame | None = None, max_depth: int = 3, min_volume: int = 0) -> DataFrame:
    """(seed, end, hops, path, last_volume, total, bottleneck): all simple directed paths of 1 to max_depth edges from each seed (every vertex without).

    The number of paths grows with the mean degree to the power max_depth: ask safe_depth() first. Each round is one equi-join.
    """
    e = edges.where((F.col("total_volume") >= min_volume) & (F.col("from_address") != F.col("to_address")))
    first = e if seeds is None else e.join(seeds.select(F.col("address").alias("from_address")).distinct(), "from_address")
    now = first.select(
        F.col("from_address").alias("seed"), F.col("to_address").alias("end"), F.lit(1).alias("hops"), F.array("from_address", "to_address").alias("path"), F.col("total_volume").alias("last_volume"), F.col("total_volume").alias("total"), F.col("total_volume").alias("bottleneck")
    )
    out, step = [now], _step(e)
    for k in range(2, max_depth + 1):
        now = now.join(step, "end").where(~F.array_contains("path", F.col("_to"))).select(
            "seed", F.col("_to").alias("end"), F.lit(k).alias("hops"), F.array_append("path", F.col("_to")).alias("path"), F.col("_volume").alias("last_volume"), (F.col("total") + F.col("_volume")).cast("decimal(38,0)").alias("total"),
            F.least("bottleneck", "_volume").alias("bottleneck"),
        )
        out.append(now)
    return _union(out)


def multi_hop_connections(edges: DataFrame, accounts: DataFrame, seeds: DataFrame, max_depth: int = 3, min_volume: int = 0, limit: int = 100) -> DataFrame:
    """The best-connected destinations of each seed: least hops, number of paths, best bottleneck, and the destination's account."""
    p = enumerate_paths(edges, seeds, max_depth, min_volume).groupBy("seed", "end").agg(F.min("hops").alias("min_hops"), F.count("*").alias("paths"), F.max("bottleneck").alias("best_bottleneck"))
    best = topk(p, ["seed"], [F.col("min_hops"), F.col("best_bottleneck").desc(), F.col("end")], limit)
    return best.join(accounts.select(F.col("address").alias("end"), "display", "balance", "risk_score", "node_type"), "end", "left")


def subgraph(edges: DataFrame, seeds: DataFrame, depth: int = 2) -> DataFrame:
    """(seed, address, depth): accounts within `depth` undirected steps of each seed, with the least number of steps."""
    v = undirected_view(edges).select("address", "other").distinct()
    front = seeds.select(F.col("address").alias("seed"), "address", F.lit(0).alias("depth")).distinct()
    seen = front
    for k in range(1, depth + 1):
        front = front.join(v, "address").select("seed", F.col("other").alias("address"), F.lit(k).alias("depth")).distinct().join(seen.select("seed", "address"), ["seed", "address"], "left_anti")
        seen = seen.unionByName(front)
    return seen


def subgraph_with_edges(edges: DataFrame, seeds: DataFrame, depth: int = 2) -> DataFrame:
    """(seed, from_address, to_address, total_volume): edges with both ends in a seed's subgraph."""
    n = subgraph(edges, seeds, depth).select("seed", "address")
    a = n.withColumnRenamed("address", "from_address").join(edges, "from_address")
    return a.join(n.withColumnRenamed("address", "to_address"), ["seed", "to_address"], "left_semi").select("seed", "from_address", "to_address", "total_volume")


def shortest_path(edges: DataFrame, seeds: DataFrame, max_depth: int = 6, targets: DataFrame | None = None) -> DataFrame:
    """(seed, end, hops, bottleneck, path): fewest hops from each seed, of equal ones the largest bottleneck, then the first path.

    A round keeps one row per (seed, vertex) and only vertices not reached before go on, so the state is bounded by seeds x vertices.
    It ends when no vertex is new. With targets (address) only paths that end in them are returned.
    """
    out = _fewest_hops(edges, seeds, max_depth)
    return out if targets is None else out.join(targets.select(F.col("address").alias("end")).distinct(), "end", "left_semi")


def shortest_path_of_pairs(edges: DataFrame, pairs: DataFrame, max_depth: int = 6) -> DataFrame:
    """(seed, end, hops, bottleneck, path) of the given (seed, target) that at most max_depth edges join: fewest hops, of equal ones the largest bottleneck, then a fixed one.

    Two fronts grow towards each other, one from all seeds along the edges and one from all targets against them; each round grows the one
    of fewer rows. A pair is found in the first round in which its fronts share a vertex: all of its shortest paths lie on those vertices,
    so the best is the best meeting. Seeds and targets whose pairs are all found, or whose front has ended, take no part in the next round. Pairs that
    repeat count once, and one from a vertex to itself is left out. A front holds seeds times what half the distance reaches, not what the whole does.
    """
    e = materialise(_step(edges.where("from_address <> to_address")))
    wanted = materialise(pairs.select("seed", F.col("target").alias("end")).where("seed <> end").distinct())
    ahead, back = _Front(_start(wanted, "seed"), e), _Front(_start(wanted, "end"), e.select(F.col("_to").alias("end"), F.col("end").alias("_to"), "_volume"))
    found, asked = [], [wanted]
    for k in range(1, max_depth + 1):
        (ahead if ahead.rows <= back.rows else back).grow()
        here = wanted.join(ahead.now.select("seed", F.col("end").alias("_at"), F.col("bottleneck").alias("_b"), F.col("path").alias("_p")), "seed")
        there = back.now.select(F.col("seed").alias("end"), F.col("end").alias("_at"), "bottleneck", F.reverse("path").alias("path"))
        path = F.concat("_p", F.slice("path", F.lit(2), F.size("path") - 1))
        met = here.join(there, ["end", "_at"]).select("seed", "end", F.struct((-F.least("bottleneck", "_b")).alias("b"), path.alias("path")).alias("s"))
        best = met.groupBy("seed", "end").agg(F.min("s").alias("s"))
        found.append(materialise(best.select("seed", "end", F.lit(k).alias("hops"), (-F.col("s.b")).cast("decimal(38,0)").alias("bottleneck"), F.col("s.path").alias("path"))))
        left = wanted.join(found[-1].select("seed", "end"), ["seed", "end"], "left_anti")
        left = left.join(ahead.now.select("seed").distinct(), "seed", "left_semi").join(back.now.select(F.col("seed").alias("end")).distinct(), "end", "left_semi")
        wanted = materialise(left)
        asked.append(wanted)
        ahead.keep(wanted.select("seed"))
        back.keep(wanted.select(F.col("end").alias("seed")))
        if wanted.isEmpty():
            break
    for t in (e, *asked, *ahead.levels, *back.levels):
        drop(t)
    return _union(found)


def _start(df: DataFrame, column: str) -> DataFrame:
    """(seed, end, bottleneck, path): each distinct value of a column as the start of a search."""
    at = F.col(column)
    return df.select(at.alias("seed"), at.alias("end"), F.lit(None).cast("decimal(38,0)").alias("bottleneck"), F.array(at).alias("path")).distinct()


class _Front:
    """The vertices that a search from many starts reached last, with the best path to each; those reached before are on the levels behind it."""

    def __init__(self, start: DataFrame, edges: DataFrame):
        self.edges, self.levels = edges, []
        self._put(start)

    def _put(self, df: DataFrame) -> None:
        self.now = materialise(df)
        self.rows = self.now.count()
        self.levels.append(self.now)

    def keep(self, starts: DataFrame) -> None:
        self.now = self.now.join(starts.distinct(), "seed", "left_semi")

    def grow(self) -> None:
        reached = self.now.join(self.edges, "end").select("seed", F.col("_to").alias("end"), F.least("bottleneck", "_volume").alias("bottleneck"), F.array_append("path", F.col("_to")).alias("path"))
        new = reached.join(_union([x.select("seed", "end") for x in self.levels]), ["seed", "end"], "left_anti").groupBy("seed", "end").agg(F.min(F.struct((-F.col("bottleneck")).alias("b"), "path")).alias("s"))
        self._put(new.select("seed", "end", (-F.col("s.b")).cast("decimal(38,0)").alias("bottleneck"), F.col("s.path").alias("path")))


def _fewest_hops(edges: DataFrame, seeds: DataFrame, max_depth: int) -> DataFrame:
    e = materialise(_step(edges.where("from_address <> to_address")))
    start = seeds.select(F.col("address").alias("seed"), F.col("address").alias("end"), F.lit(0).alias("hops"), F.lit(None).cast("decimal(38,0)").alias("bottleneck"), F.array("address").alias("path"))
    front = materialise(start.distinct())
    seen = front
    for k in range(1, max_depth + 1):
        reached = front.join(e, "end").select("seed", F.col("_to").alias("end"), F.least("bottleneck", "_volume").alias("bottleneck"), F.array_append("path", F.col("_to")).alias("path"))
        new = reached.join(seen.select("seed", "end"), ["seed", "end"], "left_anti").groupBy("seed", "end").agg(F.min(F.struct((-F.col("bottleneck")).alias("b"), "path")).alias("best"))
        front = materialise(new.select("seed", "end", F.lit(k).alias("hops"), (-F.col("best.b")).cast("decimal(38,0)").alias("bottleneck"), F.col("best.path").alias("path")))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen.where("hops > 0")


def edge_cost(weight: str, as_of: Column | None = None) -> Column:
    """What an edge costs: hops 1; volume 1 / (1 + log10(1 + floor(volume / 1e9))); risk 1 + score / 100; time 1 + log10(1 + age in days); hours max(1, age in hours)."""
    if weight == "hops":
        return F.lit(1.0)
    if weight == "volume":
        return 1 / (1 + F.log10(1 + F.floor(F.col("total_volume") / 10**9).cast("double")))
    if weight == "risk":
        return 1 + F.col("risk_score") / 100
    age = days_between(F.col("last_transfer_time"), as_of)
    return 1 + F.log10(1 + age) if weight == "time" else F.greatest(F.lit(1.0), age * 24)


def weighted_shortest_path(costed: DataFrame, seeds: DataFrame, max_depth: int = 4) -> DataFrame:
    """(seed, end, cost, hops, path): the cheapest path of at most max_depth edges from each seed. costed: from_address, to_address, cost >= 0.

    Bellman-Ford by rounds: the state is the best row of each (seed, vertex) that the last round improved.
    """
    e = materialise(costed.where("from_address <> to_address").select(F.col("from_address").alias("end"), F.col("to_address").alias("_to"), F.col("cost").alias("_cost")))
    best = materialise(seeds.select(F.col("address").alias("seed"), F.col("address").alias("end"), F.lit(0.0).alias("cost"), F.lit(0).alias("hops"), F.array("address").alias("path")).distinct())
    front = best
    for k in range(1, max_depth + 1):
        reached = front.join(e, "end").select("seed", F.col("_to").alias("end"), (F.col("cost") + F.col("_cost")).alias("cost"), F.lit(k).alias("hops"), F.array_append("path", F.col("_to")).alias("path"))
        old = F.struct("cost", "hops", "path")
        now = best.select("seed", "end", old.alias("s")).unionByName(reached.select("seed", "end", old.alias("s"))).groupBy("seed", "end").agg(F.min("s").alias("s"))
        best = materialise(now.select("seed", "end", "s.*"))
        front = best.where(F.col("hops") == k)
    return best.where("hops > 0")


def all_paths(edges: DataFrame, pairs: DataFrame, max_depth: int = 4, max_paths: int = 100, min_volume: int = 0) -> DataFrame:
    """Simple paths between the given (seed, target) pairs, the max_paths shortest of each pair."""
    p = enumerate_paths(edges, pairs.select(F.col("seed").alias("address")), max_depth, min_volume)
    hit = p.join(pairs.select("seed", F.col("target").alias("end")).distinct(), ["seed", "end"])
    return topk(hit, ["seed", "end"], [F.col("hops"), F.col("path")], max_paths)


def high_value_paths(edges: DataFrame, pairs: DataFrame, min_volume: int, max_depth: int = 5, limit: int = 20) -> DataFrame:
    p = all_paths(edges, pairs, max_depth, 2**31 - 1, min_volume)
    return topk(p, ["seed", "end"], [F.col("bottleneck").desc(), F.col("hops"), F.col("path")], limit)


def quickest_paths(edges: DataFrame, seeds: DataFrame, as_of: Column, window_days: int = 30, max_depth: int = 4) -> DataFrame:
    """Cheapest paths over edges that were active in the window, each edge costing the hours since its last transfer (at least 1)."""
    active = edges.where(days_between(F.col("last_transfer_time"), as_of) <= window_days)
    return weighted_shortest_path(active.withColumn("cost", edge_cost("hours", as_of)), seeds, max_depth)


def path_risk(paths: DataFrame, metrics: DataFrame, edges: DataFrame) -> DataFrame:
    """Per (seed, end, path): average and highest node risk, average edge risk, flags, total risk and its level.

    Edge risk: mean risk of its ends, and 30 more for a single transfer of over one unit, 100 at most. Flags: mixers and exchanges on the path, and such
    single transfers. Total: 0.4 node + 0.3 edge + 0.3 * 20 per flag, 100 at most.
    """
    p = paths.withColumn("_id", F.xxhash64("path")).select("_id", "path", "seed", "end")
    node = metrics.select("address", F.coalesce("risk_score", F.lit(0.0)).alias("risk"), F.coalesce(F.col("node_type").isin("mixer", "exchange"), F.lit(False)).cast("int").alias("flag"))
    n = p.select("path", F.explode("path").alias("address")).join(node, "address", "left").groupBy("path").agg(F.avg(F.coalesce("risk", F.lit(0.0))).alias("node_risk"), F.max(F.coalesce("risk", F.lit(0.0))).alias("max_node_risk"), F.coalesce(F.sum("flag"), F.lit(0)).alias("node_flags"))
    single = (F.col("transfer_count") == 1) & (F.col("total_volume") > UNIT)
    ends = edges.join(node.select(F.col("address").alias("from_address"), F.col("risk").alias("a")), "from_address", "left").join(node.select(F.col("address").alias("to_address"), F.col("risk").alias("b")), "to_address", "left")
    e = ends.select("from_address", "to_address", F.least(F.lit(100.0), (F.coalesce("a", F.lit(0.0)) + F.coalesce("b", F.lit(0.0))) / 2 + F.when(single, 30).otherwise(0)).alias("edge_risk"), single.cast("int").alias("single"))
    steps = p.select("path", F.explode(F.expr("transform(sequence(1, size(path) - 1), k -> struct(element_at(path, k) as from_address, element_at(path, k + 1) as to_address))")).alias("x")).select("path", "x.*")
    s = steps.join(e, ["from_address", "to_address"]).groupBy("path").agg(F.avg("edge_risk").alias("edge_risk"), F.sum("single").alias("edge_flags"))
    out = p.drop("_id").join(n, "path").join(s, "path", "left").withColumn("flags", F.col("node_flags") + F.coalesce("edge_flags", F.lit(0))).withColumn("edge_risk", F.coalesce("edge_risk", F.lit(0.0)))
    total = F.least(F.lit(100.0), 0.4 * F.col("node_risk") + 0.3 * F.col("edge_risk") + 0.3 * 20 * F.col("flags"))
    return out.withColumn("total_risk", total).withColumn("level", ladder(F.col("total_risk"), [(80, "critical"), (50, "high"), (20, "medium")], "low")).drop("node_flags", "edge_flags")


def critical_nodes(paths: DataFrame, metrics: DataFrame, short: int = 3) -> DataFrame:
    """Interior vertices of the paths of each pair: frequency, share of paths, whether every path of at most `short` edges holds it, and a score."""
    total = paths.groupBy("seed", "end").agg(F.count("*").alias("_all"), F.count(F.when(F.col("hops") <= short, 1)).alias("_short"))
    inner = paths.where("hops > 1").select("seed", "end", "hops", F.explode(F.slice("path", F.lit(2), F.size("path") - 2)).alias("address"))
    f = inner.groupBy("seed", "end", "address").agg(F.count("*").alias("frequency"), F.count(F.when(F.col("hops") <= short, 1)).alias("_in_short")).join(total, ["seed", "end"])
    f = f.withColumn("participation", F.col("frequency") / F.col("_all")).withColumn("critical", F.col("_in_short") == F.col("_short")).join(metrics.select("address", "degree"), "address", "left")
    score = 40 * F.col("participation") + F.when(F.col("critical"), 30).otherwise(0) + F.least(F.lit(15.0), F.coalesce("degree", F.lit(0)) / 10)
    return f.withColumn("score", score).drop("_all", "_short", "_in_short")


def circular_flows(edges: DataFrame, seeds: DataFrame | None = None, max_depth: int = 5, min_volume: int = 0, min_length: int = 2, least_origin: bool = False) -> DataFrame:
    """(seed, length, path, bottleneck, total): simple cycles through each seed; min_volume binds the first edge only.

    With least_origin a cycle is found once, from its smallest vertex. A cycle is two simple paths that meet: one that leaves the seed, of half
    its edges (rounded up), and one that comes back to it, of the rest; so paths grow with the degree to the power of half the length. Paths of each
    number of edges are written once, as longer ones and several lengths read them.
    """
    e = materialise(edges.where("from_address <> to_address").select("from_address", "to_address", "total_volume"))
    columns = ["seed", "end", "path", "bottleneck", "total"]

    def grown(near: str, far: str, first: DataFrame, depth: int, longer: Callable[[Column, Column], Column]) -> list[DataFrame]:
        """Simple paths from the seeds of 1 to depth edges, which are walked from `near` to `far`; the path does not hold the seed."""
        first = first if seeds is None else first.join(seeds.select(F.col("address").alias(near)).distinct(), near)
        first = first.where(F.col(near) < F.col(far)) if least_origin else first
        step = e.select(F.col(near).alias("end"), F.col(far).alias("_to"), F.col("total_volume").alias("_volume"))
        out = [materialise(first.select(F.col(near).alias("seed"), F.col(far).alias("end"), F.array(far).alias("path"), F.col("total_volume").alias("bottleneck"), F.col("total_volume").alias("total")))]
        for _ in range(depth - 1):
            new = out[-1].join(step, "end").where((F.col("_to") > F.col("seed")) if least_origin else (F.col("_to") != F.col("seed"))).where(~F.array_contains("path", F.col("_to")))
            new = new.select("seed", F.col("_to").alias("end"), longer(F.col("path"), F.col("_to")).alias("path"), F.least("bottleneck", "_volume").alias("bottleneck"), (F.col("total") + F.col("_volume")).cast("decimal(38,0)").alias("total"))
            out.append(materialise(new))
        return out

    out_of = grown("from_address", "to_address", e.where(F.col("total_volume") >= min_volume), (max_depth + 1) // 2, F.array_append)
    back_to = grown("to_address", "from_address", e, max_depth // 2, F.array_prepend)
    found = []
    for k in range(max(2, min_length), max_depth + 1):
        back = back_to[k // 2 - 1].select(*(F.col(c).alias(c if c in ("seed", "end") else f"_{c}") for c in columns))
        # both halves hold the vertex where they meet, and must not share another
        met = out_of[(k + 1) // 2 - 1].join(back, ["seed", "end"]).where(F.size(F.array_intersect("path", "_path")) == 1)
        path = F.concat(F.array("seed"), "path", F.slice("_path", 2, k), F.array("seed"))
        found.append(met.select("seed", F.lit(k).alias("length"), path.alias("path"), F.least("bottleneck", "_bottleneck").alias("bottleneck"), (F.col("total") + F.col("_total")).cast("decimal(38,0)").alias("total")))
    result = materialise(_union(found))
    for t in (e, *out_of, *back_to):
        drop(t)
    return result


def temporal_circular_flow(transfers: DataFrame, seeds: DataFrame, max_hops: int = 3) -> DataFrame:
    """Cycles over transfers with strictly increasing block numbers: (seed, hops, path, first_block, last_block)."""
    t = transfers.where("from_address <> to_address").select(F.col("from_address").alias("end"), F.col("to_address").alias("_to"), F.col("block_number").alias("_block"))
    now = t.join(seeds.select(F.col("address").alias("end")).distinct(), "end").select(F.col("end").alias("seed"), F.col("_to").alias("end"), F.array("end", "_to").alias("path"), F.col("_block").alias("first_block"), F.col("_block").alias("last_block"))
    out = []
    for k in range(2, max_hops + 1):
        grown = now.join(t, "end").where("_block > last_block").select("seed", F.col("_to").alias("end"), "path", "first_block", F.col("_block").alias("last_block"))
        out.append(grown.where("end = seed").select("seed", F.lit(k).alias("hops"), F.array_append("path", F.col("end")).alias("path"), "first_block", "last_block"))
        now = grown.where(~F.array_contains("path", F.col("end"))).withColumn("path", F.array_append("path", F.col("end")))
    return _union(out)


def layering_chains(edges: DataFrame, seeds: DataFrame | None = None, min_volume: int = UNIT, tolerance: float = 0.2, max_hops: int = 4, min_hops: int = 3) -> DataFrame:
    """(seed, end, hops, path, first_volume, last_volume): chains in which each amount is within the tolerance of the one before; the amount prunes each round."""
    e = edges.where((F.col("from_address") != F.col("to_address")) & (F.col("total_volume") >= min_volume))
    first = e if seeds is None else e.join(seeds.select(F.col("address").alias("from_address")).distinct(), "from_address")
    now = first.select(F.col("from_address").alias("seed"), F.col("to_address").alias("end"), F.array("from_address", "to_address").alias("path"), F.col("total_volume").alias("first_volume"), F.col("total_volume").alias("last_volume"))
    out, step = [], _step(e)
    for k in range(2, max_hops + 1):
        near = F.abs(F.col("_volume").cast("double") - F.col("last_volume").cast("double")) <= tolerance * F.col("last_volume").cast("double")
        now = now.join(step, "end").where(near & ~F.array_contains("path", F.col("_to"))).select("seed", F.col("_to").alias("end"), F.array_append("path", F.col("_to")).alias("path"), "first_volume", F.col("_volume").alias("last_volume"))
        if k >= min_hops:
            out.append(now.withColumn("hops", F.lit(k)))
    return _union(out)


def bfs_build_graph(edges: DataFrame, seeds: DataFrame, depth: int = 2, per_node: int = 10, min_volume: int = 0) -> DataFrame:
    """(seed, address, other, depth, volume): a bounded view for display: each round follows the per_node strongest edges of each new account."""
    v = undirected_view(edges.where(F.col("total_volume") >= min_volume)).groupBy("address", "other").agg(F.sum("total_volume").cast("decimal(38,0)").alias("volume")).where("address <> other")
    strong = materialise(topk(v, ["address"], [F.col("volume").desc(), F.col("other")], per_node))
    front = seeds.select(F.col("address").alias("seed"), "address").distinct()
    seen, out = front, []
    for k in range(1, depth + 1):
        links = materialise(front.join(strong, "address").select("seed", "address", "other", F.lit(k).alias("depth"), "volume"))
        out.append(links)
        front = links.select("seed", F.col("other").alias("address")).distinct().join(seen, ["seed", "address"], "left_anti")
        seen = seen.unionByName(front)
    return _union(out)


def safe_depth(edges: DataFrame) -> DataFrame:
    """The depth that enumeration can afford, from vertices * mean degree squared."""
    n = edges.select(F.explode(F.array("from_address", "to_address")).alias("a")).agg(F.countDistinct("a").alias("nodes"))
    x = edges.agg(F.count("*").alias("edges")).crossJoin(n).withColumn("average_degree", F.col("edges") / F.col("nodes"))
    x = x.withColumn("estimate", F.col("nodes") * F.col("average_degree") * F.col("average_degree"))
    return x.withColumn("depth", F.when(F.col("estimate") < 1e4, 4).when(F.col("estimate") < 1e5, 3).when(F.col("estimate") < 1e6, 2).otherwise(1))


def path_score(paths: DataFrame) -> DataFrame:
    """100 - 10 per hop + min(50, 10 log10(total / 1e10)), not below 0."""
    gain = F.when(F.col("total") > 0, F.least(F.lit(50.0), F.log10(F.col("total").cast("double") / 1e10) * 10)).otherwise(F.lit(-100.0))
    return paths.withColumn("score", F.greatest(F.lit(0.0), 100 - 10 * F.col("hops") + gain))


def recent_alternatives(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """Each path with the last activity of any of its edges."""
    steps = paths.select("path", F.explode(F.expr("transform(sequence(1, size(path) - 1), k -> struct(element_at(path, k) as from_address, element_at(path, k + 1) as to_address))")).alias("x")).select("path", "x.*")
    return steps.join(edges.select("from_address", "to_address", "last_transfer_time"), ["from_address", "to_address"]).groupBy("path").agg(F.max(micros("last_transfer_time")).alias("last_activity_us"))
