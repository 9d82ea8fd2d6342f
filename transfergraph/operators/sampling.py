"""Betweenness by sampled pairs of vertices, with a bound on the error that says when to stop."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.cut import drop, materialise
from .aggregates import prefix_of_values
from .sets import vertices
from .weighted import Parts, counted


def draw_pairs(numbered: DataFrame, n: int, first: int, last: int, seed: int) -> DataFrame:
    """(pair, u, v): the draws first to last - 1 of two different vertices; each draw hangs on the seed and its number alone. numbered: (address, i), i from 0 to n - 1."""

    def number(end: int, among: int) -> Column:
        return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("pair").cast("string"), F.lit(str(end))).cast("binary")), 1, 15), 16, 10).cast("long") % among

    draws = numbered.sparkSession.range(first, last).select(F.col("id").alias("pair")).withColumn("a", number(0, n)).withColumn("b", number(1, n - 1))
    draws = draws.withColumn("b", F.col("b") + (F.col("b") >= F.col("a")).cast("long"))
    one = draws.join(numbered.select(F.col("i").alias("a"), F.col("address").alias("u")), "a")
    return one.join(numbered.select(F.col("i").alias("b"), F.col("address").alias("v")), "b").select("pair", "u", "v")


class _Side:
    """The search of one end of all pairs: (pair, address, level, sigma), level by level."""

    def __init__(self, pairs: DataFrame, end: str, links: DataFrame):
        self.links, self.depth = links, 0
        self.now, self.rows = counted(pairs.select("pair", F.col(end).alias("address"), F.lit(0).alias("level"), F.lit(1.0).alias("sigma")))
        self.all = Parts(self.now)

    def grow(self, open_pairs: DataFrame) -> None:
        self.depth += 1
        near = self.now.join(open_pairs, "pair", "left_semi").join(self.links, "address").groupBy("pair", F.col("_to").alias("address")).agg(F.sum("sigma").alias("sigma"))
        new = near.join(self.all.whole().select("pair", "address"), ["pair", "address"], "left_anti")
        self.now, self.rows = counted(new.select("pair", "address", F.lit(self.depth).alias("level"), "sigma"))
        self.all.add(self.now)

    def hand_back(self, shares: DataFrame) -> list[DataFrame]:
        """(pair, address, share) of the vertices between the end and those of `shares` (pair, address, level, share), by the numbers of paths."""
        out, seen = [], self.all.whole()
        top = shares.agg(F.max("level")).first()[0] or 0
        now = shares.where(F.col("level") == top)
        back = self.links.select(F.col("_to").alias("address"), F.col("address").alias("_from"))
        for level in range(top, 1, -1):
            at = now.join(seen.select("pair", "address", F.col("sigma").alias("_sigma")), ["pair", "address"]).join(back, "address")
            before = seen.where(F.col("level") == level - 1).select("pair", F.col("address").alias("_from"), "sigma")
            got = at.join(before, ["pair", "_from"]).groupBy("pair", F.col("_from").alias("address")).agg(F.sum(F.col("share") * F.col("sigma") / F.col("_sigma")).alias("share"))
            got = materialise(got)
            out.append(got)
            now = got.unionByName(shares.where(F.col("level") == level - 1).select("pair", "address", "share"))
        return out


def path_shares(links: DataFrame, pairs: DataFrame) -> DataFrame:
    """(pair, address, share): on what share of the shortest paths from u to v each vertex between them lies. links: (address, _to), distinct, without loops.

    Both ends of all pairs are searched towards each other, the side of fewer rows first; where they meet, all shortest paths of the
    pair pass, so the products of the numbers of paths are the shares there; the shares are then handed back towards both ends.
    """
    ahead, behind = _Side(pairs, "u", links), _Side(pairs, "v", links.select(F.col("_to").alias("address"), F.col("address").alias("_to")))
    left, met = materialise(pairs.select("pair")), []
    while True:
        side = ahead if ahead.rows <= behind.rows else behind
        side.grow(left)
        if not side.rows:
            break
        hit = ahead.now.select("pair", "address", F.col("level").alias("up"), F.col("sigma").alias("_s")).join(behind.now.select("pair", "address", F.col("level").alias("down"), "sigma"), ["pair", "address"]).join(left, "pair", "left_semi")
        met.append(materialise(hit.select("pair", "address", "up", "down", (F.col("_s") * F.col("sigma")).alias("paths"))))
        left, n = counted(left.join(met[-1].select("pair").distinct(), "pair", "left_anti"))
        if not n:
            break
    if not met:
        return pairs.select("pair", F.col("u").alias("address"), F.lit(0.0).alias("share")).where(F.lit(False))
    every = reduce(DataFrame.unionByName, met)
    total = every.groupBy("pair").agg(F.sum("paths").alias("_all"))
    shares = materialise(every.join(total, "pair").select("pair", "address", "up", "down", (F.col("paths") / F.col("_all")).alias("share")))
    out = [shares.where("up > 0 and down > 0").select("pair", "address", "share")]
    out += ahead.hand_back(shares.select("pair", "address", F.col("up").alias("level"), "share"))
    out += behind.hand_back(shares.select("pair", "address", F.col("down").alias("level"), "share"))
    result = materialise(reduce(DataFrame.unionByName, out))
    ahead.all.drop()
    behind.all.drop()
    for t in (shares, *met):
        drop(t)
    return result


def sampled_betweenness(edges: DataFrame, most: int = 100_000, seed: int = 42, epsilon: float = 0.01, confidence: float = 0.9, first: int = 256) -> DataFrame:
    """(address, betweenness, bound, pairs): the mean share of shortest paths that pass through each vertex, over drawn pairs of vertices.

    Pairs are drawn with replacement from all ordered pairs of different vertices, the same ones for the same seed; a pair without a path counts as
    0. After 256 pairs, and each time their number has doubled, the error is bounded for all vertices together (empirical Bernstein: variance seen,
    range 1, a share of 1 - confidence spent over vertices and looks); drawing stops when no vertex's bound is over epsilon, or at `most`
    pairs. With epsilon 0 all `most` pairs are drawn at one look. The exact value is the mean over all n (n - 1) pairs. Work grows with pairs times what half
    a distance reaches, not with the number of vertices squared; only sums of each vertex are kept from one look to the next.
    """
    links = materialise(edges.where("from_address <> to_address").select(F.col("from_address").alias("address"), F.col("to_address").alias("_to")).distinct())
    every = materialise(prefix_of_values(vertices(edges), "address").select(F.col("value").alias("address"), F.col("before").alias("i")))
    n = every.count()
    if n < 2:
        return every.select("address", F.lit(0.0).alias("betweenness"), F.lit(0.0).alias("bound"), F.lit(0).cast("long").alias("pairs"))
    looks = 1 if epsilon <= 0 else max(1, math.ceil(math.log2(max(most, first) / first)) + 1)
    drawn, sums = 0, None
    while True:
        upto = most if epsilon <= 0 else min(most, max(first, 2 * drawn))
        pairs = materialise(draw_pairs(every, n, drawn, upto, seed))
        shares = path_shares(links, pairs)
        got = shares.groupBy("address").agg(F.sum("share").alias("s1"), F.sum(F.col("share") * F.col("share")).alias("s2"))
        old, sums = sums, materialise(got if sums is None else got.unionByName(sums).groupBy("address").agg(F.sum("s1").alias("s1"), F.sum("s2").alias("s2")))
        for t in (pairs, shares, *([old] if old is not None else [])):
            drop(t)
        drawn = upto
        log = math.log(3 * n * looks / (1 - confidence))
        mean = F.coalesce("s1", F.lit(0.0)) / drawn
        spread = F.greatest(F.lit(0.0), F.coalesce("s2", F.lit(0.0)) / drawn - mean * mean)
        out = every.join(sums, "address", "left").select("address", mean.alias("betweenness"), (F.sqrt(2 * spread * log / drawn) + 3 * log / drawn).alias("bound"), F.lit(drawn).cast("long").alias("pairs"))
        if drawn >= most or out.agg(F.max("bound")).first()[0] <= epsilon:
            return out
