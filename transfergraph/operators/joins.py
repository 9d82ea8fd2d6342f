"""Joins. OR-joins are rewritten as an equi-join of the undirected view, range joins as bucketed equi-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.times import micros
from ..plans.cut import materialise
from ..plans.ranges import CELL_ROWS, join_cells, within_after
from .aggregates import AMOUNT
from .sets import undirected_view
from .topk import topk

US = 1_000_000


def direct_connections(edges: DataFrame, accounts: DataFrame, metrics: DataFrame, seeds: DataFrame | None = None, min_volume: int = 0, limit: int = 50) -> DataFrame:
    """The strongest neighbours both ways of each seed (every account without seeds), with the neighbour's identity, balance, risk and kind."""
    v = undirected_view(edges.where(F.col("total_volume") >= min_volume))
    v = v if seeds is None else v.join(seeds.select("address").distinct(), "address")
    best = topk(v, ["address"], [F.col("total_volume").desc(), F.col("other"), F.col("direction")], limit)
    who = accounts.select(F.col("address").alias("other"), F.col("display").alias("other_display"), F.col("balance").alias("other_balance"))
    what = metrics.select(F.col("address").alias("other"), F.col("degree").alias("other_degree"), F.col("risk_score").alias("other_risk"), F.col("node_type").alias("other_type"))
    return best.join(who, "other", "left").join(what, "other", "left")


def two_hop_pairs(edges: DataFrame) -> DataFrame:
    """(origin, via, destination, bottleneck) of distinct two-edge walks between different ends."""
    a = edges.select(F.col("from_address").alias("origin"), F.col("to_address").alias("via"), F.col("total_volume").alias("_a"))
    b = edges.select(F.col("from_address").alias("via"), F.col("to_address").alias("destination"), F.col("total_volume").alias("_b"))
    return a.join(b, "via").where("origin <> destination").select("origin", "via", "destination", F.least("_a", "_b").alias("bottleneck"))


def bidirectional_edges(edges: DataFrame) -> DataFrame:
    back = edges.select(F.col("to_address").alias("from_address"), F.col("from_address").alias("to_address"), F.col("total_volume").alias("_v"), F.col("transfer_count").alias("_n"))
    j = edges.join(back, ["from_address", "to_address"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return j.select(
        "from_address", "to_address", F.col("total_volume").alias("forward_volume"), zero("_v").cast(AMOUNT).alias("reverse_volume"), F.col("transfer_count").alias("forward_count"), zero("_n").alias("reverse_count"),
        (F.col("total_volume") + zero("_v")).cast(AMOUNT).alias("both_volume"),
    )


def two_hop_neighbourhood(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(seed, other, distance, paths, max_volume): accounts one or two undirected steps from each seed."""
    v = undirected_view(edges).groupBy("address", "other").agg(F.max("total_volume").alias("volume")).where("address <> other")
    one = seeds.select(F.col("address").alias("seed")).distinct().join(v.withColumnRenamed("address", "seed"), "seed")
    two = one.select("seed", F.col("other").alias("address"), F.col("volume").alias("_first")).join(v, "address").where("other <> seed")
    every = one.select("seed", "other", F.lit(1).alias("distance"), "volume").unionByName(two.select("seed", "other", F.lit(2).alias("distance"), F.least("_first", "volume").alias("volume")))
    return every.groupBy("seed", "other").agg(F.min("distance").alias("distance"), F.count("*").alias("paths"), F.max("volume").alias("max_volume"))


#: Lists of up to so many links are compared whole; a pair with a longer one is looked up link by link.
LINKS = 500


def _first_links(simple: DataFrame, end: str, other: str, n: int) -> DataFrame:
    """(end, _links): the first n links of each account, so that a hub's list is no longer than that."""
    at = Window.partitionBy(end).orderBy(other)
    return simple.withColumn("_k", F.row_number().over(at)).where(F.col("_k") <= n).groupBy(end).agg(F.collect_list(other).alias("_links"))


def _looked_up(simple: DataFrame, wanted: DataFrame) -> DataFrame:
    """(from_address, to_address, common) of pairs of different ends: each is opened on the side of fewer links, a row for each, and the far link is looked up."""
    given = simple.groupBy("from_address").agg(F.count("*").alias("_out"))
    got = simple.groupBy("to_address").agg(F.count("*").alias("_in"))
    ends = wanted.join(given, "from_address").join(got, "to_address").select(F.col("from_address").alias("u"), F.col("to_address").alias("w"), (F.col("_out") <= F.col("_in")).alias("_ahead"))
    ahead = ends.where("_ahead").join(simple, F.col("u") == F.col("from_address")).where("to_address <> w").select("u", "w", F.col("to_address").alias("from_address"), F.col("w").alias("to_address"))
    back = ends.where("not _ahead").join(simple, F.col("w") == F.col("to_address")).where("from_address <> u").select("u", "w", F.col("u").alias("from_address"), F.col("from_address").alias("to_address"))
    found = ahead.unionByName(back).join(simple, ["from_address", "to_address"]).groupBy(F.col("u").alias("from_address"), F.col("w").alias("to_address")).agg(F.count("*").alias("common"))
    return wanted.join(found, ["from_address", "to_address"], "left").fillna(0, ["common"])


def common_connections(edges: DataFrame, pairs: DataFrame | None = None, longest: int = LINKS) -> DataFrame:
    """(from_address, to_address, common): for each edge (or pair) the number of other accounts x with from -> x -> to.

    The lesser list of links, the sender's receivers or the receiver's senders, is sent to the account at the other end and compared with its list
    there, so what is sent is the sum of the lesser degrees, in one row for each pair. Pairs with a list of more than `longest` are opened link by
    link on the side of fewer links, so two hubs that share a partner make no walks between all of their neighbours.
    """
    simple = materialise(edges.where("from_address <> to_address").select("from_address", "to_address").distinct())
    wanted = (edges if pairs is None else pairs).select("from_address", "to_address").distinct()
    out = materialise(_first_links(simple, "from_address", "to_address", longest + 1))
    into = materialise(_first_links(simple, "to_address", "from_address", longest + 1))
    count = lambda df, end, name: df.select(end, F.size("_links").alias(name))
    n = lambda c: F.when(F.col("from_address") != F.col("to_address"), F.coalesce(c, F.lit(0))).otherwise(0).alias(c)
    ends = wanted.join(count(into, "to_address", "_in"), "to_address", "left").join(count(out, "from_address", "_out"), "from_address", "left")
    ends = materialise(ends.select("from_address", "to_address", n("_out"), n("_in")))
    some, short = F.least("_out", "_in") > 0, F.greatest("_out", "_in") <= longest
    met = ends.where(some & short)
    both = F.size(F.array_intersect("_sent", "_links")).cast("long").alias("common")
    sent = lambda df: df.withColumnRenamed("_links", "_sent")
    ahead = met.where("_out <= _in").join(sent(out), "from_address").join(into, "to_address").select("from_address", "to_address", both)
    back = met.where("_out > _in").join(sent(into), "to_address").join(out, "from_address").select("from_address", "to_address", both)
    found = ends.where(~some).select("from_address", "to_address", F.lit(0).cast("long").alias("common")).unionByName(ahead).unionByName(back)
    rest = ends.where(some & ~short).select("from_address", "to_address")
    return found if rest.isEmpty() else found.unionByName(_looked_up(simple, rest))


def sequential_transfers(transfers: DataFrame, window_seconds: int = 300 * 60, tolerance: float | None = 0.15) -> DataFrame:
    """Pairs of successful transfers: the second leaves the first's receiver within the window, of nearly the same amount."""
    cols = lambda n: [F.col("hash").alias(f"hash{n}"), F.col("from_address").alias(f"from{n}"), F.col("to_address").alias(f"to{n}"), F.col("value").alias(f"value{n}"), micros("timestamp").alias(f"us{n}")]
    ok = transfers.where("success")
    j = within_after(ok.select(*cols(1)), ok.select(*cols(2)), [("to1", "from2")], "us1", "us2", window_seconds * US)
    near = j if tolerance is None else j.where(F.abs(F.col("value1").cast("double") - F.col("value2").cast("double")) <= tolerance * F.col("value1").cast("double"))
    return near.withColumn("seconds", (F.col("us2") - F.col("us1")) / US).drop("us1", "us2")


def time_proximity_pairs(activity: DataFrame, window_seconds: int = 60, at: str = "timestamp", limit: int = CELL_ROWS) -> DataFrame:
    """(address_a, address_b, seconds): events of two addresses, a < b, at most window_seconds apart, whichever comes first.

    activity: address, timestamp. Time buckets are the join key, so the cost follows the number of near pairs; a bucket of more than `limit` events is
    compared in blocks, so that a busy minute is many tasks' work.
    """
    a = activity.select(F.col("address").alias("address_a"), micros(at).alias("us_a"))
    b = activity.select(F.col("address").alias("address_b"), micros(at).alias("us_b"))
    w = window_seconds * US
    near = a.withColumn("_cell", F.explode(F.array(*(F.floor(F.col("us_a") / w) + d for d in (-1, 0, 1)))))
    j = join_cells(near, b.withColumn("_cell", F.floor(F.col("us_b") / w)), ["_cell"], limit).where((F.col("address_a") < F.col("address_b")) & (F.abs(F.col("us_a") - F.col("us_b")) <= w))
    return j.select("address_a", "address_b", (F.abs(F.col("us_a") - F.col("us_b")) / US).alias("seconds"))


def shared_destination_pairs(transfers: DataFrame, window_seconds: int = 3600) -> DataFrame:
    """(address_a, address_b, destination, seconds): senders whose first transfers to one receiver lie within the window."""
    first = transfers.groupBy("from_address", "to_address").agg(F.min("timestamp").alias("timestamp"))
    a = first.select(F.col("from_address").alias("a"), F.col("to_address").alias("da"), micros("timestamp").alias("ua"))
    b = first.select(F.col("from_address").alias("b"), F.col("to_address").alias("db"), micros("timestamp").alias("ub"))
    j = within_after(a, b, [("da", "db")], "ua", "ub", window_seconds * US, include_equal=True).where("a <> b and (ua < ub or a < b)")
    return j.select(F.least("a", "b").alias("address_a"), F.greatest("a", "b").alias("address_b"), F.col("da").alias("destination"), ((F.col("ub") - F.col("ua")) / US).alias("seconds"))


def high_risk_edges(edges: DataFrame, accounts: DataFrame, threshold: float = 0.5) -> DataFrame:
    r = accounts.select("address", (F.col("risk_score") / 100).alias("r"))
    j = edges.join(r.select(F.col("address").alias("from_address"), F.col("r").alias("from_risk")), "from_address").join(r.select(F.col("address").alias("to_address"), F.col("r").alias("to_risk")), "to_address")
    return j.where((F.col("from_risk") > threshold) | (F.col("to_risk") > threshold)).withColumn("average_risk", (F.col("from_risk") + F.col("to_risk")) / 2)


def enrich_edges(edges: DataFrame, accounts: DataFrame, min_volume: int = 0) -> DataFrame:
    who = lambda end: accounts.select(F.col("address").alias(f"{end}_address"), F.col("display").alias(f"{end}_display"))
    return edges.where(F.col("total_volume") >= min_volume).join(who("from"), "from_address", "left").join(who("to"), "to_address", "left")


def risky_neighbours(edges: DataFrame, metrics: DataFrame, min_degree: int = 100, min_risk: float = 70) -> DataFrame:
    risky = metrics.where((F.col("degree") > min_degree) | (F.col("risk_score") > min_risk) | F.col("node_type").isin("mixer", "exchange"))
    return undirected_view(edges).join(risky.select(F.col("address").alias("other"), F.col("degree").alias("other_degree"), "risk_score", "node_type"), "other")


def tokens(column: Column) -> Column:
    return F.filter(F.split(F.lower(column), "[^a-z0-9]+"), lambda x: x != "")


def inverted_index(accounts: DataFrame, columns: list[str]) -> DataFrame:
    """(token, address, tf)."""
    return accounts.select("address", F.explode(tokens(F.concat_ws(" ", *columns))).alias("token")).groupBy("token", "address").agg(F.count("*").alias("tf"))


def fulltext_search(accounts: DataFrame, queries: DataFrame, columns: list[str]) -> DataFrame:
    """(query, address, matched, rank): accounts that hold any term of a query; rank sums tf * ln(1 + N / df). Terms are not stemmed."""
    index = inverted_index(accounts, columns)
    df = index.groupBy("token").agg(F.count("*").alias("df"))
    n = accounts.agg(F.count("*").alias("n"))
    terms = queries.select("query", F.explode(F.array_distinct(tokens(F.col("query")))).alias("token"))
    hit = terms.join(index, "token").join(df, "token").crossJoin(F.broadcast(n))  # one row
    return hit.groupBy("query", "address").agg(F.count("*").alias("matched"), F.sum(F.col("tf") * F.log(1 + F.col("n") / F.col("df"))).alias("rank"))


def orphan_transfers(transfers: DataFrame, accounts: DataFrame) -> DataFrame:
    """(hash, missing): transfers with an unknown end, one row per unknown end."""
    known = accounts.select("address")
    ends = transfers.select("hash", F.expr("stack(2, 'from', from_address, 'to', to_address) as (missing, address)"))
    return ends.join(known, "address", "left_anti").select("hash", "missing")


def subgraph_edges(edges: DataFrame, nodes: DataFrame, both: bool = True) -> DataFrame:
    n = nodes.select("address").distinct()
    a = edges.join(n.withColumnRenamed("address", "from_address"), "from_address", "left_semi")
    if both:
        return a.join(n.withColumnRenamed("address", "to_address"), "to_address", "left_semi")
    return a.unionByName(edges.join(n.withColumnRenamed("address", "to_address"), "to_address", "left_semi")).distinct()


def node_pattern_overlap(edges: DataFrame, patterns: DataFrame, min_confidence: float = 0.5) -> DataFrame:
    """Neighbours with two or more distinct confident detections that are not false positives."""
    p = patterns.where((F.col("confidence") >= min_confidence) & ~F.coalesce("false_positive", F.lit(False))).groupBy(F.col("address").alias("other")).agg(F.collect_set("pattern_type").alias("kinds")).where(F.size("kinds") >= 2)
    return undirected_view(edges).select("address", "other").distinct().join(p, "other").select("address", "other", F.size("kinds").alias("n_kinds"), F.array_join(F.array_sort("kinds"), ",").alias("kinds"))


def sub_identity_hierarchy(subs: DataFrame, accounts: DataFrame) -> DataFrame:
    """Each parent with its sub-identities in order."""
    s = subs.groupBy(F.col("parent").alias("address")).agg(F.array_sort(F.collect_list(F.struct("sub_name", F.col("address").alias("sub_address")))).alias("subs"))
    return accounts.select("address", "display").join(s, "address")


def multi_hop_transfer_pairs_by_block(transfers: DataFrame, blocks: int = 100) -> DataFrame:
    """Distinct (a, c) with a -> b then b -> c fewer than `blocks` blocks later."""
    x = transfers.select(F.col("from_address").alias("a"), F.col("to_address").alias("b"), F.col("block_number").alias("at1"))
    y = transfers.select(F.col("from_address").alias("b2"), F.col("to_address").alias("c"), F.col("block_number").alias("at2"))
    return within_after(x, y, [("b", "b2")], "at1", "at2", blocks - 1).where("a <> c").select("a", "c").distinct()
