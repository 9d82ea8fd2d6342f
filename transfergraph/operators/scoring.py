"""Relationship scores: each component is a frame on (from_address, to_address); as_of is a frame of one row and one column."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.times import days_between, micros
from .aggregates import degrees, total
from .filters import ladder
from .joins import common_connections
from .windows import percent_rank, strict_rank_fraction

EDGE = ["from_address", "to_address"]
UNIT = 10**12


def with_as_of(df: DataFrame, as_of: DataFrame) -> DataFrame:
    return df.crossJoin(F.broadcast(as_of.select(F.col(as_of.columns[0]).alias("as_of"))))  # one row


def capped(limit: float, x: Column) -> Column:
    return F.least(F.lit(float(limit)), x)


Rank = Callable[[DataFrame, str, str], DataFrame]


def volume_score(edges: DataFrame, accounts: DataFrame, method: str | Rank = "strict") -> DataFrame:
    """40 * rank of total + 30 * rank of mean size + min(30, 100 * total / sender's balance), 15 without a balance; at most 100.

    method: strict, percent, or a function like strict_rank_fraction(df, column, name) that knows the ranks of more edges than these.
    """
    rank = method if callable(method) else strict_rank_fraction if method == "strict" else percent_rank
    e = edges.select(*EDGE, F.col("total_volume").cast("double").alias("_total"), (F.col("total_volume").cast("double") / F.col("transfer_count")).alias("_mean"))
    r = rank(rank(e, "_total", "_rt"), "_mean", "_rm").join(accounts.select(F.col("address").alias("from_address"), F.col("balance").cast("double").alias("_balance")), "from_address", "left")
    return r.select(*EDGE, _volume_points().alias("volume_score"))


def _volume_points() -> Column:
    share = F.when(F.coalesce("_balance", F.lit(0.0)) > 0, capped(30, 100 * F.col("_total") / F.col("_balance"))).otherwise(15.0)
    return capped(100, 40 * F.col("_rt") + 30 * F.col("_rm") + share)


def frequency_score(edges: DataFrame, transfers: DataFrame, rank: Rank = strict_rank_fraction) -> DataFrame:
    """40 * rank of count + 30 * min(1, transfers a day / 10) + 30 * distinct days / days active."""
    d = transfers.groupBy(*EDGE).agg(F.countDistinct(F.to_date("timestamp")).alias("_days"), F.min("timestamp").alias("_a"), F.max("timestamp").alias("_b"), F.count("*").alias("_n"))
    r = rank(edges.select(*EDGE, "transfer_count"), "transfer_count", "_rc").join(d, EDGE)
    return r.select(*EDGE, _frequency_points("_a", "_b").alias("frequency_score"))


def _frequency_points(first: str, last: str) -> Column:
    active = F.greatest(F.lit(1), F.ceil(days_between(first, last)) + 1)
    return 40 * F.col("_rc") + 30 * capped(1, F.col("_n") / active / 10) + 30 * F.col("_days") / active


#: Days since the last transfer and their points.
RECENCY = [(1, 40), (7, 35), (30, 25), (90, 15), (365, 5)]


def temporal_score(transfers: DataFrame, as_of: DataFrame) -> DataFrame:
    """Recency points + min(30, duration in days / 365 * 30) + min(30, 15 * share of last week + 15 * share of last month)."""
    t = with_as_of(transfers, as_of).withColumn("_age", days_between("timestamp", "as_of"))
    g = t.groupBy(*EDGE).agg(F.min("_age").alias("_last"), F.max("_age").alias("_first"), F.count("*").alias("_n"), F.count(F.when(F.col("_age") <= 7, 1)).alias("_w"), F.count(F.when(F.col("_age") <= 30, 1)).alias("_m"))
    return g.select(*EDGE, _temporal_points(F.col("_first"), F.col("_last")).alias("temporal_score"))


def _temporal_points(first: Column, last: Column) -> Column:
    recency = None
    for days, points in RECENCY:
        recency = F.when(last <= days, points) if recency is None else recency.when(last <= days, points)
    return recency.otherwise(0) + capped(30, (first - last) / 365 * 30) + capped(30, 15 * F.col("_w") / F.col("_n") + 15 * F.col("_m") / F.col("_n"))


def temporal_decay_score(transfers: DataFrame, as_of: DataFrame) -> DataFrame:
    """The other form: 40 e^(-days / 30) + min(30, duration / 10) + min(30, activity)."""
    t = with_as_of(transfers, as_of).withColumn("_age", days_between("timestamp", "as_of"))
    g = t.groupBy(*EDGE).agg(F.min("_age").alias("_last"), F.max("_age").alias("_first"), F.count("*").alias("_n"), F.count(F.when(F.col("_age") <= 7, 1)).alias("_w"), F.count(F.when(F.col("_age") <= 30, 1)).alias("_m"))
    return g.select(*EDGE, (40 * F.exp(-F.col("_last") / 30) + capped(30, (F.col("_first") - F.col("_last")) / 10) + capped(30, 15 * F.col("_w") / F.col("_n") + 15 * F.col("_m") / F.col("_n"))).alias("temporal_score"))


def network_score(edges: DataFrame, centrality: DataFrame, ranks: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """min(40, 5 * common) + min(30, 100 * mean degree centrality) + min(30, 1000 * mean pagerank), of each edge or of the pairs."""
    m = centrality.select("address", "centrality").join(ranks.select("address", "pagerank"), "address", "left")
    end = lambda e, s: m.select(F.col("address").alias(e), F.col("centrality").alias(f"_c{s}"), F.col("pagerank").alias(f"_p{s}"))
    j = common_connections(edges, pairs).join(end("from_address", 1), "from_address", "left").join(end("to_address", 2), "to_address", "left")
    mean = lambda x: (F.coalesce(F.col(f"{x}1"), F.lit(0.0)) + F.coalesce(F.col(f"{x}2"), F.lit(0.0))) / 2
    return j.select(*EDGE, (capped(40, 5.0 * F.col("common")) + capped(30, 100 * mean("_c")) + capped(30, 1000 * mean("_p"))).alias("network_score"))


def followed_quickly(transfers: DataFrame, seconds: int = 300) -> DataFrame:
    """The transfers with _rapid: 1 if the receiver sends on within the time, else null; the receiver's next outgoing transfer is found by a window, not a join.

    The rows stay where the window put them, by to_address, so what is then folded by edge is not shuffled again.
    """
    from pyspark.sql import Window

    us = micros("timestamp")
    row = F.struct(*transfers.columns)
    v = transfers.select(F.col("to_address").alias("_at"), us.alias("_us"), row.alias("_row"), F.lit(None).cast("long").alias("_out")).unionByName(
        transfers.select(F.col("from_address").alias("_at"), us.alias("_us"), F.lit(None).cast(transfers.select(row).schema[0].dataType).alias("_row"), us.alias("_out"))
    )
    after = Window.partitionBy("_at").orderBy("_us").rangeBetween(1, seconds * 1_000_000)
    columns = [F.col("_at").alias(c) if c == "to_address" else F.col(f"_row.{c}") for c in transfers.columns]
    return v.withColumn("_next", F.min("_out").over(after)).where("_row is not null").select(*columns, F.when(F.col("_next").isNotNull(), 1).alias("_rapid"))


def risk_score(transfers: DataFrame, accounts: DataFrame) -> DataFrame:
    """min(30, 100 * rapid share) + min(25, 50 * round share) + min(25, 50 * share at 2 to 5 o'clock) + 20 if the receiver was under 7 days old."""
    t = followed_quickly(transfers.select(*EDGE, "timestamp", "value"))
    g = t.groupBy(*EDGE).agg(F.count("*").alias("_n"), *_risk_counts(), F.min("timestamp").alias("_a")).join(accounts.select(F.col("address").alias("to_address"), "created_at"), "to_address", "left")
    return g.select(*EDGE, _risk_points("_a").alias("risk_score"))


def _risk_counts() -> list[Column]:
    return [F.count("_rapid").alias("_r"), F.count(F.when(F.col("value") % UNIT == 0, 1)).alias("_o"), F.count(F.when(F.hour("timestamp").between(2, 5), 1)).alias("_h")]


def _risk_points(first: str) -> Column:
    n = F.col("_n")
    new = F.when(days_between("created_at", first) < 7, 20).otherwise(0)
    return capped(30, 100 * F.col("_r") / n) + capped(25, 50 * F.col("_o") / n) + capped(25, 50 * F.col("_h") / n) + new


COMPONENTS = ["volume_score", "frequency_score", "temporal_score", "network_score", "risk_score"]


def strength_score(volume: DataFrame, frequency: DataFrame, temporal: DataFrame, network: DataFrame, risk: DataFrame) -> DataFrame:
    """All components of each edge and (0.25 V + 0.25 F + 0.20 T + 0.30 N)(1 - risk / 200), rounded to cents."""
    j = volume
    for other in (frequency, temporal, network, risk):
        j = j.join(other, EDGE, "left")
    return _with_strength(j)


def _with_strength(scored: DataFrame) -> DataFrame:
    names = COMPONENTS
    j = scored.fillna(0.0, names)
    base = 0.25 * F.col(names[0]) + 0.25 * F.col(names[1]) + 0.2 * F.col(names[2]) + 0.3 * F.col(names[3])
    return j.withColumn("strength", F.round(base * (1 - F.col("risk_score") / 200), 2)).withColumn("adjusted", F.greatest(F.lit(0.0), base - 0.5 * F.col("risk_score")))


def edge_facts(transfers: DataFrame, accounts: DataFrame, as_of: DataFrame) -> DataFrame:
    """What the scores take from the transfers and the receiver of each edge, in one fold: the rows are shuffled once, by receiver, for what it sends on.

    Days are counted by a fold by day first, where the rows are, as a distinct count beside other sums would shuffle them twice more.
    """
    t = with_as_of(followed_quickly(transfers.select(*EDGE, "timestamp", "value")), as_of).withColumn("_age", days_between("timestamp", "as_of"))
    aged = [F.count(F.when(F.col("_age") <= days, 1)).alias(name) for days, name in ((7, "_w"), (30, "_m"))]
    sums = ["_n", "_r", "_o", "_h", "_w", "_m"]
    daily = t.groupBy(*EDGE, "as_of", F.to_date("timestamp").alias("_day")).agg(F.count("*").alias("_n"), total("value").alias("_sum"), *_risk_counts(), *aged, F.min("timestamp").alias("_a"), F.max("timestamp").alias("_b"))
    g = daily.groupBy(*EDGE, "as_of").agg(*(F.sum(c).alias(c) for c in sums), total("_sum").alias("total_volume"), F.count("_day").alias("_days"), F.min("_a").alias("_a"), F.max("_b").alias("_b"))
    return g.join(accounts.select(F.col("address").alias("to_address"), "created_at"), "to_address", "left").withColumn("transfer_count", F.col("_n"))


def strength_of_facts(facts: DataFrame, accounts: DataFrame, network: DataFrame) -> DataFrame:
    """strength_score with transfer_count and total_volume from edge_facts, which should be a written table; its edges meet the network score and no other table of edges."""
    e = facts.withColumn("_total", F.col("total_volume").cast("double")).withColumn("_mean", F.col("_total") / F.col("transfer_count"))
    for column, name in (("_total", "_rt"), ("_mean", "_rm"), ("transfer_count", "_rc")):
        e = strict_rank_fraction(e, column, name)
    e = e.join(accounts.select(F.col("address").alias("from_address"), F.col("balance").cast("double").alias("_balance")), "from_address", "left")
    temporal = _temporal_points(days_between("_a", "as_of"), days_between("_b", "as_of"))
    points = [_volume_points(), _frequency_points("_a", "_b"), temporal, _risk_points("_a")]
    own = e.select(*EDGE, "transfer_count", "total_volume", *(x.alias(c) for x, c in zip(points, [c for c in COMPONENTS if c != "network_score"])))
    return _with_strength(own.join(network, EDGE).select(*EDGE, *COMPONENTS, "transfer_count", "total_volume"))


def interpret_score(scored: DataFrame) -> DataFrame:
    return scored.withColumn("interpretation", ladder(F.col("strength"), [(80, "very strong"), (60, "strong"), (40, "moderate"), (20, "weak")], "very weak"))


def primary_factors(scored: DataFrame, n: int = 2) -> DataFrame:
    """The n highest components by name, highest first, equal ones by name."""
    parts = F.array(*(F.struct((-F.col(f"{k}_score")).alias("s"), F.lit(k).alias("k")) for k in ("frequency", "network", "temporal", "volume")))
    return scored.withColumn("factors", F.array_join(F.transform(F.slice(F.array_sort(parts), 1, n), lambda x: x["k"]), ","))


def bulk_scores(scored: DataFrame, pairs: DataFrame) -> DataFrame:
    return scored.join(pairs.select(*EDGE).distinct(), EDGE, "left_semi")


def score_distribution(scored: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """Bands of strength with means; edges may be left out if the scores have their transfer_count and total_volume."""
    j = scored if edges is None else scored.join(edges.select(*EDGE, "transfer_count", "total_volume"), EDGE)
    return interpret_score(j).groupBy("interpretation").agg(
        F.count("*").alias("n"), F.avg("strength").alias("mean_score"), F.avg("transfer_count").alias("mean_transfers"), F.avg(F.col("total_volume").cast("double")).alias("mean_volume")
    )


def step_percentile_score(edges: DataFrame, quantiles: DataFrame, column: str = "total_volume") -> DataFrame:
    """10, 30, 50, 70, 85, 95 or 100 points by the quantile band of a column, with the band's name. quantiles: one row, p25 to p99."""
    x = F.col(column).cast("double")
    steps = [("p99", 100, "top 1%"), ("p95", 95, "top 5%"), ("p90", 85, "top 10%"), ("p75", 70, "top 25%"), ("p50", 50, "top 50%"), ("p25", 30, "top 75%")]
    score = label = None
    for q, points, name in steps:
        c = x >= F.col(q)
        score, label = (F.when(c, points), F.when(c, name)) if score is None else (score.when(c, points), label.when(c, name))
    return edges.crossJoin(F.broadcast(quantiles)).select(*EDGE, score.otherwise(10).alias("score"), label.otherwise("bottom 25%").alias("percentile"))  # one row


def quick_relationship_score(edges: DataFrame, as_of: DataFrame) -> DataFrame:
    """min(50, 10 log10 of volume in units) + min(30, 2 per transfer) + max(0, 20 - days since the last), at least 1."""
    units = F.col("total_volume").cast("double") / UNIT
    v = F.when(units > 0, capped(50, F.log10(units) * 10)).otherwise(0.0)
    days = F.floor(days_between("last_transfer_time", "as_of"))
    return with_as_of(edges, as_of).select(*EDGE, F.greatest(F.lit(1.0), v + capped(30, 2.0 * F.col("transfer_count")) + F.greatest(F.lit(0), 20 - days)).alias("score"))


def relative_score(edges: DataFrame, as_of: DataFrame) -> DataFrame:
    """Volume and count over their maxima, 100 / 70 / 40 / 20 points by 7 / 30 / 90 days, 50 for the network; weighted 0.3, 0.3, 0.2, 0.2."""
    top = edges.agg(F.max(F.col("total_volume").cast("double")).alias("_v"), F.max("transfer_count").alias("_c"))
    e = with_as_of(edges, as_of).crossJoin(F.broadcast(top))  # one row
    age = days_between("last_transfer_time", "as_of")
    temporal = F.when(age <= 7, 100).when(age <= 30, 70).when(age <= 90, 40).otherwise(20)
    e = e.select(*EDGE, (100 * F.col("total_volume").cast("double") / F.col("_v")).alias("volume"), (100 * F.col("transfer_count") / F.col("_c")).alias("frequency"), temporal.alias("temporal"))
    return e.withColumn("score", 0.3 * F.col("volume") + 0.3 * F.col("frequency") + 0.2 * F.col("temporal") + 0.2 * 50)


def address_risk(edges: DataFrame, transfers: DataFrame, metrics: DataFrame, detections: DataFrame, centrality: DataFrame) -> DataFrame:
    """0.4 * risky links / 10 + 0.3 * open detections / 10 + 0.2 * transfers per active day / 10 + 0.1 * degree centrality, each at most 1; over 0.7 high, over 0.4 medium."""
    from .joins import risky_neighbours
    from .sets import undirected_view

    links = risky_neighbours(edges, metrics).groupBy("address").agg(F.countDistinct("other").alias("_links"))
    open_ = detections.where(~F.coalesce("reviewed", F.lit(False)) & ~F.coalesce("false_positive", F.lit(False))).groupBy("address").agg(F.count("*").alias("_open"))
    speed = undirected_view(transfers).groupBy("address").agg((F.count("*") / F.countDistinct(F.to_date("timestamp"))).alias("_speed"))
    j = degrees(edges).select("address").join(links, "address", "left").join(open_, "address", "left").join(speed, "address", "left").join(centrality.select("address", "centrality"), "address", "left").fillna(0, ["_links", "_open", "_speed", "centrality"])
    one = lambda x: capped(1, x)
    risk = 0.4 * one(F.col("_links") / 10) + 0.3 * one(F.col("_open") / 10) + 0.2 * one(F.col("_speed") / 10) + 0.1 * one(F.col("centrality"))
    return j.select("address", risk.alias("risk")).withColumn("level", ladder(F.col("risk"), [(0.7, "high"), (0.4, "medium")], "low", strict=True))
