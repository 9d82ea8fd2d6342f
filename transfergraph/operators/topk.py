"""Sorts, limits and searches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def topk(df: DataFrame, key: list[str], order: list[Column], k: int, offset: int = 0) -> DataFrame:
    """The first k rows of each key after offset. Spark keeps k + offset rows per key and task before it shuffles."""
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("_rank") <= k + offset)
    return (ranked.where(F.col("_rank") > offset) if offset else ranked).drop("_rank")


def top_relationships(scored: DataFrame, n: int = 100, min_score: float = 0.0) -> DataFrame:
    return scored.where(F.col("strength") >= min_score).orderBy(F.col("strength").desc(), "from_address", "to_address").limit(n)


def suspicious_relationships(scored: DataFrame, volume: float = 70, risk: float = 30, inclusive: bool = True) -> DataFrame:
    v, r = F.col("volume_score"), F.col("risk_score")
    return scored.where((v >= volume) & (r >= risk) if inclusive else (v > volume) & (r > risk))


def high_activity_accounts(summary: DataFrame, n: int = 100) -> DataFrame:
    return summary.where(F.col("total_transfers") > n)


def high_degree_nodes(metrics: DataFrame, accounts: DataFrame, more_than: int = 50) -> DataFrame:
    return metrics.where(F.col("degree") > more_than).join(accounts.select("address", "display", "balance"), "address")


def search_accounts(accounts: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """Accounts that hold the query in address, display or legal name: exact address first, then exact name, then the rest by activity."""
    q = query.lower()
    has = lambda c: F.coalesce(F.lower(c).contains(q), F.lit(False))
    rank = F.when(F.col("address") == query, 0).when(F.lower("display") == q, 1).otherwise(2)
    return accounts.where(has("address") | has("display") | has("legal")).withColumn("rank", rank).orderBy("rank", F.col("total_transfers").desc(), "address").limit(limit)


def search_ranked(accounts: DataFrame, patterns: DataFrame, query: str, limit: int = 50) -> DataFrame:
    """Addresses, names and detections that match, with a relevance, best first.

    Addresses: 100 exact, 50 prefix, 25 otherwise. Names: 100 exact, 70 prefix, 50 word, 30 otherwise, 10 less with a risk over 50. Both gain 20
    or 25 if verified and up to 20 for activity. Detections: 100 times their confidence.
    """
    q = query.lower()
    activity = F.least(F.lit(20.0), F.log10(1 + F.col("total_transfers").cast("double")) * 5)
    a, d = F.lower("address"), F.lower("display")
    by_address = accounts.where(a.contains(q)).select(
        F.lit("address").alias("kind"), "address", (F.when(a == q, 100).when(a.startswith(q), 50).otherwise(25) + F.when(F.col("verified"), 20).otherwise(0) + activity).alias("relevance"), "risk_score", "total_transfers"
    )
    base = F.when(d == q, 100).when(d.startswith(q), 70).when(d.contains(f" {q}"), 50).otherwise(30)
    by_name = accounts.where(d.contains(q)).select(
        F.lit("name").alias("kind"), "address", (base + F.when(F.col("verified"), 25).otherwise(0) + activity - F.when(F.col("risk_score") > 50, 10).otherwise(0)).alias("relevance"), "risk_score", "total_transfers"
    )
    found = patterns.where(F.lower("address").contains(q)).select(F.lit("pattern").alias("kind"), "address", (F.col("confidence") * 100).alias("relevance"), F.lit(None).cast("double").alias("risk_score"), F.lit(None).cast("long").alias("total_transfers"))
    return by_address.unionByName(by_name).unionByName(found).orderBy(F.col("relevance").desc(), "kind", "address").limit(limit)


def suggest(accounts: DataFrame, query: str, n: int = 5) -> DataFrame:
    """Up to n addresses that begin with the query by balance, and n names that hold it, shortest first."""
    q = query.lower()
    a = accounts.where(F.lower("address").startswith(q)).orderBy(F.col("balance").desc(), "address").limit(n).select(F.lit("address").alias("kind"), F.col("address").alias("suggestion"))
    b = accounts.where(F.lower("display").contains(q)).select("display").distinct().orderBy(F.length("display"), "display").limit(n).select(F.lit("name").alias("kind"), F.col("display").alias("suggestion"))
    return a.unionByName(b)


def expand_frontier(edges: DataFrame, frontier: DataFrame, seen: DataFrame, limit: int = 50) -> DataFrame:
    """The next ring: neighbours of frontier accounts that are not seen yet, the strongest `limit` of each by volume."""
    from .sets import undirected_view

    near = undirected_view(edges).join(frontier.select("address").distinct(), "address").join(seen.select(F.col("address").alias("other")).distinct(), "other", "left_anti")
    ring = near.groupBy("address", "other").agg(F.sum("total_volume").cast("decimal(38,0)").alias("volume"), F.sum("transfer_count").alias("transfers"))
    return topk(ring, ["address"], [F.col("volume").desc(), F.col("other")], limit)


def investigation_latest(investigations: DataFrame) -> DataFrame:
    return topk(investigations, ["session_id"], [F.col("updated_at").desc(), F.col("version").desc()], 1)
