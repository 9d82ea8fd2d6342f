"""Projections and predicates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sets import undirected_view
from .topk import topk


def lookup_accounts(accounts: DataFrame, seeds: DataFrame) -> DataFrame:
    return accounts.join(seeds.select("address").distinct(), "address")


def transfers_for(transfers: DataFrame, seeds: DataFrame, start: Column | None = None, end: Column | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """The limit newest transfers after offset of each seed, from either end."""
    t = transfers if start is None else transfers.where(F.col("timestamp") >= start)
    t = t if end is None else t.where(F.col("timestamp") <= end)
    v = undirected_view(t).join(seeds.select("address").distinct(), "address")
    return topk(v, ["address"], [F.col("timestamp").desc(), F.col("hash"), F.col("direction")], limit, offset)


def with_direction(transfers: DataFrame, seeds: DataFrame) -> DataFrame:
    v = undirected_view(transfers).withColumnRenamed("other", "counterparty")
    return v.join(seeds.select("address").distinct(), "address")


def filter_edges_min_volume(edges: DataFrame, volume: int) -> DataFrame:
    """Edges of at least `volume`; null and 0 are dropped."""
    v = F.floor("total_volume")
    return edges.where((v > 0) & (v >= F.lit(volume)))


def filter_edges_direction(edges: DataFrame, seeds: DataFrame, direction: str = "bidirectional") -> DataFrame:
    """Edges at a seed: incoming, outgoing or both."""
    s = seeds.select("address").distinct()
    into = edges.join(s, edges.to_address == s.address, "left_semi")
    out = edges.join(s, edges.from_address == s.address, "left_semi")
    return {"incoming": into, "outgoing": out}.get(direction) if direction != "bidirectional" else into.unionByName(out).distinct()


def balance_units(balance: Column, unit: int = 10**10) -> Column:
    """A balance that may be text: with a point it counts whole units, otherwise the smallest."""
    return F.when(balance.contains("."), F.floor(balance.cast("double") * unit).cast("decimal(38,0)")).otherwise(balance.cast("decimal(38,0)"))


def filter_nodes_min_balance(nodes: DataFrame, at_least: int, column: str = "balance") -> DataFrame:
    return nodes.where(balance_units(F.col(column).cast("string")) >= F.lit(at_least))


def filter_edges_time(edges: DataFrame, start: Column, end: Column) -> DataFrame:
    return edges.where(F.coalesce("last_transfer_time", "first_transfer_time").between(start, end))


def filter_nodes_type(nodes: DataFrame, types: list[str]) -> DataFrame:
    return nodes.where(F.coalesce("node_type", F.lit("regular")).isin(types))


def filter_nodes_risk(nodes: DataFrame, low: float, high: float) -> DataFrame:
    return nodes.where(F.coalesce("risk_score", F.lit(0.0)).between(low, high))


def flag_volume_threshold(edges: DataFrame, threshold: int) -> DataFrame:
    return edges.withColumn("above_threshold", F.coalesce(F.col("total_volume") >= F.lit(threshold), F.lit(False)))


#: Days that the names of ranges reach back.
RANGES = {"day": 1, "week": 7, "month": 30, "year": 365}


def relative_time_filter(df: DataFrame, name: str, as_of: DataFrame, column: str = "timestamp") -> DataFrame:
    """Rows of the last day, week, month or year before as_of (one row, one column)."""
    at = as_of.select(F.col(as_of.columns[0]).alias("_as_of"))
    return df.crossJoin(F.broadcast(at)).where(F.col(column) >= F.col("_as_of") - F.make_dt_interval(F.lit(RANGES[name]))).drop("_as_of")


def transfers_where(transfers: DataFrame, from_address: str | None = None, to_address: str | None = None, min_amount: int | None = None) -> DataFrame:
    conditions = [c for c in (
        F.col("from_address") == from_address if from_address else None, F.col("to_address") == to_address if to_address else None, F.col("value") >= F.lit(min_amount) if min_amount is not None else None,
    ) if c is not None]
    return transfers.where(reduce(lambda a, b: a & b, conditions)) if conditions else transfers


def account_type(accounts: DataFrame) -> DataFrame:
    """verified, high-activity (over 1000 transfers or a balance over 1e6), active (over 100 transfers) or normal."""
    kind = F.when(F.col("verified"), "verified").when((F.col("total_transfers") > 1000) | (F.col("balance") > 10**6), "high-activity").when(F.col("total_transfers") > 100, "active").otherwise("normal")
    return accounts.withColumn("account_type", kind)


def ladder(column: Column, steps: list[tuple[float, str]], otherwise: str, strict: bool = False) -> Column:
    """The name of the first step that the column reaches (exceeds, if strict)."""
    out = None
    for at, name in steps:
        c = column > at if strict else column >= at
        out = F.when(c, name) if out is None else out.when(c, name)
    return out.otherwise(otherwise)


#: Three scales in use: fractions, and two on 0 to 100.
RISK_STEPS = {"fraction": [(0.8, "high"), (0.5, "medium"), (0.2, "low")], "quarters": [(75, "critical"), (50, "high"), (25, "medium")], "percent": [(80, "high"), (50, "medium"), (20, "low")]}


def risk_level(df: DataFrame, scale: str = "fraction", column: str = "risk_score") -> DataFrame:
    return df.withColumn("risk_level", ladder(F.coalesce(column, F.lit(0.0)), RISK_STEPS[scale], "low" if scale == "quarters" else "minimal"))


def regex_filter(df: DataFrame, column: str, pattern: str) -> DataFrame:
    return df.where(F.coalesce(F.col(column).rlike(pattern), F.lit(False)))


def regex_classify(df: DataFrame, column: str, patterns: list[tuple[str, str]], otherwise: str = "other") -> DataFrame:
    out = None
    for name, p in patterns:
        out = F.when(F.col(column).rlike(p), name) if out is None else out.when(F.col(column).rlike(p), name)
    return df.withColumn("class", out.otherwise(otherwise))


def unreviewed_patterns(patterns: DataFrame) -> DataFrame:
    return patterns.where(~F.coalesce("reviewed", F.lit(False)) & ~F.coalesce("false_positive", F.lit(False))).orderBy(F.col("confidence").desc(), "address", "pattern_type")


def stale_accounts(accounts: DataFrame, as_of: DataFrame, hours: int = 24, column: str = "updated_at") -> DataFrame:
    at = as_of.select(F.col(as_of.columns[0]).alias("_as_of"))
    return accounts.crossJoin(F.broadcast(at)).where(F.col(column).isNull() | (F.col(column) < F.col("_as_of") - F.make_dt_interval(hours=F.lit(hours)))).drop("_as_of")


def resolve_identities(raw: DataFrame, subs: DataFrame) -> DataFrame:
    """address, display, legal, verified, invalid, parent: identities flattened; a sub-identity without one of its own takes its parent's.

    raw: address, info struct, judgements array<struct<registrar,judgement>>. subs: address, parent, sub_name. Verified if any judgement
    is Reasonable or KnownGood, invalid if any is Erroneous or LowQuality-like Bad.
    """
    own = raw.select(
        "address", F.col("info.display").alias("display"), F.col("info.legal").alias("legal"), F.coalesce(F.exists("judgements", lambda j: j["judgement"].isin("Reasonable", "KnownGood")), F.lit(False)).alias("verified"),
        F.coalesce(F.exists("judgements", lambda j: j["judgement"].isin("Erroneous", "Bad")), F.lit(False)).alias("invalid"),
    )
    parent = own.select(F.col("address").alias("parent"), F.col("display").alias("_parent"), F.col("verified").alias("_verified"))
    named = subs.join(parent, "parent", "left").select("address", "parent", F.concat_ws("/", "_parent", "sub_name").alias("_display"), "_verified")
    return own.join(named, "address", "full").select("address", F.coalesce("display", "_display").alias("display"), "legal", F.coalesce("verified", "_verified", F.lit(False)).alias("verified"), F.coalesce("invalid", F.lit(False)).alias("invalid"), "parent")


def empty_accounts(accounts: DataFrame, known: DataFrame) -> DataFrame:
    """Accounts with no balance, no transfers and no identity that are not known already."""
    return accounts.where((F.coalesce("balance", F.lit(0)) == 0) & F.col("display").isNull()).join(known.select("address"), "address", "left_anti")
