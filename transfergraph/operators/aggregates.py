"""Aggregations over transfers, edges and accounts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.times import micros
from ..plans.cut import materialise
from .sets import undirected_view

AMOUNT = "decimal(38,0)"


def total(column: Column | str, where: Column | None = None) -> Column:
    """An exact sum, 0 if there is nothing to add."""
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(F.sum(c if where is None else F.when(where, c)), F.lit(0)).cast(AMOUNT)


def count_if(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def build_edges(transfers: DataFrame) -> DataFrame:
    """Transfers folded into directed edges."""
    return transfers.groupBy("from_address", "to_address").agg(
        F.count("*").alias("transfer_count"), total("value").alias("total_volume"), F.min("block_number").alias("first_transfer_block"), F.max("block_number").alias("last_transfer_block"),
        F.min("timestamp").alias("first_transfer_time"), F.max("timestamp").alias("last_transfer_time"),
    )


def account_totals(transfers: DataFrame) -> DataFrame:
    v = undirected_view(transfers)
    inward = F.col("direction") == "in"
    return v.groupBy("address").agg(
        count_if(inward).alias("transfers_in"), count_if(~inward).alias("transfers_out"), total("value", inward).alias("volume_in"), total("value", ~inward).alias("volume_out"), F.max("block_number").alias("last_seen_block")
    )


def account_stats(accounts: DataFrame, transfers: DataFrame) -> DataFrame:
    """Totals both ways, distinct counterparties and block range of every account; accounts without transfers have zeros."""
    v = undirected_view(transfers)
    inward = F.col("direction") == "in"
    s = v.groupBy("address").agg(
        total("value", inward).alias("received"), total("value", ~inward).alias("sent"), count_if(inward).alias("n_received"), count_if(~inward).alias("n_sent"),
        F.countDistinct(F.when(inward, F.col("other"))).alias("unique_senders"), F.countDistinct(F.when(~inward, F.col("other"))).alias("unique_receivers"), F.min("block_number").alias("first_block"), F.max("block_number").alias("last_block"),
    )
    zeros = {k: 0 for k in ("n_received", "n_sent", "unique_senders", "unique_receivers")}
    out = accounts.select("address").join(s, "address", "left").fillna(zeros)
    return out.withColumns({k: F.coalesce(k, F.lit(0)).cast(AMOUNT) for k in ("received", "sent")})


def rapid_pairs(transfers: DataFrame, seconds: int = 3600) -> DataFrame:
    """(address, rapid_pairs): ordered pairs of an address's transfers at most `seconds` apart; a range frame counts them without a self-join."""
    v = undirected_view(transfers).withColumn("us", micros("timestamp"))
    later = Window.partitionBy("address").orderBy("us").rangeBetween(1, seconds * 1_000_000)
    return v.select("address", F.count("*").over(later).alias("n")).groupBy("address").agg(F.sum("n").alias("rapid_pairs"))


def transfer_statistics(transfers: DataFrame, rapid_seconds: int = 3600) -> DataFrame:
    v = undirected_view(transfers)
    inward = F.col("direction") == "in"
    s = v.groupBy("address").agg(
        F.countDistinct("other").alias("unique_counterparties"), total("value", inward).alias("volume_in"), total("value", ~inward).alias("volume_out"), total("value").alias("total_volume"), count_if(inward).alias("n_in"),
        count_if(~inward).alias("n_out"), F.count("*").alias("n_total"),
    )
    return s.join(rapid_pairs(transfers, rapid_seconds), "address")


def counterparty_rollup(edges: DataFrame, min_volume: int = 0) -> DataFrame:
    v = undirected_view(edges)
    out = v.groupBy("address", "other").agg(
        count_if(F.col("direction") == "in").alias("edges_in"), count_if(F.col("direction") == "out").alias("edges_out"), total("total_volume").alias("volume"), F.min("first_transfer_block").alias("first_block"),
        F.max("last_transfer_block").alias("last_block"),
    )
    return out.where(F.col("volume") >= min_volume)


def account_summary(accounts: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct in and out connections; each side is aggregated before it is joined."""
    out = edges.groupBy(F.col("from_address").alias("address")).agg(F.count("*").alias("out_connections"), F.sum("transfer_count").alias("n_out"))
    into = edges.groupBy(F.col("to_address").alias("address")).agg(F.count("*").alias("in_connections"), F.sum("transfer_count").alias("n_in"))
    j = accounts.select("address", "balance", "risk_score").join(out, "address", "left").join(into, "address", "left").fillna(0, ["out_connections", "n_out", "in_connections", "n_in"])
    return j.select("address", "balance", "risk_score", "in_connections", "out_connections", (F.col("n_in") + F.col("n_out")).alias("total_transfers"))


def counterparty_flows(transfers: DataFrame, min_amount: int = 0) -> DataFrame:
    v = undirected_view(transfers.where(F.col("value") >= min_amount))
    out = F.col("direction") == "out"
    f = v.groupBy("address", "other").agg(
        count_if(out).alias("n_sent"), count_if(~out).alias("n_received"), total("value", out).alias("sent"), total("value", ~out).alias("received"), F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen")
    )
    kind = F.when((F.col("n_sent") > 0) & (F.col("n_received") > 0), "bidirectional").when(F.col("n_sent") > 0, "outgoing").otherwise("incoming")
    return f.withColumn("total", (F.col("sent") + F.col("received")).cast(AMOUNT)).withColumn("kind", kind)


def prefix_of_values(df: DataFrame, column: str) -> DataFrame:
    """(value, n, before): a histogram of a column with the number of rows below each value.

    Values are dealt into ranges; each range is summed on its own and only one row per range meets in one task, so no window
    holds all values. The dealt histogram is written once, as a range's bounds are sampled anew by each run.
    """
    hist = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    dealt = materialise(hist.repartitionByRange("value").withColumn("bucket", F.spark_partition_id()))  # without a number, as small ranges next to each other are then read as one
    sums = dealt.groupBy("bucket").agg(F.sum("n").alias("in_bucket"))
    offsets = sums.withColumn("offset", F.coalesce(F.sum("in_bucket").over(Window.partitionBy().orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("bucket", "offset")
    within = Window.partitionBy("bucket").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    return dealt.withColumn("below", F.coalesce(F.sum("n").over(within), F.lit(0))).join(offsets, "bucket").select("value", "n", (F.col("offset") + F.col("below")).alias("before"))


def volume_statistics(edges: DataFrame, column: str = "total_volume") -> DataFrame:
    """Rows (metric, value): total, average, upper median (row n/2 from 0 in ascending order)."""
    s = edges.agg(F.sum(column).cast("double").alias("total"), F.avg(F.col(column).cast("double")).alias("average"), F.count(column).alias("n"))
    h = prefix_of_values(edges, column)
    n = s.select(F.floor(F.col("n") / 2).alias("at"))
    median = h.join(F.broadcast(n), (F.col("before") <= F.col("at")) & (F.col("at") < F.col("before") + F.col("n"))).select(F.lit("median").alias("metric"), F.col("value").cast("double").alias("value"))
    return s.select(F.expr("stack(2, 'total', total, 'average', average) as (metric, value)")).unionByName(median)


def pair_activity(transfers: DataFrame, min_count: int = 1) -> DataFrame:
    return transfers.groupBy("from_address", "to_address").agg(
        F.count("*").alias("n"), total("value").alias("volume"), F.avg(F.col("value").cast("double")).alias("mean"), F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen")
    ).where(F.col("n") > min_count)


def sender_totals(transfers: DataFrame) -> DataFrame:
    return transfers.groupBy("from_address").agg(F.count("*").alias("n"), total("value").alias("volume"))


def address_activity(transfers: DataFrame, start: Column, end: Column, more_than: int) -> DataFrame:
    v = undirected_view(transfers.where((F.col("timestamp") >= start) & (F.col("timestamp") <= end)))
    return v.groupBy("address").agg(F.count("*").alias("n"), F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen")).where(F.col("n") > more_than)


def pattern_counts(patterns: DataFrame) -> DataFrame:
    return patterns.groupBy("pattern_type").agg(F.count("*").alias("n"), F.countDistinct("address").alias("addresses"), F.max("confidence").alias("max_confidence"))


def network_overview(accounts: DataFrame, transfers: DataFrame) -> DataFrame:
    t = transfers.agg(F.count("*").alias("transfers"), total("value").alias("volume"), F.max("block_number").alias("last_block"))
    busy = undirected_view(transfers).groupBy("address").count().where("count > 10").agg(F.count("*").alias("busy_accounts"))
    a = accounts.agg(F.count("*").alias("accounts"), F.avg(F.when(F.col("balance") > 0, F.col("balance").cast("double"))).alias("mean_balance"), count_if(F.col("display").isNotNull()).alias("identified"))
    return t.crossJoin(a).crossJoin(busy)  # one row each


def graph_totals(edges: DataFrame) -> DataFrame:
    n = edges.select(F.explode(F.array("from_address", "to_address")).alias("address")).agg(F.countDistinct("address").alias("nodes"))
    return edges.agg(F.count("*").alias("edges")).crossJoin(n).withColumn("average_degree", F.when(F.col("nodes") > 0, 2 * F.col("edges") / F.col("nodes")))


def daily_metric(transfers: DataFrame) -> DataFrame:
    return transfers.groupBy(F.to_date("timestamp").alias("metric_date")).agg(F.count("*").alias("transfers"), total("value").alias("volume"), F.countDistinct("from_address").alias("senders"))


def latest_metrics(metrics: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The latest row of each key, as an upsert leaves it."""
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return metrics.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def dedup_transfers(transfers: DataFrame) -> DataFrame:
    """The first row of each hash by block, time and ends."""
    w = Window.partitionBy("hash").orderBy("block_number", "timestamp", "from_address", "to_address")
    return transfers.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def merge_accounts(existing: DataFrame, incoming: DataFrame, key: str = "address") -> DataFrame:
    """An upsert: a new value wins unless it is null."""
    rest = [c for c in existing.columns if c != key]
    o, n = existing.alias("o"), incoming.alias("n")
    return o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full").select(F.coalesce(f"n.{key}", f"o.{key}").alias(key), *(F.coalesce(f"n.{c}", f"o.{c}").alias(c) if c in incoming.columns else F.col(f"o.{c}") for c in rest))


def connection_summary(paths: DataFrame) -> DataFrame:
    return paths.groupBy("start", "end").agg(F.min("hops").alias("min_hops"), F.count("*").alias("paths"), F.max("bottleneck").alias("max_volume"))


def volume_quantiles(edges: DataFrame, column: str = "total_volume", exact: bool = True, quantiles: tuple[float, ...] = (0.25, 0.5, 0.75, 0.9, 0.95, 0.99)) -> DataFrame:
    """One column per quantile. exact interpolates; otherwise a sketch of bounded size that one task can merge at any scale."""
    q = F.array(*map(F.lit, quantiles))
    got = F.percentile(F.col(column).cast("double"), q) if exact else F.percentile_approx(F.col(column).cast("double"), q, 10000)
    return edges.agg(got.alias("q")).select(*(F.col("q")[k].alias(f"p{round(x * 100)}") for k, x in enumerate(quantiles)))


def daily_volume_baseline(transfers: DataFrame, days: int = 30) -> DataFrame:
    d = undirected_view(transfers).groupBy("address", F.to_date("timestamp").alias("day")).agg(total("value").alias("volume"))
    recent = d.withColumn("_n", F.row_number().over(Window.partitionBy("address").orderBy(F.col("day").desc()))).where(F.col("_n") <= days)
    return recent.groupBy("address").agg(F.count("*").alias("days"), F.avg(F.col("volume").cast("double")).alias("average"), F.max("volume").alias("highest"))


def amount_frequency(transfers: DataFrame) -> DataFrame:
    return undirected_view(transfers).groupBy("address", "value").agg(F.count("*").alias("n")).where("n > 1")


def degrees(edges: DataFrame) -> DataFrame:
    v = undirected_view(edges)
    inward = F.col("direction") == "in"
    return v.groupBy("address").agg(
        F.count("*").alias("degree"), count_if(inward).alias("in_degree"), count_if(~inward).alias("out_degree"), total("total_volume", inward).alias("total_volume_in"), total("total_volume", ~inward).alias("total_volume_out")
    )


def degree_distribution(edges: DataFrame) -> DataFrame:
    each = degrees(edges).select(F.expr("stack(3, 'in', in_degree, 'out', out_degree, 'total', degree) as (kind, degree)"))
    return each.groupBy("kind", "degree").agg(F.count("*").alias("nodes"))


def node_graph_metrics(edges: DataFrame) -> DataFrame:
    """Degrees and volume per node of an edge list after dropping repeated edges, with the average degree."""
    d = degrees(edges.dropDuplicates(["from_address", "to_address"]))
    average = d.agg(F.avg("degree").alias("average_degree"))
    return d.crossJoin(F.broadcast(average))  # one row
