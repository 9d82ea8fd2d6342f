"""Set operators on edges and graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import ieee_ratio


def undirected_view(df: DataFrame, src: str = "from_address", dst: str = "to_address") -> DataFrame:
    """Each row twice, once from either end: address, other, direction and the other columns. One scan."""
    ends = F.array(
        F.struct(F.col(src).alias("address"), F.col(dst).alias("other"), F.lit("out").alias("direction")),
        F.struct(F.col(dst).alias("address"), F.col(src).alias("other"), F.lit("in").alias("direction")),
    )
    rest = [c for c in df.columns if c not in (src, dst)]
    return df.select(F.explode(ends).alias("_end"), *rest).select("_end.*", *rest)


def vertices(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("from_address", "to_address")).alias("address")).distinct()


def merge_graphs(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of first, and those of second whose keys first does not have (one row per key)."""
    return first.unionByName(second.dropDuplicates(keys).join(first.select(*keys), keys, "left_anti"))


def graph_delta(before: DataFrame, after: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """keys and change (added, removed, updated) of the rows that differ."""
    old = before.select(*keys, F.struct(*values).alias("_old"), F.lit(True).alias("_was"))
    new = after.select(*keys, F.struct(*values).alias("_new"), F.lit(True).alias("_is"))
    change = F.when(F.col("_was").isNull(), "added").when(F.col("_is").isNull(), "removed").when(~F.col("_old").eqNullSafe(F.col("_new")), "updated")
    return old.join(new, keys, "full").withColumn("change", change).where("change is not null").select(*keys, "change")


def nodes_edges_tagged(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One document stream: (kind, json) of nodes and edges."""
    as_json = lambda df, kind: df.select(F.lit(kind).alias("kind"), F.to_json(F.struct(*df.columns)).alias("json"))
    return as_json(nodes, "nodes").unionByName(as_json(edges, "edges"))


def dominant_direction(sent: Column, total: Column) -> Column:
    """By the share sent; an edge of volume 0 counts as outgoing."""
    share = ieee_ratio(sent, total)
    return F.when(share > 0.7, "outgoing").when(share < 0.3, "incoming").otherwise("balanced")


def dedupe_edges_undirected(edges: DataFrame) -> DataFrame:
    """a-b and b-a as one row: summed volume and count, what the lesser address sent and received, dominant direction seen from it."""
    a, b = F.least("from_address", "to_address"), F.greatest("from_address", "to_address")
    forward = F.col("from_address") == a
    amount = "decimal(38,0)"
    out = edges.groupBy(a.alias("address_a"), b.alias("address_b")).agg(
        F.sum("transfer_count").alias("transfer_count"), F.sum("total_volume").cast(amount).alias("total_volume"),
        F.coalesce(F.sum(F.when(forward, F.col("total_volume"))), F.lit(0)).cast(amount).alias("sent"), F.coalesce(F.sum(F.when(~forward, F.col("total_volume"))), F.lit(0)).cast(amount).alias("received"),
    )
    return out.withColumn("direction", dominant_direction(F.col("sent"), F.col("total_volume")))
