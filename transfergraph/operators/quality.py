"""Data-quality jobs: what constraints would have refused."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import looks_like_address
from .sets import undirected_view


def unique_violations(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def foreign_key_violations(df: DataFrame, column: str, known: DataFrame, key: str = "address") -> DataFrame:
    """Values of a column that no row of known has, with their number of rows."""
    return df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).join(known.select(F.col(key).alias("value")).distinct(), "value", "left_anti")


def errors_of(checks: dict[str, Column]) -> Column:
    """An array of the names of the checks that fail; a check that is null fails."""
    return F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in checks.items())))


def format_check(transfers: DataFrame) -> DataFrame:
    """(hash, errors) of transfers with an amount that is no non-negative whole number, a hash that is not 0x and 64 hex digits, or an end that is no address."""
    checks = {
        "amount": F.col("value").cast("string").rlike("^[0-9]+$"), "hash": F.col("hash").rlike("^0x[0-9a-fA-F]{64}$"),
        "from_address": looks_like_address(F.col("from_address")), "to_address": looks_like_address(F.col("to_address")),
    }
    return transfers.select("hash", errors_of(checks).alias("errors")).where(F.size("errors") > 0)


def transfer_consistency(transfers: DataFrame, accounts: DataFrame, fee: int = 0) -> DataFrame:
    """(hash, errors): sender's balance below amount and fee, hash used before, transfer to oneself."""
    again = Window.partitionBy("hash").orderBy("block_number", "from_address", "to_address")
    t = transfers.withColumn("_k", F.row_number().over(again)).join(accounts.select(F.col("address").alias("from_address"), "balance"), "from_address", "left")
    checks = {"insufficient_balance": F.col("balance") >= F.col("value") + fee, "duplicate_hash": F.col("_k") == 1, "self_transfer": F.col("from_address") != F.col("to_address")}
    return t.select("hash", errors_of(checks).alias("errors")).where(F.size("errors") > 0)


def balance_reconciliation(accounts: DataFrame, transfers: DataFrame, tolerance: float = 0.001) -> DataFrame:
    """(address, stated, derived, ok): stated balance against what came in less what went out."""
    signed = F.when(F.col("direction") == "in", F.col("value")).otherwise(-F.col("value"))
    d = undirected_view(transfers).groupBy("address").agg(F.sum(signed).cast("decimal(38,0)").alias("derived"))
    j = accounts.select("address", F.col("balance").alias("stated")).join(d, "address", "left").withColumn("derived", F.coalesce("derived", F.lit(0)).cast("decimal(38,0)"))
    return j.withColumn("ok", F.abs((F.col("stated") - F.col("derived")).cast("double")) <= tolerance * F.abs(F.col("stated").cast("double")))


def source_reconciliation(a: DataFrame, b: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, status, fields): rows missing on one side, or with differing fields."""
    x = a.select(F.col(key), F.struct(*columns).alias("_a"), F.lit(1).alias("_x"))
    y = b.select(F.col(key), F.struct(*columns).alias("_b"), F.lit(1).alias("_y"))
    fields = F.array_compact(F.array(*(F.when(~F.col(f"_a.{c}").eqNullSafe(F.col(f"_b.{c}")), c) for c in columns)))
    j = x.join(y, key, "full").withColumn("status", F.when(F.col("_x").isNull(), "missing_in_a").when(F.col("_y").isNull(), "missing_in_b").otherwise("differs"))
    j = j.withColumn("fields", F.when(F.col("status") == "differs", F.array_join(fields, ",")).otherwise(""))
    return j.where((F.col("status") != "differs") | (F.col("fields") != "")).select(key, "status", "fields")


def block_reconciliation(blocks: DataFrame, transfers: DataFrame) -> DataFrame:
    """(number, errors) of blocks whose parent hash is not the hash before, or whose count of transfers is wrong.

    The block before is found by a join on number - 1, so no task orders the whole chain.
    """
    before = blocks.select((F.col("number") + 1).alias("number"), F.col("hash").alias("_before"))
    n = transfers.groupBy(F.col("block_number").alias("number")).agg(F.count("*").alias("_n"))
    j = blocks.join(before, "number", "left").join(n, "number", "left")
    checks = {"parent": F.col("_before").isNull() | (F.col("_before") == F.col("parent_hash")), "count": F.coalesce("_n", F.lit(0)) == F.col("transfers")}
    return j.select("number", errors_of(checks).alias("errors")).where(F.size("errors") > 0)


def graph_validity(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(issue, n): nodes without an id or with an id unlike their address, edges with a missing or unknown end, repeated ids."""
    known = nodes.select(F.col("id").alias("_id")).where("_id is not null").distinct()
    end = lambda c: edges.where(F.col(c).isNotNull()).join(known, F.col(c) == F.col("_id"), "left_anti")
    parts = [
        ("node_without_id", nodes.where("id is null")), ("id_is_not_address", nodes.where("id <> address")), ("repeated_id", nodes.groupBy("id").count().where("count > 1")),
        ("edge_without_end", edges.where("source is null or target is null")), ("unknown_source", end("source")), ("unknown_target", end("target")),
    ]
    return reduce(DataFrame.unionByName, (df.agg(F.count("*").alias("n")).select(F.lit(name).alias("issue"), "n") for name, df in parts))


def quality_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """(field, filled, n, completeness) of each column, from one aggregation."""
    counts = df.agg(F.count("*").alias("n"), *(F.count(c).alias(c) for c in columns))
    pairs = ", ".join(f"'{c}', `{c}`" for c in columns)
    return counts.select("n", F.expr(f"stack({len(columns)}, {pairs}) as (field, filled)")).withColumn("completeness", F.when(F.col("n") > 0, F.col("filled") / F.col("n")))


def remove_synthetic(df: DataFrame, rules: list[Column]) -> DataFrame:
    """Rows that no rule of synthetic data matches; a rule that is null does not match."""
    return df.where(~reduce(lambda a, b: a | b, (F.coalesce(r, F.lit(False)) for r in rules)))
