"""A full-text index that is kept as a table bucketed by token: batches of accounts are added to it, and searches join it without a shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.cut import materialise
from .joins import inverted_index, tokens

BUCKETS = 64


def add_to_index(accounts: DataFrame, columns: list[str], table: str, buckets: int = BUCKETS) -> int:
    """Add the accounts that the index does not have yet; the number of those. `table` is created by the first batch.

    Postings (token, address, tf) are appended to the buckets of their tokens, so a batch costs what it brings; what is there is read for its
    addresses alone. {table}_batches gets a row a batch with its number of accounts. A null address is no account; of several rows of one address in a batch one counts.
    """
    spark = accounts.sparkSession
    new = accounts.where("address is not null").dropDuplicates(["address"])
    if spark.catalog.tableExists(f"{table}_accounts"):
        new = new.join(spark.table(f"{table}_accounts"), "address", "left_anti")
    new = materialise(new.select("address", *(c for c in columns if c != "address")))
    n = new.count()
    postings = inverted_index(new, columns).select("token", "address", "tf").repartition(buckets, "token")
    postings.write.bucketBy(buckets, "token").sortBy("token").mode("append").format("parquet").saveAsTable(table)
    spark.createDataFrame([(n,)], "n long").coalesce(1).write.mode("append").format("parquet").saveAsTable(f"{table}_batches")
    new.select("address").write.mode("append").format("parquet").saveAsTable(f"{table}_accounts")
    return n


def search_index(queries: DataFrame, table: str) -> DataFrame:
    """(query, address, matched, rank) as fulltext_search gives for all accounts added so far: rank sums tf * ln(1 + N / df).

    Terms are shuffled to the buckets; the postings, and the number of them for each token, stay where they are.
    """
    spark = queries.sparkSession
    index = spark.table(table)
    df = index.groupBy("token").agg(F.count("*").alias("df"))
    n = spark.table(f"{table}_batches").agg(F.sum("n").alias("n"))
    terms = queries.select("query", F.explode(F.array_distinct(tokens(F.col("query")))).alias("token"))
    hit = terms.join(index.hint("shuffle_merge"), "token").join(df.hint("shuffle_merge"), "token").crossJoin(F.broadcast(n))  # one row
    return hit.groupBy("query", "address").agg(F.count("*").alias("matched"), F.sum(F.col("tf") * F.log(1 + F.col("n") / F.col("df"))).alias("rank"))


def drop_index(spark: SparkSession, table: str) -> None:
    for name in (table, f"{table}_batches", f"{table}_accounts"):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
