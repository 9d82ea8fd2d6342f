"""Strength scores of the edges that a stream touches, with ranks from value histograms that follow the stream."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import scoring as R
from ..operators.aggregates import build_edges
from ..operators.metrics import degree_centrality
from ..plans.cut import delete, drop, materialise
from .jobs import add_edges, run_batches, snapshot_edges, versions

EDGE = ["from_address", "to_address"]
HISTOGRAM = "measure string, value double, n long"
#: Transfers are kept in so many parts by sender, so that a batch reads those of its own accounts.
PARTS = 64

def _measures() -> dict[str, Column]:
    """What strength_score ranks: the total, the mean and the number of an edge's transfers."""
    total = F.col("total_volume").cast("double")
    return {"_total": total, "_mean": total / F.col("transfer_count"), "transfer_count": F.col("transfer_count").cast("double")}


def _values(edges: DataFrame, n: int) -> DataFrame:
    """(measure, value, n): n for each measure of each edge."""
    each = F.array(*(F.struct(F.lit(name).alias("measure"), value.alias("value")) for name, value in _measures().items()))
    return edges.select(F.explode(each).alias("x")).select("x.*", F.lit(n).cast("long").alias("n"))


def histogram(spark: SparkSession, base: str, upto: int) -> DataFrame:
    """The histogram of all edges after batch `upto`: the newest whole one and the changes since."""
    whole = max((k for k in versions(spark, base, "histogram") if k <= upto), default=-1)
    paths = [f"{base}/change-{k}" for k in versions(spark, base, "change") if whole < k <= upto] + ([f"{base}/histogram-{whole}"] if whole >= 0 else [])
    return spark.read.schema(HISTOGRAM).parquet(*paths)


def _band(value: Column) -> Column:
    """A coarse place of a value that keeps its order: 64 bands for each doubling above 1, one for all below; some 10,000 in all."""
    return F.when(value <= 1, F.lit(-1)).otherwise(F.floor(F.log2(value) * 64)).cast("long")


def ranks_from(found: DataFrame) -> Callable[[DataFrame, str, str], DataFrame]:
    """strict_rank_fraction for a few rows, by a histogram of all: values are counted by band, and one by one only in the bands of those rows."""

    def rank(df: DataFrame, column: str, name: str) -> DataFrame:
        mine = found.where(F.col("measure") == column).groupBy("value").agg(F.sum("n").alias("n")).where("n <> 0").withColumn("band", _band(F.col("value")))
        bands = materialise(mine.groupBy("band").agg(F.sum("n").alias("n")))
        wanted = materialise(df.select(F.col(column).cast("double").alias("value")).where("value is not null").distinct().withColumn("band", _band(F.col("value"))))
        at = wanted.select("band").distinct()
        lower = at.join(F.broadcast(bands.withColumnRenamed("band", "_b")), F.col("_b") < F.col("band"), "left").groupBy("band").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("_lower"))  # some 10,000 bands at most
        fine = mine.join(at, "band", "left_semi").select("band", F.col("value").alias("_v"), "n")
        below = wanted.join(fine, "band", "left").groupBy("value", "band").agg(F.coalesce(F.sum(F.when(F.col("_v") < F.col("value"), F.col("n"))), F.lit(0)).alias("_below"))
        every = bands.agg(F.sum("n").alias("_all"))
        share = below.join(lower, "band").crossJoin(F.broadcast(every)).select(F.col("value").alias("_key"), ((F.col("_lower") + F.col("_below")) / F.col("_all")).alias(name))  # one row
        return df.join(share, F.col(column).cast("double") == F.col("_key"), "left").drop("_key")

    return rank


def rescore_strength(transfers: DataFrame, accounts: DataFrame, ranks: DataFrame, as_of: DataFrame, folder: str | None = None, fold_every: int = 20) -> DataFrame:
    """(from_address, to_address, strength, adjusted): the full score of each edge as of the last batch that touched it.

    A batch adds its edges to the edge table, its transfers to the parts of their senders, and to the histograms the values that its edges have now less
    those that they had; so what an edge's rank needs follows the stream without ranking all edges again. Scores are those of
    strength_score over all rows so far, for the touched edges alone: transfers are read of their senders and receivers, common connections are looked
    up for them. ranks (address, pagerank) and as_of stand still within a run. All state is in the folder; a batch that is run again writes the same.
    """
    spark = transfers.sparkSession
    schema = build_edges(spark.createDataFrame([], transfers.schema)).schema
    part = lambda c: F.pmod(F.xxhash64(c), F.lit(PARTS)).cast("int")

    def each(batch: DataFrame, k: int, base: str) -> None:
        batch = materialise(batch)
        before = snapshot_edges(spark, base, schema, k - 1)
        touched = materialise(batch.select(*EDGE).distinct())
        old = materialise(before.join(touched, EDGE, "left_semi"))
        add_edges(spark, schema, fold_every, batch, k, base)
        edges = materialise(snapshot_edges(spark, base, schema, k))
        mine = materialise(edges.join(touched, EDGE, "left_semi"))
        _values(mine, 1).unionByName(_values(old, -1)).groupBy("measure", "value").agg(F.sum("n").alias("n")).where("n <> 0").write.mode("overwrite").parquet(f"{base}/change-{k}")
        if k % fold_every == fold_every - 1:
            whole = [j for j in versions(spark, base, "histogram") if j < k]
            histogram(spark, base, k).groupBy("measure", "value").agg(F.sum("n").alias("n")).where("n <> 0").write.mode("overwrite").parquet(f"{base}/histogram-{k}")
            if whole:
                delete(spark, [f"{base}/change-{j}" for j in versions(spark, base, "change") if j <= whole[-1]] + [f"{base}/histogram-{j}" for j in whole[:-1]])
        batch.withColumn("part", part("from_address")).repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{base}/rows-{k}")
        ends = touched.select(F.explode(F.array(*EDGE)).alias("address")).distinct()
        parts = [r.part for r in ends.select(part("address").alias("part")).distinct().collect()]  # PARTS at most
        paths = [f"{base}/rows-{j}" for j in versions(spark, base, "rows") if j <= k]
        kept = [spark.read.schema(batch.withColumn("part", F.lit(0)).schema).parquet(p).where(F.col("part").isin(parts)) for p in paths]
        rows = materialise(reduce(DataFrame.unionByName, kept).join(ends.withColumnRenamed("address", "from_address"), "from_address", "left_semi").drop("part"))
        own = rows.join(touched, EDGE, "left_semi")
        rank = ranks_from(histogram(spark, base, k))
        scored = R.strength_score(
            R.volume_score(mine, accounts, rank), R.frequency_score(mine, own, rank), R.temporal_score(own, as_of), R.network_score(edges, degree_centrality(edges), ranks, touched), R.risk_score(rows, accounts).join(touched, EDGE, "left_semi")
        )
        scored.select(*EDGE, "strength", "adjusted", F.lit(k).cast("long").alias("batch")).write.mode("overwrite").parquet(f"{base}/strength-{k}")
        for t in (batch, touched, old, edges, mine, rows):
            drop(t)

    base = run_batches(transfers, each, folder=folder)
    paths = [f"{base}/strength-{k}" for k in versions(spark, base, "strength")]
    kind = "from_address string, to_address string, strength double, adjusted double, batch long"
    scores = spark.read.schema(kind).parquet(*paths) if paths else spark.createDataFrame([], kind)
    return scores.groupBy(*EDGE).agg(F.max_by(F.struct("strength", "adjusted"), "batch").alias("s")).select(*EDGE, "s.*")
