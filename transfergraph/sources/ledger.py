"""The ledger that the driver's tables hold: purchases are transfers, users are accounts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .schemas import AMOUNT


def read_ledger(spark: SparkSession, path: str, fmt: str = "parquet", schema=None) -> DataFrame:
    """A table of the ledger in any format that Spark reads."""
    reader = spark.read.format(fmt)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def address(user: Column) -> Column:
    return F.concat(F.lit("U"), F.lpad(user.cast("string"), 6, "0"))


def transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """hash, block_number, timestamp, from_address, to_address, value, success."""
    e = events(spark, sf_dir)
    users = e.agg((F.max("user_id") + 1).alias("k"))
    to = (F.col("user_id") * 31 + F.col("event_id") * 17 + 7) % F.col("k")
    return (
        e.where("event_type = 'purchase'").crossJoin(F.broadcast(users))  # one row
        .select(
            F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("hash"), F.col("event_id").alias("block_number"), F.col("ts").alias("timestamp"), address(F.col("user_id")).alias("from_address"),
            address(to).alias("to_address"), (F.round(F.col("value") * 100).cast("long") * 10**10).cast(AMOUNT).alias("value"), (F.col("event_id") % 20 != 0).alias("success"),
        )
    )


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, address, display, legal, verified, balance, created_at, risk_score, node_type: one row per user of events."""
    u = events(spark, sf_dir).select("user_id").distinct()
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("user_id"), "c_acctbal")
    k = F.col("user_id")
    kind = F.when(k % 25 == 0, "exchange").when(k % 25 == 1, "mixer").when(k % 25 == 2, "validator").otherwise("regular")
    return u.join(c, "user_id", "left").select(
        "user_id", address(k).alias("address"), F.when(k % 3 == 0, F.concat(F.lit("Name "), k.cast("string"))).alias("display"), F.when(k % 6 == 0, F.concat(F.lit("Legal "), k.cast("string"))).alias("legal"),
        (k % 9 == 0).alias("verified"), F.greatest(F.round(F.coalesce("c_acctbal", F.lit(0.0)) * 100).cast("long") * 10**10, F.lit(0).cast("long")).cast(AMOUNT).alias("balance"),
        (F.lit("2023-12-15").cast("timestamp") + F.make_dt_interval((k % 40).cast("int"))).alias("created_at"), ((k * 7) % 101).cast("double").alias("risk_score"), kind.alias("node_type"),
    )


def seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set of searches: accounts whose id is divisible by 100."""
    return accounts(spark, sf_dir).where("user_id % 100 = 0").select("address")


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """address, pattern_type, confidence, severity, reviewed, false_positive, detected_at: the events that are no purchases, read as detections."""
    k = F.col("event_id")
    return events(spark, sf_dir).where("event_type <> 'purchase'").select(
        k.alias("detection_id"), address(F.col("user_id")).alias("address"), F.col("event_type").alias("pattern_type"), F.least(F.col("value") / 100, F.lit(1.0)).alias("confidence"),
        F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high"), F.lit("critical")), (k % 4 + 1).cast("int")).alias("severity"), (k % 7 == 0).alias("reviewed"), (k % 11 == 0).alias("false_positive"), F.col("ts").alias("detected_at"),
    )
