"""Readers that bring other shapes of data into the ledger's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .schemas import API_ACCOUNT, API_TRANSFER, BLOCK, LOG_LINE, AMOUNT


def _frame(spark: SparkSession, source: str | DataFrame, schema: str) -> DataFrame:
    return source if isinstance(source, DataFrame) else spark.read.schema(schema).json(source)


def read_chain_api_transfers(spark: SparkSession, source: str | DataFrame) -> DataFrame:
    """Explorer transfers: amount_v2, else amount, else 0; epoch seconds to timestamps; the asset is `native` unless named."""
    j = _frame(spark, source, API_TRANSFER)
    return j.select(
        "hash", F.col("block_num").alias("block_number"), F.timestamp_seconds("block_timestamp").alias("timestamp"), F.col("from").alias("from_address"), F.col("to").alias("to_address"),
        F.coalesce("amount_v2", "amount", F.lit("0")).cast(AMOUNT).alias("value"), F.col("fee").cast(AMOUNT).alias("fee"), F.coalesce("success", F.lit(False)).alias("success"), F.coalesce("asset_symbol", F.lit("native")).alias("asset"),
    )


def display_name(d: Column) -> Column:
    """The first of: own display, parent:sub-symbol, the person's display, the tag's name."""
    parent = F.when(d["parent"]["display"].isNotNull(), F.concat_ws(":", d["parent"]["display"], d["parent"]["sub_symbol"]))
    text = lambda c: F.nullif(c, F.lit(""))
    return F.coalesce(text(d["display"]), parent, text(d["people"]["display"]), text(d["merkle"]["tag_name"]))


def read_chain_api_accounts(spark: SparkSession, source: str | DataFrame) -> DataFrame:
    j = _frame(spark, source, API_ACCOUNT)
    d = F.col("account_display")
    verified = F.coalesce(F.exists(d["judgements"], lambda x: x["judgement"].isin("Reasonable", "KnownGood")), F.lit(False))
    return j.select("address", F.col("balance").cast(AMOUNT).alias("balance"), display_name(d).alias("display"), verified.alias("verified"), d["merkle"]["tag_type"].alias("tag_type"), d["merkle"]["tag_name"].alias("tag_name"))


def extract_transfers_from_blocks(blocks: DataFrame) -> DataFrame:
    """Transfers of blocks (see schemas.BLOCK): extrinsics of the balances section with their success and fee, and events that no extrinsic gave.

    Success: an ExtrinsicSuccess event of the extrinsic; fee: its TransactionFeePaid event. An event-only transfer is dropped if its block has an extrinsic's with
    the same ends and amount.
    """
    b = blocks.select("number", "timestamp", "events", F.posexplode("extrinsics").alias("pos", "x"))
    own = F.filter("events", lambda e: e["extrinsic"] == F.col("x.index"))
    called = b.where("x.section = 'balances' and x.method like 'transfer%'").select(
        F.col("x.hash").alias("hash"), F.col("number").alias("block_number"), "timestamp", F.col("x.signer").alias("from_address"), F.col("x.args.dest").alias("to_address"), F.col("x.args.value").cast(AMOUNT).alias("value"),
        F.filter(own, lambda e: e["method"] == "TransactionFeePaid")[0]["data"]["fee"].cast(AMOUNT).alias("fee"), F.exists(own, lambda e: e["method"] == "ExtrinsicSuccess").alias("success"), F.col("x.method").alias("method"), F.lit("balances").alias("section"),
    )
    e = blocks.select("number", "hash", "timestamp", F.posexplode("events").alias("pos", "e")).where("e.section = 'balances' and e.method = 'Transfer'")
    events = e.select(
        F.concat_ws("-", "hash", F.col("pos").cast("string")).alias("hash"), F.col("number").alias("block_number"), "timestamp", F.col("e.data.from").alias("from_address"), F.col("e.data.to").alias("to_address"), F.col("e.data.amount").cast(AMOUNT).alias("value"),
        F.lit(None).cast(AMOUNT).alias("fee"), F.lit(True).alias("success"), F.lit("Transfer").alias("method"), F.lit("events").alias("section"),
    )
    keys = ["block_number", "from_address", "to_address", "value"]
    return called.unionByName(events.join(called.select(*keys), keys, "left_anti"))


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BLOCK).json(path)


def read_legacy_tables(transfers: DataFrame, blocks: DataFrame) -> DataFrame:
    """A relational dump: transfers joined to their blocks for hash and time."""
    b = blocks.select(F.col("id").alias("block_id"), F.col("number").alias("block_number"), F.col("time").alias("timestamp"))
    return transfers.join(b, "block_id").select("hash", "block_number", "timestamp", "from_address", "to_address", F.col("amount").cast(AMOUNT).alias("value"), "success")


def read_graph_json(spark: SparkSession, path: str, multi_line: bool = True) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of {nodes, edges} documents, one a file or (multi_line off) one a line; entries without their ids are left out."""
    schema = "nodes array<struct<id:string,identity:string,balance:string,riskScore:double,type:string>>, edges array<struct<source:string,target:string,weight:double,totalVolume:string,transferCount:long,type:string>>"
    docs = spark.read.schema(schema).option("multiLine", multi_line).json(path)
    nodes = docs.select(F.inline("nodes")).where("id is not null")
    return nodes, docs.select(F.inline("edges")).where("source is not null and target is not null").withColumn("totalVolume", F.col("totalVolume").cast(AMOUNT))


def read_watchlist(spark: SparkSession, path: str, fmt: str, existing: DataFrame | None = None) -> DataFrame:
    """A watchlist from CSV (with a header) or JSON without rows that have no address or are there already; one row per address."""
    schema = "address string, reason string, risk_level string"
    reader = spark.read.schema(schema)
    rows = (reader.option("header", True).csv(path) if fmt == "csv" else reader.json(path)).where("address is not null").dropDuplicates(["address"])
    return rows if existing is None else rows.join(existing.select("address"), "address", "left_anti")


def read_json_logs(spark: SparkSession, path: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Line-JSON logs; lines that are no JSON are skipped; optional range of times."""
    rows = spark.read.schema(LOG_LINE).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    rows = rows.where("_corrupt_record is null").drop("_corrupt_record")
    rows = rows if start is None else rows.where(F.col("time") >= F.lit(start).cast("timestamp"))
    return rows if end is None else rows.where(F.col("time") <= F.lit(end).cast("timestamp"))
