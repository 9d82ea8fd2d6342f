import uuid

from pyspark.sql import functions as F

from ..operators import scoring as R
from ..plans.cut import shared_dir
from ..sources import ledger as L
from ..sources import readers as I
from ..sources import sinks as K
from .base import LEDGER
from .filters import UNIT, _edges
from .joins import _metrics
from .scoring import SCORES, BANDS, _strength

_t = L.transfers


def _api_transfers(s, d):
    """The ledger as explorer JSON, written and read back."""
    path = f"{shared_dir(s)}/api-{uuid.uuid4().hex}"
    us = F.unix_seconds(F.col("timestamp").cast("timestamp"))
    odd = F.col("block_number") % 3
    _t(s, d).select("hash", F.col("block_number").alias("block_num"), us.alias("block_timestamp"), F.col("from_address").alias("from"), F.col("to_address").alias("to"), F.when(odd == 1, F.col("value").cast("string")).alias("amount"), F.when(odd == 0, F.col("value").cast("string")).alias("amount_v2"), F.lit("125000000").alias("fee"), "success").write.json(path)
    return I.read_chain_api_transfers(s, path).select("hash", "block_number", F.unix_seconds("timestamp").alias("seconds"), "from_address", "to_address", "value", "success", "asset")


def _api_accounts(s, d):
    path = f"{shared_dir(s)}/api-{uuid.uuid4().hex}"
    k = F.col("user_id")
    text = lambda c, x: F.when(c, x)
    shown = F.struct(
        text(k % 3 == 0, F.col("display")).alias("display"), F.when(k % 3 == 1, F.struct(F.lit("P").alias("display"), k.cast("string").alias("sub_symbol"))).alias("parent"), F.when(k % 9 == 2, F.struct(F.lit("person").alias("display"))).alias("people"),
        F.when(k % 9 == 5, F.struct(F.lit("Exchange").alias("tag_type"), F.lit("Ex").alias("tag_name"))).alias("merkle"), F.when(F.col("verified"), F.array(F.struct(F.lit("KnownGood").alias("judgement")))).alias("judgements"),
    )
    L.accounts(s, d).select("address", F.col("balance").cast("string").alias("balance"), shown.alias("account_display")).write.json(path)
    return I.read_chain_api_accounts(s, path)


def _blocks(s, d):
    """Blocks of ten ledger rows; every third transfer has no extrinsic of its own."""
    t = _t(s, d).withColumn("number", F.floor(F.col("block_number") / 10)).withColumn("i", (F.col("block_number") % 10).cast("int"))
    called = F.col("block_number") % 3 != 0
    x = F.struct(F.col("i").alias("index"), "hash", F.col("from_address").alias("signer"), F.lit("balances").alias("section"), F.lit("transfer_keep_alive").alias("method"), F.struct(F.col("to_address").alias("dest"), F.col("value").cast("string").alias("value")).alias("args"))
    data = lambda f, t_, a, fee: F.struct(f.alias("from"), t_.alias("to"), a.alias("amount"), fee.alias("fee"))
    none = F.lit(None).cast("string")
    ev = lambda sec, m, dt: F.struct(F.col("i").alias("extrinsic"), F.lit(sec).alias("section"), F.lit(m).alias("method"), dt.alias("data"))
    moved = ev("balances", "Transfer", data(F.col("from_address"), F.col("to_address"), F.col("value").cast("string"), none))
    paid = ev("transactionPayment", "TransactionFeePaid", data(none, none, none, F.lit("125")))
    done = F.when(F.col("success"), ev("system", "ExtrinsicSuccess", data(none, none, none, none)))
    b = t.groupBy("number").agg(F.array_sort(F.collect_list(F.when(called, x))).alias("extrinsics"), F.flatten(F.array_sort(F.collect_list(F.when(called, F.array_compact(F.array(moved, paid, done))).otherwise(F.array(moved))))).alias("events"))
    return b.select("number", F.concat(F.lit("B"), F.col("number").cast("string")).alias("hash"), F.make_timestamp(F.lit(2024), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)).alias("timestamp"), "extrinsics", "events")


def _from_blocks(s, d):
    return I.extract_transfers_from_blocks(_blocks(s, d)).select("block_number", "from_address", "to_address", "value", "fee", "success", "section")


def _legacy(s, d):
    t = _t(s, d).select("hash", F.col("block_number").alias("block_id"), "from_address", "to_address", F.col("value").cast("string").alias("amount"), "success")
    b = L.events(s, d).select(F.col("event_id").alias("id"), (F.col("event_id") * 2).alias("number"), F.col("ts").alias("time"))
    return I.read_legacy_tables(t, b)


def _graph_json(s, d):
    path = f"{shared_dir(s)}/graph-{uuid.uuid4().hex}"
    e = _edges(s, d).withColumn("k", F.col("from_address"))
    doc = e.groupBy("k").agg(F.collect_list(F.struct(F.col("from_address").alias("source"), F.col("to_address").alias("target"), F.col("total_volume").cast("string").alias("totalVolume"), F.col("transfer_count").alias("transferCount"))).alias("edges"))
    doc.select(F.array(F.struct(F.col("k").alias("id"))).alias("nodes"), "edges").write.json(path)
    return I.read_graph_json(s, path, multi_line=False)[1].select("source", "target", F.col("totalVolume").cast("string").alias("totalVolume"), "transferCount")


def _watchlist(s, d):
    path = f"{shared_dir(s)}/watch-{uuid.uuid4().hex}"
    a = L.accounts(s, d)
    a.select("address", F.col("node_type").alias("reason"), F.lit("high").alias("risk_level")).write.option("header", True).csv(path)
    return I.read_watchlist(s, path, "csv", a.where("node_type = 'regular'"))


def _csv(s, d):
    path = f"{shared_dir(s)}/csv-{uuid.uuid4().hex}"
    K.write_csv(_metrics(s, d).join(L.accounts(s, d).select("address", "balance"), "address"), _edges(s, d), path)
    return s.read.option("header", True).csv(f"{path}/edges").select("source", "target", "volume", "count")


def _json(s, d):
    path = f"{shared_dir(s)}/json-{uuid.uuid4().hex}"
    K.write_json(_metrics(s, d), _edges(s, d), path)
    return s.read.schema("address string, degree long, risk_score double").json(f"{path}/nodes")


def _nodes(s, d):
    return L.accounts(s, d).select("address", "display", "balance", F.col("risk_score").cast("int").alias("risk_score"), "node_type")


def _monthly(s, d):
    path = f"{shared_dir(s)}/month-{uuid.uuid4().hex}"
    K.write_partitioned_monthly(_t(s, d).withColumn("timestamp", F.col("timestamp") + F.make_dt_interval(F.lit(20))), path)
    return K.archive_before(s, path, 2024, 2).select("hash", "year", "month")


def _logs(s, d):
    path = f"{shared_dir(s)}/log-{uuid.uuid4().hex}"
    good = F.to_json(F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("time"), F.lit("info").alias("level"), F.col("event_type").alias("operation"), F.col("value").alias("duration"), F.col("user_id").cast("string").alias("requestId")))
    L.events(s, d).select(F.when(F.col("event_id") % 10 == 0, "no json").otherwise(good).alias("value")).write.text(path)
    return I.read_json_logs(s, path).groupBy("operation", "requestId").agg(F.count("*").alias("n"), F.round(F.sum("duration"), 4).alias("duration"))


QUERIES = {
    "s1_read_ledger": (lambda s, d: L.read_ledger(s, f"{d}/events.parquet").groupBy("event_type").agg(F.count("*").alias("n")), "SELECT event_type, count(*) AS n FROM events GROUP BY 1"),
    "s2_api_transfers": (
        _api_transfers,
        LEDGER + "SELECT hash, block_number, CAST(epoch_us(timestamp)//1000000 AS BIGINT) AS seconds, from_address, to_address, CASE WHEN block_number%3=2 THEN CAST(0 AS DECIMAL(38,0)) ELSE value END AS value, success, 'native' AS asset FROM t",
    ),
    "s3_api_accounts": (
        _api_accounts,
        LEDGER + "SELECT address, balance, CASE WHEN user_id%3=0 THEN display WHEN user_id%3=1 THEN concat('P:',user_id) WHEN user_id%9=2 THEN 'person' WHEN user_id%9=5 THEN 'Ex' END AS display, verified, CASE WHEN user_id%9=5 THEN 'Exchange' END AS tag_type, CASE WHEN user_id%9=5 THEN 'Ex' END AS tag_name FROM a",
    ),
    "s4_blocks": (
        _from_blocks,
        LEDGER + "SELECT block_number//10 AS block_number, from_address, to_address, value, CASE WHEN block_number%3<>0 THEN CAST(125 AS DECIMAL(38,0)) END AS fee, CASE WHEN block_number%3<>0 THEN success ELSE TRUE END AS success, CASE WHEN block_number%3<>0 THEN 'balances' ELSE 'events' END AS section FROM t",
    ),
    "s5_legacy_tables": (_legacy, LEDGER + "SELECT hash, block_number*2 AS block_number, timestamp, from_address, to_address, value, success FROM t"),
    "s6_graph_json": (_graph_json, LEDGER + 'SELECT from_address AS source, to_address AS target, CAST(total_volume AS VARCHAR) AS "totalVolume", transfer_count AS "transferCount" FROM e'),
    "s7_watchlist": (_watchlist, LEDGER + "SELECT address, node_type AS reason, 'high' AS risk_level FROM a WHERE node_type <> 'regular'"),
    "s8_write_csv": (_csv, LEDGER + "SELECT from_address AS source, to_address AS target, CAST(total_volume AS VARCHAR) AS volume, CAST(transfer_count AS VARCHAR) AS count FROM e"),
    "s9_write_json": (_json, LEDGER + "SELECT address, degree, risk_score FROM m"),
    "s10_graphml": (
        lambda s, d: K.graphml_rows(_nodes(s, d), _edges(s, d)),
        LEDGER + """SELECT 1 AS part, concat('<node id="',address,'"><data key="balance">',CAST(balance AS VARCHAR),'</data><data key="riskScore">',CAST(CAST(risk_score AS INTEGER) AS VARCHAR),'</data></node>') AS line FROM a UNION ALL SELECT 2, concat('<edge source="',from_address,'" target="',to_address,'"><data key="value">',CAST(total_volume AS VARCHAR),'</data><data key="transferCount">',transfer_count,'</data></edge>') FROM e""",
    ),
    "s11_gexf": (
        lambda s, d: K.gexf_rows(_nodes(s, d), _edges(s, d), 20 * UNIT, ["regular", "mixer"]),
        LEDGER + """, n AS (SELECT * FROM a WHERE node_type IN ('regular','mixer')) SELECT 1 AS part, concat('<node id="',address,'" label="',coalesce(display,address),'"/>') AS line FROM n UNION ALL SELECT 2, concat('<edge source="',from_address,'" target="',to_address,'" weight="',CAST(total_volume AS VARCHAR),'"/>') FROM e WHERE total_volume >= 20000000000000 AND from_address IN (SELECT address FROM n) AND to_address IN (SELECT address FROM n)""",
    ),
    "s12_export": (lambda s, d: K.export_select(L.accounts(s, d), "accounts", [F.col("risk_score") > 50]), LEDGER + "SELECT address, display, balance, risk_score, node_type FROM a WHERE risk_score > 50"),
    "s13_monthly": (_monthly, LEDGER + "SELECT hash, CAST(year(timestamp + INTERVAL 20 DAY) AS INTEGER) AS year, CAST(month(timestamp + INTERVAL 20 DAY) AS INTEGER) AS month FROM t WHERE timestamp + INTERVAL 20 DAY >= '2024-02-01'"),
    "s14_score_report": (
        lambda s, d: K.score_report(R.interpret_score(_strength(s, d)), "2024-01-30").select(F.get_json_object("value", "$.from").alias("from_address"), F.get_json_object("value", "$.to").alias("to_address"), F.get_json_object("value", "$.interpretation").alias("interpretation")),
        SCORES + f"SELECT from_address, to_address, {BANDS} AS interpretation FROM st",
    ),
    "m11_read_logs": (_logs, 'SELECT event_type AS operation, CAST(user_id AS VARCHAR) AS "requestId", count(*) AS n, round(sum(value),4) AS duration FROM events WHERE event_id%10<>0 GROUP BY 1,2'),
}
