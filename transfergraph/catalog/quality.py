from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import quality as Q
from ..sources import ledger as L
from .base import LEDGER
from .filters import UNIT, _edges
from .windows import _round

_t = L.transfers


def _blocks(s, d):
    n = A.dedup_transfers(_t(s, d)).groupBy(F.col("block_number").alias("number")).agg(F.count("*").alias("transfers"))
    k = F.col("number")
    e = L.events(s, d).select(F.col("event_id").alias("number")).join(n, "number", "left").fillna(0, ["transfers"])
    return e.select("number", F.concat(F.lit("b"), k.cast("string")).alias("hash"), F.when(k % 97 == 0, "x").otherwise(F.concat(F.lit("b"), (k - 1).cast("string"))).alias("parent_hash"), F.when(k % 501 == 0, F.col("transfers") + 1).otherwise(F.col("transfers")).alias("transfers"))


def _validity(s, d):
    n = L.accounts(s, d).select(F.when(F.col("user_id") % 10 != 0, F.col("address")).alias("id"), F.when(F.col("user_id") % 7 == 0, "other").otherwise(F.col("address")).alias("address"))
    e = _edges(s, d).select(F.when(F.col("transfer_count") == 1, F.col("from_address")).alias("source"), F.col("to_address").alias("target"))
    return Q.graph_validity(n, e)


def _show(df):
    return df.withColumn("errors", F.array_join("errors", ","))


QUERIES = {
    "q1_unique_violations": (lambda s, d: Q.unique_violations(_t(s, d), ["from_address", "to_address"]), LEDGER + "SELECT from_address, to_address, count(*) AS n FROM t GROUP BY 1,2 HAVING count(*) > 1"),
    "q2_foreign_keys": (
        lambda s, d: Q.foreign_key_violations(_t(s, d), "to_address", L.accounts(s, d).where("display is not null")),
        LEDGER + "SELECT to_address AS value, count(*) AS n FROM t WHERE to_address NOT IN (SELECT address FROM a WHERE display IS NOT NULL) GROUP BY 1",
    ),
    "q3_formats": (
        lambda s, d: _show(Q.format_check(_t(s, d).withColumn("hash", F.when(F.col("block_number") % 2 == 0, F.concat(F.lit("0x"), F.sha2("hash", 256))).otherwise(F.col("hash"))).withColumn("to_address", F.when(F.col("block_number") % 3 == 0, F.repeat(F.lit("x"), F.lit(47))).otherwise(F.col("to_address"))))),
        LEDGER + "SELECT CASE WHEN block_number%2=0 THEN concat('0x',sha256(hash)) ELSE hash END AS hash, concat_ws(',', CASE WHEN block_number%2<>0 THEN 'hash' END, 'from_address', CASE WHEN block_number%3<>0 THEN 'to_address' END) AS errors FROM t",
    ),
    "q4_consistency": (
        lambda s, d: _show(Q.transfer_consistency(_t(s, d), L.accounts(s, d), UNIT)),
        LEDGER + ", x AS (SELECT hash, concat_ws(',', CASE WHEN NOT coalesce(balance >= value + 1000000000000, FALSE) THEN 'insufficient_balance' END, CASE WHEN from_address = to_address THEN 'self_transfer' END) AS errors FROM t LEFT JOIN a ON a.address = from_address) SELECT * FROM x WHERE errors <> ''",
    ),
    "q5_balances": (
        lambda s, d: Q.balance_reconciliation(L.accounts(s, d), _t(s, d), 1.0),
        LEDGER + ", x AS (SELECT address, CAST(sum(CASE WHEN direction='in' THEN value ELSE -value END) AS DECIMAL(38,0)) AS derived FROM l GROUP BY 1) SELECT a.address, balance AS stated, CAST(coalesce(derived,0) AS DECIMAL(38,0)) AS derived, abs(CAST(balance - coalesce(derived,0) AS DOUBLE)) <= 1.0*abs(CAST(balance AS DOUBLE)) AS ok FROM a LEFT JOIN x USING (address)",
    ),
    "q6_sources": (
        lambda s, d: Q.source_reconciliation(_t(s, d).where("block_number % 11 <> 0"), _t(s, d).where("block_number % 13 <> 0").withColumn("success", F.when(F.col("block_number") % 5 == 0, F.lit(None)).otherwise(F.col("success"))), "hash", ["value", "success"]),
        LEDGER + "SELECT hash, CASE WHEN block_number%11=0 THEN 'missing_in_a' WHEN block_number%13=0 THEN 'missing_in_b' ELSE 'differs' END AS status, CASE WHEN block_number%11<>0 AND block_number%13<>0 THEN 'success' ELSE '' END AS fields FROM t WHERE NOT (block_number%11=0 AND block_number%13=0) AND (block_number%11=0 OR block_number%13=0 OR block_number%5=0)",
    ),
    "q7_blocks": (
        lambda s, d: _show(Q.block_reconciliation(_blocks(s, d), _t(s, d))),
        "SELECT event_id AS number, concat_ws(',', CASE WHEN event_id%97=0 AND event_id > (SELECT min(event_id) FROM events) THEN 'parent' END, CASE WHEN event_id%501=0 THEN 'count' END) AS errors FROM events WHERE (event_id%97=0 AND event_id > (SELECT min(event_id) FROM events)) OR event_id%501=0",
    ),
    "q8_graph_validity": (
        _validity,
        LEDGER + ", n AS (SELECT CASE WHEN user_id%10<>0 THEN address END AS id, CASE WHEN user_id%7=0 THEN 'other' ELSE address END AS address FROM a), x AS (SELECT CASE WHEN transfer_count=1 THEN from_address END AS source, to_address AS target FROM e) SELECT 'node_without_id' AS issue, count(*) AS n FROM n WHERE id IS NULL UNION ALL SELECT 'id_is_not_address', count(*) FROM n WHERE id <> address UNION ALL SELECT 'repeated_id', count(*) FROM (SELECT id FROM n GROUP BY 1 HAVING count(*) > 1) "
        "UNION ALL SELECT 'edge_without_end', count(*) FROM x WHERE source IS NULL UNION ALL SELECT 'unknown_source', count(*) FROM x WHERE source IS NOT NULL AND source NOT IN (SELECT id FROM n WHERE id IS NOT NULL) UNION ALL SELECT 'unknown_target', count(*) FROM x WHERE target NOT IN (SELECT id FROM n WHERE id IS NOT NULL)",
    ),
    "q9_quality_summary": (
        lambda s, d: _round(Q.quality_summary(L.accounts(s, d), ["address", "display", "legal"]), "completeness"),
        LEDGER + "SELECT count(*) AS n, 'address' AS field, count(address) AS filled, round(count(address)/count(*),6) AS completeness FROM a UNION ALL SELECT count(*), 'display', count(display), round(count(display)/count(*),6) FROM a UNION ALL SELECT count(*), 'legal', count(legal), round(count(legal)/count(*),6) FROM a",
    ),
    "q10_remove_synthetic": (
        lambda s, d: Q.remove_synthetic(L.accounts(s, d), [F.col("address").like("U00001%"), F.col("user_id").between(50, 59), F.col("display").like("Name 9%")]),
        LEDGER + "SELECT * FROM a WHERE NOT (address LIKE 'U00001%' OR user_id BETWEEN 50 AND 59 OR coalesce(display LIKE 'Name 9%', FALSE))",
    ),
}
