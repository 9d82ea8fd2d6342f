from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import joins as J
from ..sources import ledger as L
from .base import LEDGER
from .filters import T0, T1, UNIT, _edges, _ts
from .joins import HOPS

D = "CAST({} AS DECIMAL(38,0))".format
IN, OUT = "FILTER (WHERE direction='in')", "FILTER (WHERE direction='out')"
_t = L.transfers


def _two_hop_paths(s, d):
    return J.two_hop_pairs(_edges(s, d)).select(F.col("origin").alias("start"), F.col("destination").alias("end"), F.lit(2).alias("hops"), "bottleneck")


def _merge(s, d):
    a = L.accounts(s, d).select("address", "display", "legal", "balance")
    new = L.accounts(s, d).where("user_id % 2 = 0").select(F.when(F.col("user_id") % 4 == 0, F.col("address")).otherwise(F.concat(F.lit("N"), "address")).alias("address"), F.when(F.col("user_id") % 8 == 0, F.lit("New")).alias("display"), F.lit(None).cast("string").alias("legal"), (F.col("balance") * 2).cast("decimal(38,0)").alias("balance"))
    return A.merge_accounts(a, new)


def _daily_history(s, d):
    t = _t(s, d)
    twice = A.daily_metric(t).withColumn("version", F.lit(1)).unionByName(A.daily_metric(t.where("success")).withColumn("version", F.lit(2)))
    return A.latest_metrics(twice, ["metric_date"], "version")


QUERIES = {
    "a1_build_edges": (_edges, LEDGER + "SELECT * FROM e"),
    "a2_account_totals": (lambda s, d: A.account_totals(_t(s, d)), LEDGER + f"SELECT address, count(*) {IN} AS transfers_in, count(*) {OUT} AS transfers_out, {D(f'coalesce(sum(value) {IN},0)')} AS volume_in, {D(f'coalesce(sum(value) {OUT},0)')} AS volume_out, max(block_number) AS last_seen_block FROM l GROUP BY 1"),
    "a3_account_stats": (
        lambda s, d: A.account_stats(L.accounts(s, d), _t(s, d)),
        LEDGER + f"SELECT a.address, {D(f'coalesce(sum(value) {IN},0)')} AS received, {D(f'coalesce(sum(value) {OUT},0)')} AS sent, count(l.hash) {IN} AS n_received, count(l.hash) {OUT} AS n_sent, count(DISTINCT other) {IN} AS unique_senders, count(DISTINCT other) {OUT} AS unique_receivers, min(block_number) AS first_block, max(block_number) AS last_block FROM a LEFT JOIN l USING (address) GROUP BY 1",
    ),
    "a4_transfer_statistics": (
        lambda s, d: A.transfer_statistics(_t(s, d)),
        LEDGER + f", r AS (SELECT address, count(*) AS n FROM (SELECT x.address FROM l x JOIN l y ON x.address = y.address AND epoch_us(y.timestamp) > epoch_us(x.timestamp) AND epoch_us(y.timestamp) <= epoch_us(x.timestamp) + 3600000000) GROUP BY 1) "
        f"SELECT l.address, count(DISTINCT other) AS unique_counterparties, {D(f'coalesce(sum(value) {IN},0)')} AS volume_in, {D(f'coalesce(sum(value) {OUT},0)')} AS volume_out, {D('sum(value)')} AS total_volume, count(*) {IN} AS n_in, count(*) {OUT} AS n_out, count(*) AS n_total, coalesce(any_value(n),0) AS rapid_pairs FROM l LEFT JOIN r USING (address) GROUP BY 1",
    ),
    "a5_counterparty_rollup": (
        lambda s, d: A.counterparty_rollup(_edges(s, d), 20 * UNIT),
        LEDGER + f"SELECT address, other, count(*) {IN} AS edges_in, count(*) {OUT} AS edges_out, {D('sum(total_volume)')} AS volume, min(first_transfer_block) AS first_block, max(last_transfer_block) AS last_block FROM ue GROUP BY 1,2 HAVING sum(total_volume) >= 20000000000000",
    ),
    "a6_account_summary": (
        lambda s, d: A.account_summary(L.accounts(s, d), _edges(s, d)),
        LEDGER + f"SELECT a.address, balance, risk_score, count(ue.other) {IN} AS in_connections, count(ue.other) {OUT} AS out_connections, CAST(coalesce(sum(transfer_count),0) AS BIGINT) AS total_transfers FROM a LEFT JOIN ue USING (address) GROUP BY 1,2,3",
    ),
    "a7_counterparty_flows": (
        lambda s, d: A.counterparty_flows(_t(s, d), UNIT),
        LEDGER + f"SELECT address, other, count(*) {OUT} AS n_sent, count(*) {IN} AS n_received, {D(f'coalesce(sum(value) {OUT},0)')} AS sent, {D(f'coalesce(sum(value) {IN},0)')} AS received, min(timestamp) AS first_seen, max(timestamp) AS last_seen, {D('sum(value)')} AS total, "
        f"CASE WHEN count(*) {OUT} > 0 AND count(*) {IN} > 0 THEN 'bidirectional' WHEN count(*) {OUT} > 0 THEN 'outgoing' ELSE 'incoming' END AS kind FROM l WHERE value >= 1000000000000 GROUP BY 1,2",
    ),
    "a8_volume_statistics": (
        lambda s, d: A.volume_statistics(_edges(s, d)).withColumn("value", F.round(F.col("value") / 1e12, 6)),
        LEDGER + ", o AS (SELECT total_volume, row_number() OVER (ORDER BY total_volume) - 1 AS i, count(*) OVER () AS n FROM e) SELECT 'total' AS metric, round(CAST(sum(total_volume) AS DOUBLE)/1e12,6) AS value FROM e UNION ALL SELECT 'average', round(CAST(sum(total_volume) AS DOUBLE)/count(*)/1e12,6) FROM e UNION ALL SELECT 'median', round(CAST(total_volume AS DOUBLE)/1e12,6) FROM o WHERE i = n // 2",
    ),
    "a10_pair_activity": (
        lambda s, d: A.pair_activity(_t(s, d)).withColumn("mean", F.round(F.col("mean") / 1e12, 6)),
        LEDGER + f"SELECT from_address, to_address, count(*) AS n, {D('sum(value)')} AS volume, round(avg(CAST(value AS DOUBLE))/1e12,6) AS mean, min(timestamp) AS first_seen, max(timestamp) AS last_seen FROM t GROUP BY 1,2 HAVING count(*) > 1",
    ),
    "a11_sender_totals": (lambda s, d: A.sender_totals(_t(s, d)), LEDGER + f"SELECT from_address, count(*) AS n, {D('sum(value)')} AS volume FROM t GROUP BY 1"),
    "a12_address_activity": (
        lambda s, d: A.address_activity(_t(s, d), _ts(T0), _ts(T1), 3),
        LEDGER + f"SELECT address, count(*) AS n, min(timestamp) AS first_seen, max(timestamp) AS last_seen FROM l WHERE timestamp BETWEEN '{T0}' AND '{T1}' GROUP BY 1 HAVING count(*) > 3",
    ),
    "a13_pattern_counts": (lambda s, d: A.pattern_counts(L.detections(s, d)), LEDGER + "SELECT pattern_type, count(*) AS n, count(DISTINCT address) AS addresses, max(confidence) AS max_confidence FROM det GROUP BY 1"),
    "a14_network_overview": (
        lambda s, d: A.network_overview(L.accounts(s, d), _t(s, d)).withColumn("mean_balance", F.round(F.col("mean_balance") / 1e12, 6)),
        LEDGER + f"SELECT * FROM (SELECT count(*) AS transfers, {D('sum(value)')} AS volume, max(block_number) AS last_block FROM t), (SELECT count(*) AS accounts, round(avg(CAST(balance AS DOUBLE)) FILTER (WHERE balance > 0)/1e12,6) AS mean_balance, count(display) AS identified FROM a), (SELECT count(*) AS busy_accounts FROM (SELECT address FROM l GROUP BY 1 HAVING count(*) > 10))",
    ),
    "a15_graph_totals": (lambda s, d: A.graph_totals(_edges(s, d)).withColumn("average_degree", F.round("average_degree", 6)), LEDGER + "SELECT (SELECT count(*) FROM e) AS edges, count(DISTINCT address) AS nodes, round(2.0*(SELECT count(*) FROM e)/count(DISTINCT address),6) AS average_degree FROM ue"),
    "a16_daily_metric": (_daily_history, LEDGER + f"SELECT CAST(timestamp AS DATE) AS metric_date, count(*) AS transfers, {D('sum(value)')} AS volume, count(DISTINCT from_address) AS senders, 2 AS version FROM t WHERE success GROUP BY 1"),
    "a17_dedup_transfers": (lambda s, d: A.dedup_transfers(_t(s, d).unionByName(_t(s, d).withColumn("block_number", F.col("block_number") + 5))), LEDGER + "SELECT * FROM t"),
    "a18_merge_accounts": (
        _merge,
        LEDGER + ", n AS (SELECT CASE WHEN user_id%4=0 THEN address ELSE concat('N',address) END AS address, CASE WHEN user_id%8=0 THEN 'New' END AS display, CAST(balance*2 AS DECIMAL(38,0)) AS balance FROM a WHERE user_id%2=0) SELECT coalesce(n.address, a.address) AS address, coalesce(n.display, a.display) AS display, a.legal, coalesce(n.balance, a.balance) AS balance FROM a FULL JOIN n USING (address)",
    ),
    "a19_connection_summary": (lambda s, d: A.connection_summary(_two_hop_paths(s, d)), LEDGER + HOPS + 'SELECT origin AS start, destination AS "end", 2 AS min_hops, count(*) AS paths, max(bottleneck) AS max_volume FROM hop GROUP BY 1,2'),
    "a20_volume_quantiles": (
        lambda s, d: A.volume_quantiles(_edges(s, d)).select(*(F.round(F.col(c) / 1e12, 6).alias(c) for c in ("p25", "p50", "p75", "p90", "p95", "p99"))),
        LEDGER + "SELECT " + ", ".join(f"round(quantile_cont(CAST(total_volume AS DOUBLE), {q})/1e12, 6) AS p{round(q*100)}" for q in (0.25, 0.5, 0.75, 0.9, 0.95, 0.99)) + " FROM e",
    ),
    "a21_daily_volume_baseline": (
        lambda s, d: A.daily_volume_baseline(_t(s, d), 10).withColumn("average", F.round(F.col("average") / 1e12, 6)),
        LEDGER + f", dv AS (SELECT address, CAST(timestamp AS DATE) AS day, sum(value) AS v FROM l GROUP BY 1,2), r AS (SELECT *, row_number() OVER (PARTITION BY address ORDER BY day DESC) AS rn FROM dv) SELECT address, count(*) AS days, round(avg(CAST(v AS DOUBLE))/1e12,6) AS average, {D('max(v)')} AS highest FROM r WHERE rn <= 10 GROUP BY 1",
    ),
    "a22_amount_frequency": (lambda s, d: A.amount_frequency(_t(s, d)), LEDGER + "SELECT address, value, count(*) AS n FROM l GROUP BY 1,2 HAVING count(*) > 1"),
    "a23_degree_distribution": (
        lambda s, d: A.degree_distribution(_edges(s, d)),
        LEDGER + "SELECT kind, degree, count(*) AS nodes FROM (SELECT 'in' AS kind, in_degree AS degree FROM m UNION ALL SELECT 'out', out_degree FROM m UNION ALL SELECT 'total', degree FROM m) GROUP BY 1,2",
    ),
    "a24_node_graph_metrics": (
        lambda s, d: A.node_graph_metrics(_edges(s, d)).withColumn("average_degree", F.round("average_degree", 6)),
        LEDGER + "SELECT address, degree, in_degree, out_degree, total_volume_in, total_volume_out, round((SELECT avg(degree) FROM m),6) AS average_degree FROM m",
    ),
}
