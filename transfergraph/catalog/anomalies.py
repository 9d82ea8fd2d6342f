from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import anomalies as N
from ..operators import paths as G
from ..operators import windows as W
from ..sources import ledger as L
from .base import LEDGER
from .filters import _as_of, _edges
from .graph import CYCLES, REC, SEEDED

from .windows import BALANCES, GAPS, QUERIES as WINDOWS, _round, _round_scaled

_t = L.transfers
X = "CAST(value AS DOUBLE)/1e12"


def _bursts(s, d):
    return L.detections(s, d).select("address", F.col("detected_at").alias("timestamp"), F.col("pattern_type").alias("kind"), "confidence", F.element_at(F.create_map(*(x for k, n in (("low", 1), ("medium", 2), ("high", 3), ("critical", 4)) for x in (F.lit(k), F.lit(n)))), F.col("severity")).alias("severity"))


def _rates(seconds):
    u = seconds * 1000000
    w = f"(PARTITION BY address ORDER BY epoch_us(timestamp) RANGE BETWEEN {u} PRECEDING AND CURRENT ROW)"
    p = f"(PARTITION BY address ORDER BY epoch_us(timestamp) RANGE BETWEEN UNBOUNDED PRECEDING AND {u + 1} PRECEDING)"
    return (
        f", r1 AS (SELECT *, count(*) OVER w AS n, sum({X}) OVER w AS vol, len(list_distinct(array_agg(other) OVER w)) AS partners FROM l WINDOW w AS {w}), r2 AS (SELECT *, avg(n) OVER p AS nb, avg(vol) OVER p AS vb, stddev_pop(vol) OVER p AS vs, avg(partners) OVER p AS pb, count(*) OVER p AS eb FROM r1 WINDOW p AS {p})"
    )


def _fee(s, d):
    return N.burst_fee(_t(s, d), F.col("value").cast("double") / 1e15, 86400, 100, 1.5)


def _calls(s, d):
    return L.events(s, d).select(L.address(F.col("user_id")).alias("address"), F.col("ts").alias("timestamp"), F.when(F.col("event_type") == "click", "xcm").otherwise("system").alias("module"), F.col("event_type").alias("call"), (F.col("event_id") % 5).alias("destination"))


def _splits(s, d):
    return _round(N.split_merge_flows(_t(s, d), 86400 * 7, 0.5), "sent", "merged")


def _features(s, d):
    return N.transfer_features(_t(s, d), A.degrees(_edges(s, d)))


def _similar(s, d):
    return _round(N.similar_addresses(A.degrees(_edges(s, d)), L.seeds(s, d), 0.85), "similarity")


DIFF = lambda c: f"CASE WHEN greatest(x.{c},y.{c}) > 0 THEN abs(CAST(x.{c} AS DOUBLE)-CAST(y.{c} AS DOUBLE))/CAST(greatest(x.{c},y.{c}) AS DOUBLE) ELSE 0 END"
COLUMNS = ["amount", "hour", "weekday", "gap", "degree", "deviation"]

QUERIES = {
    "n1_balance_anomalies": (
        lambda s, d: N.balance_anomalies(W.balance_events(_t(s, d))),
        LEDGER + BALANCES + """, b AS (SELECT *, lag(balance) OVER o AS lst, abs(balance - lag(balance) OVER o) AS ch FROM bal WINDOW o AS (PARTITION BY address ORDER BY timestamp, hash, direction)),
 c AS (SELECT *, count(balance) OVER h AS n, avg(balance) OVER h AS mean, stddev_pop(balance) OVER h AS sd, avg(ch) OVER h AS ty, list_sort(array_agg(balance) OVER h) AS hs FROM b WINDOW h AS (PARTITION BY address ORDER BY timestamp, hash, direction ROWS BETWEEN 100 PRECEDING AND 1 PRECEDING)),
 q AS (SELECT *, hs[CAST(floor(len(hs)*0.25) AS INTEGER)+1] AS q1, hs[CAST(floor(len(hs)*0.75) AS INTEGER)+1] AS q3 FROM c WHERE n >= 5),
 f AS (SELECT *, CAST(coalesce(sd > 0 AND abs(balance-mean) > 3*sd, FALSE) AS INTEGER) AS by_z, CAST(coalesce(balance < q1-1.5*(q3-q1) OR balance > q3+1.5*(q3-q1), FALSE) AS INTEGER) AS by_fence, CAST(coalesce(lst <> 0 AND ch > 0.5*abs(lst), FALSE) AS INTEGER) AS by_change, CAST(coalesce(ty > 0 AND ch > 10*ty, FALSE) AS INTEGER) AS by_rate FROM q)
 SELECT address, hash, direction, by_z, by_fence, by_change, by_rate, (by_z+by_fence+by_change+by_rate)/4 AS score FROM f WHERE (by_z+by_fence+by_change+by_rate)/4 > 0.3""",
    ),
    "n2_robust_balance": (lambda s, d: W.robust_zscore(W.balance_events(_t(s, d))).where("outlier").select("address", "hash", "direction"), WINDOWS["w10_robust_zscore"][1].split("SELECT address, hash, direction, round(balance")[0] + "SELECT address, hash, direction FROM z WHERE abs(z) > 3.5"),
    "n3_transfer_features": (
        lambda s, d: _round(_features(s, d), "amount", "gap", "deviation"),
        LEDGER + GAPS + f", mn AS (SELECT from_address, avg({X}) AS mean FROM t GROUP BY 1) SELECT hash, round({X},6) AS amount, hour(timestamp) AS hour, dayofweek(timestamp) AS weekday, round(coalesce(gap_before,0),6) AS gap, coalesce(degree,0) AS degree, round({X}-mean,6) AS deviation FROM g JOIN mn USING (from_address) LEFT JOIN m ON m.address = to_address",
    ),
    "n4_isolation_forest": (lambda s, d: N.isolation_forest(_features(s, d), "hash", COLUMNS), None),
    "n5_sequence_anomaly": (
        lambda s, d: _round(N.sequence_anomaly(_t(s, d), 5, 0.3, 0.1, 0.6), "score"),
        LEDGER + GAPS + f""", x AS (SELECT *, {X} AS x, CAST(row_number() OVER o AS DOUBLE) AS i FROM g WINDOW o AS (PARTITION BY from_address ORDER BY timestamp, hash)),
 y AS (SELECT *, avg(x) OVER w AS a, avg(gap_before) OVER w AS ga, regr_slope(x, i) OVER w AS sl FROM x WINDOW w AS (PARTITION BY from_address ORDER BY timestamp, hash ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)),
 z AS (SELECT *, lag(a,5) OVER o AS a0, lag(ga,5) OVER o AS g0 FROM y WINDOW o AS (PARTITION BY from_address ORDER BY timestamp, hash)),
 f AS (SELECT hash, from_address, CAST(coalesce(abs(a-a0) > 0.3*abs(a0),FALSE) AS INTEGER) AS by_amount, CAST(coalesce(abs(ga-g0) > 0.3*abs(g0),FALSE) AS INTEGER) AS by_gap, CAST(coalesce(abs(sl) > 0.1*abs(a),FALSE) AS INTEGER) AS by_trend FROM z WHERE i >= 10)
 SELECT *, round((by_amount+by_gap+by_trend)/3,6) AS score FROM f WHERE (by_amount+by_gap+by_trend)/3 > 0.6""",
    ),
    "n6_burst_count": (lambda s, d: _round(N.burst_count(_t(s, d), 86400, 2.0), "ratio"), LEDGER + _rates(86400) + "SELECT address, hash, direction, round(n/nb,6) AS ratio FROM r2 WHERE eb >= 3 AND n > 2.0*nb"),
    "n7_burst_volume": (lambda s, d: _round(N.burst_volume(_t(s, d), 86400, 2.0), "volume"), LEDGER + _rates(86400) + "SELECT address, hash, direction, round(vol,6) AS volume FROM r2 WHERE eb >= 3 AND vol > vb + 2.0*vs"),
    "n8_burst_fee": (
        lambda s, d: _round(_fee(s, d), "ratio"),
        LEDGER + ", x AS (SELECT *, CAST(value AS DOUBLE)/1e15 AS fee FROM l), y AS (SELECT *, avg(fee) OVER w AS nw, avg(fee) OVER p AS ps, count(fee) OVER p AS n FROM x WINDOW w AS (PARTITION BY address ORDER BY epoch_us(timestamp) RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW), p AS (PARTITION BY address ORDER BY timestamp, hash, direction ROWS BETWEEN 100 PRECEDING AND 1 PRECEDING)) SELECT address, hash, direction, round(nw/ps,6) AS ratio FROM y WHERE n >= 5 AND nw > 1.5*ps",
    ),
    "n9_burst_counterparty": (lambda s, d: _round(N.burst_counterparty(_t(s, d), 86400, 2.0), "ratio"), LEDGER + _rates(86400) + "SELECT address, hash, direction, round(partners/pb,6) AS ratio FROM r2 WHERE eb >= 3 AND partners > 2.0*pb"),
    "n10_burst_crosschain": (
        lambda s, d: N.burst_crosschain(_calls(s, d), 86400, 1.5, 1.0).select("address", "most", "events", F.expr("array_join(transform(map_entries(destinations), x -> concat(x.key, ':', x.value)), ',')").alias("destinations")),
        "WITH x AS (SELECT concat('U',lpad(CAST(user_id AS VARCHAR),6,'0')) AS address, ts, event_id%5 AS dst FROM events WHERE event_type='click'), y AS (SELECT *, count(*) OVER (PARTITION BY address ORDER BY epoch_us(ts) RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) AS n FROM x), z AS (SELECT *, avg(n) OVER (PARTITION BY address ORDER BY epoch_us(ts) RANGE BETWEEN UNBOUNDED PRECEDING AND 86400000001 PRECEDING) AS p FROM y), "
        "h AS (SELECT address, max(n) AS most, count(*) AS events FROM z WHERE CASE WHEN p IS NULL THEN n > 1 ELSE n > 1.5*p END GROUP BY 1), w AS (SELECT address, string_agg(concat(dst,':',c), ',' ORDER BY dst) AS destinations FROM (SELECT address, dst, count(*) AS c FROM x GROUP BY 1,2) GROUP BY 1) SELECT * FROM h JOIN w USING (address)",
    ),
    "n11_aggregate_bursts": (
        lambda s, d: _round(N.aggregate_bursts(_bursts(s, d)), "confidence"),
        LEDGER + ", g AS (SELECT address, epoch_us(detected_at)//3600000000 AS \"window\", count(*) AS bursts, count(DISTINCT pattern_type) AS kinds, least(CAST(0.95 AS DOUBLE), avg(confidence)*1.5) AS c, avg(CASE severity WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 ELSE 4 END) AS s FROM det GROUP BY 1,2) SELECT address, \"window\", bursts, kinds, round(c,6) AS confidence, CASE WHEN s >= 3.5 THEN 'critical' WHEN s >= 2.5 THEN 'high' WHEN s >= 1.5 THEN 'medium' ELSE 'low' END AS severity FROM g",
    ),
    "n12_dormancy": (
        lambda s, d: _round(N.dormancy(_t(s, d), _as_of(s, d), [(7, "deep"), (3, "moderate"), (1, "light")]).withColumn("mean_amount", F.col("mean_amount") + 1e-8), "mean_amount", "dormant_days"),
        LEDGER + f", g AS (SELECT address, count(*) AS n, avg({X}) AS mean, count(DISTINCT CAST(timestamp AS DATE)) AS active_days, ((SELECT epoch_us(as_of) FROM latest_)-epoch_us(max(timestamp)))/1000000.0/86400 AS dd FROM l GROUP BY 1) SELECT address, n, round(mean+1e-8,6) AS mean_amount, active_days, round(dd,6) AS dormant_days, CASE WHEN dd >= 7 THEN 'deep' WHEN dd >= 3 THEN 'moderate' WHEN dd >= 1 THEN 'light' ELSE 'active' END AS level FROM g",
    ),
    "n13_awakening": (
        lambda s, d: _round_scaled(N.awakening(_t(s, d), 2.0).withColumn("mean_gap", F.col("mean_gap") + 1e-6), "sent", "received", "dormant_days", "volume_factor", "mean_gap", "confidence", n=4),
        LEDGER + f""", x AS (SELECT *, {X} AS x, (epoch_us(timestamp)-epoch_us(lag(timestamp) OVER o))/1000000.0 AS gap FROM l WINDOW o AS (PARTITION BY address ORDER BY timestamp, hash, direction)),
 s AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 172800 THEN 1 ELSE 0 END) OVER (PARTITION BY address ORDER BY timestamp, hash, direction ROWS UNBOUNDED PRECEDING) AS ss FROM x),
 g AS (SELECT address, CAST(ss AS BIGINT) AS session, count(*) AS n, sum(CASE WHEN direction='out' THEN x ELSE 0 END) AS sent, sum(CASE WHEN direction='in' THEN x ELSE 0 END) AS received, count(DISTINCT other) FILTER (WHERE direction='out') AS destinations, first(gap ORDER BY timestamp, hash, direction) AS g0, sum(gap) AS gs FROM s GROUP BY 1,2),
 p AS (SELECT *, sent+received AS al, sum(sent+received) OVER w / sum(n) OVER w AS past FROM g WINDOW w AS (PARTITION BY address ORDER BY session ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 f AS (SELECT *, al/n/past AS vf, CASE WHEN n > 1 THEN (gs-g0)/(n-1) END AS mg FROM p WHERE session > 1)
 SELECT address, session, n, round(sent,4) AS sent, round(received,4) AS received, destinations, round(g0/86400,4) AS dormant_days, CASE WHEN sent > 0.8*al AND destinations <= 2 THEN 'liquidation' WHEN destinations >= 3 THEN 'distribution' WHEN received > sent THEN 'consolidation' ELSE 'testing' END AS kind, round(vf,4) AS volume_factor, round(mg+1e-6,4) AS mean_gap, round(CAST(0.5 + CASE WHEN vf > 1 THEN 0.2 ELSE 0 END + CASE WHEN mg < 60 THEN 0.2 ELSE 0 END AS DOUBLE),4) AS confidence FROM f""",
    ),
    "n14_destination_profile": (
        lambda s, d: N.destination_profile(_t(s, d), L.accounts(s, d), 30),
        LEDGER + ", x AS (SELECT from_address, to_address, min(timestamp) AS f FROM t GROUP BY 1,2), g AS (SELECT from_address AS address, count(*) AS destinations, count(*) FILTER (WHERE node_type='exchange') AS exchanges, count(*) FILTER (WHERE node_type='mixer') AS mixers, count(*) FILTER (WHERE (epoch_us(f)-epoch_us(created_at))/1000000.0/86400 < 30) AS new, count(*) FILTER (WHERE risk_score > 70) AS high_risk FROM x LEFT JOIN a ON a.address = to_address GROUP BY 1) SELECT *, exchanges+mixers+new+high_risk > 3 AS flag FROM g",
    ),
    "n15_circles": (
        lambda s, d: _round(N.consolidate_circles(G.circular_flows(_edges(s, d), L.seeds(s, d), 5)), "confidence"),
        REC + CYCLES.format(first=SEEDED, cond="", depth=5, grow="") + "SELECT seed AS address, count(*) AS cycles, round(max(least(CAST(0.95 AS DOUBLE), 0.7+0.05*(hops-2)+CASE WHEN CAST(bottleneck AS DOUBLE)/1e12 > 1 THEN log10(CAST(bottleneck AS DOUBLE)/1e12)/20 ELSE 0 END)),6) AS confidence FROM cy WHERE closed GROUP BY 1",
    ),
    "n16_split_merge": (
        _splits,
        LEDGER + ", s AS (SELECT t1.from_address AS o, t2.to_address AS dst, t1.to_address AS via, t1.hash AS h1, t2.hash AS h2, t1.value AS v1, t2.value AS v2 FROM t t1 JOIN t t2 ON t1.to_address = t2.from_address AND epoch_us(t2.timestamp) > epoch_us(t1.timestamp) AND epoch_us(t2.timestamp) - epoch_us(t1.timestamp) <= 604800000000 WHERE t1.success AND t2.success AND t1.from_address <> t2.to_address AND t1.from_address <> t1.to_address AND t1.to_address <> t2.to_address), "
        "lg AS (SELECT DISTINCT o, dst, via, 1 AS leg, h1 AS h, v1 AS v FROM s UNION SELECT DISTINCT o, dst, via, 2, h2, v2 FROM s), g AS (SELECT o AS origin, dst AS destination, count(DISTINCT via) AS vias, sum(CAST(v AS DOUBLE)/1e12) FILTER (WHERE leg = 1) AS sent, sum(CAST(v AS DOUBLE)/1e12) FILTER (WHERE leg = 2) AS merged FROM lg GROUP BY 1,2) SELECT origin, destination, vias, round(sent,6) AS sent, round(merged,6) AS merged FROM g WHERE vias >= 2 AND abs(sent-merged) <= 0.5*sent",
    ),
    "n17_similar_addresses": (
        _similar,
        LEDGER + f", f AS (SELECT x.address AS seed, y.address AS other, 1 - ({DIFF('in_degree')} + {DIFF('out_degree')} + {DIFF('total_volume_in')} + {DIFF('total_volume_out')})/4 AS sim FROM m x JOIN seeds ON seeds.address = x.address JOIN m y ON x.address <> y.address) SELECT seed, other, round(sim,6) AS similarity FROM f WHERE sim >= 0.85",
    ),
    "n18_timed_circles": (
        lambda s, d: _round(N.timed_circles(W.periodic_pairs(_t(s, d), 1.0)).select("from_address", "to_address", "n", "confidence"), "confidence"),
        LEDGER + ", g AS (SELECT *, (epoch_us(timestamp) - epoch_us(lag(timestamp) OVER (PARTITION BY from_address, to_address ORDER BY timestamp, hash)))/1000000.0 AS gap FROM t) SELECT from_address, to_address, count(*) AS n, round(least(CAST(0.9 AS DOUBLE), 0.5 + count(*)/20),6) AS confidence FROM g GROUP BY 1,2 HAVING count(*) >= 3 AND stddev_samp(gap) < avg(gap)",
    ),
    "n19_account_clusters": (lambda s, d: N.account_clusters(N.account_features(A.transfer_statistics(_t(s, d))), ["f1", "f2", "f3", "f4"]), None),
    "n20_reconstruction": (lambda s, d: N.reconstruction_outliers(N.account_features(A.transfer_statistics(_t(s, d))), ["f1", "f2", "f3", "f4"]), None),
}
