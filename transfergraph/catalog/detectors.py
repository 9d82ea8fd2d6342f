from pyspark.sql import functions as F

from ..operators import detectors as D
from ..operators import paths as G
from ..sources import ledger as L
from .base import LEDGER
from .filters import _as_of, _edges
from .graph import CYCLES, REC, SEEDED
from .joins import SEQUENCE, _metrics
from .windows import _round

_t = L.transfers
RAPID = "least(0.9, 0.7*(1 + CASE WHEN avg(seconds)/60 > 0 THEN least(1.0, 10/(avg(seconds)/60)) ELSE 1 END*0.3))"
CHAINS = """, lc AS (SELECT from_address AS seed, to_address AS fin, [from_address,to_address] AS path, total_volume AS fv, total_volume AS lv, 1 AS hops FROM e {first} WHERE from_address <> to_address AND total_volume >= 1000000000000
 UNION ALL SELECT seed, e.to_address, list_append(path, e.to_address), fv, e.total_volume, hops+1 FROM lc JOIN e ON e.from_address = fin WHERE hops < {depth} AND e.from_address <> e.to_address AND e.total_volume >= 1000000000000 AND abs(CAST(e.total_volume AS DOUBLE)-CAST(lv AS DOUBLE)) <= {tol}*CAST(lv AS DOUBLE) AND NOT list_contains(path, e.to_address))"""
MIX = ", rk AS (SELECT ue.address, count(DISTINCT other) AS risky, count(DISTINCT other) FILTER (WHERE risk_score > 70) AS high_risk, count(DISTINCT other) FILTER (WHERE node_type='mixer') AS mixers FROM ue JOIN m ON m.address = other WHERE degree > 100 OR risk_score > 70 OR node_type IN ('mixer','exchange') GROUP BY 1), nb AS (SELECT address, count(DISTINCT other) AS neighbours FROM ue GROUP BY 1), mx AS (SELECT *, least(1.0, 0.9*risky/neighbours + least(0.3,0.1*high_risk) + least(0.3,0.15*mixers)) AS confidence FROM rk JOIN nb USING (address))"
NIGHT = "(hour(timestamp) >= 22 OR hour(timestamp) <= 6)"
TIMING = f", ut AS (SELECT *, least(0.8, 0.4 + CASE WHEN night/n > 0.3 THEN 0.25 ELSE 0 END + CASE WHEN weekend/n > 0.4 THEN 0.25 ELSE 0 END) AS confidence FROM (SELECT address, count(*) AS n, count(*) FILTER (WHERE {NIGHT}) AS night, count(*) FILTER (WHERE dayofweek(timestamp) IN (0,6)) AS weekend FROM l WHERE success GROUP BY 1 HAVING count(*) >= 5) WHERE night/n > 0.3 OR weekend/n > 0.4)"
ROUND = """, rn AS (SELECT *, least(0.7, 0.4 + CASE WHEN (perfect+half_round)/n > 1.0/3 THEN 0.2 ELSE 0 END + CASE WHEN perfect > 0 THEN 0.1 ELSE 0 END) AS confidence FROM (SELECT address, count(*) AS n, count(*) FILTER (WHERE regexp_matches(v,'^[1-9]0{3,}$')) AS perfect, count(*) FILTER (WHERE regexp_matches(v,'^[1-9][05]0{2,}$') AND NOT regexp_matches(v,'^[1-9]0{3,}$')) AS half_round,
 count(*) FILTER (WHERE z >= 12) AS zeros, max(z) AS most_zeros FROM (SELECT *, CAST(value AS VARCHAR) AS v, length(CAST(value AS VARCHAR)) - length(rtrim(CAST(value AS VARCHAR),'0')) AS z FROM l WHERE success) GROUP BY 1) WHERE perfect+half_round+zeros >= 3)"""
NOW = "(SELECT as_of FROM latest_)"


def _chains(s, d):
    return G.layering_chains(_edges(s, d), None, 10**12, 0.05, 3)


def _large_sender(transfers, edges):
    """A detector as a user adds one: senders of a transfer of 300 units or more."""
    return transfers.where(F.col("value") >= 300 * 10**12).select(F.col("from_address").alias("address"), F.lit(0.5).alias("confidence"))


#: The thresholds of the single queries, at which the tables have something to find.
OPTIONS = {
    "round_numbers": {"min_zeros": 11}, "rapid_same_sender": {"window_seconds": 86400}, "round_unit_share": {"more_than": 0}, "burst_counterparties": {"window_hours": 72, "min_transfers": 3, "min_partners": 2, "min_bucket": 1},
    "splitting_layers": {"gap_seconds": 86400, "layers": 2}, "unusual_volume": {"multiple": 1.0}, "rapid_dispersion": {"blocks": 2000, "min_recipients": 3},
}


def _all(s, d):
    """Cycles of up to five accounts and chains of up to eight from the seeds, everything else over all accounts."""
    return D.detect_all(_t(s, d), _edges(s, d), _metrics(s, d), L.seeds(s, d), _as_of(s, d), OPTIONS)


def _registered(s, d):
    D.register_detector("large_sender", _large_sender)
    try:
        return _all(s, d).where("pattern_type = 'large_sender'")
    finally:
        D.unregister_detector("large_sender")


QUERIES = {
    "x1_registered_detector": (_registered, LEDGER + "SELECT DISTINCT from_address AS address, 'large_sender' AS pattern_type, CAST(0.5 AS DOUBLE) AS confidence FROM t WHERE value >= 300000000000000"),
    "d1_rapid_movement": (
        lambda s, d: _round(D.rapid_movement(_t(s, d)), "mean_minutes", "confidence"),
        LEDGER + SEQUENCE + f"SELECT to1 AS address, count(*) AS pairs, round(avg(seconds)/60,6) AS mean_minutes, CAST(sum(value1) AS DECIMAL(38,0)) AS volume, round({RAPID},6) AS confidence FROM seq GROUP BY 1",
    ),
    "d2_circular_flow": (
        lambda s, d: _round(D.circular_flow(_edges(s, d), L.seeds(s, d), 5), "mean_length", "confidence"),
        REC + CYCLES.format(first=SEEDED, cond="", depth=5, grow="") + "SELECT seed AS address, count(*) AS cycles, round(avg(hops),6) AS mean_length, max(bottleneck) AS best_bottleneck, count(*) FILTER (WHERE hops = 2) AS direct, round(least(0.95, 0.8*(1+0.2*2/avg(hops))),6) AS confidence FROM cy WHERE closed GROUP BY 1",
    ),
    "d3_layering": (
        lambda s, d: _round(D.layering(_edges(s, d), L.seeds(s, d), 10**12, 0.2, 8), "ratio", "confidence"),
        REC + CHAINS.format(first=SEEDED, depth=8, tol=0.2) + ', g AS (SELECT seed AS address, fin AS "end", count(*) AS chains, max(hops) AS longest, avg(CAST(lv AS DOUBLE)/CAST(fv AS DOUBLE)) AS ratio FROM lc WHERE hops >= 3 GROUP BY 1,2 HAVING count(*) >= 2) SELECT address, "end", chains, longest, round(ratio,6) AS ratio, round(least(0.9, 0.6 + CASE WHEN longest >= 4 THEN 0.1 ELSE 0 END + 0.2*greatest(0.0, 1-abs(1-ratio))),6) AS confidence FROM g',
    ),
    "d4_mixing": (lambda s, d: _round(D.mixing(_edges(s, d), _metrics(s, d)), "confidence"), LEDGER + MIX + "SELECT address, risky, high_risk, mixers, neighbours, round(confidence,6) AS confidence FROM mx"),
    "d5_unusual_timing": (lambda s, d: _round(D.unusual_timing(_t(s, d)), "confidence"), LEDGER + TIMING + "SELECT address, n, night, weekend, round(CAST(confidence AS DOUBLE),6) AS confidence FROM ut"),
    "d6_round_numbers": (lambda s, d: _round(D.round_numbers(_t(s, d), 11, 3), "confidence"), LEDGER + ROUND.replace("z >= 12", "z >= 11") + "SELECT address, n, perfect, half_round, zeros, most_zeros, round(CAST(confidence AS DOUBLE),6) AS confidence FROM rn"),
    "d7_behaviour_summary": (
        lambda s, d: _round(D.behaviour_summary(_t(s, d)), "amount_uniformity", "gap_uniformity", "partner_ratio", "per_day", "confidence"),
        LEDGER + """, x AS (SELECT *, CAST(value AS DOUBLE)/1e12 AS x, (epoch_us(timestamp) - epoch_us(lag(timestamp) OVER (PARTITION BY address ORDER BY timestamp, hash, direction)))/1000000.0 AS gap FROM l),
 g AS (SELECT address, count(*) AS n, CASE WHEN avg(x) <> 0 THEN greatest(0, 1-stddev_pop(x)/avg(x)) ELSE 0 END AS au, CASE WHEN coalesce(avg(gap),0) <> 0 THEN greatest(0, 1-stddev_pop(gap)/avg(gap)) ELSE 0 END AS gu, max(x) > 10*avg(x) AS spike, count(DISTINCT other)/count(*) AS pr, count(*)/greatest(1.0,(epoch_us(max(timestamp))-epoch_us(min(timestamp)))/1000000.0/86400) AS pd FROM x GROUP BY 1)
 SELECT address, n, round(au,6) AS amount_uniformity, round(gu,6) AS gap_uniformity, spike, round(pr,6) AS partner_ratio, round(pd,6) AS per_day, round(CAST(CASE WHEN au > 0.8 THEN 0.3 ELSE 0 END + CASE WHEN gu > 0.8 THEN 0.3 ELSE 0 END + CASE WHEN pr < 0.1 THEN 0.2 ELSE 0 END + CASE WHEN pd > 50 THEN 0.2 ELSE 0 END AS DOUBLE),6) AS confidence FROM g""",
    ),
    "d8_rapid_same_sender": (
        lambda s, d: D.rapid_same_sender(_t(s, d), 86400, 3).select("hash", "from_address", "nearby"),
        LEDGER + ", x AS (SELECT *, count(*) OVER (PARTITION BY from_address ORDER BY epoch_us(timestamp) RANGE BETWEEN 86400000000 PRECEDING AND 86400000000 FOLLOWING) - 1 AS nearby FROM t), y AS (SELECT *, row_number() OVER (PARTITION BY from_address ORDER BY timestamp DESC, hash) AS rn FROM x WHERE nearby >= 3) SELECT hash, from_address, nearby FROM y WHERE rn <= 10",
    ),
    "d9_round_unit_share": (
        lambda s, d: _round(D.round_unit_share(_t(s, d), 0), "share"),
        LEDGER + "SELECT address, count(*) AS n, " + ", ".join(f"count(*) FILTER (WHERE value % {k}000000000000 = 0) AS by_{k}" for k in (1, 10, 100)) + ", round(count(*) FILTER (WHERE value % 1000000000000 = 0)/count(*),6) AS share, count(*) FILTER (WHERE value % 1000000000000 = 0) > 0 AS flag FROM l GROUP BY 1",
    ),
    "d10_risk_assessment": (
        lambda s, d: _round(D.risk_assessment(L.detections(s, d)), "risk", n=4),
        LEDGER + ", g AS (SELECT address, count(*) AS detections, least(100.0, sum(CASE severity WHEN 'critical' THEN 30 WHEN 'high' THEN 20 WHEN 'medium' THEN 10 ELSE 5 END*confidence)) AS r FROM det GROUP BY 1) SELECT address, detections, round(r,4) AS risk, CASE WHEN r >= 70 THEN 'flag_for_review' WHEN r >= 40 THEN 'investigate' ELSE 'monitor' END AS action FROM g",
    ),
    "d11_burst_counterparties": (
        lambda s, d: _round(D.burst_counterparties(_t(s, d), _as_of(s, d), 72, 3, 2, 1), "severity"),
        LEDGER + f", x AS (SELECT * FROM l WHERE timestamp > {NOW} - INTERVAL 72 HOUR), b AS (SELECT address, max(n) AS busiest FROM (SELECT address, epoch_us(timestamp)//300000000 AS k, count(*) AS n FROM x GROUP BY 1,2) GROUP BY 1), g AS (SELECT address, count(*) AS n, count(DISTINCT other) AS partners FROM x GROUP BY 1) SELECT address, n, partners, busiest, round(20*log10(n)+30*log10(partners),6) AS severity FROM g JOIN b USING (address) WHERE n >= 3 AND partners >= 2",
    ),
    "d12_splitting_layers": (
        lambda s, d: D.splitting_layers(_t(s, d), 100, 86400, 2, 2),
        LEDGER + ", r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY from_address ORDER BY timestamp DESC, hash) AS rn FROM t) WHERE rn <= 100), s AS (SELECT *, sum(CASE WHEN p IS NULL OR epoch_us(timestamp)-p > 86400000000 THEN 1 ELSE 0 END) OVER (PARTITION BY from_address ORDER BY timestamp, hash ROWS UNBOUNDED PRECEDING) AS ss FROM (SELECT *, epoch_us(lag(timestamp) OVER (PARTITION BY from_address ORDER BY timestamp, hash)) AS p FROM r)), "
        "g AS (SELECT from_address, ss, count(*) AS n, avg(CAST(value AS DOUBLE)/1e12) AS m, var_pop(CAST(value AS DOUBLE)/1e12) AS v FROM s GROUP BY 1,2) SELECT from_address AS address, count(*) AS layers, CAST(sum(n) AS BIGINT) AS transfers FROM g WHERE n >= 2 AND v < m*m/4 GROUP BY 1 HAVING count(*) >= 2",
    ),
    "d13_mixer_behaviour": (
        lambda s, d: D.mixer_behaviour(_t(s, d)),
        LEDGER + ", v AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY address, direction ORDER BY timestamp DESC, hash) AS rn FROM l) WHERE rn <= 50), b AS (SELECT address, count(*) FILTER (WHERE direction='in') AS n_in, count(*) FILTER (WHERE direction='out') AS n_out FROM v GROUP BY 1), sm AS (SELECT address, max(n) AS repeats FROM (SELECT address, value, count(*) AS n FROM v GROUP BY 1,2) GROUP BY 1), "
        "hr AS (SELECT address, max(n) AS busiest_hour FROM (SELECT address, epoch_us(timestamp)//3600000000 AS h, count(*) AS n FROM v GROUP BY 1,2) GROUP BY 1) SELECT address, n_in, n_out, repeats, busiest_hour, repeats >= 3 OR busiest_hour >= 10 AS flag FROM b JOIN sm USING (address) JOIN hr USING (address) WHERE n_in >= 5 AND n_out >= 5",
    ),
    "d14_unusual_volume": (
        lambda s, d: _round(D.unusual_volume(_t(s, d), _as_of(s, d), 1.0), "ratio"),
        LEDGER + f", n AS (SELECT address, sum(CAST(value AS DOUBLE)) AS recent FROM l WHERE timestamp > {NOW} - INTERVAL 1 DAY GROUP BY 1), r AS (SELECT *, row_number() OVER (PARTITION BY address ORDER BY day DESC) AS rn FROM (SELECT address, CAST(timestamp AS DATE) AS day, sum(value) AS v FROM l GROUP BY 1,2)), b AS (SELECT address, avg(CAST(v AS DOUBLE)) AS average FROM r WHERE rn <= 30 GROUP BY 1) SELECT address, round(recent/average,6) AS ratio FROM n JOIN b USING (address) WHERE recent/average >= 1.0",
    ),
    "d15_pattern_risk": (
        lambda s, d: _round(D.pattern_risk(L.detections(s, d), {"error": 0.3, "view": 0.25, "signup": 0.25, "click": 0.35}), "risk", n=4),
        LEDGER + ", x AS (SELECT address, CASE pattern_type WHEN 'error' THEN 0.3 WHEN 'view' THEN 0.25 WHEN 'signup' THEN 0.25 WHEN 'click' THEN 0.35 ELSE 0.2 END AS w, CASE severity WHEN 'critical' THEN 100 WHEN 'high' THEN 75 WHEN 'medium' THEN 50 ELSE 25 END*confidence AS x FROM det) SELECT address, round(sum(CAST(w AS DOUBLE)*x)/sum(CAST(w AS DOUBLE)),4) AS risk FROM x GROUP BY 1",
    ),
    "d16_rapid_dispersion": (
        lambda s, d: _round(D.rapid_dispersion(_t(s, d), 2000, 3), "confidence"),
        LEDGER + "SELECT t1.hash AS source, t1.from_address AS origin, t1.to_address AS hub, count(DISTINCT t2.to_address) AS recipients, round(least(1.0, 0.5 + count(DISTINCT t2.to_address)/20),6) AS confidence FROM t t1 JOIN t t2 ON t2.from_address = t1.to_address AND t2.block_number > t1.block_number AND t2.block_number <= t1.block_number + 2000 GROUP BY 1,2,3 HAVING count(DISTINCT t2.to_address) >= 3",
    ),
    "d16_dispersion_buckets": (
        lambda s, d: D.dispersion_buckets(_t(s, d), 1000, 2),
        LEDGER + "SELECT from_address, block_number//1000*1000 AS bucket, count(DISTINCT to_address) AS recipients FROM t GROUP BY 1,2 HAVING count(DISTINCT to_address) > 2",
    ),
    "d17_validate_layering": (
        lambda s, d: _round(D.validate_layering(_t(s, d), _chains(s, d)).select("seed", "end", "hops", F.expr("array_join(path,'->')").alias("path"), "step_ratio", "steady"), "step_ratio"),
        REC + CHAINS.format(first="", depth=3, tol=0.05) + ", x AS (SELECT *, pow(CAST(lv AS DOUBLE)/CAST(fv AS DOUBLE), 1.0/hops) AS r FROM lc WHERE hops >= 3) SELECT seed, fin AS \"end\", hops, array_to_string(path,'->') AS path, round(r,6) AS step_ratio, abs(r-1) < 0.05 AS steady FROM x",
    ),
    "d18_validate_mixer": (
        lambda s, d: _round(D.validate_mixer(_t(s, d)), "uniformity", "recipient_ratio"),
        LEDGER + ", g AS (SELECT from_address AS address, count(*) AS n, CASE WHEN avg(CAST(value AS DOUBLE)) > 0 THEN greatest(0, 1-stddev_pop(CAST(value AS DOUBLE))/avg(CAST(value AS DOUBLE))) ELSE 0 END AS u, count(DISTINCT to_address)/count(*) AS r FROM t GROUP BY 1) SELECT address, n, round(u,6) AS uniformity, round(r,6) AS recipient_ratio, u > 0.7 AND r > 0.9 AS valid FROM g",
    ),
}


def _inner(name):
    """A query's SQL as a subquery beside the ledger's tables."""
    sql = QUERIES[name][1].replace("round(20*log10(n)+30*log10(partners),6)", "20*log10(n)+30*log10(partners)")
    body = sql[len(REC if sql.startswith(REC) else LEDGER) :]
    return f"(WITH RECURSIVE {body[2:]})" if body.startswith(", ") else f"({body})"


#: Pattern, query, and how its columns give the confidence.
PARTS = [
    ("rapid_movement", "d1_rapid_movement", "confidence"), ("circular_flow", "d2_circular_flow", "confidence"), ("layering", "d3_layering", "confidence"), ("mixing", "d4_mixing", "confidence"), ("unusual_timing", "d5_unusual_timing", "confidence"),
    ("round_numbers", "d6_round_numbers", "confidence"), ("behaviour", "d7_behaviour_summary", "nullif(confidence, 0)"), ("rapid_same_sender", "d8_rapid_same_sender", "0.6"), ("round_unit_share", "d9_round_unit_share", "CASE WHEN flag THEN share END"),
    ("burst_counterparties", "d11_burst_counterparties", "least(1.0, severity/100)"), ("splitting_layers", "d12_splitting_layers", "0.7"), ("mixer_behaviour", "d13_mixer_behaviour", "CASE WHEN flag THEN 0.7 END"), ("unusual_volume", "d14_unusual_volume", "0.6"),
    ("rapid_dispersion", "d16_rapid_dispersion", "confidence"),
]
ADDRESS = {"rapid_same_sender": "from_address", "rapid_dispersion": "hub"}
QUERIES["d19_detect_all"] = (
    lambda s, d: _round(_all(s, d), "confidence"),
    REC + " SELECT * FROM (" + " UNION ALL ".join(f"SELECT {ADDRESS.get(k, 'address')} AS address, '{k}' AS pattern_type, round(CAST(max({c}) AS DOUBLE),6) AS confidence FROM {_inner(q)} GROUP BY 1" for k, q, c in PARTS) + ") WHERE confidence IS NOT NULL",
)
