from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import metrics as M
from ..operators import scoring as R
from ..operators import topk as O
from ..plans.cut import drop, materialise
from ..sources import ledger as L
from .base import LEDGER
from .filters import _as_of, _edges
from .graph import pagerank_sql
from .joins import HOPS, _metrics
from .windows import _round

_t = L.transfers


def _volume(s, d):
    return R.volume_score(_edges(s, d), L.accounts(s, d))


def _frequency(s, d):
    return R.frequency_score(_edges(s, d), _t(s, d))


def _network(s, d):
    e = _edges(s, d)
    return R.network_score(e, M.degree_centrality(e), M.pagerank(e, 3))


def _strength_of_edges(s, d):
    """The scores of every edge with its count and volume: transfers are folded twice, into edges for the network and into what the other scores take, and no more."""
    t = materialise(_t(s, d))
    a = materialise(L.accounts(s, d).select("address", "balance", "created_at"))
    e = materialise(A.build_edges(t))
    facts = materialise(R.edge_facts(t, a, t.agg(F.max("timestamp").alias("as_of"))))
    drop(t)
    network = R.network_score(e, M.degree_centrality(e), M.pagerank(e, 3))
    out = materialise(R.strength_of_facts(facts, a, network))
    for x in (a, e, facts):
        drop(x)
    return out


def _strength(s, d):
    return _strength_of_edges(s, d).drop("transfer_count", "total_volume")


def _distribution(s, d):
    out = R.score_distribution(_strength_of_edges(s, d))
    return _round(out.withColumn("mean_volume", F.col("mean_volume") / 1e12), "mean_score", "mean_transfers", "mean_volume", n=4)


NOW = "(SELECT epoch_us(as_of) FROM latest_)"
DAYS = "/1000000.0/86400"
SCORES = (
    LEDGER + HOPS + pagerank_sql(3)
    + f""", vs AS (SELECT from_address, to_address, least(100.0, 40*(rank() OVER (ORDER BY v)-1)/count(*) OVER () + 30*(rank() OVER (ORDER BY mean)-1)/count(*) OVER () + CASE WHEN coalesce(b,0) > 0 THEN least(30.0, 100*v/b) ELSE 15 END) AS volume_score
 FROM (SELECT e.*, CAST(total_volume AS DOUBLE) AS v, CAST(total_volume AS DOUBLE)/transfer_count AS mean, CAST(balance AS DOUBLE) AS b FROM e LEFT JOIN a ON a.address = from_address)),
 fq AS (SELECT from_address, to_address, count(DISTINCT CAST(timestamp AS DATE)) AS days, greatest(1, ceil((epoch_us(max(timestamp))-epoch_us(min(timestamp))){DAYS})+1) AS active, count(*) AS n FROM t GROUP BY 1,2),
 fs AS (SELECT e.from_address, e.to_address, 40*(rank() OVER (ORDER BY transfer_count)-1)/count(*) OVER () + 30*least(1.0, n/active/10) + 30*days/active AS frequency_score FROM e JOIN fq USING (from_address, to_address)),
 tg AS (SELECT from_address, to_address, min(age) AS lst, max(age) AS fst, count(*) AS n, count(*) FILTER (WHERE age <= 7) AS w, count(*) FILTER (WHERE age <= 30) AS mo FROM (SELECT *, ({NOW}-epoch_us(timestamp)){DAYS} AS age FROM t) GROUP BY 1,2),
 ts AS (SELECT from_address, to_address, CASE WHEN lst <= 1 THEN 40 WHEN lst <= 7 THEN 35 WHEN lst <= 30 THEN 25 WHEN lst <= 90 THEN 15 WHEN lst <= 365 THEN 5 ELSE 0 END + least(30.0, (fst-lst)/365*30) + least(30.0, 15*w/n+15*mo/n) AS temporal_score FROM tg),
 cm AS (SELECT origin, destination, count(DISTINCT via) AS common FROM hop WHERE via <> origin AND via <> destination GROUP BY 1,2),
 nm AS (SELECT m.address, degree/((SELECT count(*) FROM m)-1) AS c, r AS p FROM m JOIN r3 USING (address)),
 ns AS (SELECT e.from_address, e.to_address, least(40.0, 5*coalesce(common,0)) + least(30.0, 100*(x.c+y.c)/2) + least(30.0, 1000*(x.p+y.p)/2) AS network_score FROM e LEFT JOIN cm ON origin = from_address AND destination = to_address JOIN nm x ON x.address = from_address JOIN nm y ON y.address = to_address),
 rp AS (SELECT t1.hash FROM t t1 SEMI JOIN t t2 ON t2.from_address = t1.to_address AND epoch_us(t2.timestamp) > epoch_us(t1.timestamp) AND epoch_us(t2.timestamp) <= epoch_us(t1.timestamp) + 300000000),
 rg AS (SELECT from_address, to_address, count(*) AS n, count(*) FILTER (WHERE hash IN (FROM rp)) AS rr, count(*) FILTER (WHERE value % 1000000000000 = 0) AS ro, count(*) FILTER (WHERE hour(timestamp) BETWEEN 2 AND 5) AS rh, min(timestamp) AS fst FROM t GROUP BY 1,2),
 rs AS (SELECT from_address, to_address, least(30.0,100*rr/n) + least(25.0,50*ro/n) + least(25.0,50*rh/n) + CASE WHEN (epoch_us(fst)-epoch_us(created_at)){DAYS} < 7 THEN 20 ELSE 0 END AS risk_score FROM rg LEFT JOIN a ON a.address = to_address),
 sc AS (SELECT *, 0.25*volume_score+0.25*frequency_score+0.2*temporal_score+0.3*network_score AS base FROM vs JOIN fs USING (from_address,to_address) JOIN ts USING (from_address,to_address) JOIN ns USING (from_address,to_address) JOIN rs USING (from_address,to_address)),
 st AS (SELECT *, round(base*(1-risk_score/200),2) AS strength FROM sc)
"""
)

BANDS = "CASE WHEN strength >= 80 THEN 'very strong' WHEN strength >= 60 THEN 'strong' WHEN strength >= 40 THEN 'moderate' WHEN strength >= 20 THEN 'weak' ELSE 'very weak' END"
QCOLS = ", ".join(f"quantile_cont(CAST(total_volume AS DOUBLE), {q}) AS p{round(q * 100)}" for q in (0.25, 0.5, 0.75, 0.9, 0.95, 0.99))
FACTORS = "array_to_string(list_transform(list_sort([{'s': -frequency_score, 'k': 'frequency'}, {'s': -network_score, 'k': 'network'}, {'s': -temporal_score, 'k': 'temporal'}, {'s': -volume_score, 'k': 'volume'}])[1:2], lambda x: x.k), ',')"


def _address_risk(s, d):
    e = _edges(s, d)
    return _round(R.address_risk(e, _t(s, d), _metrics(s, d), L.detections(s, d), M.degree_centrality(e)), "risk")



QUERIES = {
    "r1_volume_score": (lambda s, d: _round(_volume(s, d), "volume_score", n=4), SCORES + "SELECT from_address, to_address, round(volume_score,4) AS volume_score FROM vs"),
    "r2_frequency_score": (lambda s, d: _round(_frequency(s, d), "frequency_score", n=4), SCORES + "SELECT from_address, to_address, round(frequency_score,4) AS frequency_score FROM fs"),
    "r3_temporal_score": (lambda s, d: _round(R.temporal_score(_t(s, d), _as_of(s, d)), "temporal_score", n=4), SCORES + "SELECT from_address, to_address, round(temporal_score,4) AS temporal_score FROM ts"),
    "r3_temporal_decay": (
        lambda s, d: _round(R.temporal_decay_score(_t(s, d), _as_of(s, d)), "temporal_score", n=4),
        SCORES + "SELECT from_address, to_address, round(40*exp(-lst/30) + least(30.0,(fst-lst)/10) + least(30.0,15*w/n+15*mo/n),4) AS temporal_score FROM tg",
    ),
    "r4_network_score": (lambda s, d: _round(_network(s, d), "network_score", n=4), SCORES + "SELECT from_address, to_address, round(network_score,4) AS network_score FROM ns"),
    "r5_risk_score": (lambda s, d: _round(R.risk_score(_t(s, d), L.accounts(s, d)), "risk_score", n=4), SCORES + "SELECT from_address, to_address, round(risk_score,4) AS risk_score FROM rs"),
    "r6_strength": (
        lambda s, d: _round(_strength(s, d).select("from_address", "to_address", F.round("strength", 1).alias("strength"), "adjusted"), "adjusted", n=3),
        SCORES + "SELECT from_address, to_address, round(strength,1) AS strength, round(greatest(0.0, base-0.5*risk_score),3) AS adjusted FROM st",
    ),
    "r7_interpret": (lambda s, d: R.interpret_score(_strength(s, d)).select("from_address", "to_address", "interpretation"), SCORES + f"SELECT from_address, to_address, {BANDS} AS interpretation FROM st"),
    "r8_primary_factors": (lambda s, d: R.primary_factors(_strength(s, d)).select("from_address", "to_address", "factors"), SCORES + f"SELECT from_address, to_address, {FACTORS} AS factors FROM st"),
    "r9_bulk_scores": (
        lambda s, d: R.bulk_scores(_strength(s, d), _edges(s, d).where("transfer_count > 1")).select("from_address", "to_address", "strength"),
        SCORES + "SELECT from_address, to_address, strength FROM st SEMI JOIN (SELECT * FROM e WHERE transfer_count > 1) USING (from_address, to_address)",
    ),
    "a9_score_distribution": (
        _distribution,
        SCORES + f"SELECT {BANDS} AS interpretation, count(*) AS n, round(avg(strength),4) AS mean_score, round(avg(transfer_count),4) AS mean_transfers, round(avg(CAST(total_volume AS DOUBLE))/1e12,4) AS mean_volume FROM st JOIN e USING (from_address, to_address) GROUP BY 1",
    ),
    "o2_top_relationships": (
        lambda s, d: O.top_relationships(_strength(s, d), 100, 10).select("from_address", "to_address", "strength"),
        SCORES + "SELECT from_address, to_address, strength FROM st WHERE strength >= 10 ORDER BY strength DESC, from_address, to_address LIMIT 100",
    ),
    "o3_suspicious": (lambda s, d: O.suspicious_relationships(_strength(s, d), 40, 10).select("from_address", "to_address"), SCORES + "SELECT from_address, to_address FROM st WHERE volume_score >= 40 AND risk_score >= 10"),
    "r10_step_percentile": (
        lambda s, d: R.step_percentile_score(_edges(s, d), A.volume_quantiles(_edges(s, d))),
        LEDGER + f", q AS (SELECT {QCOLS} FROM e), x AS (SELECT e.*, q.*, CAST(total_volume AS DOUBLE) AS v FROM e, q) SELECT from_address, to_address, CASE WHEN v >= p99 THEN 100 WHEN v >= p95 THEN 95 WHEN v >= p90 THEN 85 WHEN v >= p75 THEN 70 WHEN v >= p50 THEN 50 WHEN v >= p25 THEN 30 ELSE 10 END AS score, "
        "CASE WHEN v >= p99 THEN 'top 1%' WHEN v >= p95 THEN 'top 5%' WHEN v >= p90 THEN 'top 10%' WHEN v >= p75 THEN 'top 25%' WHEN v >= p50 THEN 'top 50%' WHEN v >= p25 THEN 'top 75%' ELSE 'bottom 25%' END AS percentile FROM x",
    ),
    "r11_quick_score": (
        lambda s, d: _round(R.quick_relationship_score(_edges(s, d), _as_of(s, d)), "score", n=4),
        LEDGER + f"SELECT from_address, to_address, round(greatest(1.0, CASE WHEN total_volume > 0 THEN least(50.0, log10(CAST(total_volume AS DOUBLE)/1e12)*10) ELSE 0 END + least(30.0, 2*transfer_count) + greatest(0, 20 - floor(({NOW}-epoch_us(last_transfer_time)){DAYS}))),4) AS score FROM e",
    ),
    "r12_relative_score": (
        lambda s, d: _round(R.relative_score(_edges(s, d), _as_of(s, d)).select("from_address", "to_address", "score"), "score", n=4),
        LEDGER + f", x AS (SELECT *, ({NOW}-epoch_us(last_transfer_time)){DAYS} AS age, CAST(total_volume AS DOUBLE)/(SELECT max(CAST(total_volume AS DOUBLE)) FROM e) AS v, transfer_count/(SELECT max(transfer_count) FROM e) AS c FROM e) SELECT from_address, to_address, round(30*v + 30*c + 0.2*CASE WHEN age <= 7 THEN 100 WHEN age <= 30 THEN 70 WHEN age <= 90 THEN 40 ELSE 20 END + 10,4) AS score FROM x",
    ),
    "r13_address_risk": (
        _address_risk,
        LEDGER + ", lk AS (SELECT ue.address, count(DISTINCT other) AS n FROM ue JOIN m ON m.address = other WHERE degree > 100 OR risk_score > 70 OR node_type IN ('mixer','exchange') GROUP BY 1), op AS (SELECT address, count(*) AS n FROM det WHERE NOT reviewed AND NOT false_positive GROUP BY 1), sp AS (SELECT address, count(*)/count(DISTINCT CAST(timestamp AS DATE)) AS n FROM l GROUP BY 1), "
        "x AS (SELECT m.address, 0.4*least(1.0,coalesce(lk.n,0)/10) + 0.3*least(1.0,coalesce(op.n,0)/10) + 0.2*least(1.0,coalesce(sp.n,0)/10) + 0.1*least(1.0, degree/((SELECT count(*) FROM m)-1)) AS r FROM m LEFT JOIN lk USING (address) LEFT JOIN op USING (address) LEFT JOIN sp USING (address)) SELECT address, round(r,6) AS risk, CASE WHEN r > 0.7 THEN 'high' WHEN r > 0.4 THEN 'medium' ELSE 'low' END AS level FROM x",
    ),
}
