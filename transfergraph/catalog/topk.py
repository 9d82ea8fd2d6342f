from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import sets as U
from ..operators import topk as O
from ..sources import ledger as L
from .base import LEDGER
from .filters import ACTIVE, UNIT, _active, _edges
from .joins import _metrics


def _investigations(s, d):
    return L.events(s, d).select((F.col("user_id") % 50).alias("session_id"), F.col("ts").alias("updated_at"), F.col("event_id").alias("version"), F.col("event_type").alias("state"))


def _search(s, d):
    return O.search_accounts(_active(s, d), "name 1", 20).select("address", "rank", "total_transfers")


def _ranked(s, d):
    return O.search_ranked(_active(s, d), L.detections(s, d), "00001", 40).select("kind", "address", F.round("relevance", 6).alias("relevance"))


ACT = "least(20.0, log10(1 + total_transfers) * 5)"
QUERIES = {
    "o1_topk_per_seed": (
        lambda s, d: O.topk(U.undirected_view(_edges(s, d)), ["address"], [F.col("transfer_count").desc(), F.col("total_volume").desc(), F.col("other"), F.col("direction")], 3).select("address", "other", "direction", "transfer_count"),
        LEDGER + "SELECT address, other, direction, transfer_count FROM (SELECT *, row_number() OVER (PARTITION BY address ORDER BY transfer_count DESC, total_volume DESC, other, direction) AS rn FROM ue) WHERE rn <= 3",
    ),
    "o4_high_activity": (lambda s, d: O.high_activity_accounts(A.account_summary(L.accounts(s, d), _edges(s, d)), 25).select("address", "total_transfers"), LEDGER + "SELECT address, count(*) AS total_transfers FROM l GROUP BY 1 HAVING count(*) > 25"),
    "o5_high_degree": (lambda s, d: O.high_degree_nodes(_metrics(s, d), L.accounts(s, d), 20), LEDGER + "SELECT m.*, display, balance FROM m JOIN a USING (address) WHERE degree > 20"),
    "o6_search_accounts": (
        _search,
        ACTIVE + "SELECT address, CASE WHEN address = 'name 1' THEN 0 WHEN lower(display) = 'name 1' THEN 1 ELSE 2 END AS rank, total_transfers FROM act WHERE lower(address) LIKE '%name 1%' OR lower(display) LIKE '%name 1%' OR lower(legal) LIKE '%name 1%' ORDER BY 2, 3 DESC, 1 LIMIT 20",
    ),
    "o7_search_ranked": (
        _ranked,
        ACTIVE + f", r AS (SELECT 'address' AS kind, address, CASE WHEN lower(address)='00001' THEN 100 WHEN lower(address) LIKE '00001%' THEN 50 ELSE 25 END + CASE WHEN verified THEN 20 ELSE 0 END + {ACT} AS relevance FROM act WHERE lower(address) LIKE '%00001%' "
        f"UNION ALL SELECT 'name', address, CASE WHEN lower(display)='00001' THEN 100 WHEN lower(display) LIKE '00001%' THEN 70 WHEN lower(display) LIKE '% 00001%' THEN 50 ELSE 30 END + CASE WHEN verified THEN 25 ELSE 0 END + {ACT} - CASE WHEN risk_score > 50 THEN 10 ELSE 0 END FROM act WHERE lower(display) LIKE '%00001%' "
        "UNION ALL SELECT 'pattern', address, confidence*100 FROM det WHERE lower(address) LIKE '%00001%') SELECT kind, address, round(relevance, 6) AS relevance FROM r ORDER BY r.relevance DESC, kind, address LIMIT 40",
    ),
    "o8_suggest": (
        lambda s, d: O.suggest(L.accounts(s, d), "u0000", 5).unionByName(O.suggest(L.accounts(s, d), "name", 4)),
        LEDGER + ", n AS (SELECT 'name' AS kind, display AS suggestion FROM (SELECT DISTINCT display FROM a WHERE lower(display) LIKE '%name%') ORDER BY length(display), display LIMIT 4), x AS (SELECT 'address' AS kind, address AS suggestion FROM a WHERE lower(address) LIKE 'u0000%' ORDER BY balance DESC, address LIMIT 5) SELECT * FROM x UNION ALL SELECT * FROM n",
    ),
    "o9_expand_frontier": (
        lambda s, d: O.expand_frontier(_edges(s, d), L.seeds(s, d), L.accounts(s, d).where("node_type <> 'regular'"), 8),
        LEDGER + ", ring AS (SELECT ue.address, other, CAST(sum(total_volume) AS DECIMAL(38,0)) AS volume, CAST(sum(transfer_count) AS BIGINT) AS transfers FROM ue SEMI JOIN seeds USING (address) WHERE other NOT IN (SELECT address FROM a WHERE node_type <> 'regular') GROUP BY 1,2) SELECT address, other, volume, transfers FROM (SELECT *, row_number() OVER (PARTITION BY address ORDER BY volume DESC, other) AS rn FROM ring) WHERE rn <= 8",
    ),
    "o10_investigation_latest": (
        lambda s, d: O.investigation_latest(_investigations(s, d)),
        "SELECT session_id, updated_at, version, state FROM (SELECT user_id % 50 AS session_id, ts AS updated_at, event_id AS version, event_type AS state, row_number() OVER (PARTITION BY user_id % 50 ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1",
    ),
}
