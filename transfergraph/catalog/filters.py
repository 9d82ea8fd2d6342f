from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import filters as P
from ..sources import ledger as L
from .base import LEDGER

UNIT = 10**12


def _edges(s, d):
    return A.build_edges(L.transfers(s, d))


def _as_of(s, d):
    return L.transfers(s, d).agg(F.max("timestamp").alias("as_of"))


def _active(s, d):
    return L.accounts(s, d).join(A.account_totals(L.transfers(s, d)).select("address", (F.col("transfers_in") + F.col("transfers_out")).alias("total_transfers")), "address", "left").fillna(0, ["total_transfers"])


ACTIVE = LEDGER + ", act AS (SELECT a.*, coalesce(n,0) AS total_transfers FROM a LEFT JOIN (SELECT address, count(*) AS n FROM l GROUP BY 1) USING (address))"
T0, T1 = "2024-01-08 00:00:00", "2024-01-22 00:00:00"
_ts = lambda x: F.lit(x).cast("timestamp")


def _identities(s, d):
    a = L.accounts(s, d)
    j = F.when(F.col("user_id") % 9 == 0, F.array(F.struct(F.lit(0).alias("registrar"), F.lit("Reasonable").alias("judgement")))).when(F.col("user_id") % 15 == 0, F.array(F.struct(F.lit(1).alias("registrar"), F.lit("Erroneous").alias("judgement"))))
    raw = a.where("display is not null").select("address", F.struct("display", "legal").alias("info"), j.alias("judgements"))
    subs = a.where("user_id % 3 = 1").select("address", L.address(F.col("user_id") - 1).alias("parent"), F.concat(F.lit("sub"), F.col("user_id").cast("string")).alias("sub_name"))
    return P.resolve_identities(raw, subs)


QUERIES = {
    "p1_lookup_accounts": (lambda s, d: P.lookup_accounts(L.accounts(s, d), L.seeds(s, d)), LEDGER + "SELECT a.* FROM a SEMI JOIN seeds USING (address)"),
    "p2_transfers_for": (
        lambda s, d: P.transfers_for(L.transfers(s, d), L.accounts(s, d), _ts(T0), _ts(T1), 10, 2),
        LEDGER + f"SELECT address, other, direction, hash, block_number, timestamp, value, success FROM (SELECT *, row_number() OVER (PARTITION BY address ORDER BY timestamp DESC, hash, direction) AS rn FROM l WHERE timestamp BETWEEN '{T0}' AND '{T1}') WHERE rn > 2 AND rn <= 12",
    ),
    "p3_with_direction": (lambda s, d: P.with_direction(L.transfers(s, d), L.accounts(s, d)), LEDGER + "SELECT l.address, other AS counterparty, direction, hash, block_number, timestamp, value, success FROM l SEMI JOIN a USING (address)"),
    "p4_min_volume": (lambda s, d: P.filter_edges_min_volume(_edges(s, d), 50 * UNIT), LEDGER + "SELECT * FROM e WHERE total_volume >= 50000000000000"),
    "p5_direction": (lambda s, d: P.filter_edges_direction(_edges(s, d), L.seeds(s, d), "bidirectional"), LEDGER + "SELECT * FROM e WHERE from_address IN (FROM seeds) OR to_address IN (FROM seeds)"),
    "p6_min_balance": (lambda s, d: P.filter_nodes_min_balance(L.accounts(s, d), 3000 * UNIT), LEDGER + "SELECT * FROM a WHERE balance >= 3000000000000000"),
    "p7_edges_time": (lambda s, d: P.filter_edges_time(_edges(s, d), _ts(T0), _ts(T1)), LEDGER + f"SELECT * FROM e WHERE last_transfer_time BETWEEN '{T0}' AND '{T1}'"),
    "p8_node_type": (lambda s, d: P.filter_nodes_type(L.accounts(s, d), ["mixer", "exchange"]), LEDGER + "SELECT * FROM a WHERE node_type IN ('mixer','exchange')"),
    "p9_node_risk": (lambda s, d: P.filter_nodes_risk(L.accounts(s, d), 20, 60), LEDGER + "SELECT * FROM a WHERE risk_score BETWEEN 20 AND 60"),
    "p10_flag_threshold": (lambda s, d: P.flag_volume_threshold(_edges(s, d), 60 * UNIT), LEDGER + "SELECT *, total_volume >= 60000000000000 AS above_threshold FROM e"),
    "p11_relative_time": (lambda s, d: P.relative_time_filter(L.transfers(s, d), "week", _as_of(s, d)), LEDGER + "SELECT t.* FROM t, latest_ WHERE timestamp >= as_of - INTERVAL 7 DAY"),
    "p12_transfers_where": (lambda s, d: P.transfers_where(L.transfers(s, d), from_address="U000007", min_amount=UNIT), LEDGER + "SELECT * FROM t WHERE from_address = 'U000007' AND value >= 1000000000000"),
    "p13_account_type": (
        lambda s, d: P.account_type(_active(s, d)).select("address", "account_type"),
        ACTIVE + "SELECT address, CASE WHEN verified THEN 'verified' WHEN total_transfers > 1000 OR balance > 1000000 THEN 'high-activity' WHEN total_transfers > 100 THEN 'active' ELSE 'normal' END AS account_type FROM act",
    ),
    "p14_risk_level": (
        lambda s, d: P.risk_level(L.accounts(s, d), "percent").select("address", "risk_level"),
        LEDGER + "SELECT address, CASE WHEN risk_score >= 80 THEN 'high' WHEN risk_score >= 50 THEN 'medium' WHEN risk_score >= 20 THEN 'low' ELSE 'minimal' END AS risk_level FROM a",
    ),
    "p15_regex": (
        lambda s, d: P.regex_classify(P.regex_filter(L.accounts(s, d), "display", "^Name [0-9]+$"), "display", [("even", "[02468]$"), ("one", "1$")]).select("address", "class"),
        LEDGER + "SELECT address, CASE WHEN regexp_matches(display,'[02468]$') THEN 'even' WHEN regexp_matches(display,'1$') THEN 'one' ELSE 'other' END AS class FROM a WHERE regexp_matches(display,'^Name [0-9]+$')",
    ),
    "p16_unreviewed": (lambda s, d: P.unreviewed_patterns(L.detections(s, d)).drop("detected_at"), LEDGER + "SELECT detection_id, address, pattern_type, confidence, severity, reviewed, false_positive FROM det WHERE NOT reviewed AND NOT false_positive"),
    "p17_stale_accounts": (
        lambda s, d: P.stale_accounts(L.accounts(s, d).join(A.account_totals(L.transfers(s, d)).select("address"), "address", "left").join(L.transfers(s, d).groupBy(F.col("from_address").alias("address")).agg(F.max("timestamp").alias("updated_at")), "address", "left"), _as_of(s, d)).select("address", "updated_at"),
        LEDGER + "SELECT a.address, u.ts AS updated_at FROM a LEFT JOIN (SELECT from_address AS address, max(timestamp) AS ts FROM t GROUP BY 1) u USING (address), latest_ WHERE u.ts IS NULL OR u.ts < as_of - INTERVAL 24 HOUR",
    ),
    "p18_identities": (
        _identities,
        LEDGER + ", own AS (SELECT address, display, legal, user_id%9=0 AS verified, user_id%9<>0 AND user_id%15=0 AS invalid FROM a WHERE display IS NOT NULL), sub AS (SELECT address, concat('U',lpad(CAST(user_id-1 AS VARCHAR),6,'0')) AS parent, concat('sub',CAST(user_id AS VARCHAR)) AS sub_name FROM a WHERE user_id%3=1), "
        "named AS (SELECT s.address, s.parent, concat_ws('/', o.display, sub_name) AS nm, o.verified AS pv FROM sub s LEFT JOIN own o ON o.address = s.parent) "
        "SELECT coalesce(o.address, n.address) AS address, coalesce(display, nm) AS display, legal, coalesce(verified, pv, FALSE) AS verified, coalesce(invalid, FALSE) AS invalid, parent FROM own o FULL JOIN named n ON o.address = n.address",
    ),
    "p19_empty_accounts": (
        lambda s, d: P.empty_accounts(L.accounts(s, d), L.transfers(s, d).select(F.col("to_address").alias("address")).distinct()).select("address"),
        LEDGER + "SELECT address FROM a WHERE balance = 0 AND display IS NULL AND address NOT IN (SELECT to_address FROM t)",
    ),
}
