from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import sets as U
from ..sources import ledger as L
from .base import LEDGER
from .filters import T1, _edges, _ts


def _halves(s, d):
    t = L.transfers(s, d)
    return A.build_edges(t.where(F.col("timestamp") < _ts(T1))), A.build_edges(t)


def _merged(s, d):
    a, b = _halves(s, d)
    return U.merge_graphs(a.select("from_address", "to_address", "transfer_count"), b.select("from_address", "to_address", "transfer_count"), ["from_address", "to_address"])


def _delta(s, d):
    a, b = _halves(s, d)
    return U.graph_delta(a, b.where("to_address <> 'U000001'"), ["from_address", "to_address"], ["transfer_count", "total_volume"])


BEFORE = LEDGER + f", b AS (SELECT from_address, to_address, count(*) AS transfer_count FROM t WHERE timestamp < '{T1}' GROUP BY 1,2)"
QUERIES = {
    "u1_vertices": (lambda s, d: U.vertices(_edges(s, d)), LEDGER + "SELECT DISTINCT address FROM ue"),
    "u2_undirected_view": (lambda s, d: U.undirected_view(L.transfers(s, d)), LEDGER + "SELECT * FROM l"),
    "u3_merge_graphs": (_merged, BEFORE + "SELECT * FROM b UNION ALL SELECT from_address, to_address, transfer_count FROM e ANTI JOIN b USING (from_address, to_address)"),
    "u4_graph_delta": (
        _delta,
        BEFORE + ", x AS (SELECT * FROM e WHERE to_address <> 'U000001') SELECT coalesce(b.from_address, x.from_address) AS from_address, coalesce(b.to_address, x.to_address) AS to_address, CASE WHEN b.from_address IS NULL THEN 'added' WHEN x.from_address IS NULL THEN 'removed' ELSE 'updated' END AS change "
        "FROM b FULL JOIN x ON b.from_address = x.from_address AND b.to_address = x.to_address WHERE b.from_address IS NULL OR x.from_address IS NULL OR b.transfer_count <> x.transfer_count",
    ),
    "u5_nodes_edges_tagged": (
        lambda s, d: U.nodes_edges_tagged(U.vertices(_edges(s, d)), _edges(s, d).select("from_address", "to_address", "transfer_count")),
        LEDGER + """SELECT 'nodes' AS kind, concat('{"address":"', address, '"}') AS json FROM (SELECT DISTINCT address FROM ue) UNION ALL SELECT 'edges', concat('{"from_address":"', from_address, '","to_address":"', to_address, '","transfer_count":', CAST(transfer_count AS VARCHAR), '}') FROM e""",
    ),
    "u6_dedupe_undirected": (
        lambda s, d: U.dedupe_edges_undirected(_edges(s, d)),
        LEDGER + ", g AS (SELECT least(from_address,to_address) AS address_a, greatest(from_address,to_address) AS address_b, CAST(sum(transfer_count) AS BIGINT) AS transfer_count, CAST(sum(total_volume) AS DECIMAL(38,0)) AS total_volume, CAST(coalesce(sum(total_volume) FILTER (WHERE from_address <= to_address),0) AS DECIMAL(38,0)) AS sent, "
        "CAST(coalesce(sum(total_volume) FILTER (WHERE from_address > to_address),0) AS DECIMAL(38,0)) AS received FROM e GROUP BY 1,2) SELECT *, CASE WHEN CAST(sent AS DOUBLE)/CAST(total_volume AS DOUBLE) > 0.7 THEN 'outgoing' WHEN CAST(sent AS DOUBLE)/CAST(total_volume AS DOUBLE) < 0.3 THEN 'incoming' ELSE 'balanced' END AS direction FROM g",
    ),
}
