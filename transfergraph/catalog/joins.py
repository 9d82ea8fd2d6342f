import uuid

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import joins as J
from ..operators import kept_index as K
from ..plans.cut import materialise
from ..sources import ledger as L
from .base import LEDGER
from .filters import UNIT, _edges


def _metrics(s, d):
    return A.degrees(_edges(s, d)).join(L.accounts(s, d).select("address", "risk_score", "node_type"), "address", "left")


def _activity(s, d):
    return L.transfers(s, d).select(F.col("from_address").alias("address"), "timestamp", "value")


def _queries(s, d):
    return L.accounts(s, d).select(F.explode(F.array(F.lit("Name 3"), F.lit("legal 12"), F.lit("U000009 name"))).alias("query")).distinct()


def _subs(s, d):
    return L.accounts(s, d).where("user_id % 3 <> 0").select("address", L.address((F.col("user_id") / 3).cast("long") * 3).alias("parent"), F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("sub_name"))


U1, U2 = "epoch_us(t1.timestamp)", "epoch_us(t2.timestamp)"
HOPS = ", hop AS (SELECT x.from_address AS origin, x.to_address AS via, y.to_address AS destination, least(x.total_volume, y.total_volume) AS bottleneck FROM e x JOIN e y ON x.to_address = y.from_address WHERE x.from_address <> y.to_address)"
SEQUENCE = f""", seq AS (SELECT t1.hash AS hash1, t1.from_address AS from1, t1.to_address AS to1, t1.value AS value1, t2.hash AS hash2, t2.from_address AS from2, t2.to_address AS to2, t2.value AS value2, ({U2}-{U1})/1000000.0 AS seconds
 FROM t t1 JOIN t t2 ON t1.to_address = t2.from_address AND {U2} > {U1} AND {U2} - {U1} <= 18000000000 WHERE t1.success AND t2.success AND abs(CAST(t1.value AS DOUBLE) - CAST(t2.value AS DOUBLE)) <= 0.15 * CAST(t1.value AS DOUBLE))"""


def _kept_index(s, d):
    """The same search over an index that two batches of accounts have made."""
    name = f"postings_{uuid.uuid4().hex}"
    a = L.accounts(s, d)
    for batch in (a.where("user_id < 700"), a):
        K.add_to_index(batch, ["address", "display", "legal"], name, 8)
    found = materialise(K.search_index(_queries(s, d), name).withColumn("rank", F.round("rank", 6)))
    K.drop_index(s, name)
    return found


FULLTEXT = (
        LEDGER + ", tok AS (SELECT address, unnest(list_filter(regexp_split_to_array(lower(concat_ws(' ', address, display, legal)), '[^a-z0-9]+'), lambda x: x <> '')) AS token FROM a), idx AS (SELECT token, address, count(*) AS tf FROM tok GROUP BY 1,2), dfs AS (SELECT token, count(*) AS df FROM idx GROUP BY 1), "
        "q AS (SELECT DISTINCT query, unnest(regexp_split_to_array(lower(query), '[^a-z0-9]+')) AS token FROM (VALUES ('Name 3'), ('legal 12'), ('U000009 name')) v(query)) SELECT query, address, count(*) AS matched, round(sum(tf * ln(1 + (SELECT count(*) FROM a) / df)), 6) AS rank FROM q JOIN idx USING (token) JOIN dfs USING (token) GROUP BY 1,2"
)

QUERIES = {
    "j1_direct_connections": (
        lambda s, d: J.direct_connections(_edges(s, d), L.accounts(s, d), _metrics(s, d), None, 10 * UNIT, 5),
        LEDGER + """SELECT b.address, b.other, direction, transfer_count, total_volume, first_transfer_block, last_transfer_block, first_transfer_time, last_transfer_time, a.display AS other_display, a.balance AS other_balance,
 m.degree AS other_degree, m.risk_score AS other_risk, m.node_type AS other_type FROM (SELECT *, row_number() OVER (PARTITION BY address ORDER BY total_volume DESC, other, direction) AS rn FROM ue WHERE total_volume >= 10000000000000) b
 LEFT JOIN a ON a.address = b.other LEFT JOIN m ON m.address = b.other WHERE rn <= 5""",
    ),
    "j2_two_hop_pairs": (lambda s, d: J.two_hop_pairs(_edges(s, d)), LEDGER + HOPS + "SELECT * FROM hop"),
    "j3_bidirectional_edges": (
        lambda s, d: J.bidirectional_edges(_edges(s, d)),
        LEDGER + "SELECT x.from_address, x.to_address, x.total_volume AS forward_volume, CAST(coalesce(y.total_volume,0) AS DECIMAL(38,0)) AS reverse_volume, x.transfer_count AS forward_count, coalesce(y.transfer_count,0) AS reverse_count, CAST(x.total_volume + coalesce(y.total_volume,0) AS DECIMAL(38,0)) AS both_volume FROM e x LEFT JOIN e y ON x.from_address = y.to_address AND x.to_address = y.from_address",
    ),
    "j4_two_hop_neighbourhood": (
        lambda s, d: J.two_hop_neighbourhood(_edges(s, d), L.seeds(s, d)),
        LEDGER + ", v AS (SELECT address, other, max(total_volume) AS volume FROM ue WHERE address <> other GROUP BY 1,2), one AS (SELECT s.address AS seed, other, volume FROM seeds s JOIN v USING (address)), "
        "every AS (SELECT seed, other, 1 AS distance, volume FROM one UNION ALL SELECT seed, v.other, 2, least(one.volume, v.volume) FROM one JOIN v ON v.address = one.other WHERE v.other <> seed) SELECT seed, other, min(distance) AS distance, count(*) AS paths, max(volume) AS max_volume FROM every GROUP BY 1,2",
    ),
    "j5_common_connections": (
        lambda s, d: J.common_connections(_edges(s, d)),
        LEDGER + HOPS + "SELECT e.from_address, e.to_address, coalesce(common, 0) AS common FROM e LEFT JOIN (SELECT origin, destination, count(DISTINCT via) AS common FROM hop WHERE via <> origin AND via <> destination GROUP BY 1,2) ON origin = e.from_address AND destination = e.to_address",
    ),
    "j6_sequential_transfers": (lambda s, d: J.sequential_transfers(L.transfers(s, d)), LEDGER + SEQUENCE + "SELECT * FROM seq"),
    "j7_time_proximity_pairs": (
        lambda s, d: J.time_proximity_pairs(_activity(s, d), 120),
        LEDGER + "SELECT x.from_address AS address_a, y.from_address AS address_b, abs(epoch_us(x.timestamp)-epoch_us(y.timestamp))/1000000.0 AS seconds FROM t x JOIN t y ON x.from_address < y.from_address AND abs(epoch_us(x.timestamp)-epoch_us(y.timestamp)) <= 120000000",
    ),
    "j8_shared_destinations": (
        lambda s, d: J.shared_destination_pairs(L.transfers(s, d), 86400),
        LEDGER + ", f AS (SELECT from_address AS x, to_address AS dst, epoch_us(min(timestamp)) AS u FROM t GROUP BY 1,2) SELECT f.x AS address_a, g.x AS address_b, f.dst AS destination, abs(f.u-g.u)/1000000.0 AS seconds FROM f JOIN f g ON f.dst = g.dst AND f.x < g.x AND abs(f.u-g.u) <= 86400000000",
    ),
    "j9_high_risk_edges": (
        lambda s, d: J.high_risk_edges(_edges(s, d), L.accounts(s, d), 0.7).select("from_address", "to_address", "from_risk", "to_risk", F.round("average_risk", 6).alias("average_risk")),
        LEDGER + "SELECT from_address, to_address, x.risk_score/100 AS from_risk, y.risk_score/100 AS to_risk, round((x.risk_score/100+y.risk_score/100)/2,6) AS average_risk FROM e JOIN a x ON x.address = from_address JOIN a y ON y.address = to_address WHERE x.risk_score/100 > 0.7 OR y.risk_score/100 > 0.7",
    ),
    "j10_enrich_edges": (
        lambda s, d: J.enrich_edges(_edges(s, d), L.accounts(s, d), 40 * UNIT).select("from_address", "to_address", "total_volume", "from_display", "to_display"),
        LEDGER + "SELECT from_address, to_address, total_volume, x.display AS from_display, y.display AS to_display FROM e LEFT JOIN a x ON x.address = from_address LEFT JOIN a y ON y.address = to_address WHERE total_volume >= 40000000000000",
    ),
    "j11_risky_neighbours": (
        lambda s, d: J.risky_neighbours(_edges(s, d), _metrics(s, d)).select("address", "other", "direction", "other_degree", "risk_score", "node_type"),
        LEDGER + "SELECT ue.address, other, direction, degree AS other_degree, risk_score, node_type FROM ue JOIN m ON m.address = other WHERE degree > 100 OR risk_score > 70 OR node_type IN ('mixer','exchange')",
    ),
    "j12_fulltext_search": (
        lambda s, d: J.fulltext_search(L.accounts(s, d), _queries(s, d), ["address", "display", "legal"]).withColumn("rank", F.round("rank", 6)),
        FULLTEXT,
    ),
    "j12_kept_index": (_kept_index, FULLTEXT),
    "j13_orphan_transfers": (
        lambda s, d: J.orphan_transfers(L.transfers(s, d), L.accounts(s, d).where("display is not null")),
        LEDGER + "SELECT hash, 'from' AS missing FROM t WHERE from_address NOT IN (SELECT address FROM a WHERE display IS NOT NULL) UNION ALL SELECT hash, 'to' FROM t WHERE to_address NOT IN (SELECT address FROM a WHERE display IS NOT NULL)",
    ),
    "j14_subgraph_edges": (
        lambda s, d: J.subgraph_edges(_edges(s, d), L.accounts(s, d).where("node_type <> 'regular'")),
        LEDGER + ", n AS (SELECT address FROM a WHERE node_type <> 'regular') SELECT * FROM e WHERE from_address IN (FROM n) AND to_address IN (FROM n)",
    ),
    "j15_node_pattern_overlap": (
        lambda s, d: J.node_pattern_overlap(_edges(s, d), L.detections(s, d), 0.9),
        LEDGER + ", p AS (SELECT address AS other, count(DISTINCT pattern_type) AS n_kinds, string_agg(DISTINCT pattern_type, ',' ORDER BY pattern_type) AS kinds FROM det WHERE confidence >= 0.9 AND NOT false_positive GROUP BY 1 HAVING count(DISTINCT pattern_type) >= 2) SELECT DISTINCT ue.address, other, n_kinds, kinds FROM ue JOIN p USING (other)",
    ),
    "j16_sub_identities": (
        lambda s, d: J.sub_identity_hierarchy(_subs(s, d), L.accounts(s, d)).select("address", "display", F.expr("array_join(transform(subs, x -> concat(x.sub_name, ':', x.sub_address)), ',')").alias("subs")),
        LEDGER + ", s AS (SELECT address AS sa, concat('U',lpad(CAST(user_id//3*3 AS VARCHAR),6,'0')) AS parent, concat('s',CAST(user_id AS VARCHAR)) AS sub_name FROM a WHERE user_id % 3 <> 0) SELECT a.address, display, string_agg(concat(sub_name,':',sa), ',' ORDER BY sub_name, sa) AS subs FROM a JOIN s ON parent = a.address GROUP BY 1,2",
    ),
    "j17_block_pairs": (
        lambda s, d: J.multi_hop_transfer_pairs_by_block(L.transfers(s, d), 100),
        LEDGER + "SELECT DISTINCT t1.from_address AS a, t2.to_address AS c FROM t t1 JOIN t t2 ON t1.to_address = t2.from_address AND t2.block_number > t1.block_number AND t2.block_number - t1.block_number < 100 WHERE t1.from_address <> t2.to_address",
    ),
}
