from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import metrics as M
from ..operators import paths as G
from ..operators import sampling as S
from ..operators import weighted as V
from ..sources import ledger as L
from .base import LEDGER
from .filters import UNIT, _as_of, _edges, _ts
from .joins import _metrics
from .windows import _round

REC = LEDGER.replace("WITH n_", "WITH RECURSIVE n_", 1)
ARROW = "array_join(path, '->')"


def PATHS(depth, extra="", first="JOIN seeds ON seeds.address = from_address"):
    """Simple paths from the seeds of up to depth edges."""
    return f""", p AS (SELECT from_address AS seed, to_address AS fin, 1 AS hops, [from_address, to_address] AS path, total_volume AS last_volume, CAST(total_volume AS HUGEINT) AS total, total_volume AS bottleneck FROM e {first} WHERE from_address <> to_address {extra}
 UNION ALL SELECT seed, e.to_address, hops+1, list_append(path, e.to_address), e.total_volume, total + CAST(e.total_volume AS HUGEINT), least(bottleneck, e.total_volume) FROM p JOIN e ON e.from_address = fin WHERE hops < {depth} AND NOT list_contains(path, e.to_address) {extra})"""


def _pairs(s, d):
    """The seeds and those that they send to."""
    return _edges(s, d).join(L.seeds(s, d).withColumnRenamed("address", "from_address"), "from_address").where("from_address <> to_address").select(F.col("from_address").alias("seed"), F.col("to_address").alias("target"))


def _strong(s, d):
    """Edges of 80 units or more: few, so that pairs are from one edge to over ten apart, and some out of reach."""
    return _edges(s, d).where(F.col("total_volume") >= 80 * UNIT)


def _hundreds(s, d):
    """Each seed with the 99 accounts that follow it."""
    a = L.accounts(s, d)
    return a.select(L.address(F.col("user_id") - F.col("user_id") % 100).alias("seed"), F.col("address").alias("target")).where("seed <> target")


PAIR = ", pr AS (SELECT from_address AS seed, to_address AS fin FROM e JOIN seeds ON seeds.address = from_address WHERE from_address <> to_address)"
_show = lambda df, *rest: df.withColumn("path", F.expr(ARROW)).select("path", *rest)


def _costed(s, d, weight):
    e = _edges(s, d)
    if weight == "risk":
        r = L.accounts(s, d).select(F.col("address").alias("to_address"), "risk_score")
        e = e.join(r, "to_address")
    as_of = None
    if weight in ("time", "hours"):
        e = e.crossJoin(F.broadcast(_as_of(s, d)))  # one row
        as_of = F.col("as_of")
    return e.withColumn("cost", G.edge_cost(weight, as_of))


def _weighted(weight):
    return lambda s, d: _round(G.weighted_shortest_path(_costed(s, d, weight), L.seeds(s, d), 4).select("seed", "end", "cost"), "cost")


def _weighted_sql(cost, table="e", hops=4):
    return REC + f""", ce AS (SELECT from_address, to_address, {cost} AS cost FROM {table} WHERE from_address <> to_address), w AS (SELECT from_address AS seed, to_address AS fin, cost, 1 AS hops FROM ce JOIN seeds ON address = from_address
 UNION ALL SELECT seed, ce.to_address, w.cost + ce.cost, hops+1 FROM w JOIN ce ON ce.from_address = w.fin WHERE hops < {hops}) SELECT seed, fin AS "end", round(min(cost),6) AS cost FROM w WHERE fin <> seed GROUP BY 1,2"""


AGE = "(epoch_us((SELECT as_of FROM latest_)) - epoch_us(last_transfer_time))/1000000.0/86400"
DIST = """, ee AS (SELECT DISTINCT from_address AS u, to_address AS v FROM e WHERE from_address <> to_address), nodes AS (SELECT DISTINCT address FROM ue),
 wk AS (SELECT address AS s, address AS v, 0 AS d FROM nodes UNION SELECT s, ee.v, d+1 FROM wk JOIN ee ON ee.u = wk.v WHERE d < 12), ds AS (SELECT s, v, min(d) AS d FROM wk GROUP BY 1,2)"""
#: Shortest paths between all pairs, and on how many of them each vertex lies.
BETWEEN = """, sg AS (SELECT s, v, 0 AS d, CAST(1 AS DOUBLE) AS g FROM (SELECT address AS s, address AS v FROM nodes) UNION ALL SELECT s, w, d+1, g FROM (SELECT sg.s, ee.v AS w, sg.d, sum(sg.g) AS g FROM sg JOIN ee ON ee.u = sg.v JOIN ds ON ds.s = sg.s AND ds.v = ee.v AND ds.d = sg.d+1 GROUP BY 1,2,3)),
 bt AS (SELECT x.v AS address, sum(x.g*y.g/z.g) AS b FROM sg x {seeded} JOIN sg z ON z.s = x.s JOIN sg y ON y.s = x.v AND y.v = z.v AND x.d + y.d = z.d WHERE x.v <> x.s AND x.v <> z.v GROUP BY 1)"""
TRI = """, se AS (SELECT DISTINCT least(from_address,to_address) AS a, greatest(from_address,to_address) AS b FROM e WHERE from_address <> to_address), nb AS (SELECT a AS x, b AS y FROM se UNION ALL SELECT b, a FROM se),
 tr AS (SELECT n1.x AS address, count(*) AS triangles FROM nb n1 JOIN nb n2 ON n1.x = n2.x AND n1.y < n2.y JOIN se ON se.a = n1.y AND se.b = n2.y GROUP BY 1),
 cc AS (SELECT v.address, coalesce(k,0) AS neighbours, coalesce(triangles,0) AS triangles, CASE WHEN coalesce(k,0) > 1 THEN 2.0*coalesce(triangles,0)/(k*(k-1)) ELSE 0 END AS clustering FROM (SELECT DISTINCT address FROM ue) v LEFT JOIN (SELECT x AS address, count(*) AS k FROM nb GROUP BY 1) USING (address) LEFT JOIN tr USING (address))"""


#: Least sums of volume between all pairs, by doubling: paths of up to 64 edges.
FAR = """, far0 AS MATERIALIZED (SELECT s, v, min(d) AS d FROM (SELECT from_address AS s, to_address AS v, CAST(total_volume AS HUGEINT) AS d FROM e WHERE from_address <> to_address UNION ALL SELECT DISTINCT address, address, CAST(0 AS HUGEINT) FROM ue) GROUP BY 1,2)""" + "".join(
    f", far{k + 1} AS MATERIALIZED (SELECT x.s, y.v, min(x.d + y.d) AS d FROM far{k} x JOIN far{k} y ON y.s = x.v GROUP BY 1,2)" for k in range(6)
) + ", far AS (FROM far6)"
FAR_PATHS = """, tight AS MATERIALIZED (SELECT x.s, x.v, y.v AS w FROM far x JOIN e ON e.from_address = x.v AND e.from_address <> e.to_address JOIN far y ON y.s = x.s AND y.v = e.to_address AND x.d + CAST(e.total_volume AS HUGEINT) = y.d),
 sk AS (SELECT s, v, 0 AS k, CAST(1 AS DOUBLE) AS g FROM far WHERE s = v UNION ALL SELECT s, w, k+1, g FROM (SELECT sk.s, tight.w, sk.k, sum(sk.g) AS g FROM sk JOIN tight ON tight.s = sk.s AND tight.v = sk.v GROUP BY ALL)),
 sg AS MATERIALIZED (SELECT sk.s, sk.v, any_value(far.d) AS d, sum(g) AS g FROM sk JOIN far ON far.s = sk.s AND far.v = sk.v GROUP BY 1,2)"""
#: Pairs that g15_betweenness_sampled draws.
SAMPLED = 400


def _by_volume(s, d):
    return _edges(s, d).select("from_address", "to_address", F.col("total_volume").alias("cost"))


def pagerank_sql(rounds, weighted=False):
    w = "CAST(total_volume AS DOUBLE)" if weighted else "1.0"
    out = f", nodes AS (SELECT DISTINCT address FROM ue), nn AS (SELECT count(*) AS n FROM nodes), ls AS MATERIALIZED (SELECT from_address, to_address, {w}/sum({w}) OVER (PARTITION BY from_address) AS share FROM e), r0 AS (SELECT address, 1.0/n AS r FROM nodes, nn)"
    for k in range(rounds):
        out += f", r{k + 1} AS MATERIALIZED (SELECT nodes.address, 0.15/any_value(n) + 0.85*coalesce(sum(r*share),0) AS r FROM nodes CROSS JOIN nn LEFT JOIN (ls JOIN r{k} ON r{k}.address = ls.from_address) ON ls.to_address = nodes.address GROUP BY 1)"
    return out


def labels_sql(rounds):
    out = ", vv AS MATERIALIZED (SELECT address, other FROM ue WHERE address <> other), lb0 AS (SELECT DISTINCT address, address AS label FROM ue)"
    for k in range(rounds):
        out += f", lb{k + 1} AS MATERIALIZED (SELECT lb{k}.address, coalesce(b.label, lb{k}.label) AS label FROM lb{k} LEFT JOIN (SELECT address, label FROM (SELECT vv.address, x.label, row_number() OVER (PARTITION BY vv.address ORDER BY count(*) DESC, x.label) AS rn FROM vv JOIN lb{k} x ON x.address = vv.other GROUP BY 1,2) WHERE rn = 1) b USING (address))"
    return out


SINGLE = "(transfer_count = 1 AND total_volume > 1000000000000)"
RISK = f""", er AS (SELECT from_address, to_address, least(100.0, (coalesce(x.risk_score,0)+coalesce(y.risk_score,0))/2 + CASE WHEN {SINGLE} THEN 30 ELSE 0 END) AS edge_risk, CASE WHEN {SINGLE} THEN 1 ELSE 0 END AS single FROM e LEFT JOIN m x ON x.address = from_address LEFT JOIN m y ON y.address = to_address),
 nr AS (SELECT path, avg(coalesce(m.risk_score,0)) AS nr, max(coalesce(m.risk_score,0)) AS mx, sum(CASE WHEN node_type IN ('mixer','exchange') THEN 1 ELSE 0 END) AS nf FROM (SELECT path, unnest(path) AS address FROM p) LEFT JOIN m USING (address) GROUP BY 1),
 ep AS (SELECT path, avg(edge_risk) AS er, sum(single) AS ef FROM (SELECT path, path[i] AS from_address, path[i+1] AS to_address FROM (SELECT path, unnest(range(1, len(path))) AS i FROM p)) JOIN er USING (from_address, to_address) GROUP BY 1),
 rk AS (SELECT p.seed, p.fin AS "end", array_to_string(p.path,'->') AS path, nr, mx, er, nf+ef AS flags, least(100.0, 0.4*nr + 0.3*er + 0.3*20*(nf+ef)) AS tot FROM p JOIN nr USING (path) JOIN ep USING (path))"""


def _clustering_hubs(s, d):
    e = _edges(s, d)
    return _round(M.hubs(e, L.accounts(s, d), M.clustering_coefficient(e), 20).select("address", "degree", "partners", "score", "class"), "score")


def _communities(s, d):
    e = _edges(s, d)
    return M.community_metrics(M.label_propagation(e, 2), e)


def _community_totals(s, d):
    e = _edges(s, d)
    lab = M.label_propagation(e, 2)
    return _round(M.community_totals(M.community_metrics(lab, e), lab, e), "mean_size", "edge_balance", "modularity_q")


COMM = labels_sql(2) + """, cj AS (SELECT x.label, y.label AS l2, total_volume FROM e JOIN lb2 x ON x.address = from_address JOIN lb2 y ON y.address = to_address), cs AS (SELECT label, count(*) AS members FROM lb2 GROUP BY 1),
 cm AS (SELECT cs.label, members, count(l2) FILTER (WHERE l2 = cj.label) AS internal, count(l2) FILTER (WHERE l2 <> cj.label) AS external, CAST(coalesce(sum(total_volume) FILTER (WHERE l2 = cj.label),0) AS DECIMAL(38,0)) AS internal_volume FROM cs LEFT JOIN cj ON cj.label = cs.label GROUP BY 1,2)"""
CYCLES = """, cy AS (SELECT from_address AS seed, to_address AS fin, [from_address, to_address] AS path, total_volume AS bottleneck, 1 AS hops, FALSE AS closed FROM e {first} WHERE from_address <> to_address {cond}
 UNION ALL SELECT seed, e.to_address, list_append(path, e.to_address), least(bottleneck, e.total_volume), hops+1, e.to_address = seed FROM cy JOIN e ON e.from_address = fin WHERE NOT closed AND hops < {depth} AND e.from_address <> e.to_address AND (e.to_address = seed OR (NOT list_contains(path, e.to_address) {grow})))"""
SEEDED = "JOIN seeds ON seeds.address = from_address"

QUERIES = {
    "g1_enumerate_paths": (
        lambda s, d: _show(G.enumerate_paths(_edges(s, d), L.seeds(s, d), 3), "seed", "end", "hops", "last_volume", "total", "bottleneck"),
        REC + PATHS(3) + "SELECT array_to_string(path,'->') AS path, seed, fin AS \"end\", hops, last_volume, CAST(total AS DECIMAL(38,0)) AS total, bottleneck FROM p",
    ),
    "g2_multi_hop": (
        lambda s, d: G.multi_hop_connections(_edges(s, d), L.accounts(s, d), L.seeds(s, d), 3, 0, 50),
        REC + PATHS(3) + ', g AS (SELECT seed, fin AS "end", min(hops) AS min_hops, count(*) AS paths, max(bottleneck) AS best_bottleneck FROM p GROUP BY 1,2), r AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY min_hops, best_bottleneck DESC, "end") AS rn FROM g) SELECT seed, "end", min_hops, paths, best_bottleneck, display, balance, risk_score, node_type FROM r LEFT JOIN a ON a.address = "end" WHERE rn <= 50',
    ),
    "g3_subgraph": (
        lambda s, d: G.subgraph(_edges(s, d), L.seeds(s, d), 2),
        LEDGER + ", x0 AS (SELECT address AS seed, address, 0 AS depth FROM seeds), x1 AS (SELECT DISTINCT seed, other AS address, 1 AS depth FROM x0 JOIN ue USING (address)), x2 AS (SELECT DISTINCT seed, other AS address, 2 AS depth FROM x1 JOIN ue USING (address)) SELECT seed, address, min(depth) AS depth FROM (FROM x0 UNION ALL FROM x1 UNION ALL FROM x2) GROUP BY 1,2",
    ),
    "g3_subgraph_edges": (
        lambda s, d: G.subgraph_with_edges(_edges(s, d), L.seeds(s, d), 1),
        LEDGER + ", x AS (SELECT address AS seed, address FROM seeds UNION SELECT address, other FROM ue SEMI JOIN seeds USING (address)) SELECT x.seed, from_address, to_address, total_volume FROM e JOIN x ON x.address = from_address JOIN x y ON y.address = to_address AND y.seed = x.seed",
    ),
    "g4_shortest_path": (
        lambda s, d: G.shortest_path(_edges(s, d), L.seeds(s, d), 4).select("seed", "end", "hops", "bottleneck"),
        REC + ', w AS (SELECT from_address AS seed, to_address AS fin, 1 AS hops, total_volume AS bn FROM e JOIN seeds ON address = from_address WHERE from_address <> to_address UNION SELECT seed, e.to_address, hops+1, least(bn, e.total_volume) FROM w JOIN e ON e.from_address = fin WHERE hops < 4 AND e.to_address <> seed), f AS (SELECT seed, fin, min(hops) AS h FROM w GROUP BY 1,2) SELECT w.seed, w.fin AS "end", hops, max(bn) AS bottleneck FROM w JOIN f ON f.seed = w.seed AND f.fin = w.fin AND h = hops WHERE w.fin <> w.seed GROUP BY 1,2,3',
    ),
    "g4_shortest_pairs": (
        lambda s, d: G.shortest_path_of_pairs(_strong(s, d), _hundreds(s, d), 6).select("seed", "end", "hops", "bottleneck"),
        REC + """, st AS (SELECT * FROM e WHERE total_volume >= 80000000000000 AND from_address <> to_address), pr AS (SELECT concat('U',lpad(CAST(user_id - user_id % 100 AS VARCHAR),6,'0')) AS seed, address AS fin FROM a WHERE user_id % 100 <> 0),
 w AS (SELECT from_address AS seed, to_address AS fin, 1 AS hops, total_volume AS bn FROM st WHERE from_address IN (SELECT seed FROM pr)
  UNION SELECT seed, st.to_address, hops+1, least(bn, st.total_volume) FROM w JOIN st ON st.from_address = w.fin WHERE hops < 6 AND st.to_address <> seed),
 f AS (SELECT seed, fin, min(hops) AS h FROM w GROUP BY 1,2)
 SELECT w.seed, w.fin AS "end", hops, max(bn) AS bottleneck FROM w JOIN f ON f.seed = w.seed AND f.fin = w.fin AND h = hops JOIN pr ON pr.seed = w.seed AND pr.fin = w.fin GROUP BY 1,2,3""",
    ),
    "g5_weighted_volume": (_weighted("volume"), _weighted_sql("1/(1+log10(1+CAST(CAST(total_volume AS HUGEINT)//1000000000 AS DOUBLE)))")),
    "g5_weighted_risk": (_weighted("risk"), _weighted_sql("1 + risk_score/100", "(SELECT e.*, risk_score FROM e JOIN a ON a.address = to_address)")),
    "g5_weighted_time": (_weighted("time"), _weighted_sql(f"1 + log10(1 + {AGE})")),
    "g6_all_paths": (
        lambda s, d: _show(G.all_paths(_edges(s, d), _pairs(s, d), 4, 100), "seed", "end", "hops", "total", "bottleneck"),
        REC + PATHS(4) + PAIR + ", r AS (SELECT p.*, row_number() OVER (PARTITION BY p.seed, p.fin ORDER BY hops, path) AS rn FROM p SEMI JOIN pr USING (seed, fin)) SELECT array_to_string(path,'->') AS path, seed, fin AS \"end\", hops, CAST(total AS DECIMAL(38,0)) AS total, bottleneck FROM r WHERE rn <= 100",
    ),
    "g7_high_value_paths": (
        lambda s, d: _show(G.high_value_paths(_edges(s, d), _pairs(s, d), 80 * UNIT, 4, 20), "seed", "end", "hops", "bottleneck"),
        REC + PATHS(4, "AND e.total_volume >= 80000000000000") + PAIR + ", r AS (SELECT p.*, row_number() OVER (PARTITION BY p.seed, p.fin ORDER BY bottleneck DESC, hops, path) AS rn FROM p SEMI JOIN pr USING (seed, fin)) SELECT array_to_string(path,'->') AS path, seed, fin AS \"end\", hops, bottleneck FROM r WHERE rn <= 20",
    ),
    "g8_quickest_paths": (
        lambda s, d: _round(G.quickest_paths(_edges(s, d).crossJoin(F.broadcast(_as_of(s, d))), L.seeds(s, d), F.col("as_of"), 14, 4).select("seed", "end", "cost"), "cost", n=4),
        _weighted_sql(f"greatest(1.0, {AGE}*24)", f"(SELECT * FROM e WHERE {AGE} <= 14)").replace("round(min(cost),6)", "round(min(cost),4)"),
    ),
    "g9_path_risk": (
        lambda s, d: _round(_show(G.path_risk(G.enumerate_paths(_edges(s, d), L.seeds(s, d), 2), _metrics(s, d), _edges(s, d)), "seed", "end", "node_risk", "edge_risk", "flags", "total_risk", "level"), "node_risk", "edge_risk", "total_risk", n=4),
        REC + PATHS(2) + RISK + "SELECT path, seed, \"end\", round(nr,4) AS node_risk, round(er,4) AS edge_risk, CAST(flags AS BIGINT) AS flags, round(tot,4) AS total_risk, CASE WHEN tot >= 80 THEN 'critical' WHEN tot >= 50 THEN 'high' WHEN tot >= 20 THEN 'medium' ELSE 'low' END AS level FROM rk",
    ),
    "g10_critical_nodes": (
        lambda s, d: _round(G.critical_nodes(G.all_paths(_edges(s, d), _pairs(s, d), 3, 100), _metrics(s, d)).select("seed", "end", "address", "frequency", "participation", "critical", "score"), "participation", "score"),
        REC + PATHS(3) + PAIR + ", r AS (SELECT * FROM (SELECT p.*, row_number() OVER (PARTITION BY p.seed, p.fin ORDER BY hops, path) AS rn FROM p SEMI JOIN pr USING (seed, fin)) WHERE rn <= 100), tt AS (SELECT seed, fin, count(*) AS n FROM r GROUP BY 1,2), i AS (SELECT seed, fin, address, count(*) AS f FROM (SELECT seed, fin, unnest(path[2:len(path)-1]) AS address FROM r WHERE hops > 1) GROUP BY 1,2,3) "
        'SELECT i.seed, i.fin AS "end", i.address, f AS frequency, round(f/n,6) AS participation, f = n AS critical, round(40*f/n + CASE WHEN f = n THEN 30 ELSE 0 END + least(15.0, coalesce(degree,0)/10),6) AS score FROM i JOIN tt USING (seed, fin) LEFT JOIN m ON m.address = i.address',
    ),
    "g11_circular_flows": (
        lambda s, d: _show(G.circular_flows(_edges(s, d), L.seeds(s, d), 4), "seed", "length", "bottleneck"),
        REC + CYCLES.format(first=SEEDED, cond="", depth=4, grow="") + "SELECT array_to_string(path,'->') AS path, seed, hops AS length, bottleneck FROM cy WHERE closed",
    ),
    "g12_temporal_cycles": (
        lambda s, d: _show(G.temporal_circular_flow(L.transfers(s, d), L.seeds(s, d), 3), "seed", "hops", "first_block", "last_block"),
        REC + ", tc AS (SELECT from_address AS seed, to_address AS fin, [from_address,to_address] AS path, block_number AS fb, block_number AS lb, 1 AS hops, FALSE AS closed FROM t JOIN seeds ON address = from_address WHERE from_address <> to_address UNION ALL SELECT seed, t.to_address, list_append(path, t.to_address), fb, t.block_number, hops+1, t.to_address = seed FROM tc JOIN t ON t.from_address = fin AND t.block_number > lb WHERE NOT closed AND hops < 3 AND t.from_address <> t.to_address AND (t.to_address = seed OR NOT list_contains(path, t.to_address))) SELECT array_to_string(path,'->') AS path, seed, hops, fb AS first_block, lb AS last_block FROM tc WHERE closed",
    ),
    "g13_degree_centrality": (
        lambda s, d: _round(M.degree_centrality(_edges(s, d)), "centrality", "in_centrality", "out_centrality"),
        LEDGER + "SELECT address, degree, in_degree, out_degree, total_volume_in, total_volume_out, " + ", ".join(f"round({c}degree/((SELECT count(*) FROM m)-1),6) AS {c}centrality" for c in ("", "in_", "out_")) + " FROM m",
    ),
    "g14_clustering": (lambda s, d: _round(M.clustering_coefficient(_edges(s, d)), "clustering"), LEDGER + TRI + "SELECT address, neighbours, triangles, round(clustering,6) AS clustering FROM cc"),
    "g15_betweenness": (
        lambda s, d: _round(M.betweenness(_edges(s, d), L.seeds(s, d)), "betweenness", n=8),
        REC + DIST + BETWEEN.format(seeded="JOIN seeds ON seeds.address = x.s") + """ SELECT nodes.address, round(coalesce(b,0)*2.0/((SELECT (count(*)-1)*(count(*)-2) FROM nodes)),8) AS betweenness FROM nodes LEFT JOIN bt USING (address)""",
    ),
    "g15_betweenness_volume": (
        lambda s, d: _round(V.weighted_betweenness(_by_volume(s, d), L.seeds(s, d)), "betweenness", n=8),
        REC + FAR + FAR_PATHS + """, nodes AS (SELECT DISTINCT address FROM ue), bt AS (SELECT x.v AS address, sum(x.g*y.g/z.g) AS b FROM sg x JOIN seeds ON seeds.address = x.s JOIN sg z ON z.s = x.s JOIN sg y ON y.s = x.v AND y.v = z.v AND x.d + y.d = z.d WHERE x.v <> x.s AND x.v <> z.v GROUP BY 1)
 SELECT nodes.address, round(coalesce(b,0)*2.0/((SELECT (count(*)-1)*(count(*)-2) FROM nodes)),8) AS betweenness FROM nodes LEFT JOIN bt USING (address)""",
    ),
    "g15_betweenness_sampled": (
        lambda s, d: _round(S.sampled_betweenness(_edges(s, d), SAMPLED, seed=7, epsilon=0.0), "betweenness", "bound", n=8),
        REC + DIST + BETWEEN.format(seeded="") + """, vx AS (SELECT address, row_number() OVER (ORDER BY address) - 1 AS i, count(*) OVER () AS n FROM nodes),
 dr AS (SELECT j, CAST('0x' || substr(md5('7:' || j || ':0'),1,15) AS BIGINT) % n AS a, CAST('0x' || substr(md5('7:' || j || ':1'),1,15) AS BIGINT) % (n-1) AS b FROM range({m}) AS t(j), (SELECT count(*) AS n FROM nodes)),
 pr AS (SELECT j, x.address AS u, y.address AS v FROM dr JOIN vx x ON x.i = a JOIN vx y ON y.i = CASE WHEN b >= a THEN b + 1 ELSE b END),
 ex AS (SELECT x.v AS address, j, x.g*y.g/z.g AS f FROM pr JOIN sg x ON x.s = pr.u JOIN sg z ON z.s = pr.u AND z.v = pr.v JOIN sg y ON y.s = x.v AND y.v = pr.v AND x.d + y.d = z.d WHERE x.v <> pr.u AND x.v <> pr.v),
 sm AS (SELECT address, sum(f) AS s1, sum(f*f) AS s2 FROM ex GROUP BY 1), w AS (SELECT nodes.address, coalesce(s1,0)/{m} AS mean, greatest(0, coalesce(s2,0)/{m} - (coalesce(s1,0)/{m})*(coalesce(s1,0)/{m})) AS var, ln(3.0*(SELECT count(*) FROM nodes)/0.1) AS l FROM nodes LEFT JOIN sm USING (address))
 SELECT address, round(mean,8) AS betweenness, round(sqrt(2*var*l/{m}) + 3*l/{m},8) AS bound, {m} AS pairs FROM w""".format(m=SAMPLED),
    ),
    "g16_betweenness_proxy": (
        lambda s, d: _round(M.betweenness_proxy(_edges(s, d), 20), "betweenness"),
        LEDGER + "SELECT x.from_address AS address, count(DISTINCT y.to_address) AS reach, round(count(DISTINCT y.to_address)/1000,6) AS betweenness FROM e x JOIN e y ON x.to_address = y.from_address JOIN m ON m.address = x.from_address WHERE degree > 20 AND x.from_address <> y.to_address GROUP BY 1",
    ),
    "g17_closeness": (
        lambda s, d: _round(M.closeness(_edges(s, d)), "closeness"),
        REC + DIST + "SELECT v AS address, count(*)-1 AS reachable, round(coalesce((count(*)-1)/nullif(sum(d),0),0)*(count(*)-1)/((SELECT count(*) FROM nodes)-1),6) AS closeness FROM ds GROUP BY 1",
    ),
    "g17_closeness_volume": (
        lambda s, d: _round(V.weighted_closeness(_by_volume(s, d), L.seeds(s, d)).withColumn("closeness", F.col("closeness") * 1e12), "closeness"),
        REC + FAR + ", nodes AS (SELECT DISTINCT address FROM ue) SELECT v AS address, count(*)-1 AS reachable, round(1e12*coalesce((count(*)-1)/nullif(CAST(sum(d) AS DOUBLE),0),0)*(count(*)-1)/((SELECT count(*) FROM nodes)-1),6) AS closeness FROM far SEMI JOIN seeds ON seeds.address = v GROUP BY 1",
    ),
    "g18_pagerank": (lambda s, d: _round(M.pagerank(_edges(s, d), 20), "pagerank", n=9), LEDGER + pagerank_sql(20) + "SELECT address, round(r,9) AS pagerank FROM r20"),
    "g18_pagerank_weighted": (lambda s, d: _round(M.pagerank(_edges(s, d), 20, weighted=True), "pagerank", n=9), LEDGER + pagerank_sql(20, True) + "SELECT address, round(r,9) AS pagerank FROM r20"),
    "g18_convergence": (
        lambda s, d: _round(_round(M.pagerank_convergence(M.pagerank(_edges(s, d), 20)), "total", "mean", "deviation"), "variance", n=10),
        LEDGER + pagerank_sql(20) + "SELECT count(*) AS vertices, round(sum(r),6) AS total, round(avg(r),6) AS mean, round(var_pop(r),10) AS variance, round(stddev_pop(r),6) AS deviation, var_pop(r) < 0.0001 AS converged FROM r20",
    ),
    "g19_hubs": (
        _clustering_hubs,
        LEDGER + TRI + ", pt AS (SELECT address, count(DISTINCT other) AS partners FROM ue GROUP BY 1) SELECT m.address, degree, partners, round(0.3*least(1.0,degree/100) + 0.3*least(1, CAST(total_volume_in+total_volume_out AS HUGEINT)//1000000000000) + 0.2*least(1.0,partners/50) + 0.2*(1-clustering),6) AS score, "
        "CASE WHEN node_type='exchange' THEN 'exchange_hub' WHEN node_type='mixer' THEN 'mixer_hub' WHEN out_degree/(in_degree+1) > 10 THEN 'distribution_hub' WHEN out_degree/(in_degree+1) < 0.1 THEN 'collection_hub' ELSE 'balanced_hub' END AS class FROM m JOIN pt USING (address) JOIN cc USING (address) WHERE degree >= 20",
    ),
    "g20_label_propagation": (lambda s, d: M.label_propagation(_edges(s, d), 10), LEDGER + labels_sql(10) + "SELECT * FROM lb10"),
    "g21_community_metrics": (
        lambda s, d: _round(_communities(s, d), "density"),
        LEDGER + COMM + "SELECT label, members, internal, external, internal_volume, round(CASE WHEN members > 1 THEN internal/(members*(members-1)) ELSE 0 END,6) AS density FROM cm",
    ),
    "g21_community_totals": (
        _community_totals,
        LEDGER + COMM + ", io AS (SELECT label, sum(CAST(in_degree AS DOUBLE)) AS i, sum(CAST(out_degree AS DOUBLE)) AS o FROM m JOIN lb2 USING (address) GROUP BY 1) SELECT count(*) AS communities, round(avg(members),6) AS mean_size, max(members) AS max_size, min(members) AS min_size, round((sum(internal)-sum(external))/sum(internal+external),6) AS edge_balance, round(sum(internal)/sum(internal+external) - (SELECT sum(i*o) FROM io)/(sum(internal+external)*sum(internal+external)),6) AS modularity_q FROM cm",
    ),
    "g22_components": (
        lambda s, d: M.weak_components(_edges(s, d)),
        REC + ", be AS (SELECT address, other FROM ue), rc AS (SELECT address, address AS o FROM be UNION SELECT rc.address, be.other FROM rc JOIN be ON be.address = rc.o) SELECT address, min(o) AS component FROM rc GROUP BY 1",
    ),
    "g23_graph_density": (
        lambda s, d: _round(M.graph_density(_edges(s, d)).drop("components", "largest"), "density", "mean_degree", "reciprocity", n=8),
        LEDGER + "SELECT (SELECT count(*) FROM m) AS nodes, count(*) AS edges, round(count(*)/((SELECT count(*) FROM m)*((SELECT count(*) FROM m)-1)),8) AS density, round(2*count(*)/(SELECT count(*) FROM m),8) AS mean_degree, round((SELECT count(*) FROM e x JOIN e y ON x.from_address = y.to_address AND x.to_address = y.from_address WHERE x.from_address < x.to_address)/count(*),8) AS reciprocity FROM e",
    ),
    "g24_common_neighbours": (lambda s, d: _round(M.common_neighbours_avg(_edges(s, d)), "average"), LEDGER + TRI + "SELECT address, round(CASE WHEN neighbours > 0 THEN 2.0*triangles/neighbours ELSE 0 END,6) AS average FROM cc"),
    "g25_network_metrics": (
        lambda s, d: _round(_round(M.network_metrics(_edges(s, d)), "centrality", "clustering", "closeness", "common_average"), "pagerank", "betweenness", n=8),
        REC + pagerank_sql(20).replace("nodes AS (SELECT DISTINCT address FROM ue), ", "", 1).replace(", nn AS", DIST + ", nn AS", 1) + TRI + BETWEEN.format(seeded="")
        + """, cl AS (SELECT v AS address, round(coalesce((count(*)-1)/nullif(sum(d),0),0)*(count(*)-1)/((SELECT count(*) FROM nodes)-1),6) AS closeness FROM ds GROUP BY 1)
 SELECT m.address, degree, round(degree/((SELECT count(*) FROM m)-1),6) AS centrality, neighbours, triangles, round(clustering,6) AS clustering, round(r,8) AS pagerank, round(coalesce(b,0)*2.0/((SELECT (count(*)-1)*(count(*)-2) FROM nodes)),8) AS betweenness, closeness,
 round(CASE WHEN neighbours > 0 THEN 2.0*triangles/neighbours ELSE 0 END,6) AS common_average FROM m JOIN cc USING (address) JOIN r20 USING (address) JOIN cl USING (address) LEFT JOIN bt USING (address)""",
    ),
    "g26_metrics_cache": (
        lambda s, d: _round(M.graph_metrics_cache(_edges(s, d)).withColumn("mean_volume", F.col("mean_volume") / 1e12), "mean_volume"),
        LEDGER + TRI + ", g AS (SELECT address, count(*) AS degree, CAST(sum(total_volume) AS DECIMAL(38,0)) AS volume, min(first_transfer_time) AS first_seen, max(last_transfer_time) AS last_seen, CAST(sum(transfer_count) AS BIGINT) AS transfers FROM ue GROUP BY 1) SELECT g.*, triangles, round(CAST(volume AS DOUBLE)/degree/1e12,6) AS mean_volume FROM g JOIN cc USING (address)",
    ),
    "g27_bfs_build": (
        lambda s, d: G.bfs_build_graph(_edges(s, d), L.seeds(s, d), 2, 5),
        LEDGER + """, v AS (SELECT address, other, CAST(sum(total_volume) AS DECIMAL(38,0)) AS volume FROM ue WHERE address <> other GROUP BY 1,2), st AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY address ORDER BY volume DESC, other) AS rn FROM v) WHERE rn <= 5),
 b1 AS (SELECT address AS seed, address, other, 1 AS depth, volume FROM seeds JOIN st USING (address)), f1 AS (SELECT DISTINCT seed, other AS address FROM b1 EXCEPT SELECT address, address FROM seeds) SELECT * FROM b1 UNION ALL SELECT seed, address, other, 2, volume FROM f1 JOIN st USING (address)""",
    ),
    "g28_node_profile": (
        lambda s, d: M.node_profile(A.transfer_statistics(L.transfers(s, d)), L.accounts(s, d)),
        LEDGER + ", r AS (SELECT x.address, count(*) AS n FROM l x JOIN l y ON x.address = y.address AND epoch_us(y.timestamp) > epoch_us(x.timestamp) AND epoch_us(y.timestamp) <= epoch_us(x.timestamp) + 3600000000 GROUP BY 1) SELECT l.address, count(DISTINCT other) AS degree, CAST(coalesce(sum(value) FILTER (WHERE direction='in'),0) AS DECIMAL(38,0)) AS volume_in, CAST(coalesce(sum(value) FILTER (WHERE direction='out'),0) AS DECIMAL(38,0)) AS volume_out, "
        "count(*) FILTER (WHERE direction='in') AS n_in, count(*) FILTER (WHERE direction='out') AS n_out, CASE WHEN count(DISTINCT other) > 1000 AND sum(value) > 1000000000000000 THEN 'exchange' ELSE 'regular' END AS kind, CASE WHEN coalesce(any_value(n),0) > 10 THEN 'High Activity' ELSE '' END AS tags FROM l LEFT JOIN r USING (address) GROUP BY 1",
    ),
    "g29_safe_depth": (
        lambda s, d: _round(G.safe_depth(_edges(s, d)), "average_degree", "estimate"),
        LEDGER + ", x AS (SELECT count(*) AS edges, (SELECT count(*) FROM m) AS nodes FROM e), y AS (SELECT *, edges/nodes AS ad, nodes*(edges/nodes)*(edges/nodes) AS est FROM x) SELECT edges, nodes, round(ad,6) AS average_degree, round(est,6) AS estimate, CASE WHEN est < 1e4 THEN 4 WHEN est < 1e5 THEN 3 WHEN est < 1e6 THEN 2 ELSE 1 END AS depth FROM y",
    ),
    "g30_path_score": (
        lambda s, d: _round(_show(G.path_score(G.enumerate_paths(_edges(s, d), L.seeds(s, d), 2)), "seed", "hops", "score"), "score"),
        REC + PATHS(2) + "SELECT array_to_string(path,'->') AS path, seed, hops, round(greatest(0.0, 100 - 10*hops + CASE WHEN total > 0 THEN least(50.0, log10(CAST(total AS DOUBLE)/1e10)*10) ELSE -100 END),6) AS score FROM p",
    ),
}
