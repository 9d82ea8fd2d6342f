"""Graph metrics: degree, clustering, centralities, communities and components as joins over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.components import connected_components as components_of
from ..plans.cut import drop, materialise
from .aggregates import degrees
from .blocks import dependencies_of_sources
from .searches import Held, closeness_of, dependencies_of, held
from .sets import undirected_view, vertices
from .weighted import Parts, counted


def degree_centrality(edges: DataFrame) -> DataFrame:
    """Degrees and volumes of every vertex with the degrees over N - 1."""
    d = degrees(edges)
    n = d.agg(F.count("*").alias("_n"))
    x = d.crossJoin(F.broadcast(n))  # one row
    share = lambda c: F.when(F.col("_n") > 1, F.col(c) / (F.col("_n") - 1)).otherwise(0.0)
    return x.withColumns({"centrality": share("degree"), "in_centrality": share("in_degree"), "out_centrality": share("out_degree")}).drop("_n")


def simple_edges(edges: DataFrame) -> DataFrame:
    """Distinct undirected edges a < b without loops."""
    return edges.where("from_address <> to_address").select(F.least("from_address", "to_address").alias("a"), F.greatest("from_address", "to_address").alias("b")).distinct()


def clustering_coefficient(edges: DataFrame) -> DataFrame:
    """(address, neighbours, triangles, clustering) over the undirected neighbour sets.

    Each edge is directed from the end of lower degree to the higher (ties by name), so a wedge starts at a vertex of few onward edges
    and a hub of any size makes none; each triangle is found once.
    """
    e = materialise(simple_edges(edges))
    deg = e.select(F.explode(F.array("a", "b")).alias("address")).groupBy("address").agg(F.count("*").alias("neighbours"))
    d = lambda end: deg.select(F.col("address").alias(end), F.col("neighbours").alias(f"_{end}"))
    up = F.struct("_a", "a") < F.struct("_b", "b")
    o = materialise(e.join(d("a"), "a").join(d("b"), "b").select(F.when(up, F.col("a")).otherwise(F.col("b")).alias("x"), F.when(up, F.col("b")).otherwise(F.col("a")).alias("y")))
    wedge = o.select("x", F.col("y").alias("y1")).join(o.select("x", F.col("y").alias("y2")), "x").where("y1 < y2")
    closed = wedge.join(e, (F.col("y1") == F.col("a")) & (F.col("y2") == F.col("b")))
    tri = closed.select(F.explode(F.array("x", "y1", "y2")).alias("address")).groupBy("address").agg(F.count("*").alias("triangles"))
    out = vertices(edges).join(deg, "address", "left").join(tri, "address", "left").fillna(0, ["neighbours", "triangles"])
    k = F.col("neighbours")
    return out.withColumn("clustering", F.when(k > 1, 2 * F.col("triangles") / (k * (k - 1))).otherwise(0.0))


def bfs(edges: DataFrame, sources: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(source, address, distance, sigma): hops from each source along the edges and the number of shortest paths; to the end of the graph if no depth is given.

    Levels are counted while they are written, folded when they are many and dropped at the end.
    """
    e = materialise(edges.where("from_address <> to_address").select(F.col("from_address").alias("address"), F.col("to_address").alias("_to")).distinct())
    front = materialise(sources.select(F.col("address").alias("source"), "address", F.lit(0).alias("distance"), F.lit(1.0).alias("sigma")).distinct())
    seen, k, n = Parts(front), 0, 1
    while n and (max_depth is None or k < max_depth):
        k += 1
        near = front.join(e, "address").groupBy("source", F.col("_to").alias("address")).agg(F.sum("sigma").alias("sigma"))
        new = near.join(seen.whole().select("source", "address"), ["source", "address"], "left_anti")
        front, n = counted(new.select("source", "address", F.lit(k).alias("distance"), "sigma"))
        seen.add(front)
    out = materialise(seen.whole())
    seen.drop()
    drop(e)
    return out


#: What the searches of one block of sources reach, at most, in rows.
REACHED = 200_000_000


def in_blocks(sources: DataFrame, size: int | None = None) -> list[DataFrame]:
    """The sources in blocks of about `size`, by hash, so that a search from all vertices keeps one block's rows at a time; without a size as many as reach REACHED rows if each reaches as many vertices."""
    n = sources.count()
    size = size or max(1, REACHED // max(1, n))
    blocks = max(1, -(-n // size))
    return [sources.where(F.pmod(F.xxhash64("address"), F.lit(blocks)) == k) for k in range(blocks)] if blocks > 1 else [sources]


def betweenness(edges: DataFrame, sources: DataFrame, max_depth: int | None = None, graph: Held | None = None) -> DataFrame:
    """(address, betweenness): Brandes' dependencies summed over the sources and scaled by 2 / ((n - 1)(n - 2)); shortest paths are counted, not listed.

    Sources are dealt to tasks that hold the graph (see searches.py). In a larger graph searches and the way back are products of cells (see blocks.py). Neither makes a row for a source and an edge.
    """
    every = vertices(edges)
    own = graph or held(edges)
    if own is not None:
        got, n = materialise(dependencies_of(own, sources, max_depth)), own.n
        if own is not graph:
            own.drop()
    else:
        got, n = dependencies_of_sources(edges, sources, max_depth)
    scale = 2 / ((n - 1) * (n - 2)) if n > 2 else 0.0
    return every.join(got.select("address", (F.col("delta") * scale).alias("betweenness")), "address", "left").fillna(0.0, ["betweenness"])


def betweenness_proxy(edges: DataFrame, more_than: int = 50) -> DataFrame:
    """Distinct accounts two steps away over 1000, for vertices of over `more_than` edges."""
    big = degrees(edges).where(F.col("degree") > more_than).select(F.col("address").alias("from_address"))
    links = edges.select("from_address", "to_address").distinct()
    first = links.join(big, "from_address", "left_semi").select(F.col("from_address").alias("address"), F.col("to_address").alias("via"))
    walks = first.join(links.select(F.col("from_address").alias("via"), F.col("to_address").alias("other")), "via").where("address <> other")
    reach = walks.select("address", "other").distinct().groupBy("address").agg(F.count("*").alias("reach"))
    return reach.withColumn("betweenness", F.col("reach") / 1000)


def closeness(edges: DataFrame, targets: DataFrame | None = None, max_depth: int | None = None, block: int | None = None, graph: Held | None = None) -> DataFrame:
    """(address, reachable, closeness) of the targets, or of every vertex: by distances to it along the edges, scaled by the share of vertices that reach it.

    Targets are dealt to tasks that hold the graph and keep a bit for each target and vertex (see searches.py). In a larger graph they are searched by joins, in
    blocks, one after the other. The work grows with targets times what each reaches.
    """
    every = vertices(edges) if targets is None else targets
    own = graph or held(edges)
    if own is not None:
        d = materialise(closeness_of(own, every, max_depth))
        if own is not graph:
            own.drop()
    else:
        d = _closeness_by_joins(edges, every, max_depth, block)
    n = vertices(edges).agg(F.count("*").alias("_n"))
    x = d.crossJoin(F.broadcast(n))  # one row
    return x.select("address", "reachable", F.when((F.col("_sum") > 0) & (F.col("_n") > 1), F.col("reachable") / F.col("_sum") * F.col("reachable") / (F.col("_n") - 1)).otherwise(0.0).alias("closeness"))


def _closeness_by_joins(edges: DataFrame, targets: DataFrame, max_depth: int | None, block: int | None) -> DataFrame:
    back = edges.select(F.col("to_address").alias("from_address"), F.col("from_address").alias("to_address"))
    d = None
    for part in in_blocks(targets, block):
        far = bfs(back, part, max_depth)
        got = materialise(far.groupBy(F.col("source").alias("address")).agg((F.count("*") - 1).alias("reachable"), F.sum("distance").alias("_sum")))
        drop(far)
        d = got if d is None else d.unionByName(got)
    return d


#: PageRank's lineage is cut by a written table after so many rounds.
ROUNDS_A_CUT = 5


def pagerank(edges: DataFrame, iterations: int = 20, damping: float = 0.85, weighted: bool = False, redistribute: bool = False) -> DataFrame:
    """(address, pagerank): (1 - d) / n + d * sum of rank / out-degree (or by volume share, weighted); with redistribute the rank of dead ends is shared by all.

    Each iteration is a join and a partial aggregation in which every vertex takes part with 0; each fifth result is written, so lineage and
    driver stay small.
    """
    w = F.col("total_volume").cast("double") if weighted else F.lit(1.0)
    e = edges.select(F.col("from_address").alias("address"), F.col("to_address").alias("_to"), w.alias("_w"))
    out = e.groupBy("address").agg(F.sum("_w").alias("_all"))
    links = materialise(e.join(out, "address").select("address", "_to", (F.col("_w") / F.col("_all")).alias("_share")))
    nodes = materialise(vertices(edges))
    n = nodes.count()
    if not n:
        return nodes.withColumn("pagerank", F.lit(0.0))
    rank, written = nodes.withColumn("pagerank", F.lit(1.0 / n)), None
    for k in range(1, iterations + 1):
        lost = 0.0
        if redistribute:
            lost = rank.join(out, "address", "left_anti").agg(F.sum("pagerank")).first()[0] or 0.0
        given = rank.join(links, "address").select(F.col("_to").alias("address"), (F.col("pagerank") * F.col("_share")).alias("_in"))
        got = given.unionByName(nodes.withColumn("_in", F.lit(0.0))).groupBy("address").agg(F.sum("_in").alias("_in"))
        rank = got.select("address", (F.lit((1 - damping) / n + damping * lost / n) + damping * F.col("_in")).alias("pagerank"))
        if redistribute or k == iterations or not k % ROUNDS_A_CUT:
            rank = materialise(rank)
            if written is not None:
                drop(written)
            written = rank
    return rank


def hubs(edges: DataFrame, accounts: DataFrame, clustering: DataFrame, threshold: int = 10) -> DataFrame:
    """Vertices of at least `threshold` edges with a score (0.3 degree / 100, 0.3 whole units of volume, 0.2 partners / 50, 0.2 (1 - clustering)) and a class."""
    d = degrees(edges).where(F.col("degree") >= threshold)
    p = undirected_view(edges).groupBy("address").agg(F.countDistinct("other").alias("partners"))
    x = d.join(p, "address").join(accounts.select("address", "node_type"), "address", "left").join(clustering.select("address", "clustering"), "address", "left")
    volume = F.floor((F.col("total_volume_in") + F.col("total_volume_out")) / 10**12)
    score = 0.3 * F.least(F.lit(1.0), F.col("degree") / 100) + 0.3 * F.least(F.lit(1), volume).cast("double") + 0.2 * F.least(F.lit(1.0), F.col("partners") / 50) + 0.2 * (1 - F.coalesce("clustering", F.lit(0.0)))
    ratio = F.col("out_degree") / (F.col("in_degree") + 1)
    kind = F.when(F.col("node_type") == "exchange", "exchange_hub").when(F.col("node_type") == "mixer", "mixer_hub").when(ratio > 10, "distribution_hub").when(ratio < 0.1, "collection_hub").otherwise("balanced_hub")
    return x.select("address", "degree", "in_degree", "out_degree", "partners", score.alias("score"), kind.alias("class"))


def label_propagation(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """(address, label): every vertex takes the most frequent label of its neighbours at once, of equal ones the smallest; starts from its own name.

    A neighbour counts once per direction of the edge. Counting is a partial aggregation on (vertex, label), so a hub is no hot task.
    """
    v = materialise(undirected_view(edges.where("from_address <> to_address")).select("address", "other"))
    label = materialise(vertices(edges).withColumn("label", F.col("address")))
    for _ in range(rounds):
        seen = v.join(label.select(F.col("address").alias("other"), F.col("label").alias("_l")), "other").groupBy("address", "_l").agg(F.count("*").alias("_n"))
        best = seen.groupBy("address").agg(F.min(F.struct((-F.col("_n")).alias("n"), "_l")).alias("best"))
        label = materialise(label.join(best, "address", "left").select("address", F.coalesce("best._l", "label").alias("label")))
    return label


def community_metrics(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """One row per community: members, edges inside and across, volume inside, density."""
    size = labels.groupBy("label").agg(F.count("*").alias("members"))
    a = labels.select(F.col("address").alias("from_address"), F.col("label").alias("label"))
    b = labels.select(F.col("address").alias("to_address"), F.col("label").alias("_b"))
    j = edges.join(a, "from_address").join(b, "to_address")
    inside = F.col("label") == F.col("_b")
    s = j.groupBy("label").agg(F.count(F.when(inside, 1)).alias("internal"), F.count(F.when(~inside, 1)).alias("external"), F.coalesce(F.sum(F.when(inside, F.col("total_volume"))), F.lit(0)).cast("decimal(38,0)").alias("internal_volume"))
    out = size.join(s, "label", "left").fillna(0, ["internal", "external"])
    m = F.col("members")
    return out.select("label", "members", "internal", "external", F.coalesce("internal_volume", F.lit(0)).cast("decimal(38,0)").alias("internal_volume"), F.when(m > 1, F.col("internal") / (m * (m - 1))).otherwise(0.0).alias("density"))


def community_totals(communities: DataFrame, labels: DataFrame, edges: DataFrame) -> DataFrame:
    """Count and sizes of communities, (internal - external) / edges as edge_balance, and Newman's Q."""
    c = communities.agg(F.count("*").alias("communities"), F.avg("members").alias("mean_size"), F.max("members").alias("max_size"), F.min("members").alias("min_size"), F.sum("internal").alias("internal"), F.sum("external").alias("external"))
    d = degrees(edges).join(labels, "address").groupBy("label").agg(F.sum("in_degree").cast("double").alias("i"), F.sum("out_degree").cast("double").alias("o")).agg(F.sum(F.col("i") * F.col("o")).alias("_io"))
    m = F.col("internal") + F.col("external")
    return c.crossJoin(d).select("communities", "mean_size", "max_size", "min_size", ((F.col("internal") - F.col("external")) / m).alias("edge_balance"), (F.col("internal") / m - F.col("_io") / (m * m)).alias("modularity_q"))


def weak_components(edges: DataFrame) -> DataFrame:
    """(address, component): the smallest address that is connected, whatever the direction."""
    c = components_of(edges, "from_address", "to_address").withColumnRenamed("node", "address")
    return vertices(edges).join(c, "address", "left").select("address", F.coalesce("component", "address").alias("component"))


def component_sizes(edges: DataFrame) -> DataFrame:
    return weak_components(edges).groupBy("component").agg(F.count("*").alias("size"))


def graph_density(edges: DataFrame) -> DataFrame:
    """One row: n, m, density, mean degree, reciprocity (mutual pairs over edges), components."""
    e = edges.select("from_address", "to_address").distinct()
    back = e.select(F.col("to_address").alias("from_address"), F.col("from_address").alias("to_address"))
    mutual = e.where("from_address < to_address").join(back, ["from_address", "to_address"], "left_semi").agg(F.count("*").alias("mutual"))
    n = vertices(edges).agg(F.count("*").alias("nodes"))
    c = component_sizes(edges).agg(F.count("*").alias("components"), F.max("size").alias("largest"))
    x = e.agg(F.count("*").alias("edges")).crossJoin(n).crossJoin(mutual).crossJoin(c)  # one row each
    pairs = F.col("nodes") * (F.col("nodes") - 1)
    return x.select("nodes", "edges", "components", "largest", F.when(pairs > 0, F.col("edges") / pairs).otherwise(0.0).alias("density"), F.when(F.col("nodes") > 0, 2 * F.col("edges") / F.col("nodes")).alias("mean_degree"), F.when(F.col("edges") > 0, F.col("mutual") / F.col("edges")).otherwise(0.0).alias("reciprocity"))


def common_neighbours_avg(edges: DataFrame) -> DataFrame:
    """(address, average): mean over a vertex's undirected neighbours of the neighbours they share: twice its triangles over its neighbours."""
    c = clustering_coefficient(edges)
    return c.select("address", F.when(F.col("neighbours") > 0, 2 * F.col("triangles") / F.col("neighbours")).otherwise(0.0).alias("average"))


def network_metrics(edges: DataFrame, sources: DataFrame | None = None, iterations: int = 20, block: int | None = None) -> DataFrame:
    """One row per vertex: degree centrality, clustering, pagerank, betweenness, closeness, common-neighbour average.

    Betweenness counts paths from the sources, and closeness is that of the sources (null for other vertices); without sources both take every
    vertex, in a graph that no task may hold block by block, and the work grows with vertices times what each reaches.
    """
    c = clustering_coefficient(edges)
    graph, asked, between = held(edges), vertices(edges) if sources is None else sources, None
    for part in in_blocks(asked, block) if graph is None else [asked]:
        got = betweenness(edges, part, graph=graph)
        between = got if between is None else between.unionByName(got)
    between = between.groupBy("address").agg(F.sum("betweenness").alias("betweenness"))
    near = closeness(edges, sources, block=block, graph=graph)
    if graph is not None:
        graph.drop()
    return (
        degree_centrality(edges).select("address", "degree", "centrality").join(c.select("address", "neighbours", "triangles", "clustering"), "address").join(pagerank(edges, iterations), "address")
        .join(between, "address").join(near.select("address", "closeness"), "address", "left")
        .withColumn("common_average", F.when(F.col("neighbours") > 0, 2 * F.col("triangles") / F.col("neighbours")).otherwise(0.0))
    )


def graph_metrics_cache(edges: DataFrame) -> DataFrame:
    """Degrees, volumes, first and last activity, triangles and mean volume per edge of each account."""
    v = undirected_view(edges).groupBy("address").agg(F.count("*").alias("degree"), F.sum("total_volume").cast("decimal(38,0)").alias("volume"), F.min("first_transfer_time").alias("first_seen"), F.max("last_transfer_time").alias("last_seen"), F.sum("transfer_count").alias("transfers"))
    return v.join(clustering_coefficient(edges).select("address", "triangles"), "address").withColumn("mean_volume", F.col("volume").cast("double") / F.col("degree"))


def node_profile(statistics: DataFrame, accounts: DataFrame) -> DataFrame:
    """Kind (exchange: over 1000 partners and 1e15 volume; validator by name; regular) and a tag for over 10 rapid pairs."""
    j = statistics.join(accounts.select("address", "display"), "address", "left")
    kind = F.when((F.col("unique_counterparties") > 1000) & (F.col("total_volume") > 10**15), "exchange").when(F.lower(F.coalesce("display", F.lit(""))).contains("validator"), "validator").otherwise("regular")
    return j.select("address", F.col("unique_counterparties").alias("degree"), "volume_in", "volume_out", "n_in", "n_out", kind.alias("kind"), F.array_join(F.array_compact(F.array(F.when(F.col("rapid_pairs") > 10, "High Activity"))), ",").alias("tags"))


def pagerank_report(ranks: DataFrame) -> DataFrame:
    """Each rank with its share of the mean (rank * n) and place."""
    n = ranks.agg(F.count("*").alias("_n"))
    return ranks.crossJoin(F.broadcast(n)).select("address", "pagerank", (F.col("pagerank") * F.col("_n")).alias("relative"))


def pagerank_convergence(ranks: DataFrame, below: float = 1e-4) -> DataFrame:
    """One row (vertices, total, mean, variance, deviation, converged): how far the ranks spread; converged if their variance is less than `below`."""
    g = ranks.agg(F.count("*").alias("vertices"), F.sum("pagerank").alias("total"), F.avg("pagerank").alias("mean"), F.var_pop("pagerank").alias("variance"))
    return g.withColumn("deviation", F.sqrt("variance")).withColumn("converged", F.coalesce(F.col("variance") < below, F.lit(False)))
