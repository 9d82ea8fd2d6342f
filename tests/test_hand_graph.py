"""The hand graph: A>B 100 (2), B>C 95, C>A 90, A>D 500 (5), D>C 10, E>F 7, F>E 7."""

import pytest
from pyspark.sql import functions as F

from transfergraph.operators import aggregates, coordination, metrics, paths, sets, windows
from transfergraph.operators.joins import two_hop_pairs
from transfergraph.plans.components import connected_components

EDGES = [("A", "B", 2, 100), ("B", "C", 1, 95), ("C", "A", 1, 90), ("A", "D", 5, 500), ("D", "C", 1, 10), ("E", "F", 1, 7), ("F", "E", 1, 7)]


@pytest.fixture(scope="module")
def edges(spark):
    e = spark.createDataFrame(EDGES, "from_address string, to_address string, transfer_count long, total_volume long")
    t = F.lit("2024-01-01").cast("timestamp")
    return e.withColumn("total_volume", F.col("total_volume").cast("decimal(38,0)")).withColumns({"first_transfer_block": F.lit(1).cast("long"), "last_transfer_block": F.lit(2).cast("long"), "first_transfer_time": t, "last_transfer_time": t}).cache()


def one(spark, a="A"):
    return spark.createDataFrame([(a,)], "address string")


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_degrees_and_components(edges):
    assert ("A", 2, 1) in rows(aggregates.degrees(edges), "address", "out_degree", "in_degree")
    assert ("C", 1, 2) in rows(aggregates.degrees(edges), "address", "out_degree", "in_degree")
    assert rows(metrics.component_sizes(edges), "component", "size") == [("A", 4), ("E", 2)]


def test_cycles(spark, edges):
    c = paths.circular_flows(edges, one(spark), 5).withColumn("path", F.array_join("path", ""))
    assert [(p, int(b)) for p, b in rows(c, "path", "bottleneck")] == [("ABCA", 90), ("ADCA", 10)]
    assert rows(coordination.rings(edges, 5, 2).withColumn("p", F.array_join("path", "")), "p") == [("ABCA",), ("ADCA",), ("EFE",)]


def test_shortest_path(spark, edges):
    s = paths.shortest_path(edges, one(spark), 4).withColumn("p", F.array_join("path", ""))
    assert ("C", 2, "ABC") in rows(s, "end", "hops", "p")


def test_all_paths(spark, edges):
    pair = spark.createDataFrame([("A", "C")], "seed string, target string")
    assert rows(paths.all_paths(edges, pair, 3).withColumn("p", F.array_join("path", "")), "p") == [("ABC",), ("ADC",)]


def test_clustering_density_reciprocity(edges):
    c = {r.address: r.clustering for r in metrics.clustering_coefficient(edges).collect()}
    assert c["A"] == pytest.approx(2 / 3) and c["E"] == 0
    d = metrics.graph_density(edges).first()
    assert d.reciprocity == pytest.approx(1 / 7) and d.density == pytest.approx(7 / 30)


def test_two_hops(edges):
    assert [(a, b, c, int(v)) for a, b, c, v in rows(two_hop_pairs(edges).where("origin = 'A'"), "origin", "via", "destination", "bottleneck")] == [("A", "B", "C", 95), ("A", "D", "C", 10)]


def test_pagerank_sums_with_redistribution(edges):
    total = metrics.pagerank(edges, 10, redistribute=True).agg(F.sum("pagerank")).first()[0]
    assert total == pytest.approx(1.0)


def test_empty(spark, edges):
    none = edges.limit(0)
    assert metrics.pagerank(none, 2).count() == 0
    assert metrics.weak_components(none).count() == 0
    assert metrics.clustering_coefficient(none).count() == 0
    assert paths.enumerate_paths(none, one(spark), 3).count() == 0
    assert sets.dedupe_edges_undirected(none).count() == 0


def test_large_volumes_are_exact(spark):
    big = 2**70
    e = spark.createDataFrame([("A", "B", str(big)), ("A", "B", "1")], "from_address string, to_address string, value string").withColumn("value", F.col("value").cast("decimal(38,0)"))
    assert int(e.groupBy("from_address").agg(aggregates.total("value").alias("v")).first().v) == big + 1


def test_components_of_a_chain(spark):
    chain = spark.range(200).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    got = connected_components(chain)
    assert got.count() == 201 and got.where("component <> 0").count() == 0


def test_rank_by_histogram(spark):
    df = spark.createDataFrame([(1,), (2,), (2,), (5,), (None,)], "x long")
    assert [(r.x, r.share) for r in windows.strict_rank_fraction(df, "x", "share").orderBy("x").collect()] == [(None, None), (1, 0.0), (2, 0.25), (2, 0.25), (5, 0.75)]


def test_shortest_path_of_pairs(spark, edges):
    pairs = spark.createDataFrame([("A", "C"), ("A", "C"), ("B", "A"), ("A", "E"), ("A", "A"), ("C", "D")], "seed string, target string")
    s = paths.shortest_path_of_pairs(edges, pairs, 4).withColumn("p", F.array_join("path", ""))
    assert rows(s, "seed", "end", "hops", "p") == [("A", "C", 2, "ABC"), ("B", "A", 2, "BCA"), ("C", "D", 2, "CAD")]
    assert paths.shortest_path_of_pairs(edges, pairs.limit(0), 4).count() == 0


def test_spread_of_ranks(spark):
    r = metrics.pagerank_convergence(spark.createDataFrame([("a", 0.2), ("b", 0.4)], "address string, pagerank double")).first()
    assert r.vertices == 2 and r.mean == pytest.approx(0.3) and r.variance == pytest.approx(0.01) and not r.converged
    assert not metrics.pagerank_convergence(spark.createDataFrame([], "address string, pagerank double")).first().converged
