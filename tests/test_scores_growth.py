"""What the strength of all edges shuffles grows with transfers and edges, not with walks or components; the scores are those of the single operators."""

import random
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from transfergraph.operators import aggregates, joins, scoring

TRANSFER = "hash string, block_number long, from_address string, to_address string, timestamp timestamp, value decimal(38,0)"


def shuffled_rows(spark) -> dict[int, int]:
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    lists = spark._jvm.java.util.ArrayList
    it = sc._jsc.sc().statusStore().stageList(lists(), False, False, sc._gateway.new_array(spark._jvm.double, 0), lists()).iterator()
    rows = {}
    while it.hasNext():
        stage = it.next()
        rows[stage.stageId()] = stage.shuffleWriteRecords()
    return rows


def rows_of(spark, run) -> int:
    before = shuffled_rows(spark)
    run()
    return sum(n for k, n in shuffled_rows(spark).items() if k not in before)


def graph(n: int, links: int, hubs: int = 0) -> list[tuple[str, str]]:
    r = random.Random(3)
    found = {(f"v{r.randrange(n)}", f"v{r.randrange(n)}") for _ in range(links)}
    found |= {(f"h{k}", f"v{j}") for k in range(hubs) for j in range(n)} | {(f"v{j}", f"h{k}") for k in range(hubs) for j in range(0, n, 2)}
    return sorted(found)


def by_hand(edges, pairs):
    links = {(a, b) for a, b in edges if a != b}
    ends = {a for e in links for a in e}
    return sorted((a, b, 0 if a == b else sum((a, x) in links and (x, b) in links for x in ends - {a, b})) for a, b in set(pairs))


@pytest.mark.parametrize("longest", [1, 6, 500])
def test_lists_of_any_length_give_the_same_counts(spark, longest):
    edges = graph(24, 120, hubs=2)
    pairs = edges[::3] + [("v1", "v2"), ("h0", "h1"), ("v3", "v3"), ("nobody", "v1"), ("v1", "nobody")]
    e, p = (spark.createDataFrame(x, "from_address string, to_address string") for x in (edges, pairs))
    for asked, want in ((None, edges), (p, pairs)):
        got = joins.common_connections(e, asked, longest=longest)
        assert dict(got.dtypes)["common"] == "bigint"
        assert sorted(map(tuple, got.collect())) == by_hand(edges, want)


def test_common_connections_send_a_row_for_each_pair(spark):
    edges = [(f"v{a:02}", f"v{b:02}") for a in range(45) for b in range(45) if a != b]  # 1,980 edges; 44 links at each end make 87,120 walks
    e = spark.createDataFrame(edges, "from_address string, to_address string")
    got, limit = [], "spark.sql.autoBroadcastJoinThreshold"
    was = spark.conf.get(limit)
    spark.conf.set(limit, "-1")  # as with tables too large to broadcast
    try:
        assert rows_of(spark, lambda: got.extend(joins.common_connections(e).collect())) < 15 * len(edges)
    finally:
        spark.conf.set(limit, was)
    assert len(got) == len(edges) and {r.common for r in got} == {43}


def transfers(spark, n: int):
    r = random.Random(5)
    start = datetime(2024, 1, 1)
    rows = []
    for k in range(n):
        at = start + timedelta(seconds=r.randrange(40 * 86400) if k % 3 else r.randrange(4000))
        rows.append((f"e{k}", k, f"v{r.randrange(12)}", f"v{r.randrange(12)}", at, Decimal(r.choice([10**12, 3 * 10**12, 25 * 10**10, 7]))))
    return spark.createDataFrame(rows, TRANSFER)


def test_scores_of_facts_are_those_of_the_components(spark):
    t = transfers(spark, 900)
    a = spark.createDataFrame([(f"v{k}", Decimal(k % 3 * 10**12), datetime(2023, 12, 20) + timedelta(days=3 * k)) for k in range(10)], "address string, balance decimal(38,0), created_at timestamp")
    as_of = t.agg(F.max("timestamp").alias("as_of"))
    e = aggregates.build_edges(t)
    network = e.select(*scoring.EDGE, (F.col("transfer_count") * 1.5).alias("network_score"))
    want = scoring.strength_score(scoring.volume_score(e, a), scoring.frequency_score(e, t), scoring.temporal_score(t, as_of), network, scoring.risk_score(t, a))
    got = scoring.strength_of_facts(scoring.edge_facts(t, a, as_of), a, network)
    assert len(want.take(101)) == 101
    key = lambda r: tuple(r[:2])
    assert sorted(map(tuple, got.select(*want.columns).collect()), key=key) == sorted(map(tuple, want.collect()), key=key)
    counts = lambda df: sorted(map(tuple, df.select(*scoring.EDGE, "transfer_count", "total_volume").collect()))
    assert counts(got) == counts(e)


def test_facts_shuffle_a_transfer_from_either_end_and_no_more(spark):
    n = 900
    t = transfers(spark, n)
    a = t.select(F.col("from_address").alias("address"), F.lit(None).cast("timestamp").alias("created_at")).limit(0)
    as_of = spark.createDataFrame([(datetime(2024, 3, 1),)], "as_of timestamp")
    assert rows_of(spark, lambda: scoring.edge_facts(t, a, as_of).collect()) <= 2 * n + 10
