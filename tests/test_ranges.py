"""Joins by time: as-of values by blocks, cells of a grid that are split, the kept full-text index."""

import datetime
import itertools
import random
from collections import Counter
from decimal import Decimal

from pyspark.sql import functions as F

from transfergraph.operators import coordination as C
from transfergraph.operators import joins as J
from transfergraph.operators import kept_index as K
from transfergraph.plans.ranges import as_of, join_cells

START = datetime.datetime(2024, 1, 1)


def test_as_of_against_a_scan(spark):
    r = random.Random(4)
    left = [(k, r.choice("ab") if k else None, r.choice([r.randrange(1000), None] if k % 9 == 0 else [r.randrange(1000)]), "kept") for k in range(200)]
    right = [(r.choice("ab"), r.choice([r.randrange(0, 900, 50), None]), r.choice([None, r.random()]), "not kept") for _ in range(60)]
    lf = spark.createDataFrame(left, "id long, k string, t long, price string").withColumnRenamed("price", "note").repartition(3)
    rf = spark.createDataFrame(right, "k string, u long, price double, note string").repartition(3)
    for on, width in ((["k"], 70), (["k"], 10_000), (None, 90)):
        got = {x.id: x.price for x in as_of(lf, rf, "t", "u", "price", width, on).collect()}
        want = {}
        for i, k, t, _ in left:
            seen = [(u, p) for kk, u, p, _ in right if t is not None and u is not None and p is not None and u <= t and (on is None or (k is not None and kk == k))]
            want[i] = max(seen)[1] if seen else None
        assert got == want
    assert as_of(lf.limit(0), rf, "t", "u", "price", 70).count() == 0
    assert as_of(lf, rf.limit(0), "t", "u", "price", 70).where("price is not null").count() == 0


def test_cells_are_split_without_losing_or_doubling_pairs(spark):
    r = random.Random(6)
    left = [(r.choice([1, 1, 1, 2, None]), k) for k in range(90)] + [(3, 7)] * 4
    right = [(r.choice([1, 1, 2, 4]), k) for k in range(70)] + [(3, 8)] * 3
    lf, rf = spark.createDataFrame(left, "c long, x long"), spark.createDataFrame(right, "c long, y long")
    want = Counter((a, x, y) for (a, x), (b, y) in itertools.product(left, right) if a == b)
    for limit in (2, 7, 1000):
        assert Counter(map(tuple, join_cells(lf, rf, ["c"], limit).select("c", "x", "y").collect())) == want


def test_no_task_meets_all_of_a_busy_bucket(spark):
    """All events lie in one bucket: with blocks of 500 rows no key of the join holds more than about that of either side."""
    df = spark.range(6000).select(F.lit(1).alias("c"), F.col("id").alias("x"))
    other = df.withColumnRenamed("x", "y")
    cells = join_cells(df, other, ["c"], 500)
    parts = cells.select(F.pmod(F.xxhash64("x"), F.lit(12)).alias("i"), F.pmod(F.xxhash64("y"), F.lit(12)).alias("j"), "x", "y").groupBy("i", "j").agg(F.count("*").alias("pairs"))
    got = parts.agg(F.count("*").alias("cells"), F.sum("pairs").alias("pairs"), F.max("pairs").alias("most")).first()
    assert got.cells == 144 and got.pairs == 36_000_000 and got.most < 2 * 500 * 500


def test_near_pairs_in_blocks(spark):
    r = random.Random(7)
    rows = [(f"h{k}", START + datetime.timedelta(seconds=r.randrange(200)), f"a{r.randrange(9)}", "b", Decimal(r.choice([0, 0, 100, 104, 106, 111, 5000]))) for k in range(150)]
    t = spark.createDataFrame(rows, "hash string, timestamp timestamp, from_address string, to_address string, value decimal(38,0)")
    seconds = lambda x, y: abs((x[1] - y[1]).total_seconds())
    near = Counter((x[2], y[2], seconds(x, y)) for x, y in itertools.product(rows, rows) if x[2] < y[2] and seconds(x, y) <= 20)
    alike = Counter((x[2], y[2]) for x, y in itertools.product(rows, rows) if x[2] < y[2] and seconds(x, y) <= 20 and abs(x[4] - y[4]) <= 0.05 * float(max(x[4], y[4])))
    for limit in (10, 10_000):
        got = J.time_proximity_pairs(t.select(F.col("from_address").alias("address"), "timestamp"), 20, limit=limit)
        assert Counter(map(tuple, got.collect())) == near
        got = C.volume_coordination(t, 20, 0.05, 1, limit)
        assert {(x.address_a, x.address_b): x.events for x in got.collect()} == alike


def test_index_grows_by_batches_and_is_not_shuffled(spark):
    rows = [(f"a{k}", f"Name {k % 5}", "Legal entity" if k % 3 else None) for k in range(40)]
    every = spark.createDataFrame([*rows, (None, "Name 1", None)], "address string, display string, legal string")
    queries = spark.createDataFrame([("name 3",), ("LEGAL a7",), ("nothing",)], "query string")
    K.drop_index(spark, "postings_test")
    try:
        assert K.add_to_index(every.limit(15), ["address", "display", "legal"], "postings_test", 4) == 15
        assert K.add_to_index(every, ["address", "display", "legal"], "postings_test", 4) == 25
        assert K.add_to_index(every, ["address", "display", "legal"], "postings_test", 4) == 0
        found = K.search_index(queries, "postings_test")
        figures = lambda df: {(r.query, r.address): (r.matched, round(r.rank, 9)) for r in df.collect()}
        assert figures(found) == figures(J.fulltext_search(every.where("address is not null"), queries, ["address", "display", "legal"]))
        plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        tree = plan.split("Exchange hashpartitioning(token")
        assert len(tree) == 2 and "postings_test" not in tree[1].split("FileScan")[0], "the terms alone are dealt by token"
    finally:
        K.drop_index(spark, "postings_test")
