"""Amounts of 0: shares, fees, logarithms and costs."""

import math

import pytest
from pyspark.sql import functions as F

from transfergraph.functions.scalars import ieee_log10, ieee_ratio
from transfergraph.operators.sets import dedupe_edges_undirected
from transfergraph.operators.weighted import weighted_betweenness, weighted_closeness
from transfergraph.streaming.jobs import link_batch


def test_ratio_and_logarithm_of_nothing(spark):
    df = spark.createDataFrame([(0, 0), (3, 0), (-3, 0), (1, 4), (None, 0), (1, None)], "a int, b int")
    got = [r[0] for r in df.select(ieee_ratio(F.col("a"), F.col("b"))).collect()]
    assert math.isnan(got[0]) and got[1:] == [math.inf, -math.inf, 0.25, None, None]
    assert [r[0] for r in spark.createDataFrame([(0.0,), (100.0,)], "x double").select(ieee_log10(F.col("x"))).collect()] == [-math.inf, 2.0]


def test_edges_of_volume_zero(spark):
    e = spark.createDataFrame([("a", "b", 1, 0), ("c", "d", 1, 10), ("d", "c", 1, 90)], "from_address string, to_address string, transfer_count long, total_volume long")
    assert {r.address_a: r.direction for r in dedupe_edges_undirected(e).collect()} == {"a": "outgoing", "c": "incoming"}


def test_fees_on_nothing(spark):
    sent = spark.createDataFrame([(1, 0), (2, 0), (3, 100), (4, 0)], "message long, sent_value long")
    received = spark.createDataFrame([(1, 0, True), (2, 0, False), (3, 90, True), (4, 1, True)], "message long, received_value long, charged boolean")
    assert {r.message: r.status for r in link_batch(sent, received).collect()} == {1: "suspicious_fee", 2: "completed", 3: "suspicious_fee", 4: "invalid"}
    assert {r.message: r.status for r in link_batch(sent, received.drop("charged")).collect()}[2] == "suspicious_fee"


COSTED = "from_address string, to_address string, cost long"


def test_costs_of_zero(spark):
    e = spark.createDataFrame([("a", "b", 0), ("b", "c", 5), ("a", "d", 5), ("d", "c", 0)], COSTED)
    got = {r.address: r.betweenness for r in weighted_betweenness(e, spark.createDataFrame([("a",)], "address string")).collect()}
    assert got == pytest.approx({"a": 0, "b": 1 / 6, "c": 0, "d": 1 / 6})  # half of a's two paths to c, times 2 / (3 * 2)
    near = weighted_closeness(e, spark.createDataFrame([("c",), ("b",)], "address string")).collect()
    assert {r.address: r.reachable for r in near} == {"b": 1, "c": 3} and {r.address: r.closeness for r in near}["c"] == pytest.approx(3 / 10)


def test_a_circle_of_cost_zero_is_refused(spark):
    e = spark.createDataFrame([("a", "b", 0), ("b", "a", 0), ("b", "c", 1)], COSTED)
    seeds = spark.createDataFrame([("a",)], "address string")
    assert weighted_closeness(e, seeds).count() == 1
    with pytest.raises(ValueError, match="circle"):
        weighted_betweenness(e, seeds)
