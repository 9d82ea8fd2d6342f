"""Priority with correlated alerts, on hand-made rows."""

import datetime

import pytest

from transfergraph.operators import alerts as A

NOON = datetime.datetime(2024, 5, 1, 12)
KINDS = "id string, type string, address string, timestamp timestamp, confidence double, severity int, value double, metadata map<string,string>"


def scored(spark, rows, window=300):
    alerts = A.with_correlated(spark.createDataFrame(rows, KINDS), window)
    accuracy = spark.createDataFrame([("burst", 0.9)], "type string, accuracy double")
    accounts = spark.createDataFrame([("rich", 2 * 10**15), ("poor", 5)], "address string, balance long")
    return {r.id: r for r in A.priority_of_correlated(alerts, accuracy, accounts, spark.createDataFrame([(NOON,)], "t timestamp"), systemic=("slashing",)).collect()}


def test_parts_and_modifiers(spark):
    at = NOON - datetime.timedelta(minutes=30)
    night = NOON.replace(hour=3)
    got = scored(spark, [
        ("plain", "burst", "poor", at, 0.5, 2, 0.0, {}),
        ("nulls", "other", None, at, 0.5, 2, None, None),
        ("rich", "burst", "rich", at, 0.5, 2, 0.0, {}),
        ("night", "burst", "a", night, 0.5, 2, 0.0, {"known_pattern": "true"}),
        ("slashing", "slashing", "b", NOON - datetime.timedelta(hours=100), 2.0, 4, 100_000.0, {}),
        ("boosted", "MIXING_PATTERNS", "c", at, 1.0, 4, 1e9, {}),
    ])
    base = 0.25 * 0.5 + 0.2 * 0.67 + 0.1 * 0.5
    assert got["plain"].priority == pytest.approx(base + 0.15 + 0.09)
    assert got["nulls"].priority == pytest.approx(base + 0.15 + 0.05)
    assert got["rich"].priority == pytest.approx((base + 0.15 + 0.09) * 1.15)
    assert got["night"].priority == pytest.approx((base + 0.15 * 0.6 + 0.09) * 0.8 * 1.1)
    assert got["slashing"].priority == pytest.approx(0.25 + 0.2 + 0.2 * 0.8 + 0.15 * 0.2 + 0.05 + 0.05)
    assert got["boosted"].priority == 1.0, "never above 1"


def test_groups_are_anchored_at_their_first_alert(spark):
    at = lambda s: NOON - datetime.timedelta(hours=2) + datetime.timedelta(seconds=s)
    rows = [(f"x{s}", "burst", "x", at(s), 0.5, 1, 0.0, {}) for s in (0, 200, 300, 301, 601, 602)] + [("y", "burst", "y", at(100), 0.5, 1, 0.0, {})]
    got = scored(spark, rows)
    assert {k: r.correlated for k, r in got.items()} == {"x0": 2, "x200": 2, "x300": 2, "x301": 1, "x601": 1, "x602": 0, "y": 0}
    assert scored(spark, []) == {}


def test_known_patterns_of_alerts_with_one_id(spark):
    """Two alerts of one type, address and time have one id, but flags of their own."""
    rows = [("same", "burst", "a", NOON, 0.5, 2, 0.0, {"routine": "true"}), ("same", "burst", "a", NOON, 0.6, 2, 0.0, {"routine": "false", "reward": "true"}), ("none", "burst", "b", NOON, 0.7, 2, 0.0, None), ("other", "mixing", "a", NOON, 0.8, 2, 0.0, {"routine": "true"})]
    rules = spark.createDataFrame([("burst", "routine"), ("burst", "known"), ("mixing", "reward")], "type string, flag string")
    assert sorted(r.confidence for r in A.known_pattern_filter(spark.createDataFrame(rows, KINDS), rules).collect()) == [0.6, 0.7, 0.8]
