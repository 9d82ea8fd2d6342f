"""The strength of all edges folds the transfers into edges once, and flags transfers without meeting them by hash."""

from datetime import datetime, timedelta
from decimal import Decimal

import pytest

from tests.oracle import compare
from transfergraph import catalog
from transfergraph.operators import aggregates, scoring


@pytest.mark.parametrize("name", ["s14_score_report", "a9_score_distribution"])
def test_edges_are_built_once(spark, monkeypatch, name):
    built, build = [], aggregates.build_edges
    monkeypatch.setattr(aggregates, "build_edges", lambda t: built.append(1) or build(t))
    assert compare(spark, catalog.queries()[name], catalog.oracle_sql()[name]) > 1
    assert len(built) == 1


def test_transfers_of_one_hash_are_flagged_one_by_one(spark):
    at = datetime(2024, 1, 1, 12)
    rows = [("h", "a", "b", 0), ("h", "c", "d", 0), ("g", "b", "e", 60), ("f", "d", "e", 400), (None, "x", "b", 30)]
    t = spark.createDataFrame([(h, a, b, at + timedelta(seconds=s), Decimal(3)) for h, a, b, s in rows], "hash string, from_address string, to_address string, timestamp timestamp, value decimal(38,0)")
    got = sorted((r.from_address, r.to_address, r._rapid) for r in scoring.followed_quickly(t).collect())
    assert got == [("a", "b", 1), ("b", "e", None), ("c", "d", None), ("d", "e", None), ("x", "b", 1)]
