"""Closeness of every vertex, not of some."""

from tests.oracle import SF, compare
from transfergraph import catalog
from transfergraph.catalog.filters import _edges
from transfergraph.operators.sets import vertices


def test_closeness_of_every_vertex(spark):
    assert compare(spark, catalog.queries()["g17_closeness"], catalog.oracle_sql()["g17_closeness"]) == vertices(_edges(spark, SF)).count() > 1
