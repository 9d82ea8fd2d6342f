"""A query of each family against its SQL; the driver compares all of them."""

import pytest

import __spark_entry__ as entry
from tests.oracle import compare
from transfergraph import catalog

NAMES = [
    "p2_transfers_for", "p18_identities", "j1_direct_connections", "j6_sequential_transfers", "j8_shared_destinations", "a4_transfer_statistics", "a8_volume_statistics", "w1_percent_rank", "w7_sessions", "w9_balance_profile", "l9_priority_of_correlated", "u4_graph_delta",
    "o7_search_ranked", "g1_enumerate_paths", "g4_shortest_path", "g14_clustering", "g15_betweenness", "g18_pagerank", "g20_label_propagation", "g22_components", "r6_strength", "d3_layering", "d19_detect_all", "n1_balance_anomalies", "n13_awakening",
    "c6_rings", "l8_correlate", "l10_priority_levels", "f6_normal_cdf", "f8_time_differences", "f16_path_arrays", "f19_json_groups", "q8_graph_validity", "m1_latency_stats", "s4_blocks", "st3_stream_edges", "st4_stream_rescore", "l14_run_pipeline", "g4_shortest_pairs", "g18_convergence", "st8_stream_sessions",
]


@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, name):
    compare(spark, catalog.queries()[name], catalog.oracle_sql()[name])


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(catalog.queries()) > 200


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "other_type" in df.columns


def test_queries_are_listed_without_a_session():
    import subprocess
    import sys
    from pathlib import Path

    root = Path(entry.__file__).parent
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=root, capture_output=True, text=True, check=True)
    assert int(out.stdout.split()[0]) > 200
