"""Plan helpers against plain joins."""

from collections import Counter

import pytest

from transfergraph.plans.hot import join_counted


@pytest.mark.parametrize("parts", [1, 10, 1000])
def test_join_of_hot_keys_is_a_join(spark, parts):
    rows = [(k if k % 3 else 7, f"v{k}") for k in range(300)] + [(None, "none"), (7, "v0"), (999, "no match")]
    big = spark.createDataFrame(rows, "k long, v string")
    n = Counter(k for k, _ in rows)
    keyed = spark.createDataFrame([(k, n[k], f"x{k}") for k in n if k is not None and k != 999] + [(5000, 0, "unused")], "k long, n long, x string")
    out = join_counted(big, keyed, ["k"], "n", parts)
    assert out.columns == ["k", "v", "x"]
    assert Counter(map(tuple, out.collect())) == Counter((k, v, f"x{k}") for k, v in rows if k is not None and k != 999)


def test_join_of_nothing(spark):
    big, keyed = spark.createDataFrame([], "k long, v string"), spark.createDataFrame([], "k long, n long, x string")
    assert join_counted(big, keyed, ["k"], "n").count() == 0
