"""Decisions at exact ties, as the SQL engine makes them."""

import datetime

import duckdb
from pyspark.sql import functions as F

from transfergraph.catalog.windows import _round_scaled
from transfergraph.operators.alerts import dedup_alerts, priority_score
from transfergraph.operators.detectors import splitting_layers

START = datetime.datetime(2024, 1, 1)


def test_variance_of_just_the_limit(spark):
    """Amounts of 1 to 3 have a variance of exactly mean^2 / 4."""
    amounts = [(k, 3 * k) if k % 2 else (3 * k, k) for k in range(101, 2101)]
    rows = [(f"h{k}{i}", START + datetime.timedelta(hours=i), f"a{k:04}", "b", x * 10**10) for k, pair in enumerate(amounts) for i, x in enumerate(pair)]
    t = spark.createDataFrame(rows, "hash string, timestamp timestamp, from_address string, to_address string, value long")
    got = {r.address for r in splitting_layers(t, 100, 86400, 2, 1).collect()}
    db = duckdb.connect()
    x = ", ".join(f"({k}, {i}, {v}::DOUBLE * 1e10 / 1e12)" for k, pair in enumerate(amounts) for i, v in enumerate(pair))
    found = db.execute(f"SELECT k FROM (SELECT k, avg(x) AS m, var_pop(x) AS v FROM (SELECT * FROM (VALUES {x}) t(k, i, x) ORDER BY k, i) GROUP BY 1) WHERE v < m*m/4").fetchall()
    assert got == {f"a{k:04}" for (k,) in found} and 0 < len(got) < len(amounts)


def test_rounding_as_sql_rounds(spark):
    values = [k / 8 + 0.000001 * j + 65675.8263 for k in range(50) for j in range(40)] + [k / 10**5 + 5e-6 for k in range(3000)]
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    db = duckdb.connect()
    want = [db.execute("SELECT round(CAST(? AS DOUBLE), 4)", [v]).fetchone()[0] for v in values]
    assert [r.x for r in _round_scaled(df, "x", n=4).collect()] == want


def test_priority_to_the_last_bit(spark):
    """0.2 times a severity of 3 is 0.6, not what follows it."""
    a = spark.createDataFrame([("t", 0.1, 3, 0.0, START, 10)], "type string, confidence double, severity int, value double, last_seen timestamp, count long")
    accuracy = spark.createDataFrame([("t", 0.3)], "type string, accuracy double")
    as_of = spark.createDataFrame([(START,)], "as_of timestamp")
    got = priority_score(a, accuracy, as_of).select(F.col("priority")).first()[0]
    want = duckdb.sql("SELECT 0.25*0.1::DOUBLE + 0.2*3/4 + 0.2*least(1.0, log10(1+0::DOUBLE)/3) + 0.15*exp(-0::DOUBLE) + 0.1*least(1.0, 10/10) + 0.1*0.3::DOUBLE").fetchall()[0][0]
    assert got == want


def test_exponentials_and_logarithms_to_the_last_bit(spark):
    """Rows where the JVM's exp, log10 and pow have another last bit than the SQL engine's."""
    rows = [("t", 0.5, 2, k / 100, START + datetime.timedelta(seconds=977 * k), 1) for k in range(3000)]
    a = spark.createDataFrame(rows, "type string, confidence double, severity int, value double, last_seen timestamp, count long")
    at = START + datetime.timedelta(seconds=977 * 3000)
    accuracy = spark.createDataFrame([("t", 0.5)], "type string, accuracy double")
    got = {r.value: r.priority for r in priority_score(a, accuracy, spark.createDataFrame([(at,)], "as_of timestamp")).collect()}
    want = duckdb.sql("SELECT k/100, 0.25*0.5::DOUBLE + 0.2*2/4 + 0.2*least(1.0, log10(1+k/100)/3) + 0.15*exp(-(977000000*(3000-k))/1000000.0/86400) + 0.1*least(1.0, 1/10) + 0.1*0.5::DOUBLE FROM range(3000) t(k)").fetchall()
    assert got == dict(want)
    alerts = [(f"{n}-{i}", "t", f"a{n}", START, 0.1, 1, 0.0) for n in range(1, 25) for i in range(n)]
    deduped = dedup_alerts(spark.createDataFrame(alerts, "id string, type string, address string, timestamp timestamp, confidence double, severity int, value double"))
    powers = dict(duckdb.sql("SELECT n, CASE WHEN n > 1 THEN least(CAST(0.95 AS DOUBLE), 0.1::DOUBLE*pow(1.1, n-1)) ELSE 0.1::DOUBLE END FROM range(1, 25) t(n)").fetchall())
    assert {r["count"]: r.confidence for r in deduped.collect()} == powers
