"""Analytics of query and application logs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .topk import topk
from .windows import linear_trend


def latency_stats(log: DataFrame, key: str = "operation", slow: float = 80.0) -> DataFrame:
    """Count, mean, extremes, nearest-rank p50, p95 and p99, and shares of errors and slow calls per key.

    Percentiles are found in a window by key, so a key of any number of rows is ordered by Spark's spilling sort.
    """
    w = Window.partitionBy(key).orderBy("duration", "id")
    n = F.count("*").over(Window.partitionBy(key))
    r = log.withColumn("_r", F.row_number().over(w)).withColumn("_n", n)
    at = lambda q: F.max(F.when(F.col("_r") == F.ceil(q * F.col("_n")), F.col("duration")))
    return r.groupBy(key).agg(
        F.count("*").alias("n"), F.avg("duration").alias("mean"), F.min("duration").alias("lowest"), F.max("duration").alias("highest"), at(0.5).alias("p50"), at(0.95).alias("p95"), at(0.99).alias("p99"),
        F.avg(F.col("failed").cast("double")).alias("error_rate"), F.avg((F.col("duration") > slow).cast("double")).alias("slow_rate"),
    )


def latency_trend(log: DataFrame, key: str = "operation", last: int = 50, limit: float = 0.2) -> DataFrame:
    """Slope of the last durations of each key over the first of them; degraded beyond the limit."""
    recent = topk(log, [key], [F.col("time").desc(), F.col("id").desc()], last)
    return linear_trend(recent, key, "duration", ["time", "id"]).withColumn("degraded", F.coalesce(F.col("relative") > limit, F.lit(False)))


def threshold_alerts(log: DataFrame, rules: dict[str, tuple[str, float, float]]) -> DataFrame:
    """(id, alert, level): each rule is a column with a warning and a critical limit."""
    alert = lambda name, column, warn, bad: F.when(F.col(column) >= bad, F.struct(F.lit(name).alias("alert"), F.lit("critical").alias("level"))).when(F.col(column) >= warn, F.struct(F.lit(name).alias("alert"), F.lit("warning").alias("level")))
    return log.select("id", F.explode(F.array_compact(F.array(*(alert(k, *v) for k, v in rules.items())))).alias("a")).select("id", "a.*")


def slowest_queries(log: DataFrame, key: str = "operation", n: int = 10) -> DataFrame:
    return log.groupBy(key).agg(F.avg("duration").alias("mean"), F.count("*").alias("n")).orderBy(F.col("mean").desc(), key).limit(n)


def health_score(stats: DataFrame, target: float = 100.0) -> DataFrame:
    """100 - 2 per cent of errors - 0.5 per cent of slow calls - 10 times the overshoot of the mean, from 0 to 100."""
    over = F.greatest(F.lit(0.0), F.col("mean") / target - 1)
    return stats.withColumn("health", F.least(F.lit(100.0), F.greatest(F.lit(0.0), 100 - 200 * F.col("error_rate") - 50 * F.col("slow_rate") - 10 * over)))


def request_flows(log: DataFrame) -> DataFrame:
    """Per request: events, components, total duration, time span, last status."""
    return log.groupBy("request").agg(
        F.count("*").alias("events"), F.array_join(F.array_sort(F.collect_set("component")), ",").alias("components"), F.sum("duration").alias("duration"), F.min("time").alias("start"), F.max("time").alias("end"),
        F.max_by("status", F.struct("time", "id")).alias("status"),
    )


def error_patterns(log: DataFrame) -> DataFrame:
    """(kind, value, n): errors by component, by type and by hour."""
    e = log.where("failed")
    by = lambda kind, c: e.groupBy(c.cast("string").alias("value")).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "value", "n")
    return reduce(DataFrame.unionByName, (by("component", F.col("component")), by("type", F.col("type")), by("hour", F.hour("time"))))


def performance_patterns(log: DataFrame, slow: float = 80.0) -> DataFrame:
    return log.groupBy("operation", "component").agg(F.count("*").alias("n"), F.avg("duration").alias("mean"), F.max("duration").alias("highest"), F.count(F.when(F.col("duration") > slow, 1)).alias("slow"))


def component_transitions(log: DataFrame) -> DataFrame:
    """(from_component, to_component, n) of consecutive events of a request in different components."""
    w = Window.partitionBy("request").orderBy("time", "id")
    return log.select(F.col("component").alias("from_component"), F.lead("component").over(w).alias("to_component")).where("from_component <> to_component").groupBy("from_component", "to_component").agg(F.count("*").alias("n"))


#: Classes of security events and what their lines hold.
SECURITY = {
    "authentication": "(?i)auth|login|password|token", "rate_limit": "(?i)rate.?limit|too many", "injection": "(?i)union select|drop table|<script", "access": "(?i)forbidden|unauthori[sz]ed|denied",
    "validation": "(?i)invalid|malformed", "network": "(?i)refused|timeout|unreachable",
}


def security_events(lines: DataFrame, column: str = "line") -> DataFrame:
    """(kind, n) of lines that match each class; a line may be in several."""
    hits = F.array_compact(F.array(*(F.when(F.col(column).rlike(p), k) for k, p in SECURITY.items())))
    return lines.select(F.explode(hits).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


def regression_compare(run: DataFrame, previous: DataFrame, key: str = "operation", limit: float = 0.1) -> DataFrame:
    """Mean duration of two runs and whether the new one is slower by more than the limit."""
    m = lambda df, name: df.groupBy(key).agg(F.avg("duration").alias(name))
    j = m(run, "now").join(m(previous, "before"), key)
    change: Column = F.col("now") / F.col("before") - 1
    return j.withColumn("change", change).withColumn("regressed", F.col("change") > limit)
