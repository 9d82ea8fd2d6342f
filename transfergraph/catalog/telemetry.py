from pyspark.sql import functions as F

from ..operators import telemetry as M
from ..sources import ledger as L
from .filters import T1, _ts
from .windows import _round


def _log(s, d):
    """The events as a log: value as duration, type as operation, user as request."""
    k = F.col("event_id")
    parts = F.array(*map(F.lit, ("api", "db", "cache")))
    return L.events(s, d).select(
        k.alias("id"), F.col("ts").alias("time"), F.col("event_type").alias("operation"), F.col("user_id").alias("request"), F.col("value").alias("duration"), F.element_at(parts, (k % 3 + 1).cast("int")).alias("component"), (F.col("event_type") == "error").alias("failed"),
        F.when(k % 2 == 0, "io").otherwise("logic").alias("type"), F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status"), F.concat_ws(" ", "event_type", "props", F.when(k % 9 == 0, "login denied").when(k % 10 == 0, "request timeout")).alias("line"),
    )


def _stats(s, d):
    return M.latency_stats(_log(s, d))


LOG = """WITH log AS (SELECT event_id AS id, ts AS time, event_type AS operation, user_id AS request, value AS duration, CASE event_id%3 WHEN 0 THEN 'api' WHEN 1 THEN 'db' ELSE 'cache' END AS component, event_type='error' AS failed,
 CASE WHEN event_id%2=0 THEN 'io' ELSE 'logic' END AS type, CASE WHEN event_type='error' THEN 500 ELSE 200 END AS status, concat_ws(' ', event_type, props, CASE WHEN event_id%9=0 THEN 'login denied' WHEN event_id%10=0 THEN 'request timeout' END) AS line FROM events)"""
STATS = LOG + ", st AS (SELECT operation, count(*) AS n, avg(duration) AS mean, min(duration) AS lowest, max(duration) AS highest, quantile_disc(duration,0.5) AS p50, quantile_disc(duration,0.95) AS p95, quantile_disc(duration,0.99) AS p99, avg(CAST(failed AS INTEGER)) AS error_rate, avg(CAST(duration > 80 AS INTEGER)) AS slow_rate FROM log GROUP BY 1)"
RULES = {"slow": ("duration", 150.0, 300.0), "failed": ("status", 400.0, 500.0)}

QUERIES = {
    "m1_latency_stats": (
        lambda s, d: _round(_stats(s, d), "mean", "error_rate", "slow_rate"),
        STATS + "SELECT operation, n, round(mean,6) AS mean, lowest, highest, p50, p95, p99, round(error_rate,6) AS error_rate, round(slow_rate,6) AS slow_rate FROM st",
    ),
    "m2_latency_trend": (
        lambda s, d: _round(M.latency_trend(_log(s, d)), "slope", "relative"),
        LOG + ", r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY operation ORDER BY time DESC, id DESC) AS rn FROM log) WHERE rn <= 50), x AS (SELECT operation, row_number() OVER (PARTITION BY operation ORDER BY time, id)-1 AS x, duration AS y FROM r), g AS (SELECT operation, count(*) AS n, regr_slope(y,x) AS s, arg_min(y,x) AS f FROM x GROUP BY 1) SELECT operation, n, round(s,6) AS slope, f AS first, round(CASE WHEN f <> 0 THEN s/f END,6) AS relative, coalesce(CASE WHEN f <> 0 THEN s/f END > 0.2, FALSE) AS degraded FROM g",
    ),
    "m3_threshold_alerts": (
        lambda s, d: M.threshold_alerts(_log(s, d), RULES),
        LOG + "SELECT id, 'slow' AS alert, CASE WHEN duration >= 300 THEN 'critical' ELSE 'warning' END AS level FROM log WHERE duration >= 150 UNION ALL SELECT id, 'failed', 'critical' FROM log WHERE status >= 500",
    ),
    "m4_slowest": (lambda s, d: _round(M.slowest_queries(_log(s, d), "operation", 3), "mean"), LOG + "SELECT operation, round(avg(duration),6) AS mean, count(*) AS n FROM log GROUP BY 1 ORDER BY avg(duration) DESC, 1 LIMIT 3"),
    "m5_health_score": (
        lambda s, d: _round(M.health_score(_stats(s, d), 45.0).select("operation", "health"), "health"),
        STATS + "SELECT operation, round(least(CAST(100 AS DOUBLE), greatest(CAST(0 AS DOUBLE), 100-200*error_rate-50*slow_rate-10*greatest(CAST(0 AS DOUBLE), mean/45-1))),6) AS health FROM st",
    ),
    "m6_request_flows": (
        lambda s, d: _round(M.request_flows(_log(s, d)), "duration", n=4),
        LOG + 'SELECT request, count(*) AS events, string_agg(DISTINCT component, \',\' ORDER BY component) AS components, round(sum(duration),4) AS duration, min(time) AS start, max(time) AS "end", arg_max(status, id) AS status FROM log GROUP BY 1',
    ),
    "m7_error_patterns": (
        lambda s, d: M.error_patterns(_log(s, d)),
        LOG + "SELECT 'component' AS kind, component AS value, count(*) AS n FROM log WHERE failed GROUP BY 2 UNION ALL SELECT 'type', type, count(*) FROM log WHERE failed GROUP BY 2 UNION ALL SELECT 'hour', CAST(hour(time) AS VARCHAR), count(*) FROM log WHERE failed GROUP BY 2",
    ),
    "m8_performance": (lambda s, d: _round(M.performance_patterns(_log(s, d)), "mean"), LOG + "SELECT operation, component, count(*) AS n, round(avg(duration),6) AS mean, max(duration) AS highest, count(*) FILTER (WHERE duration > 80) AS slow FROM log GROUP BY 1,2"),
    "m9_transitions": (
        lambda s, d: M.component_transitions(_log(s, d)),
        LOG + ", x AS (SELECT component AS from_component, lead(component) OVER (PARTITION BY request ORDER BY time, id) AS to_component FROM log) SELECT from_component, to_component, count(*) AS n FROM x WHERE from_component <> to_component GROUP BY 1,2",
    ),
    "m10_security": (
        lambda s, d: M.security_events(_log(s, d)),
        LOG + "SELECT 'authentication' AS kind, count(*) AS n FROM log WHERE regexp_matches(line,'(?i)auth|login|password|token') HAVING count(*) > 0 UNION ALL SELECT 'access', count(*) FROM log WHERE regexp_matches(line,'(?i)forbidden|unauthori[sz]ed|denied') HAVING count(*) > 0 UNION ALL SELECT 'network', count(*) FROM log WHERE regexp_matches(line,'(?i)refused|timeout|unreachable') HAVING count(*) > 0",
    ),
    "m12_regression": (
        lambda s, d: _round(M.regression_compare(_log(s, d).where(F.col("time") >= _ts(T1)), _log(s, d).where(F.col("time") < _ts(T1)), "operation", 0.02), "now", "before", "change"),
        LOG + f", g AS (SELECT operation, avg(duration) FILTER (WHERE time >= '{T1}') AS nw, avg(duration) FILTER (WHERE time < '{T1}') AS bf FROM log GROUP BY 1) SELECT operation, round(nw,6) AS now, round(bf,6) AS before, round(nw/bf-1,6) AS change, nw/bf-1 > 0.02 AS regressed FROM g",
    ),
}
