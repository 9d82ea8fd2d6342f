from pyspark.sql import functions as F

from ..operators import alerts as L_
from ..sources import ledger as L
from .base import LEDGER
from .windows import _round

def _meta():
    k = F.col("detection_id")
    return F.create_map(F.lit("maintenance"), (k % 13 == 0).cast("string"), F.lit("routine"), (k % 5 == 0).cast("string"), F.lit("reward"), (k % 17 == 0).cast("string"))


def _detections(s, d):
    return L.detections(s, d).withColumn("value", F.col("confidence") * 100).withColumn("metadata", _meta()).withColumn("severity", F.when(F.col("detection_id") % 3 != 0, F.col("severity")))


def _alerts(s, d):
    return L_.format_alerts(_detections(s, d))


def _rules(s, d):
    return L.events(s, d).agg(F.max("event_id")).select(F.explode(F.array(F.struct(F.lit("view").alias("type"), F.lit("reward").alias("flag")), F.struct(F.lit("click").alias("type"), F.lit("routine").alias("flag")))).alias("r")).select("r.*")


def _white(s, d):
    return L.accounts(s, d).where("node_type = 'validator'")


def _feedback(s, d):
    return L.detections(s, d).where("reviewed").select(F.col("pattern_type").alias("type"), (~F.col("false_positive")).alias("true_positive"))


def _as_of(s, d):
    return L.events(s, d).agg(F.max("ts").alias("as_of"))


def _scored(s, d):
    return L_.priority_score(L_.dedup_alerts(_alerts(s, d)), L_.detector_accuracy(_feedback(s, d)), _as_of(s, d))


def _correlated(s, d):
    return L_.priority_of_correlated(L_.with_correlated(_alerts(s, d), 7200), L_.detector_accuracy(_feedback(s, d)), L.accounts(s, d), _as_of(s, d), ("click",), ("error",), "reward", 5000.0)


def _stages(s, d):
    a = _alerts(s, d)
    b = L_.whitelist_filter(a, _white(s, d), L.accounts(s, d))
    c = L_.known_pattern_filter(b, _rules(s, d))
    e = L_.context_filter(c, ["maintenance"], {"routine": 0.8})
    return L_.reduction_report([("formatted", a), ("whitelist", b), ("known", c), ("context", e)])


ALERTS = LEDGER + """, al AS (SELECT detection_id, sha256(concat(pattern_type,'|',address,'|',CAST(epoch_us(detected_at) AS VARCHAR))) AS id, pattern_type AS type, address, detected_at AS timestamp, confidence, detection_id%13=0 AS maintenance, detection_id%5=0 AS routine, detection_id%17=0 AS reward,
 CASE WHEN detection_id%3<>0 THEN CASE severity WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 ELSE 4 END WHEN confidence > 0.8 THEN 3 WHEN confidence > 0.5 THEN 2 ELSE 1 END AS severity, confidence*100 AS value FROM det)"""
WHITE = ", wl AS (SELECT al.* REPLACE (CASE WHEN node_type='exchange' THEN greatest(1, severity-1) ELSE severity END AS severity, CASE WHEN node_type='exchange' THEN confidence*0.7 ELSE confidence END AS confidence) FROM al LEFT JOIN a USING (address) WHERE address NOT IN (SELECT address FROM a WHERE node_type='validator'))"
KNOWN = ", kp AS (SELECT * FROM wl WHERE NOT (type='view' AND reward) AND NOT (type='click' AND routine))"
CONTEXT = ", cx AS (SELECT * REPLACE (CASE WHEN routine THEN confidence*0.8 ELSE confidence END AS confidence) FROM kp WHERE NOT maintenance)"
DEDUP = ", dd AS (SELECT type, address, epoch_us(timestamp)//60000000 AS minute, min(id) AS id, count(*) AS count, min(timestamp) AS first_seen, max(timestamp) AS last_seen, max(severity) AS severity, sum(value) AS value, CASE WHEN count(*) > 1 THEN least(CAST(0.95 AS DOUBLE), max(confidence)*pow(1.1, count(*)-1)) ELSE max(confidence) END AS confidence FROM al GROUP BY 1,2,3)"
ACC = ", ac AS (SELECT pattern_type AS type, count(*) AS n, CASE WHEN count(*) >= 10 THEN count(*) FILTER (WHERE NOT false_positive)/count(*) ELSE 0.5 END AS accuracy FROM det WHERE reviewed GROUP BY 1)"
PRIORITY = ", pr AS (SELECT dd.*, (0.25*confidence + 0.2*severity/4 + 0.2*least(1.0, log10(1+value)/3) + 0.15*exp(-((SELECT epoch_us(max(ts)) FROM events)-epoch_us(last_seen))/1000000.0/86400) + 0.1*least(1.0, count/10) + 0.1*coalesce(accuracy,0.5)) * CASE severity WHEN 4 THEN 1.2 WHEN 1 THEN 0.8 ELSE 1.0 END AS priority FROM dd LEFT JOIN ac USING (type))"
LEVEL = ", lv AS (SELECT *, rank() OVER (ORDER BY priority DESC) AS rank, CASE WHEN (rank() OVER (ORDER BY priority DESC)-1)/count(*) OVER () < 0.05 THEN 'critical' WHEN (rank() OVER (ORDER BY priority DESC)-1)/count(*) OVER () < 0.2 THEN 'high' WHEN (rank() OVER (ORDER BY priority DESC)-1)/count(*) OVER () < 0.5 THEN 'medium' ELSE 'low' END AS level FROM pr)"
SHOW = "id, type, address, round(confidence,6) AS confidence, severity"
_show = lambda df: _round(df.select("id", "type", "address", "confidence", "severity"), "confidence")
ERF = "(1 - (((((1.061405429*tt - 1.453152027)*tt) + 1.421413741)*tt - 0.284496736)*tt + 0.254829592)*tt*exp(-zz*zz))"
SIGNIFICANT = f""", bs AS (SELECT type, count(value) AS bn, avg(value) AS mn, stddev_samp(value) AS sd FROM cx GROUP BY 1), z AS (SELECT cx.*, CASE WHEN bn >= 30 AND sd > 0 THEN abs((value-mn)/sd)/sqrt(2) END AS zz, 1/(1+0.3275911*zz) AS tt FROM cx JOIN bs USING (type)),
 sg AS (SELECT * FROM z WHERE zz IS NULL OR 2*(1-0.5*(1+CASE WHEN zz > 0 THEN {ERF} ELSE 0 END)) >= 0.05)"""
HEURISTIC = ", hx AS (SELECT * REPLACE (CASE WHEN sc > 0.7 THEN least(CAST(0.95 AS DOUBLE), confidence*1.1) ELSE confidence*0.8 END AS confidence) FROM (SELECT *, 0.5+0.2*confidence+0.15*least(severity,3)/3+CASE WHEN value > 0 THEN 0.1 ELSE 0 END+0.1 AS sc FROM sg) WHERE sc > 0.3)"

CORRELATED = ALERTS.replace("WITH n_", "WITH RECURSIVE n_", 1) + """, o AS (SELECT *, epoch_us(timestamp) AS us, row_number() OVER (PARTITION BY address ORDER BY epoch_us(timestamp), type, confidence) AS i FROM al),
 w AS (SELECT id, address, i, us, us AS anchor FROM o WHERE i = 1 UNION ALL SELECT o.id, o.address, o.i, o.us, CASE WHEN o.us - w.anchor <= 7200000000 THEN w.anchor ELSE o.us END FROM w JOIN o ON o.address = w.address AND o.i = w.i+1),
 co AS (SELECT o.*, count(*) OVER (PARTITION BY o.address, w.anchor) - 1 AS correlated, ((SELECT epoch_us(max(ts)) FROM events) - o.us)/3600000000.0 AS hours FROM o JOIN w ON o.address = w.address AND o.i = w.i)"""

QUERIES = {
    "l1_format_alerts": (lambda s, d: _show(_alerts(s, d)), ALERTS + f"SELECT {SHOW} FROM al"),
    "l2_dedup_alerts": (lambda s, d: _round(L_.dedup_alerts(_alerts(s, d)).drop("value"), "confidence"), ALERTS + DEDUP + "SELECT type, address, minute, id, count, first_seen, last_seen, severity, round(confidence,6) AS confidence FROM dd"),
    "l3_whitelist": (lambda s, d: _show(L_.whitelist_filter(_alerts(s, d), _white(s, d), L.accounts(s, d))), ALERTS + WHITE + f"SELECT {SHOW} FROM wl"),
    "l4_known_patterns": (lambda s, d: _show(L_.known_pattern_filter(_alerts(s, d), _rules(s, d))), ALERTS + f"SELECT {SHOW} FROM al WHERE NOT (type='view' AND reward) AND NOT (type='click' AND routine)"),
    "l5_context": (lambda s, d: _show(L_.context_filter(_alerts(s, d), ["maintenance"], {"routine": 0.8})), ALERTS + f"SELECT id, type, address, round(CASE WHEN routine THEN confidence*0.8 ELSE confidence END,6) AS confidence, severity FROM al WHERE NOT maintenance"),
    "l6_significance": (
        lambda s, d: _round(L_.significance_filter(_alerts(s, d), 30, 0.3).select("id", "p"), "p"),
        ALERTS + f", bs AS (SELECT type, count(value) AS n, avg(value) AS mn, stddev_samp(value) AS sd FROM al GROUP BY 1), z AS (SELECT id, abs((value-mn)/sd)/sqrt(2) AS zz, 1/(1+0.3275911*abs((value-mn)/sd)/sqrt(2)) AS tt FROM al JOIN bs USING (type) WHERE n >= 30), p AS (SELECT id, 2*(1-0.5*(1+CASE WHEN zz > 0 THEN {ERF} ELSE 0 END)) AS p FROM z) SELECT id, round(p,6) AS p FROM p WHERE p >= 0.3",
    ),
    "l7_heuristic": (
        lambda s, d: _show(L_.heuristic_filter(_alerts(s, d))),
        ALERTS + ", x AS (SELECT *, 0.5+0.2*confidence+0.15*least(severity,3)/3+CASE WHEN value > 0 THEN 0.1 ELSE 0 END+0.1 AS sc FROM al) SELECT id, type, address, round(CASE WHEN sc > 0.7 THEN least(CAST(0.95 AS DOUBLE), confidence*1.1) ELSE confidence*0.8 END,6) AS confidence, severity FROM x WHERE sc > 0.3",
    ),
    "l8_correlate": (
        lambda s, d: _round(L_.correlate_alerts(_alerts(s, d), 7200), "confidence", "strength"),
        ALERTS.replace("WITH n_", "WITH RECURSIVE n_", 1) + """, o AS (SELECT address, epoch_us(timestamp) AS us, type, severity, confidence, row_number() OVER (PARTITION BY address ORDER BY epoch_us(timestamp), type, confidence) AS i FROM al),
 w AS (SELECT address, i, us AS anchor, us, type, severity, confidence FROM o WHERE i = 1 UNION ALL SELECT o.address, o.i, CASE WHEN o.us - w.anchor <= 7200000000 THEN w.anchor ELSE o.us END, o.us, o.type, o.severity, o.confidence FROM w JOIN o ON o.address = w.address AND o.i = w.i+1)
 SELECT address, anchor AS start_us, max(us) AS end_us, count(*) AS n, string_agg(DISTINCT type, ',' ORDER BY type) AS types, max(severity) AS severity, round(CASE WHEN count(*) > 1 THEN least(CAST(0.95 AS DOUBLE), sum(confidence)/count(*)*1.2) ELSE sum(confidence) END,6) AS confidence, round(least(CAST(1 AS DOUBLE), CAST(0.3*count(DISTINCT type)+0.1*count(*) AS DOUBLE)),6) AS strength FROM w GROUP BY 1,2""",
    ),
    "l9_priority_score": (lambda s, d: _round(_scored(s, d).select("id", "priority"), "priority"), ALERTS + DEDUP + ACC + PRIORITY + "SELECT id, round(priority,6) AS priority FROM pr"),
    "l9_priority_of_correlated": (
        lambda s, d: _round(_correlated(s, d).select("id", "correlated", "priority"), "priority"),
        CORRELATED + ACC + """
SELECT id, correlated, round(least(1.0, (0.25*greatest(least(confidence, 1), 0) + 0.2*CASE severity WHEN 1 THEN 0.33 WHEN 2 THEN 0.67 ELSE 1 END
 + 0.2*greatest(least(1.0, coalesce(value, 0)*5000/1e6), CASE WHEN type='error' THEN 0.8 ELSE 0 END) + 0.15*CASE WHEN hours < 1 THEN 1.0 WHEN hours < 6 THEN 0.8 WHEN hours < 24 THEN 0.6 WHEN hours < 72 THEN 0.4 ELSE 0.2 END
 + 0.1*least(1.0, 0.5 + correlated/10) + 0.1*coalesce(accuracy, 0.5))
 * CASE WHEN type='click' THEN 1.2 ELSE 1 END * CASE WHEN balance > 1e15 THEN 1.15 ELSE 1 END * CASE WHEN reward THEN 0.8 ELSE 1 END * CASE WHEN hour(timestamp) BETWEEN 2 AND 5 THEN 1.1 ELSE 1 END), 6) AS priority
FROM co LEFT JOIN ac USING (type) LEFT JOIN a USING (address)""",
    ),
    "l10_priority_levels": (lambda s, d: L_.priority_levels(_scored(s, d)).select("id", "rank", "level"), ALERTS + DEDUP + ACC + PRIORITY + LEVEL + "SELECT id, rank, level FROM lv"),
    "l11_priority_summary": (
        lambda s, d: _round(L_.priority_summary(L_.priority_levels(_scored(s, d))), "mean_priority", "top_priority"),
        ALERTS + DEDUP + ACC + PRIORITY + LEVEL + "SELECT level, type, count(*) AS n, round(avg(priority),6) AS mean_priority, round(max(priority),6) AS top_priority FROM lv GROUP BY 1,2",
    ),
    "l12_detector_accuracy": (lambda s, d: _round(L_.detector_accuracy(_feedback(s, d)), "accuracy"), LEDGER + ACC + "SELECT type, n, round(CAST(accuracy AS DOUBLE),6) AS accuracy FROM ac"),
    "l13_reduction_report": (
        lambda s, d: _round(_stages(s, d), "kept"),
        ALERTS + WHITE + KNOWN + CONTEXT + ", r AS (SELECT 0 AS position, 'formatted' AS stage, count(*) AS alerts FROM al UNION ALL SELECT 1, 'whitelist', count(*) FROM wl UNION ALL SELECT 2, 'known', count(*) FROM kp UNION ALL SELECT 3, 'context', count(*) FROM cx) SELECT *, round(alerts/(SELECT count(*) FROM al),6) AS kept FROM r",
    ),
    "l14_run_pipeline": (
        lambda s, d: _round(L_.run_pipeline(_detections(s, d), _white(s, d), L.accounts(s, d), _rules(s, d), _feedback(s, d), _as_of(s, d)).drop("value"), "confidence", "priority"),
        ALERTS + WHITE + KNOWN + CONTEXT + SIGNIFICANT + HEURISTIC + DEDUP.replace("FROM al", "FROM hx") + ACC + PRIORITY + LEVEL
        + "SELECT type, address, minute, id, count, first_seen, last_seen, severity, round(confidence,6) AS confidence, round(priority,6) AS priority, rank, level FROM lv",
    ),
}
