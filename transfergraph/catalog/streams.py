"""Streams over the driver's events, each against the SQL of its batch twin."""

from pyspark.sql import functions as F


from ..operators import metrics as M
from ..sources import ledger as L
from ..streaming import jobs as S
from ..streaming.awakening import awakenings
from ..streaming.rescoring import rescore_strength
from . import anomalies as N
from . import scoring as R
from .base import LEDGER
from .filters import UNIT, _as_of, _edges
from .windows import _round


def _events(s, d):
    return S.read_stream(s, d, "events.parquet", L.events(s, d).schema)


def _stream(s, d):
    """The ledger as a stream: the same projection, with the number of users from the batch table."""
    k = L.events(s, d).agg((F.max("user_id") + 1).alias("k"))
    to = (F.col("user_id") * 31 + F.col("event_id") * 17 + 7) % F.col("k")
    e = _events(s, d).where("event_type = 'purchase'").crossJoin(F.broadcast(k))  # one row
    return e.select(
        F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("hash"), F.col("event_id").alias("block_number"), F.col("ts").cast("timestamp").alias("timestamp"), L.address(F.col("user_id")).alias("from_address"), L.address(to).alias("to_address"),
        (F.round(F.col("value") * 100).cast("long") * 10**10).cast("decimal(38,0)").alias("value"), (F.col("event_id") % 20 != 0).alias("success"),
    )


def _ntz(df, *names):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in names})


def _twice(s, d):
    t = _stream(s, d)
    return S.run_to_table(S.dedup(t.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("copy")))).drop("copy")


def _alerts(s, d):
    e = _events(s, d).where("event_type <> 'purchase'")
    return S.run_to_table(S.alert_dedup(e.select(F.col("event_type").alias("type"), L.address(F.col("user_id")).alias("address"), F.col("ts").cast("timestamp").alias("timestamp"), F.least(F.col("value") / 100, F.lit(1.0)).alias("confidence"))))


def _sent(df, at):
    return df.select(F.col("event_id").alias("message"), (F.col("value") * 100).cast("long").alias("sent_value"), at.alias("sent_at"))


def _received(df, at):
    v = (F.col("value") * 100).cast("long")
    return df.where("event_id % 4 <> 0").select(F.col("event_id").alias("message"), F.when(F.col("event_id") % 7 == 0, v + 1).when(F.col("event_id") % 5 == 0, F.floor(v * 0.8)).otherwise(v).alias("received_value"), at.alias("received_at"), (F.col("event_id") % 5 == 0).alias("charged"))


def _link(s, d):
    at = F.col("ts").cast("timestamp")
    return S.run_to_table(S.link(_sent(_events(s, d), at), _received(_events(s, d), at + F.expr("INTERVAL 1 MINUTE"))))


def _link_batch(s, d):
    e = L.events(s, d)
    return S.link_batch(_sent(e, F.col("ts")), _received(e, F.col("ts")))


# Append mode gives out what the watermark has passed: windows that end by the last event less the delay.
LAST = "(SELECT max(timestamp) FROM t)"

def _link_as_of(s, d):
    """As of the last event; what is divisible by 9 takes two hours, and every 50th message is received without a trace of its sender."""
    e = L.events(s, d)
    took = F.when(F.col("event_id") % 9 == 0, F.expr("INTERVAL 2 HOURS")).otherwise(F.expr("INTERVAL 1 MINUTE"))
    return S.link_as_of(_sent(e, F.col("ts")).where("message % 50 <> 1"), _received(e, F.col("ts") + took).drop("charged"), e.agg(F.max("ts").alias("now")), 7 * 86_400)


LINK = "SELECT event_id AS message, CASE WHEN event_id%4=0 THEN 'not_found' WHEN event_id%7=0 THEN 'invalid' WHEN event_id%5=0 AND (CAST(trunc(value*100) AS BIGINT) - floor(CAST(trunc(value*100) AS BIGINT)*0.8))/CAST(trunc(value*100) AS BIGINT) > 0.05 THEN 'suspicious_fee' ELSE 'completed' END AS status FROM events"

QUERIES = {
    "st1_stream_transfers": (lambda s, d: _ntz(S.run_to_table(_stream(s, d)), "timestamp"), LEDGER + "SELECT * FROM t"),
    "st2_stream_dedup": (lambda s, d: _ntz(_twice(s, d), "timestamp"), LEDGER + "SELECT * FROM t"),
    "st3_stream_edges": (lambda s, d: _ntz(S.edges_snapshot(_stream(s, d)), "first_transfer_time", "last_transfer_time"), LEDGER + "SELECT * FROM e"),
    "st4_stream_rescore": (
        lambda s, d: _round(S.rescore(_stream(s, d), _edges(s, d), _as_of(s, d)), "score", n=4),
        LEDGER + "SELECT from_address, to_address, round(greatest(1.0, CASE WHEN total_volume > 0 THEN least(50.0, log10(CAST(total_volume AS DOUBLE)/1e12)*10) ELSE 0 END + least(30.0, 2*transfer_count) + greatest(0, 20 - floor(((SELECT epoch_us(as_of) FROM latest_)-epoch_us(last_transfer_time))/1000000.0/86400))),4) AS score FROM e",
    ),
    "st4_stream_strength": (
        lambda s, d: rescore_strength(_stream(s, d), L.accounts(s, d), M.pagerank(_edges(s, d), 3), _as_of(s, d)).select("from_address", "to_address", F.round("strength", 1).alias("strength"), F.round("adjusted", 3).alias("adjusted")),
        R.QUERIES["r6_strength"][1],
    ),
    "st5_stream_dispersion": (
        lambda s, d: S.run_to_table(S.dispersion(_stream(s, d), 1000, 2)).groupBy("from_address", "bucket").agg(F.max("recipients").alias("recipients")),
        LEDGER + "SELECT from_address, block_number//1000*1000 AS bucket, count(DISTINCT to_address) AS recipients FROM t GROUP BY 1,2 HAVING count(DISTINCT to_address) > 2",
    ),
    "st6_stream_alert_dedup": (
        lambda s, d: _ntz(_alerts(s, d), "minute"),
        LEDGER + "SELECT pattern_type AS type, address, date_trunc('minute', detected_at) AS minute, count(*) AS count, max(confidence) AS confidence FROM det GROUP BY 1,2,3 HAVING date_trunc('minute', detected_at) + INTERVAL 1 MINUTE <= (SELECT max(detected_at) FROM det) - INTERVAL 10 MINUTE",
    ),
    "st7_stream_bursts": (
        lambda s, d: _ntz(S.run_to_table(S.bursts(_stream(s, d), "1 hour", "30 minutes")), "start", "end"),
        LEDGER + f", w AS (SELECT address, value, time_bucket(INTERVAL 30 MINUTE, timestamp) - k * INTERVAL 30 MINUTE AS start FROM l, (VALUES (0), (1)) v(k)) SELECT address, start, start + INTERVAL 1 HOUR AS \"end\", count(*) AS n, CAST(sum(value) AS DECIMAL(38,0)) AS volume FROM w WHERE start + INTERVAL 1 HOUR <= {LAST} - INTERVAL 1 HOUR GROUP BY 1,2",
    ),
    "st8_stream_sessions": (
        lambda s, d: _ntz(S.run_to_table(S.activity_sessions(_stream(s, d), "6 hours")), "start", "end"),
        LEDGER + f", g AS (SELECT *, sum(CASE WHEN p IS NULL OR epoch_us(timestamp)-p > 21600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY from_address ORDER BY timestamp, hash ROWS UNBOUNDED PRECEDING) AS ss FROM (SELECT *, epoch_us(lag(timestamp) OVER (PARTITION BY from_address ORDER BY timestamp, hash)) AS p FROM t)) SELECT from_address, min(timestamp) AS start, max(timestamp) + INTERVAL 6 HOUR AS \"end\", count(*) AS n, CAST(sum(value) AS DECIMAL(38,0)) AS volume FROM g GROUP BY from_address, ss HAVING max(timestamp) + INTERVAL 6 HOUR <= {LAST} - INTERVAL 1 HOUR",
    ),
    "st8_stream_awakening": (
        lambda s, d: _round(S.run_to_table(awakenings(_stream(s, d), 2.0)).withColumn("mean_gap", F.round(F.col("mean_gap") + 0.0123, 1)), "sent", "received", "dormant_days", "volume_factor", "confidence", n=4),
        # the sessions of n13_awakening that the watermark has closed: their last event is over two days and an hour before the last of all
        N.QUERIES["n13_awakening"][1].replace("sum(gap) AS gs FROM", "sum(gap) AS gs, max(timestamp) AS last FROM").replace("round(mg+1e-6,4)", "round(mg+0.0123,1)").replace("WHERE session > 1", f"WHERE session > 1 AND last + INTERVAL 2 DAY < {LAST} - INTERVAL 1 HOUR"),
    ),
    "st9_stream_watch": (
        lambda s, d: S.run_to_table(S.watch(_stream(s, d), L.accounts(s, d).where("node_type = 'mixer'"), 200 * UNIT)),
        LEDGER + "SELECT hash, l.address, 'watched_address' AS rule FROM l JOIN a ON a.address = l.address AND node_type='mixer' UNION ALL SELECT hash, from_address, 'large_transfer' FROM t WHERE value >= 200000000000000",
    ),
    "st10_block_link": (_link_batch, LINK),
    "st10_link_as_of": (
        _link_as_of,
        """WITH n AS (SELECT max(ts) AS now FROM events), v AS (SELECT event_id, ts, CAST(trunc(value*100) AS BIGINT) AS v, now FROM events, n),
 s AS (SELECT event_id, v, ts, now FROM v WHERE event_id%50 <> 1),
 r AS (SELECT event_id, CASE WHEN event_id%7=0 THEN v+1 WHEN event_id%5=0 THEN floor(v*0.8) ELSE v END AS r, ts + CASE WHEN event_id%9=0 THEN INTERVAL 2 HOURS ELSE INTERVAL 1 MINUTE END AS arrived, now FROM v WHERE event_id%4 <> 0),
 k AS (SELECT * FROM r WHERE arrived <= now)
 SELECT coalesce(s.event_id, k.event_id) AS message, CASE WHEN s.event_id IS NULL THEN 'not_found' WHEN k.event_id IS NULL AND s.now <= s.ts + INTERVAL 7 DAYS THEN 'pending' WHEN k.event_id IS NULL THEN 'not_found'
 WHEN k.r > s.v THEN 'invalid' WHEN (s.v - k.r)/s.v > 0.05 THEN 'suspicious_fee' ELSE 'completed' END AS status FROM s FULL JOIN k ON s.event_id = k.event_id""",
    ),
    "st10_stream_block_link": (lambda s, d: _link(s, d).where("status <> 'not_found'"), f"SELECT * FROM ({LINK}) WHERE status <> 'not_found'"),
}
