from pyspark.sql import functions as F

from ..operators import sets as U
from ..operators import windows as W
from ..sources import ledger as L
from .base import LEDGER
from .filters import _edges
from .joins import _metrics

_t = L.transfers
GAPS = ", g AS (SELECT *, (epoch_us(timestamp) - epoch_us(lag(timestamp) OVER w))/1000000.0 AS gap_before, (epoch_us(lead(timestamp) OVER w) - epoch_us(timestamp))/1000000.0 AS gap_after FROM t WINDOW w AS (PARTITION BY from_address ORDER BY timestamp, hash))"
BALANCES = ", bal AS (SELECT address, timestamp, hash, direction, CAST(sum(CASE WHEN direction='in' THEN value ELSE -value END) OVER (PARTITION BY address ORDER BY timestamp, hash, direction ROWS UNBOUNDED PRECEDING) AS DOUBLE)/1e12 AS balance FROM l)"


def _round(df, *names, n=6):
    return df.withColumns({c: F.round(c, n) for c in names})


def _round_scaled(df, *names, n=6):
    """Rounded as the SQL engine rounds doubles: what 10^n times the value rounds to, over 10^n (F.round goes by the decimal digits, which differs at ties)."""
    return df.withColumns({c: F.round(F.col(c) * float(10**n)) / float(10**n) for c in names})


def _hist(n):
    return f", h AS (SELECT *, list_sort(array_agg(balance) OVER (PARTITION BY address ORDER BY timestamp, hash, direction ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)) AS h FROM bal)"


QUERIES = {
    "w1_percent_rank": (
        lambda s, d: _round(W.percent_rank(W.percent_rank(_edges(s, d), "total_volume", "volume_pr"), "transfer_count", "count_pr").select("from_address", "to_address", "volume_pr", "count_pr"), "volume_pr", "count_pr"),
        LEDGER + "SELECT from_address, to_address, round(percent_rank() OVER (ORDER BY total_volume),6) AS volume_pr, round(percent_rank() OVER (ORDER BY transfer_count),6) AS count_pr FROM e",
    ),
    "w2_strict_rank": (
        lambda s, d: _round(W.strict_rank_fraction(_edges(s, d), "total_volume", "share").select("from_address", "to_address", "share"), "share"),
        LEDGER + "SELECT from_address, to_address, round((rank() OVER (ORDER BY total_volume) - 1)/count(*) OVER (),6) AS share FROM e",
    ),
    "w3_gaps": (lambda s, d: W.inter_transfer_gaps(_t(s, d)).select("hash", "gap_before", "gap_after"), LEDGER + GAPS + "SELECT hash, gap_before, gap_after FROM g"),
    "w4_periodic_pairs": (
        lambda s, d: _round(W.periodic_pairs(_t(s, d), 1.0, None, 3), "mean_gap", "stddev_gap", n=4),
        LEDGER + ", g AS (SELECT *, (epoch_us(timestamp) - epoch_us(lag(timestamp) OVER (PARTITION BY from_address, to_address ORDER BY timestamp, hash)))/1000000.0 AS gap FROM t) SELECT from_address, to_address, count(*) AS n, round(avg(gap),4) AS mean_gap, round(stddev_samp(gap),4) AS stddev_gap FROM g GROUP BY 1,2 HAVING count(*) >= 3 AND stddev_samp(gap) < avg(gap)",
    ),
    "w5_rank_per_parent": (lambda s, d: W.rank_per_parent(_edges(s, d)).select("from_address", "to_address", "rank"), LEDGER + "SELECT from_address, to_address, row_number() OVER (PARTITION BY from_address ORDER BY total_volume DESC, to_address) AS rank FROM e"),
    "w6_node_rankings": (
        lambda s, d: _round(W.node_rankings(_metrics(s, d), ["degree", "total_volume_in"]).select("address", "degree_rank", "degree_percentile", "total_volume_in_rank", "total_volume_in_percentile", "category"), "degree_percentile", "total_volume_in_percentile"),
        LEDGER + ", r AS (SELECT address, rank() OVER (ORDER BY degree DESC) AS degree_rank, round(100.0*(rank() OVER (ORDER BY degree)-1)/count(*) OVER (),6) AS degree_percentile, rank() OVER (ORDER BY total_volume_in DESC) AS total_volume_in_rank, round(100.0*(rank() OVER (ORDER BY total_volume_in)-1)/count(*) OVER (),6) AS total_volume_in_percentile FROM m) "
        "SELECT *, CASE WHEN degree_rank <= 20 THEN 'hub' WHEN degree_rank <= 50 THEN 'connector' ELSE 'peripheral' END AS category FROM r",
    ),
    "w7_sessions": (
        lambda s, d: W.sessions(_t(s, d), 86400),
        LEDGER + ", s AS (SELECT *, sum(CASE WHEN p IS NULL OR epoch_us(timestamp) - p > 86400000000 THEN 1 ELSE 0 END) OVER (PARTITION BY from_address ORDER BY timestamp, hash ROWS UNBOUNDED PRECEDING) AS session FROM (SELECT *, epoch_us(lag(timestamp) OVER (PARTITION BY from_address ORDER BY timestamp, hash)) AS p FROM t)) "
        'SELECT from_address, CAST(session AS BIGINT) AS session, count(*) AS n, min(timestamp) AS start, max(timestamp) AS "end", CAST(sum(value) AS DECIMAL(38,0)) AS volume FROM s GROUP BY 1,2',
    ),
    "w8_rolling_activity": (
        lambda s, d: W.rolling_activity(_t(s, d), (300, 900, 3600)).select("address", "hash", "direction", *(f"{c}_{w}" for w in (300, 900, 3600) for c in ("n", "volume", "partners"))),
        LEDGER + "SELECT address, hash, direction, " + ", ".join(f"count(*) OVER w{k} AS n_{k}, CAST(sum(value) OVER w{k} AS DECIMAL(38,0)) AS volume_{k}, len(list_distinct(array_agg(other) OVER w{k})) AS partners_{k}" for k in (300, 900, 3600))
        + " FROM l WINDOW " + ", ".join(f"w{k} AS (PARTITION BY address ORDER BY epoch_us(timestamp) RANGE BETWEEN {k}000000 PRECEDING AND CURRENT ROW)" for k in (300, 900, 3600)),
    ),
    "w9_balance_profile": (
        lambda s, d: _round(W.balance_profile(W.balance_events(_t(s, d))), "ema", "deviation", "mean_change", "last_balance"),
        LEDGER.replace("WITH n_", "WITH RECURSIVE n_", 1) + BALANCES + ", o AS (SELECT *, row_number() OVER (PARTITION BY address ORDER BY timestamp, hash, direction) AS i FROM bal), f AS (SELECT address, i, balance AS ema, CAST(0 AS DOUBLE) AS dev, CAST(0 AS DOUBLE) AS change, balance AS last FROM o WHERE i = 1 "
        "UNION ALL SELECT o.address, o.i, 0.1*o.balance + 0.9*f.ema, 0.1*abs(o.balance - (0.1*o.balance + 0.9*f.ema)) + 0.9*f.dev, f.change + (abs(o.balance - f.last) - f.change)/f.i, o.balance FROM f JOIN o ON o.address = f.address AND o.i = f.i + 1) "
        "SELECT address, i AS n, round(ema,6) AS ema, round(dev,6) AS deviation, round(change,6) AS mean_change, round(last,6) AS last_balance, least(i,100) AS kept FROM f QUALIFY row_number() OVER (PARTITION BY address ORDER BY i DESC) = 1",
    ),
    "w10_robust_zscore": (
        lambda s, d: _round(W.robust_zscore(W.balance_events(_t(s, d))).drop("timestamp"), "balance", "median", "mad", "z"),
        LEDGER + BALANCES + _hist(30) + ", q AS (SELECT *, CASE WHEN len(h) > 0 THEN list_median(h) END AS md FROM h), r AS (SELECT *, list_median(list_transform(h, lambda x: abs(x - md))) AS md2 FROM q), z AS (SELECT *, CASE WHEN len(h) >= 5 AND md2 > 0 THEN 0.6745*(balance - md)/md2 END AS z FROM r) "
        "SELECT address, hash, direction, round(balance,6) AS balance, round(md,6) AS median, round(md2,6) AS mad, round(z,6) AS z, coalesce(abs(z) > 3.5, FALSE) AS outlier FROM z",
    ),
    "w11_iqr_outliers": (
        lambda s, d: _round(W.iqr_outliers(W.balance_events(_t(s, d))).drop("timestamp"), "balance", "q1", "q3"),
        LEDGER + BALANCES + _hist(100) + ", q AS (SELECT *, CASE WHEN len(h) >= 5 THEN h[CAST(floor(len(h)*0.25) AS INTEGER)+1] END AS q1, CASE WHEN len(h) >= 5 THEN h[CAST(floor(len(h)*0.75) AS INTEGER)+1] END AS q3 FROM h) SELECT address, hash, direction, round(balance,6) AS balance, round(q1,6) AS q1, round(q3,6) AS q3, coalesce(balance < q1 - 1.5*(q3-q1) OR balance > q3 + 1.5*(q3-q1), FALSE) AS outlier FROM q",
    ),
    "w12_linear_trend": (
        lambda s, d: _round(W.linear_trend(U.undirected_view(_t(s, d)).withColumn("units", F.col("value").cast("double") / 1e12), "address", "units", ["timestamp", "hash", "direction"]), "slope", "first", "relative"),
        LEDGER + ", x AS (SELECT address, row_number() OVER (PARTITION BY address ORDER BY timestamp, hash, direction) - 1 AS x, CAST(value AS DOUBLE)/1e12 AS y FROM l), r AS (SELECT address, count(*) AS n, regr_slope(y, x) AS slope, arg_min(y, x) AS f FROM x GROUP BY 1) SELECT address, n, round(slope,6) AS slope, round(f,6) AS first, round(CASE WHEN f <> 0 THEN slope/f END,6) AS relative FROM r",
    ),
    "w13_periodicity": (
        lambda s, d: _round(W.periodicity(_t(s, d)), "periodicity"),
        LEDGER + GAPS + ", mn AS (SELECT from_address, avg(gap_before) AS mean, count(*) AS n FROM g WHERE gap_before IS NOT NULL GROUP BY 1) SELECT from_address, any_value(n) AS n, round(CASE WHEN any_value(mean) > 0 THEN 1 - least(avg(abs(gap_before-mean))/any_value(mean),1) ELSE 0 END,6) AS periodicity FROM g JOIN mn USING (from_address) WHERE gap_before IS NOT NULL GROUP BY 1",
    ),
    "w14_uniformity": (
        lambda s, d: _round(W.uniformity(_t(s, d), "from_address", "value"), "uniformity"),
        LEDGER + "SELECT from_address, count(*) AS n, round(CASE WHEN avg(CAST(value AS DOUBLE)) <> 0 THEN greatest(0, 1 - stddev_pop(CAST(value AS DOUBLE))/avg(CAST(value AS DOUBLE))) ELSE 0 END,6) AS uniformity FROM t GROUP BY 1",
    ),
}
