"""SQL of the ledger, for the oracles; its rows are those of sources.ledger and operators.aggregates.build_edges."""

LEDGER = """WITH n_ AS (SELECT max(user_id)+1 AS k FROM events),
t AS (SELECT concat('e',CAST(event_id AS VARCHAR)) AS hash, event_id AS block_number, ts AS timestamp, concat('U',lpad(CAST(user_id AS VARCHAR),6,'0')) AS from_address,
 concat('U',lpad(CAST((user_id*31+event_id*17+7)%k AS VARCHAR),6,'0')) AS to_address, CAST(CAST(round(value*100) AS BIGINT)*10000000000 AS DECIMAL(38,0)) AS value, event_id%20<>0 AS success
 FROM events CROSS JOIN n_ WHERE event_type='purchase'),
a AS (SELECT u.user_id, concat('U',lpad(CAST(u.user_id AS VARCHAR),6,'0')) AS address, CASE WHEN u.user_id%3=0 THEN concat('Name ',CAST(u.user_id AS VARCHAR)) END AS display,
 CASE WHEN u.user_id%6=0 THEN concat('Legal ',CAST(u.user_id AS VARCHAR)) END AS legal, u.user_id%9=0 AS verified,
 CAST(greatest(CAST(round(coalesce(c_acctbal,0.0)*100) AS BIGINT)*10000000000,0) AS DECIMAL(38,0)) AS balance, TIMESTAMP '2023-12-15 00:00:00' + to_days(CAST(u.user_id%40 AS INTEGER)) AS created_at,
 CAST((u.user_id*7)%101 AS DOUBLE) AS risk_score, CASE u.user_id%25 WHEN 0 THEN 'exchange' WHEN 1 THEN 'mixer' WHEN 2 THEN 'validator' ELSE 'regular' END AS node_type
 FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN customer ON c_custkey = u.user_id),
e AS (SELECT from_address, to_address, count(*) AS transfer_count, CAST(sum(value) AS DECIMAL(38,0)) AS total_volume, min(block_number) AS first_transfer_block, max(block_number) AS last_transfer_block,
 min(timestamp) AS first_transfer_time, max(timestamp) AS last_transfer_time FROM t GROUP BY 1,2),
l AS (SELECT from_address AS address, to_address AS other, 'out' AS direction, hash, block_number, timestamp, value, success FROM t
 UNION ALL SELECT to_address, from_address, 'in', hash, block_number, timestamp, value, success FROM t),
ue AS (SELECT from_address AS address, to_address AS other, 'out' AS direction, transfer_count, total_volume, first_transfer_block, last_transfer_block, first_transfer_time, last_transfer_time FROM e
 UNION ALL SELECT to_address, from_address, 'in', transfer_count, total_volume, first_transfer_block, last_transfer_block, first_transfer_time, last_transfer_time FROM e),
m AS (SELECT d.*, risk_score, node_type FROM (SELECT address, count(*) AS degree, count(*) FILTER (WHERE direction='in') AS in_degree, count(*) FILTER (WHERE direction='out') AS out_degree,
 CAST(coalesce(sum(total_volume) FILTER (WHERE direction='in'),0) AS DECIMAL(38,0)) AS total_volume_in, CAST(coalesce(sum(total_volume) FILTER (WHERE direction='out'),0) AS DECIMAL(38,0)) AS total_volume_out
 FROM ue GROUP BY address) d LEFT JOIN a USING (address)),
latest_ AS (SELECT max(timestamp) AS as_of FROM t),
seeds AS (SELECT address FROM a WHERE user_id % 100 = 0),
det AS (SELECT event_id AS detection_id, concat('U',lpad(CAST(user_id AS VARCHAR),6,'0')) AS address, event_type AS pattern_type, least(value/100, 1.0) AS confidence,
 CASE event_id%4 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' ELSE 'critical' END AS severity, event_id%7=0 AS reviewed, event_id%11=0 AS false_positive, ts AS detected_at
 FROM events WHERE event_type <> 'purchase')
"""
