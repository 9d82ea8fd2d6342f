from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.times import days_between, micros
from ..plans.ranges import as_of
from ..sources import ledger as L
from .base import LEDGER
from .filters import _as_of, _edges
from .windows import _round

_t = L.transfers
ERF = "(1 - (((((1.061405429*tt - 1.453152027)*tt) + 1.421413741)*tt - 0.284496736)*tt + 0.254829592)*tt*exp(-zz*zz))"
WHOLE = "CAST(value AS HUGEINT)//1000000000000"


def _cast(s, d):
    text = F.col("value").cast("string")
    return _t(s, d).select("hash", text.cast("decimal(38,0)").alias("exact"), F.expr("try_cast(substring(cast(value as string), 1, 4) as int)").alias("small"), (text.cast("double") / 1e12).alias("approx"), F.nullif(F.col("value") % 10**12, F.lit(0).cast("decimal(38,0)")).alias("fraction"))


def _math(s, d):
    x = F.col("value").cast("double") / 1e12
    return _t(s, d).select("hash", S.ieee_log10(x).alias("log"), F.sqrt(x).alias("root"), F.pow(x, 0.25).alias("power"), F.exp(-x / 100).alias("decay"), F.ceil(x).alias("up"), F.floor(x).alias("down"), F.abs(x - 50).alias("far"), F.round(x, 1).alias("near"), F.greatest(F.lit(1.0), F.least(x, F.lit(100.0))).alias("clipped"))


def _dates(s, d):
    t = F.col("timestamp")
    return _t(s, d).select("hash", F.hour(t).alias("hour"), (F.dayofweek(t) - 1).alias("weekday"), F.to_date(t).alias("day"), (F.floor(micros(t) / 300_000_000) * 300).alias("bucket"), (F.floor(F.col("block_number") / 10) * 10).alias("block_bucket"), (t + F.expr("INTERVAL 1 HOUR")).alias("later"))


def _text(s, d):
    a = L.accounts(s, d)
    v = F.col("balance").cast("string")
    return a.select(
        "address", F.concat(F.col("address"), F.lit("/"), F.coalesce("display", F.lit("-"))).alias("joined"), F.col("address").like("U0001%").alias("is_like"), F.lower("display").alias("lowered"), F.length("address").alias("size"), (F.length(v) - F.length(F.regexp_replace(v, "0*$", ""))).alias("zeros"), F.sha2("address", 256).alias("key"),
        F.coalesce(F.col("display").rlike("[02468]$"), F.lit(False)).alias("matches"), F.split(F.col("address"), "0")[0].alias("head"),
    )


def _arrays(s, d):
    g = _t(s, d).groupBy("from_address").agg(F.array_sort(F.collect_set("to_address")).alias("p"))
    return g.select("from_address", F.array_join("p", ",").alias("partners"), F.array_contains("p", "U000003").alias("has"), F.array_join(F.slice("p", 1, 3), ">").alias("first"), F.element_at("p", -1).alias("last"), F.size(F.array_append("p", F.lit("x"))).alias("size"))


def _json(s, d):
    e = L.events(s, d)
    return e.select("event_id", F.from_json("props", "k long").getField("k").alias("k"), F.to_json(F.struct("event_id", "event_type")).alias("json"))


def _conditionals(s, d):
    risk = F.col("risk_score")
    band = F.when(risk >= 75, "high").when(risk.between(40, 74.5), "medium").otherwise("low")
    return L.accounts(s, d).select("address", F.coalesce("legal", "display", "address").alias("name"), F.nullif("node_type", F.lit("regular")).alias("special"), band.alias("band"), F.col("node_type").isin("exchange", "mixer").alias("watched"))


def _rounding(s, d):
    x = F.col("value").cast("double") / 1e12
    return _t(s, d).select("hash", F.abs(x - 50).alias("far"), F.round(x, 1).alias("near"), F.pmod(F.col("value"), F.lit(10**12).cast("decimal(38,0)")).cast("long").alias("rest"), F.pmod("block_number", F.lit(7)).alias("residue"))


def _powers(s, d):
    x = F.col("total_volume").cast("double") / 1e12
    n = F.col("transfer_count").cast("double")
    return _edges(s, d).select("from_address", "to_address", F.log10(x + 1).alias("log"), F.sqrt(x / n).alias("root"), F.pow(n, 1.5).alias("power"), F.exp(-n / 10).alias("decay"), F.ceil(x / n).alias("up"), F.floor(x / n).alias("down"))


def _differences(s, d):
    week = F.col("timestamp") >= F.col("as_of") - F.expr("INTERVAL 7 DAYS")
    return _t(s, d).crossJoin(F.broadcast(_as_of(s, d))).select("hash", days_between(F.col("timestamp"), F.col("as_of")).alias("days"), week.alias("recent"), (F.col("timestamp") + F.expr("INTERVAL 1 HOUR")).alias("later"))


def _paths(s, d):
    path = F.array("from_address", "to_address")
    longer = S.extend_path(path, F.lit("U000003"))
    return _t(s, d).select("hash", F.array_contains(path, "U000003").alias("has"), F.array_join(longer, ",").alias("longer"), F.array_join(F.slice(longer, 2, 2), ",").alias("rest"), F.array_join(S.path_edges(longer), ",").alias("edges"))


def _sorted(s, d):
    v = F.array(*(F.col(c).cast("double") for c in ("l_quantity", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice")))
    t = s.read.parquet(f"{d}/lineitem.parquet")
    return t.select("l_orderkey", "l_linenumber", F.array_sort(v)[0].alias("least"), S.index_quantile(v, 0.25).alias("q1"), S.index_quantile(v, 0.75).alias("q3"), S.top_values(v, 2)[1].alias("second"))


def _json_groups(s, d):
    """Groups of ten blocks hold ten transfers at most."""
    rows = _t(s, d).withColumn("blocks", S.block_bucket(F.col("block_number"), 10))
    item = F.struct(F.col("block_number").alias("block"), "hash")
    return rows.groupBy("blocks").agg(F.to_json(F.array_sort(F.collect_list(item))).alias("items"), F.to_json(F.array(F.min("block_number"), F.max("block_number"))).alias("span"), F.to_json(F.struct(F.count("*").alias("n"))).alias("object"))


def _priced(s, d):
    """Each transfer at the last price before it; the values of clicks are read as prices."""
    quotes = L.events(s, d).where("event_type = 'click'").select(micros("ts").alias("at"), F.col("value").alias("price"))
    priced = as_of(_t(s, d).withColumn("us", micros("timestamp")), quotes, "us", "at", "price", 86400 * 10**6)
    return _round(priced.select("hash", "price", S.price(F.col("value"), F.col("price")).alias("usd")), "usd", n=4)


QUERIES = {
    "f1_casts": (
        lambda s, d: _round(_cast(s, d), "approx"),
        LEDGER + "SELECT hash, value AS exact, TRY_CAST(substring(CAST(value AS VARCHAR),1,4) AS INTEGER) AS small, round(CAST(value AS DOUBLE)/1e12,6) AS approx, CAST(nullif(value % 1000000000000, 0) AS DECIMAL(38,0)) AS fraction FROM t",
    ),
    "f3_math": (
        lambda s, d: _round(_math(s, d), "log", "root", "power", "decay", "far", "near", "clipped"),
        LEDGER + ", x AS (SELECT hash, CAST(value AS DOUBLE)/1e12 AS x FROM t) SELECT hash, round(log10(x),6) AS log, round(sqrt(x),6) AS root, round(pow(x,0.25),6) AS power, round(exp(-x/100),6) AS decay, CAST(ceil(x) AS BIGINT) AS up, CAST(floor(x) AS BIGINT) AS down, round(abs(x-50),6) AS far, round(x,1) AS near, round(greatest(CAST(1 AS DOUBLE), least(x, CAST(100 AS DOUBLE))),6) AS clipped FROM x",
    ),
    "f6_normal_cdf": (
        lambda s, d: _round(_t(s, d).select("hash", S.normal_cdf((F.col("value").cast("double") / 1e12 - 50) / 30).alias("p")), "p"),
        LEDGER + f", z AS (SELECT hash, (CAST(value AS DOUBLE)/1e12-50)/30/sqrt(2) AS zz FROM t), y AS (SELECT hash, zz, 1/(1+0.3275911*abs(zz)) AS tt FROM z) SELECT hash, round(0.5*(1+sign(zz)*{ERF}),6) AS p FROM y",
    ),
    "f7_isolation_depth": (
        lambda s, d: _round(_edges(s, d).groupBy("from_address").agg(F.count("*").alias("n")).select("from_address", S.isolation_depth(F.col("n")).alias("depth")), "depth"),
        LEDGER + "SELECT from_address, round(CASE WHEN count(*) > 1 THEN 2*(ln(count(*)-1)+0.5772156649)-2*(count(*)-1)/count(*) ELSE 0 END,6) AS depth FROM e GROUP BY 1",
    ),
    "f9_dates": (
        _dates,
        LEDGER + "SELECT hash, hour(timestamp) AS hour, dayofweek(timestamp) AS weekday, CAST(timestamp AS DATE) AS day, epoch_us(timestamp)//300000000*300 AS bucket, block_number//10*10 AS block_bucket, timestamp + INTERVAL 1 HOUR AS later FROM t",
    ),
    "f11_text": (
        _text,
        LEDGER + "SELECT address, concat(address,'/',coalesce(display,'-')) AS joined, address LIKE 'U0001%' AS is_like, lower(display) AS lowered, length(address) AS size, length(CAST(balance AS VARCHAR))-length(rtrim(CAST(balance AS VARCHAR),'0')) AS zeros, sha256(address) AS key, coalesce(regexp_matches(display,'[02468]$'),FALSE) AS matches, split_part(address,'0',1) AS head FROM a",
    ),
    "f14_arrays": (
        _arrays,
        LEDGER + ", g AS (SELECT from_address, list_sort(list(DISTINCT to_address)) AS p FROM t GROUP BY 1) SELECT from_address, array_to_string(p,',') AS partners, list_contains(p,'U000003') AS has, array_to_string(p[1:3],'>') AS first, p[-1] AS last, len(p)+1 AS size FROM g",
    ),
    "f18_json": (_json, """SELECT event_id, CAST(json_extract(props,'$.k') AS BIGINT) AS k, concat('{"event_id":',event_id,',"event_type":"',event_type,'"}') AS json FROM events"""),
    "f20_format_amount": (
        lambda s, d: _edges(s, d).select("from_address", "to_address", S.format_amount(F.col("total_volume") * 1000).alias("amount"), S.transfer_label(F.col("transfer_count"), F.col("total_volume") * 1000).alias("label")),
        LEDGER + ", x AS (SELECT from_address, to_address, transfer_count, CAST(CAST(total_volume AS HUGEINT)*1000//1000000000000 AS BIGINT) AS w FROM e) SELECT from_address, to_address, concat(CASE WHEN w >= 1000000 THEN format('{:,.1f}', w//100000/10)||'M' WHEN w >= 1000 THEN format('{:,.1f}', w//100/10)||'K' ELSE format('{:,}', w) END, ' UNIT') AS amount, concat(transfer_count, ' ⇆ ', format('{:,}', w)) AS label FROM x",
    ),
    "f21_log_scale": (
        lambda s, d: _round(_t(s, d).select("hash", S.log_scale(F.col("value").cast("double"), 1e12, 1e14).alias("scale")), "scale"),
        LEDGER + "SELECT hash, round(least(CAST(1 AS DOUBLE), greatest(CAST(0 AS DOUBLE), (log10(greatest(CAST(value AS DOUBLE),1e12))-12)/2)),6) AS scale FROM t",
    ),
    "f22_truncate_address": (
        lambda s, d: L.accounts(s, d).select("address", S.truncate_address(F.concat(F.lit("prefix"), "address"), 6, 4).alias("short")),
        LEDGER + "SELECT address, concat('prefix','...',right(address,4)) AS short FROM a",
    ),
    "f23_relative_time": (
        lambda s, d: _t(s, d).crossJoin(F.broadcast(_as_of(s, d))).select("hash", S.relative_time((micros("as_of") - micros("timestamp")) / 1_000_000).alias("ago")),
        LEDGER + ", x AS (SELECT hash, (epoch_us(as_of)-epoch_us(timestamp))/1000000.0 AS s FROM t, latest_) SELECT hash, CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN concat(CAST(floor(s/60) AS BIGINT),'m ago') WHEN s < 86400 THEN concat(CAST(floor(s/3600) AS BIGINT),'h ago') ELSE concat(CAST(floor(s/86400) AS BIGINT),'d ago') END AS ago FROM x",
    ),
    "f24_edge_keys": (
        lambda s, d: _edges(s, d).select(S.undirected_key(F.col("from_address"), F.col("to_address")).alias("pair"), S.edge_id(F.col("from_address"), F.col("to_address")).alias("edge")),
        LEDGER + "SELECT concat(least(from_address,to_address),'-',greatest(from_address,to_address)) AS pair, concat(from_address,'->',to_address) AS edge FROM e",
    ),
    "f25_address_shape": (
        lambda s, d: L.accounts(s, d).select("address", S.looks_like_address(F.concat(F.lit("x" * 38), F.translate("address", "0", "1"), F.lit("zz"))).alias("valid"), S.looks_like_address(F.col("address")).alias("raw"), S.repair_address(F.col("address")).alias("repaired")),
        LEDGER + "SELECT address, regexp_matches(concat(repeat('x',38),translate(address,'0','1'),'zz'),'^[1-9A-HJ-NP-Za-km-z]{46,}$') AS valid, regexp_matches(address,'^[1-9A-HJ-NP-Za-km-z]{46,}$') AS raw, translate(address,'0OIl','oo11') AS repaired FROM a",
    ),
    "f27_price": (
        lambda s, d: _round(_t(s, d).select("hash", S.price(F.col("value"), F.lit(6.5)).alias("usd")), "usd", n=4),
        LEDGER + "SELECT hash, round(CAST(value AS DOUBLE)/1000000000000*CAST(6.5 AS DOUBLE),4) AS usd FROM t",
    ),
    "f27_price_as_of": (
        _priced,
        LEDGER + ", q AS (SELECT ts AS at, max(value) AS price FROM events WHERE event_type = 'click' GROUP BY 1) SELECT hash, price, round(CAST(value AS DOUBLE)/1000000000000*price,4) AS usd FROM t ASOF LEFT JOIN q ON t.timestamp >= q.at",
    ),
    "f2_conditionals": (
        _conditionals,
        LEDGER + "SELECT address, coalesce(legal,display,address) AS name, nullif(node_type,'regular') AS special, CASE WHEN risk_score >= 75 THEN 'high' WHEN risk_score BETWEEN 40 AND 74.5 THEN 'medium' ELSE 'low' END AS band, node_type IN ('exchange','mixer') AS watched FROM a",
    ),
    "f4_rounding": (
        lambda s, d: _round(_rounding(s, d), "far", "near"),
        LEDGER + "SELECT hash, round(abs(CAST(value AS DOUBLE)/1e12-50),6) AS far, round(CAST(value AS DOUBLE)/1e12,1) AS near, CAST(value % 1000000000000 AS BIGINT) AS rest, block_number % 7 AS residue FROM t",
    ),
    "f5_powers": (
        lambda s, d: _round(_powers(s, d), "log", "root", "power", "decay"),
        LEDGER + ", y AS (SELECT from_address, to_address, CAST(total_volume AS DOUBLE)/1e12 AS x, CAST(transfer_count AS DOUBLE) AS n FROM e) SELECT from_address, to_address, round(log10(x+1),6) AS log, round(sqrt(x/n),6) AS root, round(pow(n,1.5),6) AS power, round(exp(-n/10),6) AS decay, CAST(ceil(x/n) AS BIGINT) AS up, CAST(floor(x/n) AS BIGINT) AS down FROM y",
    ),
    "f8_time_differences": (
        lambda s, d: _round(_differences(s, d), "days"),
        LEDGER + "SELECT hash, round((epoch_us(as_of)-epoch_us(timestamp))/CAST(86400000000 AS DOUBLE),6) AS days, timestamp >= as_of - INTERVAL 7 DAYS AS recent, timestamp + INTERVAL 1 HOUR AS later FROM t, latest_",
    ),
    "f10_buckets": (
        lambda s, d: _t(s, d).groupBy(S.time_bucket(F.col("timestamp")).alias("bucket"), S.block_bucket(F.col("block_number"), 100).alias("blocks")).agg(F.count("*").alias("n")),
        LEDGER + "SELECT epoch_us(timestamp)//300000000*300 AS bucket, block_number//100*100 AS blocks, count(*) AS n FROM t GROUP BY 1,2",
    ),
    "f12_trailing_zeros": (
        lambda s, d: _t(s, d).select("hash", F.length(F.col("value").cast("string")).alias("digits"), S.trailing_zeros(F.col("value")).alias("zeros")),
        LEDGER + "SELECT hash, length(CAST(value AS VARCHAR)) AS digits, length(CAST(value AS VARCHAR))-length(rtrim(CAST(value AS VARCHAR),'0')) AS zeros FROM t",
    ),
    "f13_regexp": (
        lambda s, d: _t(s, d).where(F.col("to_address").rlike("^U0+[13579]*$")).select("hash", "to_address", F.regexp_extract("to_address", "0([1-9][0-9]*)$", 1).alias("number")),
        LEDGER + "SELECT hash, to_address, regexp_extract(to_address,'0([1-9][0-9]*)$',1) AS number FROM t WHERE regexp_matches(to_address,'^U0+[13579]*$')",
    ),
    "f15_split": (
        lambda s, d: _edges(s, d).select(F.concat_ws(" -> ", "from_address", "to_address").alias("path")).select("path", F.split("path", " -> ")[0].alias("head"), F.element_at(F.split("path", " -> "), -1).alias("tail"), F.size(F.split("path", ",")).alias("parts")),
        LEDGER + "SELECT concat(from_address,' -> ',to_address) AS path, from_address AS head, to_address AS tail, 1 AS parts FROM e",
    ),
    "f16_path_arrays": (
        _paths,
        LEDGER + ", p AS (SELECT hash, from_address AS x, to_address AS y, 'U000003' IN (from_address,to_address) AS has FROM t) SELECT hash, has, CASE WHEN NOT has THEN concat(x,',',y,',U000003') END AS longer, CASE WHEN NOT has THEN concat(y,',U000003') END AS rest, CASE WHEN NOT has THEN concat(x,'->',y,',',y,'->U000003') END AS edges FROM p",
    ),
    "f17_sorted_arrays": (
        _sorted,
        "WITH v AS (SELECT l_orderkey, l_linenumber, list_sort([l_quantity, CAST(l_partkey AS DOUBLE), CAST(l_suppkey AS DOUBLE), CAST(l_linenumber AS DOUBLE), l_extendedprice]) AS v FROM lineitem) SELECT l_orderkey, l_linenumber, v[1] AS least, v[2] AS q1, v[4] AS q3, v[4] AS second FROM v",
    ),
    "f19_json_groups": (
        _json_groups,
        LEDGER + """SELECT block_number//10*10 AS blocks, concat('[',string_agg(concat('{"block":',block_number,',"hash":"',hash,'"}'),',' ORDER BY block_number),']') AS items, concat('[',min(block_number),',',max(block_number),']') AS span, concat('{"n":',count(*),'}') AS object FROM t GROUP BY 1""",
    ),
    "f26_key_hashes": (
        lambda s, d: _edges(s, d).select("from_address", "to_address", F.sha2(F.concat_ws("|", "from_address", "to_address"), 256).alias("key"), F.md5(S.undirected_key(F.col("from_address"), F.col("to_address"))).alias("pair_key")),
        LEDGER + "SELECT from_address, to_address, sha256(concat(from_address,'|',to_address)) AS key, md5(concat(least(from_address,to_address),'-',greatest(from_address,to_address))) AS pair_key FROM e",
    ),
}
